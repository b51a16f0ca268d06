"""Every SQL-expressible query equals its DuckDB oracle on the same tables."""

import pytest

import __spark_entry__ as E
from helpers import compare

from conftest import SF_SMALL

ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    compare(E.queries()[name](spark, SF_SMALL), duck(SF_SMALL), ORACLE[name])


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(E.queries())


def test_kpis_expected_values(spark):
    """FIXTURES 2.2: the KPI row at sf0.01."""
    from conftest import SF_MID
    r = E.queries()["case_kpis"](spark, SF_MID).first()
    assert (r.total_cases, r.open_cases) == (15000, 4979)
    assert abs(r.avg_response_hours - 4.069728) < 1e-6
    assert abs(r.avg_resolution_hours - 103.380248) < 1e-6
    assert abs(r.avg_csat - 3.222222) < 1e-6
    assert abs(r.escalation_rate_pct - 15.113333) < 1e-6
    assert abs(r.sla_met_pct - 61.533333) < 1e-6
