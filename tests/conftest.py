import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from casetriage.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    # tests own their checkpoint folder (the cluster sets spark.checkpoint.dir)
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ct-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from casetriage.sources.fixtures import BASE_TABLES
    cons = {}

    def get(sf_dir):
        if sf_dir not in cons:
            con = duckdb.connect()
            for t in BASE_TABLES:
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
            cons[sf_dir] = con
        return cons[sf_dir]
    return get
