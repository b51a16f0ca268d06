"""Join helpers with an explicit, checked broadcast decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when its row count is known and at most this many
# rows (and it is narrow); otherwise the join shuffles both sides.
BROADCAST_MAX_ROWS = 1_000_000


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               small_rows: int | None = None, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join ``small`` into ``big``; broadcast it only when ``small_rows`` (a
    proven bound, e.g. a count already computed or a fixed dictionary size)
    is within ``max_rows``.  Without a bound, leave the choice to the
    planner (AQE converts to broadcast at runtime when the measured size is
    below ``spark.sql.adaptive.autoBroadcastJoinThreshold``)."""
    if small_rows is not None and small_rows <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, parts: int = 256) -> DataFrame:
    """Left join with ``right``, which has one row a key and in ``weight``
    what bounds the left rows that hold the key.

    Weights add up to ``total``, so no more than ``parts`` keys have at
    least 1/``parts`` of it.  Those go to every task; each of the other keys is
    small, and they are shuffled.  No key, however frequent, meets its
    rows in one task."""
    hot = F.broadcast(right.where(F.col(weight) * parts >= total).drop(weight))
    rest = right.where(F.col(weight) * parts < total).drop(weight)
    cold = left.join(hot.select(*on), on, "left_anti").join(rest, on, "left")
    return left.join(hot, on).unionByName(cold)
