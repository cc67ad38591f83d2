"""Bounded samples that don't depend on how many tasks read the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = 1 << 30
SPARE = 3


def distinct_sample(df: DataFrame, column: str, rows: int) -> list[str]:
    """At most ``rows`` distinct non-null values, those with the smallest hashes, on the driver.

    The distinct values are counted first (about); a filter on the hash then
    keeps about SPARE x rows of them wherever they are, so tasks send no more
    than that each. A value counts once, however many rows have it.
    """
    values = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull())
    n = values.agg(F.approx_count_distinct("v", 0.02)).first()[0]
    key = F.pmod(F.xxhash64("v"), F.lit(SPACE))
    kept = values if n <= SPARE * rows else values.filter(key < int(SPACE * SPARE * rows / n))
    got = kept.select("v", key.alias("k")).distinct().collect()
    return [r["v"] for r in sorted(got, key=lambda r: (r["k"], r["v"]))[:rows]]
