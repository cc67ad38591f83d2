"""Equi-joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
#: rows of a hot key that one task takes, about
ROWS = 1_000_000
LEAST_SALTS = 8


def join_hot(
    rows: DataFrame,
    dim: DataFrame,
    on: list[str],
    weight: str,
    spread: str,
    how: str = "inner",
    hot_keys: int = HOT_KEYS,
    salts: int | None = None,
) -> DataFrame:
    """rows joined to dim, which has one row per key and, in ``weight``, its number of rows.

    The ``hot_keys`` heaviest keys (a top-k, so the broadcast is bounded) are
    salted: their rows spread by the hash of ``spread`` over as many partitions
    as their weight asks for (ROWS rows each, or ``salts``) and their dim rows
    are repeated so often. Every key with more
    than 1/hot_keys of the rows is among them, whatever the data. Null keys
    match nothing; with how="left" they are spread as well.
    """
    wanted = F.lit(salts).cast("int") if salts else F.greatest(F.lit(LEAST_SALTS), F.ceil(F.col(weight) / ROWS)).cast("int")
    hot = dim.select(*on, weight).orderBy(F.desc(weight), *on).limit(hot_keys).select(*on, wanted.alias("_hot"))
    hot = F.broadcast(hot)
    null_key = F.lit(False)
    for c in on:
        null_key = null_key | F.col(c).isNull()
    marked = rows.join(hot, on, "left")
    own = F.xxhash64(spread)
    salt = F.when(null_key, F.pmod(own, F.lit(1 << 20)).cast("int")).otherwise(F.pmod(own, F.coalesce("_hot", F.lit(1))).cast("int"))
    marked = marked.withColumn("_salt", salt).drop("_hot")
    wide = dim.join(hot, on, "left")
    wide = wide.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_hot", F.lit(1)) - 1))
    ).drop("_hot", weight)
    return marked.join(wide, [*on, "_salt"], how).drop("_salt")
