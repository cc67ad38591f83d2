"""Percentiles of very large columns from mergeable centroid digests (problem 2).

The values of a group are sorted and cut into clusters whose size depends on
the quantile, small at the tails; a digest is the mean, weight, least and
largest value of each cluster. Digests of parts, days or files are merged by
sorting their clusters and cutting them anew. A second pass counts the values
below each estimate, which certifies its rank error. All of it is built-in
expressions; no group is ever in one task as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomaudit.operators.skew import join_hot
from loomaudit.session import cut

#: clusters of a digest, about
SIZE = 200
#: values that one task sorts for one group, and digests that it merges at once
PART, FAN = 500_000, 64
HOT = 1000
PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def bound(p: float, size: int = SIZE) -> float:
    """The rank error that is asked of an estimate at percentile p, as a share of the group.

    A cluster around quantile q holds at most about pi/size * sqrt(q(1-q)) of
    the weight; merging can join two halves, so twice that is allowed: 1.6 % at
    the median, 0.3 % at p99.
    """
    return 2 * math.pi / size * math.sqrt(p * (1 - p))


def _cluster(q: Column, size: int) -> Column:
    return F.floor(size * (F.asin(2 * q - 1) / math.pi + 0.5))


def merged(parts: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """One digest (mean, weight, low, high rows) per ``keys`` from the clusters of several.

    A cluster of one digest is never split. Group columns may be null.
    """
    order = W.partitionBy(*keys).orderBy("mean", "low", "high", "weight")
    upto = F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("weight").over(W.partitionBy(*keys))
    c = parts.withColumn("_q", (upto - F.col("weight") / 2) / total).withColumn("_k", _cluster(F.col("_q"), size))
    return c.groupBy(*keys, "_k").agg(
        (F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"),
        F.sum("weight").alias("weight"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    ).drop("_k")


def dealt(rows: DataFrame, keys: list[str], spread: str) -> tuple[DataFrame, int]:
    """rows with ``_part``, so that no (keys, _part) has much more than PART rows, and the most parts of a group.

    The HOT largest groups (a top-k, collected as HOT counts) get parts by
    their size; the others have at most 1/HOT of the rows each.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = counts.orderBy(F.desc("_n")).limit(HOT).select(F.max("_n").alias("most"), F.min("_n").alias("least")).collect()[0]
    others = max(1, -(-(hot["least"] or 0) // PART))
    most = max(others, -(-(hot["most"] or 0) // PART))
    if most == 1:
        return rows, 1
    big = counts.orderBy(F.desc("_n")).limit(HOT).select(*(F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)), F.ceil(F.col("_n") / PART).alias("_s"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    salted = rows.join(F.broadcast(big), same, "left").drop(*(f"_h{i}" for i in range(len(keys))))
    return salted.withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_s", F.lit(others))).cast("int")).drop("_s"), int(most)


def digests(values: DataFrame, keys: list[str], parts: int, size: int = SIZE) -> DataFrame:
    """(keys, mean, weight, low, high) from rows with keys, value and, for several parts, _part."""
    group = [*keys, "_part"] if parts > 1 else keys
    single = values.select(*group, F.col("value").cast("double").alias("mean"), F.lit(1).cast("long").alias("weight"))
    # equal values are one cluster at once: fewer rows to sort, and ties stay together
    single = single.groupBy(*group, "mean").agg(F.sum("weight").alias("weight"))
    out = merged(single.withColumn("low", F.col("mean")).withColumn("high", F.col("mean")), group, size)
    while parts > 1:
        parts = -(-parts // FAN)
        out = merged(out.withColumn("_part", F.pmod(F.col("_part"), F.lit(parts))), group, size)
    return out.drop("_part")  # which is 0 by now


def estimates(digest: DataFrame, keys: list[str], percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(keys, n, p50, ...): the value at each percentile, between the clusters around its rank."""
    order = W.partitionBy(*keys).orderBy("mean", "low", "high", "weight")
    upto = F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0))
    c = digest.select(*keys, "mean", "weight", "low", "high", upto.alias("upto"), F.sum("weight").over(W.partitionBy(*keys)).alias("n"))
    out = [F.max("n").alias("n")]
    for p in percentiles:
        rank = F.ceil(F.col("n") * p)
        inside = (F.col("upto") >= rank) & (F.col("upto") - F.col("weight") < rank)
        # the rank within the cluster, on the line from its least to its largest value
        share = (rank - (F.col("upto") - F.col("weight"))) / F.col("weight")
        value = F.when(F.col("weight") == 1, F.col("mean")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * share)
        out.append(F.max(F.when(inside, value)).alias(_name(p)))
    return c.groupBy(*keys).agg(*out)


def _name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def rank_errors(rows: DataFrame, found: DataFrame, keys: list[str], metrics: list[str], spread: str | None, percentiles: tuple[float, ...] = PERCENTILES, size: int = SIZE) -> DataFrame:
    """(keys, metric, rank_error, within_bound): the largest distance of an estimate's true ranks from its percentile, as a share of n, and whether each is within its own bound or one rank.

    ``rows`` has keys, none of them null, and the metrics as columns. If they
    already lie by keys they are not shuffled; else ``spread`` salts hot keys.
    """
    wide = [F.sum("n").alias("_w")]
    for m in metrics:
        mine = F.col("metric") == m
        wide += [F.max(F.when(mine, F.col("n"))).alias(f"{m}_n"), *(F.max(F.when(mine, F.col(_name(p)))).alias(f"{m}_{_name(p)}") for p in percentiles)]
    table = found.groupBy(*keys).agg(*wide)
    joined = join_hot(rows, table, keys, "_w", spread) if spread else rows.join(table, keys)
    counts, errors = [], []
    for m in metrics:
        counts.append(F.max(f"{m}_n").alias(f"{m}_n"))
        worst = []
        for p in percentiles:
            e, lt, le = (f"{m}_{_name(p)}", f"{m}_lt_{_name(p)}", f"{m}_le_{_name(p)}")
            counts += [F.count_if(F.col(m) < F.col(e)).alias(lt), F.count_if(F.col(m) <= F.col(e)).alias(le)]
            rank = F.ceil(F.col(f"{m}_n") * p)
            off = F.greatest(F.col(lt) + 1 - rank, rank - F.greatest(F.col(le), F.col(lt) + 1), F.lit(0))
            worst.append(F.struct((off / F.col(f"{m}_n")).alias("error"), (off <= F.greatest(F.lit(bound(p, size)) * F.col(f"{m}_n"), F.lit(1.0))).alias("ok")))
        all_ = F.array(*worst)
        errors.append(
            F.struct(F.lit(m).alias("metric"), F.round(F.array_max(F.transform(all_, lambda x: x["error"])), 6).alias("rank_error"), F.forall(all_, lambda x: x["ok"]).alias("within_bound"))
        )
    return joined.groupBy(*keys).agg(*counts).select(*keys, F.explode(F.array(*errors)).alias("e")).select(*keys, "e.metric", "e.rank_error", "e.within_bound")


def measured(fetches: DataFrame) -> DataFrame:
    """(site_key, fetcher_id, status, day, event_id, load_time_ms, size_bytes) of each event once.

    Redelivered events are equal rows and count once. A null or non-positive
    value is no measurement of its metric.
    """
    return fetches.filter("event_id is not null").select(
        "site_key", "fetcher_id", "status", F.to_date("event_ts").alias("day"), "event_id",
        F.when(F.col("load_time_ms") > 0, F.col("load_time_ms")).cast("long").alias("load_time_ms"),
        F.when(F.col("size_bytes") > 0, F.col("size_bytes")).cast("long").alias("size_bytes"),
    )


def long_form(rows: DataFrame, keys: list[str], metrics: list[str], *keep: str) -> DataFrame:
    """One row per value: keys, metric, value; values that are no measurement are left out."""
    return rows.select(*keys, *keep, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("v")).select(
        *keys, *keep, "v.metric", "v.value"
    ).filter("value is not null")


def _once(rows: DataFrame, keys: list[str], row_id: str) -> tuple[DataFrame, int]:
    """Each row once, lying by keys and part, and the number of parts."""
    parted, parts = dealt(rows, keys, row_id)
    by = [*keys, "_part"] if parts > 1 else keys
    return parted.repartition(*by).dropDuplicates([*by, row_id]), parts


def day_digests(rows: DataFrame, keys: list[str], metrics: list[str], row_id: str, size: int = SIZE) -> DataFrame:
    """Digests per keys and metric. One shuffle serves for taking off copies, sorting and clustering."""
    once, parts = _once(rows, keys, row_id)
    return digests(long_form(once, keys, metrics, *(["_part"] if parts > 1 else [])), [*keys, "metric"], parts, size)


def percentiles_of(rows: DataFrame, keys: list[str], metrics: list[str], row_id: str, size: int = SIZE) -> DataFrame:
    """(keys, metric, n, p50, p90, p95, p99, rank_error, within_bound); an empty table gives no rows, null keys are groups.

    Rows are shuffled twice, once for the digests and once for counting, with
    128 bits in place of their keys.
    """
    group = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]
    coded = rows.withColumns({"_a": F.xxhash64(*group), "_b": F.xxhash64(F.lit(5), *group)})
    ids = ["_a", "_b"]
    names = coded.groupBy(*ids).agg(F.any_value(F.struct(*keys)).alias("_g"))
    once, parts = _once(coded.select(*ids, row_id, *metrics), ids, row_id)
    values = long_form(once, ids, metrics, *(["_part"] if parts > 1 else []))
    found = cut(estimates(digests(values, [*ids, "metric"], parts, size), [*ids, "metric"]))
    errors = rank_errors(once.drop("_part"), found, ids, metrics, row_id if parts > 1 else None, size=size)
    out = found.join(errors, [*ids, "metric"]).join(names, ids)
    return out.select(*(F.col(f"_g.{k}").alias(k) for k in keys), *(c for c in found.columns if c not in ids), "rank_error", "within_bound")


def spans(digest: DataFrame, keys: list[str], period: str = "month", size: int = SIZE) -> DataFrame:
    """Digests of days joined into those of longer spans: ``day`` becomes the first day of its period."""
    return merged(digest.withColumn("day", F.to_date(F.date_trunc(period, "day"))), keys, size)


def spans_of(rows: DataFrame, keys: list[str], metrics: list[str], row_id: str, period: str = "month", size: int = SIZE) -> DataFrame:
    """As ``percentiles_of`` for longer spans, from stored digests of days: only these are merged, and the second pass certifies the result.

    ``keys`` include ``day``. The digests are written to the shared folder, as
    they would be day by day; the joining reads nothing else. A row that is
    delivered again on the same day counts once.
    """
    # finer by half than what is asked of the spans, since merging adds to a cluster
    stored = cut(day_digests(rows, keys, metrics, row_id, 2 * size))
    found = cut(estimates(spans(stored, [*keys, "metric"], period, size), [*keys, "metric"]))
    month = rows.dropDuplicates([*keys, row_id]).withColumn("day", F.to_date(F.date_trunc(period, "day")))
    # null keys join as a value of their own
    coded = lambda d: d.withColumns({"_a": F.xxhash64(*group), "_b": F.xxhash64(F.lit(5), *group)})
    group = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]
    ids = ["_a", "_b"]
    errors = rank_errors(coded(month).select(*ids, row_id, *metrics), coded(found), ids, metrics, row_id, size=size)
    return coded(found).join(errors, [*ids, "metric"]).drop(*ids)
