"""Changes between consecutive full snapshots (problem 4).

A bucketed index holds, for each key of the last snapshot, a 128-bit hash of
the compared values. A new snapshot probes it: keys that only
the index has were removed, keys that only the snapshot has were added, keys
with another hash were changed. Old values are fetched for changed keys alone,
then the new index replaces the old one.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomaudit.session import cut, get_text, list_folder, remove, shared_dir, swap_text

#: rows of a bucket, about
ROWS = 200_000


def value_hash(columns: list[str]) -> Column:
    """128 bits over the columns; null and each value differ, and null equals null."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *reversed(parts)).alias("b"))


def consecutive(crawls: DataFrame) -> DataFrame:
    """(base_url, crawl_id, seq, next_crawl_id) of completed crawls in order of started_at within a root.

    Repeated rows count once; equal started_at are ordered by crawl_id.
    Crawls without a root or an id are left out.
    """
    done = (
        crawls.filter((F.col("status") == "completed") & F.col("base_url").isNotNull() & F.col("crawl_id").isNotNull())
        .groupBy("crawl_id")
        .agg(F.min_by("base_url", F.struct("started_at", "base_url")).alias("base_url"), F.min("started_at").alias("started_at"))
    )
    w = W.partitionBy("base_url").orderBy("started_at", "crawl_id")
    return done.select(
        "base_url", "crawl_id", F.row_number().over(w).alias("seq"), F.lead("crawl_id").over(w).alias("next_crawl_id")
    )


@dataclass
class SnapshotIndex:
    """The bucketed key-to-hash index of the last snapshot: ``advance`` gives the changes and swaps the index.

    Each version is a bucketed table of its own in ``folder``: a new snapshot
    is shuffled once, into the buckets, and meets the stored index bucket by
    bucket without another shuffle of either side. A file CURRENT names the
    version in force; the swap is the rename of that file, so a job that dies
    leaves the old index valid, and what it left is removed by the next one.
    The number of buckets follows from the first snapshot (ROWS rows a bucket)
    and is set anew when a snapshot has grown or shrunk fourfold. One writer at
    a time is assumed.

    ``latest`` chooses between rows of the same key (the largest holds, equal
    ones by the hash); without it the keys must be unique. ``carry`` are columns
    kept beside the hash. Rows with a null key are left out.
    """

    spark: SparkSession
    folder: str
    keys: list[str]
    values: list[str]
    carry: list[str] = field(default_factory=list)
    latest: list[str] = field(default_factory=list)
    buckets: int | None = None

    def _current(self) -> dict | None:
        text = get_text(self.spark, os.path.join(self.folder, "CURRENT"))
        return json.loads(text) if text else None

    def _entries(self, snapshot: DataFrame, buckets: int) -> DataFrame:
        known = F.lit(True)
        for k in self.keys:
            known = known & F.col(k).isNotNull()
        e = snapshot.filter(known).select(*self.keys, *self.carry, value_hash(self.values).alias("hash"), F.struct(*(self.latest or [F.lit(0)])).alias("_at"))
        e = e.repartition(buckets, *self.keys)
        if self.latest:
            # the rows of a key lie together already, so this is no second shuffle
            kept = F.max_by(F.struct("hash", *self.carry), F.struct("_at", "hash", *self.carry)).alias("_kept")
            e = e.groupBy(*self.keys).agg(kept).select(*self.keys, "_kept.*")
        return e.select(*self.keys, *self.carry, "hash")

    def _write(self, snapshot: DataFrame, buckets: int) -> dict:
        name = f"loomaudit_index_{uuid.uuid4().hex}"
        (
            self._entries(snapshot, buckets).write.format("parquet").bucketBy(buckets, *self.keys).sortBy(*self.keys)
            .option("path", os.path.join(self.folder, name)).saveAsTable(name)
        )
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.table(name).schema.fields)
        return {"table": name, "buckets": buckets, "schema": schema}

    def _read(self, version: dict) -> DataFrame:
        """The version's table; a session that didn't write it gets to know it first."""
        if not self.spark.catalog.tableExists(version["table"]):
            by = ", ".join(f"`{k}`" for k in self.keys)
            at = os.path.join(self.folder, version["table"]).replace("'", "")
            self.spark.sql(f"CREATE TABLE {version['table']} ({version['schema']}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {version['buckets']} BUCKETS LOCATION '{at}'")
        return self.spark.table(version["table"])

    def _remove_all_but(self, kept: str | None) -> None:
        for name in list_folder(self.spark, self.folder):
            if name.startswith("loomaudit_index_") and name != kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                remove(self.spark, os.path.join(self.folder, name))

    def probe(self, was: DataFrame, now: DataFrame) -> DataFrame:
        """(keys, change, was_<carry>, now_<carry>) of the keys in which two versions differ."""
        side = lambda t, s: t.select(*self.keys, F.col("hash").alias(f"{s}_hash"), *(F.col(c).alias(f"{s}_{c}") for c in self.carry))
        change = (
            F.when(F.col("was_hash").isNull(), "added").when(F.col("now_hash").isNull(), "removed").when(F.col("now_hash") != F.col("was_hash"), "changed")
        )
        pair = side(was, "was").join(side(now, "now").hint("merge"), self.keys, "full")
        carried = [f"{s}_{c}" for s in ("was", "now") for c in self.carry]
        return pair.select(*self.keys, change.alias("change"), *carried).filter(F.col("change").isNotNull())

    def advance(self, snapshot: DataFrame, previous: DataFrame | None = None) -> DataFrame:
        """(keys, change, was_<carry>, now_<carry>) and, where ``previous`` is given, the old values of changed keys in ``was``.

        The first snapshot gives no rows; an empty one removes all keys.
        """
        stored = self._current()
        self._remove_all_but(stored and stored["table"])
        n = -(-snapshot.count() // ROWS)
        wanted = self.buckets or max(1, n)
        buckets = stored["buckets"] if stored and stored["buckets"] // 4 <= wanted <= stored["buckets"] * 4 else wanted
        new = self._write(snapshot, buckets)
        now = self._read(new)
        if stored:
            out = self.probe(self._read(stored), now)
            if previous is not None:
                changed = out.filter(F.col("change") == "changed").select(*self.keys)
                old = previous.join(changed, self.keys, "left_semi").select(*self.keys, F.struct(*self.values).alias("was"))
                out = out.join(old, self.keys, "left")
            out = cut(out)
        else:
            out = self.probe(now, now).limit(0)
            if previous is not None:
                out = out.join(previous.select(*self.keys, F.struct(*self.values).alias("was")).limit(0), self.keys, "left")
            out = cut(out)
        swap_text(self.spark, os.path.join(self.folder, "CURRENT"), json.dumps(new))
        self._remove_all_but(new["table"])
        return out

    def drop(self) -> None:
        """Removes the index and its folder."""
        self._remove_all_but(None)
        remove(self.spark, self.folder)


def snapshot_changes(rows: DataFrame, crawls: DataFrame, crawl_col: str, key: str, values: list[str], latest: list[str]) -> DataFrame:
    """(crawl_id, key, change) for every crawl after the first of its root, by an index that goes from crawl to crawl.

    Step k advances one index of all roots by the k-th crawl of each, so there
    are as many steps as the root with most crawls has; each reads its own
    delivery, not all of them. Copies of a key count once, by the largest
    ``latest``. Rows with a null key are left out; a crawl without rows removes
    all pages of its root; empty tables give no rows. Two hashes differ if and
    only if the values do, but for a chance of 2^-128.
    """
    spark = rows.sparkSession
    order = consecutive(crawls).withColumnRenamed("crawl_id", "_crawl")
    slim = rows.select(F.col(crawl_col).alias("_id"), F.col(key).alias("_key"), value_hash(values).alias("_value"), F.struct(*latest).alias("_latest"))
    staged = slim.join(order, F.col("_id") == F.col("_crawl")).select("base_url", "_key", "_value", "_latest", "_crawl", "next_crawl_id", "seq")
    # the deliveries by their number, each to be read alone
    staged = cut(staged, "seq")
    steps = order.agg(F.max("seq")).first()[0] or 0
    index = SnapshotIndex(spark, os.path.join(shared_dir(spark), f"snapshots-{uuid.uuid4().hex}"), ["base_url", "_key"], ["_value"], ["_crawl", "next_crawl_id"], ["_latest"])
    out = None
    for k in range(1, steps + 1):
        found = index.advance(staged.filter(F.col("seq") == k))
        # a root without a next crawl has ended: its pages weren't removed
        crawl = F.coalesce("now__crawl", "was_next_crawl_id")
        found = found.select(crawl.alias("crawl_id"), F.col("_key").alias(key), "change").filter("crawl_id is not null")
        out = found if out is None else out.unionByName(found)
    index.drop()
    if out is None:
        return rows.select(F.col(crawl_col).cast("string").alias("crawl_id"), key, F.lit("added").alias("change")).limit(0)
    return out
