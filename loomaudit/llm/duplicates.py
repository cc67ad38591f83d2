"""Records equal but for formatting (problem 6).

Columns are dictionary-encoded while they are read: each task canonicalises
every distinct value once and replaces it by an integer, so that no text is
shuffled. Records become tuples of integers (group and title, description,
sorted description fields), and the tuples are grouped. Identifiers are
64-bit hashes of the canonical value, not counters, so all tasks, and one that
is run again, give the same ones; two records are taken for equal only if two
independent ones agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomaudit.operators.skew import join_hot
from loomaudit.session import cut

FIELD_BREAK = re.compile(r"[;|·\n\r]+")
FIELD = re.compile(r"[^:]*[^\W_][^:]*:.*[^\W_].*", re.S)
OTHER = re.compile(r"[\W_]+")
#: entries of a task's dictionary before it starts anew
ENTRIES = 500_000


def identifier(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - 2**63


def canonical(text: str) -> str:
    """Unicode letters and digits in order, regardless of case."""
    return OTHER.sub("", text.casefold())


def field_parts(text: str) -> list[str] | None:
    """The fields of a text made up only of two or more ``name: value`` fields, else None."""
    parts = [p for p in map(str.strip, FIELD_BREAK.split(text)) if p]
    return parts if len(parts) >= 2 and all(map(FIELD.fullmatch, parts)) else None


class Dictionary(dict):
    """Distinct value to (identifier of its letters and digits or None, identifier of its sorted fields or None, another identifier)."""

    def __missing__(self, text: str | None) -> tuple[int | None, int | None, int]:
        if text is None:
            return None, None, 0
        if len(self) >= ENTRIES:
            self.clear()
        whole = canonical(text)
        parts = field_parts(text)
        fields = identifier(",".join(map(str, sorted(identifier(canonical(p)) for p in parts)))) if parts else None
        self[text] = got = (identifier(whole) if whole else None, fields, identifier(whole, 1))
        return got


def encode(rows: DataFrame, group: str, row_id: str, title: str, description: str) -> DataFrame:
    """(_gt, _whole, _fields, _id): each record as integers; rows with neither text are left out.

    _gt stands for group and title, _whole for the description's letters and
    digits, _fields for its sorted fields (null where it isn't made of fields).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        titles, descriptions, groups = Dictionary(), Dictionary(), {}
        for b in batches:
            out = []
            for g, i, t, d in zip(b["g"], b["id"], b["t"], b["d"]):
                (ti, _, other), (whole, fields, _) = titles[t], descriptions[d]
                if ti is None and whole is None:
                    continue
                gi = groups.get(g)
                if gi is None:
                    gi = groups[g] = identifier(g)
                # a record without a description is told by a second identifier of its title
                out.append((hash((gi, ti or 0)), hash((other, gi, 1)) if whole is None else whole, fields, i))
            f = pd.DataFrame(out, columns=["_gt", "_whole", "_fields", "_id"])
            f["_fields"] = f["_fields"].astype("Int64")
            yield f

    slim = rows.select(
        F.col(group).cast("string").alias("g"), F.col(row_id).cast("long").alias("id"), F.col(title).alias("t"), F.col(description).alias("d")
    ).filter("g is not null and id is not null")
    return slim.mapInPandas(run, "_gt bigint, _whole bigint, _fields bigint, _id bigint")


def _merged_readings(forms: DataFrame, codes: DataFrame) -> DataFrame:
    """forms with ``key`` the same for all readings as fields that one text joins.

    Only where the same letters and digits are read as fields in two ways;
    repeats until no label changes.
    """
    edges = codes.filter("_fields is not null").groupBy("_gt", "_whole", "_fields").agg(F.count("*").alias("m")).select("_gt", "_whole", "_fields")
    label = edges.withColumn("key", F.col("_fields"))
    while True:
        step = label.withColumn("new", F.min("key").over(W.partitionBy("_gt", "_whole")))
        step = step.withColumn("new", F.min("new").over(W.partitionBy("_gt", "_fields")))
        step = cut(step)
        label = step.select("_gt", "_whole", "_fields", F.col("new").alias("key"))
        if step.filter("new <> key").isEmpty():
            break
    best = label.groupBy("_gt", "_whole").agg(F.min("key").alias("linked"))
    return forms.join(best, ["_gt", "_whole"], "left").withColumn("key", F.coalesce("linked", "key")).drop("linked")


def copy_sets(codes: DataFrame) -> DataFrame:
    """(_gt, _whole, first, copies, n): per encoded description its set's smallest row_id and size; sets of one are left out.

    Two descriptions belong together if either the letters and digits or the
    sorted fields agree.
    """
    forms = codes.groupBy("_gt", "_whole").agg(
        F.min("_id").alias("id"), F.count("*").alias("n"), F.min("_fields").alias("key"), F.max("_fields").alias("other")
    )
    several = not forms.filter("key <> other").isEmpty()
    forms = forms.withColumn("key", F.coalesce("key", "_whole")).drop("other")
    if several:
        forms = _merged_readings(forms, codes)
    # the group holds one row per different description, not per record
    same = W.partitionBy("_gt", "key")
    sets = forms.withColumn("first", F.min("id").over(same)).withColumn("copies", F.sum("n").over(same))
    return sets.filter("copies > 1").select("_gt", "_whole", "first", "copies", "n")


def copies(rows: DataFrame, group: str = "crawl_id", row_id: str = "row_id", title: str = "title", description: str = "description") -> DataFrame:
    """(first_row_id, row_id): every further record of a set of equal ones, with the set's smallest row_id.

    Records compare within ``group``; a null group or row_id leaves a row out,
    null text is the same as empty, an empty table gives no rows. Hot sets are
    pre-aggregated and salted, nothing is collected.
    """
    codes = cut(encode(rows, group, row_id, title, description))
    pairs = join_hot(codes.select("_gt", "_whole", "_id"), copy_sets(codes).drop("copies"), ["_gt", "_whole"], "n", "_id")
    return pairs.filter(F.col("_id") != F.col("first")).select(F.col("first").alias("first_row_id"), F.col("_id").alias("row_id"))


def representatives(rows: DataFrame, group: str = "crawl_id", row_id: str = "row_id", title: str = "title", description: str = "description") -> DataFrame:
    """(group, first_row_id, copies): one record per set of two or more."""
    sets = copy_sets(cut(encode(rows, group, row_id, title, description))).groupBy("first").agg(F.max("copies").alias("copies"))
    return sets.join(rows.select(group, F.col(row_id).alias("first")), "first").select(group, F.col("first").alias("first_row_id"), "copies")
