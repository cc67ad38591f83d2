"""Filling containers of fixed capacity with whole texts (problem 8).

Conflict-constrained best fit, the largest items first. Open bins stand in
order of their residual room and carry bitmaps of their sources and duplicate
clusters; the search for the smallest residual that is large enough goes on to
the next until a bin is found that doesn't hold the item's cluster yet, nor,
with ``per_source``, so many of its source. Without that limit, among equally
tight bins one without the item's source comes first. Items are dealt
to shards by their hash; every shard is packed by itself, which leaves at most
a few bins a shard less full than one packing of everything would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: items of a shard, about
SHARD = 50_000
#: fixed: the public word-punctuation tokenizer \w+|[^\w\s]+ with \w and \s as Unicode has them
WORDS = r"[\p{L}\p{N}_]+"
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKENS = WORDS + r"|[^\p{L}\p{N}_" + SPACE + r"]+"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKENS))


class Bins:
    """The open bins of one shard and capacity.

    Bins of one residual are grouped by their bitmap of sources: of those that
    they hold, or, with ``per_source``, of those of which they hold that many.
    Whole groups are passed over at once, so no bin is looked at only to find
    that its sources don't suit.
    """

    def __init__(self, capacity: int, per_source: int | None = None):
        self.capacity, self.per_source = capacity, per_source
        self.at: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.mask = 0
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.members: list[set[int]] = []
        self.counts: list[dict[int, int]] = []
        self.bits: dict[int, int] = {}

    def _open(self) -> int:
        self.sources.append(0)
        self.clusters.append(0)
        self.members.append(set())
        self.counts.append({})
        return len(self.sources) - 1

    def _holds(self, b: int, cluster: int) -> bool:
        return bool(self.clusters[b] >> (cluster & 63) & 1) and cluster in self.members[b]

    def _put(self, b: int, residual: int, bit: int, cluster: int) -> None:
        if self.per_source is None:
            self.sources[b] |= bit
        else:
            n = self.counts[b][bit] = self.counts[b].get(bit, 0) + 1
            if n >= self.per_source:
                self.sources[b] |= bit
        self.clusters[b] |= 1 << (cluster & 63)
        self.members[b].add(cluster)
        self.at[residual].setdefault(self.sources[b], []).append(b)
        self.mask |= 1 << residual

    def _take(self, r: int, bit: int, cluster: int) -> int | None:
        """A compatible bin of residual r, one without the source if there is one."""
        groups = self.at[r]
        for lacking in (True, False) if self.per_source is None else (True,):
            for key, row in groups.items():
                if bool(key & bit) is lacking:
                    continue
                for k in range(len(row) - 1, -1, -1):
                    if not self._holds(row[k], cluster):
                        b = row.pop(k)
                        if not row:
                            del groups[key]
                            if not groups:
                                self.mask &= ~(1 << r)
                        return b
        return None

    def place(self, need: int, source: int, cluster: int, start: int = 0) -> tuple[int, int]:
        """(bin, residual at which it was found): the tightest compatible bin from residual ``start`` on, or a new one."""
        bit = self.bits.get(source)
        if bit is None:
            bit = self.bits[source] = 1 << len(self.bits)
        r = max(need, start)
        while True:
            above = self.mask >> r
            if not above:
                break
            r += (above & -above).bit_length() - 1
            b = self._take(r, bit, cluster)
            if b is not None:
                self._put(b, r - need, bit, cluster)
                return b, r
            r += 1
        b = self._open()
        self._put(b, self.capacity - need, bit, cluster)
        return b, self.capacity + 1


def pack(items: Iterator[tuple], capacity: int, per_source: int | None = None) -> Iterator[tuple]:
    """(id, piece, size, bin) for items (id, size, source, cluster), the largest first and clusters together.

    Only an item that is larger than the capacity is split: into full pieces
    that are alone in their bins, and a rest that is packed as an item.
    """
    bins, rests = Bins(capacity, per_source), []
    last, start = None, 0

    def put(i, piece, size, source, cluster):
        nonlocal last, start
        # copies come one after another: none of the bins passed over for the last is open to the next
        same = (size, cluster) if per_source is None else (size, cluster, source)
        if same != last:
            last, start = same, 0
        b, start = bins.place(size, source, cluster, start)
        return i, piece, size, b

    for i, size, source, cluster in items:
        if size > capacity:
            full, rest = divmod(size, capacity)
            for piece in range(full):
                yield i, piece, capacity, bins._open()
            if rest:
                rests.append((rest, cluster, i, full, source))
            continue
        if rests:
            rests.sort(reverse=True)
            while rests and rests[0][0] >= size:
                rest, c, j, piece, s = rests.pop(0)
                yield put(j, piece, rest, s, c)
        yield put(i, 0, size, source, cluster)
    for rest, c, j, piece, s in sorted(rests, reverse=True):
        yield put(j, piece, rest, s, c)


def packed(
    docs: DataFrame,
    limits: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokens: str = "n_tokens",
    source: str = "source",
    shard: int = SHARD,
    per_source: int | None = None,
) -> DataFrame:
    """(container_kind, capacity_tokens, bin_id, doc_id, piece, tokens): every text once per kind of container.

    Sizes are ``tokens``, counted where that is null; a null text is empty, and
    empty texts take no room but have a bin. Rows with a null id are left out.
    Texts of equal words in order are copies and never share a bin;
    ``per_source`` also limits the texts of one source in a bin. Kinds of no or
    null capacity raise an error. The limits are a fixed small table and are
    collected.
    """
    kinds = [(r[0], r[1]) for r in limits.select("container_kind", "capacity_tokens").distinct().limit(10_001).collect()]
    if len(kinds) > 10_000 or any(k is None or not c or c < 1 for k, c in kinds):
        raise ValueError("container kinds must be few and their capacities positive")
    body = F.coalesce(F.col(text), F.lit(""))
    items = docs.filter(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(tokens).cast("int"), token_count(body)).alias("size"),
        F.xxhash64(F.coalesce(F.col(source), F.lit(""))).alias("source"),
        F.xxhash64(F.regexp_replace(F.lower(body), r"\s+", " ")).alias("cluster"),
    )
    shards = max(1, -(-docs.count() // shard))
    # copies are dealt over all shards like other texts, so a hot text doesn't fill one; a shard is a task, without hashing its number again
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))
    dealt = dealt.sortWithinPartitions(F.desc("size"), "cluster", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import itertools

        batches = iter(batches)
        first = next(batches, None)
        if first is None or not len(first):
            return
        shard_no = int(first["shard"].iloc[0])
        # all kinds read the items once
        rows = [r for b in itertools.chain([first], batches) for r in zip(b["doc_id"].tolist(), b["size"].tolist(), b["source"].tolist(), b["cluster"].tolist())]
        for kind, capacity in kinds:
            made = list(pack(iter(rows), capacity, per_source))
            yield pd.DataFrame(
                {
                    "container_kind": kind,
                    "capacity_tokens": capacity,
                    "bin_id": [f"{kind}-{shard_no}-{m[3]}" for m in made],
                    "doc_id": [m[0] for m in made],
                    "piece": [m[1] for m in made],
                    "tokens": [m[2] for m in made],
                }
            )

    return dealt.mapInPandas(run, "container_kind string, capacity_tokens int, bin_id string, doc_id long, piece int, tokens int")


def fill(packs: DataFrame) -> DataFrame:
    """(container_kind, capacity_tokens, bins, items, tokens, unused_share)."""
    bins = packs.groupBy("container_kind", "capacity_tokens", "bin_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return bins.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("bins"),
        F.sum("items").alias("items"),
        F.sum("tokens").alias("tokens"),
        F.round(1 - F.sum("tokens") / (F.count("*") * F.first("capacity_tokens")), 6).alias("unused_share"),
    )
