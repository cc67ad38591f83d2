"""Texts cut off by field limits or broken transfers (problem 10).

Two tries over the whole corpus are kept as tables of prefixes: one of
letters (is the last token an unknown proper prefix of known words?), one of
words (does the last sentence, as far as it goes, stand alone elsewhere, or
does it always go on?). Where they can't tell, the length does: whether texts
of the same source pile up at one length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomaudit.session import cut as cut_lineage
from loomaudit.session import spread

#: fixed patterns: what senders put in place of the rest
MARK = r"(?i)\s*(?:\(\s*(?:\.\.\.|…)\s*\)|\[\s*(?:\.\.\.|…|more)\s*\]|(?:\.\.\.|…)\s*(?:read more|more|continue reading|weiterlesen|lire la suite|leer más|czytaj dalej|читать далее)|»»|>>)\s*$"
DOTS = r"\s*(?:\.{2,}|…)\s*$"
TERMINAL = r"[.!?。！？][\"'”’»“)\]\s]*$"
OPEN = r"(?:[,;(\[{]|\p{L}[-‐‑/])\s*$"
BREAK = r"[.!?。！？…]+[\"'”’»“)\]]*\s+|\n+"
#: bits of the filter of keys that some end asks for; its size doesn't grow, beyond about a tenth as many keys it only lets more through
BITS = 1 << 26
#: a sentence start goes on if it does so that many times as often as it ends
GOES_ON = 3
#: share of a source's unfinished texts within SLACK characters below one length that makes a pile, and least number
PILE, SLACK, FEW = 0.2, 12, 5
#: a text of one line of at most so many words may be a label
LABEL = 6


_BREAK, _DOTS, _TOKENS = re.compile(BREAK), re.compile(DOTS), re.compile(r"^\s*[-*•–—]+|[^\W\d_]+|\d+")
#: flush the per-task counts at so many different starts
FLUSH = 400_000


def masked(sentence: str) -> list[str]:
    """Words in lower case; numbers become #, later capitalised words ^, so that names don't matter."""
    words = _TOKENS.findall(sentence)
    if not words:
        return []
    first = 1 if len(words) > 1 and not words[0][-1].isalnum() else 0
    return ["#" if w[0].isdigit() else "^" if i > first and w[0].isupper() else w.lower().strip() for i, w in enumerate(words)]


def starts_of(words: list[str]) -> list[int]:
    """A 64-bit key for each start of the sentence."""
    h, out = xxhash.xxh64(), []
    for w in words:
        h.update(w + "\x1f")
        out.append(h.intdigest() - 2**63)
    return out


def count_starts(batches: Iterator[pd.DataFrame], wanted: np.ndarray) -> Iterator[pd.DataFrame]:
    """How often each start of a sentence that passes the filter is the whole one, and how often it goes on."""
    full: Counter[int] = Counter()
    on: Counter[int] = Counter()

    def out() -> pd.DataFrame:
        keys = list(on.keys() | full.keys())
        return pd.DataFrame({"key": keys, "full": [full[k] for k in keys], "on": [on[k] for k in keys]}).astype("int64")

    for b in batches:
        keys: list[int] = []
        ends: list[int] = []
        for text in b["text"]:
            for s in _BREAK.split(text):
                if words := masked(_DOTS.sub("", s)) if s else []:
                    keys += starts_of(words)
                    ends.append(len(keys) - 1)
        if keys:
            a = np.array(keys, np.int64)
            whole = np.zeros(len(a), bool)
            whole[ends] = True
            hit = passes(a, wanted)
            full.update(a[hit & whole].tolist())
            on.update(a[hit & ~whole].tolist())
        if len(on) + len(full) > FLUSH:
            yield out()
            full.clear()
            on.clear()
    yield out()


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = keys.astype(np.uint64)
    return (u & np.uint64(BITS - 1)).astype(np.int64), ((u >> np.uint64(32)) & np.uint64(BITS - 1)).astype(np.int64)


def passes(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for at in _bits(keys):
        out &= (wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of BITS bits of the column ``key``; tasks set bits, the driver joins at most BITS / 64 words."""
    u = F.col("key")
    low = u.bitwiseAND(F.lit(BITS - 1))
    high = F.shiftrightunsigned(u, 32).bitwiseAND(F.lit(BITS - 1))
    bits = keys.select(F.explode(F.array(low, high)).alias("b"))
    rows = bits.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m")).toPandas()
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["m"].to_numpy(np.int64).astype(np.uint64)
    return out.view(np.uint8)


_MARK, _TERMINAL, _OPEN = (re.compile(x) for x in (MARK, TERMINAL, OPEN.replace(r"\p{L}", r"[^\W\d_]")))
TAIL_ROW = "doc_id long, source string, chars int, bytes int, sure string, size int, at_start boolean, alone boolean, token string, key long, stem long, print long"


def _last_token(text: str) -> str:
    i = len(text)
    while i and text[i - 1].isalpha():
        i -= 1
    return text[i:].lower()


def judge_end(end: str | None) -> tuple:
    """(sure, size, at_start, alone, token, key, stem, print) of a text by its end; ``sure`` is None where the corpus must be asked."""
    nothing = (None,) * 7
    if end is None or not (end := end.rstrip()):
        return "complete", *nothing
    near = end[-60:]
    if m := _MARK.search(near):
        kept = end[: len(end) - len(near) + m.start()]
        return "complete" if _TERMINAL.search(kept[-40:]) else "mark", *nothing
    m = _DOTS.search(near)
    kept = end[: len(end) - len(near) + m.start()] if m else end
    if _OPEN.search(kept[-40:]) or end.endswith("�"):
        return "open", *nothing
    if not m and _TERMINAL.search(kept[-40:]):
        return "complete", *nothing
    line = kept.rpartition("\n")[2]
    sentence = _BREAK.split(line)[-1]
    words = masked(sentence)
    keys = starts_of(words)
    return (
        None, len(words), line.strip() == sentence.strip(), kept.strip() == sentence.strip(), _last_token(kept),
        keys[-1] if keys else None, keys[-2] if len(keys) > 1 else None, xxhash.xxh64_intdigest(kept) - 2**63,
    )


def tails(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """TAIL_ROW of every text with an id: what its end shows by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["sure", "size", "at_start", "alone", "token", "key", "stem", "print"]
        for b in batches:
            columns = dict(zip(names, zip(*map(judge_end, b["text"])))) if len(b) else {n: () for n in names}
            out = {c: b[c] for c in ("doc_id", "source", "chars", "bytes")}
            out |= {c: pd.array(v, "Int64") if c in ("size", "key", "stem", "print") else pd.Series(v, dtype=object) for c, v in columns.items()}
            yield pd.DataFrame(out)

    d = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"),
        F.coalesce(F.length(text), F.lit(0)).alias("chars"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"),
    ).filter(F.col("doc_id").isNotNull())
    return d.mapInPandas(run, TAIL_ROW)


def letter_trie(docs: DataFrame, text: str, tokens: DataFrame) -> DataFrame:
    """(token, known, longer): occurrences of each wanted token as a word elsewhere, and of words that it properly begins.

    The trie is the table of prefixes of all distinct words; nodes that no
    token asks for are dropped by the join. Where a token is a text's own
    last one, that is no evidence and is taken off again.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    nodes = counts.select("n", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k"))
    nodes = nodes.select(F.substring(F.col("word"), F.lit(1), F.col("k")).alias("token"), (F.col("k") == F.length("word")).alias("whole"), "n")
    wanted = tokens.filter("token <> ''").groupBy("token").agg(F.count("*").alias("own"))
    return (
        nodes.join(wanted, "token")
        .groupBy("token")
        .agg(
            (F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)) - F.any_value("own")).alias("known"),
            F.sum(F.when(~F.col("whole"), F.col("n")).otherwise(0)).alias("longer"),
        )
    )


def word_trie(docs: DataFrame, text: str, ends: DataFrame) -> DataFrame:
    """(key, full, on): for each wanted sentence start, how often it is a whole sentence and how often it goes on.

    Ends of unsure texts count as whole sentences only if different texts have them.
    """
    texts = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    keys = ends.select(F.explode(F.array("key", "stem")).alias("key")).filter("key is not null")
    given = docs.sparkSession.sparkContext.broadcast(key_filter(keys))
    counted = texts.mapInPandas(lambda batches: count_starts(batches, given.value), "key bigint, full bigint, on bigint")
    counts = counted.groupBy("key").agg(F.sum("full").alias("full"), F.sum("on").alias("on"))
    end = ends.filter(F.col("key").isNotNull()).select("key", F.lit(1).alias("own_full"), F.lit(0).alias("own_on"), "print")
    stem = ends.filter(F.col("stem").isNotNull()).select(F.col("stem").alias("key"), F.lit(0).alias("own_full"), F.lit(1).alias("own_on"), F.lit(None).cast("bigint").alias("print"))
    wanted = end.unionByName(stem).groupBy("key").agg(
        F.sum("own_full").alias("own_full"), F.sum("own_on").alias("own_on"), F.min("print").alias("one"), F.max("print").alias("other")
    )
    return wanted.join(counts, "key", "left").select(
        "key",
        F.greatest(F.coalesce("full", F.lit(0)) - F.col("own_full"), F.lit(0)).alias("full"),
        F.greatest(F.coalesce("on", F.lit(0)) - F.col("own_on"), F.lit(0)).alias("on"),
        F.coalesce(F.col("one") != F.col("other"), F.lit(False)).alias("several"),
    )


def piles(unsure: DataFrame) -> DataFrame:
    """(source, limit_chars, limit_bytes): the length below which a source's unfinished texts pile up, null where they don't."""
    lengths = []
    for c in ("chars", "bytes"):
        n = unsure.groupBy("source", F.col(c).alias("size")).agg(F.count("*").alias("n"))
        w = W.partitionBy("source")
        n = n.withColumn("near", F.sum("n").over(w.orderBy("size").rangeBetween(-SLACK, 0))).withColumn("all", F.sum("n").over(w))
        top = n.groupBy("source").agg(F.max_by("size", F.struct("near", "size")).alias(f"limit_{c}"), F.max("near").alias("near"), F.max("all").alias("all"))
        lengths.append(top.select("source", F.when((F.col("near") >= FEW) & (F.col("near") >= PILE * F.col("all")), F.col(f"limit_{c}")).alias(f"limit_{c}")))
    return lengths[0].join(lengths[1], "source")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, cut, reason) for every text; null and empty texts are not cut.

    reason: mark, open (a comma, a hyphen or half a character at the end),
    word, sentence, length, or null for complete texts. Rows with a null id
    are left out; copies of a text are judged alike.
    """
    docs = spread(docs)
    d = cut_lineage(tails(docs, doc_id, text, source))
    unsure = d.filter(F.col("sure").isNull())
    starts = cut_lineage(word_trie(docs, text, unsure))
    stems = starts.select(F.col("key").alias("stem"), F.col("on").alias("stem_on"))
    u = (
        unsure.join(letter_trie(docs, text, unsure), "token", "left")
        .join(starts, "key", "left")
        .join(stems, "stem", "left")
        .join(piles(unsure), "source", "left")
    )
    near = lambda c: F.coalesce(F.col(c).between(F.col(f"limit_{c}") - SLACK, F.col(f"limit_{c}")), F.lit(False))
    at_limit = near("chars") | near("bytes")
    in_word = (F.col("token") != "") & (F.coalesce("known", F.lit(0)) <= 0) & (F.coalesce("longer", F.lit(0)) > 0)
    full, on, stem_on = (F.coalesce(c, F.lit(0)) for c in ("full", "on", "stem_on"))
    label = F.col("alone") & (F.col("size") <= LABEL) & ~at_limit
    reason = (
        F.when(F.col("size") == 0, F.when(at_limit, F.lit("length")))
        .when(in_word, F.lit("word"))
        .when(label, F.lit(None))
        .when(full > 0, F.when(on > GOES_ON * full, F.lit("sentence")).when(at_limit & (on > 0), F.lit("length")))
        .when((on > 0) | (stem_on >= GOES_ON) | F.col("key").isNull(), F.lit("sentence"))
        .when(F.col("several"), F.lit(None))
        .when(~F.col("at_start"), F.lit("sentence"))
        .when(at_limit, F.lit("length"))
    )
    u = u.select("doc_id", "source", reason.alias("reason"))
    told = d.filter(F.col("sure").isNotNull()).select("doc_id", "source", F.nullif("sure", F.lit("complete")).alias("reason"))
    return told.unionByName(u).select("doc_id", "source", F.col("reason").isNotNull().alias("cut"), "reason")


def cut_texts(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id of every cut text."""
    return judged(docs, **columns).filter("cut").select("doc_id")


def cut_rates(docs: DataFrame, **columns: str) -> DataFrame:
    """(source, texts, cut_texts, share) over all texts, empty ones included; a null source is one source."""
    return judged(docs, **columns).groupBy("source").agg(
        F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.round(F.count_if("cut") / F.count("*"), 6).alias("share")
    )
