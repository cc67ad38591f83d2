"""Evaluation passages inside corpus texts (problem 9).

One Aho-Corasick automaton holds every run of SEED words of the items' own
passages (and whole passages shorter than that), and their answers. Texts are
normalised to words with their character offsets and scanned once; each hit
gives an alignment of text to passage, which is then checked word by word. An
answer alone is no leak, as it may stand anywhere; it is told beside one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomaudit.session import spread

SEED = 4
WINDOW = 15
#: one word in eight of WINDOW, rounded up
EXCHANGED = 2
#: a word that at most so many passages hold is rare: names and numbers tell a passage from another of the same form
RARE = 3
#: items of one automaton; more are scanned in blocks
BLOCK = 20_000
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return [w.casefold() for w in WORD.findall(text)]


def shared_prefix(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def own_passages(items: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Each item's words after the wording that it shares with others.

    A shared wording is a leading sentence or line (up to . ? ! or a line
    break) that at least two items of different text begin with. Items of the
    same text don't make each other's text shared.
    """
    heads: dict[tuple[str, ...], set[str]] = defaultdict(set)
    cuts = []
    for item_id, text in items:
        text = text or ""
        ends = [m.end() for m in re.finditer(r"[.?!:](?=\s)|\n+", text)]
        cuts.append((item_id, text, ends))
        for e in ends:
            if w := tuple(words(text[:e])):
                heads[w].add(" ".join(words(text)))
    out = []
    for item_id, text, ends in cuts:
        start = 0
        for e in ends:
            if len(heads.get(tuple(words(text[:e])), ())) > 1 and words(text[e:]):
                start = e
        out.append((item_id, words(text[start:])))
    return [(i, w) for i, w in out if w]


class Scanner:
    """The automaton of some passages, which are (item_id, words, answer words); ``holders`` counts passages by word over all of them."""

    def __init__(self, passages: list[tuple[int, list[str], list[str]]], holders: Counter[str], seed: int = SEED):
        import ahocorasick

        self.passages, self.seed = passages, seed
        self.rare = [[holders[w] <= RARE for w in p] for _, p, _ in passages]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w, answer) in enumerate(passages):
            n = min(seed, len(w))
            for i in range(len(w) - n + 1):
                at[" " + " ".join(w[i : i + n]) + " "].append((k, i))
            if answer:
                at[" " + " ".join(answer) + " "].append((k, -1))
        self.automaton = ahocorasick.Automaton()
        for key, places in at.items():
            self.automaton.add_word(key, (key.count(" ") - 1, places))
        if at:
            self.automaton.make_automaton()
        self.empty = not at

    def scan(self, text: str) -> list[tuple[int, int, int, int, bool]]:
        """(item_id, words that agree in the best window, start, end, whether the answer stands in the text): offsets in the text as given."""
        if self.empty or not text:
            return []
        spans = [m.span() for m in WORD.finditer(text)]
        if not spans:
            return []
        doc = [text[a:b].casefold() for a, b in spans]
        starts, n = [], 0
        for w in doc:
            starts.append(n)
            n += len(w) + 1
        lines = " " + " ".join(doc) + " "
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        answered: set[int] = set()
        for end, (length, places) in self.automaton.iter(lines):
            first = bisect_right(starts, end - 1) - length
            for k, i in places:
                if i < 0:
                    answered.add(k)
                else:
                    hits[k, first - i].append(i)
        best: dict[int, tuple[int, int, int]] = {}
        for (k, d), found in hits.items():
            passage = self.passages[k][1]
            need, seed = min(WINDOW, len(passage)), min(self.seed, len(passage))
            allowed = EXCHANGED if need == WINDOW else need // 8
            # need - allowed words in allowed + 1 stretches hold at least so many seeds, wherever the exchanged ones are
            if len(found) < max(1, need - allowed - (allowed + 1) * (seed - 1)):
                continue
            lo, hi = max(0, -d), min(len(passage), len(doc) - d)
            same = [passage[j] == doc[j + d] for j in range(lo, hi)]
            score = self._best(same, self.rare[k][lo:hi], need)
            if score >= need - allowed and score > best.get(k, (0, 0, 0))[0]:
                held = [j for j in range(lo, hi) if same[j - lo]]
                best[k] = (score, spans[held[0] + d][0], spans[held[-1] + d][1])
        return [(self.passages[k][0], *b, k in answered) for k, b in best.items()]

    @staticmethod
    def _best(same: list[bool], rare: list[bool], need: int) -> int:
        """Most words that agree in any ``need`` in a row of which at least half the rare ones agree; -1 if there are none."""
        best = -1
        agree = held = all_rare = 0
        for i, (s, r) in enumerate(zip(same, rare)):
            agree, held, all_rare = agree + s, held + (s and r), all_rare + r
            if i >= need:
                s, r = same[i - need], rare[i - need]
                agree, held, all_rare = agree - s, held - (s and r), all_rare - r
            if i >= need - 1 and agree > best and (2 * held >= all_rare and held > 0 or agree == need):
                best = agree
        return best


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str = "answer", block: int = BLOCK
) -> DataFrame:
    """(doc_id, item_id, words, begins, ends, answered): every text that holds an item's own passage.

    At least WINDOW passage words in a row (or the whole passage, if shorter)
    with at most EXCHANGED of them different, and at least half of the rare
    words among them the same. ``answered``: the item's answer stands in the
    text too. Null and empty texts and items give no rows; copies of a text
    are separate rows, a repeated item counts once per item_id, a missing
    column of answers is one of nulls. Items are a held-out set and are read on
    the driver; automata of ``block`` of them each are built there once and
    scanned one after another.
    """
    spark = docs.sparkSession
    answers = F.col(answer) if answer in items.columns else F.lit(None).cast("string")
    got = items.select(item_id, item_text, answers).where(f"{item_id} is not null and {item_text} is not null").distinct().collect()
    said = {r[0]: words(r[2] or "") for r in got}
    passages = [(i, w, said[i]) for i, w in own_passages([(r[0], r[1]) for r in got])]
    holders = Counter(w for _, p, _ in passages for w in set(p))
    slim = spread(docs.selectExpr(f"cast({doc_id} as bigint) d", f"{text} t").where("d is not null and t is not null"))
    schema = "doc_id bigint, item_id bigint, words int, begins int, ends int, answered boolean"
    out = None
    for k in range(0, max(1, len(passages)), block):
        given = spark.sparkContext.broadcast(Scanner(passages[k : k + block], holders))

        def run(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            scanner = given.value
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b["d"], b["t"]) for hit in scanner.scan(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "begins", "ends", "answered"])

        found = slim.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["doc_id", "item_id"])
