"""Text decoded with the wrong character encoding (problem 7).

A multinomial classifier on hashed byte bigrams is fitted to clean words of
the corpus and to the same words garbled by each known chain of encodings. A
word is taken for garbled by the chain that it predicts if inverting that
chain decodes strictly and the result is far likelier as clean text than the
word as it stands.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomaudit.operators.sampling import distinct_sample
from loomaudit.operators.skew import join_hot
from loomaudit.session import cut, spread

#: fixed list of chains: each step is (written in, read as); the steps were done in this order
CHAINS: dict[str, list[tuple[str, str]]] = {
    "utf-8 as cp1252": [("utf-8", "cp1252")],
    "utf-8 as latin-1": [("utf-8", "latin-1")],
    "utf-8 as cp1252, twice": [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "utf-8 as latin-1, twice": [("utf-8", "latin-1"), ("utf-8", "latin-1")],
    "utf-8 as cp1250": [("utf-8", "cp1250")],
    "utf-8 as cp1251": [("utf-8", "cp1251")],
    "utf-8 as koi8-r": [("utf-8", "koi8-r")],
    "utf-8 as cp437": [("utf-8", "cp437")],
    "utf-8 as cp850": [("utf-8", "cp850")],
    "utf-8 as cp866": [("utf-8", "cp866")],
    "utf-8 as mac-roman": [("utf-8", "mac_roman")],
    "utf-8 as iso-8859-2": [("utf-8", "iso8859_2")],
    "cp1251 as cp1252": [("cp1251", "cp1252")],
    "cp1251 as koi8-r": [("cp1251", "koi8-r")],
    "koi8-r as cp1251": [("koi8-r", "cp1251")],
    "koi8-r as cp1252": [("koi8-r", "cp1252")],
    "cp866 as cp1251": [("cp866", "cp1251")],
    "cp1252 as cp1251": [("cp1252", "cp1251")],
    "cp1252 as latin-1": [("cp1252", "latin-1")],
    "cp1252 as cp437": [("cp1252", "cp437")],
    "cp1252 as mac-roman": [("cp1252", "mac_roman")],
    "mac-roman as cp1252": [("mac_roman", "cp1252")],
    "cp1250 as cp1252": [("cp1250", "cp1252")],
    "iso-8859-2 as cp1252": [("iso8859_2", "cp1252")],
}
NAMES = list(CHAINS)
#: chains whose inverse fails on nearly all other text
PROVABLE = {k for k, n in enumerate(NAMES) if CHAINS[n][0][0] == "utf-8" or n == "cp1252 as latin-1"}
#: fixed letters of the languages of the corpus beyond a-z, by which clean training words are known
LETTERS = "äöüßéèêëàâîïôûùçœæáíóúñãõêąćęłńóśźżÿ" + "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
SIGNS = "–—’‘“”„«»…·€½¼¡¿°©»№×•§ "
#: rows of each column that the classifier learns from, at most
SAMPLE_ROWS = 2_000
SIZE = 1 << 16
#: nats by which a chain must be likelier than clean text; for chains between single-byte tables, all such words of a line together
MARGIN, LINE_MARGIN = 0.5, 9.0
#: what each bigram counts before any is seen
ADD = 0.02
#: copies of a training word that count, at most
HEAVIEST = 100
WORD = re.compile(r"\S*[^\x00-\x7f]\S*")
QUOTES = {"“": "”", '"': '"', "«": "»", "„": "“", "‘": "’", "'": "'", "`": "`"}


def _tables() -> dict[str, tuple[dict[str, int], list[str]]]:
    """Per single-byte encoding, bytes and characters; bytes that it leaves open stand for the control of that number, as decoders in use do."""
    out = {}
    for name in {n for chain in CHAINS.values() for step in chain for n in step} - {"utf-8"}:
        chars = [bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)]
        back: dict[str, int] = {}
        for b, c in enumerate(chars):
            back.setdefault(c, b)
        out[name] = (back, chars)
    return out


TABLES = _tables()


def _write(text: str, encoding: str) -> bytes | None:
    if encoding == "utf-8":
        return text.encode("utf-8", "strict") if not any(0xD800 <= ord(c) < 0xE000 for c in text) else None
    back = TABLES[encoding][0]
    try:
        return bytes([back[c] for c in text])
    except KeyError:
        return None


def _read(data: bytes, encoding: str) -> str | None:
    if encoding == "utf-8":
        try:
            return data.decode("utf-8", "strict")
        except UnicodeDecodeError:
            return None
    chars = TABLES[encoding][1]
    return "".join([chars[b] for b in data])


def garble(text: str, chain: str) -> str | None:
    for written, read in CHAINS[chain]:
        data = _write(text, written)
        if data is None:
            return None
        text = _read(data, read) or ""
    return text


def invert(text: str, chain: str) -> str | None:
    """The text before the chain, or null where some step can't have given it."""
    for written, read in reversed(CHAINS[chain]):
        data = _write(text, read)
        got = None if data is None else _read(data, written)
        if got is None:
            return None
        text = got
    return text


def bigrams(word: str) -> np.ndarray:
    data = np.frombuffer(b"\x20" + word.encode("utf-8", "replace") + b"\x20", dtype=np.uint8).astype(np.int32)
    return (data[:-1] * 256 + data[1:]) % SIZE


def is_clean(word: str) -> bool:
    """A word of one script whose letters are of the corpus languages and not mostly accented."""
    low = word.lower()
    odd = [c for c in low if ord(c) > 127]
    if any(c not in LETTERS and c not in SIGNS for c in odd):
        return False
    letters = [c for c in odd if c in LETTERS]
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in letters)
    if cyrillic:
        # a wrongly read Cyrillic word mixes cases within
        tail = [c for c in word[1:] if c.isalpha()]
        return cyrillic == len(letters) and (word.isupper() or not any(c.isupper() for c in tail))
    return len(letters) <= 1 + sum(c.isalpha() for c in word) // 2 and not re.search("[ãâ][" + SIGNS + "]", low)


def fit(words: list[tuple[str, int]]) -> np.ndarray:
    """SIZE x (clean, each chain): log likelihoods of hashed byte bigrams."""
    counts = np.full((SIZE, 1 + len(NAMES)), ADD)
    for w, n in words:
        weight = min(n, HEAVIEST) ** 0.5
        for form in {w, w.upper()}:
            np.add.at(counts[:, 0], bigrams(form), weight)
            for k, chain in enumerate(NAMES):
                g = garble(form, chain)
                if g is not None and g != form:
                    np.add.at(counts[:, k + 1], bigrams(g), weight)
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


class Restorer:
    def __init__(self, weights: np.ndarray, cache: int = 300_000):
        self.weights, self.cache, self.size = weights, {}, cache
        self.peaks: dict[str, float] = {}

    def word(self, w: str) -> tuple[tuple[int, float, str] | None, dict[int, tuple[float, str]]]:
        """The chain through UTF-8 that the classifier predicts, with its nats against clean text and the word restored; and nats and word for every chain of single bytes.

        Chains are tried in the order in which the classifier holds them
        likely, as far as it doesn't hold the word for clean; the first whose
        inverse decodes strictly is taken. Chains of single bytes undo nearly
        anything, so for them the classifier must also hold the result for
        clean, and its nats are summed over a line.
        """
        got = self.cache.get(w)
        if got is None:
            scores = self.weights[bigrams(w)].sum(axis=0)
            gains = scores[1:] - scores[0]
            proven, single = None, {}
            # signs and single letters tell nothing of chains that undo nearly anything
            letters = any(ord(c) > 127 and (c.isalpha() or c not in SIGNS and c not in "‹›") for c in w) and len(w.strip(SIGNS + ".,:;!?()[]")) > 1
            for k in np.argsort(-gains, kind="stable").tolist():
                if k in PROVABLE and (proven is not None or gains[k] < MARGIN):
                    continue
                if k not in PROVABLE and not letters:
                    continue
                plain = invert(w, NAMES[k])
                if plain is None or plain == w or any(0x80 <= ord(c) < 0xA0 for c in plain):
                    continue
                if k in PROVABLE:
                    proven = (k, float(gains[k]), plain)
                elif is_clean(plain):
                    # the restored word must also be likelier in the clean class than the word as it stands
                    clean = float(self.weights[bigrams(plain), 0].sum()) - float(scores[0])
                    single[k] = (min(float(gains[k]), clean), plain)
            got = (proven, single)
            if len(self.cache) < self.size:
                self.cache[w] = got
        return got

    def line(self, line: str) -> tuple[bool, str, set[str]]:
        """Whether the line holds a garbled passage that isn't a quotation, the line restored, and the chains."""
        lost, chains, found = False, set(), []
        words: dict[str, tuple] = {}
        for m in WORD.finditer(line):
            w = m.group()
            if "�" in w:
                lost |= not quoted(line, m.start(), m.end(), "�")
            elif not quoted(line, m.start(), m.end()):
                words[w] = self.word(w)
                found.append(m)
        plain = [single for proven, single in words.values() if proven is None]
        sums = {k: sum(s[k][0] if k in s else -LINE_MARGIN for s in plain) for k in {k for s in plain for k in s}}
        best = max(sums, key=sums.get, default=None)
        if best is not None and sums[best] < LINE_MARGIN:
            best = None
        parts, at = [], 0
        for m in found:
            proven, single = words[m.group()]
            if proven is None and (best is None or best not in single):
                continue
            parts += [line[at : m.start()], proven[2] if proven else single[best][1]]
            at = m.end()
            chains.add(NAMES[proven[0] if proven else best])
        return lost or bool(chains), "".join([*parts, line[at:]]), chains

    def peak(self, w: str) -> float:
        """The most that the word can add to a line's evidence."""
        got = self.peaks.get(w)
        if got is None:
            proven, single = self.word(w)
            got = LINE_MARGIN if "�" in w or proven else max([0.0, *(g for g, _ in single.values())])
            if len(self.peaks) < self.size:
                self.peaks[w] = got
        return got

    def text(self, text: str) -> tuple[bool, str, str, bool]:
        """(garbled, restored text, chains, wholly restored)."""
        if text.isascii():
            return False, text, "", True
        any_bad, lines, chains = False, [], set()
        peak = self.peak
        for line in text.split("\n"):
            if line.isascii() or sum(map(peak, set(WORD.findall(line)))) < LINE_MARGIN:
                lines.append(line)
                continue
            bad, fixed, used = self.line(line)
            any_bad |= bad
            chains |= used
            lines.append(fixed)
        fixed = "\n".join(lines)
        return any_bad, fixed, ", ".join(sorted(chains)), "�" not in fixed


def quoted(line: str, start: int, end: int, only: str | None = None) -> bool:
    """Whether the odd characters of the word are all set in quotation marks, as an example."""
    word = line[start:end]
    for left, right in QUOTES.items():
        a = word.find(left)
        b = word.rfind(right)
        if 0 <= a < b - 1:
            outside = word[:a] + word[b + 1 :]
            if outside.isascii() and len(word[a + 1 : b]) <= 12 and (only is None or only in word[a:b]):
                return True
    return False


def train(*columns: tuple[DataFrame, str], rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Fits the classifier to the clean non-ASCII words of the columns.

    It learns from at most ``rows`` distinct values of each column, those with the
    smallest hashes; all else covers all rows.
    """
    words: Counter[str] = Counter()
    for df, c in columns:
        for t in distinct_sample(df.filter(F.col(c).rlike(r"[^\x00-\x7F]")), c, rows):
            words.update(WORD.findall(t))
    return fit([(w, n) for w, n in words.items() if len(w) <= 40 and is_clean(w)])


def restored(df: DataFrame, key: str, text: str, weights: np.ndarray) -> DataFrame:
    """(record_key, chains, restored, whole) for each row with a garbled passage.

    ``whole``: nothing unrecoverable is left; ``chains`` is empty where only
    replacement characters tell. Null and pure ASCII texts give no rows, null
    keys are left out, copies are separate rows. A word set in quotation marks
    as an example of garbling is no case.
    """
    model = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(model.value)
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                bad, fixed, chains, whole = r.text(t)
                if bad:
                    rows.append((k, chains, fixed, whole))
            yield pd.DataFrame(rows, columns=["record_key", "chains", "restored", "whole"])

    odd = df.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull() & F.col("t").rlike(r"[^\x00-\x7F]"))
    return spread(odd).mapInPandas(run, "record_key string, chains string, restored string, whole boolean")


def restored_titles(df: DataFrame, key: str, text: str, weights: np.ndarray) -> DataFrame:
    """As ``restored``, for short texts with many copies: each distinct value is judged once."""
    odd = df.select(F.col(key).cast("string").alias("record_key"), F.col(text).alias("t")).filter(F.col("record_key").isNotNull() & F.col("t").rlike(r"[^\x00-\x7F]"))
    values = odd.groupBy("t").agg(F.count("*").alias("n"))
    bad = restored(values.select("t", F.col("t").alias("v")), "t", "v", weights)
    bad = cut(bad.withColumnRenamed("record_key", "t").join(values, "t"))
    return join_hot(odd, bad, ["t"], "n", "record_key").select("record_key", "chains", "restored", "whole")
