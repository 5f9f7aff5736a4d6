"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and of full width
to Latin ones and digits and signs that stand for letters to these letters; l
and i become one letter, since 1, | and ! stand for both. What is neither
letter nor digit separates words.

The lexicon is learned: its entries are beginnings of words, whole words among
them. From a bounded sample of labelled rows (about ``MAX_ROWS``, picked by a
hash of the id) the beginnings frequent in toxic documents are counted in both
classes, and a greedy cover keeps the few that explain the toxic documents and
are precise; a document has a beginning if it is as frequent in it as once in
``DENSE`` words, so chance hits in long texts do not count. An entry weighs its
log odds. Phrases of an entry and the word beside it that are seen in clean documents only are exceptions and count
nothing. The sum of weights is divided by the number of stretches of
``STRETCH`` words begun and turned into a probability by a logistic fit.

Null and empty texts have no hit and the score of a text without hits. Without
toxic or without clean training rows no lexicon is learned and every score is
the smoothed share of toxic rows. A document with several labels counts as
toxic if one of them says so; null labels are not used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permrisk.llm.common import fold

MAX_ROWS = 50_000
MAX_LENGTH, MIN_LENGTH = 14, 3
MIN_SHARE = 0.005
MIN_PRECISION = 0.9
MAX_ENTRIES = 2_000
STRETCH = 50
DENSE = 150
THRESHOLD = 0.7
# fixed values: look-alike letters and the Latin letters they stand for
_LOOKALIKES = {
    "абвгдезиікмнопрстухѕјһԁԛԝьѵ": "a6brde3uikmhonpctyxsjhdqwbv",
    "αβεηικνορτυχγω": "abeniknoptuxyw",
}
_SIGNS = "013457@$!|l"
_LETTERS = "oieastasiii"


def _table() -> dict[int, str]:
    table = {c: " " for c in range(128) if not chr(c).isalnum()}
    for found, stands in _LOOKALIKES.items():
        table |= {ord(a): b for a, b in zip(found, stands, strict=True)}
    table |= {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
    table = {c: s if s.isalnum() else " " for c, s in table.items()}
    digits = dict(zip(_SIGNS, _LETTERS, strict=True))
    table |= {ord(c): s for c, s in digits.items() if c.isalnum()}
    return {c: digits.get(s, s) if s.isalnum() else " " for c, s in table.items()} | {0x200B: "", 0x200C: "", 0x200D: "", 0xAD: "", 0xA0: " ", 0x3000: " "}


_FOLDED = _table()
_INNER = str.maketrans("@$!|", "asii")
#: signs between letters, and @ or $ in front of a word
_AMONG = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])|(?<!\S)[@$](?=[^\W_])")


def folded(text: str | None) -> list[str]:
    """The words of a text after folding."""
    text = (text or "").lower()
    if any(c in text for c in "@$!|"):
        text = _AMONG.sub(lambda m: m.group().translate(_INNER), text)
    return text.translate(_FOLDED).split()


def beginnings(words: list[str]) -> set[str]:
    """Beginnings of the words, as often as once in ``DENSE`` words; a blank at the end of one says that the word ends there."""
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        w += " "
        for k in range(MIN_LENGTH, min(len(w), MAX_LENGTH) + 1):
            counts[w[:k]] += n
    return {b for b, n in counts.items() if n * DENSE >= len(words)}


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str]
    slope: float
    offset: float

    def compiled(self):
        automaton = ahocorasick.Automaton()
        for entry in self.weights:
            automaton.add_word(" " + entry, entry)
        if self.weights:
            automaton.make_automaton()
        return automaton

    def hits(self, words: list[str], automaton) -> list[tuple[str, str, str]]:
        """(entry, phrase with the word before, phrase with the word behind) for each word with an entry, its longest one."""
        if not self.weights or not words:
            return []
        line, best = f" {' '.join(words)} ", {}
        for end, entry in automaton.iter(line):
            best[end - len(entry)] = entry  # longer entries of one word end later
        found = []
        for at, entry in best.items():
            stop = line.index(" ", at + 1)
            word = line[at + 1 : stop]
            after = line.find(" ", stop + 1)
            before, behind = line[line.rfind(" ", 0, at) + 1 : at], line[stop + 1 : after] if after > 0 else ""
            found.append((entry, f"{before} {word}", f"{word} {behind}"))
        return found

    def density(self, words: list[str], automaton) -> float:
        total = sum(self.weights[e] for e, a, b in self.hits(words, automaton) if a not in self.exceptions and b not in self.exceptions)
        return total / (1 + len(words) // STRETCH)

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * density + self.offset))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, modulus: int, held: int, max_rows: int) -> DataFrame:
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, modulus) != held)).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    total = rows.count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    # at most about max_rows rows of two numbers
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), F.col("id") == F.col("__id")).select("text", F.col("__toxic").alias("toxic"))


def _counted(rows: DataFrame, of, keys: str) -> DataFrame:
    """Sum of what ``of`` counts in each (text, toxic), by key and class."""

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key in of(text):
                    counts[key, toxic] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=[keys, "toxic", "n"])

    return rows.mapInArrow(run, f"{keys} string, toxic int, n bigint").groupBy(keys).agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") != 1, F.col("n")).otherwise(0)).alias("good"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, modulus: int = 3, held: int = 1, max_rows: int = MAX_ROWS) -> Lexicon:
    spark = docs.sparkSession
    sample = _sample(docs, labels, id_col, text_col, label_col, modulus, held, max_rows)
    n = {r.toxic: r["count"] for r in sample.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    blank = Lexicon({}, frozenset(), 0.0, math.log((bad + 1) / (good + 1)))
    if not bad or not good:
        return blank
    least = max(2, math.ceil(MIN_SHARE * bad))
    frequent = _counted(sample.where("toxic = 1"), lambda t: beginnings(folded(t)), "entry").where(F.col("bad") >= least)
    # least is a share of the sample, so this is bounded by words a document / MIN_SHARE
    names = frozenset(r.entry for r in frequent.select("entry").collect())
    shared = spark.sparkContext.broadcast(names)
    both = _counted(sample, lambda t: beginnings(folded(t)) & shared.value, "entry").where((F.col("bad") / bad) >= 9 * (F.col("good") / good))
    odds = {r.entry: (r.bad, r.good) for r in both.orderBy(F.desc("bad"), F.length("entry").desc(), "entry").limit(MAX_ENTRIES).collect()}
    if not odds:
        return blank
    shared_odds = spark.sparkContext.broadcast(frozenset(odds))
    # one row a document of the bounded sample: which candidates it has
    seen = _counted(sample, lambda t: ["\x1f".join(sorted(beginnings(folded(t)) & shared_odds.value))], "entries").where("entries <> ''").collect()
    entries = _beside(_cover([(frozenset(r.entries.split("\x1f")), r.bad, r.good) for r in seen], bad, good), odds, bad, good)
    weights = {e: math.log((odds[e][0] + 0.5) / (bad + 1)) - math.log((odds[e][1] + 0.5) / (good + 1)) for e in entries}
    draft = Lexicon(weights, frozenset(), 0.0, 0.0)

    def phrases(text):
        automaton = draft.__dict__.get("automaton") or draft.__dict__.setdefault("automaton", draft.compiled())
        return {p for _, a, b in draft.hits(folded(text), automaton) for p in (a, b) if " " in p.strip()}

    harmless = _counted(sample, phrases, "phrase").where((F.col("bad") == 0) & (F.col("good") >= 3)).collect()
    lexicon = Lexicon(weights, frozenset(r.phrase for r in harmless), 0.0, 0.0)

    def bins(text):
        automaton = lexicon.__dict__.get("automaton") or lexicon.__dict__.setdefault("automaton", lexicon.compiled())
        return [str(min(4000, round(lexicon.density(folded(text), automaton) * 50)))]

    cells = _counted(sample, bins, "bin").collect()
    x = np.array([int(r.bin) / 50 for r in cells])
    slope, offset = _logistic(x, np.array([r.bad for r in cells], float), np.array([r.good for r in cells], float))
    return Lexicon(weights, lexicon.exceptions, slope, offset)


def _cover(rows: list[tuple[frozenset, int, int]], bad: int, good: int) -> list[str]:
    """Greedy cover of the toxic documents by precise entries; of equal ones the longest."""
    left, chosen = rows, []
    while left:
        gain: Counter = Counter()
        cost: Counter = Counter()
        for entries, b, g in left:
            for e in entries:
                gain[e] += b
                cost[e] += g
        best = max(gain, key=lambda e: (gain[e] - cost[e] * bad / good * 9, len(e), e))
        worth = gain[best] / bad
        if worth < MIN_SHARE or gain[best] < 2 or worth < MIN_PRECISION * (worth + cost[best] / good):
            break
        chosen.append(best)
        left = [r for r in left if best not in r[0]]
    return chosen


def _beside(chosen: list[str], odds: dict[str, tuple[int, int]], bad: int, good: int) -> list[str]:
    """The cover, and what it left out because the same documents hold other entries: as precise, and half as frequent as its median."""
    if not chosen:
        return chosen
    usual = sorted(odds[e][0] for e in chosen)[len(chosen) // 2]
    for e in sorted(odds, key=lambda e: (-odds[e][0], -len(e), e)):
        b, g = odds[e][0] / bad, odds[e][1] / good
        if 2 * odds[e][0] >= usual and b >= 0.99 * (b + g) and not any(e.startswith(c.strip()) or c.startswith(e.strip()) for c in chosen):
            chosen = [*chosen, e]
    return chosen


def _logistic(x: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps with a small ridge, half a row of either class added at both ends."""
    x = np.concatenate([x, [0.0, x.max() or 1.0]])
    bad, good = np.concatenate([bad, [0.5, 0.5]]), np.concatenate([good, [0.5, 0.5]])
    w, n = np.zeros(2), bad + good
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (bad - n * p) - 1e-3 * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def predict(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", *, modulus: int = 3, held: int = 1) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        automaton = shared.value.compiled()
        for batch in batches:
            scores = [shared.value.score(shared.value.density(folded(t), automaton)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    rows = docs.select(id_col, F.coalesce(fold(id_col, modulus) == held, F.lit(False)).alias("held_out"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    return predict(docs, learn(docs, labels, id_col, text_col, label_col, **options), id_col, text_col)
