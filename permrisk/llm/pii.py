"""Personal data by bootstrapped contextual extraction.

Four exact forms (email, ip, card, phone) are the seeds. They and all values
that could be one of the four kinds in another form are instances; each
occurrence of an instance bears the lexical patterns around it, case and digits
folded: one token and two tokens to its left, the second to the left with any
token between, one token to its right, and those on both sides. Spark scores the
graph of patterns and instances in rounds: a pattern is worth the mean worth of
what stands in its place anywhere in the corpus, where words that are no
instance are worth nothing; a seed is worth 1, another instance as much as the
best pattern around it in the round before. So a pattern may be learnt from
instances that other patterns discovered, and instances without a seed's form
count for a pattern only as fast as its seeds and discoveries vouch for them.
Instances of a kind with a pattern of high confidence are added to the spans
found by form.

A pattern needs at least ``min_support`` distinct values worth ``confidence``;
other patterns are worth nothing, and so are those that would not reach it were
all their instances seeds. Patterns are broadcast in blocks of about ``BLOCK``;
if there are more, the texts are passed over once for each block, which is exact
because patterns do not meet.

Null and empty texts return zero counts and empty span lists; rows are judged
one by one, so repeated rows repeat their result; null ids are kept. Tokens and
values of any length are taken whole; long ones are known by a digest.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permrisk.llm.common import materialize, unused

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
BLOCK = 200_000
ADDED = "__added"
CONFIDENCE = 0.8
ROUNDS = 12
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s:=]+[:=]?|[:=]")
#: runs of numbers between blanks, and of what may be an address
_NUMBERS = re.compile(r"""(?<![^\s:=(<\["'])[+(]{0,2}[0-9][0-9().+-]*+(?:\x20[+(]{0,2}[0-9][0-9().+-]*+)*+(?![^\s.,;:!?)\]}'">])""")
_NUMBER = re.compile(r"[^\x20]+")
_MARKED = re.compile(r"(?<![^\s:=])[^\s:=@]*+@[^\s:=]*+")
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:.]++(?![0-9A-Za-z])")
_ODD = ".,;!?)\"'>]}"
_OPEN = "<([{\"'"
LONG = 64


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of KINDS, then of start; leftmost, not overlapping within a kind."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def compatible(kind: str, value: str) -> bool:
    """Could ``value`` be a ``kind`` that the exact form misses?"""
    n = len(_digits(value))
    if kind == "phone":
        return 7 <= n <= 15 and not value.strip("+0123456789 ().-")
    if kind == "card":
        return 12 <= n <= 19 and not value.strip("0123456789 -")
    if kind == "ip":
        return value.count(":") >= 3 and not value.lower().strip("0123456789abcdef:.")
    return "@" in value.strip("@")


def _plain(text: str) -> bool:
    """No form and no instance can be in such a text."""
    return "@" not in text and text.count(":") < 3 and not _DIGIT.search(text)


def _values(text: str) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """(kinds, start, end) of every value that could be of a kind."""
    found: list[tuple[int, int]] = []
    for run in _NUMBERS.finditer(text):
        numbers = [(run.start() + m.start(), run.start() + m.end()) for m in _NUMBER.finditer(run.group())]
        found += numbers
        digits, end = 0, numbers[-1][1]
        for a, b in reversed(numbers[:-1]):  # a value may be several numbers, up to the end of the run
            digits += len(_digits(text[a:b]))
            if digits > 19:
                break
            found.append((a, end))
    found += [m.span() for m in _MARKED.finditer(text)] if "@" in text else []
    found += [m.span() for m in _COLONS.finditer(text) if m.group().count(":") >= 3] if text.count(":") >= 3 else []
    for a, b in found:
        while b > a and text[b - 1] in _ODD:
            b -= 1
        while a < b and text[a] in _OPEN and not (text[a] == "(" and ")" in text[a:b]):
            a += 1
        value = text[a:b]
        kinds = tuple(k for k in KINDS if compatible(k, value))
        if kinds:
            yield kinds, a, b


def _merged(spans: list) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _occurrences(text: str, base: list) -> Iterator[tuple[tuple[str, ...], int, int, bool]]:
    """(kinds, start, end, whether a seed) of the instances: the base spans, and the values beside them."""
    for kind, a, b in base:
        yield (kind,), a, b, True
    starts, ends = _merged(base)
    for kinds, a, b in _values(text):
        at = bisect_right(starts, b - 1)
        if not at or ends[at - 1] <= a:
            yield kinds, a, b, False


def _named(value: str) -> str:
    return value if len(value) <= LONG else hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()


def _key(token: str) -> str:
    return _named(_DIGIT.sub("0", token.lower()))


class _Around:
    """The patterns around places of a text."""

    def __init__(self, text: str):
        self.text = text
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [a for a, _ in self.spans]

    def of(self, a: int, b: int) -> list[str]:
        text, spans = self.text, self.spans
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        if any(map(str.isalnum, text[spans[i][0] : a])):
            return []  # glued to a word
        key = lambda k: _key(text[slice(*spans[k])])
        right = key(j + 1) if j + 1 < len(spans) and not any(map(str.isalnum, text[b : spans[j][1]])) else None
        out = [] if right is None else [f"r {right}"]
        if i:
            left = key(i - 1)
            out.append(f"l {left}")
            if right is not None:
                out.append(f"b {left} {right}")
            if i > 1:
                second = key(i - 2)
                out += [f"m {second} {left}", f"g {second}"]
        return out


def _instances(batches):
    """(kind, pattern, value, seed, n) of the occurrences of instances."""
    for batch in batches:
        rows: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if _plain(text):
                continue
            around = None
            for kinds, a, b, seed in _occurrences(text, base_spans(text)):
                around = around or _Around(text)
                for pattern in around.of(a, b):
                    for kind in kinds:
                        rows[kind, pattern, _named(text[a:b]), seed] += 1
        columns = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(columns, types, strict=True)), pa.array(list(rows.values()), pa.int64())], names=["kind", "pattern", "value", "seed", "n"])


def _counted(batches, patterns: list[str]):
    """How often each pattern occurs with any token in its place."""
    anchors: dict[str, list] = {}
    for pattern in patterns:
        sort, *keys = pattern.split(" ")
        known = anchors.setdefault(keys[-1], [None, None, None, {}, {}])
        if sort in "lgr":
            known["lgr".index(sort)] = pattern
        else:
            known[3 if sort == "m" else 4][keys[0]] = pattern
    for batch in batches:
        rows: Counter = Counter()
        for text in batch.column(0).to_pylist():
            low = text.lower()
            words = [w if len(w) <= LONG else _named(w) for w in _TOKEN.findall(_DIGIT.sub("0", low) if _DIGIT.search(low) else low)]
            last = len(words) - 1
            for p in [p for p, w in enumerate(words) if w in anchors]:
                left, gap, right, pairs, both = anchors[words[p]]
                if p < last:
                    if left is not None:
                        rows[left] += 1
                    if gap is not None and p + 1 < last:
                        rows[gap] += 1
                    if pairs and p and (found := pairs.get(words[p - 1])) is not None:
                        rows[found] += 1
                if p:
                    if right is not None:
                        rows[right] += 1
                    if both and p > 1 and (found := both.get(words[p - 2])) is not None:
                        rows[found] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.int64())], names=["pattern", "n"])


def _scores(edges: DataFrame, min_support: int, confidence: float, rounds: int) -> DataFrame:
    """(kind, pattern) of high confidence after so many rounds, or as soon as no score moves. Edges: kind, pattern, value, seed, rest."""
    seed = F.when(F.col("seed"), 1.0).otherwise(0.0)
    now, before = edges.withColumn("worth", seed), None
    for _ in range(rounds):
        enough = F.sum(F.when(F.col("worth") >= confidence, 1).otherwise(0)) >= min_support
        scores = now.groupBy("kind", "pattern").agg((F.sum("worth") / (F.count(F.lit(1)) + F.max("rest"))).alias("score"), enough.alias("enough"))
        scores = materialize(scores.where("enough").drop("enough"), "scores")
        mark = scores.agg(F.count(F.lit(1)), F.round(F.sum("score"), 2)).first()
        if mark == before:
            break
        before = mark
        best = edges.join(scores, ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("score").alias("best"))
        now = edges.join(best, ["kind", "value"], "left").withColumn("worth", F.greatest(seed, F.coalesce("best", F.lit(0.0))))
    return scores.where(F.col("score") >= confidence).select("kind", "pattern")


def patterns(docs: DataFrame, text_col: str = "text", *, min_support: int = MIN_SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> Iterator[dict[str, tuple[str, ...]]]:
    """The patterns of high confidence in blocks, each with the kinds it stands for; one empty block if there are none."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    found = texts.mapInArrow(_instances, "kind string, pattern string, value string, seed boolean, n bigint")
    edges = found.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))
    edges = materialize(edges, "instances")
    hopeful = materialize(edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("inside")).where(F.col("values") >= min_support), "hopeful")
    parts = []
    for cues in _blocks(hopeful.select("kind", "pattern")):
        shared = docs.sparkSession.sparkContext.broadcast(sorted(cues))
        seen = texts.mapInArrow(lambda b, shared=shared: _counted(b, shared.value), "pattern string, n bigint")
        parts.append(seen.groupBy("pattern").agg(F.sum("n").alias("times")))
    none = True
    if parts:
        times = materialize(reduce(DataFrame.unionByName, parts), "times")
        rest = hopeful.join(times, "pattern").withColumn("rest", F.greatest(F.col("times") - F.col("inside"), F.lit(0)))
        # a pattern with too many other words in its place is worth nothing whatever its instances are worth
        rest = rest.where(F.col("values") >= confidence * (F.col("values") + F.col("rest"))).select("kind", "pattern", "rest")
        counted = materialize(edges.join(rest, ["kind", "pattern"]), "edges")
        for block in _blocks(_scores(counted, min_support, confidence, rounds)):
            none = False
            yield block
    if none:
        yield {}


def _blocks(rows: DataFrame) -> Iterator[dict[str, tuple[str, ...]]]:
    """The rows as dictionaries of about ``BLOCK`` each; a pattern is in one of them with all its kinds."""
    n = -(-rows.count() // BLOCK)
    for k in range(n):
        found = _as_dict(rows if n == 1 else rows.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k))
        if found:
            yield found


def _as_dict(rows: DataFrame) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for r in sorted(rows.collect()):
        out[r.pattern] = (*out.get(r.pattern, ()), r.kind)
    return out


def all_spans(text: str, found: dict[str, tuple[str, ...]], more: str = "") -> tuple[list, list]:
    """Base spans, and all spans: those and what patterns of high confidence add beside them, or have added (``more``)."""
    base = base_spans(text)
    added = {(k, int(a), int(b)) for k, a, b in (s.split(":") for s in more.split(",") if s)}
    if found and not _plain(text):
        around = None
        for kinds, a, b, seed in _occurrences(text, base):
            if not seed:
                around = around or _Around(text)
                told = {kind for pattern in around.of(a, b) for kind in found.get(pattern, ())}
                added |= {(kind, a, b) for kind in kinds if kind in told}
    if not added:
        return base, base
    order = {k: i for i, k in enumerate(KINDS)}
    kept: list = []
    for kind, a, b in sorted(added, key=lambda s: (order[s[0]], s[1], -s[2])):
        if not kept or kept[-1][0] != kind or kept[-1][2] <= a:
            kept.append((kind, a, b))
    return base, sorted({*base, *kept}, key=lambda s: (order[s[0]], s[1], s[2]))


def _text(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _searched(docs: DataFrame, text_col: str, options: dict):
    """The documents and the last block of patterns; if there were others before it, what they add is noted in a last column."""
    blocks = patterns(docs, text_col, **options)
    found, noted = next(blocks), False
    for block in blocks:
        docs = docs if noted else docs.withColumn(unused(ADDED, docs.columns), F.lit(""))
        noted = True
        docs = materialize(_noted(docs, text_col, found), "added")
        found = block
    return docs, noted, docs.sparkSession.sparkContext.broadcast(found)


def _noted(docs: DataFrame, text_col: str, found: dict[str, tuple[str, ...]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(found)
    at, to = docs.columns.index(text_col), len(docs.columns) - 1

    def run(batches):
        for batch in batches:
            more = []
            for text, before in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist(), strict=True):
                base, every = all_spans(text or "", shared.value, before)
                more.append(_text(sorted({*every} - {*base})))
            yield pa.RecordBatch.from_arrays([pa.array(more, pa.string()) if i == to else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _before(batch, noted: bool) -> list[str]:
    return batch.columns[-1].to_pylist() if noted else [""] * batch.num_rows


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: counts and digest of the base spans, all spans, and how many the patterns added."""
    docs, noted, shared = _searched(docs.select(id_col, text_col), text_col, options)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts, sha, spans, added = [[] for _ in KINDS], [], [], []
            for text, more in zip(batch.column(1).to_pylist(), _before(batch, noted), strict=True):
                base, every = all_spans(text or "", shared.value, more)
                per = Counter(k for k, _, _ in base)
                for column, name in zip(counts, KINDS, strict=True):
                    column.append(per[name])
                sha.append(hashlib.sha256(_text(base).encode()).hexdigest())
                spans.append(_text(every))
                added.append(len(every) - len(base))
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, n_added bigint"
    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all other columns as they were."""
    schema = docs.schema
    docs, noted, shared = _searched(docs, text_col, options)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else masked(t, all_spans(t, shared.value, more)[1]) for t, more in zip(batch.column(at).to_pylist(), _before(batch, noted), strict=True)]
            kept = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(schema)])]
            yield pa.RecordBatch.from_arrays(kept, names=schema.names)

    return docs.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans are joined and named after the one that starts first."""
    out, upto = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= upto:
            out += [text[upto:a], f"[{kind.upper()}]"]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])
