"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as lower-cased UTF-8 without ASCII blanks, punctuation and
control characters. An item of n bytes may differ in k = floor(rate x n)
single-byte edits; cut into k + 1 pieces, one of them must occur unchanged in
any text within k edits. An Aho-Corasick automaton finds the pieces, and each
place they point to is verified with Myers' bit-parallel distance over a window
of k bytes on either side. No hit within the budget is lost.

Items are the query set: they reach the tasks in blocks of at most
``BLOCK_BYTES``, however many there are, and each block passes over all texts.
Items that normalise to nothing match nothing; a null or empty document has no
hit; repeated items and repeated documents each report their own hits.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.06
BLOCK_BYTES = 8 << 20
_DROPPED = bytes(b for b in range(128) if not chr(b).isalnum())


def normalise(text: str | None) -> str:
    """One character for each byte that counts."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _DROPPED).decode("latin-1")


def myers(item: str, window: str, masks: dict[str, int] | None = None) -> int:
    """Least edit distance of ``item`` to any substring of ``window``."""
    m = len(item)
    masks = letter_masks(item) if masks is None else masks
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now = full, 0, m
    best = m
    for c in window:
        eq = masks.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            now += 1
        elif down & top:
            now -= 1
            if now < best:
                best = now
        up, down = up << 1 & full, down << 1 & full
        eq |= minus
        plus = down | (full & ~(eq | up))
        minus = up & eq
    return best


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


class Matcher:
    """The pieces of a block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(key, text) for key, raw in items if (text := normalise(raw))]
        self.budget = [int(rate * len(text)) for _, text in self.items]
        self.masks: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, ((_, text), k) in enumerate(zip(self.items, self.budget, strict=True)):
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places[text[a:b]].append((n, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, where)
        if places:
            self.automaton.make_automaton()

    def hits(self, raw: str | None) -> list[tuple[int, int]]:
        """(place of the item in ``items``, distance) of every item within its budget."""
        text = normalise(raw)
        if not self.items or not text:
            return []
        spans: dict[int, list[list[int]]] = defaultdict(list)
        for end, where in self.automaton.iter(text):
            for n, b in where:
                k, size = self.budget[n], len(self.items[n][1])
                lo, hi = max(0, end + 1 - b - k), end + 1 - b + size + k
                if spans[n] and lo <= spans[n][-1][1] and lo >= spans[n][-1][0]:
                    spans[n][-1][1] = max(hi, spans[n][-1][1])
                elif not spans[n] or [lo, hi] != spans[n][-1]:
                    spans[n].append([lo, hi])
        found = []
        for n, windows in spans.items():
            item = self.items[n][1]
            masks = self.masks.get(n) or self.masks.setdefault(n, letter_masks(item))
            best = min(0 if item in text[lo:hi] else myers(item, text[lo:hi], masks) for lo, hi in windows)
            if best <= self.budget[n]:
                found.append((n, best))
        return sorted(found)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *,
    rate: float = ERROR_RATE, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each (document, item) within the item's budget: the id, ``carry``, the item and the distance."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    out = None
    for block in range(max(1, blocks)):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(max(1, blocks))) == block)
        found = _scan(docs, [tuple(r) for r in part.collect()], id_col, text_col, item_col, rate, carry)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(docs, items, id_col, text_col, item_col, rate, carry) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kept = docs.select(id_col, *carry).schema

    def run(batches):
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            row, item, distance = [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for n, d in matcher.hits(text):
                    row.append(i)
                    item.append(matcher.items[n][0])
                    distance.append(d)
            at = pa.array(row, pa.int64())
            arrays = [c.take(at) for c in batch.columns[:-1]] + [pa.array(item, pa.int64()), pa.array(distance, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept.names, item_col, "distance"])

    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.fields)
    return docs.select(id_col, *carry, F.col(text_col).alias("__text")).mapInArrow(run, f"{out}`{item_col}` bigint, distance int")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit, all their columns as they were. Filters block by block, without a shuffle."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    at = docs.columns.index(text_col)
    for block in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()])

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.hits(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
