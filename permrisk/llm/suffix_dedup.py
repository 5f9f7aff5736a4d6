"""Removal of repeated byte strings by families of suffix arrays that merge geometrically.

A string of ``LENGTH`` bytes contains, at a place its content fixes, the anchor
with the least hash among its ``GRAM``-byte grams. Equal strings share the
anchor's content, so it is enough to index suffixes at anchors, about one byte
in 85, and to look at what surrounds them: a string of ``LENGTH`` bytes around
an anchor is its last L bytes in front, the gram, and the first SPAN - L behind.

1. Each text gives its anchors: hash of the gram, hash of all that surrounds
   it, place. They are dealt out by the gram. Anchors alone in theirs are
   dropped; those whose whole surroundings occur again are repeated as they
   are; the others, and one of each repeated surroundings, are compared.
2. Compared anchors fetch their surroundings and meet, by gram, in a
   :class:`Family`: batches get suffix arrays, a batch is merge-scanned with
   the level of its size, and the result goes up a level. Anchors of a gram with
   over ``SPLIT_AT`` different surroundings are dealt twice instead, by what is
   behind the gram and by what is in front of it, half a string's rest each: two
   equal strings agree on one of the halves at least.
3. The byte ranges found go back to the texts by content and are cut out.

:class:`SuffixIndex` keeps such an index between batches of documents, its
levels as tables.

Texts are keyed by a 64-bit hash and their length, surroundings by the 64-bit
hash of their bytes (XXH3) together with one of the gram; what is compared is
compared byte by byte. A null
text counts as empty; repeated rows are copies of each other; ids are only
passed on. A text shorter than ``LENGTH`` bytes loses nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permrisk.llm.common import materialize, slices

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM
#: grams in a string of LENGTH bytes
WINDOW = SPAN + 1
BATCH_BYTES = 1 << 20
FAMILY_BATCH = 4096
FAMILY_ROWS = 1 << 15
BASE = 0x9E3779B97F4A7C15
HALF = SPAN // 2
SPLIT_AT = 4096
#: repeated as it is; to compare; stands for several that are repeated; and, added to these, in a split gram
WHOLE, COMPARE, WITNESS, SPLIT = 0, 1, 2, 4


@cache
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x):
        out = np.full(size, x, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(pow(base, -1, 1 << 64))


class Rolling:
    """Hash of any range of a buffer in constant time, modulo 2^64."""

    def __init__(self, data: np.ndarray, base: int):
        self.up, down = _powers(1 << max(10, int(len(data)).bit_length()), base)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.up[start]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _slide(x: np.ndarray, pick) -> np.ndarray:
    """pick over each run of WINDOW items, by doubling."""
    size, now = 1, x
    while 2 * size <= WINDOW:
        now = pick(now[:-size], now[size:])
        size *= 2
    rest = WINDOW - size
    return pick(now[: len(now) - rest], now[rest:]) if rest else now


def anchors(texts: list[bytes]):
    """(text number, place, bytes in front up to SPAN, bytes behind up to SPAN, gram hash, surroundings hash)."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < LENGTH:
        return None
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    rolling = Rolling(data, BASE)
    at = np.arange(len(data) - GRAM + 1)
    gram = mix(rolling.of(at, at + GRAM))
    least = _slide(gram, np.minimum)
    # strings that reach into the next text do not count
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    least[owner[: len(least)] != owner[LENGTH - 1 : LENGTH - 1 + len(least)]] = 0
    padded = np.zeros(len(gram) + WINDOW - 1, dtype=np.uint64)
    padded[WINDOW - 1 : WINDOW - 1 + len(least)] = least
    place = np.flatnonzero((_slide(padded, np.maximum) == gram) & (gram > 0))
    who = owner[place]
    left = np.maximum(starts[who], place - SPAN)
    right = np.minimum(ends[who], place + GRAM + SPAN)
    front, behind = place - left, right - place - GRAM
    joined, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    around = np.fromiter((digest(joined[a:b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)), np.uint64, len(left))
    around = mix(around ^ (front << 8 | behind).astype(np.uint64) * np.uint64(BASE))
    return who, place - starts[who], front, behind, gram[place], around


def _anchored(batches):
    for batch in batches:
        key, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
        for lo, hi in slices([len(t) for t in texts], BATCH_BYTES):
            found = anchors(texts[lo:hi])
            if found is not None:
                who, place, front, behind, gram, around = found
                gram, around, times = _met_here(gram, around)
                columns = (gram.view(np.int64), around.view(np.int64), key[lo:hi][who], size[lo:hi][who], place << 16 | front << 8 | behind, times)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["gram", "around", "key", "size", "at", "times"])


def _met_here(gram: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Settle surroundings that occur several times in one batch before they are dealt out.

    One of them stands for all, with their number. The others are known to be
    repeated; they get a gram of their own, so that no frequent gram gathers them.
    """
    _, first, at, count = np.unique(mix(gram) + around, return_index=True, return_inverse=True, return_counts=True)
    stands = np.zeros(len(gram), dtype=bool)
    stands[first] = True
    lone = mix(gram + around + np.arange(len(gram), dtype=np.uint64) * np.uint64(BASE))
    return np.where(stands, gram, lone), np.where(stands, around, np.uint64(0)), np.where(stands, count[at], 2)


def _whole_groups(batches, column: str):
    """Tables that hold all rows of each value of a sorted column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        values = batch.column(column).to_numpy()
        if held[0].column(column)[0].as_py() == values[-1]:
            continue
        last = pa.Table.from_batches(held)
        values = last[column].to_numpy()
        cut = int(np.argmax(values == values[-1]))
        yield last.slice(0, cut)
        held = last.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _sort_out(batches):
    """Of anchors in order of gram and surroundings: those that are repeated as they are, and those to compare."""
    for table in _whole_groups(batches, "gram"):
        gram, around = table["gram"].to_numpy(), table["around"].to_numpy()
        new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
        new_run = new_gram | np.concatenate([[True], around[1:] != around[:-1]])
        run, group = np.cumsum(new_run) - 1, np.cumsum(new_gram) - 1
        times = np.bincount(run, weights=table["times"].to_numpy())[run]
        variants = np.bincount(group[new_run], minlength=group[-1] + 1)[group]
        sort = np.where(times > 1, np.where((variants > 1) & new_run, WITNESS, WHOLE), np.where(variants > 1, COMPARE, -1))
        keep = sort >= 0
        sort += np.where((sort > WHOLE) & (variants > SPLIT_AT), SPLIT, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(table[c].to_numpy()[keep], pa.int64()) for c in ("gram", "key", "size", "at")] + [pa.array(sort[keep], pa.int32())], names=["gram", "key", "size", "at", "sort"]
        )


def _surroundings(batches):
    """The bytes in front, reversed, and the gram with the bytes behind, of each listed anchor."""
    for batch in batches:
        rows: list[tuple] = []
        for key, size, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for p in places:
                at, front, behind = p["at"] >> 16, p["at"] >> 8 & 255, p["at"] & 255
                ahead, rest = data[at - front : at][::-1], data[at : at + GRAM + behind]
                if p["sort"] < SPLIT:
                    rows.append((p["gram"], key, size, p["at"], p["sort"], ahead, rest))
                    continue
                halves = [b"b" + rest[: GRAM + HALF]] * (behind >= HALF) + [b"f" + ahead[:HALF] + rest[:GRAM]] * (front >= HALF)
                rows += [(xxhash.xxh3_64_intdigest(h) - (1 << 63), key, size, p["at"], p["sort"] - SPLIT, ahead, rest) for h in halves]
            if len(rows) >= 8192:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)


_AROUND = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("at", pa.int64()), ("sort", pa.int32()), ("front", pa.binary()), ("behind", pa.binary())])


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _AROUND, strict=True)], schema=_AROUND)


def _agree(block: np.ndarray) -> np.ndarray:
    """Leading bytes each row has in common with the row before; -1 for the first."""
    out = np.full(len(block), -1)
    if len(block) > 1:
        differ = block[1:] != block[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), block.shape[1])
    return out


@dataclass
class Level:
    """A suffix array: anchors in order of their suffixes, and the widest repeated strings found to either side (-1: none)."""

    height: int
    suffix: np.ndarray  # gram hash, gram, bytes behind
    prefix: np.ndarray  # gram hash, bytes in front reversed
    front: np.ndarray
    behind: np.ndarray
    before: np.ndarray
    after: np.ndarray
    where: np.ndarray  # number of the anchor

    def take(self, rows: np.ndarray, height: int) -> Level:
        return Level(height, *(x[rows] for x in self._arrays()))

    def _arrays(self):
        return self.suffix, self.prefix, self.front, self.behind, self.before, self.after, self.where

    def order(self) -> np.ndarray:
        return np.argsort(np.ascontiguousarray(self.suffix).view(f"S{self.suffix.shape[1]}").ravel(), kind="stable")

    @classmethod
    def both(cls, a: Level, b: Level) -> Level:
        return cls(a.height, *(np.concatenate(x) for x in zip(a._arrays(), b._arrays(), strict=True)))

    def scan(self, part: np.ndarray) -> None:
        """Note the repeated strings between anchors of different parts."""
        agree = _agree(self.suffix)
        group = np.cumsum(agree < 8 + GRAM)
        mixed = np.zeros(group[-1] + 1, dtype=bool)
        mixed[group[1:][(group[1:] == group[:-1]) & (part[1:] != part[:-1])]] = True
        rows = np.flatnonzero(mixed[group])
        n = len(rows)
        if n < 2:
            return
        agree, group = agree[rows], group[rows]
        prefix = self.prefix[rows]
        order = np.argsort(np.ascontiguousarray(prefix).view(f"S{prefix.shape[1]}").ravel(), kind="stable")
        agree_front = _agree(prefix[order])
        agree = np.where(np.concatenate([[False], group[1:] == group[:-1]]), agree, -1)
        front, behind = self.front[rows], self.behind[rows]
        before, after = self.before[rows], self.after[rows]
        ahead = np.empty(n, dtype=np.int64)
        for width in range(SPAN + 1):
            rest = SPAN - width
            fits = (front >= width) & (behind >= rest)
            if not fits.any():
                continue
            ahead[order] = np.cumsum(agree_front < 8 + width)
            key = (np.cumsum(agree < 8 + GRAM + rest) * (n + 1) + ahead)[fits]
            _, at, times = np.unique(key, return_inverse=True, return_counts=True)
            hit = np.flatnonzero(fits)[times[at] > 1]
            before[hit] = np.maximum(before[hit], width)
            after[hit] = np.maximum(after[hit], rest)
        self.before[rows], self.after[rows] = before, after


class Family:
    """Suffix arrays of anchors in levels; two of one height are merge-scanned and go up as one."""

    def __init__(self):
        self.levels: list[Level] = []
        self.size = 0
        self.before = self.after = np.empty(0, int)

    def add(self, gram: np.ndarray, fronts: list[bytes], behinds: list[bytes]) -> None:
        n = len(gram)
        lead = gram.astype(">i8").view(np.uint8).reshape(-1, 8)
        pad = lambda rows, width: np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
        lengths = np.array([len(f) for f in fronts]), np.array([len(b) - GRAM for b in behinds])
        level = Level(0, np.hstack([lead, pad(behinds, GRAM + SPAN)]), np.hstack([lead, pad(fronts, SPAN)]), *lengths, np.full(n, -1), np.full(n, -1), np.arange(self.size, self.size + n))
        self.size += n
        level = level.take(level.order(), 0)
        level.scan(np.arange(n))
        self.levels.append(level)
        while len(self.levels) > 1 and self.levels[-1].height == self.levels[-2].height:
            self._merge()

    def finish(self) -> None:
        """Merge what is left, and note the results in the order of the anchors."""
        while len(self.levels) > 1:
            self._merge()
        self.before, self.after = np.full(self.size, -1), np.full(self.size, -1)
        for level in self.levels:
            self.before[level.where], self.after[level.where] = level.before, level.after

    def _merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        both, side = Level.both(a, b), np.repeat([0, 1], [len(a.where), len(b.where)])
        order = both.order()  # two sorted runs
        level = both.take(order, a.height + 1)
        level.scan(side[order])
        self.levels.append(level)


def _matched(batches):
    """Byte ranges of the compared anchors that are covered by repeated strings."""
    family, held = Family(), []

    def found():
        family.finish()
        if not held:
            return
        table = pa.concat_tables(held)
        at, sort = table["at"].to_numpy() >> 16, table["sort"].to_numpy()
        keep = (family.before >= 0) & (sort == COMPARE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[keep], pa.int64()) for x in (table["key"].to_numpy(), table["size"].to_numpy(), at - family.before, at + GRAM + family.after)], names=["key", "size", "start", "stop"]
        )

    for table in _whole_groups(batches, "gram"):
        for lo in range(0, len(table), FAMILY_BATCH):
            part = table.slice(lo, FAMILY_BATCH)
            family.add(part["gram"].to_numpy(), part["front"].to_pylist(), part["behind"].to_pylist())
            held.append(part.select(["key", "size", "at", "sort"]))
        if sum(map(len, held)) >= FAMILY_ROWS:
            yield from found()
            family, held = Family(), []
    yield from found()


def _cut(batches):
    for batch in batches:
        ids, out = batch.column(0), []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for a, b in sorted((r["start"], r["stop"]) for r in ranges or []):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            kept, upto = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[upto:a])
                upto = b
            kept.update(data[upto:])
            out.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [tuple(s) for s in spans]))
        n, removed, count, sha, spans = map(list, zip(*out, strict=True)) if out else ([], [], [], [], [])
        spans = pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), spans], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed byte ranges) of every document."""
    rows = keyed(docs, id_col, text_col)
    found = rows.where(F.col("size") >= LENGTH).select("key", "size", "text").mapInArrow(_anchored, "gram bigint, around bigint, key bigint, size bigint, at bigint, times bigint")
    sorted_out = found.repartition("gram").sortWithinPartitions("gram", "around").mapInArrow(_sort_out, "gram bigint, key bigint, size bigint, at bigint, sort int")
    marks = materialize(sorted_out, "anchors")
    kind_of = F.col("sort").bitwiseAND(F.lit(SPLIT - 1))
    places = marks.where(kind_of != WHOLE).groupBy("key", "size").agg(F.collect_list(F.struct("gram", "at", "sort")).alias("places"))
    one_each = rows.where(F.col("size") >= LENGTH).groupBy("key", "size").agg(F.first("text").alias("text"))
    around = one_each.join(places, ["key", "size"]).select("key", "size", "text", "places").mapInArrow(_surroundings, "gram bigint, key bigint, size bigint, at bigint, sort int, front binary, behind binary")
    matched = materialize(around.repartition("gram").sortWithinPartitions("gram").mapInArrow(_matched, "key bigint, size bigint, start bigint, stop bigint"), "matched")
    at, front, behind = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255))
    whole = marks.where((kind_of != COMPARE) & (front + behind >= SPAN)).select("key", "size", (at - front).alias("start"), (at + GRAM + behind).alias("stop"))
    ranges = whole.unionByName(matched).groupBy("key", "size").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    joined = rows.join(ranges, ["key", "size"], "left").select("id", "text", "ranges")
    kind = rows.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(_cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start:bigint,stop:bigint>>")
    return out.withColumnRenamed("id", id_col)


def _entries(batches):
    """Every anchor of the texts with its surroundings."""
    for batch in batches:
        key, size = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
        for lo, hi in slices([len(t) for t in texts], BATCH_BYTES):
            found = anchors(texts[lo:hi])
            if found is None:
                continue
            rows = []
            for w, at, front, behind, gram in zip(*(x.tolist() for x in (*found[:4], found[4].view(np.int64))), strict=True):
                data = texts[lo + w]
                rows.append((gram, key[lo + w], size[lo + w], at << 16 | front << 8 | behind, COMPARE, data[at - front : at][::-1], data[at : at + GRAM + behind]))
            if rows:
                yield _rows(rows)


class SuffixIndex:
    """An index of texts that grows by batches: a new batch is compared with itself and with the levels so far, and levels of one height merge.

    Levels are tables in the shared scratch folder. :meth:`add` returns, for texts of this and of
    earlier batches, the byte ranges that the new batch shows to be repeated (key, size, start, stop); the
    union over all batches is what one batch of everything would give. Keys are those of
    :func:`keyed`. A text that comes again in a later batch is a copy, and repeated as a whole.
    """

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        rows = keyed(docs, None, text_col).where(F.col("size") >= LENGTH).select("key", "size", "text")
        batch = materialize(rows.mapInArrow(_entries, "gram bigint, key bigint, size bigint, at bigint, sort int, front binary, behind binary"), "level")
        grams = batch.select("gram").distinct()
        met = [batch, *(level.join(grams, "gram", "left_semi") for _, level in self.levels)]
        every = reduce(DataFrame.unionByName, met)
        found = materialize(every.repartition("gram").sortWithinPartitions("gram").mapInArrow(_matched, "key bigint, size bigint, start bigint, stop bigint"), "matched")
        self.levels.append((0, batch))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (height, a), (_, b) = self.levels[-2:]
            self.levels[-2:] = [(height + 1, materialize(a.unionByName(b), "level"))]
        return found


def keyed(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, key, size): texts by a hash and their length in bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [] if id_col is None else [F.col(id_col).alias("id")]
    return docs.select(*own, text.alias("text"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("bigint").alias("size"))
