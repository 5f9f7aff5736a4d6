"""SimHash near-duplicates by anchor-point covering.

A fingerprint holds one majority vote for each bit of the XXH64 values of its
word shingles. Two blocks of 23 bits of a fingerprint are decoded by the binary
[23,12] Golay code, a perfect code of covering radius 3, so 2^24 pairs of
codewords are the anchors and each fingerprint has one home anchor. Is y within
distance t of x, then y lies within 3 + t1 and 3 + t2 of the blocks of x's home
with t1 + t2 <= t; a fingerprint is therefore sent to each anchor within the
covering radius plus the threshold, and compared there with the fingerprints at
home. No pair is lost, whichever bits differ.

Only distinct fingerprints are compared, so copies cost one row. An anchor that
is home to very many is split: its homes are dealt out, its visitors go to each
part. The list of those anchors has at most ``HOT_ANCHORS`` entries by the way
the limit is set. From each group only a spanning forest of links is emitted.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permrisk.llm.common import materialize, unused
from permrisk.llm.components import components, forest

THRESHOLD = 2
SHINGLE = 3
SEED = 42
HOMES_A_TASK = 4096
#: fingerprints that one task sends out; each of them goes to some 60 anchors
SENT_A_TASK = 1 << 16
HOT_ANCHORS = 1 << 16
PAIRS_AT_ONCE = 1 << 22
BLOCK = 23
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GOLAY = 0b110001110101


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint; 0 without words. Only A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    last = max(1, len(words) - shingle + 1)
    votes, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for lo in range(0, last, 1 << 15):
        hi = min(last, lo + (1 << 15))
        h = np.array([digest(joined[starts[i] : ends[min(i + shingle, len(words)) - 1]], SEED) for i in range(lo, hi)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > last, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=["id", "fp"])


def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for k in range(BLOCK - 1, 10, -1):
        words ^= np.where(words >> k & 1, GOLAY << (k - 11), 0)
    return words


@cache
def _cosets(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of up to 3 + threshold bits, and by how many bits each exceeds 3."""
    bits = [int(x) for x in _remainder(1 << np.arange(BLOCK))]
    lists: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for weight in range(4 + threshold):
        for places in combinations(range(BLOCK), weight):
            s = 0
            for p in places:
                s ^= bits[p]
            lists[s].append((sum(1 << p for p in places), max(0, weight - 3)))
    width = max(map(len, lists))
    pattern, excess = np.zeros((1 << 11, width), dtype=np.int64), np.full((1 << 11, width), 99)
    for s, found in enumerate(lists):
        pattern[s, : len(found)] = [p for p, _ in found]
        excess[s, : len(found)] = [e for _, e in found]
    return pattern, excess


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether it is the home) for every anchor in reach."""
    pattern, excess = _cosets(threshold)
    one, two = (fps & (1 << BLOCK) - 1).astype(np.int64), (fps >> np.uint64(BLOCK) & (1 << BLOCK) - 1).astype(np.int64)
    s, t = _remainder(one), _remainder(two)
    spare = excess[s][:, :, None] + excess[t][:, None, :]
    i, j, k = np.nonzero(spare <= threshold)
    where = ((one[i] ^ pattern[s[i], j]) >> 11) << 12 | (two[i] ^ pattern[t[i], k]) >> 11
    return i, where, spare[i, j, k] == 0


def _spread(batches, hot: dict[int, int], threshold: int):
    keys = np.array(sorted(hot), dtype=np.int64)
    parts = np.array([hot[k] for k in keys.tolist()], dtype=np.int64)
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for lo in range(0, len(every), 1024):
            fps = every[lo : lo + 1024]
            i, anchor, home = anchors(fps, threshold)
            fp, part = fps[i], np.zeros(len(i), dtype=np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, anchor), len(keys) - 1)
                n = np.where(keys[at] == anchor, parts[at], 1)
                own = (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % n
                again = np.repeat(np.arange(len(i)), n)
                part = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                # at home in one part, a visitor in the others
                anchor, fp, home = anchor[again], fp[again], home[again] & (part == own[again])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part << 24 | anchor, pa.int64()), pa.array(fp.view(np.int64), pa.int64()), pa.array(home, pa.bool_())], names=["anchor", "fp", "home"]
            )


def _links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int):
    """Forests of the links found in whole groups of equal anchors; the rows are in anchor order."""
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.diff(np.concatenate([start, [len(anchor)]]))
    group = np.repeat(np.arange(len(start)), size)
    rows = np.flatnonzero(home & (size[group] > 1))
    count = size[group[rows]]
    done, upto = 0, np.cumsum(count)
    while done < len(rows):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS_AT_ONCE)))
        r, c = rows[done:stop], count[done:stop]
        x = np.repeat(r, c)
        y = np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[group[r]], c)
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= threshold) & (fp[x] != fp[y])
        if near.any():
            yield forest(fp[x[near]].view(np.int64), fp[y[near]].view(np.int64))
        done = stop


def _compare(batches, threshold: int):
    held: list[tuple] = []

    def emit(anchor, fp, home):
        for a, b in _links(anchor, fp, home, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy()
        held.append((anchor, batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
        if held[0][0][0] == anchor[-1]:
            continue  # still inside one group
        anchor, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(anchor, anchor[-1]))
        yield from emit(anchor[:cut], fp[:cut], home[:cut])
        held = [(anchor[cut:], fp[cut:], home[cut:])]
    if held:
        yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))


def link_fingerprints(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``threshold`` bits."""
    total = fps.count()
    limit = max(HOMES_A_TASK, total // HOT_ANCHORS)
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SENT_A_TASK))
    # by a hash of its own: the grouping by fp would satisfy, and its few large partitions be kept
    fps = fps.select("fp").repartition(tasks, F.xxhash64("fp"))

    def homes(batches):
        for batch in batches:
            i, where, home = anchors(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), 0)
            yield pa.RecordBatch.from_arrays([pa.array(where[home], pa.int64())], names=["anchor"])

    hot = fps.mapInArrow(homes, "anchor bigint").groupBy("anchor").count().where(F.col("count") > limit)
    parts = {r["anchor"]: -(-r["count"] // limit) for r in hot.collect()}
    spread = fps.mapInArrow(lambda b: _spread(b, parts, threshold), "anchor bigint, fp bigint, home boolean")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _compare(b, threshold), "a bigint, b bigint")


def _classes(marked: DataFrame, best: str, threshold: int) -> DataFrame:
    """(fp, best): the least ``best`` of each component, for every distinct fingerprint."""
    fps = marked.groupBy("fp").agg(F.expr(best).alias("low"))
    roots = components(materialize(link_fingerprints(fps, threshold), "links"))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return materialize(rooted.join(rooted.groupBy("root").agg(F.min("low").alias("best")), "root").select("fp", "best"), "classes")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, f"id {kind}, fp bigint"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: int = THRESHOLD) -> DataFrame:
    """One row a document: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Null and wordless texts have fingerprint zero and are linked like any other.
    ``component_id`` is the smallest id reachable over links, null only where
    the whole component has null ids. Repeated rows each return a row.
    """
    marked = _marked(docs, id_col, text_col)
    classes = _classes(marked, "min(id)", threshold)
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component, all its columns as they were: the one of the smallest id, then text hash.

    A row without an id stays only if its component has no row with one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text")).alias("id"), F.col(text_col).alias("text"))
    marked = materialize(keyed.mapInArrow(_fingerprints, f"id struct<none:boolean,id:{kind},text:bigint>, fp bigint"), "fp")
    kept = _classes(marked, "min(id)", threshold).select("best").distinct()
    again = marked.join(kept, F.col("id") == F.col("best"), "left_semi").groupBy("id").count().where("count > 1")
    names = docs.columns
    own = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    best = unused("__best", names)
    out = docs.join(kept.withColumnRenamed("best", best), own.eqNullSafe(F.col(best)), "left_semi").select(*names)
    if again.isEmpty():
        return out
    # repeated rows of one id and text: only now is their text worth a shuffle
    return out.dropDuplicates([id_col, text_col])
