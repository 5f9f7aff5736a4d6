"""Vector codes: product quantisation by exact integer k-means, nearest entries by exponion search.

Components become integers, floor(1024 x), and vectors are cut into four equal
parts with a codebook each, which starts as the parts of the vectors of the
least ids. In every round each part goes to the nearest entry of its codebook
(squared distance in integers, ties to the lower index), then entries become the
floors of the means of their parts.

The search for a part starts at its entry of the round before, a, at distance
u. An entry nearer than a, or as near, is within 2u of a, so of the list of
entries by their distance from a only those with squared distance up to 4u^2
are looked at, in rings that double; all comparisons are of integers.

A round is one pass: tasks read vectors with their codes, write them with the
new codes to a scratch table and, beside them, a row for each entry in use with
the sum of its parts. Only these sums, grouped by entry, and the codebooks (4 x
256 entries) pass through the driver; the size of both is fixed. Label sums are
added up before they are joined back: the at most thousand labels with a
thousandth of all rows or more by broadcast, all others by a shuffle.

Results for odd input: vectors that are null, empty or hold null or non-finite
components are dropped; a null id is kept and sorts last, repeated rows are all
kept, ids that repeat sort by their components; fewer vectors than entries give
as many entries; an empty table gives an empty one. Vectors of different
lengths, or whose length four does not divide, are refused, as are components
so large that a squared distance would not fit (2^27 after scaling for 64
components). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permrisk.llm.common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: A label with this share of all rows or more is joined by broadcast; there are at most as many such labels as its inverse.
HEAVY = 0.001


@dataclass(frozen=True)
class Codebook:
    """Entries of one part position and, for each, all entries by squared distance from it."""

    entries: np.ndarray
    near: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebook:
        gaps = squared(entries, entries)
        near = np.argsort(gaps, axis=1, kind="stable")
        return cls(entries, near, np.take_along_axis(gaps, near, axis=1))

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lowest of equals, and the squared distance; ``start`` only directs the search."""
        code = start.astype(np.int64)
        least = ((x - self.entries[code]) ** 2).sum(axis=1)
        rows = np.argsort(start, kind="stable")
        cuts = np.flatnonzero(np.diff(start[rows])) + 1
        for group in np.split(rows, cuts) if len(rows) else ():
            a = int(start[group[0]])
            reach = np.searchsorted(self.gaps[a], 4 * least[group], side="right")
            order = np.argsort(-reach, kind="stable")
            group, reach = group[order], reach[order]
            low, width = 0, 8
            while low < reach[0]:
                live = group[: np.searchsorted(-reach, -low, side="left")]
                ring = self.near[a, low : min(low + width, int(reach[0]))]
                apart = squared(x[live], self.entries[ring])
                best = apart.min(axis=1)
                index = np.where(apart == best[:, None], ring[None, :], len(self.entries)).min(axis=1)
                better = (best < least[live]) | ((best == least[live]) & (index < code[live]))
                least[live[better]], code[live[better]] = best[better], index[better]
                low, width = low + len(ring), width * 2
        return code, least


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)


def quantised(values: np.ndarray, part: int) -> np.ndarray:
    """floor(1024 x) as integers, if squared distances between parts of ``part`` of them fit."""
    scaled = np.floor(SCALE * values.astype(np.float64))
    if scaled.size and np.abs(scaled).max() > isqrt((1 << 58) // part):
        raise ValueError("components are too large for squared distances in 64 bits")
    return scaled.astype(np.int64)


def _whole(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return vectors.where(_whole(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), label.alias("label"), F.col(vector_col).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if len(column) and np.any(np.diff(np.asarray(column.offsets)) != dim):
        raise ValueError(f"vectors of other lengths than {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, PARTS)


def _assigned(batch: pa.RecordBatch, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The integers of a batch (vec_id, label, v, codes), the new codes and the summed squared distances. Floats and null codes are of the first round."""
    part = books[0].entries.shape[1]
    raw = _matrix(batch.column(2), part * PARTS)
    x = quantised(raw, part) if raw.dtype.kind == "f" else raw.astype(np.int64)
    start = _codes(batch.column(3)) if raw.dtype.kind != "f" else np.zeros((len(x), PARTS), dtype=np.uint8)
    codes, error = np.empty_like(start), np.zeros(len(x), dtype=np.int64)
    for p, book in enumerate(books):
        code, least = book.nearest(x[:, p * part : (p + 1) * part], start[:, p])
        codes[:, p] = code
        error += least
    return x, codes, error


def _pass(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """The vectors with new codes, and the sums of the parts of every entry, told apart by ``kind``."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    size, part = books[0].entries.shape
    schema = rows.schema
    ids, labels = schema["vec_id"].dataType.simpleString(), schema["label"].dataType.simpleString()

    def run(batches):
        count, total = np.zeros((PARTS, size), dtype=np.int64), np.zeros((PARTS, size, part), dtype=np.int64)
        kinds = None
        for batch in batches:
            kinds = batch.schema.types[:2]
            x, codes, _ = _assigned(batch, shared.value)
            for p in range(PARTS):
                count[p] += np.bincount(codes[:, p], minlength=size)
                np.add.at(total[p], codes[:, p], x[:, p * part : (p + 1) * part])
            n, none = len(x), pa.nulls(len(x), pa.int32())
            v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part * PARTS), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(["vector"] * n), batch.column(0), batch.column(1), v, pa.array([c.tobytes() for c in codes], pa.binary()), none, none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                names=names,
            )
        if kinds is not None:
            at, entry = np.nonzero(count)
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["sum"] * n), pa.nulls(n, kinds[0]), pa.nulls(n, kinds[1]), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary()), pa.array(at, pa.int32()), pa.array(entry, pa.int32()),
                 pa.array(count[at, entry]), pa.array(list(total[at, entry]), pa.list_(pa.int64()))],
                names=names,
            )

    names = ["kind", "vec_id", "label", "v", "codes", "part", "entry", "n", "total"]
    return rows.select("vec_id", "label", "v", "codes").mapInArrow(run, f"kind string, vec_id {ids}, label {labels}, v array<bigint>, codes binary, part int, entry int, n bigint, total array<bigint>")


def _moved(passed: DataFrame, books: list[Codebook]) -> list[Codebook]:
    """The codebooks whose entries are the floors of the means of their parts; an entry without parts stays."""
    sums = passed.where("kind = 'sum'").select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    sums = sums.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    entries = [b.entries.copy() for b in books]
    for row in sums.toLocalIterator():
        entries[row.part][row.entry, row.at] = row.x // row.n
    return [Codebook.of(e) for e in entries]


def _start(rows: DataFrame) -> list[Codebook]:
    first = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()]
    if len({len(v) for v in first}) > 1 or first and len(first[0]) % PARTS:
        raise ValueError(f"vectors of one length that {PARTS} divides are needed")
    if not first:
        return []
    part = len(first[0]) // PARTS
    x = quantised(np.array(first), part)
    return [Codebook.of(x[:, p * part : (p + 1) * part]) for p in range(PARTS)]


def _trained(rows: DataFrame) -> tuple[list[Codebook], DataFrame]:
    books, state = _start(rows), rows.withColumn("codes", F.lit(None).cast("binary"))
    for _ in range(ROUNDS if books else 0):
        passed = materialize(_pass(state, books), "codes", by="kind")
        books = _moved(passed, books)
        state = passed.where("kind = 'vector'").select("vec_id", "label", "v", "codes")
    return books, state


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> list[Codebook]:
    """The codebooks of the four part positions; none for an empty table."""
    return _trained(_kept(vectors, id_col, vector_col, None))[0]


def _encoded(state: DataFrame, books: list[Codebook]) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(books)
    ids, labels = state.schema["vec_id"].dataType.simpleString(), state.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not shared.value:
                continue
            _, codes, error = _assigned(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "v", "codes").mapInArrow(run, f"vec_id {ids}, label {labels}, code string, error bigint")


def encode(vectors: DataFrame, books: list[Codebook], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, code, error) of any vectors by given codebooks."""
    rows = _kept(vectors, id_col, vector_col, None).withColumn("codes", F.lit(None).cast("binary"))
    return _encoded(rows, books).select(F.col("vec_id").alias(id_col), "code", "error")


def decode(rows: DataFrame, books: list[Codebook], id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """(id, vector): the entries that a code names, scaled back; a null code gives a null vector."""
    kind, shared = rows.schema[id_col].dataType.simpleString(), rows.sparkSession.sparkContext.broadcast([b.entries for b in books])

    def spelled(code: str | None) -> list[float] | None:
        return None if code is None else np.concatenate([shared.value[p][c] / SCALE for p, c in enumerate(bytes.fromhex(code))]).tolist()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spelled(c) for c in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=[id_col, "vector"])

    return rows.select(id_col, code_col).mapInArrow(run, f"`{id_col}` {kind}, vector array<double>")


def digest(books: list[Codebook]) -> str:
    """sha256 of all entries' components, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def _with_label_error(coded: DataFrame) -> DataFrame:
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "own"), "labels")
    rows = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    same = F.col("label").eqNullSafe(F.col("own"))
    heavy, light = sums.where(F.col("n") >= HEAVY * rows).drop("n"), sums.where(F.col("n") < HEAVY * rows).drop("n")
    return coded.join(F.broadcast(heavy), same).drop("own").unionByName(coded.join(F.broadcast(heavy.select("own")), same, "left_anti").join(light, same).drop("own"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector, by codebooks trained on all of them."""
    books, state = _trained(_kept(vectors, id_col, vector_col, label_col))
    coded = materialize(_encoded(state, books), "coded")
    return _with_label_error(coded).select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
