"""Embedding near-duplicates by E8 lattice hashing.

In each table a vector is normalised, projected to ``BLOCKS`` times eight
dimensions by orthonormal rows of a seeded random matrix, shifted and decoded to
the nearest E8 lattice points; their coordinates name its cell. It is also sent
to the ``PROBES`` next-nearest cells, so two vectors meet if one's cell is among
the other's. Where they meet, the cosine is computed in double precision. At a
cosine of exactly 0.9 in 64 dimensions a table joins a pair with probability
0.58, five tables with 0.986; closer pairs are found with more. Large
collections want more blocks (smaller cells) and tables in proportion to the
logarithm of their size (:class:`Scheme`).

First only cells and row numbers are dealt out, to learn which cells hold two
vectors at all, one of them at home; vectors go to those cells alone.

Equal vectors are one representative with a multiplicity. A pair that meets
several times is counted once, at its first meeting, which both sides' codes
tell without listing pairs; only counts and spanning forests leave a group.
Cells with many vectors are split into blocks that are compared two by two.

Null, empty, zero and non-finite vectors and those of other dimensions link
with nothing of theirs. A null id links like any other; ``component_id`` is the
smallest id of the component and null only where all its ids are. Repeated rows
are vectors of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permrisk.llm.common import materialize
from permrisk.llm.components import components, forest

COSINE = 0.9
SEED = 7
BLOCK_ROWS = 512
SMALL = 16
_NEAR = 4


@dataclass(frozen=True)
class Scheme:
    """How vectors are hashed: tables, blocks of eight dimensions and probed cells a table, and the size of the cells."""

    tables: int = 5
    blocks: int = 2
    probes: int = 4
    cell: float = 1.0

    @property
    def width(self) -> int:
        return 1 + self.probes


@cache
def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [v for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2) for v in [np.bincount([i, j], [s, t], 8)]]
    half = [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(c < 0 for c in s) % 2 == 0]
    return np.array(whole + half)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point of even sum: round, and round the least certain coordinate the other way if the sum is odd."""
    f = np.rint(x)
    off = x - f
    k = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(f.sum(axis=1) % 2)
    f[rows, k[rows]] += np.where(off[rows, k[rows]] >= 0, 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@cache
def _projection(dim: int, table: int, blocks: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, table])
    size = max(dim, 8 * blocks)
    basis, _ = np.linalg.qr(rng.normal(size=(size, 8 * blocks)))
    return basis[:dim] * np.sqrt(size / 8) / cell, rng.uniform(-1, 1, size=8 * blocks)


def codes(unit: np.ndarray, scheme: Scheme) -> np.ndarray:
    """(vectors, tables, 1 + probes) codes of the own cell, first, and of the probed cells."""
    n, dim = unit.shape
    out = np.empty((n, scheme.tables, scheme.width), dtype=np.int32)
    at = np.arange(n)[:, None]
    for table in range(scheme.tables):
        basis, shift = _projection(dim, table, scheme.blocks, scheme.cell)
        u = unit @ basis + shift
        distance, points = np.zeros((n, 1)), np.zeros((n, 1), dtype=np.uint64)
        for block in range(scheme.blocks):
            x = u[:, 8 * block : 8 * block + 8]
            own = nearest_e8(x)
            towards = (x - own) @ _roots().T
            top = np.argpartition(-towards, _NEAR, axis=1)[:, : _NEAR - 1]
            near = np.concatenate([own[:, None], own[:, None] + _roots()[top]], axis=1)
            d = ((x[:, None] - near) ** 2).sum(axis=2)
            h = np.zeros(d.shape, dtype=np.uint64)
            for k in range(8):
                h = (h ^ (2 * near[:, :, k] + 4096).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            distance = (distance[:, :, None] + d[:, None, :]).reshape(n, -1)
            points = (points[:, :, None] * np.uint64(0xD6E8FEB86659FD93) + h[:, None, :]).reshape(n, -1)
        best = np.argsort(distance, axis=1, kind="stable")[:, : scheme.width]
        mixed = points[at, best] + np.uint64(dim)
        out[:, table] = ((mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _units(lists: pa.ListArray):
    """(row numbers, unit vectors) for each dimension in an array of vectors."""
    offsets = lists.offsets.to_numpy()
    sizes, start = np.diff(offsets), offsets[:-1] - offsets[0]
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        x = flat[start[rows][:, None] + np.arange(dim)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(code: np.ndarray) -> np.ndarray:
    """Cell keys, the table above the code."""
    return (np.arange(code.shape[1], dtype=np.int64) << 32)[:, None] | code.view(np.uint32).astype(np.int64)


def _census(batches, scheme: Scheme):
    """(cell, rid, whether at home) of every vector in every cell it goes to."""
    home = np.tile(np.arange(scheme.width) == 0, scheme.tables)
    for batch in batches:
        rid = batch.column(0).to_numpy()
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            for rows, unit in _units(batch.column(1).slice(lo, BLOCK_ROWS)):
                keys = _keys(codes(unit, scheme)).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.repeat(rid[lo:][rows], len(home)), pa.int64()), pa.array(np.tile(home, len(rows)), pa.bool_())], names=["cell", "rid", "own"])


def _spread(batches, scheme: Scheme):
    """The vectors, once for each listed cell; in a split cell once for each pair of blocks that the vector is in.

    Columns: rid, n, vec, the listed cells and into how many blocks each is split. Codes are sent up to the cell's table.
    """
    names = ["cell", "pair", "side", "own", "rid", "n", "codes", "vec"]
    for batch in batches:
        rid, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(lo, BLOCK_ROWS)
            listed, vectors = some.column(3), some.column(2)
            first = listed.offsets.to_numpy()
            cells = listed.flatten().field("cell").to_numpy()
            parts = listed.flatten().field("parts").to_numpy()
            for rows, unit in _units(vectors):
                code = codes(unit, scheme)
                counts = np.diff(first)[rows]
                row = np.repeat(np.arange(len(rows)), counts)
                at = np.repeat(first[:-1][rows] - first[0], counts) + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                keys, k = cells[at], parts[at]
                own = _keys(code)[row, keys >> 32, 0] == keys
                again = np.repeat(np.arange(len(keys)), k)
                other = np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
                keys, row, own, k = keys[again], row[again], own[again], k[again]
                if not len(keys):
                    continue
                ids = rid[lo:][rows][row]
                mine = (ids * 0x9E3779B1 >> 7) % k
                a, b = np.minimum(mine, other), np.maximum(mine, other)
                upto = ((keys >> 32) + 1) * scheme.width
                flat = code.reshape(len(rows), -1)[row]
                flat = flat[np.arange(flat.shape[1]) < upto[:, None]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()), pa.array(a << 31 | b, pa.int64()), pa.array(mine != a, pa.bool_()), pa.array(own, pa.bool_()), pa.array(ids, pa.int64()),
                        pa.array(n[lo:][rows][row], pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(upto)]), pa.int32()), pa.array(flat, pa.int32())), vectors.take(pa.array(rows[row], pa.int64())),
                    ],
                    names=names,
                )


def _first(table: int, code: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the cell ``code`` of ``table`` is the first meeting of the pairs with codes ``x`` and ``y`` up to that table."""
    forth = (y == x[:, :, :1]).any(axis=2)
    back = (x == y[:, :, :1]).any(axis=2)
    earlier = (forth | back)[:, :table].any(axis=1)
    big = np.int64(1) << 40
    one = np.where(forth[:, table], x[:, table, 0].view(np.uint32).astype(np.int64), big)
    two = np.where(back[:, table], y[:, table, 0].view(np.uint32).astype(np.int64), big)
    return ~earlier & (np.minimum(one, two) == code)


def _small(start: np.ndarray, size: np.ndarray):
    """All pairs i < j inside groups of a few rows."""
    rows = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    after = np.repeat(start + size, size) - rows - 1
    i = np.repeat(rows, after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def _large(rows: np.ndarray, pair: int, side: np.ndarray, own: np.ndarray, unit: np.ndarray):
    """Pairs of cosine enough in one block of one cell, by blocks of rows."""
    same = (pair >> 31) == (pair & (1 << 31) - 1)
    left = rows if same else rows[~side[rows]]
    right = left if same else rows[side[rows]]
    for lo in range(0, len(left), BLOCK_ROWS):
        for ro in range(lo if same else 0, len(right), BLOCK_ROWS):
            a, b = left[lo : lo + BLOCK_ROWS], right[ro : ro + BLOCK_ROWS]
            i, j = np.nonzero((unit[a] @ unit[b].T >= COSINE) & (own[a][:, None] | own[b]))
            i, j = a[i], b[j]
            yield (i[i < j], j[i < j]) if same else (i, j)


def _links(cell, pair, side, own, unit):
    """Pairs of row numbers of cosine enough; rows come in order of cell and pair."""
    start = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])]))
    size = np.diff(np.append(start, len(cell)))
    whole = pair[start] >> 31 == pair[start] & (1 << 31) - 1
    few = (size > 1) & (size <= SMALL) & whole
    i, j = _small(start[few], size[few])
    for lo in range(0, len(i), 1 << 18):
        a, b = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
        meet = own[a] | own[b]
        a, b = a[meet], b[meet]
        near = np.einsum("ij,ij->i", unit[a], unit[b]) >= COSINE
        yield a[near], b[near]
    for s, n in zip(start[(size > 1) & ~few].tolist(), size[(size > 1) & ~few].tolist(), strict=True):
        if own[s : s + n].any():
            yield from _large(np.arange(s, s + n), int(pair[s]), side, own, unit)


def _compare(batches, scheme: Scheme):
    held: list[pa.RecordBatch] = []

    def emit(table: pa.Table):
        one = table.combine_chunks().to_batches()[0]
        every = [one.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        flat, first = one.column(6).flatten().to_numpy(), one.column(6).offsets.to_numpy()
        first = first - first[0]
        for rows, unit in _units(one.column(7)):
            cell, pair, side, own, rid, n = (x[rows] for x in every)
            a, b = [], []
            for i, j in _links(cell, pair, side, own, unit):
                differ = rid[i] != rid[j]
                i, j = i[differ], j[differ]
                for t in np.unique(cell[i] >> 32).tolist():
                    at = cell[i] >> 32 == t
                    p, q = i[at], j[at]
                    width = (t + 1) * scheme.width
                    code = lambda r: flat[first[rows[r]][:, None] + np.arange(width)].reshape(len(r), t + 1, scheme.width)  # noqa: B023, E731
                    keep = _first(t, cell[p] & 0xFFFFFFFF, code(p), code(q))
                    a.append(p[keep])
                    b.append(q[keep])
                if sum(map(len, a)) > 1 << 20:
                    yield from counted(np.concatenate(a), np.concatenate(b), rid, n)
                    a, b = [], []
            if a:
                yield from counted(np.concatenate(a), np.concatenate(b), rid, n)

    def counted(a, b, rid, n):
        if not len(a):
            return
        ids, at = np.unique(rid[np.concatenate([a, b])], return_inverse=True)
        links = np.bincount(at, weights=n[np.concatenate([b, a])]).astype(np.int64)
        u, v = forest(rid[a], rid[b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids, u]), pa.int64()), pa.array(np.concatenate([ids, v]), pa.int64()), pa.array(np.concatenate([links, np.zeros(len(u), np.int64)]), pa.int64())], names=["a", "b", "links"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        key = lambda x, i: (x.column(0)[i].as_py(), x.column(1)[i].as_py())
        if key(held[0], 0) == key(batch, batch.num_rows - 1):
            continue
        table = pa.Table.from_batches(held)
        cell, pair = table["cell"].to_numpy(), table["pair"].to_numpy()
        cut = int(np.argmax((cell == cell[-1]) & (pair == pair[-1])))
        if cut:
            yield from emit(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield from emit(pa.Table.from_batches(held))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, scheme: Scheme = Scheme()) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>" if "double" not in vectors.schema[vec_col].dataType.simpleString() else "array<double>").alias("vec"))
    sound = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    kind = rows.schema["vec"].dataType.simpleString()
    classes = rows.where("sound").groupBy("vec").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    light = classes.select("rid", "vec").mapInArrow(lambda b: _census(b, scheme), "cell bigint, rid bigint, own boolean").repartition("cell")
    census = light.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("n > 1 AND own")
    parts = F.ceil(F.col("n") / (4 * BLOCK_ROWS)).alias("parts")
    asked = light.select("cell", "rid").join(census.select("cell", parts), "cell").groupBy("rid").agg(F.collect_list(F.struct("cell", "parts")).alias("cells"))
    spread = classes.select("rid", "n", "vec").join(asked, "rid").mapInArrow(lambda b: _spread(b, scheme), f"cell bigint, pair bigint, side boolean, own boolean, rid bigint, n bigint, codes array<int>, vec {kind}")
    found = materialize(spread.repartition("cell", "pair").sortWithinPartitions("cell", "pair").mapInArrow(lambda b: _compare(b, scheme), "a bigint, b bigint, links bigint"), "links")
    links = found.groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    roots = components(found.where("a <> b")).withColumnRenamed("node", "rid")
    known = classes.join(links, "rid", "left").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    lowest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = materialize(known.join(lowest, "root").select(F.xxhash64("vec").alias("h"), "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "known")
    linked = rows.where("sound").withColumn("h", F.xxhash64("vec")).join(known, ["h", "vec"]).select("id", "n_links", "component_id")
    lone = rows.where(~F.col("sound")).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(lone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
