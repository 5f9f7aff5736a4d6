"""Language-model scores from a hashed maximum-entropy model.

Counts first: every word of every training document is counted, and the counts
stay a table. The ``HOT_WORDS`` most frequent words (a bounded list; words over
``HOT_BYTES`` bytes stand in it by their digest) go to all tasks; other words of
a text meet their counts in a join on the word, so no dictionary grows with the
corpus, and no frequent word is a hot join key.

The model factors a token into classes of classes: the words of the list, the
end of a text among them, and one leaf for all words beyond it are the leaves of
a tree with ``BRANCH`` ways at each node, cut so that the ways are about equally
likely. A frequent word takes one or two choices, a rare one five or six. Each
choice is a softmax over hashed features of the node with the word before, with
the second before, skipping one, and, in the first choices, with the two. Biases are the
logarithms of the exact counts, so a context never seen leaves the unigram
model. In the leaf of the words beyond the list, these have add-one
probabilities.

Each round, tasks take minibatch gradient steps (Adagrad, a step size for each
feature) from the broadcast weights on another share of the training documents,
all of them by the last round. The weights of a feature are averaged over the
tasks in proportion to the squared gradients each saw for it, block by block, on
the executors. Scoring is a sparse gather and a dense softmax in numpy batches.

A null text is an empty one: its only token is the end. Null ids are scored and
never trained on. Without training documents counts are zero and the model
gives every token the add-one probability.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permrisk.llm.common import fold, materialize, slices

HOT_WORDS, HOT_BYTES = (1 << 16) - 1, 64
BRANCH = 16
#: features of a choice, and the rows that the features of a kind are hashed to
FEATURES, ROWS = 3, 1 << 16
#: choices from the root on that see the pair of words before; below them, too few tokens pass for pairs
PAIRED = 2
HASHED = 1024
START = HOT_WORDS + HASHED + 1
ROUNDS, STEP, BATCH = 3, 0.5, 32768
BLOCK = 1024
BOUND = np.float32(40)
BATCH_CHARS = 1 << 21
COUNTED_CHARS = 1 << 23
#: choices whose shares are made at once, so that they stay in a core's cache
PIECE = 4096


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words with A-Z lower-cased, an end (no bytes) behind those of each text; and how many tokens each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # split at the blank behind its last word, a text leaves an empty string there; an empty text is that string
    closed = pc.if_else(pc.equal(pc.binary_length(trimmed), 0), trimmed, pc.binary_join_element_wise(trimmed, "", " "))
    words = pc.ascii_split_whitespace(closed)
    return words.flatten().cast(pa.binary()), pc.list_value_length(words).to_numpy().astype(np.int64)


def _cut(texts: pa.Array, chars: int):
    """(start, stop) of runs of texts with about so many characters."""
    return slices(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), chars)


def _counts(batches):
    for batch in batches:
        texts = batch.column(0)
        for lo, hi in _cut(texts, COUNTED_CHARS):
            found = tokens(texts.slice(lo, hi - lo))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])


def _put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """``rows[at] = values``, a row as one item."""
    item = f"V{rows.itemsize * BRANCH}"
    np.put(rows.view(item), at, np.ascontiguousarray(values).view(item))


@dataclass
class Vocabulary:
    """The words of the list by rank, their counts, and the number of all and of all distinct tokens."""

    rank: dict[bytes, int]
    count: np.ndarray
    total: int
    distinct: int

    def __post_init__(self):
        self.rest_total = self.total - int(self.count.sum())
        self.rest_distinct = self.distinct - len(self.count)
        self.listed = pa.array(sorted(self.rank, key=self.rank.get), pa.binary())

    def ids(self, words: pa.Array) -> np.ndarray:
        """Rank of each token; a word without one gets minus one minus its hash."""
        ids = pc.fill_null(pc.index_in(words, value_set=self.listed), -1).to_numpy().astype(np.int64)
        beyond = np.flatnonzero(ids < 0)
        if len(beyond):
            rest = words.take(pa.array(beyond)).to_numpy(zero_copy_only=False).tolist()
            ids[beyond] = -1 - np.fromiter(map(zlib.crc32, rest), np.int64, len(rest)) % HASHED
            for k in np.flatnonzero(np.fromiter(map(len, rest), np.int64, len(rest)) > HOT_BYTES).tolist():
                ids[beyond[k]] = self.rank.get(_digest(rest[k]), ids[beyond[k]])
        return ids


def _digest(word: bytes) -> bytes:
    """What stands for a long word in the list; no word has a blank."""
    return b" " + hashlib.sha256(word).digest()


class Tree:
    """Paths of choices to the leaves: words by rank, and last the words beyond the list.

    The least likely BRANCH nodes become the ways of a new node until one is left,
    which keeps the mean number of choices a token least (Huffman).
    """

    def __init__(self, vocabulary: Vocabulary):
        mass = np.concatenate([vocabulary.count, [vocabulary.rest_total]]) + 0.5
        leaves = len(mass)
        heap = [(m, k) for k, m in enumerate(mass.tolist())]
        heapq.heapify(heap)
        ways: list[list[int]] = []
        take = 2 + (leaves - 2) % (BRANCH - 1)  # so that every later node has all its ways
        while len(heap) > 1 or not ways:
            found = [heapq.heappop(heap) for _ in range(min(take, len(heap)))]
            heapq.heappush(heap, (sum(m for m, _ in found), leaves + len(ways)))
            ways.append([k for _, k in found])
            take = BRANCH
        ways.reverse()  # the root first
        number = leaves + len(ways) - 1
        self.bias = np.full((len(ways), BRANCH), -BOUND, dtype=np.float32)
        total = np.concatenate([mass, np.zeros(len(ways))])
        paths: list[list[tuple[int, int]]] = [[] for _ in range(leaves + len(ways))]
        for node, below in enumerate(ways):
            for way, k in enumerate(below):
                paths[k] = [*paths[number - node], (node, way)]
        for node in range(len(ways) - 1, -1, -1):
            part = total[ways[node]]
            total[number - node] = part.sum()
            self.bias[node, : len(part)] = np.log(part / part.sum())
        depth = max(len(p) for p in paths[:leaves])
        self.node = np.full((depth, leaves), -1, dtype=np.int32)
        self.way = np.zeros((depth, leaves), dtype=np.int8)
        for leaf, path in enumerate(paths[:leaves]):
            for d, (node, way) in enumerate(path):
                self.node[d, leaf], self.way[d, leaf] = node, way


class Model:
    """The tree and the weights of all features, a table for each kind of feature."""

    def __init__(self, tree: Tree, tables: list[np.ndarray] | None = None):
        self.tree = tree
        self.tables = tables if tables is not None else [np.zeros((ROWS, BRANCH), dtype=np.float32) for _ in range(FEATURES)]

    @staticmethod
    def contexts(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        """What each kind of feature sees of the words before."""
        a, b = one.astype(np.uint32) * np.uint32(0x9E3779B1), two.astype(np.uint32) * np.uint32(0x85EBCA77)
        return [a, b ^ np.uint32(0x27D4EB2F), (a ^ b >> np.uint32(15)) * np.uint32(0xC2B2AE3D) + b]

    @staticmethod
    def rows(contexts: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
        n = node.astype(np.uint32) * np.uint32(0x165667B1)
        return [((c ^ n) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16) for c in contexts]

    def shares(self, node: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What each way has, and the sum over the ways of a choice: their quotient is the probability of a way."""
        out, total = np.empty((len(node), BRANCH), dtype=np.float32), np.empty(len(node), dtype=np.float32)
        for lo in range(0, len(node), PIECE):
            x, cut = out[lo : lo + PIECE], slice(lo, lo + PIECE)
            np.add(self.tree.bias.take(node[cut], axis=0), self.tables[0].take(rows[0][cut], axis=0), out=x)
            for table, r in zip(self.tables[1:], rows[1:], strict=False):
                x += table.take(r[cut], axis=0)
            np.clip(x, -BOUND, BOUND, out=x)
            np.exp(x, out=x)
            np.einsum("ij->i", x, out=total[cut])
        return out, total

    def levels(self, leaf: np.ndarray, contexts: list[np.ndarray]):
        """(tokens, nodes, ways, feature rows) of the choices of each depth."""
        live = np.arange(len(leaf))
        for depth, (node, way) in enumerate(zip(self.tree.node, self.tree.way, strict=True)):
            if depth == PAIRED:
                contexts = contexts[:-1]
            at = node.take(leaf)
            if len(live) < len(leaf) or (at < 0).any():
                keep = np.flatnonzero(at >= 0)
                live, leaf, at = live[keep], leaf[keep], at[keep]
                contexts = [c[keep] for c in contexts]
            if not len(live):
                return
            yield live, at, way.take(leaf), self.rows(contexts, at)

    def log_probability(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.zeros(len(leaf))
        for lo in range(0, len(leaf), BATCH):
            cut = slice(lo, lo + BATCH)
            for live, node, way, rows in self.levels(leaf[cut], self.contexts(one[cut], two[cut])):
                each, total = self.shares(node, rows)
                out[lo + live] += np.log(each[np.arange(len(live)), way] / total)
        return out

    def learn(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray, sums: list[np.ndarray]) -> None:
        """One step on a minibatch; ``sums`` holds the squared gradients of each row."""
        for live, node, way, rows in self.levels(leaf, self.contexts(one, two)):
            g, whole = self.shares(node, rows)
            g /= whole[:, None]
            g[np.arange(len(live)), way] -= 1
            for table, total, r in zip(self.tables, sums, rows, strict=False):
                order = np.argsort(r, kind="stable")
                inside = r.take(order)
                start = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
                size = np.diff(start, append=len(order))
                step = g.take(order.take(start), axis=0)
                several = np.flatnonzero(size > 1)  # most rows are met once, and have their sum already
                if len(several):
                    inner = order[np.repeat(size > 1, size)]
                    # as complex numbers, two columns are added at once
                    _put(step, several, np.add.reduceat(g.take(inner, axis=0).view(np.complex64), np.cumsum(size[several]) - size[several], axis=0).view(np.float32))
                at = inside.take(start)
                so_far = total.take(at) + np.einsum("ij,ij->i", step, step)
                total[at] = so_far
                step *= (STEP / np.sqrt(so_far + np.float32(1e-2)))[:, None]
                _put(table, at, table.take(at, axis=0) - step)


def _positions(vocabulary: Vocabulary, texts: pa.Array):
    """Words, sizes of the texts, ids, leaves, and what stands for the word before and the second before each token."""
    words, sizes = tokens(texts)
    ids = vocabulary.ids(words)
    known = np.where(ids < 0, HOT_WORDS - ids, ids)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

    def back(k):
        out = np.full(len(ids), START, dtype=np.int64)
        out[k:] = known[:-k]
        return np.where(place >= k, out, START)

    return words, sizes, ids, np.where(ids < 0, len(vocabulary.count), ids), back(1), back(2)


def _steps(batches, vocabulary: Vocabulary, tree: Tree, tables: list[np.ndarray]):
    """Weights after this task's steps, as blocks of bytes with the squared gradients of each row."""
    model = Model(tree, [t.copy() for t in tables])
    sums = [np.zeros(ROWS, dtype=np.float32) for _ in tables]
    for batch in batches:
        texts = batch.column(0)
        for lo, hi in _cut(texts, BATCH_CHARS):
            _, _, _, leaf, one, two = _positions(vocabulary, texts.slice(lo, hi - lo))
            for s in range(0, len(leaf), BATCH):
                model.learn(*(x[s : s + BATCH] for x in (leaf, one, two)), sums)
    parts = [(k, lo) for k in range(FEATURES) for lo in range(0, ROWS, BLOCK) if sums[k][lo : lo + BLOCK].any()]
    if parts:
        cut = lambda tables: pa.array([tables[k][lo : lo + BLOCK].astype("<f4").tobytes() for k, lo in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([k << 32 | lo for k, lo in parts], pa.int64()), cut(sums), cut(model.tables)], names=["block", "seen", "w"])


def _average(batches):
    total: dict[int, np.ndarray] = {}
    weight: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, seen, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = np.frombuffer(seen, "<f4").astype(np.float64)
            part = np.frombuffer(w, "<f4").reshape(-1, BRANCH) * n[:, None]
            total[block] = total[block] + part if block in total else part
            weight[block] = weight[block] + n if block in weight else n
    keys = sorted(total)
    mean = [total[k] / np.where(weight[k] > 0, weight[k], 1)[:, None] for k in keys]
    names = ["block", "seen", "w"]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array([x.astype("<f4").tobytes() for x in xs], pa.binary()) for xs in ([weight[k] for k in keys], mean))], names=names)


def train(docs: DataFrame, vocabulary: Vocabulary, *, rounds: int = ROUNDS) -> Model:
    """Fit on the texts of ``docs`` (columns key, text), each of them in one of the rounds."""
    spark = docs.sparkSession
    model = Model(Tree(vocabulary))
    tasks = max(12, docs.rdd.getNumPartitions() // 8)
    for r in range(rounds):
        weights = spark.sparkContext.broadcast((vocabulary, model.tree, model.tables))
        part = docs.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r).select("text").coalesce(tasks)
        steps = part.mapInArrow(lambda b, w=weights: _steps(b, *w.value), "block bigint, seen binary, w binary")
        # the weights have a fixed size, so have the blocks that come back
        for row in steps.repartition("block").mapInArrow(_average, "block bigint, seen binary, w binary").collect():
            seen = np.frombuffer(row.seen, "<f4") > 0
            lo = row.block & 0xFFFFFFFF
            model.tables[row.block >> 32][lo : lo + BLOCK][seen] = np.frombuffer(row.w, "<f4").reshape(-1, BRANCH)[seen]
        weights.unpersist()
    return model


def _rare(words: pa.Array, beyond: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The distinct words beyond the list of each text, with their occurrences there."""
    found = words.filter(pa.array(beyond)).dictionary_encode()
    distinct = max(1, len(found.dictionary))
    pairs, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[beyond] * distinct + found.indices.to_numpy(), return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(len(sizes) + 1) * distinct)
    met = pa.StructArray.from_arrays([found.dictionary.take(pa.array(pairs % distinct)), pa.array(times, pa.int64())], names=["w", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), met)


def _scored(batches, vocabulary: Vocabulary, tree: Tree, tables: list[np.ndarray]):
    model = Model(tree, tables)
    count = np.log10(vocabulary.count + 1.0)
    blank = not vocabulary.total
    log_rest = np.log10(max(1, vocabulary.rest_total + vocabulary.rest_distinct + 1))
    for batch in batches:
        texts = batch.column(2)
        for lo, hi in _cut(texts, BATCH_CHARS):
            words, sizes, ids, leaf, one, two = _positions(vocabulary, texts.slice(lo, hi - lo))
            p = np.zeros(len(ids)) if blank else model.log_probability(leaf, one, two) / np.log(10)
            hot = ids >= 0
            base = np.where(hot, count[np.maximum(ids, 0)] if len(count) else 0.0, 0.0)
            p += np.where(hot, 0.0, -log_rest)
            start = np.cumsum(sizes) - sizes
            rare = _rare(words, ~hot, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat(hot.astype(np.int64), start), pa.int64()),
                    pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(p, start)), rare,
                ],
                names=["id", "held_out", "n_tokens", "known", "base", "model", "rare"],
            )


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """The most frequent words, at most ``HOT_WORDS``.

    A histogram of the counts in steps of 2^(1/64) tells from which count on they are few enough;
    only these leave the tasks. A step that does not fit as a whole stays out.
    """
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    word = F.when(F.octet_length("word") <= HOT_BYTES, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.sha2("word", 256))))
    short = counts.select(word.alias("word"), "n").withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int"))
    room, least = HOT_WORDS, None
    for row in sorted(short.groupBy("step").count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row.step
    top = [] if least is None else sorted((-r.n, bytes(r.word)) for r in short.where(F.col("step") >= least).collect())
    return Vocabulary({w: i for i, (_, w) in enumerate(top)}, np.array([-n for n, _ in top], dtype=np.int64), total.n or 0, total.v)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, modulus: int = 7, held: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    out_of = fold(id_col, modulus) != held
    training = docs.where(out_of).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    counts = materialize(training.select("text").mapInArrow(_counts, "word binary, n bigint").where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    vocabulary = vocabulary_of(counts)
    model = train(training, vocabulary) if vocabulary.total else Model(Tree(vocabulary))
    shared = spark.sparkContext.broadcast((vocabulary, model.tree, model.tables))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(~out_of, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(lambda b: _scored(b, *shared.value), f"id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, model double, rare array<struct<w:binary,n:bigint>>")
    scored = materialize(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")
    asked = scored.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.w").alias("word"), F.col("r.n").alias("times"))
    met = asked.join(counts, "word").groupBy("rid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("add"))
    every = float(vocabulary.total + vocabulary.distinct + 1)
    more, add = F.coalesce("more", F.lit(0)), F.coalesce("add", F.lit(0.0))
    return scored.drop("rare").join(met, "rid", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + add - F.col("n_tokens") * F.log10(F.lit(every))).alias("base_score"), (F.col("model") + add).alias("score"),
    )
