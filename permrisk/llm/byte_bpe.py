"""Byte-level BPE by two-tier lookup.

A text is split by the pattern of the rank file. Tier one resolves whole
pre-tokens: a minimal perfect hash has one slot for each token of the
vocabulary, so a batch of pre-tokens is looked up by arithmetic on arrays and
one comparison of bytes each. Tier two takes the misses: bytes in a linked
list, and a heap of neighbouring pairs by rank, then place. The vocabulary is read on the driver and goes to the
tasks by broadcast; its size is that of the rank file, whatever the corpus.

Results for odd input: a null or empty text has no ids; a null id stays null; a
repeated row gives a repeated result; texts and runs of any length are taken
whole; other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from permrisk.llm.common import slices

BATCH_CHARS = 1 << 21
#: Pre-tokens and characters of one generation of the memo; a full one becomes the older one, and what is not met again is forgotten with it.
MEMO_PIECES, MEMO_CHARS = 1 << 18, 1 << 24
_STEP, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_M1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_M2)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A place of its own in 0..n-1 for each of n byte strings: a displacement for each bucket of about four."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.size, self.buckets = n, n // 4 + 1
        h = self.hashed(keys)
        if len(np.unique(h)) != n:
            raise ValueError("keys that repeat or share a 64-bit hash")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        shifts, free = np.zeros(self.buckets, dtype=np.uint64), np.ones(n, dtype=bool)
        for b in np.argsort(-np.diff(starts), kind="stable"):
            own = h[order[starts[b] : starts[b + 1]]]
            base = np.uint64(1)
            while len(own):
                tried = base + np.arange(512, dtype=np.uint64)
                slots = _mixed(own[:, None] + tried[None, :] * np.uint64(_STEP)) % np.uint64(n)
                fits = free[slots].all(axis=0)
                if len(own) > 1:
                    fits &= (np.diff(np.sort(slots, axis=0), axis=0) > 0).all(axis=0)
                if fits.any():
                    at = int(fits.argmax())
                    shifts[b] = tried[at]
                    free[slots[:, at]] = False
                    break
                base += np.uint64(512)
        self.shifts = shifts

    @staticmethod
    def hashed(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The place each key would have; whether it is there, its owner must compare."""
        h = self.hashed(keys)
        shift = self.shifts[(h % np.uint64(self.buckets)).astype(np.int64)]
        return (_mixed(h + shift * np.uint64(_STEP)) % np.uint64(self.size)).astype(np.int64)


class ByteBPE:
    """Encoder and decoder for ranks {token: id} and a pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every byte")
        self.pattern = pattern
        self.hash = PerfectHash(list(ranks))
        self.ranks = ranks
        self.spelled = {i: t for t, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.spelled}
        at = self.hash.slots(list(ranks)).tolist()
        self.tokens, self.ids = [b""] * len(ranks), [0] * len(ranks)
        for slot, (token, i) in zip(at, ranks.items(), strict=True):
            self.tokens[slot], self.ids[slot] = token, i
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.memo, self.older, self.memo_chars = {}, {}, 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo", "older", "memo_chars")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary: the pair of least rank first, of equal ranks the leftmost."""
        n, rank = len(piece), self.ranks.get
        # a part begins at i and stops at stop[i], 0 once it is absorbed; stop[n] closes the list
        stop, before = [*range(1, n + 1), n], [*range(-1, n)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            right = stop[i]
            # parts that were absorbed or grew since do not meet at this end
            if not right or right >= n or stop[right] != end:
                continue
            stop[i], stop[right] = end, 0
            before[end] = i
            if end < n and (r := rank(piece[i : stop[end]])) is not None:
                heapq.heappush(heap, (r, i, stop[end]))
            left = before[i]
            if left >= 0 and (r := rank(piece[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : stop[i]]])
            i = stop[i]
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of new pre-tokens into the memo."""
        if len(self.memo) > MEMO_PIECES or self.memo_chars > MEMO_CHARS:
            self.memo, self.older, self.memo_chars = {}, self.memo, 0
        new = []
        for piece in pieces:
            if piece not in self.memo:
                if (ids := self.older.get(piece)) is None:
                    new.append(piece)
                else:
                    self.memo[piece] = ids
                self.memo_chars += len(piece)
        if not new:
            return
        keys = [p.encode("utf-8", "surrogatepass") for p in new]
        for piece, key, at in zip(new, keys, self.hash.slots(keys).tolist(), strict=True):
            self.memo[piece] = (self.ids[at],) if self.tokens[at] == key else tuple(self.merge(key))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t or "") for t in texts]
        self.learn(set(chain.from_iterable(split)))
        return [list(chain.from_iterable(map(self.memo.__getitem__, pieces))) for pieces in split]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


def load(rank_file: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The encoder of a rank file (base64 token, blank, id in each line), by default the public 50k vocabulary."""
    import public_tokenizers

    ranks = {}
    with open(rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        for line in lines:
            if line.strip():
                token, i = line.split()
                ranks[base64.b64decode(token)] = int(i)
    return ByteBPE(ranks, pattern or public_tokenizers.PATTERN)


def _texts(docs: DataFrame, id_col: str, text_col: str, bpe: ByteBPE | None, results, names: dict[str, str]) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(bpe or load())

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], BATCH_CHARS):
                columns = results(shared.value, texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=[id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} {t}" for n, t in names.items()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bpe: ByteBPE | None = None) -> DataFrame:
    """(id, ids): the ids of each whole text."""

    def results(bpe: ByteBPE, texts):
        return [pa.array(bpe.encode_batch(texts), pa.list_(pa.int32()))]

    return _texts(docs, id_col, text_col, bpe, results, {"ids": "array<int>"})


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, bpe: ByteBPE | None = None) -> DataFrame:
    """(id, decoded): the bytes that the ids spell; a null list spells none."""
    kind = rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(bpe or load())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shared.value.decode(i or []) for i in part.column(1).to_pylist()], pa.binary())], names=[id_col, "decoded"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bpe: ByteBPE | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, round_trip): what ``encode`` and ``decode`` give, as digests."""

    def results(bpe: ByteBPE, texts):
        rows = []
        for text, ids in zip(texts, bpe.encode_batch(texts), strict=True):
            back = bpe.decode(ids)
            rows.append((
                len(ids), hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest(),
                hashlib.sha256(back).hexdigest(), back == (text or "").encode("utf-8", "surrogatepass"),
            ))
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))]

    return _texts(docs, id_col, text_col, bpe, results, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "round_trip": "boolean"})
