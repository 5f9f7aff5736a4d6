"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (dummy prefix,
blank to U+2581), the pieces with their weights, and the byte fallback, which
spells a character no piece covers as its UTF-8 bytes. Composing them with an
input gives a lattice over its positions; encoding is the shortest path in the
tropical semiring. For a unigram model an arc weighs minus the piece's score.
A BPE model is not additive: there the pieces are composed with an adjacency
acceptor that lets piece b follow piece a exactly if merging their joint
spelling gives a and b again. One path of finite weight is left and it is the
merge result, so each position needs one state.

No piece crosses from a non-blank to a blank or covers a character outside the
alphabet, so the lattice falls apart at these places; parts are composed one by
one and short memories keep recent ones. Whole texts are encoded.

A null text encodes like an empty one: no ids, decoded to the empty text.
Models with a character map, user-defined symbols or no byte fallback are
refused.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from permrisk.llm.common import slices

BLANK = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MEMORY = 600_000
UNIGRAM, BPE = 1, 2
NORMAL, CONTROL, UNKNOWN, USER, BYTE = 1, 3, 2, 4, 6
INFINITE = float("inf")
#: Longer parts are composed one by one.
LONG = 48
HASH, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BATCH_CHARS = 1 << 21


@dataclass
class Transducer:
    kind: int
    pieces: list[tuple[str, float, int]]
    dummy_prefix: bool
    squeeze: bool
    ids: dict[str, int] = field(default_factory=dict)
    spelled: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        self.byte_id = [0] * 256
        for i, (piece, _, kind) in enumerate(self.pieces):
            if kind == NORMAL:
                self.ids[piece] = i
                self.spelled.append(piece.encode())
            elif kind == BYTE:
                self.byte_id[int(piece[1:-1], 16)] = i
                self.spelled.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.spelled.append(b"")
        self.longest = max(map(len, self.ids), default=1)
        alphabet = set("".join(self.ids)) - {BLANK}
        if alphabet - set(self.ids):
            raise ValueError("characters that only occur inside longer pieces")
        crossing = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        inside = "".join(re.escape(c) for c in sorted(alphabet)) or "\\x00"
        self.parts = re.compile(f"[{BLANK}{inside}]+|." if crossing else f"{BLANK}+[{inside}]*|[{inside}]+|.", re.S)
        self.whole_words = not crossing and "\n" not in alphabet and "\x01" not in alphabet
        self.memory: dict[str, bytes] = {}
        self.beside: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self._compile()

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.dummy_prefix else "") + text.replace(" ", BLANK)

    def _merged(self, spelling: str) -> list[str]:
        """Reference spelling of the adjacency acceptor: join the best-scored neighbours, leftmost first."""
        parts, ids, pieces = list(spelling), self.ids, self.pieces
        while len(parts) > 1:
            best, at = -INFINITE, -1
            for i in range(len(parts) - 1):
                n = ids.get(parts[i] + parts[i + 1])
                if n is not None and pieces[n][1] > best:
                    best, at = pieces[n][1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spines(self, piece: int) -> tuple[list, list] | None:
        """Spellings and scores along the left and the right edge of a piece's merge tree, from the character up.

        None if the piece does not merge to itself, or if a part scores less than the whole, so that scores
        alone do not tell the order of merges.
        """
        if piece not in self.edges:
            tree = [(c, [(c, INFINITE)], [(c, INFINITE)]) for c in self.pieces[piece][0]]
            ordered = True
            while len(tree) > 1:
                scores = [self.pieces[n][1] if (n := self.ids.get(x[0] + y[0])) is not None else -INFINITE for x, y in zip(tree, tree[1:], strict=False)]
                at = max(range(len(scores)), key=lambda i: (scores[i], -i))
                if scores[at] == -INFINITE:
                    break
                x, y = tree[at], tree[at + 1]
                node = (x[0] + y[0], scores[at])
                ordered &= x[1][-1][1] >= scores[at] <= y[1][-1][1]
                tree[at : at + 2] = [(node[0], [*x[1], node], [*y[2], node])]
            self.edges[piece] = (tree[0][1], tree[0][2]) if len(tree) == 1 and ordered else None
        return self.edges[piece]

    def _beside(self, a: int, b: int) -> bool:
        one, two = self._spines(a), self._spines(b)
        if one is None or two is None:
            return self._merged(self.pieces[a][0] + self.pieces[b][0]) == [self.pieces[a][0], self.pieces[b][0]]
        right, left, i, j = one[1], two[0], 0, 0
        while True:
            n = self.ids.get(right[i][0] + left[j][0])
            across = -INFINITE if n is None else self.pieces[n][1]
            up = right[i + 1][1] if i + 1 < len(right) else -INFINITE
            down = left[j + 1][1] if j + 1 < len(left) else -INFINITE
            if n is not None and across > up and across >= down:
                return False
            if up == down == -INFINITE:
                return True
            if up >= down:
                i += 1
            else:
                j += 1

    def _may_follow(self, a: int, b: int) -> bool:
        if self.kind != BPE:
            return True
        if a < 0:
            return len(self._merged(self.pieces[b][0])) == 1
        return self._beside(a, b)

    def shortest_path(self, part: str) -> tuple[int, ...]:
        """Ids along the least path through the lattice of a part that byte fallback does not touch."""
        n = len(part)
        cost, last, back = [INFINITE] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        ids, pieces, additive, known, longest = self.ids, self.pieces, self.kind != BPE, self.beside, self.longest
        if len(known) >= 4 * MEMORY:
            known.clear()
        live = [0]
        for end in range(1, n + 1):
            for start in live:
                piece = ids.get(part[start:end])
                if piece is None or end - start > longest:
                    continue
                key = last[start] << 24 | piece
                allowed = known.get(key)
                if allowed is None:
                    allowed = known[key] = self._may_follow(last[start], piece)
                if not allowed:
                    continue
                weight = cost[start] - (pieces[piece][1] if additive else 0.0)
                if weight < cost[end]:
                    cost[end], last[end], back[end] = weight, piece, start
                    if not additive:
                        break  # the only path of finite weight
            if cost[end] < INFINITE:
                live.append(end)
                if len(live) > longest:
                    live = [x for x in live if x > end - longest]
        if cost[n] == INFINITE:
            return self._fallback(part)
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return tuple(reversed(out))

    def _fallback(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        for c in part:
            out += [self.ids[c]] if c in self.ids else [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def _compile(self) -> None:
        """Hashed spellings of the pieces, and a direct-mapped memory of the adjacency acceptor."""
        rows = sorted((self._hash(p), i) for p, i in self.ids.items())
        self.keys = np.array([h for h, _ in rows], dtype=np.uint64)
        self.of_key = np.array([i for _, i in rows], dtype=np.int64)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.pair_keys = np.full(1 << 22, -1, dtype=np.int64)
        self.pair_allowed = np.zeros(1 << 22, dtype=bool)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * HASH + ord(c) + 1) % (1 << 64)
        return h * MIX % (1 << 64)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 24 | b
        slots = (keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) >> 42) & (1 << 22) - 1
        for i in np.flatnonzero(self.pair_keys[slots] != keys):
            if self.pair_keys[slots[i]] != keys[i]:
                self.pair_keys[slots[i]], self.pair_allowed[slots[i]] = keys[i], self._may_follow(int(a[i]), int(b[i]))
        allowed = self.pair_allowed[slots]
        for i in np.flatnonzero(self.pair_keys[slots] != keys):  # two pairs of this call in one slot
            allowed[i] = self._may_follow(int(a[i]), int(b[i]))
        return allowed

    def shortest_paths(self, parts: list[str]) -> list[tuple[int, ...]]:
        """``shortest_path`` of parts of one length, all at once; for a BPE model."""
        n, count = len(parts[0]), len(parts)
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(count, n).astype(np.uint64) + np.uint64(1)
        arcs, h = [], np.zeros((count, n), dtype=np.uint64)
        for size in range(1, min(self.longest, n) + 1):
            h = h[:, : n - size + 1] * np.uint64(HASH) + chars[:, size - 1 :]
            mixed = h * np.uint64(MIX)
            piece = np.full(mixed.shape, -1, dtype=np.int64)
            at = np.nonzero(self.maybe[(mixed >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, mixed[at]), len(self.keys) - 1)
            piece[at] = np.where(self.keys[place] == mixed[at], self.of_key[place], -1)
            arcs.append(piece)
        last, back = np.full((count, n + 1), -1, dtype=np.int64), np.zeros((count, n + 1), dtype=np.int64)
        reached = np.zeros((count, n + 1), dtype=bool)
        reached[:, 0] = True
        for end in range(1, n + 1):
            for size in range(min(self.longest, end), 0, -1):
                start = end - size
                piece = arcs[size - 1][:, start]
                rows = np.flatnonzero((piece >= 0) & reached[:, start] & ~reached[:, end])
                if len(rows):
                    rows = rows[self._pairs(last[rows, start], piece[rows])]
                    last[rows, end], back[rows, end], reached[rows, end] = piece[rows], start, True
        out = []
        for part, done, ids, came in zip(parts, reached[:, n].tolist(), last.tolist(), back.tolist(), strict=True):
            if not done:
                out.append(self._fallback(part))
                continue
            path, at = [], n
            while at:
                path.append(ids[at])
                at = came[at]
            out.append(tuple(path[::-1]))
        return out

    def _split(self, text: str) -> list[str]:
        """Parts of the normalised text. Blanks start a part and line ends are parts of their own; runs of blanks stay together."""
        text = self.normalise(text)
        if not self.whole_words or BLANK * 2 in text or "\x01" in text:
            return self.parts.findall(text)
        text = text.replace(BLANK, "\x01" + BLANK)
        return ("\x01\n\x01".join(text.split("\n")) if "\n" in text else text).split("\x01")

    def _remember(self, parts: set[str]) -> None:
        memory, fresh = self.memory, {}
        pieces = {p: self.parts.findall(p) for p in parts}
        known: dict[str, tuple[int, ...]] = {}
        for part in {q for found in pieces.values() for q in found}:
            fresh.setdefault(len(part), []).append(part)
        for n, same in fresh.items():
            if self.kind == BPE and n <= LONG:
                for lo in range(0, len(same), 1 << 14):
                    some = same[lo : lo + (1 << 14)]
                    known.update(zip(some, self.shortest_paths(some), strict=True))
            else:
                known.update((p, self.shortest_path(p)) for p in same)
        for part, found in pieces.items():
            memory[part] = array("i", [i for q in found for i in known[q]]).tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self._split(t or "") for t in texts]
        if len(self.memory) >= MEMORY:
            self.memory.clear()
        if fresh := set(chain.from_iterable(split)).difference(self.memory):
            self._remember(fresh)
        look = self.memory.__getitem__
        return [np.frombuffer(b"".join(map(look, parts)), dtype=np.int32) for parts in split]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def load(model: str | bytes = MODEL_FILE) -> Transducer:
    """The machine of a model file, or of what such a file holds."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model if isinstance(model, bytes) else _held(model))
    kinds = {p.type for p in proto.pieces}
    if proto.normalizer_spec.precompiled_charsmap or USER in kinds or BYTE not in kinds or proto.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with byte fallback, without character map and user-defined symbols")
    return Transducer(
        proto.trainer_spec.model_type, [(p.piece, p.score, p.type) for p in proto.pieces],
        proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces,
    )


def _held(model_file: str) -> bytes:
    with open(model_file, "rb") as f:
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model_file: str = MODEL_FILE) -> DataFrame:
    """(id, ids, n_ids, decoded_sha256, round_trip): the ids of each whole text, and what decoding them gives back.

    The model file (a megabyte or so) is read on the driver and goes to the tasks by broadcast. A null
    text is an empty one, a null id stays null, and a repeated row gives a repeated result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(_held(model_file))

    def run(batches):
        machine = load(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], BATCH_CHARS):
                part, flat, sizes, sha, same = batch.slice(lo, hi - lo), [], [], [], []
                for text, ids in zip(texts[lo:hi], machine.encode_batch(texts[lo:hi]), strict=True):
                    back = machine.decode(ids.tolist())
                    flat.append(ids)
                    sizes.append(len(ids))
                    sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    same.append(back == (text or ""))
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                values = pa.array(np.concatenate(flat) if flat else np.array([], np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, values), pa.array(sizes, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                    names=[id_col, "ids", "n_ids", "decoded_sha256", "round_trip"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_ids bigint, decoded_sha256 string, round_trip boolean")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", *, model_file: str = MODEL_FILE) -> DataFrame:
    """(id, text) of encoded rows; a null list of ids decodes to the empty text."""
    kind = rows.schema[id_col].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(_held(model_file))

    def run(batches):
        machine = load(shared.value)
        for batch in batches:
            texts = [machine.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
