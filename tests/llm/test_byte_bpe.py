"""Byte-level BPE against the tokenizer library, and on odd and empty input."""

import base64
import collections
import hashlib
import pickle
import random

import public_tokenizers
import pytest
import tiktoken

from permrisk.llm import byte_bpe
from permrisk.llm.queries import op13_byte_bpe


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load()


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    for n in (1, 2, 7, 1000, 5000):
        keys = [f"key {i}".encode() for i in range(n)]
        assert sorted(byte_bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        byte_bpe.PerfectHash([b"a", b"a"])


def test_every_token_resolves_in_tier_one(bpe):
    assert sorted(bpe.ids) == list(range(50256))
    assert all(bpe.tokens[s] == t for t, s in zip(bpe.ranks, bpe.hash.slots(list(bpe.ranks)).tolist(), strict=True))


def test_same_ids_as_the_library(bpe, library):
    rng = random.Random(13)
    texts = ["", " ", "  a", "a" * 20_000, "ab" * 9_000, "<|endoftext|>", "it's\u2003we'LL 12345 ---\n\n  x\r\n", "\x1c\x85\u200b\ufeff", "\U0001f469\u200d\U0001f680" * 50]
    texts += ["".join(rng.choice("abcde '\u00e9\u4e2d1\n\t.!\U0001f642") for _ in range(rng.randint(0, 60))) for _ in range(2_000)]
    texts += ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 64)]
    got = bpe.encode_batch(texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [bpe.decode(ids) for ids in got] == [t.encode() for t in texts]


def test_memo_may_be_forgotten(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_PIECES", 3)
    small = pickle.loads(pickle.dumps(bpe))
    texts = ["one two three four five sixish sevenish", "two threeish nineish two one", "sixish tenish one"] * 3
    assert [small.encode(t) for t in texts] == [library.encode_ordinary(t) for t in texts]


def test_query(spark, sf, docs, odd, library):
    for df, got in ((docs, op13_byte_bpe(spark, sf)), (odd, byte_bpe.digests(odd))):
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            ids = library.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), True] += 1
        assert collections.Counter(map(tuple, got.collect())) == want


def test_encode_then_decode(spark, odd):
    ids = byte_bpe.encode(odd)
    assert ids.columns == ["doc_id", "ids"]
    back = collections.Counter((r.doc_id, bytes(r.decoded).decode()) for r in byte_bpe.decode(ids).collect())
    assert back == collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).first().decoded == b""


def test_empty_table(odd):
    none = odd.limit(0)
    assert byte_bpe.digests(none).collect() == [] and byte_bpe.decode(byte_bpe.encode(none)).collect() == []


def test_other_vocabulary(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    bpe = byte_bpe.load(str(path), r"[^x]+|x")
    assert bpe.encode("abcxbcab") == [258, 120, 257, 256]
    with pytest.raises(ValueError):
        byte_bpe.ByteBPE({b"a": 0}, "a")
