"""Vector codes against a plain product quantiser in Python integers, and on odd and empty input."""

import collections
import hashlib
import math

import numpy as np
import pytest

from permrisk.llm import vector_codes
from permrisk.llm.common import table
from permrisk.llm.queries import op12_vector_codes


def plainly(rows):
    """{(id, code, error, label_error): times}, digest; by every distance, in Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = len(kept[0][1]) // 4
    parts = [[[math.floor(1024 * x) for x in v[p * cut : (p + 1) * cut]] for _, v, _ in kept] for p in range(4)]
    books = [[list(x) for x in own[:256]] for own in parts]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p])) for x in parts[p]] for p in range(4)]

    for _ in range(4):
        for p, found in enumerate(assign()):
            for k in range(len(books[p])):
                own = [x for x, (_, c) in zip(parts[p], found, strict=True) if c == k]
                if own:
                    books[p][k] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    found = assign()
    errors = [sum(found[p][n][0] for p in range(4)) for n in range(len(kept))]
    by_label = collections.Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{found[p][n][1]:02x}" for p in range(4)), errors[n], by_label[label], sha) for n, (i, _, label) in enumerate(kept))


def vectors(rng, n, dim, spread):
    centres = rng.normal(size=(6, dim))
    return [[float(np.float32(x)) for x in centres[rng.integers(6)] + spread * rng.normal(size=dim)] for _ in range(n)]


SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize(("n", "dim", "spread"), [(420, 8, 0.05), (300, 4, 1.0), (40, 16, 0.3), (1, 4, 1.0)])
def test_same_as_plain_k_means(spark, n, dim, spread):
    rng = np.random.default_rng(n)
    rows = [(int(i), v, None if k % 7 == 0 else int(rng.integers(5))) for k, (i, v) in enumerate(zip(rng.permutation(3 * n)[:n], vectors(rng, n, dim, spread), strict=True))]
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == plainly(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert collections.Counter(map(tuple, op12_vector_codes(spark, sf).collect())) == plainly(rows)


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0, 0.0, 3.0, -1.0, 0.125, 2.0]
    rows = [(1, v, 1), (1, v, 1), (1, v[::-1], 2), (None, v, None), (None, [x * 3 for x in v], 3), (2, None, 1), (3, [], 1), (4, [*v[:7], None], 1), (5, [*v[:7], float("nan")], 1), (6, [*v[:7], float("-inf")], 1),
            (7, [0.0] * 8, 9), (8, [-0.0] * 8, 9), *[(20 + i, [x + i % 3 for x in v], i % 2) for i in range(300)]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS v", "1 AS codes", "2 AS kind", "3 AS own", "4 AS n", "5 AS error", "6 AS code", "7 AS part", "8 AS label_error")
    assert collections.Counter(map(tuple, vector_codes.compress(df).collect())) == plainly(rows)
    assert vector_codes.compress(df.where("vec_id in (2, 3, 4)")).collect() == []
    assert vector_codes.compress(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for bad in ([1.0] * 6, [1.0] * 12, [1e9] * 8):
        with pytest.raises(Exception, match="vectors of|too large"):
            vector_codes.compress(df.select("vec_id", "embedding", "label").union(spark.createDataFrame([(-1, bad, 1)], SCHEMA))).collect()


def test_search_from_any_start():
    rng = np.random.default_rng(5)
    for spread in (2, 40, 4000):
        book = vector_codes.Codebook.of(rng.integers(-spread, spread, size=(200, 6)))
        x = np.concatenate([rng.integers(-spread, spread, size=(500, 6)), book.entries])
        apart = vector_codes.squared(x, book.entries)
        for start in (np.zeros(len(x), dtype=np.int64), rng.integers(0, 200, size=len(x))):
            code, least = book.nearest(x, start)
            assert np.array_equal(code, apart.argmin(axis=1)) and np.array_equal(least, apart.min(axis=1))


def test_train_encode_decode(spark, sf):
    df = table(spark, sf, "embeddings")
    books = vector_codes.train(df)
    coded = vector_codes.encode(df, books)
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == sorted((r.vec_id, r.code, r.error) for r in vector_codes.compress(df).collect())
    back = {r.vec_id: r.vector for r in vector_codes.decode(coded, books).collect()}
    errors = {r.vec_id: r.error for r in coded.collect()}
    for r in df.where("embedding is not null").collect():
        if r.vec_id in back:
            assert sum((math.floor(1024 * x) - 1024 * y) ** 2 for x, y in zip(r.embedding, back[r.vec_id], strict=True)) == errors[r.vec_id]
