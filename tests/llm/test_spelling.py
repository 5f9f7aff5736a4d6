"""Spelling variants against all pairs of words, and on odd and empty input."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from permrisk.llm import spelling
from permrisk.llm.queries import op11_spelling_variants


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]


def counted(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def plainly(rows):
    n = counted(rows)
    by = {w: sorted((-n[v], v) for v in n if near(w, v)) for w in n}
    form = {w: by[w][0][1] if by[w] and -by[w][0][0] >= 10 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_mask_flips_two_bits_at_most(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(7, 12)))
        k = rng.randrange(len(a))
        pairs.append((a, rng.choice((a[:k] + a[k + 1 :], a[:k] + rng.choice(letters) + a[k:], a[:k] + rng.choice(letters) + a[k + 1 :]))))
    got = spark.createDataFrame(pairs, "a string, b string").select(F.bit_count(spelling.parity_mask(F.col("a")).bitwiseXOR(spelling.parity_mask(F.col("b")))).alias("x")).collect()
    assert all(r.x <= 2 for r in got) and any(r.x == 2 for r in got)


def test_all_near_pairs_once(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde\u00e9") for _ in range(rng.randint(7, 10))) for _ in range(60)]
    words = set(base)
    for w in base:
        for _ in range(6):
            k = rng.randrange(len(w))
            words |= {w[:k] + w[k + 1 :], w[:k] + rng.choice("abz\u00d7") + w[k:], w[:k] + rng.choice("abz\u00ff") + w[k + 1 :]}
    words = {w for w in words if len(w) >= 7}
    got = spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")).collect()
    assert collections.Counter(frozenset((r.a, r.b)) for r in got) == collections.Counter({frozenset((a, b)) for a in words for b in words if near(a, b)})


def test_query(spark, sf, docs):
    got = op11_spelling_variants(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == plainly(rows_of(docs))
    assert any(r[1] for r in got)


def test_chains_and_ties(spark):
    counts = {"abcdefgh": 2, "abcdefgx": 20, "abcdefyx": 200, "abcdezyx": 2000, "qrstuvwx": 2, "qrstuvwa": 25, "qrstuvwb": 25, "lmnopqrs": 2, "lmnopqrt": 19, "\u00e0\u00e9\u00ffmnopq": 3, "\u00e0\u00e9\u00ffmnopqr": 40}
    df = spark.createDataFrame([(1000 + k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())], "doc_id bigint, text string")
    got = {r.word: r for r in spelling.variants(df).collect()}
    assert {tuple(r) for r in got.values()} == plainly(rows_of(df))
    if counts == counted(rows_of(df)):  # no run of these ids has a checksum that calls for a deletion
        assert got["abcdefgh"].root == "abcdezyx" and got["qrstuvwx"].form == "qrstuvwa" and got["lmnopqrs"].form is None


@pytest.mark.parametrize("times", [1, 2])
def test_odd_rows(spark, odd, times):
    long = "Stra\u00dfenbahnen " + "a" * 30_000 + "b " + "a" * 30_000 + "c " + "WORDS\u00c9S words\u00c9s"
    more = spark.createDataFrame([(50, long), (51, long), (None, long), (52, "underscore_joined1separate \u0100bcdefghi \ud83d\ude42xyzxyzxy")], "doc_id bigint, text string")
    df = odd.select("doc_id", "text").union(more)
    for _ in range(times - 1):
        df = df.union(df)
    named = df.selectExpr("*", "'x' AS word", "1 AS n", "2 AS mask", "3 AS run", "4 AS id", "5 AS form", "6 AS band")
    got = [tuple(r) for r in spelling.variants(named).collect()]
    assert len(got) == len(set(got)) and set(got) == plainly(rows_of(df))


def test_empty_table(odd):
    assert spelling.variants(odd.limit(0)).collect() == []
