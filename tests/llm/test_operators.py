"""Each operator against brute force, and on odd and empty input."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from permrisk.llm import components, decontaminate, html_text, language_id, lattice, maxent_lm, pii, sentencepiece_fst, simhash, suffix_dedup, toxicity
from permrisk.llm.common import table


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# 1
EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def forms(t):
    n = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(n(m.group())) <= 19 and pii.luhn(n(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(n(m.group())) <= 15]


def test_pii_forms_on_random_strings():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("01..@@a-+ (é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == forms(t)


def test_pii_query(spark, docs, odd):
    for df in (docs, odd):
        got = collections.Counter((r.doc_id, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.find(df).collect())
        want = collections.Counter()
        for i, t in pairs(df):
            s = forms(t or "")
            want[i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest(), len(s)] += 1
        assert got == want


def test_pii_learns_contexts(spark):
    rows = [(i, f"filler text {i} hotline +1 555 010 {1000 + i} thanks") for i in range(12)] + [(99, "please use hotline 555-0199-88 today"), (100, "total of 555-0199-88 units")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert got[99].n_added == 1 and got[99].spans.startswith("phone:19:") and got[99].n_phone == 0
    assert got[100].n_added == 0
    assert got[3].n_added == 0 and got[3].n_phone == 1
    assert {r.doc_id: r.text for r in pii.redact(df).collect()}[99] == "please use hotline [PHONE] today"


def test_pii_keeps_rare_contexts_of_a_large_corpus(spark, monkeypatch):
    rows = [(i, f"filler text {i} hotline +1 555 010 {1000 + i} thanks") for i in range(3)] + [(99, "please use hotline 555-0199-88 today")]
    many = " ".join(f"mail a{i}@example.org and" for i in range(1000))
    df = spark.createDataFrame(rows + [(1000 + i, many) for i in range(310)], "doc_id bigint, text string")
    results = []
    for block in (pii.BLOCK, 3):
        monkeypatch.setattr(pii, "BLOCK", block)
        results.append(sorted(map(tuple, pii.find(df).collect())))
    assert {r.doc_id: r.text for r in pii.redact(df).where("doc_id < 1000").collect()}[99] == "please use hotline [PHONE] today"
    assert results[0] == results[1]
    assert {r[0]: r[-1] for r in results[0]}[99] == 1


CUES = {  # cues of each kind: beside seeds, and beside values that only other patterns discover
    "phone": ("hotline {}", "{} ringable", "dial at once {}", "<< {} >>"), "card": ("charge {}", "{} expiring", "paid with my {}", "visa {} today"),
    "ip": ("host {}", "{} pinged", "server named alpha {}", "via {} hop"), "email": ("mailto {}", "{} wrote", "reply to user {}", "from {} sent"),
}


def identifiers(kind, rng):
    """(an exact form, a compatible form that the exact one misses)."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "phone":
        return f"+1 555 {d(3)} {d(4)}", f"555-{d(4)}-{d(2)}"
    if kind == "card":
        body = d(15)
        good = next(body + c for c in "0123456789" if pii.luhn(body + c))
        return good, next(body + c for c in "0123456789" if not pii.luhn(body + c))
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4)), ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))
    name = "".join(rng.choice("abcdefgh") for _ in range(6))
    return f"{name}@example.org", f"{name}@intranet"


def test_pii_discovers_what_the_cues_tell(spark):
    rng = random.Random(21)
    filler = lambda: " ".join("".join(rng.choice("klmnopqrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 9)))
    rows, planted, decoys = [], {}, set()
    for kind, cues in CUES.items():
        for cue in cues[:3]:
            for _ in range(12):
                rows.append(f"{filler()} {cue.format(identifiers(kind, rng)[0])} {filler()}")
        for n in range(40):
            hidden = identifiers(kind, rng)[1]
            planted[hidden] = kind
            rows.append(f"{filler()} {cues[n % 3].format(hidden)} {filler()}")
            if n < 12:  # discovered above, and again in a place that no seed stands in
                rows.append(f"{filler()} {cues[3].format(hidden)} {filler()}")
        for _ in range(30):  # reachable only by the place that discovered values teach
            hidden = identifiers(kind, rng)[1]
            planted[hidden] = kind
            rows.append(f"{filler()} {cues[3].format(hidden)} {filler()}")
        for _ in range(40):
            other = identifiers(kind, rng)[1]
            decoys.add(other)
            rows.append(f"{filler()} total of {other} {filler()}")
    rows += [f"{filler()} total of {filler()}" for _ in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = pii.find(df).collect()
    found = {}
    for r in got:
        base = forms(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        for k, a, b in (x.split(":") for x in r.spans.split(",") if x):
            if (k, int(a), int(b)) not in base:
                found.setdefault(rows[r.doc_id][int(a) : int(b)], set()).add(k)
    right = sum(v in planted and planted[v] in kinds for v, kinds in found.items())
    assert right >= 0.9 * len(planted) and right >= 0.9 * len(found), (right, len(found), len(planted))
    assert len(decoys & set(found)) <= 0.05 * len(decoys)
    last = {rows.index(x): x for x in rows if "<< " in x}
    assert sum(r.n_added > 0 for r in got if r.doc_id in last) >= 0.9 * len(last)
    one = next(pii.patterns(df, rounds=1))
    more = next(pii.patterns(df))
    assert "b << >>" not in one and "b << >>" in more


def test_pii_counts_of_patterns_by_brute_force(docs):
    texts = [t[:3000] for _, t in pairs(docs)[:60] if t] + ["a", "", "a b", "a: b=c d", "the 12 the 13 the", "x" * 100 + " y " + "x" * 100]
    want = collections.Counter()
    for t in texts:
        w = [pii._key(x) for x in pii._TOKEN.findall(t)]
        for p in range(len(w)):
            if p:
                want[f"l {w[p - 1]}"] += 1
            if p > 1:
                want.update([f"m {w[p - 2]} {w[p - 1]}", f"g {w[p - 2]}"])
            if p + 1 < len(w):
                want.update([f"r {w[p + 1]}"] + [f"b {w[p - 1]} {w[p + 1]}"] * (p > 0))
    import pyarrow as pa

    (got,) = pii._counted([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])], sorted(want))
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist())) == want


def test_pii_time_is_linear_in_the_spans():
    import time

    took = []
    for n in (2_000, 16_000):
        text = " ".join(f"mail a{i}@example.org or 555-0{i:05d}-88 and +1 555 010 {i:05d}." for i in range(n))
        began = time.perf_counter()
        _, every = pii.all_spans(text, {"l mail": ("email",), "l or": ("phone",)})
        took.append(time.perf_counter() - began)
        assert len(every) == 3 * n
    assert took[1] < 24 * took[0]
    began = time.perf_counter()
    pii.all_spans("1 " * 200_000 + "a", {"l 0": ("card",)})
    pii.all_spans("1" * 200_000 + "a " + "@" * 100_000 + ":" * 100_000, {"l 0": ("card",)})
    assert time.perf_counter() - began < 20


# 2
def distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        cur = [i + 1]
        for j, b in enumerate(t):
            cur.append(min(prev[j + 1] + 1, cur[j] + 1, prev[j] + (a != b)))
        prev = cur
    return min(prev)


def test_myers_distance():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert decontaminate.myers(p, t) == distance(p, t)


def test_leaks_are_those_within_the_budget(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 30)))) for i in range(12)] + [(50, ""), (51, None), (52, "... !!")]
    rows = []
    for n in range(60):
        text = " ".join(word() for _ in range(40))
        if n % 2:
            item = list(items[n % 12][1])
            for _ in range(rng.randint(0, 14)):
                item[rng.randrange(len(item))] = rng.choice("abcxyz ")
            text = f"{text} {''.join(item).upper() if n % 4 == 1 else ''.join(item)} {text[:40]}"
        rows.append((n, text))
    rows += [(None, None), (70, "")]
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=200).collect()}
    want = {}
    for n, t in rows:
        for i, raw in items:
            item = decontaminate.normalise(raw)
            if item and (d := distance(item, decontaminate.normalise(t))) <= int(decontaminate.ERROR_RATE * len(item)):
                want[n, i] = d
    assert got == want and len(want) > 5


def test_clean_keeps_columns_and_clean_rows(spark, odd):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again")], "item_id bigint, text string")
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (i for i, _ in pairs(odd) if i not in (1, 2))))
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


# 3
def plain_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    sh = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_anchors_meet_for_every_pair_within_two_bits():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 400).astype(np.uint64)
    y = x.copy()
    for k in range(400):
        for b in rng.choice(64, k % 3, replace=False):
            y[k] ^= np.uint64(1) << np.uint64(b)
    i, where, home = simhash.anchors(x)
    homes = dict(zip(i[home].tolist(), where[home].tolist()))
    assert len(homes) == 400 and home.sum() == 400
    j, there, _ = simhash.anchors(y)
    reach = collections.defaultdict(set)
    for a, b in zip(j.tolist(), there.tolist()):
        reach[a].add(b)
    assert all(homes[k] in reach[k] for k in range(400))


def test_simhash_query(spark, docs, odd):
    for df in (docs, odd):
        rows = pairs(df)
        f = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
        links = [(a, int(b)) for a in range(len(f)) for b in np.flatnonzero(np.bitwise_count(f ^ f[a]) <= 2) if b > a]
        root = roots(len(f), links)
        low = {}
        for (i, _), r in zip(rows, root):
            if i is not None:
                low[r] = min(low.get(r, i), i)
        want = collections.Counter((i, f"{int(x):016x}", low.get(r)) for (i, _), x, r in zip(rows, f, root))
        assert collections.Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
        kept = simhash.deduplicate(df)
        assert kept.columns == df.columns and kept.count() == len(set(root))


def test_hot_anchors_are_split_without_loss(spark, monkeypatch):
    base = np.uint64(0x123456789ABCDEF0)
    fps = sorted({int(base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b))) for a in range(46, 64) for b in range(46, 64)})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp bigint")
    monkeypatch.setattr(simhash, "HOMES_A_TASK", 16)
    edges = simhash.link_fingerprints(df)
    assert components.components(edges).groupBy("root").count().count() == 1
    assert components.components(edges).count() == len(fps)


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 50)] + [(7, 7), (None, 3), (5, 6), (6, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {k: 0 for k in range(50)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 4
def test_lm_counts_and_gain(spark, docs, odd):
    for df, gains in ((docs, True), (odd, False), (odd.limit(0), False)):
        rows = pairs(df)
        tok = lambda t: [*(t or "").encode().lower().split(), b""]
        out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = collections.Counter(w for i, t in rows if i is not None and not out(i) for w in tok(t))
        n, v = sum(c.values()), len(c)
        want = collections.Counter((i, out(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 4)) for i, t in rows)
        got = maxent_lm.score(df).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
        if gains:
            assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def listed(n, total, distinct):
    return maxent_lm.Vocabulary({f"w{i}".encode(): i for i in range(n)}, np.arange(n, 0, -1), total, distinct)


def test_lm_leaves_are_a_distribution():
    rng = np.random.default_rng(0)
    for n in (0, 1, 15, 16, 17, 3000, maxent_lm.HOT_WORDS):
        model = maxent_lm.Model(maxent_lm.Tree(listed(n, 5_000_000_000, 2 * n + 5)))
        for weights in model.tables:
            weights += rng.normal(size=weights.shape).astype(np.float32)
        leaves = np.arange(n + 1)
        p = np.exp(model.log_probability(leaves, np.full(n + 1, 3), np.full(n + 1, 5)))
        assert abs(p.sum() - 1) < 1e-4 and (p > 0).all()


def test_lm_score_by_brute_force(spark, docs, odd, monkeypatch):
    def short(counts, full=maxent_lm.vocabulary_of):
        v = full(counts)
        return maxent_lm.Vocabulary({w: r for w, r in v.rank.items() if r < 700}, v.count[:700], v.total, v.distinct)

    monkeypatch.setattr(maxent_lm, "vocabulary_of", short)
    train, kept = maxent_lm.train, {}
    monkeypatch.setattr(maxent_lm, "train", lambda d, v: kept.setdefault(len(kept), (v, train(d, v)))[1])
    long_words = spark.createDataFrame([(k, f"so {'x' * 70} {'y' * (65 + k % 2)} end") for k in range(900, 990)], "doc_id bigint, text string")
    few = docs.select("doc_id", "text").where("doc_id < 20").unionByName(long_words)
    for k, df in enumerate((few, odd)):
        got = collections.defaultdict(set)
        for r in maxent_lm.score(df).collect():
            got[r.doc_id].add(round(r.score, 2))
        voc, model = kept[k]
        rows = pairs(df)
        split = lambda t: [*(t or "").encode().lower().split(), b""]
        counts = collections.Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in split(t))
        assert len(voc.count) <= 700 and (k or any(w[:1] == b" " for w in voc.rank)) and all(counts[w] == voc.count[r] for w, r in voc.rank.items() if w[:1] != b" ")
        for i, t in rows:
            total, before = 0.0, [maxent_lm.START, maxent_lm.START]
            for w in split(t)[:400] if len(t or "") < 5000 else []:
                r = voc.rank.get(w if len(w) <= 64 else b" " + hashlib.sha256(w).digest())
                leaf = len(voc.count) if r is None else r
                a, b = (np.array([x], dtype=np.int64) for x in before)
                for depth, (node, way) in enumerate(zip(model.tree.node[:, leaf], model.tree.way[:, leaf])):
                    if node >= 0:
                        x = model.tree.bias[node].astype(float)
                        for weights, row in zip(model.tables, model.rows(model.contexts(a, b)[: 3 if depth < 2 else 2], np.array([node]))):
                            x = x + weights[row[0]]
                        total += math.log10(math.exp(x[way]) / sum(math.exp(y) for y in x))
                if r is None:
                    total += math.log10((counts[w] + 1) / (voc.rest_total + voc.rest_distinct + 1))
                before = [maxent_lm.HOT_WORDS + 1 + zlib.crc32(w) % maxent_lm.HASHED if r is None else r, before[0]]
            if 0 < len(split(t)) <= 400 and len(t or "") < 5000:
                assert any(abs(total - x) < 0.02 + 1e-4 * abs(total) for x in got[i]), (i, total, got[i])


def test_lm_trains_on_every_document_and_every_frequent_word(spark):
    n = 3000
    for key in range(6):  # in whichever round it is
        voc = listed(n, 5_000_000, n)
        docs = spark.createDataFrame([(key, "w1 w2000 w2 w2000")], "key bigint, text string")
        before, after = maxent_lm.Model(maxent_lm.Tree(voc)), maxent_lm.train(docs, voc)
        assert all((a != b).any() for a, b in zip(before.tables, after.tables, strict=True))
        one, start = np.array([1]), np.full(1, maxent_lm.START)
        gain = lambda i: (after.log_probability(np.array([i]), one, start) - before.log_probability(np.array([i]), one, start))[0]
        assert gain(2000) > 0.01 > gain(2500)


def test_lm_tokens_and_ids_by_plain_python():
    rng = np.random.default_rng(1)
    chars = list("abAZ  \t\n\x0b\x0c\r\x1c\x85\xa0É\u2003😀")
    texts = [None, "", " ", "\n \t", "end", "x" * 65 + " " + "y" * 70, *("".join(rng.choice(chars, size=k)) for k in range(60))] * 2
    want = [[*(t or "").encode().lower().split(), b""] for t in texts]
    words, sizes = maxent_lm.tokens(pa.array(texts).slice(3))
    assert sizes.tolist() == [len(w) for w in want[3:]] and words.to_pylist() == [w for ws in want[3:] for w in ws]
    listed_words = [b"", b"a", b" " + hashlib.sha256(b"y" * 70).digest(), *(w for w, n in collections.Counter(w for ws in want for w in ws).items() if n == 2 and b"z" in w and len(w) < 65)]
    voc = maxent_lm.Vocabulary({w: k for k, w in enumerate(listed_words)}, np.ones(len(listed_words), dtype=np.int64), 999, 99)
    rank = lambda w: voc.rank.get(w, voc.rank.get(b" " + hashlib.sha256(w).digest(), -1 - zlib.crc32(w) % maxent_lm.HASHED))
    assert voc.ids(words).tolist() == [rank(w) for ws in want[3:] for w in ws]
    rare = maxent_lm._rare(words, voc.ids(words) < 0, sizes).to_pylist()
    assert [{r["w"]: r["n"] for r in rs} for rs in rare] == [collections.Counter(w for w in ws if rank(w) < 0) for ws in want[3:]]
    assert all(len({r["w"] for r in rs}) == len(rs) for rs in rare)


def test_lm_step_by_brute_force():
    rng = np.random.default_rng(2)
    model = maxent_lm.Model(maxent_lm.Tree(listed(40, 5000, 90)))
    n = 6000  # more than one piece
    leaf, one, two = rng.integers(0, 41, n), rng.integers(0, 3000, n) ** 2 // 3000, rng.integers(0, 9, n)
    levels = list(model.levels(leaf, model.contexts(one, two)))
    want, sums = [], []
    for k in range(maxent_lm.FEATURES):
        table, seen = np.zeros((maxent_lm.ROWS, maxent_lm.BRANCH)), np.zeros(maxent_lm.ROWS)
        want.append(table), sums.append(seen)
    for live, node, way, rows in levels:
        x = model.tree.bias[node] + sum(t[r] for t, r in zip(want, rows))
        g = np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
        g[np.arange(len(live)), way] -= 1
        for table, seen, r in zip(want, sums, rows):
            step = np.zeros_like(table)
            np.add.at(step, r, g)
            seen += (step**2).sum(axis=1)
            table -= step * (maxent_lm.STEP / np.sqrt(seen + 1e-2))[:, None]
    got = [np.zeros(maxent_lm.ROWS, dtype=np.float32) for _ in want]
    model.learn(leaf, one, two, got)
    assert all(np.allclose(a, b, atol=2e-3) for a, b in zip(model.tables, want)) and all(np.allclose(a, b, rtol=1e-3, atol=1e-3) for a, b in zip(got, sums))


def test_lm_looks_words_up_in_less_time_than_plain_python():
    rng = np.random.default_rng(3)
    names = [f"word{k}" for k in range(60_000)]
    texts = [" ".join(names[k] for k in rng.zipf(1.2, 400) % 70_000 if k < 60_000) for _ in range(1500)]
    voc = maxent_lm.Vocabulary({w.encode(): k for k, w in enumerate(names)}, np.arange(60_000, 0, -1), 5_000_000_000, 90_000)
    column = pa.array(texts)

    def seconds(run):
        took = []
        for _ in range(5):
            begun = time.process_time()
            run()
            took.append(time.process_time() - begun)
        return min(took)

    plain = seconds(lambda: [voc.rank.get(w, -1) for t in column.to_pylist() for w in [*t.encode().lower().split(), b""]])
    assert seconds(lambda: maxent_lm._positions(voc, column)) < plain
    assert seconds(lambda: list(maxent_lm._counts([pa.RecordBatch.from_arrays([column], names=["text"])]))) < plain


def test_lm_gain_on_held_out_tokens(spark):
    got = maxent_lm.score(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.08


# 5
def repeats(rows, size=200):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[p : p + size] for t in data for p in range(len(t) - size + 1))
    for (i, _), t in zip(rows, data):
        spans = []
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + size
                else:
                    spans.append([p, p + size])
        kept, upto = b"", 0
        for a, b in spans:
            kept, upto = kept + t[upto:a], b
        yield i, len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + t[upto:]).hexdigest()


def test_repeats_are_cut_exactly(spark, docs):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    shared = [text(n) for n in (199, 200, 201, 260, 500)]
    rows = [(i, text(rng.randint(0, 300)) + rng.choice(shared) + text(rng.randint(0, 300)) + rng.choice(shared)) for i in range(60)]
    rows += [(90, None), (91, ""), (92, "ab" * 400), (93, "x" * 450), (94, shared[3]), (94, shared[3]), (None, text(700)), (95, (text(67) + "\n") * 9)]
    small = spark.createDataFrame(rows, "doc_id bigint, text string")
    for df in (small, docs, small.limit(0)):
        got = collections.Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(df).collect())
        assert got == collections.Counter(repeats(pairs(df)))


def test_family_finds_matches_across_levels(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FAMILY_BATCH", 4)
    rng = random.Random(3)
    gram = bytes(rng.choice(b"ab") for _ in range(suffix_dedup.GRAM))
    rows = [(bytes(rng.choice(b"ab") for _ in range(3)) + b"q" * rng.randint(0, 160), b"z" * rng.randint(0, 168)) for _ in range(40)]
    family = suffix_dedup.Family()
    for lo in range(0, 40, 4):
        part = rows[lo : lo + 4]
        family.add(np.full(len(part), 5), [f for f, _ in part], [gram + b for _, b in part])
    family.finish()
    for i, (f, b) in enumerate(rows):
        wide = [w for w in range(suffix_dedup.SPAN + 1) if len(f) >= w and len(b) >= suffix_dedup.SPAN - w and any(j != i and len(g) >= w and len(c) >= suffix_dedup.SPAN - w and f[:w] == g[:w] and b[: suffix_dedup.SPAN - w] == c[: suffix_dedup.SPAN - w] for j, (g, c) in enumerate(rows))]
        assert family.before[i] == (max(wide) if wide else -1)
        assert family.after[i] == (suffix_dedup.SPAN - min(wide) if wide else -1)


def test_grams_with_many_surroundings_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    hot = "the one gram that stands in very many different places of the texts"
    tails, heads = [text(150) for _ in range(4)], [text(150) for _ in range(4)]
    rows = [(i, text(90) + rng.choice(heads)[rng.randint(0, 60) :] + hot + rng.choice(tails)[: rng.randint(60, 150)] + text(90)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = collections.Counter(repeats(rows))
    assert sum(r[2] for r in want) > 0
    marked = suffix_dedup._sort_out
    monkeypatch.setattr(suffix_dedup, "_sort_out", lambda b: split_at(b, marked))
    assert collections.Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(df).collect()) == want


def split_at(batches, marked, least=5):
    from permrisk.llm import suffix_dedup as module  # in the task

    module.SPLIT_AT = least
    yield from marked(batches)


def test_an_index_of_batches_finds_what_one_of_everything_does(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcd efgh") for _ in range(n))
    shared = [text(n) for n in (199, 200, 230, 420)]
    rows = [(i, text(rng.randint(0, 200)) + rng.choice(shared) + text(rng.randint(0, 200)) + rng.choice(shared)) for i in range(50)] + [(60, None), (61, "x" * 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    keys = {(r.key, r.size): r.id for r in suffix_dedup.keyed(df).collect()}
    want = {i: n for i, _, n, _, _ in repeats(rows)}
    for batches in (1, 5):
        index, spans = suffix_dedup.SuffixIndex(), collections.defaultdict(set)
        for k in range(batches):
            for r in index.add(df.where(f"doc_id % {batches} = {k}")).collect():
                spans[keys[r.key, r.size]] |= set(range(r.start, r.stop))
        assert {i: len(spans[i]) for i in want} == want
        assert [h for h, _ in index.levels] == ([0] if batches == 1 else [2, 0])


# 6
def test_folding():
    assert toxicity.folded("YOU 1D10T!! ѕtup!d  $tupid") == "you idiot stupid stupid".split()
    assert toxicity.folded("clown c1own") == ["ciown", "ciown"]
    assert toxicity.folded(None) == []


def test_toxicity_on_held_out(spark, odd):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    got = {r.doc_id: r for r in toxicity.classify(table(spark, sf, "documents"), labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    hit = sum(got[i].predicted and truth[i] for i in held)
    assert hit / sum(truth[i] for i in held) > 0.8
    assert hit / sum(got[i].predicted for i in held) > 0.85
    assert all(0 <= r.score <= 1 for r in got.values())
    none = labels.limit(0)
    assert toxicity.classify(odd, none).count() == odd.count()
    some = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (7, 1, None), (None, 1, 1), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert toxicity.classify(odd, some).count() == odd.count()


# 7
def test_language_held_out_accuracy(spark, docs, odd):
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und") == (r.score == 0) for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {3, 4, 5, 8, None}
    assert {r.lang_pred for r in language_id.identify(odd.where("lang IS NULL")).collect()} == {"und"}
    assert language_id.identify(odd.limit(0)).count() == 0


# 8
def test_ids_are_those_of_the_library(spark, docs, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_FILE)
    rng = random.Random(3)
    letters = "ab the ing   \n\t▁éñßжλ漢😀.,;:'\"()[]{}<>=+-_/\\0123456789%$#@!eaointhsrl"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(3000)] + [t for _, t in pairs(docs)]
    machine = sentencepiece_fst.load()
    ids = [x.tolist() for x in machine.encode_batch(texts)]
    assert ids == library.encode(texts)
    assert [machine.decode(i) for i in ids] == library.decode(ids)
    rows = sentencepiece_fst.encode(odd).collect()
    assert len(rows) == odd.count() and all(r.round_trip and r.n_ids == len(r.ids) for r in rows)
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(odd))
    assert sorted(str(tuple(r)) for r in back.collect()) == sorted(str((i, t or "")) for i, t in pairs(odd))


def test_unigram_takes_the_least_path():
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(p, s, 1) for p, s in (("▁", -5.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("▁a", -4.5), ("ba", -3.5))]
    machine = sentencepiece_fst.Transducer(sentencepiece_fst.UNIGRAM, pieces, True, False)
    name = lambda t: [pieces[i][0] for i in machine.encode(t)]
    assert name("aba") == ["▁a", "ba"]
    assert name("é") == ["▁", "<0xC3>", "<0xA9>"]


# 9
def test_e8_points_are_nearest():
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    c = lattice.nearest_e8(x)
    r = x - c
    assert ((2 * c) % 1 == 0).all() and (np.abs(c.sum(axis=1) % 2) < 1e-9).all()
    assert (((r[:, None] - lattice._roots()) ** 2).sum(axis=2).min(axis=1) >= (r**2).sum(axis=1) - 1e-9).all()


def test_vectors_link_as_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 32))
    near = np.repeat(base[:20], 12, axis=0) + rng.normal(size=(240, 32)) * 0.12
    hub = base[0] + rng.normal(size=(200, 32)) * 0.05
    x = np.vstack([base, near, hub, base[:5], base[:5], 3 * base[5:8]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * 32), (9004, [float("nan")] * 32), (9005, [1.0, None]), (9006, [1.0, 2.0]), (None, [float("inf")] * 32)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS n", "2 AS rid", "3 AS cell", "4 AS codes", "'v' AS vec", "5 AS low", "6 AS parts")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    root = roots(len(x), [(a, b) for a, b in zip(*np.nonzero(link)) if a < b])
    results = []
    for rows_a_block in (lattice.BLOCK_ROWS, 16):  # the smaller one splits the hub's cells
        monkeypatch.setattr(lattice, "BLOCK_ROWS", rows_a_block)
        got = lattice.near_duplicates(df).collect()
        by = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id < 9000}
        found = sum(by[i].n_links for i in range(len(x)))
        assert all(by[i].n_links <= link[i].sum() for i in range(len(x)))
        assert found >= 0.97 * link.sum()
        assert sum(by[i].component_id == root[i] for i in range(len(x))) >= 0.99 * len(x)
        assert all(r.n_links == 0 for r in got if r.vec_id is None or r.vec_id > 9000)
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
        results.append(sorted(map(str, got)))
    assert results[0] == results[1]
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_recall_of_the_closest_call(spark):
    """Pairs planted at cosines of 0.900 to 0.905, none of them below."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(600, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.905, size=(600, 1))
    x = np.vstack([a, c * a + np.sqrt(1 - c * c) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(df).collect()}
    assert sum(got[i] > 0 for i in range(600)) >= 0.95 * 600
    more = {r.vec_id: r.n_links for r in lattice.near_duplicates(df, scheme=lattice.Scheme(tables=9)).collect()}
    assert sum(more[i] > 0 for i in range(600)) >= 0.99 * 600


# 10
def test_longest_common_subsequence(monkeypatch):
    rng = random.Random(6)
    for cells in (1 << 22, 9):
        monkeypatch.setattr(html_text, "TABLE_CELLS", cells)
        for _ in range(300):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
            t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
            mask = html_text.shared(a, b)
            part, rest = [x for x, m in zip(a, mask) if m], iter(b)
            assert mask.sum() == t[-1][-1] and all(x in rest for x in part)


PAGE = """<html><head><title>T</title></head><body><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div><main><h1>A &amp; B</h1>
<p>First&nbsp; <b>bold<br>line</p><!-- no --><script>var x="</p>"</script><aside>Side</aside><section class="comments"><p>Nice!</p></section><form>Mail</form><p>Last</main><footer>&copy;</footer></body></html>"""


def left(page):
    return html_text.main_text(html_text.lines(page), [])[0]


def test_main_text_by_markup():
    assert left(PAGE) == "A & B\nFirst bold line\nLast"
    for page, want in (
        ('<article class="post has-sidebar"><p>Body</p></article>', "Body"), ('<article data-x="display:none"><p>x</p></article>', "x"),
        ("<article><header><h1>Title</h1><p>by me</p></header><p>text</p></article>", "Title\ntext"), ('<article><div class="entry-header"><h1>T</h1>by</div>b</article>', "T\nb"),
        ('<div class="header-image-wrapper"><p>a</p></div><p class="related-work">b</p>', "a\nb"), ('<div role="main"><div>in</div></div><div>out</div>', "in"),
        ('<main><article class="comment">no</article><p>y <math>2</math></p></main>', "y 2"), ('<p hidden>n</p><p style="Display: none">n</p><div class="cookie-notice">n</div><div class="site-header">n</div><p>yes', "yes"),
    ):
        assert left(page) == want
    for broken in (None, "", "<", "a < b", "<!-- x", "<p", "<div class='ad'>open", "<script>", "</p>", "&#x110000; &bogus;", "<p a=\"x>y</p>", "<main><main>", "</main></article>", "<header><header>x</header>"):
        left(broken)


def page_order(r):
    from urllib.parse import urlsplit

    try:
        u = urlsplit(r[1] or "")
        host, path = (u.hostname or "") if u.scheme else "", u.path if u.scheme else ""
    except ValueError:
        host, path = "", ""
    return host.lower(), path.lower(), r[0], r[2]


def test_pages_are_differenced_alike_however_they_are_dealt(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    heads = {h: [word() for _ in range(3)] for h in range(4)}
    passage, copy = "a passage that many pages hold", None
    rows = []
    for n in range(240):
        h = rng.choice([0, 0, 0, 1, 2, 3])
        body = [" ".join(word() for _ in range(5)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.3:
            body.insert(rng.randint(0, len(body)), passage)
        parts = [*heads[h], *body, f"imprint {h}"]
        if rng.random() < 0.3 and copy:
            h, parts = copy
        copy = h, parts
        tag = "article" if rng.random() < 0.1 else "div"
        html = "".join(f"<div>{x}</div>" for x in parts[:3]) + f"<{tag}>" + "".join(f"<p>{x}</p>" for x in parts[3:-1]) + f"</{tag}><div>{parts[-1]}</div>"
        rows.append((n, f"http://h{h}.example/{rng.randint(0, 60)}/{n}?q={n}", html))
    rows += rows[:5]
    places: list = []
    for r in sorted(rows, key=page_order):
        if not places or (places[-1][0], places[-1][1]) != (page_order(r)[0], r[2]):
            places.append((page_order(r)[0], r[2], []))
        places[-1][2].append(r)
    want = collections.Counter()
    for k, (host, html, group) in enumerate(places):
        near = [html_text.lines(places[j][1]) for j in (k - 1, k + 1) if 0 <= j < len(places) and places[j][0] == host]
        text, n = html_text.main_text(html_text.lines(html), near)
        want.update((r[0], text, n) for r in group)
    assert sum(n > 0 for _, _, n in want) > 100
    for parts, size in ((1, 1), (8, 3), (97, 40)):
        spark.conf.set("spark.sql.shuffle.partitions", size)
        df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts)
        got = collections.Counter((r.page_id, r.text, r.n_shared) for r in html_text.extract(df).collect())
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert got == want


def test_pages_that_name_no_main_part_give_nearly_the_same(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    marked = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    plain = {r.page_id: r.text for r in html_text.extract(pages.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))).collect()}
    assert sum(plain[i] != marked[i] for i in marked) <= 0.01 * len(marked)


def test_template_lines_go_where_nothing_names_the_main_part(spark):
    page = lambda n: f"<div>Site name</div><div>Section</div><p>Story {n} begins.</p><p>And {n} ends.</p><div>Imprint</div>"
    rows = [(n, f"http://h.example/a/{n}?q=1", page(n)) for n in range(6)] + [(20, "http://other.example/", page(20)), (21, None, None), (22, "::bad url", "<p>x</p>"), (None, "http://h.example/a/9", page(9))]
    rows += [(30, "http://copy.example/1", page(30)), (31, "http://copy.example/2", page(30))]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'t' AS text", "'h' AS host").coalesce(1)).collect()}
    assert got[3].text == "Story 3 begins.\nAnd 3 ends." and got[3].n_chars == len(got[3].text)
    assert got[20].text.startswith("Site name") and got[21].text == "" and got[22].text == "x"
    assert got[30].text == got[31].text != ""
    assert len(got) == len(rows)


def test_pages_give_their_articles(spark, sf):
    import html as h

    rows = {r.page_id: r for r in html_text.extract(table(spark, sf, "pages")).collect()}
    for p in table(spark, sf, "pages").collect():
        body = "".join(re.findall(r"<article>(.*?)</article>", p.html, re.S))
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|div)>", body)]
        assert rows[p.page_id].text == "\n".join(b for b in blocks if b)


# columns named like those that operators use within
INNER = ("__added", "__id", "__toxic", "__best", "__text", "id", "text_", "fp", "best", "toxic", "n", "word", "run", "mask", "kind", "v", "codes", "part", "u", "root", "cell", "rid", "lang_pred", "held_out", "score")


def test_inner_names_as_extra_columns(spark, docs, monkeypatch):
    few = docs.orderBy("doc_id").limit(60).cache()
    named = few.select("*", *[F.lit("x").alias(c) for c in INNER])
    labels = spark.createDataFrame([(r.doc_id, k % 3 == 0) for k, r in enumerate(few.collect())], "doc_id bigint, toxic boolean").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ran = lambda f: (sorted(map(repr, f(few).collect())), sorted(map(repr, f(named).collect())))
    own = lambda df: df.select(*few.columns)
    for f in (
        pii.find, lambda d: own(pii.redact(d)), lambda d: own(simhash.deduplicate(d)), simhash.near_duplicates, lambda d: toxicity.classify(d, labels), lambda d: toxicity.classify(d, labels.select("*", *[F.lit(1).alias(c) for c in INNER if c != "toxic"])),
        language_id.identify, suffix_dedup.remove_repeats, sentencepiece_fst.encode, maxent_lm.score,
    ):
        a, b = ran(f)
        assert a == b
    assert pii.redact(named).columns == named.columns == simhash.deduplicate(named).columns
    monkeypatch.setattr(pii, "BLOCK", 1)
    rows = spark.createDataFrame([(i, f"filler text {i} hotline +1 555 010 {1000 + i} or mobile +1 555 010 {2000 + i} thanks", "kept") for i in range(12)] + [(99, "please use hotline 555-0199-88 today", "kept")], "doc_id bigint, text string, __added string")
    out = {r.doc_id: r for r in pii.redact(rows).collect()}
    assert out[99].text == "please use hotline [PHONE] today" and out[99]["__added"] == "kept"
