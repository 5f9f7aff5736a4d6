"""The pipeline against a brute-force version of its stages."""

import collections

import numpy as np

import corpus_pipeline
from permrisk.llm import decontaminate, language_id, pii, sentencepiece_fst
from permrisk.llm.common import fold, table
from tests.llm.test_operators import distance, forms, plain_fingerprint, roots


def test_stages_are_what_run_applies(spark, sf):
    docs = table(spark, sf, "documents")
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    rows = docs.collect()
    best, prob = model.score([r.text for r in rows])
    rows = [r for r, b, p in zip(rows, best, prob) if b != "und" and p >= 0.5]
    f = np.array([plain_fingerprint(r.text) for r in rows], dtype=np.uint64)
    root = roots(len(f), [(a, int(b)) for a in range(len(f)) for b in np.flatnonzero(np.bitwise_count(f ^ f[a]) <= 2) if b > a])
    keep = {}
    for r, k in zip(rows, root):
        keep[k] = min(keep.get(k, r.doc_id), r.doc_id)
    rows = [r for r in rows if r.doc_id in set(keep.values())]
    items = [decontaminate.normalise(b.text) for b in table(spark, sf, "benchmark").collect()]
    leaks = lambda t: any(i in t or (i[:10] in t or i[-10:] in t or i[60:70] in t) and distance(i, t) <= int(decontaminate.ERROR_RATE * len(i)) for i in items if i)
    rows = [r for r in rows if not leaks(decontaminate.normalise(r.text))]
    machine = sentencepiece_fst.load()
    want = collections.Counter((r.doc_id, tuple(machine.encode(pii.masked(r.text, forms(r.text))))) for r in rows)
    got = collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_stages_on_odd_and_empty_input(spark, sf, odd):
    for docs in (odd, odd.limit(0)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == names, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
