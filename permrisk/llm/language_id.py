"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of the lower-cased text, padded by a blank on both
sides, into a fixed number of buckets. Tasks add up dense count matrices, the
sums are grouped by (language, bucket), and the smoothed log-probability matrix
is broadcast: its size is languages x buckets, a quarter of a megabyte a
language, and never depends on the number of documents. More than ``max_langs``
labels are refused.

Results for odd input: a null or letterless text gets ``und`` and score 0; a
null id is never trained on and not held out; without any training row every
text is ``und``; ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permrisk.llm.common import fold, slices

UNDETERMINED = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
BATCH_CHARS = 1 << 20
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def ngram_codes(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the texts and the index of the text it is from."""
    padded = [f" {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in padded])
    codes, owners, h = [], [], np.zeros(len(chars), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        size = len(chars) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint32(0x01000193) ^ (chars[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            whole = owner[:size] == owner[n - 1 :]
            mixed = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B)
            codes.append((mixed >> np.uint32(7))[whole] & np.uint32(buckets - 1))
            owners.append(owner[:size][whole])
    return np.concatenate(codes), np.concatenate(owners)


def _count(batches, buckets: int):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in slices([len(t) for t in texts], BATCH_CHARS):
            codes, owners = ngram_codes(texts[lo:hi], buckets)
            names = sorted(set(langs[lo:hi]))
            own = np.array([names.index(x) for x in langs[lo:hi]])[owners]
            flat = np.bincount(own * buckets + codes, minlength=len(names) * buckets).reshape(len(names), buckets)
            docs = np.bincount([names.index(x) for x in langs[lo:hi]], minlength=len(names))
            for k, name in enumerate(names):
                # the last cell counts documents
                counts.setdefault(name, np.zeros(buckets + 1, dtype=np.int64))
                counts[name][:buckets] += flat[k]
                counts[name][buckets] += docs[k]
    for name, row in counts.items():
        used = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(row[used], pa.int64())],
            names=["lang", "bucket", "n"],
        )


@dataclass(frozen=True)
class LanguageModel:
    """Classes in order, and log P(n-gram | class) with the class prior in the last row."""

    langs: tuple[str, ...]
    logp: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        best, prob = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        live = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        if not live:
            return best, prob
        codes, owners = ngram_codes([texts[i] for i in live], len(self.logp) - 1)
        total = np.stack([np.bincount(owners, weights=self.logp[:-1, k][codes], minlength=len(live)) for k in range(len(self.langs))], axis=1)
        total += self.logp[-1]
        total = np.exp(total - total.max(axis=1, keepdims=True))
        total /= total.sum(axis=1, keepdims=True)
        for i, k, p in zip(live, total.argmax(axis=1), total.max(axis=1), strict=True):
            best[i], prob[i] = self.langs[k], float(p)
        return best, prob


def train(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *,
    buckets: int = BUCKETS, alpha: float = 0.5, max_langs: int = 512,
) -> LanguageModel:
    """Fit on every row with a text and a language.

    ``max_langs`` bounds what reaches the driver and the tasks; more distinct labels
    than that are no languages, and the fit refuses them.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    cells = (
        rows.mapInArrow(lambda b: _count(b, buckets), "lang string, bucket int, n bigint")
        .groupBy("lang", (F.floor(F.col("bucket") / 4096)).alias("block"))
        .agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))
    )
    got = _collect(cells, max_langs, buckets)
    langs = tuple(sorted(got))
    if not langs:
        return LanguageModel((), np.zeros((buckets + 1, 0)))
    counts = np.stack([got[x] for x in langs], axis=1)
    grams, docs = counts[:-1].astype(np.float64), counts[-1].astype(np.float64)
    logp = np.log(grams + alpha) - np.log(grams.sum(axis=0) + alpha * len(grams))
    return LanguageModel(langs, np.vstack([logp, np.log(docs / docs.sum())]))


def _collect(cells: DataFrame, max_langs: int, buckets: int) -> dict[str, np.ndarray]:
    got: dict[str, np.ndarray] = {}
    for row in cells.toLocalIterator():
        if row.lang not in got and len(got) >= max_langs:
            raise ValueError(f"more than {max_langs} distinct language labels")
        dense = got.setdefault(row.lang, np.zeros(buckets + 1, dtype=np.int64))
        for cell in row.cells:
            dense[cell.bucket] += cell.n
    return got


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the columns ``keep``; the text itself is passed on only if kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep).schema

    def run(batches):
        for batch in batches:
            texts, best, prob = batch.column(batch.num_columns - 1).to_pylist(), [], []
            for lo, hi in slices([len(t or "") for t in texts], BATCH_CHARS):
                a, b = shared.value.score(texts[lo:hi])
                best, prob = best + a, prob + b
            arrays = batch.columns[:-1] + [pa.array(best, pa.string()), pa.array(prob, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept.names, "lang_pred", "score"])

    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.fields)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, out + "lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, modulus: int = 4, held: int = 2) -> DataFrame:
    """Train on the documents outside the held-out fold and predict every document."""
    model = train(docs.where(fold(id_col, modulus) != held), text_col, lang_col)
    out = predict(docs.withColumn("held_out", F.coalesce(fold(id_col, modulus) == held, F.lit(False))), model, text_col, (id_col, "held_out"))
    return out.select(F.col(id_col), "held_out", "lang_pred", "score")


def confident(docs: DataFrame, model: LanguageModel, text_col: str = "text", *, min_score: float = 0.5) -> DataFrame:
    """The documents whose language is told with at least ``min_score``, all their columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for lo, hi in slices([len(t or "") for t in texts], BATCH_CHARS):
                best, prob = shared.value.score(texts[lo:hi])
                keep += [b != UNDETERMINED and p >= min_score for b, p in zip(best, prob, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
