"""Publishing in batches: the chain is extended, duplicates are refused, and a batch that broke off is published once."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from permrisk.plans import ledger
from permrisk.sources import published
from permrisk.sources.scratch import scratch_dir


@pytest.fixture
def store(spark):
    return f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"


def predictions(spark, subjects, tag="p"):
    return spark.createDataFrame([(s, f"{tag}{s}") for s in subjects], "subject bigint, payload string").repartition(3)


def rows(spark, store):
    return [tuple(r) for r in published.entries(spark, store).select("seq", "subject", "payload", "prev_hash", "entry_hash").orderBy("seq").collect()]


def linked(payloads):
    prev = ledger.GENESIS
    for k, (subject, payload) in enumerate(payloads):
        after = hashlib.sha256((prev + hashlib.sha256(payload.encode()).hexdigest()).encode()).hexdigest()
        yield k, subject, payload, prev, after
        prev = after


def test_extends_refuses_and_repeats(spark, store):
    published.publish(predictions(spark, range(0, 40, 2)), store, 0)
    published.publish(predictions(spark, range(0, 40), "q"), store, 1)
    twice = predictions(spark, [100, 7]).union(predictions(spark, [100], "a")).union(spark.createDataFrame([(None, "x"), (200, None)], "subject bigint, payload string"))
    published.publish(twice, store, 5)
    want = list(linked([(k, f"p{k}") for k in range(0, 40, 2)] + [(k, f"q{k}") for k in range(1, 40, 2)] + [(100, "a100")]))
    assert rows(spark, store) == want
    assert sorted(tuple(r)[:4] for r in published.manifest(spark, store).collect()) == [(0, 20, 0, 19), (1, 20, 20, 39), (5, 1, 4, 40)]
    for epoch in (0, 1, 5):  # sent again
        published.publish(predictions(spark, range(300, 310)), store, epoch)
    published.publish(predictions(spark, []), store, 6)
    assert rows(spark, store) == want
    check = ledger.verified(published.entries(spark, store), 40).first()
    assert check.first_break is None and check.broken == 0 and check.complete and check.entries == 41


def test_a_killed_batch_leaves_one_copy(spark, store, monkeypatch):
    published.publish(predictions(spark, range(5)), store, 0)
    own = spark.__class__.createDataFrame
    with monkeypatch.context() as m:  # dies after the entries are written, before the manifest is
        m.setattr(spark.__class__, "createDataFrame", lambda self, data, schema=None, **k: (_ for _ in ()).throw(RuntimeError("killed")) if schema == published.MANIFEST and len(data) else own(self, data, schema, **k))
        batch = spark.range(5, 9).select(F.col("id").alias("subject"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("payload"))
        with pytest.raises(RuntimeError):
            published.publish(batch, store, 1)
    assert len(rows(spark, store)) == 5
    published.publish(batch, store, 1)
    published.publish(batch, store, 1)
    assert rows(spark, store) == list(linked([(k, f"p{k}") for k in range(9)]))


def test_stream(spark, store, tmp_path):
    for k in range(3):
        predictions(spark, range(10 * k, 10 * k + 12)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("subject bigint, payload string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    source.writeStream.foreachBatch(published.publisher(store)).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    got = rows(spark, store)
    assert [r[1] for r in got] and sorted(r[1] for r in got) == list(range(32)) and published.manifest(spark, store).count() == 3
    assert ledger.verified(published.entries(spark, store), 31).first().first_break is None
    # the same stream from the start: every subject is known
    source.writeStream.foreachBatch(lambda b, e: published.publish(b, store, 100 + e)).option("checkpointLocation", str(tmp_path / "again")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark, store) == got
