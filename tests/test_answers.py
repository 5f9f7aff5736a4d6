import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from permrisk.sources import answers

D = dt.date


@pytest.fixture()
def store(spark, tmp_path):
    answers.register(spark)
    land(spark, tmp_path, 1, [("legistar", "a", D(2024, 1, 1), D(2023, 1, 1), D(2023, 12, 31), "old\nlines"), ("opengov", "b", D(2024, 1, 1), None, None, None)])
    land(spark, tmp_path, 2, [("legistar", "a", D(2024, 7, 1), D(2024, 1, 1), D(2024, 6, 30), "x" * 3_000_000), ("accela", "c", None, D(2024, 2, 1), D(2024, 2, 2), "")])
    return tmp_path


def land(spark, path, batch, rows, parts=2):
    df = spark.createDataFrame(rows, answers.SCHEMA).repartition(parts, "platform")
    df.write.format("civic_answers").option("path", str(path)).option("batch", batch).mode("append").save()


def read(spark, path, pushdown=False):
    """Loaded anew: a table whose filters are pushed is filtered once only."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushdown)
    return spark.read.format("civic_answers").option("path", str(path)).option("pushdown", pushdown).load()


def test_what_was_landed_is_read(spark, store):
    got = {(r.platform, r.source, r.fetched_on, r.first_day, r.last_day, r.answer and (r.answer[:5], len(r.answer))) for r in read(spark, store).collect()}
    assert got == {
        ("legistar", "a", D(2024, 1, 1), D(2023, 1, 1), D(2023, 12, 31), ("old\nl", 9)), ("opengov", "b", D(2024, 1, 1), None, None, None),
        ("legistar", "a", D(2024, 7, 1), D(2024, 1, 1), D(2024, 6, 30), ("xxxxx", 3_000_000)), ("accela", "c", None, D(2024, 2, 1), D(2024, 2, 2), ""),
    }


def test_filters_choose_files_and_are_pushed(spark, store):
    late = read(spark, store, True).where((F.col("last_day") >= D(2024, 1, 1)) & (F.col("platform") == "legistar"))
    plan = late._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(last_day" in pushed and "EqualTo(platform" in pushed
    assert [len(r.answer) for r in late.collect()] == [3_000_000]
    # a file that cannot hold an answer is not even opened
    for f in listed(store, 1):
        (store / f["file"]).write_text("no answer")
    assert late.count() == 1
    with pytest.raises(Exception):
        read(spark, store).count()


def test_one_table_filtered_in_several_ways(spark, store):
    d = read(spark, store)
    both = d.where("platform = 'legistar'").union(d.where("platform = 'accela'"))
    assert sorted(r.source for r in both.select("source").collect()) == ["a", "a", "c"] and d.count() == 4


@pytest.mark.parametrize("options, condition", [
    ({"since": "2024-02-02"}, "last_day >= '2024-02-02'"), ({"until": "2023-06-01"}, "first_day <= '2023-06-01'"), ({"platform": ["accela", "opengov"]}, "platform IN ('accela', 'opengov')"),
    ({"source": ["a"], "since": "2024-01-01"}, "source = 'a' AND last_day >= '2024-01-01'"), ({"platform": ["none"]}, "false"), ({}, "true"),
])
def test_options_are_conditions(spark, store, options, condition):
    got = answers.stored(spark, str(store), **options).select("source", "first_day")
    assert sorted(map(str, got.collect())) == sorted(map(str, read(spark, store).where(condition).select("source", "first_day").collect()))
    reader = answers.AnswerReader(str(store), answers.chosen({k: v if isinstance(v, str) else ",".join(v) for k, v in options.items()}))
    opened = {n for p in reader.partitions() for n in p.names}
    held = {f["file"] for b in (1, 2) for f in listed(store, b)}
    assert opened == held if not options else opened < held


def listed(store, batch):
    return json.loads((store / "batches" / f"{batch:012d}.json").read_text())


@pytest.mark.parametrize(
    "condition", ["platform = 'legistar'", "source IN ('b', 'c')", "last_day >= '2024-02-01'", "last_day > '2024-02-02'", "last_day = '2024-02-02'", "first_day <= '2023-06-01'", "first_day < '2023-01-01'", "first_day = '2024-01-01'", "last_day IS NULL", "fetched_on > '2024-01-01'", "fetched_on <= '2024-01-01'", "source IN ('a', NULL)", "platform = 'legistar' AND platform = 'accela'", "length(answer) = 0", "platform <> 'legistar' OR last_day IS NULL"]
)
def test_filters_keep_the_rows_that_spark_keeps(spark, store, condition):
    kept = sorted(map(str, read(spark, store, True).where(condition).collect()))
    plain = spark.createDataFrame(read(spark, store).collect(), answers.SCHEMA)
    assert kept == sorted(map(str, plain.where(condition).collect()))


def test_a_batch_landed_twice_and_one_broken_off_leave_one_copy(spark, store):
    before = sorted(map(str, read(spark, store).collect()))
    files = sorted((store / "data").rglob("*.jsonl"))
    land(spark, store, 2, [("legistar", "again", None, None, None, "z")])
    (store / "data" / "000000000003").mkdir()
    (store / "data" / "000000000003" / "left.jsonl").write_text("half of an ans")
    (store / "batches" / "000000000003.part").write_text("[")
    assert sorted(map(str, read(spark, store).collect())) == before
    assert sorted((store / "data").glob("*2/*.jsonl")) == [f for f in files if f.parent.name.endswith("2")]
    with pytest.raises(Exception, match="only appended"):
        spark.createDataFrame([], answers.SCHEMA).write.format("civic_answers").option("path", str(store)).option("batch", 9).mode("overwrite").save()


def test_empty_batches_and_stores(spark, tmp_path):
    answers.register(spark)
    assert read(spark, tmp_path).count() == 0
    land(spark, tmp_path, 0, [])
    assert read(spark, tmp_path).count() == 0 and listed(tmp_path, 0) == []
    land(spark, tmp_path, 1, [(None, None, None, None, None, None)] * 2)
    assert read(spark, tmp_path).count() == 2


def test_files_are_closed_at_their_size_and_read_together(spark, tmp_path, monkeypatch):
    writer = answers.AnswerWriter(str(tmp_path), 4, False)
    monkeypatch.setattr(answers, "FILE_BYTES", 400)
    rows = [dict.fromkeys(answers.NAMES) | {"answer": str(i) * 50, "source": str(i)} for i in range(9)]
    writer.commit([writer.write(iter(rows)), None])
    assert all(f["bytes"] >= 400 for f in listed(tmp_path, 4)[:-1]) and len(listed(tmp_path, 4)) > 2
    reader = answers.AnswerReader(str(tmp_path))
    packs = reader.partitions()
    assert len(packs) > 1
    assert sorted(r[1] for p in packs for r in reader.read(p)) == [str(i) for i in range(9)]


def test_a_second_trigger_reads_only_new_answers(spark, store, tmp_path_factory):
    state, seen = tmp_path_factory.mktemp("state"), []

    def run():
        stream = spark.readStream.format("civic_answers").option("path", str(store)).load()
        write = lambda batch, n: seen.append(sorted(str(r.source) for r in batch.select("source").collect()))
        stream.writeStream.option("checkpointLocation", str(state)).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()

    run()
    assert sum(seen, []) == ["a", "a", "b", "c"]
    seen.clear()
    run()
    assert sum(seen, []) == []
    land(spark, store, 3, [("opengov", "new", None, None, None, "n")])
    run()
    assert sum(seen, []) == ["new"]
