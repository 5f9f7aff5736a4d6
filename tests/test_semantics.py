"""Closed forms, leakage, tampering and odd input."""

import datetime as dt
import hashlib
import math

from pyspark.sql import functions as F

from permrisk.functions import text as T
from permrisk.operators.asof import look_up, moments, running
from permrisk.plans import ledger, models, quality, text
from permrisk.streaming import changes


def test_running_state_cannot_see_the_day_or_what_follows(spark):
    day = lambda n: dt.date(2021, 1, n)
    facts = spark.createDataFrame([("a", day(1), 1), ("a", day(3), 2), ("a", None, 9), ("b", day(2), 5)], "k string, d date, x int")
    subjects = spark.createDataFrame([(1, "a", day(1)), (2, "a", day(3)), (3, "a", day(9)), (4, "c", day(9)), (5, None, day(9))], "id int, k string, t date")

    def totals(rows):
        state = running(rows, ["k"], "d", {"x": F.col("x")}, {"last": F.max("d")}, moments(subjects, ["k"], F.col("t")))
        return {r.id: (r.x, r.last) for r in look_up(subjects, state, ["k"], F.col("t"), "d", "", ["x", "last"]).collect()}

    before = totals(facts)
    assert before == {1: (0, None), 2: (1, day(1)), 3: (3, day(3)), 4: (0, None), 5: (None, None)}
    later = spark.createDataFrame([("a", dt.date(2025, 1, 1), 100), ("c", dt.date(2025, 1, 1), 100)], "k string, d date, x int")
    assert totals(facts.unionByName(later)) == before


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_normalisers(spark):
    assert one(spark, T.relief, "Rezoning and special use permit") == ["rezoning", "special_use_permit"]
    assert one(spark, T.relief, "") == []
    assert one(spark, T.outcome, "Approved after being denied") == "denied"
    assert one(spark, T.outcome, "approved with conditions") == "approved_with_conditions"
    assert one(spark, T.use_class, "church") is None
    assert tuple(one(spark, T.vote, " 4 to 1 ")) == (4, 1, 0)
    assert one(spark, T.vote, "unanimous") is None
    assert one(spark, T.organisation, "Ridgeline Holdings, L.L.C.") == one(spark, T.organisation, "Ridgeline Holdings LLC") == "ridgeline"
    assert one(spark, T.organisation, "St. Louis Partners") == "st louis"
    assert one(spark, T.body, "the Board") == ""
    assert one(spark, T.body, "BZA") == "board of zoning appeals"
    assert tuple(one(spark, T.person, "Supervisor J. Smith")) == ("smith", "j smith")
    assert one(spark, T.single_purpose, "Pageland 3 LLC") is True
    assert one(spark, T.civic_date, "someday") is None
    assert one(spark, T.collapsed, "a  b\n c .") == "a b c."
    assert one(spark, T.clock, "3725000") == "1:02:05"
    for column in (T.relief, T.outcome, T.vote, T.body, T.legibility, T.civic_date):
        one(spark, column, None)


def test_trigram_similarity(spark):
    r = spark.createDataFrame([("word", "two words")], "a string, b string").select(T.similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert abs(r.s - 4 / 11) < 1e-9


def test_general_election(spark):
    days = [r.d for r in spark.createDataFrame([(2016,), (2022,), (2023,), (2027,)], "y int").select(T.general_election(F.col("y")).alias("d")).collect()]
    assert days == [dt.date(2016, 11, 8), dt.date(2022, 11, 8), dt.date(2023, 11, 7), dt.date(2027, 11, 2)]


def test_ledger_shows_edits_relinks_and_losses(spark):
    made = ledger.chain(spark.createDataFrame([(i, f'{{"i":{i}}}') for i in range(20)], "seq bigint, payload string"))
    check = lambda df, n=19: ledger.verified(df, n).first()
    assert check(made).first_break is None and check(made).complete
    assert check(made.withColumn("payload", F.when(F.col("seq") == 7, "x").otherwise(F.col("payload")))).first_break == 7
    assert check(made.where("seq <> 7")).first_break == 8
    assert not check(made.where("seq < 19")).complete
    relinked = made.withColumn("payload_hash", F.when(F.col("seq") == 7, F.sha2(F.lit("x"), 256)).otherwise(F.col("payload_hash"))).withColumn("payload", F.when(F.col("seq") == 7, "x").otherwise(F.col("payload")))
    assert check(relinked).first_break == 7
    assert check(made.limit(0)).entries == 0


def test_ledger_chain_in_batches_is_one_chain(spark):
    made = ledger.chain(spark.createDataFrame([(i, f'{{"i":{i}}}') for i in reversed(range(50))], "seq bigint, payload string").repartition(5), batch=7)
    prev = ledger.GENESIS
    rows = sorted(made.collect())
    assert [r.seq for r in rows] == list(range(50))
    for r in rows:
        assert r.payload_hash == hashlib.sha256(r.payload.encode()).hexdigest() and r.prev_hash == prev
        prev = hashlib.sha256((prev + r.payload_hash).encode()).hexdigest()
        assert r.entry_hash == prev
    assert ledger.chain(spark.createDataFrame([], "seq bigint, payload string")).count() == 0


def test_ledger_queries_take_all_applications(spark, sf):
    from permrisk.plans.registry import QUERIES

    applications = spark.read.parquet(f"{sf}/orders.parquet").count()
    run = lambda name: QUERIES[f"ledger_{name}"][0](spark, sf)
    assert applications > 1000
    assert run("chain").count() == run("verify").first().entries == run("public_record").first().published == applications
    assert run("tampered").first().entries == applications - 1
    assert sum(r.n for r in run("daily_digest").collect()) == applications
    assert run("grades").agg(F.max("seq")).first()[0] >= 1000 and run("resolvable").agg(F.max("seq")).first()[0] >= 1000


def test_streams_lose_nothing_of_many_files_in_mixed_order(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    # the first file has the latest events, and values are negative
    rows = [(i, start + dt.timedelta(hours=(i * 7) % 240, minutes=i % 60), i % 50, ("click", "view")[i % 2], -1.0 * i) for i in range(240)]
    rows.sort(key=lambda r: r[1], reverse=True)
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(12):
        part = spark.createDataFrame(rows[k * 20 : k * 20 + 20], "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").coalesce(1)
        part.write.mode("overwrite").parquet(str(tmp_path / f"part-{k}"))
        next((tmp_path / f"part-{k}").glob("part-*.parquet")).rename(folder / f"part-{k:02d}.parquet")
    want = {}
    for _, ts, _, kind, value in rows:
        n, total = want.get((ts.replace(minute=0), kind), (0, 0.0))
        want[ts.replace(minute=0), kind] = (n + 1, total + value)
    assert {(r.hour, r.event_type): (r.n, r.total) for r in changes.window_counts(spark, str(tmp_path)).collect()} == want
    watched = {r[2] % 25 for r in rows if r[2] % 10 == 0}
    assert sorted(r.event_id for r in changes.change_stream(spark, str(tmp_path)).collect()) == sorted(r[0] for r in rows if r[3] != "view" and r[2] % 25 in watched)


def test_nearest_home_is_found_however_far(spark):
    sites = spark.createDataFrame([(1, -78.0, 38.0), (2, -76.03, 39.96), (3, -77.5, 38.5)], "site_id bigint, x double, y double")
    homes = spark.createDataFrame([(1, -77.99, 38.01), (2, -77.0, 39.0)], "home_id bigint, x double, y double")

    def far(a, b):
        (ax, ay), (bx, by) = (tuple(map(math.radians, p)) for p in (a, b))
        return 6371008.8 * 2 * math.asin(math.sqrt(math.sin((by - ay) / 2) ** 2 + math.cos(ay) * math.cos(by) * math.sin((bx - ax) / 2) ** 2))

    want = {s.site_id: min(far((s.x, s.y), (h.x, h.y)) for h in homes.collect()) for s in sites.collect()}
    got = {r.site_id: r for r in text.nearest_home(sites, homes).collect()}
    assert {k: r.distance_m for k, r in got.items()} == {k: round(m, 2) for k, m in want.items()}
    assert {k: r.within_8km for k, r in got.items()} == {1: 1, 2: 0, 3: 0}
    assert [(r.distance_m, r.within_8km) for r in text.nearest_home(sites, homes.limit(0)).collect()] == [(None, 0)] * 3


def test_ids_are_taken_from_the_whole_tables(spark, tmp_path):
    from permrisk.plans.registry import QUERIES

    spark.createDataFrame([(5, "Red ring"), (4000, "red Ring"), (4001, "x")], "p_partkey bigint, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(5,), (4000,), (9000,)], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    labels = QUERIES["registry_label_ids"][0](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, labels)) == [(5, "red-ring"), (4000, "red-ring-2"), (4001, "x")]
    assert sorted(map(tuple, QUERIES["quality_ids_twice"][0](spark, str(tmp_path)).collect())) == [(5, 2), (4000, 2)]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d"), (None, "m")], "k int, v string")
    assert sorted(quality.upsert(old, new.distinct(), ["k"]).collect(), key=str) == sorted([(1, "a"), (2, "c"), (3, "d"), (None, "m")], key=str)
    assert sorted(quality.insert_new(old, new, ["k"]).collect(), key=str) == sorted([(1, "a"), (2, "b"), (None, "n"), (3, "d")], key=str)


def test_platt_declines_on_few_rows_or_one_class(spark):
    few = spark.createDataFrame([(0.5, 1), (0.2, 0)], "p double, y int")
    assert models.platt(few) == (1.0, 0.0)
    same = spark.createDataFrame([(i / 40, 1) for i in range(40)], "p double, y int")
    assert models.platt(same) == (1.0, 0.0)


def test_hierarchical_converges_and_orders_its_interval(spark, sf):
    rows = models.hierarchical(spark, "/root/testdata/sf0.01").collect()
    assert all(r.p10 <= r.probability <= r.p90 and r.r_hat < 1.1 for r in rows)


def test_incidence_is_monotone_and_bounded(spark, sf):
    from permrisk.plans.registry import QUERIES

    rows = sorted(QUERIES["model_incidence"][0](spark, sf).collect())
    for name in ("approval", "denial", "withdrawal"):
        assert all(a[name] <= b[name] + 1e-9 for a, b in zip(rows, rows[1:]))
    assert all(r.approval + r.denial + r.withdrawal <= 1 + 1e-6 for r in rows)


def test_in_force_meets_every_day_between_start_and_end(spark):
    from permrisk.operators.intervals import in_force

    day = lambda m, d: dt.date(2021, m, d)
    facts = spark.createDataFrame([("a", day(1, 5), day(3, 2), 1), ("a", day(2, 1), None, 7), ("a", day(2, 1), day(2, 1), 99), ("a", None, day(9, 9), 50), ("b", day(1, 1), day(1, 2), 3)], "k string, f date, t date, x int")
    asked = [("a", day(1, 4)), ("a", day(1, 5)), ("a", day(1, 31)), ("a", day(2, 1)), ("a", day(3, 1)), ("a", day(3, 2)), ("b", day(1, 2)), ("c", day(1, 2))]
    got = {(r.k, r.day): (r.hi, r.lo) for r in in_force(spark.createDataFrame(asked, "k string, day date"), facts, ["k"], "f", "t", most={"hi": F.col("x")}, least={"lo": F.col("x")}).collect()}
    assert got == {("a", day(1, 4)): (None, None), ("a", day(1, 5)): (1, 1), ("a", day(1, 31)): (1, 1), ("a", day(2, 1)): (7, 1), ("a", day(3, 1)): (7, 1), ("a", day(3, 2)): (7, 7), ("b", day(1, 2)): (None, None), ("c", day(1, 2)): (None, None)}


def test_running_total_in_two_levels(spark):
    from permrisk.operators.ranks import running_total

    rows = [(i, (i * 7919 % 1000) / 1000.0, i % 5) for i in range(500)] + [(900, 0.0, 3), (901, 1.0, 4)]
    got = {r.id: r.t for r in running_total(spark.createDataFrame(rows, "id int, p double, n int"), F.col("p"), [F.col("id")], F.col("n"), "t").collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        assert got[i] == total
        total += n


def test_chunks_keep_headings_and_merge_what_is_short():
    from permrisk.plans.documents import cut_chunks

    body = "words of the record\n" * 20
    text = f"SECTION 1. Purpose\n{body}ITEM 2\n\nSECTION 3. Scope\n{body}"
    got = cut_chunks(text)
    assert [text[a:b].split("\n")[0] for a, b, _ in got] == ["SECTION 1. Purpose", "ITEM 2"] and got[-1][1] == len(text)
    assert got[1][2] == "ITEM 2"
    long = "SECTION 1. Purpose\n" + (("x" * 90 + "\n") * 30 + "\n") * 8
    pieces = cut_chunks(long)
    assert len(pieces) > 2 and all(h == "SECTION 1. Purpose" for _, _, h in pieces) and [a for a, _, _ in pieces[1:]] == [b for _, b, _ in pieces[:-1]]
    assert cut_chunks("") == [] and cut_chunks("\n \n") == []


def test_abstention_rules_in_order_and_strict(spark):
    from permrisk.plans.score import REASON

    rows = [
        (1, False, 1, 400, 0, 1.0, 1.0, "unresolved_jurisdiction_chain"), (2, True, 1, 400, 0, 1.0, 1.0, "degenerate_training_corpus"), (3, True, 2, 91, 9, 0.0, 0.0, "stale_jurisdiction_data"), (4, True, 2, 90, 2, 0.81, 0.36, "thin_local_record"),
        (5, True, 2, 90, 2, 0.8, 0.36, None), (6, True, 2, None, 2, 0.81, 0.35, None), (7, True, 2, 14, 3, 0.9, 0.9, None),
    ]
    df = spark.createDataFrame(rows, "id int, resolved boolean, classes int, stale_days int, n int, pooling double, width double, want string")
    assert all(r.got == r.want for r in df.selectExpr("want", f"{REASON} AS got").collect())
