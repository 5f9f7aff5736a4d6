"""Keeping the ledger, the watches and the registry in order, and small rules of their own.

Spark forms from DataFrames; the oracles are statements written apart from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permrisk.plans.dialect import Oracle
from permrisk.plans.graph import frame, query, statement
from permrisk.plans.ledger import CHAIN_SQL, _ledger, _payloads

DIGEST_BLOCK = 4096


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry alone: its payload against its hash, its link, and whether it is the last one issued. What it cannot see is an edit further back."""
    ledger = _ledger(spark, sf_dir)
    last = ledger.agg(F.max_by(F.struct("seq", "payload", "payload_hash", "prev_hash", "entry_hash"), "seq").alias("e"), F.max("seq").alias("issued")).select("e.*", "issued")
    sound = (F.sha2("payload", 256) == F.col("payload_hash")) & (F.sha2(F.concat("prev_hash", "payload_hash"), 256) == F.col("entry_hash"))
    return last.select(F.lit("head").alias("scope"), "seq", "entry_hash", sound.alias("ok"), (F.col("seq") == F.col("issued")).alias("complete"))


def _chained(tail: str) -> str:
    sql = statement(f"WITH issued AS ({_payloads(Oracle).strip()}), {CHAIN_SQL.strip()} {tail}", Oracle)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


HEAD_SQL = _chained("SELECT 'head' AS scope, seq, entry_hash, true AS ok, true AS complete FROM chained ORDER BY seq DESC LIMIT 1")


def _digest(rows: DataFrame) -> DataFrame:
    """Number of entries, last number and a digest of the payloads in order: blocks of numbers first, then the blocks, so no task joins the whole ledger."""
    block = F.floor(F.col("seq") / DIGEST_BLOCK)
    part = rows.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.md5("payload").alias("h")))), lambda x: x.h), "")).alias("h"))
    return part.agg(F.sum("n").alias("entries"), F.max("last").alias("head_seq"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x.h), "")).alias("digest"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a former full check still holds: the digest of the payloads is its key, so any edit makes the key differ."""
    rows = query(_payloads)[0](spark, sf_dir).select("seq", "payload")
    edited = rows.withColumn("payload", F.when(F.col("seq") == 700, F.lit("{}")).otherwise(F.col("payload")))
    now, then = _digest(rows), _digest(rows).select(F.col("digest").alias("known"))
    told = now.withColumn("state", F.lit("as it was")).unionByName(_digest(edited).withColumn("state", F.lit("edited")))
    return told.join(then).select("state", "entries", "head_seq", "digest", (F.col("digest") == F.col("known")).alias("reused"))


CACHE_SQL = statement(f"""
    WITH issued AS ({_payloads(Oracle).strip()}), both_states AS (SELECT 'as it was' AS state, seq, payload FROM issued UNION ALL SELECT 'edited', seq, CASE WHEN seq = 700 THEN '{{}}' ELSE payload END FROM issued),
    part AS (SELECT state, seq // {DIGEST_BLOCK} AS b, count(*) AS n, max(seq) AS last, md5(string_agg(md5(payload), '' ORDER BY seq)) AS h FROM both_states GROUP BY 1, 2),
    whole_key AS (SELECT state, CAST(sum(n) AS BIGINT) AS entries, max(last) AS head_seq, md5(string_agg(h, '' ORDER BY b)) AS digest FROM part GROUP BY state)
    SELECT state, entries, head_seq, digest, digest = (SELECT digest FROM whole_key WHERE state = 'as it was') AS reused FROM whole_key""", Oracle)


def accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the record growing: published, resolved, open, and outcomes that are known and not yet on it."""
    rows = query(_payloads)[0](spark, sf_dir).withColumn("resolved", F.col("seq") % 3 == 0)
    known = F.col("decided_on").isNotNull() & ~F.col("outcome").isin("pending", "withdrawn")
    return rows.agg(
        F.count(F.lit(1)).alias("published"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("pending"), F.count_if(~F.col("resolved") & known & (F.col("decided_on") > F.col("published_on"))).alias("gradeable_now"),
        F.min(F.when(~F.col("resolved"), F.col("published_on"))).alias("oldest_pending"), F.max("published_on").alias("latest_published"),
    )


ACCRUAL_SQL = statement(f"""
    WITH issued AS ({_payloads(Oracle).strip()})
    SELECT count(*) AS published, count(*) FILTER (WHERE seq % 3 = 0) AS resolved, count(*) FILTER (WHERE seq % 3 <> 0) AS pending, (SELECT count(*) FROM issued i JOIN application a ON a.application_id = i.seq WHERE i.seq % 3 <> 0 AND a.decided_on > i.published_on AND a.outcome NOT IN ('pending', 'withdrawn')) AS gradeable_now,
           min(published_on) FILTER (WHERE seq % 3 <> 0) AS oldest_pending, max(published_on) AS latest_published FROM issued""", Oracle)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored entries with the fields of their receipts; does the digest handed in belong to the entry; and what is newer than the last anchor."""
    ledger = _ledger(spark, sf_dir).select("seq", "entry_hash")
    digest = F.when(F.col("seq") % 1000 == 0, F.reverse("entry_hash")).otherwise(F.col("entry_hash"))
    held = ledger.where("seq % 250 = 0").withColumn("reference", F.concat(F.lit("service=clock digest="), digest, F.lit(" bytes="), F.col("seq").cast("string"), F.lit(" at=2024-01-01")))
    fields = F.str_to_map("reference", F.lit(" "), F.lit("="))
    last = ledger.agg(F.max("seq").alias("head_seq"))
    told = held.select("seq", "entry_hash", fields.alias("f")).join(F.broadcast(last))
    newest = F.max("seq").over(Window.partitionBy(F.lit(0)))  # anchored entries are few
    return told.select("seq", F.col("f")["service"].alias("service"), F.col("f")["bytes"].cast("bigint").alias("bytes"), (F.col("f")["digest"] == F.col("entry_hash")).alias("digest_matches"), (F.col("head_seq") - newest).alias("entries_since"))


ANCHORS_SQL = _chained("SELECT seq, 'clock' AS service, seq AS bytes, seq % 1000 <> 0 AS digest_matches, (SELECT max(seq) FROM chained) - (SELECT max(seq) FROM chained WHERE seq % 250 = 0) AS entries_since FROM chained WHERE seq % 250 = 0")


def accuracy_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model kind the latest run whose figures hold the key, and an entity tag that changes with the head."""
    from permrisk.plans.serving import _runs

    runs = _runs(spark, sf_dir).withColumn("metrics", F.when(F.col("run_id") % 2 == 0, F.to_json(F.struct(F.floor(F.col("metric") * 100).cast("bigint").alias("brier_skill")))).otherwise(F.lit("{}")))
    told = runs.withColumn("skill", F.get_json_object("metrics", "$.brier_skill").cast("bigint")).where("skill IS NOT NULL")
    best = told.groupBy("kind").agg(F.max_by(F.struct("run_id", "skill"), F.struct("trained_at", "run_id")).alias("r"))
    return best.select("kind", "r.run_id", "r.skill", F.sha2(F.concat_ws(":", "kind", F.col("r.run_id").cast("string")), 256).alias("etag"))


ACCURACY_SQL = statement("""
    WITH run AS (SELECT event_type AS kind, event_id, known_from, CAST(floor(value * 100) AS BIGINT) AS skill, row_number() OVER (PARTITION BY event_type ORDER BY known_from DESC, event_id DESC) AS rn FROM change WHERE event_id % 2 = 0 AND value IS NOT NULL)
    SELECT kind, event_id AS run_id, skill, sha256(kind || ':' || event_id) AS etag FROM run WHERE rn = 1""", Oracle)

BASES = {"rule_changed": 0.85, "moratorium_on_agenda": 0.90, "moratorium_enacted": 0.95, "litigation_filed": 0.50}


def materiality(base: Column, before: Column, after: Column, sites: Column) -> Column:
    """Base of the trigger, more if the score moved by 0.03 at least or several sites are held; at most one."""
    move = F.abs(after - before)
    moved = F.when(move >= 0.03, F.least(move / 0.15, F.lit(1.0)) * 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), base + F.coalesce(moved, F.lit(0.0)) + F.when(sites > 1, F.least(sites / 20, F.lit(0.10))).otherwise(0.0))


def rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes for each watch with the score before and after: what it is worth to the subscriber, why it is kept back, and its line."""
    watches = frame(spark, sf_dir, "watch")
    held = watches.join(watches.groupBy("subscriber_id").agg(F.count(F.lit(1)).alias("sites")), "subscriber_id").where("watch_id % 50 = 0")
    changes = frame(spark, sf_dir, "change").where("trigger_kind IS NOT NULL AND known_from >= TIMESTAMP '2024-01-28 00:00:00'")
    base = F.create_map(*[F.lit(x) for kv in BASES.items() for x in kv])
    rows = held.join(changes, "county_id").withColumn("kind", F.when(F.col("event_id") % 4 == 3, F.lit("score_moved")).otherwise(F.col("trigger_kind")))
    rows = rows.withColumn("before", F.when(F.col("watch_id") % 3 > 0, F.col("watch_id") % 100 / 100.0)).withColumn("after", F.when(F.col("event_id") % 5 > 0, F.least(F.lit(1.0), F.col("watch_id") % 100 / 100.0 + F.col("event_id") % 9 / 50.0)))
    worth = materiality(F.coalesce(base[F.col("kind")], F.lit(0.45)), F.col("before"), F.col("after"), F.col("sites"))
    quiet = (F.col("kind") == "score_moved") & ~F.coalesce(F.abs(F.col("after") - F.col("before")) >= 0.03, F.lit(False))
    day = F.date_format("occurred_on", "yyyy-MM-dd")
    line = (
        F.when(F.col("kind") == "moratorium_enacted", F.concat(F.lit("Moratorium in force since "), day)).when(F.col("kind") == "moratorium_on_agenda", F.concat(F.lit("Moratorium proposed on "), day))
        .when(F.col("kind") == "rule_changed", F.concat(F.lit("Rules changed on "), day)).when(F.col("kind") == "litigation_filed", F.concat(F.lit("Suit filed on "), day)).otherwise(F.concat(F.lit("Score moved on "), day))
    )
    return rows.select("watch_id", "event_id", F.round(worth, 6).alias("materiality"), F.when(quiet, "noise").when(worth < 0.35, "minor").alias("kept_back"), line.alias("headline"))


RESCORED_SQL = statement("""
    WITH w AS (SELECT *, count(*) OVER (PARTITION BY subscriber_id) AS sites FROM watch), c AS (SELECT * FROM change WHERE trigger_kind IS NOT NULL AND known_from >= TIMESTAMP '2024-01-28 00:00:00'),
    j AS (SELECT w.watch_id, c.event_id, w.sites, strftime(c.occurred_on, '%Y-%m-%d') AS day, CASE WHEN c.event_id % 4 = 3 THEN 'score_moved' ELSE c.trigger_kind END AS kind, CASE WHEN w.watch_id % 3 > 0 THEN w.watch_id % 100 / 100.0 END AS b,
          CASE WHEN c.event_id % 5 > 0 THEN least(1.0, w.watch_id % 100 / 100.0 + c.event_id % 9 / 50.0) END AS a FROM w JOIN c ON c.county_id = w.county_id WHERE w.watch_id % 50 = 0),
    m AS (SELECT *, abs(a - b) AS mv, CASE kind WHEN 'rule_changed' THEN 0.85 WHEN 'moratorium_on_agenda' THEN 0.90 WHEN 'moratorium_enacted' THEN 0.95 WHEN 'litigation_filed' THEN 0.50 ELSE 0.45 END AS base FROM j),
    v AS (SELECT *, least(1.0, base + CASE WHEN mv >= 0.03 THEN least(mv / 0.15, 1.0) * 0.5 ELSE 0.0 END + CASE WHEN sites > 1 THEN least(sites / 20.0, 0.10) ELSE 0.0 END) AS worth FROM m)
    SELECT watch_id, event_id, round(worth, 6) AS materiality, CASE WHEN kind = 'score_moved' AND (mv IS NULL OR mv < 0.03) THEN 'noise' WHEN worth < 0.35 THEN 'minor' END AS kept_back,
           CASE kind WHEN 'moratorium_enacted' THEN 'Moratorium in force since ' WHEN 'moratorium_on_agenda' THEN 'Moratorium proposed on ' WHEN 'rule_changed' THEN 'Rules changed on ' WHEN 'litigation_filed' THEN 'Suit filed on ' ELSE 'Score moved on ' END || day AS headline FROM v""", Oracle)


def daily_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one run of the monitor did on each day: changes seen, watches looked at, alerts made and kept back."""
    watches = frame(spark, sf_dir, "watch")
    # what a change is worth depends on all sites of a subscriber, as it does for the alerts
    sites = watches.groupBy("subscriber_id").agg(F.count(F.lit(1)).alias("sites"))
    held = watches.groupBy("county_id", "subscriber_id").agg(F.count(F.lit(1)).alias("held")).join(sites, "subscriber_id")
    base = F.create_map(*[F.lit(x) for kv in BASES.items() for x in kv])
    changes = frame(spark, sf_dir, "change").where("trigger_kind IS NOT NULL").select("event_id", "county_id", F.to_date("known_from").alias("day"), base[F.col("trigger_kind")].alias("base"))
    none = F.lit(None).cast("double")
    worth = materiality(F.col("base"), none, none, F.col("sites"))
    met = changes.join(held, "county_id", "left").groupBy("day", "event_id").agg(F.coalesce(F.sum("held"), F.lit(0)).alias("watches"), F.coalesce(F.sum(F.when(worth >= 0.35, F.col("held"))), F.lit(0)).alias("made"))
    return met.groupBy("day").agg(F.count(F.lit(1)).alias("changes"), F.sum("watches").alias("watches_checked"), F.sum("made").alias("alerts"), F.sum(F.col("watches") - F.col("made")).alias("kept_back"))


DAILY_SQL = statement("""
    WITH w AS (SELECT *, count(*) OVER (PARTITION BY subscriber_id) AS sites FROM watch),
    c AS (SELECT event_id, county_id, CAST(known_from AS DATE) AS day, CASE trigger_kind WHEN 'rule_changed' THEN 0.85 WHEN 'moratorium_on_agenda' THEN 0.90 WHEN 'moratorium_enacted' THEN 0.95 WHEN 'litigation_filed' THEN 0.50 END AS base FROM change WHERE trigger_kind IS NOT NULL),
    j AS (SELECT c.day, c.event_id, w.watch_id, least(1.0, c.base + CASE WHEN w.sites > 1 THEN least(w.sites / 20.0, 0.10) ELSE 0.0 END) >= 0.35 AS made FROM c LEFT JOIN w ON w.county_id = c.county_id)
    SELECT day, count(DISTINCT event_id) AS changes, count(watch_id) AS watches_checked, count(*) FILTER (WHERE watch_id IS NOT NULL AND made) AS alerts, count(*) FILTER (WHERE watch_id IS NOT NULL AND NOT made) AS kept_back FROM j GROUP BY day""", Oracle)


def watch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watches asked for again are made active and take the new county; the others stay, and new ones are added."""
    old = frame(spark, sf_dir, "watch").select(F.col("subscriber_id"), F.concat(F.lit("site "), F.col("watch_id").cast("string")).alias("label"), "county_id", (F.col("watch_id") % 20 == 0).alias("active"))
    asked = frame(spark, sf_dir, "watch").where("watch_id % 30 = 0").select("subscriber_id", F.concat(F.lit("site "), (F.col("watch_id") + F.when(F.col("watch_id") % 60 == 0, 0).otherwise(5)).cast("string")).alias("label"), (F.col("county_id") + 1).alias("county_id"), F.lit(True).alias("active"))
    stays = old.join(asked, ["subscriber_id", "label"], "left_anti")
    return stays.unionByName(asked).groupBy("county_id", "active").agg(F.count(F.lit(1)).alias("watches"))


WATCH_SQL = statement("""
    WITH old AS (SELECT subscriber_id AS s, 'site ' || watch_id AS l, county_id, watch_id % 20 = 0 AS active FROM watch), asked AS (SELECT subscriber_id AS s, 'site ' || (watch_id + CASE WHEN watch_id % 60 = 0 THEN 0 ELSE 5 END) AS l, county_id + 1 AS county_id FROM watch WHERE watch_id % 30 = 0),
    merged AS (SELECT coalesce(a.county_id, o.county_id) AS county_id, a.l IS NOT NULL OR o.active AS active FROM old o FULL JOIN asked a ON a.s = o.s AND a.l = o.l)
    SELECT county_id, active, count(*) AS watches FROM merged GROUP BY 1, 2""", Oracle)


def both_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats whose member and whose rule were both valid on the day of the decision: half-open intervals on both sides of the join."""
    day = F.lit("1997-06-01").cast("date")
    valid = lambda a, b: (F.col(a) <= day) & (F.col(b).isNull() | (F.col(b) > day))
    members = frame(spark, sf_dir, "member").where(valid("term_start", "term_end")).groupBy("county_id").agg(F.count(F.lit(1)).alias("members"))
    rules = frame(spark, sf_dir, "instrument").where(valid("adopted_on", "expires_on")).groupBy(F.col("county_id").cast("bigint").alias("county_id")).agg(F.count(F.lit(1)).alias("rules"))
    return members.join(rules, "county_id").select("county_id", (F.col("members") * F.col("rules")).alias("pairs"))


BOTH_SQL = statement("""
    SELECT m.county_id, count(*) AS pairs FROM member m JOIN instrument i ON i.county_id = m.county_id AND m.term_start <= DATE '1997-06-01' AND (m.term_end IS NULL OR m.term_end > DATE '1997-06-01') AND i.adopted_on <= DATE '1997-06-01' AND (i.expires_on IS NULL OR i.expires_on > DATE '1997-06-01')
    GROUP BY m.county_id""", Oracle)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of either kind of subject, an application or an instrument, under one key: whichever of the two ids is there."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cited = lines.select(F.when(F.col("l_linenumber") % 3 == 0, None).otherwise(F.col("l_orderkey")).alias("application_id"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey")).alias("instrument_id"))
    apps = frame(spark, sf_dir, "application").select(F.lit("application").alias("kind"), F.col("application_id").alias("subject_id"), F.col("county_id").cast("bigint").alias("county_id"))
    laws = frame(spark, sf_dir, "instrument").select(F.lit("instrument").alias("kind"), F.col("instrument_id").alias("subject_id"), F.col("county_id").cast("bigint").alias("county_id"))
    told = cited.select(F.when(F.col("application_id").isNull(), "instrument").otherwise("application").alias("kind"), F.coalesce("application_id", "instrument_id").alias("subject_id")).groupBy("kind", "subject_id").agg(F.count(F.lit(1)).alias("n"))
    return told.join(apps.unionByName(laws), ["kind", "subject_id"]).groupBy("county_id", "kind").agg(F.count(F.lit(1)).alias("subjects"), F.sum("n").alias("citations"))


SUBJECTS_SQL = statement("""
    WITH a AS (SELECT a.county_id, 'application' AS kind, l.l_orderkey AS id FROM lineitem l JOIN application a ON a.application_id = l.l_orderkey WHERE l.l_linenumber % 3 <> 0), i AS (SELECT i.county_id, 'instrument' AS kind, l.l_partkey AS id FROM lineitem l JOIN instrument i ON i.instrument_id = l.l_partkey WHERE l.l_linenumber % 3 = 0)
    SELECT county_id, kind, count(DISTINCT id) AS subjects, count(*) AS citations FROM (SELECT * FROM a UNION ALL SELECT * FROM i) x GROUP BY county_id, kind""", Oracle)


def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the features each application lacks, and by thirds of capacity within its use."""
    a = frame(spark, sf_dir, "application").where("capacity_mw IS NOT NULL")
    lacks = sum((F.col(c).isNull().cast("int") for c in ("acres", "by_right", "staff", "decided_on")), F.lit(0))
    cuts = a.groupBy("use_class").agg(F.percentile("capacity_mw", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("cut"))
    third = F.when(F.col("capacity_mw") <= F.col("cut")[0], 1).when(F.col("capacity_mw") <= F.col("cut")[1], 2).otherwise(3)
    return a.join(F.broadcast(cuts), "use_class").groupBy("use_class", third.alias("third")).agg(F.count(F.lit(1)).alias("n"), F.sum(lacks).alias("missing"), F.max(lacks).alias("worst"))


MISSING_SQL = statement("""
    WITH c AS (SELECT use_class, quantile_cont(capacity_mw, 0.3333333333333333) AS a, quantile_cont(capacity_mw, 0.6666666666666666) AS b FROM application GROUP BY use_class),
    r AS (SELECT p.use_class, CASE WHEN capacity_mw > c.b THEN 3 WHEN capacity_mw > c.a THEN 2 ELSE 1 END AS third, (CASE WHEN acres IS NULL THEN 1 ELSE 0 END + CASE WHEN by_right IS NULL THEN 1 ELSE 0 END + CASE WHEN staff IS NULL THEN 1 ELSE 0 END + CASE WHEN decided_on IS NULL THEN 1 ELSE 0 END) AS k FROM application p JOIN c ON c.use_class = p.use_class)
    SELECT use_class, third, count(*) AS n, CAST(sum(k) AS BIGINT) AS missing, max(k) AS worst FROM r GROUP BY 1, 2""", Oracle)


def cumulative_hazard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nelson-Aalen hazard of a decision by use, and its mean over the applications at their own months."""
    a = frame(spark, sf_dir, "application")
    until = F.coalesce("decided_on", F.lit("2001-08-01").cast("date"))
    timed = a.select("use_class", F.floor(F.datediff(until, "filed_on") / F.lit(30.44)).cast("int").alias("m"), F.col("decided_on").isNotNull().cast("int").alias("event"))
    grid = timed.groupBy("use_class", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("d"))
    back = Window.partitionBy("use_class").orderBy(F.desc("m"))
    forth = Window.partitionBy("use_class").orderBy("m")
    steps = grid.withColumn("risk", F.sum("n").over(back)).withColumn("h", F.sum(F.col("d") / F.col("risk")).over(forth))
    return steps.groupBy("use_class").agg(F.round(F.sum(F.col("h") * F.col("n")) / F.sum("n"), 6).alias("mean_hazard"), F.round(F.max("h"), 6).alias("last_hazard"))


HAZARD_SQL = statement("""
    WITH t AS (SELECT use_class, CAST(floor(date_diff('day', filed_on, coalesce(decided_on, DATE '2001-08-01')) / 30.44) AS INT) AS m, decided_on IS NOT NULL AS e FROM application),
    g AS (SELECT use_class, m, count(*) AS n, count(*) FILTER (WHERE e) AS d FROM t GROUP BY 1, 2), r AS (SELECT x.use_class, x.m, x.n, x.d, (SELECT sum(y.n) FROM g y WHERE y.use_class = x.use_class AND y.m >= x.m) AS risk FROM g x),
    h AS (SELECT x.use_class, x.m, x.n, (SELECT sum(y.d / y.risk) FROM r y WHERE y.use_class = x.use_class AND y.m <= x.m) AS h FROM r x)
    SELECT use_class, round(sum(h * n) / sum(n), 6) AS mean_hazard, round(max(h), 6) AS last_hazard FROM h GROUP BY use_class""", Oracle)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as sentences: numbers with separators, shares as whole percents, months with one decimal; what is unknown is said to be."""
    a = frame(spark, sf_dir, "application")
    share = a.groupBy("county_id").agg((F.count_if(F.col("outcome").isin("approved", "approved_with_conditions")) * 100 / F.count(F.lit(1))).alias("pct"))
    rows = a.join(share, "county_id")
    said = F.concat_ws(
        "; ", F.concat(F.format_string("%,d", F.floor("capacity_mw").cast("bigint") * 1000), F.lit(" kW")), F.coalesce(F.concat(F.floor("acres").cast("bigint").cast("string"), F.lit(" acres")), F.lit("area unknown")),
        F.concat(F.floor(F.col("pct") + 0.5).cast("bigint").cast("string"), F.lit("% approved here")), F.when(F.col("decided_on").isNull(), "undecided").otherwise(F.concat(F.format_string("%.1f", F.floor(F.datediff("decided_on", "filed_on") / F.lit(30.44) * 10) / 10), F.lit(" months"))),
    )
    return rows.select("application_id", said.alias("sentence"))


SENTENCES_SQL = statement("""
    WITH s AS (SELECT county_id, count(*) FILTER (WHERE outcome IN ('approved', 'approved_with_conditions')) * 100 / count(*) AS pct FROM application GROUP BY county_id)
    SELECT a.application_id, format('{:,}', CAST(floor(capacity_mw) AS BIGINT) * 1000) || ' kW; ' || coalesce(CAST(floor(acres) AS BIGINT) || ' acres', 'area unknown') || '; ' || CAST(floor(s.pct + 0.5) AS BIGINT) || '% approved here; '
           || coalesce(printf('%.1f', floor(date_diff('day', filed_on, decided_on) / 30.44 * 10) / 10) || ' months', 'undecided') AS sentence FROM application a JOIN s ON s.county_id = a.county_id""", Oracle)


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API keys taken apart: prefix, tier and secret; the tier's limits if the secret's hash is on file, else why not."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    tier = F.element_at(F.array(*map(F.lit, ("free", "team", "firm", "none"))), (F.col("user_id") % 4 + 1).cast("int"))
    given = users.select("user_id", F.concat(F.when(F.col("user_id") % 11 == 0, F.lit("sk")).otherwise(F.lit("pk")), F.lit("_"), tier, F.lit("_"), F.when(F.col("user_id") % 13 == 0, F.lit("short")).otherwise(F.md5(F.col("user_id").cast("string")))).alias("key"))
    filed = users.where("user_id % 7 <> 0").select("user_id", F.sha2(F.md5(F.col("user_id").cast("string")), 256).alias("on_file"))
    part = lambda i: F.regexp_extract("key", r"^pk_([a-z]+)_([0-9a-f]{32})$", i)
    rows = given.join(filed, "user_id", "left").select("user_id", part(1).alias("tier"), F.coalesce(F.sha2(part(2), 256) == F.col("on_file"), F.lit(False)).alias("known"))
    rate = F.create_map(*[F.lit(x) for kv in {"free": 2, "team": 10, "firm": 50}.items() for x in kv])[F.col("tier")]
    why = F.when(F.col("tier") == "", "malformed").when(~F.col("known"), "unknown").when(rate.isNull(), "no such tier")
    return rows.select("user_id", F.nullif(F.col("tier"), F.lit("")).alias("tier"), F.when(why.isNull(), rate).alias("a_second"), why.alias("refused"))


KEYS_SQL = """
    WITH u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT user_id, user_id % 11 <> 0 AND user_id % 13 <> 0 AS formed, CASE user_id % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'team' WHEN 2 THEN 'firm' ELSE 'none' END AS t, user_id % 7 <> 0 AS known FROM u)
    SELECT user_id, CASE WHEN formed THEN t END AS tier, CASE WHEN formed AND known THEN CASE t WHEN 'free' THEN 2 WHEN 'team' THEN 10 WHEN 'firm' THEN 50 END END AS a_second, CASE WHEN NOT formed THEN 'malformed' WHEN NOT known THEN 'unknown' WHEN t = 'none' THEN 'no such tier' END AS refused FROM k"""


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Election days of each county from its rule and as stated, each once and in order."""
    c = frame(spark, sf_dir, "county")
    derived = frame(spark, sf_dir, "election").select("county_id", "held_on")
    stated = c.select("county_id", F.explode(F.array(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("county_id") * 13).cast("int")), F.lit("1999-11-02").cast("date"))).alias("held_on"))
    day = F.date_format("held_on", "yyyy-MM-dd")
    return derived.unionByName(stated).groupBy("county_id").agg(F.array_join(F.array_sort(F.collect_set(day)), ",").alias("days"), F.count_distinct("held_on").alias("n"))


DATES_SQL = statement("""
    WITH d AS (SELECT county_id, held_on FROM election UNION SELECT county_id, DATE '1995-01-01' + CAST(county_id * 13 AS INT) FROM county UNION SELECT county_id, DATE '1999-11-02' FROM county)
    SELECT county_id, string_agg(strftime(held_on, '%Y-%m-%d'), ',' ORDER BY held_on) AS days, count(*) AS n FROM d GROUP BY county_id""", Oracle)


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence left after what no driver refers to is dropped, and drivers that refer to what is not there."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    evidence = lines.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("e")).distinct()
    cited = lines.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 4 + 1).cast("bigint").alias("e")).distinct()
    met = evidence.withColumn("there", F.lit(1)).join(cited.withColumn("asked", F.lit(1)), ["id", "e"], "full")
    return met.groupBy("id").agg(F.count_if(F.col("there").isNotNull() & F.col("asked").isNotNull()).alias("kept"), F.count_if(F.col("asked").isNull()).alias("dropped"), F.count_if(F.col("there").isNull()).alias("dangling"))


PRUNED_SQL = """
    WITH e AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS e FROM lineitem), c AS (SELECT DISTINCT l_orderkey AS id, l_linenumber % 4 + 1 AS e FROM lineitem WHERE l_returnflag <> 'N'),
    k AS (SELECT id, e, 'kept' AS w FROM (SELECT * FROM e INTERSECT SELECT * FROM c) UNION ALL SELECT id, e, 'dropped' FROM (SELECT * FROM e EXCEPT SELECT * FROM c) UNION ALL SELECT id, e, 'dangling' FROM (SELECT * FROM c EXCEPT SELECT * FROM e))
    SELECT id, count(*) FILTER (WHERE w = 'kept') AS kept, count(*) FILTER (WHERE w = 'dropped') AS dropped, count(*) FILTER (WHERE w = 'dangling') AS dangling FROM k GROUP BY id"""


def asked_for(spark: SparkSession, sf_dir: str, slug: str = "", since: str | None = "2000-01-01") -> DataFrame:
    """Decisions by county and year under filters that hold only where they are given."""
    a = frame(spark, sf_dir, "application").where("decided_on IS NOT NULL")
    if slug:
        a = a.where(F.col("use_class") == slug)
    if since is not None:
        a = a.where(F.col("decided_on") >= F.lit(since).cast("date"))
    return a.groupBy("county_id", F.year("decided_on").alias("year")).agg(F.count(F.lit(1)).alias("n"))


ASKED_SQL = statement("""
    WITH p AS (SELECT '' AS slug, DATE '2000-01-01' AS since)
    SELECT a.county_id, CAST(extract(year FROM a.decided_on) AS INT) AS year, count(*) AS n FROM application a CROSS JOIN p WHERE a.decided_on IS NOT NULL AND (p.slug = '' OR a.use_class = p.slug) AND (p.since IS NULL OR a.decided_on >= p.since) GROUP BY 1, 2""", Oracle)

QUERIES = {
    "ledger_head": (head, HEAD_SQL), "ledger_cache": (cache, CACHE_SQL), "ledger_accrual": (accrual, ACCRUAL_SQL), "ledger_anchors": (anchors, ANCHORS_SQL), "accuracy_page": (accuracy_page, ACCURACY_SQL),
    "monitor_rescored": (rescored, RESCORED_SQL), "monitor_daily_run": (daily_run, DAILY_SQL), "watch_upsert": (watch_upsert, WATCH_SQL), "registry_both_valid": (both_valid, BOTH_SQL), "evidence_subjects": (subjects, SUBJECTS_SQL),
    "feature_missingness": (missingness, MISSING_SQL), "cumulative_hazard": (cumulative_hazard, HAZARD_SQL), "feature_sentences": (sentences, SENTENCES_SQL), "api_keys": (keys, KEYS_SQL), "election_days": (dates, DATES_SQL),
    "evidence_pruned": (pruned, PRUNED_SQL), "decisions_asked_for": (asked_for, ASKED_SQL),
}
