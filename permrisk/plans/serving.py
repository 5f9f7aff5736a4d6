"""The kill test, which model serves, and what a published score must satisfy.

The Spark forms are built from DataFrames and share helpers with the other
plans; their oracles are statements of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.plans.dialect import Oracle
from permrisk.plans.evaluation import CUTOFF, OK, SETTLED, _base_rates, _shrunk, area_under_curve, coverage_bins, hazard_panel, panel, predicted
from permrisk.plans.graph import frame, query, statement
from permrisk.sources.scratch import fresh

APPROVALS = ("approved", "approved_with_conditions")
# fixed values: the gates and floors a verdict needs
LEAST_SKILL, MOST_ECE, COVERAGE, LEAST_AUC, LEAST_IMPROVEMENT = 0.15, 0.08, (0.76, 0.84), 0.70, 0.15
LEAST_DECIDED, LEAST_HELD, LEAST_DEEP, DEEP = 400, 60, 6, 5
THIN, POOLED, WIDE, PRIOR = 3, 0.8, 0.35, 4.0
STALE_FLAG, STALE_LIMIT = 14, 90


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = frame(spark, sf_dir, "application").where(~F.col("outcome").isin("pending", "withdrawn") & F.col("decided_on").isNotNull())
    return a.withColumn("y", F.col("outcome").isin(*APPROVALS).cast("double")).withColumn("staff", F.coalesce("staff", F.lit("none")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out decisions under each candidate: (model, application_id, y, p, lo, hi, reference, n_local).

    Candidates are rates by staff advice, and by staff advice and use, each shrunk to the level
    above; the reference is the base rate of county and use.
    """
    rows = _settled(spark, sf_dir)
    fit, held = rows.where(f"decided_on < {CUTOFF}"), rows.where(f"decided_on >= {CUTOFF}")
    whole = fit.agg(F.avg("y").alias("mu"))
    staff = fit.groupBy("staff").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).join(F.broadcast(whole)).select("staff", ((F.col("s") + PRIOR * F.col("mu")) / (F.col("n") + PRIOR)).alias("p_staff"), F.col("n").alias("n_staff"))
    both = fit.groupBy("staff", "use_class").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).join(staff, "staff")
    both = both.select("staff", "use_class", ((F.col("s") + PRIOR * F.col("p_staff")) / (F.col("n") + PRIOR)).alias("p_both"), F.col("n").alias("n_both"))
    local = fit.groupBy("county_id", "use_class").agg(F.count(F.lit(1)).alias("n_local"))
    reference = predicted(spark, sf_dir).select("application_id", F.col("probability").alias("reference"))
    # a decision held out may have been filed before the cutoff, where the base rate has the same value
    told = held.join(staff, "staff", "left").join(both, ["staff", "use_class"], "left").join(local, ["county_id", "use_class"], "left").join(whole)
    told = told.join(_reference(spark, sf_dir), ["county_id", "use_class"], "left").join(reference, "application_id", "left")
    p_staff = F.coalesce("p_staff", "mu")
    models = F.explode(F.array(
        F.struct(F.lit("staff").alias("model"), p_staff.alias("p"), F.coalesce("n_staff", F.lit(0)).alias("n")),
        F.struct(F.lit("staff and use").alias("model"), F.coalesce("p_both", p_staff).alias("p"), F.coalesce("n_both", F.lit(0)).alias("n")),
    ))
    out = told.select("application_id", "y", F.coalesce("reference", "p_cell", "mu").alias("reference"), F.coalesce("n_local", F.lit(0)).alias("n_local"), models.alias("m"))
    half = 1 / F.sqrt(F.col("m.n") + 2)
    return out.select(F.col("m.model").alias("model"), "application_id", "y", F.col("m.p").alias("p"), F.greatest(F.lit(0.0), F.col("m.p") - half).alias("lo"), F.least(F.lit(1.0), F.col("m.p") + half).alias("hi"), "reference", "n_local")


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base_rates(spark, sf_dir)[3].select("county_id", "use_class", F.col("p3").alias("p_cell"))


def judged(rows: DataFrame) -> DataFrame:
    """One row with the five figures of one model's held-out rows."""
    p, y = F.col("p"), F.col("y")
    square = (p - y) * (p - y)
    abstained = (F.col("n_local") < THIN) & (PRIOR / (PRIOR + F.col("n_local")) > POOLED) & (F.col("hi") - F.col("lo") > WIDE)
    bins = rows.groupBy(F.least(F.floor(p * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"), (1 - F.try_divide(F.avg(square), F.avg((F.col("reference") - y) * (F.col("reference") - y)))).alias("skill"), F.count_if(abstained).alias("n_abstained"),
        (1 - F.try_divide(F.avg(F.when(~abstained, square)), F.avg(F.when(abstained, square)))).alias("improvement"),
    )
    covered = coverage_bins(rows, "application_id").agg((F.avg(F.col("covered").cast("double"))).alias("coverage"), F.count(F.lit(1)).alias("groups"))
    ece = bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    return one.join(ece).join(area_under_curve(rows).select("auc")).join(covered).withColumn("coverage", F.when(F.floor(F.col("rows") / 8) >= 2, F.col("coverage")))


def kill_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, primary model, and the five gates, with rates by staff advice as candidates."""
    path = fresh(spark, "candidates")
    candidates(spark, sf_dir).write.parquet(path)
    return verdict(spark, sf_dir, spark.read.parquet(path), ["staff", "staff and use"])


def verdict(spark: SparkSession, sf_dir: str, rows: DataFrame, names: list[str]) -> DataFrame:
    """The kill test over candidates, as :func:`candidates` has them.

    The primary model is the best by skill, chosen before any gate is looked at. Too small a
    corpus gives INSUFFICIENT DATA whatever the gates say, and no figures.
    """
    every = None
    for name in names:
        one = judged(rows.where(F.col("model") == name)).withColumn("model", F.lit(name))
        every = one if every is None else every.unionByName(one)
    best = every.orderBy(F.desc_nulls_last(F.when(F.isnan("skill"), None).otherwise(F.col("skill"))), "model").limit(1)
    settled = _settled(spark, sf_dir)
    depth = settled.groupBy("county_id").count().agg(F.count_if(F.col("count") >= DEEP).alias("deep"))
    held = F.col("decided_on") >= F.expr(CUTOFF)
    counts = settled.agg(F.count(F.lit(1)).alias("decided"), F.count_if(held).alias("held"), F.count_if(~held).alias("fit"), F.count_distinct("y").alias("classes")).join(depth)
    enough = (F.col("decided") >= LEAST_DECIDED) & (F.col("held") >= LEAST_HELD) & (F.col("fit") >= LEAST_DECIDED - LEAST_HELD) & (F.col("deep") >= LEAST_DEEP) & (F.col("classes") > 1)
    gate = lambda name, value, passed: F.struct(F.lit(name).alias("gate"), value.alias("observed"), F.coalesce(passed, F.lit(False)).alias("passed"))
    gates = F.array(
        gate("skill", F.col("skill"), F.col("skill") >= LEAST_SKILL), gate("calibration", F.col("ece"), F.col("ece") < MOST_ECE), gate("coverage", F.col("coverage"), F.col("coverage").between(*COVERAGE)),
        gate("area", F.col("auc"), F.col("auc") > LEAST_AUC), gate("abstention", F.col("improvement"), (F.col("n_abstained") == 0) | (F.col("improvement") >= LEAST_IMPROVEMENT)),
    )
    told = best.join(counts).withColumn("gates", gates)
    outcome = F.when(~enough, "INSUFFICIENT DATA").when(F.forall("gates", lambda g: g.passed), "PASS").otherwise("FAIL")
    return told.select(outcome.alias("verdict"), F.when(enough, F.col("model")).alias("primary_model"), F.explode("gates").alias("g"), enough.alias("enough")).select(
        "verdict", "primary_model", "g.gate", F.when(F.col("enough"), F.round("g.observed", 5)).alias("observed"), F.when(F.col("enough"), F.col("g.passed")).alias("passed")
    )


KILL_SQL = statement(f"""
    WITH {_shrunk(Oracle).strip()},
    dec AS (SELECT application_id, county_id, use_class, filed_on, decided_on, coalesce(staff, 'none') AS staff, {OK} AS y FROM application WHERE {SETTLED} AND decided_on IS NOT NULL),
    fit AS (SELECT * FROM dec WHERE decided_on < {CUTOFF}), held AS (SELECT * FROM dec WHERE decided_on >= {CUTOFF}),
    mu AS (SELECT avg(y) AS m FROM fit),
    s1 AS (SELECT staff, count(*) AS n, (sum(y) + 4 * (SELECT m FROM mu)) / (count(*) + 4) AS p FROM fit GROUP BY staff),
    s2 AS (SELECT f.staff, f.use_class, count(*) AS n, (sum(f.y) + 4 * any_value(s1.p)) / (count(*) + 4) AS p FROM fit f JOIN s1 ON s1.staff = f.staff GROUP BY f.staff, f.use_class),
    loc AS (SELECT county_id, use_class, count(*) AS n FROM fit GROUP BY county_id, use_class),
    refs AS (SELECT a.application_id, round(coalesce(p3.p, p2.p, p1.p, w.mu), 6) AS r FROM application a JOIN county c ON c.county_id = a.county_id CROSS JOIN whole w LEFT JOIN p1 ON p1.use_class = a.use_class
             LEFT JOIN p2 ON p2.region_id = c.region_id AND p2.use_class = a.use_class LEFT JOIN p3 ON p3.county_id = a.county_id AND p3.use_class = a.use_class WHERE a.filed_on >= {CUTOFF}),
    told AS (SELECT h.application_id, h.y, coalesce(r.r, p3.p, (SELECT m FROM mu)) AS ref, coalesce(l.n, 0) AS nl, coalesce(s1.p, (SELECT m FROM mu)) AS a, coalesce(s1.n, 0) AS na, coalesce(s2.p, s1.p, (SELECT m FROM mu)) AS b, coalesce(s2.n, 0) AS nb
             FROM held h LEFT JOIN s1 ON s1.staff = h.staff LEFT JOIN s2 ON s2.staff = h.staff AND s2.use_class = h.use_class LEFT JOIN loc l ON l.county_id = h.county_id AND l.use_class = h.use_class
             LEFT JOIN refs r ON r.application_id = h.application_id LEFT JOIN p3 ON p3.county_id = h.county_id AND p3.use_class = h.use_class),
    both_models AS (SELECT 'staff' AS model, application_id, y, ref, nl, a AS p, na AS n FROM told UNION ALL SELECT 'staff and use', application_id, y, ref, nl, b, nb FROM told),
    iv AS (SELECT *, greatest(0.0, p - 1 / sqrt(n + 2)) AS lo, least(1.0, p + 1 / sqrt(n + 2)) AS hi FROM both_models),
    flagged AS (SELECT *, (p - y) * (p - y) AS sq, nl < 3 AND 4.0 / (4 + nl) > 0.8 AND hi - lo > 0.35 AS ab FROM iv),
    base AS (SELECT model, count(*) AS n, 1 - avg(sq) / nullif(avg((ref - y) * (ref - y)), 0) AS skill, count(*) FILTER (WHERE ab) AS nab, 1 - avg(sq) FILTER (WHERE NOT ab) / nullif(avg(sq) FILTER (WHERE ab), 0) AS imp FROM flagged GROUP BY model),
    bins AS (SELECT model, least(floor(p * 10), 9) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM flagged GROUP BY 1, 2), cal AS (SELECT model, sum(n * gap) / sum(n) AS ece FROM bins GROUP BY model),
    rk AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS r FROM flagged),
    roc AS (SELECT model, (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / nullif(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0), 0) AS auc FROM rk GROUP BY model),
    seat AS (SELECT model, y, lo, hi, row_number() OVER (PARTITION BY model ORDER BY (lo + hi) / 2, application_id) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM flagged),
    grp AS (SELECT *, greatest(1, least(12, n // 8)) AS k FROM seat),
    grp2 AS (SELECT *, CASE WHEN i < (n % k) * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - (n % k) * (n // k + 1)) // (n // k) END AS g FROM grp),
    cov AS (SELECT model, g, count(*) AS n, avg(y) BETWEEN avg(lo) AND avg(hi) AS c FROM grp2 GROUP BY model, g HAVING count(*) >= 8), covered AS (SELECT model, avg(CASE WHEN c THEN 1.0 ELSE 0.0 END) AS coverage FROM cov GROUP BY model),
    every AS (SELECT b.*, c.ece, r.auc, v.coverage FROM base b JOIN cal c ON c.model = b.model JOIN roc r ON r.model = b.model LEFT JOIN covered v ON v.model = b.model),
    best AS (SELECT * FROM every ORDER BY skill DESC NULLS LAST, model LIMIT 1),
    size AS (SELECT (SELECT count(*) FROM dec) >= 400 AND (SELECT count(*) FROM held) >= 60 AND (SELECT count(*) FROM fit) >= 340 AND (SELECT count(*) FROM (SELECT county_id FROM dec GROUP BY county_id HAVING count(*) >= 5) t) >= 6 AND (SELECT count(DISTINCT y) FROM dec) > 1 AS ok),
    gates AS (SELECT 'skill' AS gate, skill AS o, coalesce(skill >= 0.15, false) AS ok FROM best UNION ALL SELECT 'calibration', ece, coalesce(ece < 0.08, false) FROM best UNION ALL SELECT 'coverage', coverage, coalesce(coverage BETWEEN 0.76 AND 0.84, false) FROM best
              UNION ALL SELECT 'area', auc, coalesce(auc > 0.70, false) FROM best UNION ALL SELECT 'abstention', imp, coalesce(nab = 0 OR imp >= 0.15, false) FROM best)
    SELECT CASE WHEN NOT s.ok THEN 'INSUFFICIENT DATA' WHEN (SELECT bool_and(ok) FROM gates) THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN s.ok THEN (SELECT model FROM best) END AS primary_model, g.gate,
           CASE WHEN s.ok THEN round(g.o, 5) END AS observed, CASE WHEN s.ok THEN g.ok END AS passed FROM gates g CROSS JOIN size s""", Oracle)


def serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which model serves each region: the hierarchical one if it converged on forty rows of both outcomes, boosted trees on both outcomes, else the base rate; nothing is served without a decision."""
    rows = _settled(spark, sf_dir).where(f"decided_on < {CUTOFF}")
    regions = frame(spark, sf_dir, "county").select("county_id", "region_id")
    # every third region's chains are taken not to have converged
    state = regions.join(rows, "county_id", "left").groupBy("region_id").agg(F.count("application_id").alias("n"), F.count_distinct("y").alias("classes")).withColumn("converged", F.col("region_id") % 3 != 1)
    both, deep = F.col("classes") > 1, F.col("n") >= 40
    kind = F.when(F.col("n") == 0, None).when(both & deep & F.col("converged"), "hierarchical").when(both, "gradient_boosted").otherwise("base_rate")
    note = F.when(F.col("n") == 0, "nothing is trained").when(~both, "one outcome only").when(~deep, "too few rows to pool").when(~F.col("converged"), "chains did not converge")
    return state.select("region_id", "n", "classes", kind.alias("kind"), note.alias("note"))


SERVING_SQL = statement(f"""
    WITH fit AS (SELECT county_id, {OK} AS y FROM application WHERE {SETTLED} AND decided_on < {CUTOFF}),
    state AS (SELECT c.region_id, count(f.y) AS n, count(DISTINCT f.y) AS classes FROM county c LEFT JOIN fit f ON f.county_id = c.county_id GROUP BY c.region_id)
    SELECT region_id, n, classes, CASE WHEN n = 0 THEN NULL WHEN classes < 2 THEN 'base_rate' WHEN n < 40 OR region_id % 3 = 1 THEN 'gradient_boosted' ELSE 'hierarchical' END AS kind,
           CASE WHEN n = 0 THEN 'nothing is trained' WHEN classes < 2 THEN 'one outcome only' WHEN n < 40 THEN 'too few rows to pool' WHEN region_id % 3 = 1 THEN 'chains did not converge' END AS note FROM state""", Oracle)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded fits: a kind, a version, a hash of the data, when, and whether the run was then promoted."""
    e = frame(spark, sf_dir, "change")
    return e.select(F.col("event_type").alias("kind"), (F.col("event_id") % 4).cast("string").alias("version"), (F.col("event_id") % 7).cast("string").alias("dataset_hash"), F.col("known_from").alias("trained_at"), F.col("event_id").alias("run_id"), F.col("value").alias("metric"), (F.col("event_id") % 3 == 0).alias("promote"))


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs upserted on (kind, version, data): the row keeps its first number and takes everything else from the latest fit."""
    latest = F.struct("trained_at", "run_id")
    return _runs(spark, sf_dir).groupBy("kind", "version", "dataset_hash").agg(F.min("run_id").alias("run_id"), F.max("trained_at").alias("trained_at"), F.round(F.max_by("metric", latest), 6).alias("metric"), F.count(F.lit(1)).alias("fits"))


MODEL_RUNS_SQL = statement("""
    WITH run AS (SELECT event_type AS kind, CAST(event_id % 4 AS VARCHAR) AS version, CAST(event_id % 7 AS VARCHAR) AS dataset_hash, known_from, event_id, value FROM change),
    placed AS (SELECT *, row_number() OVER (PARTITION BY kind, version, dataset_hash ORDER BY known_from DESC, event_id DESC) AS rn, min(event_id) OVER w AS first_id, count(*) OVER w AS fits FROM run WINDOW w AS (PARTITION BY kind, version, dataset_hash))
    SELECT kind, version, dataset_hash, first_id AS run_id, known_from AS trained_at, round(value, 6) AS metric, fits FROM placed WHERE rn = 1""", Oracle)


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of a kind serves at a time: each promotion retires the one before it; (kind, version, data) with its times."""
    from pyspark.sql import Window

    w = Window.partitionBy("kind").orderBy("trained_at", "run_id")
    told = _runs(spark, sf_dir).where("promote").withColumn("retired_at", F.lead("trained_at").over(w))
    latest = F.struct("trained_at", "run_id")
    return told.groupBy("kind", "version", "dataset_hash").agg(F.max("trained_at").alias("promoted_at"), F.max_by("retired_at", latest).alias("retired_at"))


PROMOTIONS_SQL = statement("""
    WITH run AS (SELECT event_type AS kind, CAST(event_id % 4 AS VARCHAR) AS version, CAST(event_id % 7 AS VARCHAR) AS dataset_hash, known_from, event_id FROM change WHERE event_id % 3 = 0),
    seen AS (SELECT a.*, row_number() OVER (PARTITION BY kind ORDER BY known_from, event_id) AS i FROM run a),
    closed AS (SELECT a.*, b.known_from AS retired FROM seen a LEFT JOIN seen b ON b.kind = a.kind AND b.i = a.i + 1),
    last AS (SELECT *, row_number() OVER (PARTITION BY kind, version, dataset_hash ORDER BY i DESC) AS rn FROM closed)
    SELECT kind, version, dataset_hash, known_from AS promoted_at, retired AS retired_at FROM last WHERE rn = 1""", Oracle)


def _per_mille(c) -> Column:
    return F.floor(c * 1000 + 0.5).cast("bigint")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published form of each pending application: reason or probability with interval, months to a decision, chance of a rule change before it, hash of what went in, and the payload."""
    found = frame_abstention(spark, sf_dir)
    a = frame(spark, sf_dir, "application").where("outcome = 'pending'")
    months = frame(spark, sf_dir, "application").where("decided_on IS NOT NULL").groupBy("use_class").agg(F.percentile(F.datediff("decided_on", "filed_on") / F.lit(30.44), F.lit(0.5)).alias("median"))
    hazard = panel(spark, sf_dir).agg(F.try_divide(F.count_if("event"), F.count(F.lit(1))).alias("h"))
    rows = a.join(found, "application_id").join(months, "use_class", "left").join(F.broadcast(hazard))
    rows = rows.withColumn("p10", _per_mille(F.col("median") * 0.42)).withColumn("p50", _per_mille(F.col("median"))).withColumn("p90", _per_mille(F.col("median") * 2.35))
    rows = rows.withColumn("change", _per_mille(1 - F.pow(1 - F.col("h"), F.col("p50") / 1000)))
    features = F.to_json(F.struct(_per_mille(F.col("acres")).alias("acres"), "by_right", _per_mille(F.col("capacity_mw")).alias("capacity_mw"), "staff"))
    rows = rows.withColumn("features_hash", F.sha2(features, 256))
    payload = F.to_json(F.struct(
        F.col("abstained"), F.col("reason").alias("abstention_reason"), "features_hash", F.when(~F.col("abstained"), _per_mille(F.col("high"))).alias("high"), F.when(~F.col("abstained"), _per_mille(F.col("low"))).alias("low"),
        F.struct("p10", "p50", "p90").alias("months"), F.when(~F.col("abstained"), _per_mille(F.col("p"))).alias("probability"), F.col("change").alias("rule_change"), "use_class",
    ))
    return rows.select("application_id", "features_hash", payload.alias("payload"))


def frame_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending applications with p, low, high and the reason of an abstention."""
    from permrisk.plans.score import REASON, _scored

    return query(lambda d: f"WITH {_scored(d).strip()} SELECT application_id, {REASON} AS reason, {REASON} IS NOT NULL AS abstained, p, low, high FROM ready")[0](spark, sf_dir)


def _scores_sql() -> str:
    from permrisk.plans.score import REASON, _scored

    pm = lambda x: f"CAST(floor({x} * 1000 + 0.5) AS BIGINT)"
    # the JSON writer of Spark leaves out what is null
    item = lambda key, x, quoted=False: f"""CASE WHEN {x} IS NULL THEN '' ELSE ',"{key}":' || {"'" + '"' + "' || " + x + " || '" + '"' + "'" if quoted else f"CAST({x} AS VARCHAR)"} END"""
    return statement(f"""
    WITH {_scored(Oracle).strip()},
    told AS (SELECT application_id, {REASON} AS reason, p, low, high FROM ready),
    typical AS (SELECT use_class, quantile_cont(date_diff('day', filed_on, decided_on) / 30.44, 0.5) AS m FROM application WHERE decided_on IS NOT NULL GROUP BY use_class),
    panel AS ({hazard_panel(Oracle).strip()}), pooled AS (SELECT count(*) FILTER (WHERE event) / count(*) AS h FROM panel),
    whole_row AS (SELECT a.*, t.reason, CASE WHEN t.reason IS NULL THEN {pm('t.p')} END AS pr, CASE WHEN t.reason IS NULL THEN {pm('t.low')} END AS lo, CASE WHEN t.reason IS NULL THEN {pm('t.high')} END AS hi,
                  {pm('y.m * 0.42')} AS p10, {pm('y.m')} AS p50, {pm('y.m * 2.35')} AS p90, o.h, {pm('a.acres')} AS ac, {pm('a.capacity_mw')} AS mw
                  FROM application a JOIN told t ON t.application_id = a.application_id LEFT JOIN typical y ON y.use_class = a.use_class CROSS JOIN pooled o),
    hashed AS (SELECT *, {pm('(1 - pow(1 - h, p50 / 1000))')} AS ch,
               sha256('{{' || ltrim({item('acres', 'ac')} || {item('by_right', 'by_right')} || {item('capacity_mw', 'mw')} || {item('staff', 'staff', True)}, ',') || '}}') AS fh FROM whole_row)
    SELECT application_id, fh AS features_hash, '{{"abstained":' || CAST(reason IS NOT NULL AS VARCHAR) || {item('abstention_reason', 'reason', True)} || ',"features_hash":"' || fh || '"' || {item('high', 'hi')} || {item('low', 'lo')}
           || ',"months":{{"p10":' || p10 || ',"p50":' || p50 || ',"p90":' || p90 || '}}' || {item('probability', 'pr')} || ',"rule_change":' || ch || ',"use_class":"' || use_class || '"}}' AS payload FROM hashed""", Oracle)


PAYLOAD = "abstained boolean, abstention_reason string, features_hash string, high bigint, low bigint, months struct<p10:bigint,p50:bigint,p90:bigint>, probability bigint, rule_change bigint, use_class string"


def rehydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payloads read back into columns, with the line that is shown for each."""
    rows = scores(spark, sf_dir).select("application_id", F.from_json("payload", PAYLOAD).alias("s")).select("application_id", "s.*")
    percent = lambda c: F.concat(F.floor((c + 5) / 10).cast("string"), F.lit("%"))
    line = F.when(F.col("abstained"), "no estimate").otherwise(F.concat(percent(F.col("probability")), F.lit(" ("), percent(F.col("low")), F.lit(" to "), percent(F.col("high")), F.lit(")")))
    return rows.select("application_id", "abstained", "abstention_reason", "probability", "low", "high", F.col("months.p50").alias("p50"), line.alias("headline"))


def _rehydrated_sql() -> str:
    from permrisk.plans.score import REASON, _scored

    pm = lambda x: f"CAST(floor({x} * 1000 + 0.5) AS BIGINT)"
    return statement(f"""
    WITH {_scored(Oracle).strip()},
    typical AS (SELECT use_class, quantile_cont(date_diff('day', filed_on, decided_on) / 30.44, 0.5) AS m FROM application WHERE decided_on IS NOT NULL GROUP BY use_class),
    told AS (SELECT r.application_id, {REASON} AS reason, {pm('r.p')} AS p, {pm('r.low')} AS low, {pm('r.high')} AS high, {pm('t.m')} AS p50 FROM ready r LEFT JOIN typical t ON t.use_class = r.use_class)
    SELECT application_id, reason IS NOT NULL AS abstained, reason AS abstention_reason, CASE WHEN reason IS NULL THEN p END AS probability, CASE WHEN reason IS NULL THEN low END AS low, CASE WHEN reason IS NULL THEN high END AS high, p50,
           CASE WHEN reason IS NOT NULL THEN 'no estimate' ELSE ((p + 5) // 10) || '% (' || ((low + 5) // 10) || '% to ' || ((high + 5) // 10) || '%)' END AS headline FROM told""", Oracle)


def invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stored scores break: rows are spoilt by their id, and each rule finds its own."""
    s = scores(spark, sf_dir).select("application_id", F.from_json("payload", PAYLOAD).alias("s")).select("application_id", "s.*")
    i = F.col("application_id")
    s = s.withColumn("probability", F.when(i % 17 == 0, F.lit(500)).when(i % 23 == 0, None).otherwise(F.col("probability")))
    s = s.withColumn("low", F.when(i % 19 == 0, F.col("high") + 1).otherwise(F.col("low"))).withColumn("reason", F.when(i % 29 == 0, None).otherwise(F.col("abstention_reason")))
    s = s.withColumn("p10", F.when(i % 31 == 0, F.col("months.p50") + 1).otherwise(F.col("months.p10")))
    cited = frame(spark, sf_dir, "evidence").groupBy(F.col("application_id")).agg(F.count(F.lit(1)).alias("attached"), F.count_if(~F.col("verified")).alias("unverified"))
    s = s.join(cited, "application_id", "left").withColumn("driver_cites", F.when(i % 5 == 0, F.col("attached") + 1).otherwise(F.col("attached")))
    p, low, high = F.col("probability"), F.col("low"), F.col("high")
    rules = {
        "abstention with a probability": F.col("abstained") & p.isNotNull(), "abstention without a reason": F.col("abstained") & F.col("reason").isNull(), "answer without a probability": ~F.col("abstained") & p.isNull(),
        "interval inverted": low > high, "estimate outside its interval": (low <= high) & ~p.between(low, high), "quantiles out of order": ~((F.col("p10") <= F.col("months.p50")) & (F.col("months.p50") <= F.col("months.p90"))),
        "driver cites what is not attached": F.col("driver_cites") > F.col("attached"), "unverified evidence": F.col("unverified") > 0,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return s.select("application_id", F.explode(broken).alias("rule"))


def _invariants_sql() -> str:
    from permrisk.plans.score import REASON, _scored

    pm = lambda x: f"CAST(floor({x} * 1000 + 0.5) AS BIGINT)"
    return statement(f"""
    WITH {_scored(Oracle).strip()},
    typical AS (SELECT use_class, quantile_cont(date_diff('day', filed_on, decided_on) / 30.44, 0.5) AS m FROM application WHERE decided_on IS NOT NULL GROUP BY use_class),
    told AS (SELECT r.application_id AS i, {REASON} AS why, {pm('r.p')} AS p0, {pm('r.low')} AS l0, {pm('r.high')} AS h0, {pm('t.m * 0.42')} AS q1, {pm('t.m')} AS q2, {pm('t.m * 2.35')} AS q3 FROM ready r LEFT JOIN typical t ON t.use_class = r.use_class),
    spoilt AS (SELECT i, why IS NOT NULL AS ab, CASE WHEN i % 29 = 0 THEN NULL ELSE why END AS why, CASE WHEN i % 17 = 0 THEN 500 WHEN i % 23 = 0 THEN NULL WHEN why IS NULL THEN p0 END AS p, CASE WHEN why IS NOT NULL THEN NULL WHEN i % 19 = 0 THEN h0 + 1 ELSE l0 END AS l,
               CASE WHEN why IS NULL THEN h0 END AS h, CASE WHEN i % 31 = 0 THEN q2 + 1 ELSE q1 END AS q1, q2, q3 FROM told),
    cites AS (SELECT application_id, count(*) AS n, count(*) FILTER (WHERE NOT verified) AS bad FROM evidence GROUP BY application_id)
    SELECT i AS application_id, 'abstention with a probability' AS rule FROM spoilt WHERE ab AND p IS NOT NULL UNION ALL SELECT i, 'abstention without a reason' FROM spoilt WHERE ab AND why IS NULL UNION ALL SELECT i, 'answer without a probability' FROM spoilt WHERE NOT ab AND p IS NULL
    UNION ALL SELECT i, 'interval inverted' FROM spoilt WHERE l > h UNION ALL SELECT i, 'estimate outside its interval' FROM spoilt WHERE l <= h AND (p < l OR p > h) UNION ALL SELECT i, 'quantiles out of order' FROM spoilt WHERE q1 > q2 OR q2 > q3
    UNION ALL SELECT s.i, 'driver cites what is not attached' FROM spoilt s JOIN cites c ON c.application_id = s.i WHERE s.i % 5 = 0 UNION ALL SELECT s.i, 'unverified evidence' FROM spoilt s JOIN cites c ON c.application_id = s.i WHERE c.bad > 0""", Oracle)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason of an abstention is given, and the sentence shown with it."""
    found = frame_abstention(spark, sf_dir).where("abstained")
    text = (
        F.when(F.col("reason") == "unresolved_jurisdiction_chain", "It is not known who decides here.").when(F.col("reason") == "degenerate_training_corpus", "All known decisions went one way.")
        .when(F.col("reason") == "stale_jurisdiction_data", "The county's data are too old.").otherwise("The local record is too thin to estimate from.")
    )
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn("notice", text)


def _notices_sql() -> str:
    from permrisk.plans.score import REASON, _scored

    return statement(f"""
    WITH {_scored(Oracle).strip()},
    words AS (SELECT * FROM (VALUES ('unresolved_jurisdiction_chain', 'It is not known who decides here.'), ('degenerate_training_corpus', 'All known decisions went one way.'), ('stale_jurisdiction_data', 'The county''s data are too old.'),
              ('thin_local_record', 'The local record is too thin to estimate from.')) w(reason, notice)),
    told AS (SELECT {REASON} AS reason FROM ready)
    SELECT t.reason, count(*) AS n, any_value(w.notice) AS notice FROM told t JOIN words w ON w.reason = t.reason GROUP BY t.reason""", Oracle)


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the training set by version of their snapshot, and why others are left out; each rule is counted on its own.

    The join has no date: two snapshots of one application are two rows.
    """
    a = frame(spark, sf_dir, "application")
    verified = frame(spark, sf_dir, "verified").withColumn("is_verified", F.lit(True))
    snapshots = a.where("application_id % 2 = 0").select("application_id", F.explode(F.when(F.col("application_id") % 6 == 0, F.array(F.lit("v1"), F.lit("v2"), F.lit("v2"))).otherwise(F.array(F.lit("v2")))).alias("version"))
    rows = a.join(snapshots, "application_id", "left").join(verified, "application_id", "left")
    known = F.coalesce("is_verified", F.lit(False))
    undated = F.col("decided_on").isNull() & ~F.col("outcome").isin("pending")
    return rows.groupBy(F.coalesce("version", F.lit("none")).alias("version")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~known).alias("unverified"), F.count_if(undated).alias("undated"), F.count_if(F.col("outcome") == "withdrawn").alias("withdrawn"),
        F.count_if(F.col("decided_on") < F.col("filed_on")).alias("out_of_order"), F.count_if(known & ~undated & ~F.coalesce(F.col("decided_on") < F.col("filed_on"), F.lit(False))).alias("kept"),
    )


EXCLUSIONS_SQL = statement("""
    WITH snap AS (SELECT application_id, 'v2' AS version FROM application WHERE application_id % 2 = 0 UNION ALL SELECT application_id, v FROM application, (VALUES ('v1'), ('v2')) t(v) WHERE application_id % 6 = 0),
    joined AS (SELECT coalesce(s.version, 'none') AS version, a.*, EXISTS (SELECT 1 FROM evidence e WHERE e.application_id = a.application_id AND e.verified) AS ok FROM application a LEFT JOIN snap s ON s.application_id = a.application_id)
    SELECT version, count(*) AS rows, count(*) FILTER (WHERE NOT ok) AS unverified, count(*) FILTER (WHERE decided_on IS NULL AND outcome <> 'pending') AS undated, count(*) FILTER (WHERE outcome = 'withdrawn') AS withdrawn,
           count(*) FILTER (WHERE decided_on < filed_on) AS out_of_order, count(*) FILTER (WHERE ok AND NOT (decided_on IS NULL AND outcome <> 'pending') AND NOT coalesce(decided_on < filed_on, false)) AS kept FROM joined GROUP BY version""", Oracle)

QUERIES = {
    "kill_test": (kill_test, KILL_SQL), "serving_choice": (serving, SERVING_SQL), "model_runs": (model_runs, MODEL_RUNS_SQL), "model_promotions": (promotions, PROMOTIONS_SQL), "score_payloads": (scores, _scores_sql()),
    "score_rehydrated": (rehydrated, _rehydrated_sql()), "score_invariants": (invariants, _invariants_sql()), "abstention_notices": (notices, _notices_sql()), "dataset_exclusions": (exclusions, EXCLUSIONS_SQL),
}
