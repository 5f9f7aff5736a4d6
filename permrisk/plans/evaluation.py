"""Base rates, the hazard panel, metrics and gates of the evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.operators.asof import look_up, moments, running
from permrisk.operators.ranks import running_total
from permrisk.plans.graph import frame, query

CUTOFF = "DATE '1999-01-01'"
SETTLED = "outcome NOT IN ('pending', 'withdrawn')"
OK = "CASE WHEN outcome IN ('approved', 'approved_with_conditions') THEN 1.0 ELSE 0.0 END"


def base_rate_levels(d):
    """Tallies of all levels in one pass over the rows."""
    return f"""
    SELECT a.county_id, c.region_id, a.use_class, CAST(count(*) AS BIGINT) AS n, CAST(sum({OK}) AS BIGINT) AS approvals
    FROM application a JOIN county c ON c.county_id = a.county_id WHERE {SETTLED}
    GROUP BY GROUPING SETS ((a.county_id, c.region_id, a.use_class), (c.region_id, a.use_class), (a.use_class), ())"""


def _shrunk(d):
    return f"""
    cell AS (SELECT a.county_id, c.region_id, a.use_class, count(*) AS n, sum({OK}) AS s FROM application a JOIN county c ON c.county_id = a.county_id
             WHERE {SETTLED} AND a.decided_on < {CUTOFF} GROUP BY a.county_id, c.region_id, a.use_class),
    reg AS (SELECT region_id, use_class, sum(n) AS n, sum(s) AS s FROM cell GROUP BY region_id, use_class),
    usage AS (SELECT use_class, sum(n) AS n, sum(s) AS s FROM cell GROUP BY use_class),
    whole AS (SELECT sum(s) / sum(n) AS mu FROM cell),
    strength AS (SELECT w.mu, CASE WHEN count(c.n) < 3 THEN 4.0 WHEN coalesce(var_samp(c.s / c.n), 0) <= w.mu * (1 - w.mu) / avg(c.n) THEN 50.0
                        ELSE greatest(0.5, least(50.0, w.mu * (1 - w.mu) / var_samp(c.s / c.n) - 1)) END AS k
                 FROM whole w LEFT JOIN cell c ON c.n >= 5 GROUP BY w.mu),
    p1 AS (SELECT u.use_class, (u.s + s.mu * s.k) / (u.n + s.k) AS p, s.k FROM usage u CROSS JOIN strength s),
    p2 AS (SELECT r.region_id, r.use_class, (r.s + p1.p * p1.k) / (r.n + p1.k) AS p FROM reg r JOIN p1 ON p1.use_class = r.use_class),
    p3 AS (SELECT c.county_id, c.use_class, c.n, (c.s + p2.p * p1.k) / (c.n + p1.k) AS p, p1.k / (p1.k + c.n) AS pooling
           FROM cell c JOIN p2 ON p2.region_id = c.region_id AND p2.use_class = c.use_class JOIN p1 ON p1.use_class = c.use_class)"""


def base_rate_predict(d):
    """Three levels, each shrunk to the one above; a missing cell falls back to the next level."""
    return f"""
    WITH {_shrunk(d).strip()}
    SELECT a.application_id, round(coalesce(p3.p, p2.p, p1.p, w.mu), 6) AS probability, round(coalesce(p3.pooling, 1.0), 6) AS pooling_weight, CAST(coalesce(p3.n, 0) AS BIGINT) AS n_local,
           round(greatest(0.0, coalesce(p3.p, p2.p, p1.p, w.mu) - 1 / sqrt(coalesce(p3.n, 0) + 2)), 6) AS low, round(least(1.0, coalesce(p3.p, p2.p, p1.p, w.mu) + 1 / sqrt(coalesce(p3.n, 0) + 2)), 6) AS high
    FROM application a JOIN county c ON c.county_id = a.county_id CROSS JOIN whole w
    LEFT JOIN p1 ON p1.use_class = a.use_class LEFT JOIN p2 ON p2.region_id = c.region_id AND p2.use_class = a.use_class LEFT JOIN p3 ON p3.county_id = a.county_id AND p3.use_class = a.use_class
    WHERE a.filed_on >= {CUTOFF}"""


def hazard_panel(d):
    """A row for each county and month at risk of its first restriction, with what is known at its start."""
    return f"""
    WITH first AS (SELECT county_id, min(adopted_on) AS on_day FROM instrument WHERE kind = 'moratorium' AND adopted_on >= DATE '1996-06-01' GROUP BY county_id),
    spine AS (SELECT county_id, region_id, month FROM {d.months('county', "DATE '1995-06-01'", "DATE '2001-06-01'", 'month')}),
    risk AS (SELECT s.*, f.on_day FROM spine s LEFT JOIN first f ON f.county_id = s.county_id WHERE f.on_day IS NULL OR s.month <= {d.month('f.on_day')}),
    monthly AS (SELECT county_id, {d.month('observed_on')} AS m, count(*) AS n FROM objection GROUP BY county_id, {d.month('observed_on')}),
    filings AS (SELECT county_id, {d.month('filed_on')} AS m, count(*) AS n FROM application GROUP BY county_id, {d.month('filed_on')}),
    objections_24 AS (SELECT r.county_id, r.month, sum(x.n) AS n FROM risk r JOIN monthly x ON x.county_id = r.county_id AND x.m < r.month AND x.m >= {d.add_months('r.month', -24)} GROUP BY r.county_id, r.month),
    filings_24 AS (SELECT r.county_id, r.month, sum(x.n) AS n FROM risk r JOIN filings x ON x.county_id = r.county_id AND x.m < r.month AND x.m >= {d.add_months('r.month', -24)} GROUP BY r.county_id, r.month),
    near AS (SELECT r.county_id, r.month, count(DISTINCT j.neighbour_id) AS n FROM risk r JOIN adjacency j ON j.county_id = r.county_id JOIN first f ON f.county_id = j.neighbour_id AND f.on_day < r.month GROUP BY r.county_id, r.month),
    vote_on AS (SELECT r.county_id, r.month, min(e.held_on) AS held_on FROM risk r JOIN election e ON e.county_id = r.county_id AND e.held_on >= r.month GROUP BY r.county_id, r.month)
    SELECT r.county_id, r.month, r.on_day IS NOT NULL AND {d.month('r.on_day')} = r.month AS event, CAST(coalesce(n.n, 0) AS BIGINT) AS neighbours_restricted,
           CAST(coalesce(o.n, 0) AS BIGINT) AS objections_24m, CAST(coalesce(f.n, 0) AS BIGINT) AS filings_24m, round(coalesce(o.n, 0) / nullif(CAST(f.n AS DOUBLE), 0), 6) AS objection_pressure,
           coalesce({d.days('v.held_on', 'r.month')} / 30.44 <= 12, false) AS election_within_12m
    FROM risk r LEFT JOIN objections_24 o ON o.county_id = r.county_id AND o.month = r.month LEFT JOIN filings_24 f ON f.county_id = r.county_id AND f.month = r.month
    LEFT JOIN near n ON n.county_id = r.county_id AND n.month = r.month LEFT JOIN vote_on v ON v.county_id = r.county_id AND v.month = r.month"""


def area_under_curve(rows: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row with the rank form of the area, ties counted half, and the numbers of both classes; null on one class."""
    tied = rows.groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("pos"))
    ranked = running_total(tied, F.col("p"), [], F.col("n"), "below")
    sums = ranked.agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("ranks"), F.sum("pos").cast("double").alias("pos"), F.sum("n").cast("double").alias("n"))
    return sums.select(F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos"))).alias("auc"), "pos", "n")


def proper_scores(rows: DataFrame, reference: Column | None = None) -> list:
    """Aggregates of p, y, lo and hi: Brier score, its reference, log loss and strict coverage."""
    p, y = F.col("p").cast("double"), F.col("y").cast("double")
    clip = lambda x: F.log(F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), x)))
    rate = F.col("rate") if reference is None else reference
    return [
        F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg((rate - y) * (rate - y)).alias("reference"), (-F.avg(y * clip(p) + (1 - y) * clip(1 - p))).alias("log_loss"),
        F.avg(F.when(F.col("y") == 1, F.col("hi") >= 0.5).otherwise(F.col("lo") <= 0.5).cast("double")).alias("coverage"),
    ]


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proper scores and coverage in one pass, and the area under the curve without one task that orders all scores."""
    rows = frame(spark, sf_dir, "scored")
    rate = rows.agg(F.avg(F.col("y").cast("double")).alias("rate"))
    one = rows.join(F.broadcast(rate)).agg(*proper_scores(rows)).join(area_under_curve(rows).select("auc"))
    return one.select(
        "n", F.round("brier", 6).alias("brier"), F.round(1 - F.try_divide("brier", "reference"), 6).alias("brier_skill"), F.round("log_loss", 6).alias("log_loss"), F.round("auc", 6).alias("auc"), F.round("coverage", 6).alias("coverage")
    )


def _metrics(d):
    """Proper scores and coverage in one pass; the rank form of the area under the curve gives ties half."""
    return """
    WITH tied AS (SELECT p, count(*) AS n, count(*) FILTER (WHERE y = 1) AS pos FROM scored GROUP BY p),
    ranked AS (SELECT *, sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM tied),
    auc AS (SELECT (sum(pos * (coalesce(below, 0) + (n + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / nullif(CAST(sum(pos) AS DOUBLE) * (sum(n) - sum(pos)), 0) AS auc FROM ranked),
    base AS (SELECT avg(CAST(y AS DOUBLE)) AS rate FROM scored),
    one AS (SELECT avg((p - y) * (p - y)) AS brier, avg((b.rate - y) * (b.rate - y)) AS reference,
                   -avg(y * ln(greatest(1e-12, least(1 - 1e-12, CAST(p AS DOUBLE)))) + (1 - y) * ln(greatest(1e-12, least(1 - 1e-12, 1 - CAST(p AS DOUBLE))))) AS log_loss,
                   avg(CASE WHEN (CASE WHEN y = 1 THEN hi >= 0.5 ELSE lo <= 0.5 END) THEN 1.0 ELSE 0.0 END) AS coverage, count(*) AS n FROM scored CROSS JOIN base b)
    SELECT n, round(CAST(brier AS DOUBLE), 6) AS brier, round(1 - CAST(brier AS DOUBLE) / nullif(CAST(reference AS DOUBLE), 0), 6) AS brier_skill, round(CAST(log_loss AS DOUBLE), 6) AS log_loss, round(CAST(auc AS DOUBLE), 6) AS auc,
           round(CAST(coverage AS DOUBLE), 6) AS coverage FROM one CROSS JOIN auc"""


def reliability(d):
    """Ten equal bins, the last closed; empty bins stay, with their midpoint."""
    bins = " UNION ALL ".join(f"SELECT {i} AS bin" for i in range(10))
    return f"""
    WITH spine AS ({bins}), got AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(CAST(p AS DOUBLE)) AS predicted, avg(CAST(y AS DOUBLE)) AS observed FROM scored GROUP BY 1)
    SELECT s.bin, coalesce(g.n, 0) AS n, round(coalesce(g.predicted, (s.bin + 0.5) / 10), 6) AS predicted, round(coalesce(g.observed, 0.0), 6) AS observed FROM spine s LEFT JOIN got g ON g.bin = s.bin"""


def calibration_error(d):
    return """
    WITH got AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(CAST(p AS DOUBLE)) AS predicted, avg(CAST(y AS DOUBLE)) AS observed FROM scored GROUP BY 1)
    SELECT round(sum(n * abs(predicted - observed)) / sum(n), 6) AS ece, round(max(abs(predicted - observed)), 6) AS mce,
           bool_and(n < 5 OR abs(predicted - observed) <= 0.10) AS worst_bin_within FROM got"""


def coverage_bins(rows: DataFrame, key: str) -> DataFrame:
    """Equal-count groups by interval midpoint; the groups with the remainder come first. Groups under eight rows are dropped."""
    size = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.greatest(F.lit(1), F.least(F.lit(12), F.floor(F.col("n") / 8))))
    placed = running_total(rows, (F.col("lo") + F.col("hi")) / 2, [F.col(key)], F.lit(1), "i").join(F.broadcast(size))
    n, k, i = F.col("n"), F.col("k"), F.col("i")
    small, extra = F.floor(n / k), n % k
    group = F.when(i < extra * (small + 1), F.floor(i / (small + 1))).otherwise(extra + F.floor((i - extra * (small + 1)) / small))
    y = F.avg(F.col("y").cast("double"))
    return placed.groupBy(group.cast("bigint").alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), F.round(y, 6).alias("observed"), F.round(F.avg("lo"), 6).alias("low"), F.round(F.avg("hi"), 6).alias("high"), y.between(F.avg("lo"), F.avg("hi")).alias("covered")
    ).where("n >= 8")


def binned_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "scored")
    return coverage_bins(rows.select("doc_id", "y", F.col("lo").cast("double"), F.col("hi").cast("double")), "doc_id")


def _binned_coverage(d):
    """Equal-count groups by interval midpoint; the groups with the remainder come first."""
    return """
    WITH size AS (SELECT greatest(1, least(12, CAST(floor(count(*) / 8.0) AS INT))) AS k, count(*) AS n FROM scored),
    placed AS (SELECT s.*, row_number() OVER (ORDER BY (lo + hi) / 2, doc_id) - 1 AS i, z.k, z.n FROM scored s CROSS JOIN size z),
    grouped AS (SELECT *, CASE WHEN i < (n % k) * (floor(n / k) + 1) THEN floor(i / (floor(n / k) + 1)) ELSE n % k + floor((i - (n % k) * (floor(n / k) + 1)) / floor(n / k)) END AS g FROM placed)
    SELECT CAST(g AS BIGINT) AS grp, count(*) AS n, round(avg(CAST(y AS DOUBLE)), 6) AS observed, round(CAST(avg(lo) AS DOUBLE), 6) AS low, round(CAST(avg(hi) AS DOUBLE), 6) AS high,
           avg(CAST(y AS DOUBLE)) BETWEEN avg(lo) AND avg(hi) AS covered FROM grouped GROUP BY g HAVING count(*) >= 8"""


def wilson(d):
    z = 1.96
    return f"""
    WITH cell AS (SELECT county_id, count(*) AS n, sum({OK}) AS s FROM application WHERE {SETTLED} GROUP BY county_id),
    every AS (SELECT c.county_id, coalesce(x.n, 0) AS n, CAST(coalesce(x.s, 0) AS DOUBLE) AS s FROM county c LEFT JOIN cell x ON x.county_id = c.county_id)
    SELECT county_id, n, CASE WHEN n = 0 THEN 0.0 ELSE round((s / n + {z * z / 2} / n - {z} * sqrt(s / n * (1 - s / n) / n + {z * z / 4} / n / n)) / (1 + {z * z} / n), 6) END AS low,
           CASE WHEN n = 0 THEN 1.0 ELSE round((s / n + {z * z / 2} / n + {z} * sqrt(s / n * (1 - s / n) / n + {z * z / 4} / n / n)) / (1 + {z * z} / n), 6) END AS high FROM every"""


def abstention_precision(d):
    return """
    WITH marked AS (SELECT y, CAST(p AS DOUBLE) AS p, (hi - lo > 0.6 OR doc_id % 5 = 0) AS held FROM scored)
    SELECT count(*) FILTER (WHERE held) AS n_abstained, count(*) FILTER (WHERE NOT held) AS n_answered, round(avg((p - y) * (p - y)) FILTER (WHERE held), 6) AS brier_abstained,
           round(avg((p - y) * (p - y)) FILTER (WHERE NOT held), 6) AS brier_answered,
           round(1 - avg((p - y) * (p - y)) FILTER (WHERE NOT held) / nullif(avg((p - y) * (p - y)) FILTER (WHERE held), 0), 6) AS improvement FROM marked"""


def residual_notes(d):
    return """
    WITH place AS (SELECT source, count(*) AS n, avg(CAST(y - p AS DOUBLE)) AS bias FROM scored GROUP BY source),
    worst AS (SELECT *, row_number() OVER (ORDER BY abs(bias) DESC, source) AS rn FROM place WHERE n >= 3),
    band AS (SELECT CASE WHEN p >= 0.7 THEN 'high' WHEN p <= 0.3 THEN 'low' END AS band, count(*) AS n, avg(CAST(p AS DOUBLE)) - avg(CAST(y AS DOUBLE)) AS gap FROM scored WHERE p >= 0.7 OR p <= 0.3 GROUP BY 1)
    SELECT 'worst source' AS note, source AS subject, n, round(bias, 6) AS size FROM worst WHERE rn = 1 AND abs(bias) > 0.15
    UNION ALL SELECT 'band', band, n, round(gap, 6) FROM band WHERE n >= 5 AND abs(gap) > 0.12"""


def sufficiency(d):
    """What keeps the test from running, one row for each blocker."""
    return f"""
    WITH counted AS (SELECT count(*) AS n, count(*) FILTER (WHERE decided_on >= {CUTOFF}) AS held, count(*) FILTER (WHERE decided_on < {CUTOFF}) AS fit, count(DISTINCT {OK}) AS classes FROM application WHERE {SETTLED}),
    deep AS (SELECT count(*) AS n FROM (SELECT county_id FROM application WHERE {SETTLED} GROUP BY county_id HAVING count(*) >= 5) x)
    SELECT rule, have, need, have >= need AS met FROM (
        SELECT 'decisions' AS rule, n AS have, 400 AS need FROM counted UNION ALL SELECT 'held out', held, 60 FROM counted UNION ALL SELECT 'to fit on', fit, 340 FROM counted
        UNION ALL SELECT 'counties with five', n, 6 FROM deep UNION ALL SELECT 'outcomes', classes, 2 FROM counted) r"""


def temporal_split(d):
    return f"""
    SELECT application_id, CASE WHEN decided_on < {CUTOFF} THEN 'train' ELSE 'test' END AS part, county_id AS fold FROM application WHERE {SETTLED} AND decided_on IS NOT NULL"""


def coverage_gate(d):
    names = ("by_right", "staff", "acres", "decided_on")
    parts = " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg(CASE WHEN {n} IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM application" for n in names)
    return f"""
    WITH share AS ({parts}) SELECT feature, coverage, coverage >= 0.8 AS usable, CASE WHEN coverage < 0.8 THEN 'covers too few rows' END AS reason FROM share"""


def column_summary(d):
    return f"""
    SELECT use_class, round({d.quantile('capacity_mw', 0.5)}, 6) AS median_mw, round({d.quantile('capacity_mw', 0.1)}, 6) AS p10_mw, round({d.quantile('capacity_mw', 0.9)}, 6) AS p90_mw,
           round(stddev_samp(acres), 6) AS sd_acres, round(stddev_pop(acres), 6) AS sd_pop_acres, round(avg(CASE WHEN acres IS NULL THEN 1 ELSE 0 END), 6) AS null_share,
           count(DISTINCT applicant_id) AS applicants FROM application GROUP BY use_class"""


def competing_risks(d):
    """Arms of the survival models: the event, the months, and who is still waiting at the end."""
    return f"""
    WITH timed AS (SELECT *, coalesce(decided_on, DATE '2001-08-01') AS until FROM application)
    SELECT CASE WHEN decided_on IS NULL THEN 'censored' WHEN outcome IN ('approved', 'approved_with_conditions') THEN 'approval' WHEN outcome = 'denied' THEN 'denial' ELSE 'withdrawal' END AS risk,
           count(*) AS n, round(avg(greatest(0.03, {d.days('until', 'filed_on')} / 30.44)), 6) AS mean_months, round(min(greatest(0.03, {d.days('until', 'filed_on')} / 30.44)), 6) AS least_months
    FROM timed WHERE until >= filed_on GROUP BY 1"""


def _base_rates(spark: SparkSession, sf_dir: str) -> tuple:
    """Tables of the three levels before the cutoff, each shrunk to the one above: (whole, use, region and use, county and use)."""
    rows = frame(spark, sf_dir, "application").where(f"{SETTLED} AND decided_on < {CUTOFF}").join(frame(spark, sf_dir, "county").select("county_id", "region_id"), "county_id")
    ok = F.sum(F.when(F.col("outcome").isin("approved", "approved_with_conditions"), 1.0).otherwise(0.0))
    cell = rows.groupBy("county_id", "region_id", "use_class").agg(F.count(F.lit(1)).alias("n"), ok.alias("s"))
    whole = cell.agg((F.sum("s") / F.sum("n")).alias("mu"), F.count_if(F.col("n") >= 5).alias("cells"), F.var_samp(F.when(F.col("n") >= 5, F.col("s") / F.col("n"))).alias("v"), F.avg(F.when(F.col("n") >= 5, F.col("n"))).alias("mean_n"))
    noise = F.col("mu") * (1 - F.col("mu"))
    strength = F.when(F.col("cells") < 3, 4.0).when(F.coalesce("v", F.lit(0.0)) <= noise / F.col("mean_n"), 50.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(50.0), noise / F.col("v") - 1)))
    whole = whole.select("mu", strength.alias("k"))
    shrunk = lambda up: (F.col("s") + F.col(up) * F.col("k")) / (F.col("n") + F.col("k"))
    use = cell.groupBy("use_class").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(F.broadcast(whole)).select("use_class", "k", shrunk("mu").alias("p1"))
    region = cell.groupBy("region_id", "use_class").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(use, "use_class").select("region_id", "use_class", shrunk("p1").alias("p2"))
    local = cell.join(use, "use_class").join(region, ["region_id", "use_class"]).select("county_id", "use_class", F.col("n").alias("n_local"), shrunk("p2").alias("p3"), (F.col("k") / (F.col("k") + F.col("n"))).alias("pooling"))
    return whole, use, region, local


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels, each shrunk to the one above; a missing cell falls back to the next level."""
    whole, use, region, local = _base_rates(spark, sf_dir)
    rows = frame(spark, sf_dir, "application").where(f"filed_on >= {CUTOFF}").join(frame(spark, sf_dir, "county").select("county_id", "region_id"), "county_id")
    told = rows.join(F.broadcast(whole.select("mu"))).join(use.drop("k"), "use_class", "left").join(region, ["region_id", "use_class"], "left").join(local, ["county_id", "use_class"], "left")
    p, n = F.coalesce("p3", "p2", "p1", "mu"), F.coalesce("n_local", F.lit(0))
    half = 1 / F.sqrt(n + 2)
    return told.select(
        "application_id", F.round(p, 6).alias("probability"), F.round(F.coalesce("pooling", F.lit(1.0)), 6).alias("pooling_weight"), n.cast("bigint").alias("n_local"),
        F.round(F.greatest(F.lit(0.0), p - half), 6).alias("low"), F.round(F.least(F.lit(1.0), p + half), 6).alias("high"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each county and month at risk of its first restriction; what is known at its start comes from running totals."""
    county, laws = frame(spark, sf_dir, "county"), frame(spark, sf_dir, "instrument")
    first = laws.where("kind = 'moratorium' AND adopted_on >= DATE '1996-06-01'").groupBy(F.col("county_id").cast("bigint").alias("county_id")).agg(F.min("adopted_on").alias("on_day"))
    months = F.explode(F.expr("sequence(DATE '1995-06-01', DATE '2001-06-01', interval 1 month)"))
    spine = county.select("county_id", months.alias("month")).join(first, "county_id", "left").where("on_day IS NULL OR month <= trunc(on_day, 'MM')")
    back = F.add_months("month", -24)
    key = ["county_id"]
    asked = moments(spine, key, F.col("month"), back)
    # facts count by the month they fall in
    voiced = running(frame(spark, sf_dir, "objection").withColumn("m", F.trunc("observed_on", "MM")), key, "m", {"objections": F.lit(1)}, {}, asked)
    filed = running(frame(spark, sf_dir, "application").withColumn("m", F.trunc("filed_on", "MM")), key, "m", {"filings": F.lit(1)}, {}, asked)
    around = frame(spark, sf_dir, "adjacency").join(first.withColumnRenamed("county_id", "neighbour_id"), "neighbour_id").select("county_id", "on_day")
    near = running(around, key, "on_day", {"near": F.lit(1)}, {}, asked)
    now = spine
    for prefix, at in (("", F.col("month")), ("old_", back)):
        now = look_up(now, voiced, key, at, "m", prefix, ["objections"])
        now = look_up(now, filed, key, at, "m", prefix, ["filings"])
    now = look_up(now, near.withColumnRenamed("on_day", "d"), key, F.col("month"), "d", "", ["near"])
    held = frame(spark, sf_dir, "election").groupBy("county_id").agg(F.array_sort(F.collect_set("held_on")).alias("days"))
    ahead = F.get(F.filter("days", lambda x: x >= F.col("month")), F.lit(0))
    diff = lambda c: F.coalesce(c, F.lit(0)) - F.coalesce("old_" + c, F.lit(0))
    return now.join(held, "county_id", "left").select(
        "county_id", "month", F.coalesce(F.trunc("on_day", "MM") == F.col("month"), F.lit(False)).alias("event"), F.coalesce("near", F.lit(0)).cast("bigint").alias("neighbours_restricted"),
        diff("objections").cast("bigint").alias("objections_24m"), diff("filings").cast("bigint").alias("filings_24m"), F.round(F.try_divide(diff("objections"), F.nullif(diff("filings"), F.lit(0))), 6).alias("objection_pressure"),
        F.coalesce(F.datediff(ahead, "month") / F.lit(30.44) <= 12, F.lit(False)).alias("election_within_12m"),
    )


def curve(rows: DataFrame) -> DataFrame:
    """(bin, n, predicted, observed) of the ten equal bins that hold rows, the last one closed."""
    return rows.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p").cast("double")).alias("predicted"), F.avg(F.col("y").cast("double")).alias("observed"))


def reliable(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    told = spine.join(curve(frame(spark, sf_dir, "scored")), "bin", "left")
    return told.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("predicted", (F.col("bin") + 0.5) / 10), 6).alias("predicted"), F.round(F.coalesce("observed", F.lit(0.0)), 6).alias("observed"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return curve(frame(spark, sf_dir, "scored")).agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"), F.bool_and((F.col("n") < 5) | (gap <= 0.10)).alias("worst_bin_within"))


QUERIES = {
    f.__name__: query(f)
    for f in (base_rate_levels, wilson, abstention_precision, residual_notes, sufficiency, temporal_split, coverage_gate, column_summary, competing_risks)
} | {
    "metrics": (metrics, query(_metrics)[1]), "binned_coverage": (binned_coverage, query(_binned_coverage)[1]), "base_rate_predict": (predicted, query(base_rate_predict)[1]), "hazard_panel": (panel, query(hazard_panel)[1]),
    "reliability": (reliable, query(reliability)[1]), "calibration_error": (calibration, query(calibration_error)[1]),
}
