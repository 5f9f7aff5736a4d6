"""Scores or abstentions, and what is shown beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permrisk.plans.evaluation import CUTOFF, OK, SETTLED, _shrunk
from permrisk.plans.graph import frame, query


def _scored(d):
    """One row for each pending application: probability, interval, and what the abstention rules look at."""
    return f"""
    {_shrunk(d).strip()},
    fresh AS (SELECT county_id, max(last_success) AS last_success FROM source GROUP BY county_id),
    seen AS (SELECT c.region_id, count(DISTINCT {OK}) AS classes FROM application a JOIN county c ON c.county_id = a.county_id WHERE {SETTLED} AND a.decided_on < {CUTOFF} AND a.use_class <> 'MACHINERY' GROUP BY c.region_id),
    ready AS (
        SELECT a.application_id, a.county_id, a.use_class, a.capacity_mw, a.acres, coalesce(p3.p, p2.p, p1.p, w.mu) AS p, coalesce(p3.pooling, 1.0) AS pooling, CAST(coalesce(p3.n, 0) AS BIGINT) AS n,
               least(1.0, coalesce(p3.p, p2.p, p1.p, w.mu) + 1 / sqrt(coalesce(p3.n, 0) + 2)) - greatest(0.0, coalesce(p3.p, p2.p, p1.p, w.mu) - 1 / sqrt(coalesce(p3.n, 0) + 2)) AS width,
               greatest(0.0, coalesce(p3.p, p2.p, p1.p, w.mu) - 1 / sqrt(coalesce(p3.n, 0) + 2)) AS low, least(1.0, coalesce(p3.p, p2.p, p1.p, w.mu) + 1 / sqrt(coalesce(p3.n, 0) + 2)) AS high,
               CASE WHEN a.application_id % 41 = 3 THEN 1 ELSE coalesce(s.classes, 0) END AS classes, a.application_id % 50 <> 7 AS resolved, {d.days("DATE '2024-06-01'", 'CAST(f.last_success AS DATE)')} - a.application_id % 100 AS stale_days
        FROM application a JOIN county c ON c.county_id = a.county_id CROSS JOIN whole w LEFT JOIN fresh f ON f.county_id = a.county_id LEFT JOIN seen s ON s.region_id = c.region_id
        LEFT JOIN p1 ON p1.use_class = a.use_class LEFT JOIN p2 ON p2.region_id = c.region_id AND p2.use_class = a.use_class LEFT JOIN p3 ON p3.county_id = a.county_id AND p3.use_class = a.use_class
        WHERE a.outcome = 'pending')"""


REASON = """CASE WHEN NOT resolved THEN 'unresolved_jurisdiction_chain' WHEN classes < 2 THEN 'degenerate_training_corpus' WHEN stale_days > 90 THEN 'stale_jurisdiction_data' WHEN n < 3 AND pooling > 0.8 AND width > 0.35 THEN 'thin_local_record' END"""


def abstention(d):
    """Rules in order: who decides is unknown, all known decisions went one way, data are stale, the record is thin and borrowed and wide; limits are strict."""
    return f"""
    WITH {_scored(d).strip()}
    SELECT application_id, {REASON} AS reason, {REASON} IS NOT NULL AS abstained, CASE WHEN {REASON} IS NULL THEN round(p, 6) END AS probability, round(width, 6) AS width,
           CASE WHEN width <= 0.18 AND pooling <= 0.4 AND n >= 8 THEN 'high' WHEN width <= 0.30 AND pooling <= 0.7 AND n >= 3 THEN 'medium' ELSE 'low' END AS confidence,
           coalesce(stale_days > 14, false) AS stale_flag, pooling >= 0.2 AS discloses_pooling
    FROM ready"""


def portfolio(d):
    """Answered sites by falling probability, abstained ones last."""
    return f"""
    WITH {_scored(d).strip()},
    judged AS (SELECT application_id, county_id, {REASON} IS NOT NULL AS abstained, round(p, 6) AS p FROM ready)
    SELECT application_id, abstained, CASE WHEN NOT abstained THEN p END AS probability, row_number() OVER (PARTITION BY county_id ORDER BY abstained, CASE WHEN abstained THEN 0 ELSE -p END, application_id) AS place,
           count(*) OVER (PARTITION BY county_id) AS sites, CAST(sum(CASE WHEN abstained THEN 0 ELSE 1 END) OVER (PARTITION BY county_id) AS BIGINT) AS answered FROM judged"""


def precedents(d):
    """Of the 40 latest verified decisions of the county, the six most alike: use, relief, scale and recency."""
    return f"""
    WITH pool AS (
        SELECT a.*, coalesce(r.relief, {d.array("'N'")}) AS relief, row_number() OVER (PARTITION BY a.county_id ORDER BY a.decided_on DESC, a.application_id DESC) AS latest
        FROM application a JOIN verified v ON v.application_id = a.application_id LEFT JOIN relief r ON r.application_id = a.application_id WHERE {SETTLED} AND a.decided_on IS NOT NULL),
    site AS (SELECT a.*, coalesce(r.relief, {d.array("'N'")}) AS relief FROM application a LEFT JOIN relief r ON r.application_id = a.application_id WHERE a.outcome = 'pending'),
    paired AS (
        SELECT s.application_id, p.application_id AS precedent_id, p.outcome,
               0.40 * CASE WHEN s.use_class = p.use_class THEN 1 ELSE 0 END + 0.25 * {d.overlap('s.relief', 'p.relief')} / greatest(1, {d.union('s.relief', 'p.relief')})
               + 0.15 * coalesce(least(s.capacity_mw, p.capacity_mw) / nullif(greatest(s.capacity_mw, p.capacity_mw), 0), 0.5)
               + 0.20 * pow(0.5, {d.days("DATE '2001-08-01'", 'p.decided_on')} / 365.25 / 3) AS similarity
        FROM site s JOIN pool p ON p.county_id = s.county_id AND p.latest <= 40 AND p.application_id <> s.application_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY round(similarity, 9) DESC, precedent_id DESC) AS place FROM paired)
    SELECT application_id, precedent_id, outcome, round(similarity, 6) AS similarity, CAST(place AS INT) AS place FROM ranked WHERE place <= 6"""


def alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 40 latest verified decisions of the county, the six most alike: use, relief, scale and recency."""
    a = frame(spark, sf_dir, "application")
    relief = frame(spark, sf_dir, "relief")
    told = a.join(relief, "application_id", "left").withColumn("relief", F.coalesce("relief", F.array(F.lit("N"))))
    latest = Window.partitionBy("county_id").orderBy(F.desc("decided_on"), F.desc("application_id"))
    pool = told.where(f"{SETTLED} AND decided_on IS NOT NULL").join(frame(spark, sf_dir, "verified"), "application_id", "left_semi").withColumn("latest", F.row_number().over(latest)).where("latest <= 40")
    pool = pool.groupBy("county_id").agg(F.collect_list(F.struct(F.col("application_id").alias("id"), "outcome", "use_class", "capacity_mw", "relief", "decided_on")).alias("pool"))
    p = lambda c: F.col("x." + c)
    ratio = F.try_divide(F.least("capacity_mw", p("capacity_mw")), F.greatest("capacity_mw", p("capacity_mw")))
    ratio = F.when(F.col("capacity_mw").isNotNull() & p("capacity_mw").isNotNull(), ratio)
    age = F.datediff(F.lit("2001-08-01").cast("date"), p("decided_on")) / 365.25
    score = (
        F.when(F.col("use_class") == p("use_class"), 0.40).otherwise(0.0) + F.size(F.array_intersect("relief", p("relief"))) / F.greatest(F.lit(1), F.size(F.array_union("relief", p("relief")))) * 0.25
        + F.coalesce(ratio, F.lit(0.5)) * 0.15 + F.pow(F.lit(0.5), age / 3) * 0.20
    )
    met = told.where("outcome = 'pending'").join(pool, "county_id").withColumn("x", F.explode("pool")).where("x.id <> application_id").select("application_id", p("id").alias("precedent_id"), p("outcome").alias("outcome"), score.alias("similarity"))
    place = F.row_number().over(Window.partitionBy("application_id").orderBy(F.desc(F.round("similarity", 9)), F.desc("precedent_id")))
    return met.withColumn("place", place.cast("int")).where("place <= 6").withColumn("similarity", F.round("similarity", 6))


def drivers(d):
    """The largest contributions first, as shares of their total; zeros are no drivers."""
    parts = " UNION ALL ".join(f"SELECT application_id, '{n}' AS feature, {e} AS effect FROM application WHERE outcome = 'pending'" for n, e in (
        ("capacity_mw", "(capacity_mw - 150) * -0.004"), ("acres", "(acres - 48) * 0.01"), ("by_right", "CASE WHEN by_right THEN 0.9 WHEN NOT by_right THEN -0.3 END"),
        ("staff", "CASE staff WHEN 'approve' THEN 0.8 WHEN 'approve_with_conditions' THEN 0.5 WHEN 'deny' THEN -1.1 END")))
    return f"""
    WITH parts AS ({parts}),
    live AS (SELECT application_id, feature, CAST(effect AS DOUBLE) AS effect FROM parts WHERE effect IS NOT NULL AND abs(effect) > 0.000001),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY abs(effect) DESC, feature) AS place, sum(abs(effect)) OVER (PARTITION BY application_id) AS total FROM live)
    SELECT application_id, feature, CAST(place AS INT) AS place, round(abs(effect) / total, 6) AS weight, CASE WHEN effect > 0 THEN 'raises' ELSE 'lowers' END AS direction FROM ranked WHERE place <= 8"""


def alternatives(d):
    """Of the 12 nearest counties with a record for the use, the five of most expected value after distance."""
    return f"""
    WITH {_scored(d).strip()},
    near AS (
        SELECT a.county_id, b.county_id AS other_id, sqrt(CAST((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS DOUBLE)) * 100 AS km,
               row_number() OVER (PARTITION BY a.county_id ORDER BY (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy), b.county_id) AS rn
        FROM county a JOIN county b ON a.county_id <> b.county_id),
    valued AS (
        SELECT u.county_id, u.use_class, n.other_id, n.km, p3.p, p3.p - least(0.02 * n.km / 100, 0.15) AS value
        FROM (SELECT DISTINCT county_id, use_class FROM ready) u JOIN near n ON n.county_id = u.county_id AND n.rn <= 12 JOIN p3 ON p3.county_id = n.other_id AND p3.use_class = u.use_class AND p3.n >= 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY county_id, use_class ORDER BY round(value, 9) DESC, other_id) AS place FROM valued)
    SELECT county_id, use_class, other_id, round(km, 6) AS km, round(p, 6) AS probability, round(value, 6) AS expected_value, CAST(place AS INT) AS place FROM ranked WHERE place <= 5"""


def mitigations(d):
    return """
    SELECT application_id, rule, 0.0 AS delta FROM (
        SELECT application_id, 'reduce capacity' AS rule FROM application WHERE outcome = 'pending' AND capacity_mw > 200
        UNION ALL SELECT application_id, 'seek staff support' FROM application WHERE outcome = 'pending' AND (staff IS NULL OR staff = 'deny')
        UNION ALL SELECT application_id, 'use a by-right district' FROM application WHERE outcome = 'pending' AND by_right = false) m"""


def attached_evidence(d):
    """The first verified citation, a verified one before any other."""
    return """
    WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY CASE WHEN verified THEN 0 ELSE 1 END, evidence_id) AS rn FROM (SELECT DISTINCT * FROM evidence) e)
    SELECT application_id, evidence_id, verified FROM ranked WHERE rn = 1"""


def county_profile(d):
    return f"""
    WITH rate AS (SELECT county_id, count(*) AS decisions, count(*) FILTER (WHERE outcome IN ('approved', 'approved_with_conditions')) AS approvals, max(decided_on) AS latest FROM application WHERE {SETTLED} GROUP BY county_id),
    live AS (SELECT county_id, count(*) FILTER (WHERE kind = 'moratorium') AS moratoria, count(*) AS instruments FROM instrument WHERE adopted_on <= DATE '2001-01-01' AND (expires_on IS NULL OR expires_on > DATE '2001-01-01') GROUP BY county_id),
    seat AS (SELECT county_id, count(*) AS seats FROM member WHERE term_start <= DATE '1998-01-01' AND (term_end IS NULL OR term_end >= DATE '1998-01-01') GROUP BY county_id),
    vote_day AS (SELECT county_id, {d.listed('held_on')} AS held FROM election WHERE held_on >= DATE '1997-01-01' GROUP BY county_id)
    SELECT c.county_id, c.name, c.framework, coalesce(r.decisions, 0) AS decisions, round(CAST(r.approvals AS DOUBLE) / nullif(r.decisions, 0), 6) AS approval_rate, r.latest,
           coalesce(l.moratoria, 0) AS moratoria, coalesce(l.instruments, 0) AS instruments, coalesce(s.seats, 0) AS seats, CAST(coalesce({d.size('v.held')}, 0) AS INT) AS elections_ahead
    FROM county c LEFT JOIN rate r ON r.county_id = c.county_id LEFT JOIN live l ON l.county_id = c.county_id LEFT JOIN seat s ON s.county_id = c.county_id LEFT JOIN vote_day v ON v.county_id = c.county_id"""


def county_derived(d):
    """Depth and share of discretion, null without decisions."""
    return f"""
    WITH used AS (SELECT a.county_id, a.decided_on, {d.overlap('r.relief', d.array("'A'", "'R'"))} > 0 AS discretionary FROM application a JOIN relief r ON r.application_id = a.application_id WHERE {SETTLED})
    SELECT c.county_id, count(u.decided_on) AS data_depth, round(CAST(count(*) FILTER (WHERE u.discretionary) AS DOUBLE) / nullif(count(u.decided_on), 0), 3) AS discretion_index
    FROM county c LEFT JOIN used u ON u.county_id = c.county_id GROUP BY c.county_id"""


def label_stats(d):
    return f"""
    SELECT c.region_id, a.use_class, a.outcome, count(*) AS n, round(avg({d.days('a.decided_on', 'a.filed_on')} / 30.44), 6) AS mean_months,
           count(*) FILTER (WHERE a.decided_on IS NULL) AS waiting FROM application a JOIN county c ON c.county_id = a.county_id GROUP BY c.region_id, a.use_class, a.outcome"""


def instrument_stats(d):
    return "SELECT county_id, kind, count(*) AS n, min(adopted_on) AS first_on, max(adopted_on) AS last_on, count(expires_on) AS with_end FROM instrument GROUP BY county_id, kind"


def freshness(d):
    age = d.seconds("TIMESTAMP '2024-01-31 00:00:00'", "last_success")
    return f"""
    WITH aged AS (SELECT *, {age} / 3600 AS hours FROM source)
    SELECT source_id, county_id, round(hours, 6) AS age_hours, CASE WHEN last_success IS NULL THEN 'never' WHEN failures > 15 THEN 'broken' WHEN hours > 72 THEN 'stale' ELSE 'fresh' END AS status,
           CASE WHEN last_success IS NULL THEN 0 WHEN failures > 15 THEN 1 WHEN hours > 72 THEN 2 ELSE 3 END AS severity FROM aged"""


def stale_counties(d):
    age = d.seconds("TIMESTAMP '2024-01-31 00:00:00'", "last_success")
    return f"SELECT county_id, count(*) AS sources, round(min({age} / 86400), 6) AS least_days FROM source GROUP BY county_id HAVING min({age} / 86400) > 1 OR min({age} / 86400) IS NULL"


QUERIES = {
    f.__name__: query(f)
    for f in (abstention, portfolio, drivers, alternatives, mitigations, attached_evidence, county_profile, county_derived, label_stats, instrument_stats, freshness, stale_counties)
} | {"precedents": (alike, query(precedents)[1])}
