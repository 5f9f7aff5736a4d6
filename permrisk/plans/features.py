"""Rule, politics, opposition, site and applicant features at the filing date.

What depends on county, use and day only is computed once for each such moment
and joined back, so its cost follows the calendar, not the number of subjects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.operators.asof import look_up, moments, running
from permrisk.operators.intervals import in_force
from permrisk.plans.dialect import Oracle
from permrisk.plans.graph import frame, query, statement


USES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
OVERLAYS, PROCESSES, RESTRICTIVE = ("overlay", "interim"), ("resolution", "comprehensive_plan"), ("moratorium", "overlay", "interim", "ordinance")


def _instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments by the use they apply to; one without a use applies to all."""
    every = F.when(F.col("applies_to").isNull(), F.array(*map(F.lit, USES))).otherwise(F.array("applies_to"))
    return frame(spark, sf_dir, "instrument").withColumn("county_id", F.col("county_id").cast("bigint")).withColumn("use_class", F.explode(every))


def law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in force on the day of filing, and how long ago the last one was adopted."""
    cell = ["county_id", "use_class"]
    subjects, laws = frame(spark, sf_dir, "application"), _instruments(spark, sf_dir)
    days = subjects.select(*cell, F.col("filed_on").alias("day")).distinct()
    is_a = lambda *kinds: F.col("kind").isin(*kinds)
    when = lambda c, x: F.when(c, x)
    live = in_force(
        days, laws, cell, "adopted_on", "expires_on",
        most={"moratorium": when(is_a("moratorium"), F.lit(1)), "overlay": when(is_a(*OVERLAYS), F.lit(1)), "process_on": when(is_a(*PROCESSES), F.col("adopted_on"))},
        least={"ends_on": when(is_a("moratorium"), F.col("expires_on")), "setback_ft": F.col("setback_ft")},
    )
    following = live.select(*cell, F.date_add("day", 1).alias("day"))
    changed = running(laws, cell, "adopted_on", {}, {"changed_on": F.max("adopted_on")}, following)
    state = look_up(live, changed, cell, F.date_add("day", 1), "adopted_on", "", ["changed_on"]).withColumnRenamed("day", "filed_on")
    relief = frame(spark, sf_dir, "relief")
    rows = subjects.join(state, [*cell, "filed_on"]).join(frame(spark, sf_dir, "county").select("county_id", "framework"), "county_id").join(relief, "application_id", "left")
    since = F.datediff("filed_on", "changed_on")
    asked = F.size(F.array_intersect("relief", F.array(F.lit("A"), F.lit("R"))))
    return rows.select(
        "application_id", "by_right", F.col("moratorium").isNotNull().alias("moratorium_active"), F.col("overlay").isNotNull().alias("overlay_present"),
        F.coalesce(F.col("process_on") >= F.add_months("filed_on", -18), F.lit(False)).alias("open_rule_process"), since.cast("bigint").alias("days_since_rule_change"), (since <= 180).alias("rule_changed_within_180d"),
        F.round(F.datediff("ends_on", "filed_on") / F.lit(30.44), 6).alias("months_to_moratorium_expiry"), F.round((F.col("application_id") % 1000) * F.lit(3.28084) - F.col("setback_ft"), 6).alias("setback_compliance_margin_ft"),
        F.when(F.col("framework").isNotNull(), F.col("framework") == "home_rule").alias("home_rule"), F.when(F.col("staff").isNotNull(), F.col("staff").isin("approve", "approve_with_conditions")).alias("staff_recommended_approval"),
        F.coalesce(F.nullif(asked, F.lit(0)), F.size("relief"), F.lit(1)).cast("bigint").alias("relief_count"),
    )


def _law(d):
    live = "(i.expires_on IS NULL OR i.expires_on > m.t)"
    any_of = lambda c: f"coalesce(bool_or({c} AND {live}), false)"
    return f"""
    WITH moment AS (SELECT DISTINCT county_id, use_class, filed_on AS t FROM application),
    law AS (
        SELECT m.county_id, m.use_class, m.t,
               {any_of("i.kind = 'moratorium'")} AS moratorium_active, {any_of("i.kind IN ('overlay', 'interim')")} AS overlay_present,
               {any_of(f"i.kind IN ('resolution', 'comprehensive_plan') AND i.adopted_on >= {d.add_months('m.t', -18)}")} AS open_rule_process,
               max(i.adopted_on) AS changed_on, min(CASE WHEN i.kind = 'moratorium' AND {live} THEN i.expires_on END) AS expires_on,
               min(CASE WHEN {live} THEN i.setback_ft END) AS setback_ft
        FROM moment m LEFT JOIN instrument i ON i.county_id = m.county_id AND i.adopted_on <= m.t AND (i.applies_to IS NULL OR i.applies_to = m.use_class)
        GROUP BY m.county_id, m.use_class, m.t)
    SELECT a.application_id, a.by_right, l.moratorium_active, l.overlay_present, l.open_rule_process,
           CAST({d.days('a.filed_on', 'l.changed_on')} AS BIGINT) AS days_since_rule_change, {d.days('a.filed_on', 'l.changed_on')} <= 180 AS rule_changed_within_180d,
           round({d.days('l.expires_on', 'a.filed_on')} / 30.44, 6) AS months_to_moratorium_expiry,
           round((a.application_id % 1000) * 3.28084 - l.setback_ft, 6) AS setback_compliance_margin_ft,
           CASE WHEN c.framework IS NOT NULL THEN c.framework = 'home_rule' END AS home_rule,
           CASE WHEN a.staff IS NOT NULL THEN a.staff IN ('approve', 'approve_with_conditions') END AS staff_recommended_approval,
           CAST(coalesce(nullif({d.overlap('r.relief', d.array("'A'", "'R'"))}, 0), {d.size('r.relief')}, 1) AS BIGINT) AS relief_count
    FROM application a JOIN law l ON l.county_id = a.county_id AND l.use_class = a.use_class AND l.t = a.filed_on
    JOIN county c ON c.county_id = a.county_id LEFT JOIN relief r ON r.application_id = a.application_id"""


def elections(d):
    return f"""
    WITH moment AS (SELECT DISTINCT county_id, filed_on AS t FROM application),
    upcoming AS (SELECT m.county_id, m.t, min(e.held_on) AS next_on FROM moment m LEFT JOIN election e ON e.county_id = m.county_id AND e.held_on >= m.t GROUP BY m.county_id, m.t),
    seats AS (SELECT county_id, count(*) AS n FROM member GROUP BY county_id)
    SELECT a.application_id, nullif(s.n, 0) AS board_seats, round({d.days('u.next_on', 'a.filed_on')} / 30.44, 6) AS months_to_next_election,
           round({d.days('u.next_on', 'a.filed_on')} / 30.44, 6) <= 12 AS election_within_12m
    FROM application a JOIN upcoming u ON u.county_id = a.county_id AND u.t = a.filed_on LEFT JOIN seats s ON s.county_id = a.county_id"""


def contagion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours whose latest restriction for the use lies within 24 months before the filing: an older one cannot matter."""
    cell = ["county_id", "use_class"]
    subjects = frame(spark, sf_dir, "application")
    near = frame(spark, sf_dir, "adjacency")
    pairs = subjects.select("county_id", "use_class", F.col("filed_on").alias("day")).distinct().join(near, "county_id").withColumnRenamed("county_id", "own_id").withColumnRenamed("neighbour_id", "county_id")
    laws = _instruments(spark, sf_dir).where(F.col("kind").isin(*RESTRICTIVE))
    state = running(laws, cell, "adopted_on", {}, {"last": F.max("adopted_on")}, pairs)
    seen = look_up(pairs, state, cell, F.col("day"), "adopted_on", "", ["last"])
    counted = seen.groupBy(F.col("own_id").alias("county_id"), "use_class", F.col("day").alias("filed_on")).agg(F.count_if(F.col("last") >= F.add_months("day", -24)).alias("n"))
    return subjects.join(counted, [*cell, "filed_on"], "left").select("application_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("neighbour_contagion"))


def _contagion(d):
    return f"""
    WITH moment AS (SELECT DISTINCT county_id, use_class, filed_on AS t FROM application),
    near AS (
        SELECT m.county_id, m.use_class, m.t, count(DISTINCT j.neighbour_id) AS n
        FROM moment m JOIN adjacency j ON j.county_id = m.county_id
        JOIN instrument i ON i.county_id = j.neighbour_id AND i.kind IN ('moratorium', 'overlay', 'interim', 'ordinance') AND (i.applies_to IS NULL OR i.applies_to = m.use_class)
             AND i.adopted_on < m.t AND i.adopted_on >= {d.add_months('m.t', -24)}
        GROUP BY m.county_id, m.use_class, m.t)
    SELECT a.application_id, coalesce(n.n, 0) AS neighbour_contagion
    FROM application a LEFT JOIN near n ON n.county_id = a.county_id AND n.use_class = a.use_class AND n.t = a.filed_on"""


def site(d):
    return """
    SELECT application_id, acres AS parcel_acres, capacity_mw, round(capacity_mw / nullif(acres, 0), 6) AS intensity_mw_per_acre,
           application_id % 4 = 0 AS prior_industrial_use FROM application"""


def applicant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The applicant's settled decisions before the filing, anywhere and in the county, as running totals."""
    subjects = frame(spark, sf_dir, "application")
    facts = subjects.where("decided_on IS NOT NULL AND outcome NOT IN ('withdrawn', 'pending')")
    approved = F.when(F.col("outcome").isin("approved", "approved_with_conditions"), 1).otherwise(0)
    own = (F.coalesce(F.col("decided_on") < F.col("filed_on"), F.lit(False)) & ~F.col("outcome").isin("withdrawn", "pending")).cast("int")
    rows = subjects.select("application_id", "applicant_id", "county_id", "filed_on", "decided_on", "outcome")
    anywhere = running(facts, ["applicant_id"], "decided_on", {"n": F.lit(1), "ok": approved}, {}, moments(subjects, ["applicant_id"], F.col("filed_on")))
    local = running(facts, ["applicant_id", "county_id"], "decided_on", {"local_n": F.lit(1)}, {}, moments(subjects, ["applicant_id", "county_id"], F.col("filed_on")))
    now = look_up(rows, anywhere.withColumnRenamed("decided_on", "until"), ["applicant_id"], F.col("filed_on"), "until", "", ["n", "ok"])
    now = look_up(now, local.withColumnRenamed("decided_on", "until"), ["applicant_id", "county_id"], F.col("filed_on"), "until", "", ["local_n"])
    less = lambda c, x: F.coalesce(c, F.lit(0)) - x
    return now.select(
        "application_id", F.round(F.try_divide(less("ok", own * approved), less("n", own)), 6).alias("applicant_track_record"), less("local_n", own).cast("bigint").alias("applicant_local_experience"),
        (F.col("applicant_id") % 13 == 0).alias("entity_opacity"),
    )


def _applicant(d):
    return """
    WITH own AS (
        SELECT s.application_id, count(p.application_id) AS n, count(*) FILTER (WHERE p.outcome IN ('approved', 'approved_with_conditions')) AS ok,
               count(*) FILTER (WHERE p.county_id = s.county_id) AS local_n
        FROM application s LEFT JOIN application p ON p.applicant_id = s.applicant_id AND p.application_id <> s.application_id
             AND p.decided_on < s.filed_on AND p.outcome NOT IN ('withdrawn', 'pending')
        GROUP BY s.application_id)
    SELECT o.application_id, round(CAST(o.ok AS DOUBLE) / nullif(o.n, 0), 6) AS applicant_track_record, o.local_n AS applicant_local_experience,
           a.applicant_id % 13 = 0 AS entity_opacity
    FROM own o JOIN application a ON a.application_id = o.application_id"""


GROUNDS = ("water", "electricity_cost", "noise", "traffic")


def opposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objections and decisions of the county in the 24 months before filing, as differences of running totals."""
    subjects = frame(spark, sf_dir, "application")
    facts = frame(spark, sf_dir, "objection")
    past_day = F.add_months("filed_on", -24)
    asked = moments(subjects, ["county_id"], F.col("filed_on"), past_day)
    one = lambda c: F.when(c, 1).otherwise(0)
    sums = {"n": F.lit(1), "organised": one(F.col("organised"))} | {g: one(F.col("ground") == g) for g in GROUNDS}
    voiced = running(facts, ["county_id"], "observed_on", sums, {}, asked)
    decided = running(subjects, ["county_id"], "decided_on", {"decisions": F.lit(1)}, {}, asked)
    now = subjects.select("application_id", "county_id", "filed_on")
    for prefix, at in (("", F.col("filed_on")), ("old_", past_day)):
        now = look_up(now, voiced, ["county_id"], at, "observed_on", prefix, list(sums))
        now = look_up(now, decided, ["county_id"], at, "decided_on", prefix, ["decisions"])
    in_24 = {c: F.coalesce(c, F.lit(0)) - F.coalesce("old_" + c, F.lit(0)) for c in [*sums, "decisions"]}
    n, decisions = in_24["n"], in_24["decisions"]
    none = (n == 0) & (decisions == 0)
    share = lambda g: F.round(F.try_divide(in_24[g], n), 6)
    return now.select(
        "application_id", F.when(~none, F.round(F.coalesce(F.try_divide(n, decisions), n.cast("double")), 6)).alias("objection_density_24m"),
        F.when(~none, in_24["organised"] > 0).alias("organised_group_present"), share("water").alias("salience_water"), share("electricity_cost").alias("salience_power_cost"),
        share("noise").alias("salience_noise"), share("traffic").alias("salience_traffic"),
    )


OPPOSITION_SQL = statement("""
    WITH moment AS (SELECT DISTINCT county_id, filed_on AS t FROM application),
    voiced AS (
        SELECT m.county_id, m.t, count(o.county_id) AS n, count(*) FILTER (WHERE o.organised) AS organised, count(*) FILTER (WHERE ground = 'water') AS water,
               count(*) FILTER (WHERE ground = 'electricity_cost') AS power, count(*) FILTER (WHERE ground = 'noise') AS noise, count(*) FILTER (WHERE ground = 'traffic') AS traffic
        FROM moment m LEFT JOIN objection o ON o.county_id = m.county_id AND o.observed_on < m.t AND o.observed_on >= m.t - INTERVAL 24 MONTH GROUP BY m.county_id, m.t),
    decided AS (
        SELECT m.county_id, m.t, count(a.county_id) AS n FROM moment m LEFT JOIN application a ON a.county_id = m.county_id AND a.decided_on < m.t AND a.decided_on >= m.t - INTERVAL 24 MONTH GROUP BY m.county_id, m.t)
    SELECT a.application_id, round(CASE WHEN v.n = 0 AND d.n = 0 THEN NULL WHEN d.n = 0 THEN CAST(v.n AS DOUBLE) ELSE v.n / d.n END, 6) AS objection_density_24m,
           CASE WHEN v.n = 0 AND d.n = 0 THEN NULL ELSE v.organised > 0 END AS organised_group_present, round(v.water / nullif(v.n, 0), 6) AS salience_water,
           round(v.power / nullif(v.n, 0), 6) AS salience_power_cost, round(v.noise / nullif(v.n, 0), 6) AS salience_noise, round(v.traffic / nullif(v.n, 0), 6) AS salience_traffic
    FROM application a JOIN voiced v ON v.county_id = a.county_id AND v.t = a.filed_on JOIN decided d ON d.county_id = a.county_id AND d.t = a.filed_on""", Oracle)


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition of the sitting board, swing seats, and turnover since the last decision of the same use.

    A member's rate counts every position taken before the day; terms are closed at both ends.
    """
    subjects = frame(spark, sf_dir, "application")
    cell = ["county_id", "use_class"]
    votes = frame(spark, sf_dir, "vote").join(subjects.select("application_id", "decided_on"), "application_id")
    latest = running(subjects, cell, "decided_on", {}, {"last": F.max("decided_on")}, moments(subjects, cell, F.col("filed_on")))
    dated = look_up(subjects.select(*cell, F.col("filed_on").alias("t")).distinct(), latest, cell, F.col("t"), "decided_on", "", ["last"])
    members = frame(spark, sf_dir, "member").select("member_id", F.col("county_id").alias("body_id"), "term_start", "term_end")
    sitting = dated.join(members, (F.col("county_id") == F.col("body_id")) & (F.col("term_start") <= F.col("t")) & (F.col("term_end").isNull() | (F.col("term_end") >= F.col("t"))))
    state = running(votes, ["member_id"], "decided_on", {"n": F.lit(1), "ayes": F.when(F.col("vote_position") == "for", 1).otherwise(0)}, {}, moments(sitting, ["member_id"], F.col("t")))
    seen = look_up(sitting, state, ["member_id"], F.col("t"), "decided_on", "", ["n", "ayes"])
    rate = F.try_divide("ayes", "n")
    boards = seen.groupBy("county_id", "use_class", "t").agg(
        F.round(F.avg(rate) * 2 - 1, 6).alias("board_composition_score"), F.when(F.count(rate) > 0, F.count_if(rate.between(0.25, 0.75))).alias("swing_seat_count"),
        F.round(F.avg(F.when(F.col("last").isNotNull(), (F.col("term_start") > F.col("last")).cast("double"))), 6).alias("turnover_since_last_comparable"),
    )
    return subjects.join(boards.withColumnRenamed("t", "filed_on"), ["county_id", "use_class", "filed_on"], "left").select("application_id", "board_composition_score", "swing_seat_count", "turnover_since_last_comparable")


BOARD_SQL = statement("""
    WITH taken AS (SELECT v.member_id, a.decided_on, count(*) AS n, count(*) FILTER (WHERE v.vote_position = 'for') AS ayes FROM vote v JOIN application a ON a.application_id = v.application_id WHERE a.decided_on IS NOT NULL GROUP BY 1, 2),
    total AS (SELECT member_id, decided_on, sum(n) OVER w AS n, sum(ayes) OVER w AS ayes FROM taken WINDOW w AS (PARTITION BY member_id ORDER BY decided_on)),
    day AS (SELECT DISTINCT county_id, use_class, decided_on FROM application WHERE decided_on IS NOT NULL),
    moment AS (SELECT DISTINCT county_id, use_class, filed_on AS t FROM application),
    dated AS (SELECT m.*, d.decided_on AS last_on FROM moment m ASOF LEFT JOIN day d ON d.county_id = m.county_id AND d.use_class = m.use_class AND d.decided_on < m.t),
    sitting AS (SELECT d.*, b.member_id, b.term_start FROM dated d JOIN member b ON b.county_id = d.county_id AND b.term_start <= d.t AND (b.term_end IS NULL OR b.term_end >= d.t)),
    rated AS (SELECT s.*, x.ayes / nullif(x.n, 0) AS rate FROM sitting s ASOF LEFT JOIN total x ON x.member_id = s.member_id AND x.decided_on < s.t),
    board AS (
        SELECT county_id, use_class, t, round(avg(rate) * 2 - 1, 6) AS board_composition_score, CASE WHEN count(rate) > 0 THEN count(*) FILTER (WHERE rate BETWEEN 0.25 AND 0.75) END AS swing_seat_count,
               round(avg(CASE WHEN last_on IS NOT NULL THEN CASE WHEN term_start > last_on THEN 1.0 ELSE 0.0 END END), 6) AS turnover_since_last_comparable
        FROM rated GROUP BY county_id, use_class, t)
    SELECT a.application_id, b.board_composition_score, b.swing_seat_count, b.turnover_since_last_comparable
    FROM application a LEFT JOIN board b ON b.county_id = a.county_id AND b.use_class = a.use_class AND b.t = a.filed_on""", Oracle)

QUERIES = {
    "features_law": (law, query(_law)[1]), "features_elections": query(elections), "features_contagion": (contagion, query(_contagion)[1]), "features_site": query(site), "features_applicant": (applicant, query(_applicant)[1]),
    "features_opposition": (opposition, OPPOSITION_SQL), "features_board": (board, BOARD_SQL),
}
