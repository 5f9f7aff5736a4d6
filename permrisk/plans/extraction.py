"""What is written in batches that may be repeated: extracted decisions, from answers to applications, and published predictions.

Answers are written from the graph: the item of an application quotes its
document once for each piece of evidence, word for word where that is verified,
and is sure where it is known whether the use is by right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.plans.dialect import Oracle
from permrisk.plans.features import USES
from permrisk.plans.graph import frame, query, statement
from permrisk.plans.ledger import GENESIS, _payloads
from permrisk.sources import landing, published
from permrisk.sources.scratch import fresh

SCHEMA = landing.decision_schema(["decision"], [], USES, ["A", "N", "R", "other"], ["approved", "approved_with_conditions", "denied", "withdrawn"], [])
FIRST_BATCH = "decided_on < DATE '1998-01-01'"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, county_id, text, answer, decided_on): one document and answer for each decided application."""
    a = frame(spark, sf_dir, "application").where("decided_on IS NOT NULL AND outcome <> 'pending'")
    votes = frame(spark, sf_dir, "vote").groupBy("application_id").agg(F.count_if(F.col("vote_position") == "for").alias("f"), F.count_if(F.col("vote_position") == "against").alias("g"))
    heard = F.concat(F.lit("Case "), F.col("application_id").cast("string"), F.lit(" was heard by the board"))
    # a line of an order is a piece of evidence; an application has few of them
    quote = F.struct(F.lit(1).alias("page"), F.when(F.col("verified"), heard).otherwise(F.concat(heard, F.lit(" at night"))).alias("quote"))
    evidence = frame(spark, sf_dir, "evidence").groupBy("application_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", quote.alias("q")))).alias("told"))
    rows = a.join(evidence, "application_id", "left").join(votes, "application_id", "left").join(frame(spark, sf_dir, "relief"), "application_id", "left")
    item = F.struct(
        F.lit("decision").alias("event_type"), "outcome", F.when(F.col("by_right").isNotNull(), 0.9).otherwise(0.5).alias("confidence"), F.coalesce(F.transform("told", lambda t: t.q), F.array()).alias("evidence"),
        F.concat(F.lit("C-"), F.col("applicant_id").cast("string")).alias("case_number"), F.concat(F.lit("applicant "), F.col("applicant_id").cast("string")).alias("applicant"), "use_class", F.col("relief").alias("relief_sought"), "capacity_mw", "acres",
        F.col("filed_on").cast("string").alias("filed_on"), F.col("decided_on").cast("string").alias("decided_on"), F.when(F.col("f") + F.col("g") > 0, F.concat_ws("-", "f", "g")).alias("vote"), F.col("staff").alias("staff_recommendation"),
    )
    text = F.concat(F.lit("MINUTES\n\n"), heard, F.lit(".\nThe vote was taken."))
    return rows.select(F.lpad(F.col("application_id").cast("string"), 12, "0").alias("document_id"), "county_id", text.alias("text"), F.to_json(F.struct(F.array(item).alias("items"))).alias("answer"), "decided_on")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every item: broken schema with its messages, quote not found, review, or landed."""
    return landing.judged(answers(spark, sf_dir), SCHEMA).select("document_id", "county_id", "status", F.array_join("problems", "; ").alias("problems"))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications after a batch of the older answers and one of all answers: those of the first are not landed again."""
    path, store = fresh(spark, "answers"), fresh(spark, "store")
    answers(spark, sf_dir).write.parquet(path)
    every = spark.read.parquet(path)
    landing.land(every.where(FIRST_BATCH), SCHEMA, store)
    landing.land(every, SCHEMA, store)
    out = landing.table(spark, store, "applications")
    return out.select(F.col("county_id").cast("bigint").alias("county_id"), "external_id", "document_id", "use_class", F.array_join("relief_sought", ",").alias("relief"), "capacity_mw", "acres", "filed_on", "decided_on", "outcome", "vote_for", "vote_against", "staff_recommendation")


_RULES = """
    ev AS (SELECT application_id, count(*) AS n, bool_and(verified) AS v FROM evidence GROUP BY application_id),
    read AS (SELECT a.*, lpad(CAST(a.application_id AS VARCHAR), 12, '0') AS document_id, coalesce(e.n, 0) AS n, coalesce(e.v, false) AS v FROM application a LEFT JOIN ev e ON e.application_id = a.application_id WHERE a.decided_on IS NOT NULL AND a.outcome <> 'pending'),
    held AS (SELECT *, CASE WHEN n = 0 OR n > 6 OR capacity_mw <= 0 THEN 'schema_violation' WHEN NOT v THEN 'quote_failed' WHEN by_right IS NULL THEN 'review' ELSE 'landed' END AS status FROM read)"""

JUDGED_SQL = statement(f"""
    WITH {_RULES.strip()}
    SELECT document_id, county_id, status, CASE WHEN status <> 'schema_violation' THEN '' ELSE concat_ws('; ', CASE WHEN n = 0 THEN '$.items[].evidence: fewer than 1 items' WHEN n > 6 THEN '$.items[].evidence: more than 6 items' END,
           CASE WHEN capacity_mw <= 0 THEN '$.items[].capacity_mw: not above 0' END) END AS problems FROM held""", Oracle)

LANDED_SQL = statement(f"""
    WITH {_RULES.strip()},
    tally AS (SELECT application_id, CAST(count(*) FILTER (WHERE vote_position = 'for') AS INT) AS f, CAST(count(*) FILTER (WHERE vote_position = 'against') AS INT) AS g FROM vote GROUP BY application_id),
    told AS (SELECT h.*, CASE WHEN t.f + t.g > 0 THEN t.f END AS f, CASE WHEN t.f + t.g > 0 THEN t.g END AS g, r.relief, h.decided_on >= DATE '1998-01-01' AS later
             FROM held h LEFT JOIN tally t ON t.application_id = h.application_id LEFT JOIN relief r ON r.application_id = h.application_id WHERE h.status = 'landed'),
    placed AS (SELECT *, row_number() OVER (PARTITION BY county_id, applicant_id ORDER BY later, document_id) AS i, row_number() OVER (PARTITION BY county_id, applicant_id ORDER BY later DESC, document_id DESC) AS j FROM told)
    SELECT a.county_id, 'C-' || CAST(a.applicant_id AS VARCHAR) AS external_id, a.document_id, a.use_class, array_to_string(a.relief, ',') AS relief, a.capacity_mw, a.acres, a.filed_on, b.decided_on, b.outcome, b.f AS vote_for, b.g AS vote_against, a.staff AS staff_recommendation
    FROM placed a JOIN placed b ON b.county_id = a.county_id AND b.applicant_id = a.applicant_id AND b.j = 1 WHERE a.i = 1""", Oracle)

def extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after three batches, each of them with all that came before: known predictions are refused and the chain goes on."""
    store = fresh(spark, "published")
    issued = query(_payloads)[0](spark, sf_dir).select(F.col("seq").alias("subject"), "payload", "published_on")
    for epoch, until in enumerate(EPOCHS):
        published.publish(issued.where(F.col("published_on") < F.to_date(F.lit(until))), store, epoch)
    return published.entries(spark, store).select("epoch", "seq", "subject", "payload_hash", "prev_hash", "entry_hash")


EPOCHS = ("1996-01-01", "1999-01-01", "9999-12-31")
_EPOCH = " ".join(f"WHEN published_on < DATE '{day}' THEN {k}" for k, day in enumerate(EPOCHS))
EXTENDED_SQL = statement(f"""
    WITH every AS ({_payloads(Oracle).strip()}), dealt AS (SELECT seq AS subject, payload, CASE {_EPOCH} END AS epoch FROM every),
    entry AS (SELECT CAST(epoch AS BIGINT) AS epoch, subject, sha256(payload) AS payload_hash, row_number() OVER (ORDER BY epoch, subject) AS rn FROM dealt WHERE epoch IS NOT NULL),
    chained AS (SELECT rn, epoch, subject, payload_hash, '{GENESIS}' AS prev_hash, sha256('{GENESIS}' || payload_hash) AS entry_hash FROM entry WHERE rn = 1
                UNION ALL SELECT e.rn, e.epoch, e.subject, e.payload_hash, c.entry_hash, sha256(c.entry_hash || e.payload_hash) FROM chained c JOIN entry e ON e.rn = c.rn + 1)
    SELECT epoch, rn - 1 AS seq, subject, payload_hash, prev_hash, entry_hash FROM chained""", Oracle).replace("WITH ", "WITH RECURSIVE ", 1)

QUERIES = {"ledger_extended": (extended, EXTENDED_SQL), "extraction_judged": (judged, JUDGED_SQL), "extraction_landed": (landed, LANDED_SQL)}
