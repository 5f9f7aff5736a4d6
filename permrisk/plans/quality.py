"""Row rules, key rules, upserts and snapshots, as set operations over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.plans.graph import query

RULES = {
    "application": (
        ("outcome in vocabulary", "outcome IN ('approved', 'denied', 'withdrawn', 'pending', 'approved_with_conditions')"),
        ("decided needs a date", "outcome = 'pending' OR decided_on IS NOT NULL"),
        ("pending has no date", "outcome <> 'pending' OR decided_on IS NULL"),
        ("dates in order", "decided_on >= filed_on"),
        ("acres positive", "acres > 2"),
        ("staff in vocabulary", "staff IN ('approve', 'approve_with_conditions')"),
    ),
    "instrument": (("adopted before end", "expires_on > adopted_on"), ("setback in range", "setback_ft BETWEEN 20 AND 480")),
    "member": (("term in order", "term_end >= term_start"), ("starts in the nineties", "term_start < DATE '1998-01-01'")),
}
KEYS = {"application": "application_id", "instrument": "instrument_id", "member": "member_id"}


def violations(d):
    """A rule that cannot be told (null) is kept; a broken one names its row."""
    return " UNION ALL ".join(f"SELECT '{t}' AS subject, '{r}' AS rule, {KEYS[t]} AS subject_id FROM {t} WHERE NOT coalesce({c}, true)" for t, rules in RULES.items() for r, c in rules)


def violation_counts(d):
    return f"SELECT subject, rule, count(*) AS n FROM ({violations(d)}) v GROUP BY subject, rule"


def tallies(d):
    """Votes of each decision against its outcome: the larger side should have won."""
    return """
    WITH tally AS (SELECT application_id, count(*) FILTER (WHERE vote_position = 'for') AS ayes, count(*) FILTER (WHERE vote_position = 'against') AS noes, count(*) AS n, count(DISTINCT member_id) AS members FROM vote GROUP BY application_id)
    SELECT t.application_id, t.ayes, t.noes, round(CAST(t.ayes AS DOUBLE) / nullif(t.ayes + t.noes, 0), 6) AS margin, t.n = t.members AS no_duplicates,
           CASE WHEN t.ayes + t.noes = 0 OR a.outcome IN ('pending', 'withdrawn') THEN NULL ELSE (t.ayes > t.noes) = (a.outcome <> 'denied') END AS agrees
    FROM tally t JOIN application a ON a.application_id = t.application_id"""


def terms_cover(d):
    """Votes cast outside the member's term; both ends of a term belong to it."""
    return """
    SELECT v.application_id, v.member_id FROM vote v JOIN member m ON m.member_id = v.member_id JOIN application a ON a.application_id = v.application_id
    WHERE a.decided_on IS NOT NULL AND NOT (m.term_start <= a.decided_on AND (m.term_end IS NULL OR m.term_end >= a.decided_on))"""


def citations(d):
    """Evidence rule: one primary citation or two different sources."""
    return """
    WITH cited AS (SELECT l_orderkey AS application_id, bool_or(l_returnflag = 'R') AS primary_one, count(DISTINCT l_suppkey) AS hosts FROM lineitem GROUP BY l_orderkey)
    SELECT application_id, primary_one, hosts, primary_one OR hosts >= 2 AS enough FROM cited"""


def ids_twice(d):
    """Ids used in two sections."""
    return """
    SELECT id, count(*) AS sections FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT p_partkey FROM part) u GROUP BY id HAVING count(*) > 1"""


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key: what has no successor stays. Null keys match null keys."""
    n = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & old[k].eqNullSafe(F.col(f"__{k}"))
    return old.join(n, on, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of unknown key are added, one for each key; known keys stay as they are."""
    known = old.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & new[k].eqNullSafe(F.col(f"__{k}"))
    return old.unionByName(new.join(known, on, "left_anti").dropDuplicates(keys))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = spark.read.parquet(f"{sf_dir}/orders.parquet")
    old = a.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(1).alias("version"), "o_totalprice")
    new = a.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(2).alias("version"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return old, new


def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert(*_snapshots(spark, sf_dir), ["o_orderkey"])


def snapshot_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insert_new(*_snapshots(spark, sf_dir), ["o_orderkey"])


_OLD = "SELECT o_orderkey, 1 AS version, o_totalprice FROM orders WHERE o_orderkey % 2 = 0"
_NEW = "SELECT o_orderkey, 2 AS version, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0"
UPSERT_SQL = f"SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.version, o.version) AS version, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON n.o_orderkey = o.o_orderkey"
INSERT_SQL = f"SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.version, n.version) AS version, coalesce(o.o_totalprice, n.o_totalprice) AS o_totalprice FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON n.o_orderkey = o.o_orderkey"


def manifest(d):
    """Row count and content digest of the small tables, by which two snapshots compare."""
    parts = (("region", "r_name", "r_regionkey"), ("nation", "n_name", "n_nationkey"), ("supplier", "s_name", "s_suppkey"))
    return " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, md5({d.joined(f'md5({c})', k)}) AS digest FROM {t}" for t, c, k in parts)


def extraction_score(d):
    """Extracted rows against expected ones: matched on the case number, then field by field; null equals null."""
    same = "IS NOT DISTINCT FROM"
    return f"""
    WITH expected AS (SELECT o_orderkey AS id, o_orderstatus AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 5 <> 0),
    got AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE o_orderpriority END AS b FROM orders WHERE o_orderkey % 6 <> 0),
    met AS (SELECT e.id AS eid, g.id AS gid, e.a AS ea, g.a AS ga, e.b AS eb, g.b AS gb FROM expected e FULL OUTER JOIN got g ON g.id = e.id)
    SELECT count(*) FILTER (WHERE eid IS NOT NULL AND gid IS NOT NULL) AS matched, count(*) FILTER (WHERE gid IS NULL) AS missed, count(*) FILTER (WHERE eid IS NULL) AS spurious,
           CAST(sum(CASE WHEN eid IS NOT NULL AND gid IS NOT NULL THEN CASE WHEN ea {same} ga THEN 1 ELSE 0 END + CASE WHEN eb {same} gb THEN 1 ELSE 0 END END) AS BIGINT) AS fields_right FROM met"""


QUERIES = {f"quality_{f.__name__}": query(f) for f in (violations, violation_counts, tallies, terms_cover, citations, ids_twice, manifest, extraction_score)} | {
    "snapshot_upsert": (snapshot_upsert, UPSERT_SQL), "snapshot_insert": (snapshot_insert, INSERT_SQL),
}
