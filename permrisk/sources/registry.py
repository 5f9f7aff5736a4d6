"""Registry and label files: YAML or JSON into tables with a fixed schema, and the rows that break a rule.

These files are kept by hand and small, one entry a county, so they are read on
the driver; what they are held against may be of any size.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = "slug string, name string, fips string, platform string, framework string, seats int, quorum int, threshold string, term_years int, stagger_years int, deciders int"
LABELS = "label_id string, county string, use_class string, outcome string, filed_on string, decided_on string, votes_for int, votes_against int, sources array<struct<kind:string,url:string>>"
# fixed values: how a majority may be counted, and outcomes
THRESHOLDS = ("majority_present", "majority_full", "two_thirds", "three_fourths")
OUTCOMES = ("approved", "approved_with_conditions", "denied", "withdrawn", "pending", "continued", "tabled")


def _entries(text: str, section: str) -> list[dict]:
    try:
        found = json.loads(text)
    except ValueError:
        import yaml  # only for files that are not JSON

        found = yaml.safe_load(text)
    rows = found.get(section, []) if isinstance(found, dict) else found or []
    return [{k: str(v) if k.endswith("_on") or k == "fips" else v for k, v in r.items() if v is not None} for r in rows]


def _table(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    lines = [(json.dumps(r),) for r in _entries(text, section)]
    rows = spark.createDataFrame(lines, "line string").select(F.from_json("line", schema).alias("r"))
    return rows.select("r.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "jurisdictions", REGISTRY)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "decisions", LABELS).withColumns({c: F.col(c).try_cast("date") for c in ("filed_on", "decided_on")})


def read_platforms(spark: SparkSession, path: str) -> DataFrame:
    """Platforms found by probing; what could not be told is left out."""
    return _table(spark, path, "platforms", "slug string, platform string, confidence double").where("platform <> 'unknown'")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that is not true; what cannot be told breaks none."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def _once(rows: DataFrame, key: str, column: str) -> DataFrame:
    again = rows.groupBy(F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(key)).where("n > 1")
    return again.select(key, F.lit(f"{column} is not unique").alias("rule"))


def registry_violations(rows: DataFrame) -> DataFrame:
    rules = {
        "slug has other characters": F.col("slug").rlike("^[a-z0-9-]+$"), "fips is not five digits": F.col("fips").rlike("^[0-9]{5}$"), "quorum exceeds the seats": F.col("quorum") <= F.col("seats"),
        "unknown threshold": F.col("threshold").isin(*THRESHOLDS), "stagger exceeds the term": F.col("stagger_years") <= F.col("term_years"), "not one decider": F.col("deciders") == 1,
    }
    return violations(rows, "slug", rules).unionByName(_once(rows, "slug", "slug")).unionByName(_once(rows, "slug", "fips"))


def label_violations(rows: DataFrame) -> DataFrame:
    host = F.transform("sources", lambda s: F.regexp_extract(s.url, "^[a-z]+://([^/]+)", 1))
    settled = F.col("outcome").isin("approved", "approved_with_conditions", "denied")
    tally = F.col("votes_for") > F.col("votes_against")
    rules = {
        "unknown outcome": F.col("outcome").isin(*OUTCOMES), "settled without a date": ~settled | F.col("decided_on").isNotNull(), "pending with a date": (F.col("outcome") != "pending") | F.col("decided_on").isNull(),
        "decided before it was filed": F.col("decided_on") >= F.col("filed_on"), "tally against the outcome": ~settled | (tally == (F.col("outcome") != "denied")),
        "no primary source and not two hosts": F.exists("sources", lambda s: s.kind == "primary") | (F.size(F.array_distinct(host)) >= 2),
    }
    return violations(rows, "label_id", rules).unionByName(_once(rows, "label_id", "label_id"))


def reload_labels(graph: DataFrame, labels: DataFrame, source: str = "hand_labelled") -> DataFrame:
    """The graph's rows with everything of one label source taken out and the labels put in its place."""
    return graph.where(F.col("label_source") != source).unionByName(labels.withColumn("label_source", F.lit(source)), allowMissingColumns=True)
