"""Landing of extracted decisions: schema, quotes, review, and a keyed merge that can be run again.

An answer is a JSON list of items for one document. It is held to its schema as
a whole; then an item whose quotes are not all in the document is discarded, one
of low confidence waits for review, one without a use is an event only, and the
rest land as applications. A store is a folder of tables in folders by county;
only the counties of a batch are written anew, and a document whose run is
recorded is not landed again, so a batch that is repeated changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.functions.contract import bound, errors
from permrisk.functions.text import folded
from permrisk.sources.scratch import fresh

# fixed values: the bar for review, and the limits that answers are held to
REVIEW, VERSION = 0.6, "1.0.0"
VOTE = "^[0-9]+-[0-9]+(-[0-9]+)?$"


def _listed(members, most: int) -> dict:
    return {"type": "array", "items": members, "maxItems": most}


def decision_schema(event_types, bodies, uses, reliefs, outcomes, grounds) -> dict:
    """What an answer about decisions must be: {"items": [...]}, every item with an outcome, a confidence and a quote."""
    text = lambda most: {"type": ["string", "null"], "maxLength": most}
    day, amount = {"type": ["string", "null"], "format": "date"}, {"type": ["number", "null"], "exclusiveMinimum": 0}
    quote = {"type": "object", "additionalProperties": False, "required": ["page", "quote"], "properties": {"page": {"type": "integer", "minimum": 1}, "quote": {"type": "string", "minLength": 10, "maxLength": 500}}}
    item = {
        "type": "object", "additionalProperties": False, "required": ["event_type", "outcome", "confidence", "evidence"],
        "properties": {
            "event_type": {"enum": list(event_types)}, "outcome": {"enum": list(outcomes)}, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "evidence": _listed(quote, 6) | {"minItems": 1},
            "body": {"enum": [*bodies, None]}, "use_class": {"enum": [*uses, None]}, "staff_recommendation": {"enum": ["approve", "approve_with_conditions", "deny", "none", None]},
            "case_number": text(80), "applicant": text(300), "project_name": text(300), "vote": {"type": ["string", "null"], "pattern": VOTE}, "filed_on": day, "decided_on": day, "acres": amount, "capacity_mw": amount,
            "relief_sought": _listed({"enum": list(reliefs)}, 8), "objection_grounds": _listed({"enum": list(grounds)}, 12), "conditions": _listed({"type": "string", "maxLength": 500}, 40),
            "organised_opposition": {"type": ["boolean", "null"]}, "speakers_against": {"type": ["integer", "null"], "minimum": 0},
        },
    }
    return {"type": "object", "additionalProperties": False, "required": ["items"], "properties": {"items": {"type": "array", "items": item}}}


def judged(answers: DataFrame, schema: dict) -> DataFrame:
    """(document_id, county_id, position, status, problems, item) of answers (document_id, county_id, text, answer).

    ``status`` is schema_violation (one row for the answer), quote_failed, review, event_only or
    landed. An answer that is no JSON breaks the schema; a null one, or one without items, has no row.
    """
    read = F.try_parse_json("answer")
    told = answers.where("answer IS NOT NULL").select("document_id", "county_id", folded(F.col("text")).alias("text"), read.alias("v"))
    # one list an answer, made once: a condition on the messages, or a second branch, would evaluate every rule again
    entry = lambda position, problems, item: F.struct(position.cast("int").alias("position"), problems.alias("problems"), item.alias("item"))
    problems = F.when(F.col("v").isNull(), F.array(F.lit("$: not JSON"))).otherwise(errors(F.col("v"), schema))
    items = F.transform(F.try_variant_get("v", "$.items", "array<variant>"), lambda item, k: entry(k, F.array().cast("array<string>"), item))
    entries = bound(problems, lambda p: F.when(F.size(p) > 0, F.array(entry(F.lit(0), p, F.lit(None).cast("variant")))).otherwise(items))
    told = told.select("document_id", "county_id", "text", F.explode_outer(entries).alias("e")).where("e IS NOT NULL").select("document_id", "county_id", "text", "e.*")
    quotes = F.try_variant_get("item", "$.evidence", "array<struct<page:bigint,quote:string>>")
    lost = F.exists(quotes, lambda q: ~F.contains(F.col("text"), folded(q.quote)))
    sure, use = F.try_variant_get("item", "$.confidence", "double"), F.try_variant_get("item", "$.use_class", "string")
    status = F.when(F.coalesce(lost, F.lit(True)), "quote_failed").when(sure < REVIEW, "review").when(use.isNull(), "event_only").otherwise("landed")
    return told.select("document_id", "county_id", "position", F.when(F.size("problems") > 0, "schema_violation").otherwise(status).alias("status"), "problems", "item")


def _member(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("item", f"$.{name}", kind)


def applications(items: DataFrame) -> DataFrame:
    """Landed items as rows of applications, keyed by county and case number, or by document and project where there is none."""
    tally = F.split(_member("vote"), "-")
    at = lambda k: F.try_element_at(tally, F.lit(k)).cast("int")
    name = F.coalesce(_member("case_number"), F.concat_ws(":", F.lit("extracted"), F.substring(F.col("document_id").cast("string"), 1, 16), F.coalesce(_member("project_name"), F.lit("unnamed"))))
    return items.where("status = 'landed'").select(
        "county_id", name.alias("external_id"), "document_id", "position", _member("applicant").alias("applicant"), _member("use_class").alias("use_class"),
        F.coalesce(F.nullif(_member("relief_sought", "array<string>"), F.array().cast("array<string>")), F.array(F.lit("other"))).alias("relief_sought"), _member("capacity_mw", "double").alias("capacity_mw"), _member("acres", "double").alias("acres"),
        F.try_to_date(_member("filed_on"), "yyyy-MM-dd").alias("filed_on"), F.try_to_date(_member("decided_on"), "yyyy-MM-dd").alias("decided_on"), _member("outcome").alias("outcome"), at(1).alias("vote_for"), at(2).alias("vote_against"), _member("staff_recommendation").alias("staff_recommendation"),
    )


#: What a later item of the same key overwrites; everything else stays as it was first told.
LATEST = ("outcome", "decided_on", "vote_for", "vote_against")


def merged(held: DataFrame, told: DataFrame) -> DataFrame:
    """Rows of ``held`` and ``told`` in one row a key: the first of all, with what the last one says of the outcome.

    Both are ordered by document and position within a batch, and what is held comes before what is told.
    """
    both = held.withColumn("batch", F.lit(0)).unionByName(told.withColumn("batch", F.lit(1)))
    place = F.struct("batch", F.col("document_id"), "position")
    rest = [c for c in told.columns if c not in ("county_id", "external_id", *LATEST)]
    # aggregates keep one row a key and task, so a case that is told of often gathers nowhere
    rows = both.groupBy("county_id", "external_id").agg(F.min_by(F.struct(*rest), place).alias("first"), F.max_by(F.struct(*LATEST), place).alias("last"))
    return rows.select("county_id", "external_id", "first.*", "last.*").select(*told.columns)


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table of the store, empty before the first batch."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(like.schema).parquet(path)
    return like.limit(0)


def land(answers: DataFrame, schema: dict, store: str) -> None:
    """Land the answers whose documents have no recorded run: tables applications, evidence, review and runs of ``store``.

    Runs are written last: a batch that breaks off is landed again, and its rows replace each other
    by key. A document is answered for once in a batch.
    """
    spark = answers.sparkSession
    version = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.lit("decision_event"), F.lit(VERSION)), 256)
    keyed = answers.withColumn("cache_key", version)
    shape = keyed.select("cache_key", "document_id", "county_id", F.lit("").alias("status"), F.lit(0).cast("bigint").alias("landed"), F.lit(0).cast("bigint").alias("discarded"))
    new = keyed.join(_read(spark, f"{store}/runs", shape).select("cache_key"), "cache_key", "left_anti")
    path = fresh(spark, "items")
    # once, so that all tables are of the same items
    new.select("cache_key", "document_id", "county_id").write.parquet(f"{path}/asked")
    judged(new, schema).write.parquet(f"{path}/items")
    asked, items = spark.read.parquet(f"{path}/asked"), spark.read.parquet(f"{path}/items")
    counties = items.select("county_id").distinct()
    told = applications(items)
    landed = items.where("status = 'landed'")
    quotes = landed.select("county_id", "document_id", "position", F.posexplode(_member("evidence", "array<struct<page:bigint,quote:string>>")).alias("quote_no", "q")).select("county_id", "document_id", "position", "quote_no", F.col("q.page").alias("page"), F.col("q.quote").alias("quote"))
    waiting = items.where("status = 'review'").select("county_id", "document_id", "position", F.to_json("item").alias("item"))
    for name, rows, merge in (("applications", told, merged), ("evidence", quotes, _replaced), ("review", waiting, _replaced)):
        held = _read(spark, f"{store}/{name}", rows).join(F.broadcast(counties), "county_id", "left_semi")
        both = f"{path}/{name}"
        merge(held, rows).write.parquet(both)
        spark.read.parquet(both).repartition("county_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("county_id").parquet(f"{store}/{name}")
    told_of = items.groupBy("document_id").agg(F.count_if(F.col("status") == "schema_violation").alias("broken"), F.count_if(F.col("status") == "landed").alias("landed"), F.count_if(F.col("status") == "quote_failed").alias("discarded"))
    runs = asked.join(told_of, "document_id", "left").select("cache_key", "document_id", "county_id", F.when(F.col("broken") > 0, "schema_violation").otherwise("ok").alias("status"), F.coalesce("landed", F.lit(0)).cast("bigint").alias("landed"), F.coalesce("discarded", F.lit(0)).cast("bigint").alias("discarded"))
    runs.write.mode("append").parquet(f"{store}/runs")


def _replaced(held: DataFrame, told: DataFrame) -> DataFrame:
    """Rows held of documents that are not told of, and what is told."""
    return held.select(*told.columns).join(told.select("document_id").distinct(), "document_id", "left_anti").select(*told.columns).unionByName(told)


def table(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{store}/{name}")
