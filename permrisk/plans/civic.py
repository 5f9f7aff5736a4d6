"""The readers of civic sources over answers made from the tables: meetings, documents, archives, portals and pasted sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permrisk.plans.dialect import Oracle
from permrisk.plans.graph import frame, statement
from permrisk.sources import adapters, answers, civic
from permrisk.sources.scratch import fresh
from permrisk.streaming.changes import drained

SINCE = "1994-06-01"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "member").select("member_id", "county_id", F.col("term_start").alias("day"))


def _api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer of an events API for each county, and one that is no JSON."""
    i = F.col("member_id")
    name = lambda head, tail: F.concat(F.lit(head), i.cast("string"), F.lit(tail))
    item = F.struct(F.lit("t").alias("EventItemTitle"), F.array(F.struct(F.when(i % 2 == 0, "Staff Report").otherwise("Map").alias("MatterAttachmentName"), name("r", ".pdf").alias("MatterAttachmentHyperlink"))).alias("EventItemMatterAttachments"))
    event = F.struct(
        i.alias("EventId"), F.concat(F.lit("Board "), (i % 5).cast("string")).alias("EventBodyName"), F.when(i % 11 == 0, "soon").otherwise(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T00:00:00"))).alias("EventDate"), name("a", ".pdf").alias("EventAgendaFile"),
        F.when(i % 2 == 0, name("m", ".pdf")).alias("EventMinutesFile"), F.when(i % 3 == 0, name("x clip_id=", "")).when(i % 3 == 1, name("see https://v.example/", ".mp4 now")).alias("EventVideoPath"), F.when(i % 7 == 0, "CANCELLED").alias("EventComment"), F.when(i % 4 == 0, F.array(item)).alias("EventItems"),
    )
    answers = _members(spark, sf_dir).groupBy("county_id").agg(F.to_json(F.collect_list(event)).alias("json")).select("json")
    return answers.unionByName(spark.createDataFrame([("no json",), (None,)], "json string"))


def api_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return civic.api_meetings(_api(spark, sf_dir), SINCE, limit=20)


API_SQL = statement(f"""
    WITH m AS (SELECT *, row_number() OVER (PARTITION BY county_id ORDER BY term_start, member_id) AS rn FROM member WHERE member_id % 11 <> 0 AND term_start >= DATE '{SINCE}')
    SELECT member_id AS meeting_id, 'Board ' || member_id % 5 AS body, term_start AS held_on, member_id % 7 = 0 AS cancelled, CASE member_id % 3 WHEN 0 THEN CAST(member_id AS VARCHAR) WHEN 1 THEN 'https://v.example/' || member_id || '.mp4' END AS media_url FROM m WHERE rn <= 20""", Oracle)


def api_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return civic.api_documents(_api(spark, sf_dir))


DOCUMENTS_SQL = statement("""
    SELECT member_id AS meeting_id, 'agenda' AS kind, 'a' || member_id || '.pdf' AS url FROM member UNION ALL SELECT member_id, 'minutes', 'm' || member_id || '.pdf' FROM member WHERE member_id % 2 = 0
    UNION ALL SELECT member_id, 'staff_report', 'r' || member_id || '.pdf' FROM member WHERE member_id % 4 = 0""", Oracle)


def portal_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portals that answer with a list, and those that put it under a name."""
    i = F.col("member_id").cast("string")
    m = F.struct(i.alias("id"), F.lit("T").alias("title"), F.date_format("day", "MM/dd/yyyy").alias("date"), F.concat(F.lit("a"), i).alias("agendaUrl"), F.when(F.col("member_id") % 3 == 0, F.concat(F.lit("p"), i)).alias("packetUrl"))
    listed = _members(spark, sf_dir).groupBy("county_id").agg(F.collect_list(m).alias("ms"))
    json = F.when(F.col("county_id") % 2 == 0, F.to_json("ms")).otherwise(F.to_json(F.struct(F.col("ms").alias("meetings"))))
    return civic.portal_meetings(listed.select(json.alias("json")), SINCE).select(F.col("id").cast("bigint").alias("meeting_id"), "held_on", "kind", "url")


PORTAL_SQL = statement(f"""
    SELECT member_id AS meeting_id, term_start AS held_on, 'agenda' AS kind, 'a' || member_id AS url FROM member WHERE term_start >= DATE '{SINCE}' UNION ALL SELECT member_id, term_start, 'packet', 'p' || member_id FROM member WHERE term_start >= DATE '{SINCE}' AND member_id % 3 = 0""", Oracle)


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of past meetings with days in three forms; a body that met twice on a day is one row."""
    i = F.col("member_id")
    day = F.when(i % 3 == 0, F.date_format("day", "M/d/yyyy")).when(i % 3 == 1, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "MMMM d, yyyy"))
    row = F.concat(F.lit("<tr><td><b>Body "), (i % 10).cast("string"), F.lit("</b></td><td>"), day, F.lit("</td><td><a href='d"), i.cast("string"), F.lit(".pdf'>agenda</a></td></tr>"))
    pages = _members(spark, sf_dir).groupBy("county_id").agg(F.concat(F.lit("<table><tr><th>Body</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    return civic.archive_rows(pages.select("html"), SINCE).select("body", "held_on")


ARCHIVE_SQL = statement(f"SELECT DISTINCT 'Body ' || member_id % 10 AS body, term_start AS held_on FROM member WHERE term_start >= DATE '{SINCE}'", Oracle)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size")
    k = F.col("p_partkey")
    county = F.when(k % 13 == 0, "Nowhere").when(k % 2 == 0, "Loudoun").otherwise("prince william")
    line = F.concat(F.lit('"'), "p_name", F.lit(', site",'), county, F.lit(","), F.when(k % 17 == 0, "castle").otherwise("solar"), F.lit(',"'), F.format_string("%,d", k.cast("bigint") * 100), F.lit(' MW"'))
    head = spark.createDataFrame([(-3, "# pasted"), (-2, ""), (-1, "Name,County,Use,MW")], "n bigint, line string")
    return p.select(k.cast("bigint").alias("n"), line.alias("line")).unionByName(head)


def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pasted sites and the lines that are none, with why."""
    sites, problems = civic.site_list(_lines(spark, sf_dir), ["Loudoun", "Prince William"], ["solar"])
    good = sites.groupBy(F.lower("county").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.sum("capacity_mw").cast("bigint").alias("mw"))
    return good.unionByName(problems.groupBy(F.col("reason").alias("what")).agg(F.count(F.lit(1)).alias("n")).withColumn("mw", F.lit(None).cast("bigint")))


SITES_SQL = """
    SELECT CASE WHEN p_partkey % 13 = 0 THEN 'unknown county' WHEN p_partkey % 17 = 0 THEN 'unknown use class' WHEN p_partkey % 2 = 0 THEN 'loudoun' ELSE 'prince william' END AS what, count(*) AS n,
           CAST(sum(CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 THEN p_partkey * 100 END) AS BIGINT) AS mw FROM part GROUP BY 1"""

def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each county and year of terms, in the form of one of three platforms."""
    i = F.col("member_id").cast("string")
    day, body = F.date_format("day", "yyyy-MM-dd"), F.concat(F.lit("Board "), (F.col("member_id") % 5).cast("string"))
    event = F.to_json(F.struct(F.col("member_id").alias("EventId"), body.alias("EventBodyName"), F.concat(day, F.lit("T00:00:00")).alias("EventDate"), F.concat(F.lit("a"), i).alias("EventAgendaFile")))
    record = F.to_json(F.struct(i.alias("id"), body.alias("committee"), F.date_format("day", "M/d/yyyy").alias("date"), F.concat(F.lit("a"), i).alias("agendaUrl"), F.concat(F.lit("m"), i).alias("minutesUrl")))
    row = F.concat(F.lit("<h2>Body "), i, F.lit("</h2><ul><li>"), F.date_format("day", "MMMM d, yyyy"), F.lit(" <a href='/w"), i, F.lit("'>Watch</a></li></ul>"))
    kind = F.element_at(F.array(F.lit("legistar"), F.lit("opengov"), F.lit("civicplus")), (F.col("county_id") % 3 + 1).cast("int"))
    rows = _members(spark, sf_dir).where("day IS NOT NULL").select("county_id", F.year("day").alias("year"), "day", F.when(F.col("county_id") % 3 == 0, event).when(F.col("county_id") % 3 == 1, record).otherwise(row).alias("item"))
    said = rows.groupBy("county_id", "year").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.collect_list("item").alias("items"))
    answer = F.when(F.col("county_id") % 3 == 2, F.array_join("items", "")).otherwise(F.concat(F.lit("["), F.array_join("items", ","), F.lit("]")))
    return said.select(kind.alias("platform"), F.concat(F.lit("https://c"), F.col("county_id").cast("string"), F.lit(".example")).alias("source"), F.col("last_day").alias("fetched_on"), "first_day", "last_day", answer.alias("answer"), (F.col("year") % 2).alias("odd"))


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """A store with the answers about even years as its first batch and those about odd ones as its second, by days."""
    answers.register(spark)
    path = fresh(spark, "answers")
    for batch in (0, 1):
        part = _answers(spark, sf_dir).where(F.col("odd") == batch).drop("odd").repartitionByRange(8, "last_day")
        part.write.format("civic_answers").option("path", path).option("batch", batch).mode("append").save()
    return path


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meetings of stored answers since a day: files are chosen by the days of their answers, meetings by their own."""
    path = _landed(spark, sf_dir)
    of = lambda name: adapters.for_platform(name).meetings(answers.stored(spark, path, [name], since=SINCE))
    found = reduce(DataFrame.unionByName, [of(name) for name in ("legistar", "opengov", "civicplus")]).where(F.col("held_on") >= F.lit(SINCE).cast("date"))
    return found.select("platform", "source", "external_id", "body", "held_on", "media", F.size("documents").alias("n_documents"))


def _meetings_sql(condition: str) -> str:
    return f"""
    SELECT platform, 'https://c' || county_id || '.example' AS source, CASE platform WHEN 'civicplus' THEN 'Body ' || member_id || ':' || strftime(term_start, '%Y-%m-%d') ELSE CAST(member_id AS VARCHAR) END AS external_id,
           CASE platform WHEN 'civicplus' THEN 'Body ' || member_id ELSE 'Board ' || member_id % 5 END AS body, term_start AS held_on, CASE platform WHEN 'civicplus' THEN 'https://c' || county_id || '.example/w' || member_id END AS media,
           CAST(CASE platform WHEN 'opengov' THEN 2 ELSE 1 END AS INT) AS n_documents
    FROM (SELECT *, CASE county_id % 3 WHEN 0 THEN 'legistar' WHEN 1 THEN 'opengov' ELSE 'civicplus' END AS platform FROM member WHERE {condition}) m"""


LANDED_SQL = statement(_meetings_sql(f"term_start >= DATE '{SINCE}'"), Oracle)


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by platform, source and kind of a store that is read as a stream, batch by batch."""
    path = _landed(spark, sf_dir)
    stored = drained(spark.readStream.format("civic_answers").option("path", path).load(), "answers-read")
    return adapters.documents(stored).groupBy("platform", "source", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("n_urls"), F.max("published_on").alias("last_on"))


STREAMED_SQL = statement(f"""
    WITH m AS ({_meetings_sql("term_start IS NOT NULL")}), d AS (
        SELECT *, CASE platform WHEN 'civicplus' THEN 'other' ELSE 'agenda' END AS kind FROM m UNION ALL SELECT *, 'minutes' FROM m WHERE platform = 'opengov')
    SELECT platform, source, kind, count(*) AS n, count(DISTINCT external_id) AS n_urls, max(held_on) AS last_on FROM d GROUP BY platform, source, kind""", Oracle)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to look for the answers of each county, by its platform and what is known of it."""
    c = frame(spark, sf_dir, "county").select("county_id")
    key, name = F.col("county_id") % 6, F.concat(F.lit("c"), F.col("county_id").cast("string"))
    kind = F.element_at(F.array(*[F.lit(n) for n in adapters.ADAPTERS]), (key + 1).cast("int"))
    settings = {0: "legistar_client", 3: "accela_agency", 4: "opengov_tenant", 5: "municode_client_id"}
    config = F.create_map(*[x for k, n in settings.items() for x in (F.lit(n), F.when(key == k, name))])
    sites = c.select(kind.alias("platform"), F.concat(F.lit("https://"), name, F.lit(".example/")).alias("root"), config.alias("config"))
    return adapters.discovered(sites).select("root", "platform", "kind", "url")


PLACES_SQL = statement("""
    WITH c AS (SELECT county_id % 6 AS k, 'c' || county_id AS n, 'https://c' || county_id || '.example' AS r FROM county),
    p AS (SELECT * FROM (VALUES (0, 'legistar', 'agenda', 'https://webapi.legistar.com/v1/', '/Events'), (0, 'legistar', 'application_packet', 'https://webapi.legistar.com/v1/', '/Matters'), (0, 'legistar', 'other', 'https://webapi.legistar.com/v1/', '/Bodies'),
        (1, 'granicus', 'agenda', NULL, '/ViewPublisher.php?view_id=2'), (2, 'civicplus', 'agenda', NULL, '/AgendaCenter'), (2, 'civicplus', 'agenda', NULL, '/AgendaCenter/Search/?term=&CIDs=all&startDate=&endDate=&dateRange=&dateSelector='), (2, 'civicplus', 'minutes', NULL, '/ArchiveCenter'),
        (3, 'accela', 'application_packet', 'https://apis.accela.com/v4/records', NULL), (4, 'opengov', 'agenda', 'https://', '.opengov.com/api/meetings'), (5, 'municode', 'ordinance', 'https://api.municode.com/codesContent?jobId=', ''), (5, 'municode', 'ordinance', 'https://api.municode.com/CodesToc?jobId=', '')) v(k, platform, kind, head, tail))
    SELECT c.r || '/' AS root, platform, kind, CASE WHEN head IS NULL THEN c.r || tail WHEN tail IS NULL THEN head ELSE head || c.n || tail END AS url FROM c JOIN p ON p.k = c.k""", Oracle)

QUERIES = {
    "civic_meetings": (api_meetings, API_SQL), "civic_documents": (api_documents, DOCUMENTS_SQL), "civic_portals": (portal_meetings, PORTAL_SQL), "civic_archives": (archive_rows, ARCHIVE_SQL), "civic_sites": (site_list, SITES_SQL),
    "civic_landed": (landed, LANDED_SQL), "civic_streamed": (streamed, STREAMED_SQL), "civic_places": (places, PLACES_SQL),
}
