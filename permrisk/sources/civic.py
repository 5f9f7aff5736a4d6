"""Readers of civic sources: meeting lists and documents of several platforms, pasted site lists, published ledgers.

Each takes rows that hold what a platform returned (JSON or HTML text) and
flattens them with built-in functions; fetching is not done here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permrisk.functions import text as T

EVENT = "struct<EventId:bigint,EventBodyName:string,EventDate:string,EventAgendaFile:string,EventMinutesFile:string,EventVideoPath:string,EventComment:string,EventAgendaStatusName:string,EventItems:array<struct<EventItemTitle:string,EventItemMatterAttachments:array<struct<MatterAttachmentName:string,MatterAttachmentHyperlink:string>>>>>"
MEDIA = (r"(https?://[^\s\"'<>]+MediaPlayer\.php\?[^\s\"'<>]+)", r"(https?://[^\s\"'<>]+\.mp4)", r"clip_id=(\d+)")


def api_meetings(rows: DataFrame, since: str, limit: int = 500, col: str = "json") -> DataFrame:
    """Meetings of an events API on or after ``since``, in order, at most ``limit`` for each response; unreadable dates are left out."""
    events = rows.select(F.monotonically_increasing_id().alias("response"), F.from_json(col, f"array<{EVENT}>").alias("es")).select("response", F.explode("es").alias("e"))
    day = T.civic_date(F.col("e.EventDate"))
    status = F.lower(F.concat_ws(" ", "e.EventComment", "e.EventAgendaStatusName"))
    out = events.select("response", F.col("e.EventId").alias("meeting_id"), F.col("e.EventBodyName").alias("body"), day.alias("held_on"), status.contains("cancel").alias("cancelled"), _media(F.col("e.EventVideoPath")).alias("media_url"))
    place = F.row_number().over(Window.partitionBy("response").orderBy("held_on", "meeting_id"))
    return out.where(F.col("held_on") >= F.lit(since).cast("date")).withColumn("place", place).where(F.col("place") <= limit).drop("response", "place")


def _media(raw):
    return F.coalesce(*[F.nullif(F.regexp_extract(raw, p, 1), F.lit("")) for p in MEDIA])


def api_documents(rows: DataFrame, col: str = "json") -> DataFrame:
    """Agenda, minutes and item attachments of each meeting, one row each."""
    e = rows.select(F.explode(F.from_json(col, f"array<{EVENT}>")).alias("e"))
    files = e.select(F.col("e.EventId").alias("meeting_id"), F.expr("stack(2, 'agenda', e.EventAgendaFile, 'minutes', e.EventMinutesFile) AS (kind, url)")).where("url IS NOT NULL")
    items = e.select(F.col("e.EventId").alias("meeting_id"), F.explode("e.EventItems").alias("i")).select("meeting_id", F.explode("i.EventItemMatterAttachments").alias("a"))
    attached = items.select("meeting_id", T.document_kind(F.col("a.MatterAttachmentName")).alias("kind"), F.col("a.MatterAttachmentHyperlink").alias("url")).where("url IS NOT NULL")
    return files.unionByName(attached)


def portal_meetings(rows: DataFrame, since: str, col: str = "json") -> DataFrame:
    """Meetings of a portal that answers with a list, or with one under ``meetings``; three links become document rows."""
    one = "struct<id:string,title:string,date:string,agendaUrl:string,minutesUrl:string,packetUrl:string>"
    listed = F.coalesce(F.from_json(col, f"struct<meetings:array<{one}>>")["meetings"], F.from_json(col, f"array<{one}>"))
    m = rows.select(F.explode(listed).alias("m")).select("m.*", T.civic_date(F.col("m.date")).alias("held_on")).where(F.col("held_on") >= F.lit(since).cast("date"))
    return m.select("id", "title", "held_on", F.expr("stack(3, 'agenda', agendaUrl, 'minutes', minutesUrl, 'packet', packetUrl) AS (kind, url)")).where("url IS NOT NULL")


def archive_rows(rows: DataFrame, since: str, col: str = "html") -> DataFrame:
    """Meetings of an HTML table: title, day and links of each row; one for each body and day."""
    r = rows.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?is)(<tr[^>]*>.*?</tr>)"), 1)).alias("r"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("r", r"(?s)<[^>]*>", " "), r"\s+", " "))
    day = F.coalesce(*[T.civic_date(F.nullif(F.regexp_extract(plain, p, 1), F.lit(""))) for p in (r"(\d{1,2}/\d{1,2}/\d{4})", r"(\d{4}-\d{2}-\d{2})", r"([A-Z][a-z]+ \d{1,2}, \d{4})")])
    title = F.trim(F.regexp_replace(F.regexp_extract("r", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", 1), r"(?s)<[^>]*>", " "))
    out = r.select(title.alias("body"), day.alias("held_on"), F.regexp_extract_all("r", F.lit("(?i)href=[\"']([^\"']+)[\"']"), 1).alias("links")).where(F.col("held_on") >= F.lit(since).cast("date"))
    return out.dropDuplicates(["body", "held_on"])


def platform(url, html):
    """Which platform a source runs on and how sure that is: by host, then by markup."""
    host = F.lower(F.expr(f"try_parse_url({url}, 'HOST')"))
    rules = [(host.contains("legistar"), "legistar", 0.95), (host.contains("granicus"), "granicus", 0.95), (host.contains("civicplus") | F.lower(url).contains("agendacenter"), "civicplus", 0.9), (host.contains("accela"), "accela", 0.9), (host.contains("opengov"), "opengov", 0.9), (host.contains("municode"), "municode", 0.9)]
    rules += [(F.lower(html).contains(n), n, 0.6) for n in ("legistar", "granicus", "civicplus", "accela", "opengov", "municode")]
    which, sure = F.lit(None).cast("string"), F.lit(0.0)
    for c, name, p in reversed(rules):
        which, sure = F.when(c, F.lit(name)).otherwise(which), F.when(c, F.lit(p)).otherwise(sure)
    return F.struct(F.coalesce(which, F.lit("unknown")).alias("platform"), sure.alias("confidence"))


COLUMNS = ("label", "county", "use_class", "acres", "capacity_mw", "relief")
# fixed values: other names of the columns of a site list
SYNONYMS = {
    "label": ("label", "name", "site", "site name", "project"), "county": ("county", "jurisdiction", "slug"), "use_class": ("use", "use class", "use_class", "type"),
    "acres": ("acres", "acreage", "area"), "capacity_mw": ("mw", "capacity", "capacity mw", "capacity_mw", "megawatts"), "relief": ("relief", "relief sought", "approvals"),
}


def site_list(lines: DataFrame, counties: list[str], uses: list[str], col: str = "line", order: str = "n") -> tuple[DataFrame, DataFrame]:
    """(sites, problems) of pasted lines: tabs or commas, quoted cells, a header in any order or none, # comments.

    The header, if there is one, is the first line that is neither blank nor a
    comment; it is a single row, found with ``min_by``. Each bad line gives one problem row.
    """
    live = lines.where((F.trim(col) != "") & ~F.col(col).startswith("#"))
    cells = F.when(F.col(col).contains("\t"), F.split(col, "\t")).otherwise(F.regexp_extract_all(F.concat(col, F.lit(",")), F.lit('("(?:[^"]|"")*"|[^,]*),'), 1))
    cells = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r'^\s*"(.*)"\s*$', "$1"), '""', '"')))
    cut = live.select(order, F.col(col).alias("content"), cells.alias("c"))
    first = cut.agg(F.min_by("c", order).alias("c"), F.min(order).alias("at")).first()
    names = [next((k for k, v in SYNONYMS.items() if x.lower() in v), None) for x in first.c or []] if first else []
    headed = sum(n is not None for n in names) >= 2
    places = {n: i for i, n in enumerate(names) if n} if headed else {n: i for i, n in enumerate(COLUMNS)}
    rows = cut.where(F.col(order) > first.at) if headed else cut
    cell = lambda n: F.nullif(F.get("c", F.lit(places[n])), F.lit("")) if n in places else F.lit(None).cast("string")
    number = lambda n: F.regexp_replace(F.regexp_replace(F.lower(cell(n)), r"\s*(mw|acres|ac)\s*$", ""), ",", "").try_cast("double")
    odd = lambda n: cell(n).isNotNull() & ~F.coalesce((number(n) > 0) & (number(n) < float("inf")), F.lit(False))
    reason = F.when(cell("county").isNull(), "no county").when(~F.lower(cell("county")).isin(*[x.lower() for x in counties]), "unknown county").when(cell("use_class").isNull(), "no use class")
    reason = reason.when(~F.lower(cell("use_class")).isin(*[x.lower() for x in uses]), "unknown use class").when(odd("acres"), "acres is not a positive number").when(odd("capacity_mw"), "capacity is not a positive number")
    judged = rows.select(F.col(order), "content", *[(number(n) if n in ("acres", "capacity_mw") else cell(n)).alias(n) for n in COLUMNS], reason.alias("reason"))
    return judged.where("reason IS NULL").drop("reason", "content"), judged.where("reason IS NOT NULL").select(order, "content", "reason")


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line, keys in order; partitions are written side by side."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def read_objects(spark, path: str) -> DataFrame:
    """Stored files with their content hash, which is also their key."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    h = F.sha2("content", 256)
    return f.select("path", "length", h.alias("content_hash"), F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h).alias("storage_key"), F.when(F.substring("content", 1, 5) == F.lit(b"%PDF-"), "pdf").otherwise("text").alias("kind"))
