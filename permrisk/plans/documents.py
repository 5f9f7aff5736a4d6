"""Documents as text: readers, chunks, quotes with their places, citations checked again, and the names in them resolved."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permrisk.functions import text as T
from permrisk.plans.dialect import Oracle
from permrisk.plans.graph import statement
from permrisk.plans.text import LEGIBILITY_SQL
from permrisk.sources.scratch import fresh

MOST_CHARS, LEAST_CHARS = 6000, 200
LEGIBLE = 0.55
_HEADS = [re.compile(p) for p in T.HEADINGS]


def _is_heading(line: str) -> bool:
    line = line.strip()
    return 4 <= len(line) <= 120 and any(p.match(line) for p in _HEADS)


def cut_chunks(text: str, most: int = MOST_CHARS, least: int = LEAST_CHARS) -> list[tuple[int, int, str | None]]:
    """(start, end, heading) of the chunks: cut at headings; in sections over ``most`` also at the next blank line; what is under ``least`` goes to the one behind it."""
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, min(at + len(line) + 1, len(text)), line))
        at += len(line) + 1
    heads = [_is_heading(line) for _, _, line in lines]
    starts = sorted({0, *(k for k, h in enumerate(heads) if h)})
    pieces = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        heading = lines[a][2].strip() if heads[a] else None
        begin = a
        if lines[b - 1][1] - lines[a][0] > most:
            for k in range(a, b):
                if lines[k][1] - lines[begin][0] >= most and not lines[k][2].strip():
                    pieces.append((lines[begin][0], lines[k][1], heading))
                    begin = k + 1
        if begin < b:
            pieces.append((lines[begin][0], lines[b - 1][1], heading))
    pieces = [p for p in pieces if text[p[0] : p[1]].strip()]
    out, held = [], None
    for k, (start, end, heading) in enumerate(pieces):
        if held is not None:
            start, heading = held[0], held[1] or heading
        held = (start, heading) if len(text[start:end].strip()) < least and k + 1 < len(pieces) else None
        if held is None:
            out.append((start, end, heading))
    return out


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each document in order, with their offsets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            rows = [(i, k, *c) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, c in enumerate(cut_chunks(t))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "ordinal", "char_start", "char_end", "heading"])

    return docs.mapInArrow(run, "doc_id bigint, ordinal int, char_start bigint, char_end bigint, heading string")


_HEAD_SQL = "length(trim(c, E' \\t\\r')) BETWEEN 4 AND 120 AND (" + " OR ".join("regexp_matches(trim(c, E' \\t\\r'), '{}')".format(p.replace("'", "''")) for p in T.HEADINGS) + ")"
CHUNKS_SQL = f"""
    WITH RECURSIVE raw AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    lined AS (SELECT doc_id, unnest(ls) AS c, generate_subscripts(ls, 1) AS k, length(t) AS whole FROM raw),
    placed AS (SELECT doc_id, c, k, coalesce(sum(length(c) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, whole, {_HEAD_SQL} AS h FROM lined),
    ended AS (SELECT *, least(a + length(c) + 1, whole) AS b, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS sec FROM placed),
    sized AS (SELECT *, max(b) OVER w - min(a) OVER w AS n, first_value(CASE WHEN h THEN trim(c, E' \\t\\r') END) OVER (PARTITION BY doc_id, sec ORDER BY k) AS head, row_number() OVER (PARTITION BY doc_id, sec ORDER BY k) AS i FROM ended WINDOW w AS (PARTITION BY doc_id, sec)),
    walk AS (SELECT doc_id, sec, i, a AS since, b, (n > {MOST_CHARS} AND b - a >= {MOST_CHARS} AND trim(c, E' \\t\\r') = '') AS cut FROM sized WHERE i = 1
             UNION ALL SELECT s.doc_id, s.sec, s.i, CASE WHEN w.cut THEN s.a ELSE w.since END, s.b, (s.n > {MOST_CHARS} AND s.b - CASE WHEN w.cut THEN s.a ELSE w.since END >= {MOST_CHARS} AND trim(s.c, E' \\t\\r') = '')
             FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.sec = w.sec AND s.i = w.i + 1),
    piece AS (SELECT w.doc_id, w.since AS a, max(w.b) AS b, any_value(s.head) AS head FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.sec = w.sec AND s.i = w.i GROUP BY w.doc_id, w.since),
    live AS (SELECT p.*, r.t, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.a) AS i, count(*) OVER (PARTITION BY p.doc_id) AS n FROM piece p JOIN raw r ON r.doc_id = p.doc_id WHERE trim(substring(r.t, CAST(p.a + 1 AS INT), CAST(p.b - p.a AS INT)), E' \\n\\t\\r') <> ''),
    fold AS (SELECT doc_id, i, n, a AS start, b, head, (length(trim(substring(t, CAST(a + 1 AS INT), CAST(b - a AS INT)), E' \\n\\t\\r')) < {LEAST_CHARS} AND i < n) AS open FROM live WHERE i = 1
             UNION ALL SELECT l.doc_id, l.i, l.n, CASE WHEN f.open THEN f.start ELSE l.a END, l.b, CASE WHEN f.open THEN coalesce(f.head, l.head) ELSE l.head END,
                    (length(trim(substring(l.t, CAST(CASE WHEN f.open THEN f.start ELSE l.a END + 1 AS INT), CAST(l.b - CASE WHEN f.open THEN f.start ELSE l.a END AS INT)), E' \\n\\t\\r')) < {LEAST_CHARS} AND l.i < l.n)
             FROM fold f JOIN live l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS ordinal, CAST(start AS BIGINT) AS char_start, CAST(b AS BIGINT) AS char_end, head AS heading FROM fold WHERE NOT open"""

# fixed values: elements that carry no text of the page
DROPPED = ("script", "style", "noscript", "svg", "nav", "footer")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Lines of a page with a line end at every element boundary; scripts, styles, menus and footers go with their content."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for name in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "\n")
    out = F.regexp_replace(out, r"(?is)<head\b[^>]*>.*?</head\s*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n")


def html_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = html_text(F.coalesce("html", F.lit("")))
    return pages.select("page_id", F.sha2(text, 256).alias("text_sha256"), F.length(text).cast("bigint").alias("n_chars"))


def _html_sql() -> str:
    x = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g')"
    for name in (*DROPPED, "head"):
        x = rf"regexp_replace({x}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', chr(10), 'g')"
    for entity, plain in ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, entity, plain.replace("'", "''"))
    return f"""
    WITH told AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'), ' ')), lambda l: l <> ''), chr(10)) AS t FROM pages)
    SELECT page_id, sha256(t) AS text_sha256, length(t) AS n_chars FROM told"""


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reader each stored object goes to: by media type, else by its first bytes; the rest have none."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    media = F.element_at(F.array(*map(F.lit, ("text/html; charset=utf-8", "", "APPLICATION/PDF", "image/png", "text/plain"))), (F.col("page_id") % 5 + 1).cast("int"))
    data = F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("%PDF-1.7"), "html")).when(F.col("page_id") % 7 == 5, F.lit("plain words")).otherwise(F.col("html"))
    kind = F.lower(F.trim(F.split(media, ";")[0]))
    reader = F.when((kind == "application/pdf") | data.startswith("%PDF-"), "pdf").when(kind.isin("text/html", "application/xhtml+xml") | F.ltrim(F.substring(data, 1, 200)).startswith("<"), "html").when(kind.startswith("text/"), "text").otherwise("none")
    return pages.select(kind.alias("media_type"), reader.alias("reader")).groupBy("media_type", "reader").agg(F.count(F.lit(1)).alias("n"))


FORMATS_SQL = """
    WITH o AS (SELECT ['text/html; charset=utf-8', '', 'APPLICATION/PDF', 'image/png', 'text/plain'][CAST(page_id % 5 + 1 AS INT)] AS m, CASE page_id % 7 WHEN 3 THEN '%PDF-1.7' || html WHEN 5 THEN 'plain words' ELSE html END AS b FROM pages),
    k AS (SELECT lower(trim(split_part(m, ';', 1))) AS media_type, b FROM o)
    SELECT media_type, CASE WHEN media_type = 'application/pdf' OR left(b, 5) = '%PDF-' THEN 'pdf' WHEN media_type IN ('text/html', 'application/xhtml+xml') OR regexp_matches(left(b, 200), '^\\s*<') THEN 'html' WHEN media_type LIKE 'text/%' THEN 'text' ELSE 'none' END AS reader, count(*) AS n
    FROM k GROUP BY 1, 2"""


def parse_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheap reading of each page, and where it is hard to read dearer ones; the first of the best serves."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cheap = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "aeioutnsr", "~^{}|~^{}")).otherwise(F.col("text"))
    better = F.when(F.col("doc_id") % 9 == 0, F.translate("text", "aeioutnsr", "~^{}|~^{}")).otherwise(F.translate("text", "ae", "~~"))
    one, two, three = T.legibility(cheap), T.legibility(better), T.legibility(F.col("text"))
    tried = d.select("doc_id", one.alias("one"), F.when(one < LEGIBLE, two).alias("two"), F.when((one < LEGIBLE) & (two < LEGIBLE), three).alias("three"))
    best = F.greatest("one", "two", "three")
    method = F.when(F.col("one") == best, "text layer").when(F.col("two") == best, "layout").otherwise("recognition")
    return tried.select("doc_id", method.alias("method"), best.alias("legibility"), (method != "text layer").alias("escalated"))


def _legible_sql(column: str) -> str:
    """The oracle's legibility as a table of (doc_id, legibility) of a column of ``tried``."""
    return LEGIBILITY_SQL.replace("SELECT doc_id, text, regexp_replace(text,", f"SELECT doc_id, {column} AS text, regexp_replace({column},").replace("FROM documents", "FROM tried")


PARSE_SQL = f"""
    WITH tried AS (SELECT doc_id, coalesce(text, '') AS c3, CASE WHEN doc_id % 3 = 0 THEN translate(coalesce(text, ''), 'aeioutnsr', '~^{{}}|~^{{}}') ELSE coalesce(text, '') END AS c1,
                   CASE WHEN doc_id % 9 = 0 THEN translate(coalesce(text, ''), 'aeioutnsr', '~^{{}}|~^{{}}') ELSE translate(coalesce(text, ''), 'ae', '~~') END AS c2 FROM documents),
    l1 AS ({_legible_sql('c1')}), l2 AS ({_legible_sql('c2')}), l3 AS ({_legible_sql('c3')}),
    every AS (SELECT l1.doc_id, l1.legibility AS a, CASE WHEN l1.legibility < {LEGIBLE} THEN l2.legibility END AS b, CASE WHEN l1.legibility < {LEGIBLE} AND l2.legibility < {LEGIBLE} THEN l3.legibility END AS c FROM l1 JOIN l2 ON l2.doc_id = l1.doc_id JOIN l3 ON l3.doc_id = l1.doc_id)
    SELECT doc_id, CASE WHEN a >= coalesce(b, 0) AND a >= coalesce(c, 0) THEN 'text layer' WHEN b >= coalesce(c, 0) THEN 'layout' ELSE 'recognition' END AS method, greatest(a, b, c) AS legibility, NOT (a >= coalesce(b, 0) AND a >= coalesce(c, 0)) AS escalated FROM every"""


def quote_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a quote of whole words stands in the text as stored: found in the text with white space collapsed, told in the offsets of the original."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = d.select("doc_id", F.posexplode(F.split("text", r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")).alias("k", "part"))
    order = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("at", F.coalesce(F.sum(F.length("part")).over(order), F.lit(0))).where(F.col("part").rlike(r"\S"))
    ranked = placed.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")))
    quote = ranked.where(F.col("i").between(4, 9)).groupBy("doc_id").agg(F.min("at").alias("char_start"), F.max(F.col("at") + F.length("part")).alias("char_end"), F.count(F.lit(1)).alias("words"))
    got = quote.join(d, "doc_id")
    return got.select("doc_id", F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"), "words", F.sha2(F.regexp_replace(F.substring(F.col("text"), F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int")), r"\s+", " "), 256).alias("quote_sha256"))


PLACES_SQL = """
    WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '\\S+') AS ws, regexp_extract_all(coalesce(text, ''), '\\s+') AS gaps, regexp_matches(coalesce(text, ''), '^\\s') AS led FROM documents),
    q AS (SELECT doc_id, t, list_slice(ws, 4, 9) AS six, len(array_to_string(list_slice(ws, 1, 3), '')) AS before, ws, gaps, led FROM w WHERE len(ws) >= 4),
    p AS (SELECT doc_id, six, before + coalesce(length(array_to_string(list_slice(gaps, 1, 3 + CASE WHEN led THEN 1 ELSE 0 END), '')), 0) AS a,
                 length(array_to_string(six, '')) + length(array_to_string(list_slice(gaps, 4 + CASE WHEN led THEN 1 ELSE 0 END, 2 + len(six) + CASE WHEN led THEN 1 ELSE 0 END), '')) AS n FROM q)
    SELECT doc_id, a AS char_start, a + n AS char_end, len(six) AS words, sha256(array_to_string(six, ' ')) AS quote_sha256 FROM p"""


def quote_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that hold a phrase, case apart: the first eight of a document, each once, at most 500 characters long, with page and offset.

    A line end is the end of a block, so no sentence runs over one.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = F.regexp_replace("text", r"([.!?]) ", "$1\u0001\u0002")
    parts = d.select("doc_id", F.posexplode(F.split(F.regexp_replace(marked, "\n", "\n\u0001"), "\u0001")).alias("k", "part"))
    # the mark \\u0002 stands for the blank behind a full stop, so lengths add up to the text's
    order = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("at", F.coalesce(F.sum(F.length("part")).over(order), F.lit(0)))
    lead = F.when(F.col("part").startswith("\u0002"), 1).otherwise(0)
    said = F.regexp_replace(F.regexp_replace("part", "^\u0002", ""), "\n$", "")
    hit = placed.select("doc_id", "k", (F.col("at") + lead).alias("char_start"), said.alias("quote")).where(F.lower("quote").contains(" the ") & (F.length("quote") <= 500))
    ranked = hit.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))).where("place <= 8")
    return ranked.select("doc_id", F.col("place").cast("int").alias("place"), F.col("char_start").cast("bigint").alias("char_start"), F.floor(F.col("char_start") / 3000).cast("bigint").alias("page"), F.sha2("quote", 256).alias("quote_sha256"))


CANDIDATES_SQL = """
    WITH blocks AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS bs FROM documents), b AS (SELECT doc_id, unnest(bs) AS block, generate_subscripts(bs, 1) AS bk FROM blocks),
    bo AS (SELECT *, coalesce(sum(length(block) + 1) OVER (PARTITION BY doc_id ORDER BY bk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ba FROM b),
    s AS (SELECT doc_id, bk, ba, string_split(regexp_replace(block, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM bo), e AS (SELECT doc_id, bk, ba, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS sk FROM s),
    o AS (SELECT *, ba + coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id, bk ORDER BY sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM e),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bk, sk) AS place FROM o WHERE contains(lower(sentence), ' the ') AND length(sentence) <= 500)
    SELECT doc_id, CAST(place AS INT) AS place, CAST(a AS BIGINT) AS char_start, CAST(a AS BIGINT) // 3000 AS page, sha256(sentence) AS quote_sha256 FROM h WHERE place <= 8"""


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reading model is shown of a conversation: its turns as marked pages, cut at 180,000 characters, with its size in tokens and a key that changes with text, prompt or schema."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn = F.struct("turn", F.concat(F.lit("[page "), F.col("turn").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("t"))
    body = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x.t), "\n").alias("body"))
    cut = F.when(F.length("body") > 180_000, F.concat(F.substring("body", 1, 180_000), F.lit("\n[truncated]"))).otherwise(F.col("body"))
    return body.select("conv_id", F.length(cut).cast("bigint").alias("n_chars"), F.greatest(F.lit(1), F.floor(F.length(cut) / 4)).cast("bigint").alias("tokens"), F.sha2(F.concat_ws("\x1f", F.lit("decision"), F.lit("v3"), cut), 256).alias("cache_key"))


RENDERED_SQL = """
    WITH b AS (SELECT conv_id, string_agg('[page ' || turn || ']' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn, '[page ' || turn || ']' || chr(10) || coalesce(text, '')) AS body FROM conversations GROUP BY conv_id),
    c AS (SELECT conv_id, CASE WHEN length(body) > 180000 THEN left(body, 180000) || chr(10) || '[truncated]' ELSE body END AS t FROM b)
    SELECT conv_id, length(t) AS n_chars, greatest(1, length(t) // 4) AS tokens, sha256('decision' || chr(31) || 'v3' || chr(31) || t) AS cache_key FROM c"""


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored conversations as parsed documents: a delete-and-replace of the later half, then pages in order with their offsets."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    again = c.where("conv_id % 2 = 0 AND turn % 2 = 0").withColumn("text", F.concat("text", F.lit(" (revised)")))
    kept = c.join(again.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(again)
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    told = kept.withColumn("page", F.row_number().over(w)).withColumn("char_start", F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return told.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pages"), F.max(F.col("char_start") + F.length("text") + 1).cast("bigint").alias("chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "char_start"))), lambda x: x.char_start.cast("string")), ",").alias("offsets"))


PARSED_SQL = """
    WITH again AS (SELECT conv_id, turn, coalesce(text, '') || ' (revised)' AS t FROM conversations WHERE conv_id % 2 = 0 AND turn % 2 = 0),
    kept AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM again) UNION ALL SELECT * FROM again),
    o AS (SELECT conv_id, turn, t, coalesce(sum(length(t) + 1) OVER (PARTITION BY conv_id ORDER BY turn, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn, t) AS k FROM kept)
    SELECT conv_id, count(*) AS pages, CAST(max(a + length(t) + 1) AS BIGINT) AS chars, string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS offsets FROM o GROUP BY conv_id"""


def reverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored citations held against the documents as they are now: a quote that only a later version of the document holds is repointed to it, one in neither is unverified."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cited = d.where("length(text) >= 60").select("doc_id", F.substring("text", 21, 40).alias("quote"))
    now = d.withColumn("now", F.when(F.col("doc_id") % 4 == 1, F.substring("text", 1, 30)).when(F.col("doc_id") % 4 == 2, F.lit("")).otherwise(F.col("text")))
    later = d.where("doc_id % 4 = 1").select(F.col("doc_id"), (F.col("doc_id") + 1_000_000).alias("later_id"), F.col("text").alias("later"))
    rows = cited.join(now.select("doc_id", "now"), "doc_id").join(later, "doc_id", "left")
    held, moved = F.contains("now", "quote"), F.coalesce(F.contains("later", "quote"), F.lit(False))
    return rows.select("doc_id", F.when(held, F.col("doc_id")).when(moved, F.col("later_id")).alias("points_to"), (held | moved).alias("verified"))


REVERIFIED_SQL = """
    SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 3) THEN doc_id WHEN doc_id % 4 = 1 THEN CASE WHEN strpos(left(text, 30), substring(text, 21, 40)) > 0 THEN doc_id ELSE doc_id + 1000000 END WHEN substring(text, 21, 40) = '' THEN doc_id END AS points_to,
           doc_id % 4 <> 2 OR substring(text, 21, 40) = '' AS verified FROM documents WHERE length(text) >= 60"""


def similar(names: DataFrame, least: float, name: str = "name") -> DataFrame:
    """Pairs (a, b, similarity) of distinct names with trigram similarity of at least ``least``, a < b.

    Two such names share one of the rarest trigrams of each, as many as may differ and one more, so
    only those are joined: a frequent trigram never lists the names that have it.
    """
    grams = names.select(F.col(name).alias("name")).distinct().withColumn("g", T.trigrams(F.col("name")))
    each = grams.select("name", F.explode("g").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(often, "gram").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x.gram).alias("g"))
    size = F.size("g")
    rare = ordered.withColumn("gram", F.explode(F.slice("g", 1, (size - F.ceil(size * least) + 1).cast("int"))))
    one, two = (rare.select(F.col("name").alias(n), F.col("g").alias(f"g{n}"), "gram") for n in "ab")
    met = one.join(two, "gram").where("a < b").select("a", "b", "ga", "gb").distinct()
    s = F.size(F.array_intersect("ga", "gb")) / F.size(F.array_union("ga", "gb"))
    return met.select("a", "b", s.alias("similarity")).where(F.col("similarity") >= least)


def roots(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) of a table (node, parent) without cycles, where a root is its own parent: pointers are doubled."""
    spark = parents.sparkSession
    now = parents
    for _ in range(most_rounds):
        path = fresh(spark, "roots")
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        now.join(up, "parent").select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")).write.parquet(path)
        seen = spark.read.parquet(path)
        now = seen.select("node", "parent")
        if seen.where("moved").isEmpty():
            break
    return now.withColumnRenamed("parent", "root")


MERGE, ADJUDICATE = 0.92, 0.62


def _raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    tail = F.element_at(F.array(*map(F.lit, ("", " LLC", " Inc.", " Holdings"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select(F.concat("p_name", F.lit(" company of the county"), F.when(F.col("p_partkey") % 11 == 0, " s").otherwise(""), tail).alias("raw")).distinct()


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants in order of their names: one of a known core joins its cluster, else the most similar earlier core at 0.92; from 0.62 on a new cluster is queued for a person, else it is new.

    A cluster is named after the first name in it. Each core points to at most one earlier core, so
    the order needs no loop over names: the pointers are followed at once.
    """
    named = _raw_names(spark, sf_dir).withColumn("core", T.organisation(F.col("raw"))).where("core <> ''")
    cores = named.groupBy("core").agg(F.min("raw").alias("first_raw"))
    pairs = similar(cores, ADJUDICATE, "core")
    both = pairs.select(F.col("a").alias("core"), F.col("b").alias("other"), "similarity").unionByName(pairs.select(F.col("b").alias("core"), F.col("a").alias("other"), "similarity"))
    timed = both.join(cores, "core").join(cores.select(F.col("core").alias("other"), F.col("first_raw").alias("other_raw")), "other").where("other_raw < first_raw")
    best = timed.groupBy("core").agg(F.max_by(F.struct("other", "similarity"), F.struct("similarity", F.col("other"))).alias("b"))
    judged = cores.join(best, "core", "left").select("core", "first_raw", F.col("b.other").alias("nearest"), F.col("b.similarity").alias("score"))
    parents = judged.select(F.col("core").alias("node"), F.when(F.col("score") >= MERGE, F.col("nearest")).otherwise(F.col("core")).alias("parent"))
    top = roots(parents).join(cores.select(F.col("core").alias("root"), F.col("first_raw").alias("cluster")), "root").select(F.col("node").alias("core"), "cluster")
    sizes = named.groupBy("core").agg(F.count(F.lit(1)).alias("aliases"))
    return judged.join(top, "core").join(sizes, "core").select("core", "cluster", "aliases", F.when(F.col("score") >= MERGE, "merged").when(F.col("score").isNotNull(), "queued").otherwise("new").alias("decision"), F.round("score", 6).alias("score"))


_PLAIN = "|".join(s for s in T.SUFFIXES if "." not in s)
RESOLVED_SQL = f"""
    WITH RECURSIVE raw AS (SELECT DISTINCT p_name || ' company of the county' || CASE WHEN p_partkey % 11 = 0 THEN ' s' ELSE '' END || ['', ' LLC', ' Inc.', ' Holdings'][CAST(p_partkey % 4 + 1 AS INT)] AS raw FROM part),
    named AS (SELECT raw, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(raw), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '(?:(?:^|\\s)(?:{_PLAIN}))+$', '')) AS core FROM raw),
    cores AS (SELECT core, min(raw) AS first_raw, count(*) AS aliases, list_distinct(flatten(list_transform(string_split(core, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g FROM named WHERE core <> '' GROUP BY core),
    pair AS (SELECT a.core, b.core AS other, len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE) AS s FROM cores a JOIN cores b ON b.first_raw < a.first_raw),
    best AS (SELECT *, row_number() OVER (PARTITION BY core ORDER BY s DESC, other DESC) AS rn FROM pair WHERE s >= {ADJUDICATE}),
    up AS (SELECT c.core, c.first_raw, c.aliases, b.other, b.s FROM cores c LEFT JOIN best b ON b.core = c.core AND b.rn = 1),
    walk AS (SELECT core, core AS at FROM up UNION ALL SELECT w.core, u.other FROM walk w JOIN up u ON u.core = w.at WHERE u.s >= {MERGE}),
    top AS (SELECT w.core, u.first_raw AS cluster FROM walk w JOIN up u ON u.core = w.at WHERE u.s IS NULL OR u.s < {MERGE})
    SELECT u.core, t.cluster, u.aliases, CASE WHEN u.s >= {MERGE} THEN 'merged' WHEN u.s IS NOT NULL THEN 'queued' ELSE 'new' END AS decision, round(u.s, 6) AS score FROM up u JOIN top t ON t.core = u.core"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute addresses of the links of each page: absolute ones stay, those of the host's root and of the page's folder are completed, anchors and mail are left out."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract("url", r"^([a-z]+://[^?#]*/)", 1)
    full = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.regexp_extract("url", "^([a-z]+:)", 1), "href")).when(F.col("href").startswith("/"), F.concat(base, "href")).otherwise(F.concat(folder, "href"))
    kept = raw.where("href <> '' AND NOT href LIKE '#%' AND NOT href LIKE 'mailto:%'").select("page_id", full.alias("link"))
    return kept.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.md5(F.array_join(F.array_sort(F.collect_set("link")), "\n")).alias("digest"))


LINKS_SQL = """
    WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages),
    f AS (SELECT page_id, CASE WHEN regexp_matches(h, '^[a-z]+://') THEN h WHEN h LIKE '//%' THEN split_part(url, '/', 1) || h WHEN h LIKE '/%' THEN array_to_string(list_slice(string_split(regexp_replace(url, '[?#].*$', ''), '/'), 1, 3), '/') || h
                 ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || h END AS link FROM l WHERE h <> '' AND NOT starts_with(h, '#') AND NOT starts_with(h, 'mailto:'))
    SELECT page_id, count(*) AS links, md5(array_to_string(list_sort(list(DISTINCT link)), chr(10))) AS digest FROM f GROUP BY page_id"""

QUERIES = {
    "text_chunks": (chunks, CHUNKS_SQL), "html_reader": (html_reader, _html_sql()), "object_formats": (formats, FORMATS_SQL), "parse_cascade": (parse_cascade, PARSE_SQL), "quote_places": (quote_places, PLACES_SQL),
    "quote_candidates": (quote_candidates, CANDIDATES_SQL), "model_rendering": (rendered, RENDERED_SQL), "parsed_documents": (parsed, PARSED_SQL), "citations_reverified": (reverified, REVERIFIED_SQL),
    "applicants_resolved": (resolved, RESOLVED_SQL), "page_links": (links, LINKS_SQL),
}
