"""Queries of the text pipeline, entity resolution and geometry."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permrisk.functions import text as T
from permrisk.plans.dialect import Oracle, Spark
from permrisk.plans.graph import frame, query, statement
from permrisk.sources.scratch import fresh

PHRASES = {
    "relief": ("Rezoning and special use permit", "variance request", "Site plan review", "CUP and comprehensive plan amendment", "annexation, text amendment", "tax increment financing", "nothing here", "subdivision plat with a development agreement"),
    "use": ("AI campus phase 2", "Edge data center", "solar farm", "Wind turbine array", "BESS storage", "logistics hub", "multi-family homes", "server farm", "church", "light manufacturing", "colo hall"),
    "outcome": ("Denied 3-2", "approved with conditions", "motion passed", "withdrawn by applicant", "deferred to May", "tabled", "no action"),
    "vote": ("4-1", "4-1-0", "5 to 2", "3:2", "unanimous", "", " 7 - 0 "),
    "title": ("Planning Agenda", "MINUTES of March", "Staff Memo 12", "Zoning Ordinance", "Public Notice", "map"),
    "day": ("2021-03-04", "03/05/2021", "2021-03-04T10:11:12", "someday", "7/4/2020"),
    "org": ("Ridgeline Holdings, L.L.C.", "Ridgeline Holdings LLC", "Acme Solar 3 LLC", "St. Louis Partners", "Delta Development Group Inc", "Pageland 3 LLC", "North & South Realty Co."),
    "body": ("BOS", "the Board", "County PC", "Zoning Board of Appeals", "commission", "BZA."),
    "person": ("Supervisor J. Smith", "Jane Q. Doe", "Hon. Ann Lee", "Mr. X.", "Chair", "Vice Mayor Bob Stone"),
}


def _filing(d) -> str:
    cases = ", ".join("CASE id % {} {} END AS {}".format(len(v), " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(v)), k) for k, v in PHRASES.items())
    return f"SELECT o_orderkey AS filing_id, {cases} FROM (SELECT o_orderkey, {d.idiv('o_orderkey', 3)} AS id FROM orders) o"


def _filings(spark, sf_dir):
    return query(_filing)[0](spark, sf_dir)


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _filings(spark, sf_dir)
    v = T.vote(F.col("vote"))
    return f.select(
        "filing_id", F.array_join(T.relief(F.col("relief")), "+").alias("relief"), T.use_class(F.col("use")).alias("use_class"), T.outcome(F.col("outcome")).alias("outcome"),
        v["for"].alias("votes_for"), v["against"].alias("votes_against"), v["abstain"].alias("votes_abstain"), T.document_kind(F.col("title")).alias("kind"), T.civic_date(F.col("day")).alias("held_on"),
    )


def _sql_first(column, rules, other="NULL"):
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{k}'" for k, p in rules) + f" ELSE {other} END"


def _vote_sql(i):
    return f"nullif(regexp_extract(vote, '^\\s*(\\d+)\\s*(?:-|to|:)\\s*(\\d+)(?:\\s*(?:-|to|:)\\s*(\\d+))?\\s*$', {i}), '')"


NORMALISED_SQL = statement(f"""
    WITH filing AS ({_filing(Oracle)})
    SELECT filing_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(relief, '{p}') THEN '{k}' END" for k, p in T.RELIEF)}], lambda x: x IS NOT NULL), '+') AS relief,
           {_sql_first('"use"', T.USE_CLASS)} AS use_class, {_sql_first('outcome', T.OUTCOME)} AS outcome,
           CAST({_vote_sql(1)} AS INT) AS votes_for, CAST({_vote_sql(2)} AS INT) AS votes_against, CASE WHEN {_vote_sql(1)} IS NOT NULL THEN coalesce(CAST({_vote_sql(3)} AS INT), 0) END AS votes_abstain,
           {"CASE " + " ".join(f"WHEN contains(lower(title), '{n}') THEN '{k}'" for n, k in T.KINDS) + " ELSE 'other' END"} AS kind,
           CAST(coalesce(try_strptime(day, '%Y-%m-%dT%H:%M:%S'), try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%m/%d/%Y')) AS DATE) AS held_on FROM filing""", Oracle)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _filings(spark, sf_dir)
    p = T.person(F.col("person"))
    return f.select("filing_id", T.organisation(F.col("org")).alias("organisation"), T.body(F.col("body")).alias("body"), p.surname.alias("surname"), p.full.alias("full_name"), T.single_purpose(F.col("org")).alias("single_purpose"))


_PLAIN = "|".join(s for s in T.SUFFIXES if "." not in s)
_CORE = f"trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(org), 'l\\.l\\.c\\.', 'llc'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '(?:(?:^|\\s)(?:{_PLAIN}))+$', ''))"
_BODY = "array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(lower(body), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''), lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.BODIES.items()) + " ELSE x END), ' ')"
_PERSON = "list_filter(list_transform(string_split_regex(regexp_replace(lower(person), '[^\\w\\s.]', ' ', 'g'), '\\s+'), lambda x: trim(x, '.')), lambda x: x <> '' AND x NOT IN ({}))".format(", ".join(f"'{h}'" for h in T.HONORIFICS))
NAMES_SQL = statement(f"""
    WITH filing AS ({_filing(Oracle)}), told AS (SELECT filing_id, org, {_CORE} AS organisation, {_BODY} AS body, {_PERSON} AS words FROM filing)
    SELECT filing_id, organisation, CASE WHEN body IN ('the board', 'board', 'the commission', 'commission') THEN '' ELSE body END AS body,
           coalesce(list_filter(words, lambda x: length(x) > 1)[-1], words[-1], '') AS surname, array_to_string(words, ' ') AS full_name,
           regexp_matches(org, '{T.SINGLE_PURPOSE}') OR (len(string_split(organisation, ' ')) <= 2 AND regexp_matches(organisation, '\\d')) AS single_purpose FROM told""", Oracle)


def legibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", T.legibility(F.col("text")).alias("legibility"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("bigint").alias("token_estimate"))


_LEGIBLE = ", ".join(f"'{w}'" for w in T.EXPECTED)
LEGIBILITY_SQL = f"""
    WITH page AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '[A-Za-z][A-Za-z''\\-]+') AS words FROM page)
    SELECT doc_id, CASE WHEN length(t) <= 24 THEN 1.0 WHEN len(words) = 0 THEN 0.0 ELSE
        round(0.4::DOUBLE * length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\s.,;:''\"()\\-/$%&#*\\[\\]]', '', 'g')) / length(t) + 0.35::DOUBLE * len(list_filter(words, lambda x: length(x) BETWEEN 2 AND 20)) / len(words)
              + 0.25::DOUBLE * least(len(list_intersect(list_distinct(list_transform(words, lambda x: lower(x))), [{_LEGIBLE}])) / 6.0::DOUBLE, 1.0), 3) END AS legibility,
           greatest(1, length(text) // 4) AS token_estimate FROM w"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut into sections at headings, with running offsets; a line end counts in the offsets."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    order = Window.partitionBy("doc_id").orderBy("line")
    opened = F.when(F.length(F.trim("content")).between(4, 40) & F.col("content").rlike("^[A-Z][a-z]+\\.$"), 1).otherwise(0)
    cut = lines.select("doc_id", "content", F.sum(opened).over(order).alias("section"), F.coalesce(F.sum(F.length("content") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return cut.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("lines"), F.min("start").alias("char_start"), F.max(F.col("start") + F.length("content")).alias("char_end"))


SEGMENTS_SQL = """
    WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), lined AS (SELECT doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) AS line FROM split),
    cut AS (SELECT doc_id, content, sum(CASE WHEN length(trim(content, ' ')) BETWEEN 4 AND 40 AND regexp_matches(content, '^[A-Z][a-z]+\\.$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS section,
                   coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lined)
    SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS lines, CAST(min(start) AS BIGINT) AS char_start, CAST(max(start + length(content)) AS BIGINT) AS char_end FROM cut GROUP BY doc_id, section"""


def quotes(d):
    """Quotes against the document they cite: verbatim after white space is collapsed, at least twelve characters."""
    squeeze = lambda x: f"trim({d.replace(x, '[ ' + chr(92) + 'n]+', ' ')})"
    return f"""
    WITH cited AS (
        SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN substring(text, 11, 60) WHEN 1 THEN substring(text, 11, 40) || 'x' || substring(text, 52, 20) WHEN 2 THEN substring(text, 1, 9) ELSE substring(text, 31, 30) END AS quote FROM documents),
    plain AS (SELECT doc_id, {squeeze('text')} AS page, {squeeze('quote')} AS quote FROM cited)
    SELECT doc_id, length(quote) >= 12 AND strpos(page, quote) > 0 AS verified, CASE WHEN length(quote) < 12 THEN 'too short' WHEN strpos(page, quote) = 0 THEN 'not in the document' END AS reason FROM plain""".replace(
        "strpos(page, quote)", "instr(page, quote)" if d is Spark else "strpos(page, quote)")


def elided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with gaps: the parts in order, each behind the one before, at most 400 characters apart; no second try."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.concat(F.substring("text", 5, 25), F.lit(" ... "), F.substring("text", 80, 25), F.lit(" ... "), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 700, 25)).otherwise(F.substring("text", 120, 20))).alias("quote"))
    parts = F.filter(F.transform(F.split("quote", r"\.\.\."), lambda p: F.trim(p)), lambda p: p != "")
    state = F.expr("""aggregate(parts, struct(0 AS at, true AS ok), (s, p) -> named_struct('at', CASE WHEN s.ok AND locate(p, text, s.at + 1) > 0 THEN CAST(locate(p, text, s.at + 1) + length(p) - 1 AS INT) ELSE s.at END,
        'ok', s.ok AND locate(p, text, s.at + 1) > 0 AND (s.at = 0 OR locate(p, text, s.at + 1) - 1 - s.at <= 400)), s -> s.ok)""")
    return d.withColumn("parts", parts).select("doc_id", F.size("parts").alias("n_parts"), (state & (F.size("parts") > 0)).alias("verified"))


def _step(n, part):
    """One part of an elided quote in the oracle: where it ends, and whether all is well so far."""
    q = f"instr(substring(text, at{n} + 1), {part})"
    return f"""s{n + 1} AS (SELECT *, CASE WHEN {part} = '' OR NOT ok{n} OR {q} = 0 THEN at{n} ELSE at{n} + {q} + length({part}) - 1 END AS at{n + 1},
           ok{n} AND ({part} = '' OR ({q} > 0 AND (at{n} = 0 OR {q} - 1 <= 400))) AS ok{n + 1} FROM s{n})"""


ELIDED_SQL = f"""
    WITH s0 AS (SELECT doc_id, text, trim(substring(text, 5, 25), ' ') AS f1, trim(substring(text, 80, 25), ' ') AS f2, trim(CASE WHEN doc_id % 3 = 0 THEN substring(text, 700, 25) ELSE substring(text, 120, 20) END, ' ') AS f3, 0 AS at0, true AS ok0 FROM documents),
    {_step(0, 'f1')}, {_step(1, 'f2')}, {_step(2, 'f3')}
    SELECT doc_id, CAST(CASE WHEN f1 <> '' THEN 1 ELSE 0 END + CASE WHEN f2 <> '' THEN 1 ELSE 0 END + CASE WHEN f3 <> '' THEN 1 ELSE 0 END AS INT) AS n_parts, ok3 AND (f1 <> '' OR f2 <> '' OR f3 <> '') AS verified FROM s3"""


def transcript(d):
    """Turns as segments: offsets, times, the item on the table (the last turn of a user before it)."""
    return f"""
    WITH timed AS (
        SELECT conv_id, turn, role, text, coalesce(sum(length(text) + 1) OVER w, 0) AS char_start, coalesce(sum(length(text)) OVER w, 0) * 60 AS start_ms
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, role, CAST(char_start AS BIGINT) AS char_start, CAST(char_start + length(text) AS BIGINT) AS char_end, CAST(start_ms AS BIGINT) AS start_ms,
           max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM timed"""


def windows(d):
    """Padded hits merged where they touch: gaps and islands over the running end."""
    age = "CAST(event_id % 97 AS BIGINT)"
    return f"""
    WITH hit AS (SELECT user_id, event_id, event_id * 10 - 40 AS lo, event_id * 10 + 40 + {age} AS hi FROM events WHERE event_type = 'error'),
    marked AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit),
    island AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM marked)
    SELECT user_id, CAST(g AS BIGINT) AS island, min(lo) AS lo, max(hi) AS hi, count(*) AS hits FROM island GROUP BY user_id, g"""


def platforms(d):
    return f"""
    SELECT page_id, CASE WHEN {d.matches('lower(url)', 'legistar')} THEN 'legistar' WHEN {d.matches('lower(url)', '^https?://blog[.]')} THEN 'blog' WHEN {d.matches('html', '<article')} THEN 'article' ELSE 'unknown' END AS platform,
           CASE WHEN {d.matches('lower(url)', 'legistar|^https?://blog[.]')} THEN 0.9 ELSE 0.5 END AS confidence, length(trim(html)) < 1200 AS shell FROM pages"""


def content_store(d):
    """Content addressing: one object for equal texts, its key spread over two levels of folders."""
    h = d.sha("text")
    return f"""
    WITH hashed AS (SELECT doc_id, {h} AS h FROM documents)
    SELECT h AS content_hash, substring(h, 1, 2) || '/' || substring(h, 3, 2) || '/' || h AS storage_key, min(doc_id) AS first_id, count(*) AS copies FROM hashed GROUP BY h"""


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names with trigram similarity of at least 0.62, found by shared trigrams, not by all pairs."""
    from permrisk.plans.documents import similar

    pairs = similar(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name"), 0.62, "p_name")
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"), F.when(F.col("similarity") >= 0.92, "merge").otherwise("adjudicate").alias("decision"))


_GRAMS = "list_distinct(flatten(list_transform(string_split(lower(p_name), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
SIMILAR_SQL = f"""
    WITH named AS (SELECT DISTINCT p_name, {_GRAMS} AS g FROM part), pair AS (SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE) AS s FROM named a JOIN named b ON a.p_name < b.p_name)
    SELECT a, b, round(s, 6) AS similarity, CASE WHEN s >= 0.92 THEN 'merge' ELSE 'adjudicate' END AS decision FROM pair WHERE s >= 0.62"""


def clusters(d):
    """Applicants of one core name as one cluster, with its names; opaque if any of them is a single-purpose name."""
    return f"""
    WITH applicant AS (SELECT c_custkey, lower(substring(c_name, 1, 8)) || c_custkey % 40 AS core, c_custkey % 13 = 0 AS opaque FROM customer)
    SELECT core, min(c_custkey) AS cluster_id, count(*) AS aliases, bool_or(opaque) AS opaque FROM applicant GROUP BY core"""


def member_terms(d):
    """Votes land on members by folded name: first and last day seen widen the term."""
    return """
    SELECT m.county_id, lower(m.name) AS name, min(a.decided_on) AS first_seen, max(a.decided_on) AS last_seen, least(min(m.term_start), min(a.decided_on)) AS term_start, count(*) AS votes
    FROM vote v JOIN member m ON m.member_id = v.member_id JOIN application a ON a.application_id = v.application_id WHERE a.decided_on IS NOT NULL GROUP BY m.county_id, lower(m.name)"""


def locate(d):
    """Polygons over a point, the smallest first: it decides, the larger ones give clearance. Cells make it an equi-join."""
    return f"""
    WITH site AS (SELECT c_custkey AS site_id, (c_custkey * 37 % 500) / 100.0 AS x, (c_custkey * 91 % 500) / 100.0 AS y FROM customer),
    box AS (SELECT county_id AS box_id, cx, cy, 1.0 AS area FROM county UNION ALL SELECT 100 + cy, cx, cy, 5.0 FROM county),
    inside AS (SELECT s.site_id, b.box_id, b.area FROM site s JOIN box b ON b.cx = CAST(floor(s.x) AS INT) AND b.cy = CAST(floor(s.y) AS INT))
    SELECT site_id, box_id, area, CASE WHEN row_number() OVER (PARTITION BY site_id ORDER BY area, box_id) = 1 THEN 'decider' ELSE 'clearance' END AS role FROM inside"""


def _haversine(ax, ay, bx, by):
    return f"6371008.8 * 2 * asin(least(1.0, sqrt(pow(sin(radians(({by} - {ay}) / 2)), 2) + cos(radians({ay})) * cos(radians({by})) * pow(sin(radians(({bx} - {ax}) / 2)), 2))))"


_SITES = "SELECT c_custkey AS site_id, -78 + (c_custkey * 37 % 997) / 500.0 AS x, 38 + (c_custkey * 91 % 991) / 500.0 AS y FROM customer"
_HOMES = "SELECT s_suppkey AS home_id, -78 + (s_suppkey * 53 % 997) / 500.0 AS x, 38 + (s_suppkey * 17 % 991) / 500.0 AS y FROM supplier"


def nearest_home(sites: DataFrame, homes: DataFrame) -> DataFrame:
    """Distance to the nearest home, and how many are within 8 km, of every site; null and none without a home.

    A grid makes it an equi-join of nine cells, of a tenth of a degree at first. A site is settled if no home
    outside its cells can be nearer; the others go on to cells of twice the size, until these cover everything.
    """
    spark = sites.sparkSession
    ends = sites.select("x", "y").unionByName(homes.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    extent = max([v for v in ends if v is not None], default=0.0)
    top = max(0, math.ceil(math.log2(extent * 10))) + 1 if extent > 0 else 0
    step = F.explode(F.array(*map(F.lit, (-1, 0, 1))))
    done, pending = [], sites.select("site_id", "x", "y")
    for level in range(top + 1):
        cell = lambda c, level=level: F.floor(F.col(c) * 10 / 2**level)
        spread = homes.select(F.col("x").alias("hx"), F.col("y").alias("hy"), cell("x").alias("cx"), cell("y").alias("cy")).withColumn("dx", step).withColumn("dy", step)
        spread = spread.select("hx", "hy", (F.col("cx") + F.col("dx")).alias("gx"), (F.col("cy") + F.col("dy")).alias("gy"))
        met = pending.select("site_id", "x", "y", cell("x").alias("gx"), cell("y").alias("gy")).join(spread, ["gx", "gy"]).select("site_id", F.expr(_haversine("x", "y", "hx", "hy")).alias("m"))
        met = met.groupBy("site_id").agg(F.min("m").alias("m"), F.count_if(F.col("m") <= 8000).alias("n"))
        # the way to a meridian so far off, which is the shortest to anything outside the cells
        sure = F.lit(6371008.8 * (1 - 1e-9)) * F.asin(F.cos(F.radians("y")) * math.sin(math.radians(min(90.0, 0.1 * 2**level))))
        settled = F.coalesce((F.col("m") <= sure) & (sure >= 8000), F.lit(False)) if level < top else F.lit(True)
        path = fresh(spark, "nearest")
        pending.join(met, "site_id", "left").withColumn("settled", settled).write.parquet(path)
        seen = spark.read.parquet(path)
        done.append(seen.where("settled").select("site_id", "m", F.coalesce("n", F.lit(0)).cast("bigint").alias("within_8km")))
        pending = seen.where("NOT settled").select("site_id", "x", "y")
        if level < top and pending.isEmpty():
            break
    every = functools.reduce(DataFrame.unionByName, done)
    return every.select("site_id", F.round("m", 2).alias("distance_m"), F.round(F.col("m") * 3.28084, 1).alias("distance_ft"), "within_8km")


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_home(*(query(lambda d, sql=sql: sql)[0](spark, sf_dir) for sql in (_SITES, _HOMES)))


NEAREST_SQL = statement(f"""
    WITH site AS ({_SITES}), home AS ({_HOMES}), met AS (SELECT s.site_id, {_haversine('s.x', 's.y', 'h.x', 'h.y')} AS m FROM site s LEFT JOIN home h ON true)
    SELECT site_id, round(min(m), 2) AS distance_m, round(min(m) * 3.28084, 1) AS distance_ft, count(*) FILTER (WHERE m <= 8000) AS within_8km FROM met GROUP BY site_id""", Oracle)


def tiles(d):
    """Web-mercator tile of each site and the envelope of that tile."""
    z = 9
    return f"""
    WITH site AS (SELECT c_custkey AS site_id, -78 + (c_custkey * 37 % 997) / 500.0 AS x, 38 + (c_custkey * 91 % 991) / 500.0 AS y FROM customer),
    placed AS (SELECT site_id, CAST(floor((x + 180) / 360 * {2 ** z}) AS INT) AS tx, CAST(floor((1 - ln(tan(radians(y)) + 1 / cos(radians(y))) / pi()) / 2 * {2 ** z}) AS INT) AS ty FROM site)
    SELECT tx, ty, count(*) AS sites, round(-20037508.342789244 + tx * {40075016.685578488 / 2 ** z!r}, 3) AS xmin, round(20037508.342789244 - (ty + 1) * {40075016.685578488 / 2 ** z!r}, 3) AS ymin FROM placed GROUP BY tx, ty"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """General elections of each county from its rule (term and stagger), and the filing deadline 120 days before."""
    c = frame(spark, sf_dir, "county")
    years = c.select("county_id", F.explode(F.sequence(F.lit(1996), F.lit(2008), F.lit(2))).alias("year")).where((F.col("year") - 1996) % F.when(F.col("county_id") % 2 == 0, 4).otherwise(2) == 0)
    day = T.general_election(F.col("year"))
    return years.select("county_id", "year", day.alias("held_on"), F.date_sub(day, 120).alias("filing_deadline"))


CALENDAR_SQL = statement("""
    WITH y AS (SELECT county_id, CAST(unnest(range(1996, 2009, 2)) AS INT) AS year FROM county), n AS (SELECT *, make_date(year, 11, 1) AS d FROM y WHERE (year - 1996) % CASE WHEN county_id % 2 = 0 THEN 4 ELSE 2 END = 0),
    h AS (SELECT county_id, year, CAST(d + CAST((8 - isodow(d)) % 7 + 1 AS INT) AS DATE) AS held_on FROM n)
    SELECT county_id, year, held_on, CAST(held_on - 120 AS DATE) AS filing_deadline FROM h""", Oracle)

QUERIES = {
    "text_normalised": (normalised, NORMALISED_SQL), "text_names": (names, NAMES_SQL), "text_legibility": (legibility, LEGIBILITY_SQL), "text_segments": (segments, SEGMENTS_SQL), "text_elided_quotes": (elided, ELIDED_SQL),
    "similar_names": (similar_names, SIMILAR_SQL), "election_calendar": (calendar, CALENDAR_SQL),
} | {f"text_{f.__name__}": query(f) for f in (quotes, transcript, windows, platforms, content_store)} | {f.__name__: query(f) for f in (clusters, member_terms)} | {f"geo_{f.__name__}": query(f) for f in (locate, tiles)} | {"geo_nearest": (nearest, NEAREST_SQL)}
