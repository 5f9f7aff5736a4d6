"""Adapters of civic platforms: where to look, which meetings and which documents an answer holds, and the recording of a meeting.

An adapter is three functions over tables, looked up by the platform's name;
a platform that is not known has none, so it reads as never fetched. Meetings are

    platform, source, external_id, body, held_on, title, cancelled, media, documents array<struct<kind, title, url>>

and documents platform, source, kind, title, url, published_on. Answers that are
null or unreadable, and meetings without a readable day, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permrisk.functions import text as T
from permrisk.sources.civic import EVENT, _media

LINK = "struct<kind:string,title:string,url:string>"
MEETING = ("platform", "source", "external_id", "body", "held_on", "title", "cancelled", "media", "documents")
UNKNOWN = "unknown body"
RECORD = "struct<id:string,date:string,startsAt:string,bodyName:string,committee:string,title:string,canceled:boolean,videoUrl:string,agendaUrl:string,minutesUrl:string,packetUrl:string>"
FILE = "struct<fileName:string,url:string,uploadedDate:string,type:struct<text:string>>"
# fixed values: what the name of a link to a recording holds, and the rows of an agenda list
RECORDINGS = ("video", "media", "watch", "recording")
ROW = r"(?is)(<tr\b.*?</tr>|<li\b.*?</li>|<div[^>]*\bcatAgendaRow\b.*?</div>)"


def _link(kind, title: Column, url: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), title.alias("title"), url.alias("url"))


def _given(links: Column) -> Column:
    return F.filter(links, lambda link: F.length(link.url) > 0)


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def event_meetings(answers: DataFrame) -> DataFrame:
    """Meetings of an events API: agenda, minutes and the attachments of the items."""
    e, day = F.col("e"), T.civic_date(F.col("e.EventDate"))
    body = F.coalesce(F.nullif(e.EventBodyName, F.lit("")), F.lit(UNKNOWN))
    own = F.array(*[_link(kind, F.concat_ws(" ", body, F.lit(kind), day.cast("string")), e[f"Event{kind.title()}File"]) for kind in ("agenda", "minutes")])
    attached = F.flatten(F.transform(F.coalesce(e.EventItems, F.array()), lambda i: F.coalesce(i.EventItemMatterAttachments, F.array())))
    named = F.transform(attached, lambda a: _link(T.document_kind(a.MatterAttachmentName), a.MatterAttachmentName, a.MatterAttachmentHyperlink))
    status = F.lower(F.concat_ws(" ", e.EventComment, e.EventAgendaStatusName))
    rows = answers.select("platform", "source", F.explode(F.from_json("answer", f"array<{EVENT}>")).alias("e"))
    return rows.select(
        "platform", "source", e.EventId.cast("string").alias("external_id"), body.alias("body"), day.alias("held_on"), F.coalesce(F.nullif(e.EventComment, F.lit("")), e.EventBodyName).alias("title"),
        status.contains("cancel").alias("cancelled"), _media(e.EventVideoPath).alias("media"), _given(F.concat(own, named)).alias("documents"),
    ).where("held_on IS NOT NULL")


def portal_meetings(answers: DataFrame) -> DataFrame:
    """Meetings of a portal that answers with a list, or with one under ``meetings``."""
    listed = F.coalesce(F.from_json("answer", f"struct<meetings:array<{RECORD}>>")["meetings"], F.from_json("answer", f"array<{RECORD}>"))
    m, day = F.col("m"), T.civic_date(F.coalesce("m.date", "m.startsAt"))
    body = F.coalesce(F.nullif(m.bodyName, F.lit("")), F.nullif(m.committee, F.lit("")), F.lit(UNKNOWN))
    links = F.array(*[_link(kind, F.concat(body, F.lit(f" {kind}")), m[url]) for kind, url in (("agenda", "agendaUrl"), ("minutes", "minutesUrl"), ("agenda", "packetUrl"))])
    return answers.select("platform", "source", F.explode(listed).alias("m")).select(
        "platform", "source", F.coalesce(F.nullif(m.id, F.lit("")), day.cast("string")).alias("external_id"), body.alias("body"), day.alias("held_on"), m.title.alias("title"),
        F.coalesce(m.canceled, F.lit(False)).alias("cancelled"), F.nullif(m.videoUrl, F.lit("")).alias("media"), _given(links).alias("documents"),
    ).where("held_on IS NOT NULL")


def absolute(root: Column, href: Column) -> Column:
    site = F.regexp_extract(root, r"^([a-zA-Z][\w+.-]*://[^/]+)", 1)
    return F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), href))


def row_links(row: Column, root: Column) -> Column:
    """The links of a row by their lower-case names, in order; of one name the last address, and without a text the label or "document"."""
    tags = F.regexp_extract_all(row, F.lit(r"(?is)(<a\b[^>]*\bhref\s*=.*?</a>)"), 1)
    attribute = lambda a, name: F.regexp_extract(a, rf"""(?is)^<a\b[^>]*\b{name}\s*=\s*["']([^"']+)["']""", 1)
    pairs = F.transform(tags, lambda a: F.struct(F.lower(F.coalesce(F.nullif(_plain(a), F.lit("")), F.nullif(attribute(a, "aria-label"), F.lit("")), F.lit("document"))).alias("name"), attribute(a, "href").alias("href")))
    pairs = F.filter(pairs, lambda p: p.href != "")
    return F.transform(F.array_distinct(pairs["name"]), lambda n: F.struct(n.alias("name"), absolute(root, F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1).href).alias("url")))


def agenda_meetings(answers: DataFrame) -> DataFrame:
    """Meetings of an agenda page: rows with a day and a link, under the heading before them.

    Of one body and day on a page the first row counts. ``source`` is the site's address.
    """
    parts = answers.select("platform", "source", F.monotonically_increasing_id().alias("page"), F.posexplode(F.split("answer", r"(?i)(?=<h[23]\b)")).alias("part", "section"))
    name = F.coalesce(F.nullif(_plain(F.regexp_extract("section", r"(?is)^<h[23]\b[^>]*>(.*?)</h[23]>", 1)), F.lit("")), F.lit(UNKNOWN))
    rows = parts.select("platform", "source", "page", "part", name.alias("body"), F.posexplode(F.regexp_extract_all("section", F.lit(ROW), 1)).alias("place", "row"))
    text = _plain(F.col("row"))
    day = F.coalesce(*[T.civic_date(F.regexp_replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), r"^([A-Za-z]+ \d+) ", "$1, ")) for p in (r"\b(\d{4}-\d{2}-\d{2})\b", r"\b(\d{1,2}/\d{1,2}/\d{4})\b", r"\b([A-Z][a-z]+ \d{1,2},? \d{4})\b")])
    found = rows.select("platform", "source", "page", F.struct("part", "place").alias("at"), "body", day.alias("held_on"), text.alias("text"), row_links(F.col("row"), F.col("source")).alias("links")).where("held_on IS NOT NULL AND size(links) > 0")
    first = found.groupBy("platform", "source", "page", "body", "held_on").agg(F.min_by(F.struct("text", "links"), "at").alias("r"))
    links, heard = F.col("r.links"), lambda n: reduce(lambda a, b: a | b, [n.contains(w) for w in RECORDINGS])
    documents = F.transform(links, lambda link: _link(T.document_kind(link["name"]), F.concat_ws(" ", "body", link["name"], F.col("held_on").cast("string")), link.url))
    return first.select(
        "platform", "source", F.concat_ws(":", "body", F.col("held_on").cast("string")).alias("external_id"), "body", "held_on", F.substring("r.text", 1, 200).alias("title"),
        F.lower("r.text").contains("cancel").alias("cancelled"), F.get(F.filter(links, lambda link: heard(link["name"])), F.lit(0)).url.alias("media"), documents.alias("documents"),
    )


def no_meetings(answers: DataFrame) -> DataFrame:
    """Permit records and codes of law have no meetings."""
    return answers.where("false").selectExpr("platform", "source", "source AS external_id", "source AS body", "CAST(NULL AS DATE) AS held_on", "source AS title", "false AS cancelled", "source AS media", f"CAST(array() AS array<{LINK}>) AS documents")


def record_documents(answers: DataFrame) -> DataFrame:
    """Files of permit records, by the name of the file or else their address."""
    f = F.col("f")
    name = F.nullif(f.fileName, F.lit(""))
    rows = answers.select("platform", "source", F.explode(F.from_json("answer", f"struct<result:array<{FILE}>>")["result"]).alias("f"))
    return rows.select("platform", "source", T.document_kind(F.coalesce(f["type"]["text"], F.lit("document"))).alias("kind"), F.coalesce(name, F.lit("document")).alias("title"), F.coalesce(name, F.nullif(f.url, F.lit(""))).alias("url"), T.civic_date(f.uploadedDate).alias("published_on")).where("url IS NOT NULL")


def archive_or_events(answers: DataFrame) -> DataFrame:
    """A media archive answers with a page, or with the events of the same maker's API."""
    json = F.ltrim("answer").startswith("[")
    return event_meetings(answers.where(json)).unionByName(agenda_meetings(answers.where(~json)))


@dataclass(frozen=True)
class Adapter:
    """``documents`` is None where the meetings hold them.

    ``places`` are (kind, title, address): a name in braces is the site's ``root`` or a
    key of its configuration, and a place whose names are not all known is left out.
    """

    meetings: Callable[[DataFrame], DataFrame]
    documents: Callable[[DataFrame], DataFrame] | None = None
    places: tuple[tuple[str, str, str], ...] = ()


# fixed values: the addresses that the platforms answer at
API = "https://webapi.legistar.com/v1/{legistar_client}"
EVENTS = (("agenda", "Legistar events for {legistar_client}", f"{API}/Events"), ("application_packet", "Legistar matters for {legistar_client}", f"{API}/Matters"), ("other", "Legistar bodies for {legistar_client}", f"{API}/Bodies"))
ADAPTERS = {
    "legistar": Adapter(event_meetings, places=EVENTS),
    "granicus": Adapter(archive_or_events, places=(*EVENTS, ("agenda", "Granicus meeting archive", "{granicus_host}/ViewPublisher.php?view_id={granicus_view_id}"))),
    "civicplus": Adapter(
        agenda_meetings,
        places=(
            ("agenda", "CivicPlus AgendaCenter", "{root}/AgendaCenter"), ("agenda", "CivicPlus AgendaCenter search, all categories", "{root}/AgendaCenter/Search/?term=&CIDs=all&startDate=&endDate=&dateRange=&dateSelector="),
            ("minutes", "CivicPlus ArchiveCenter", "{root}/ArchiveCenter"),
        ),
    ),
    "accela": Adapter(no_meetings, record_documents, (("application_packet", "Accela records for {accela_agency}", "https://apis.accela.com/v4/records"),)),
    "opengov": Adapter(portal_meetings, places=(("agenda", "OpenGov meetings for {opengov_tenant}", "https://{opengov_tenant}.opengov.com/api/meetings"),)),
    "municode": Adapter(
        no_meetings,
        places=(
            ("ordinance", "Municode code content", "https://api.municode.com/codesContent?jobId={municode_client_id}"), ("ordinance", "Municode table of contents", "https://api.municode.com/CodesToc?jobId={municode_client_id}"),
            ("ordinance", "Municode library for {municode_state}", "https://library.municode.com/{municode_state}"), ("ordinance", "american legal url", "{american_legal_url}"), ("ordinance", "ecode360 url", "{ecode360_url}"),
        ),
    ),
}


def for_platform(name: str) -> Adapter | None:
    """The adapter of a platform; none for one that cannot be read, rather than a guess."""
    return ADAPTERS.get(name)


def meetings(answers: DataFrame, since: str | None = None) -> DataFrame:
    """The meetings of (platform, source, answer) by the adapter of each row's platform; ``since`` keeps those on or after a day."""
    parts = [a.meetings(answers.where(F.col("platform") == name)).select(*MEETING) for name, a in ADAPTERS.items() if a.meetings is not no_meetings]
    found = reduce(DataFrame.unionByName, parts)
    return found if since is None else found.where(F.col("held_on") >= F.lit(since).cast("date"))


def documents(answers: DataFrame) -> DataFrame:
    """The documents of answers: those of meetings, and the files of records."""
    held = meetings(answers).select("platform", "source", F.explode("documents").alias("d"), F.col("held_on").alias("published_on")).select("platform", "source", "d.kind", "d.title", "d.url", "published_on")
    return reduce(DataFrame.unionByName, [held, *(a.documents(answers.where(F.col("platform") == name)) for name, a in ADAPTERS.items() if a.documents)])


def discovered(sites: DataFrame) -> DataFrame:
    """Where to look for (platform, root, config map<string, string>): site, platform, kind, title and url of each place.

    The meetings archive without a host is at the root, and its first list is number 2. With an events API it is
    that API alone, and a code host that is known by its number is not looked up by its state.
    """
    rows = [(name, *place) for name, a in ADAPTERS.items() for place in a.places]
    places = sites.sparkSession.createDataFrame(rows, "platform string, kind string, title string, url string")
    root = F.regexp_replace("root", "/+$", "")
    given = F.map_filter(F.coalesce("config", F.create_map().cast("map<string,string>")), lambda k, v: F.length(v) > 0)
    api, number = F.try_element_at(given, F.lit("legistar_client")), F.try_element_at(given, F.lit("municode_client_id"))
    known = {
        **{k: F.try_element_at(given, F.lit(k)) for k in ("legistar_client", "accela_agency", "opengov_tenant", "municode_client_id", "american_legal_url", "ecode360_url")}, "root": root,
        "municode_state": F.when(number.isNull(), F.try_element_at(given, F.lit("municode_state"))), "granicus_host": F.when(api.isNull(), F.coalesce(F.try_element_at(given, F.lit("granicus_host")), root)), "granicus_view_id": F.coalesce(F.try_element_at(given, F.lit("granicus_view_id")), F.lit("2")),
    }
    names = F.array(*[F.struct(F.lit(f"{{{k}}}").alias("key"), v.alias("value")) for k, v in known.items()])
    filled = lambda c: F.aggregate(F.col("known"), F.col(c), lambda text, k: F.replace(text, k["key"], k["value"]))
    met = sites.select("platform", "root", F.filter(names, lambda k: k["value"].isNotNull()).alias("known")).join(F.broadcast(places), "platform")
    return met.select("root", "platform", "kind", filled("title").alias("title"), filled("url").alias("url")).where(~F.col("url").rlike(r"\{\w+\}"))
