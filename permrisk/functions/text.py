"""Text functions of the civic documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of the relief vocabulary; all that match count, in this order
RELIEF = (
    ("rezoning", r"(?i)\brezon|\bzoning\s+map\s+amend|\bmap\s+amend|\bzone\s+chang"),
    ("special_use_permit", r"(?i)\bspecial\s+(use|exception)|\bSUP\b|\bspecial\s+permit"),
    ("conditional_use_permit", r"(?i)\bconditional\s+use|\bCUP\b"),
    ("variance", r"(?i)\bvarianc"),
    ("site_plan_approval", r"(?i)\bsite\s+plan|\bdevelopment\s+plan\s+review"),
    ("comprehensive_plan_amendment", r"(?i)\bcomprehensive\s+plan|\bcomp\s+plan|\bfuture\s+land\s+use"),
    ("text_amendment", r"(?i)\btext\s+amend|\bordinance\s+amend|\bcode\s+amend"),
    ("annexation", r"(?i)\bannex"),
    ("development_agreement", r"(?i)\bdevelopment\s+agreement|\bhost\s+agreement|\bcommunity\s+benefit"),
    ("tax_abatement", r"(?i)\babatement|\btax\s+increment|\bTIF\b|\bincentive\s+agreement"),
    ("subdivision_plat", r"(?i)\bplat\b|\bsubdivi"),
)
# fixed values: patterns of the use classes; the first that matches counts
USE_CLASS = (
    ("data_center_hyperscale", r"(?i)\bhyperscale|\bAI\s+campus|\bcomputing?\s+campus"),
    ("data_center_colocation", r"(?i)\bcolocation|\bcolo\b|\bmulti[- ]?tenant\s+data"),
    ("data_center_edge", r"(?i)\bedge\s+data\s*cent"),
    ("data_center_hyperscale", r"(?i)\bdata\s*cent|\bdata\s*centre|\bserver\s+farm"),
    ("solar_utility", r"(?i)\bsolar\b"),
    ("wind_onshore", r"(?i)\bwind\s+(farm|energy|turbine)"),
    ("battery_storage", r"(?i)\bbattery|\bBESS\b|\benergy\s+storage"),
    ("substation_transmission", r"(?i)\bsubstation|\btransmission\s+line"),
    ("warehouse_logistics", r"(?i)\bwarehouse|\bdistribution\s+cent|\blogistics"),
    ("residential_multifamily", r"(?i)\bapartment|\bmultifamily|\bmulti[- ]family"),
    ("industrial_general", r"(?i)\bindustrial|\bmanufactur"),
)
# fixed values: patterns of the outcomes, denial before approval
OUTCOME = (
    ("denied", r"(?i)\bdenied?\b|\brejected?\b|\bfailed\b|\bdefeated\b|\bvoted\s+down"),
    ("approved_with_conditions", r"(?i)\bapproved?\s+with\s+condition|\bapproved?\s+subject\s+to"),
    ("approved", r"(?i)\bapproved?\b|\bgranted\b|\badopted\b|\bpassed\b"),
    ("withdrawn", r"(?i)\bwithdrew?n?\b|\bwithdraw"),
    ("continued", r"(?i)\bcontinued\b|\bdeferred\b|\bpostponed\b"),
    ("tabled", r"(?i)\btabled\b|\bheld\s+in\s+committee"),
)
# fixed values: document kinds by what a title contains
KINDS = (
    ("agenda", "agenda"), ("minutes", "minutes"), ("staff report", "staff_report"), ("staff memo", "staff_report"), ("ordinance", "ordinance"), ("resolution", "resolution"),
    ("comprehensive plan", "comprehensive_plan"), ("notice", "legal_notice"), ("application", "application_packet"), ("transcript", "transcript"),
)
# fixed values: trailing words that do not tell companies apart
SUFFIXES = (
    "llc", "l.l.c.", "inc", "inc.", "incorporated", "corp", "corp.", "corporation", "co", "co.", "company", "lp", "l.p.", "llp", "ltd", "ltd.", "limited", "holdings", "holding", "partners", "partnership",
    "trust", "group", "properties", "property", "development", "developments", "ventures", "capital", "investments", "realty",
)
# fixed values: abbreviations of bodies
BODIES = {
    "bos": "board of supervisors", "bocs": "board of county supervisors", "bcc": "board of county commissioners", "boc": "board of commissioners", "pc": "planning commission",
    "apc": "area plan commission", "zba": "zoning board of appeals", "bza": "board of zoning appeals", "cc": "city council",
}
# fixed values: titles in front of names
HONORIFICS = (
    "supervisor", "commissioner", "councilmember", "council member", "councilman", "councilwoman", "chairman", "chairwoman", "chair", "mayor", "mr", "mrs", "ms", "dr", "hon", "honorable", "vice",
)
# fixed values: words expected in planning documents
EXPECTED = (
    "the", "and", "of", "to", "in", "shall", "county", "board", "commission", "public", "hearing", "application", "zoning", "district", "property", "approve", "approved", "motion", "staff", "meeting",
    "development", "plan", "section", "ordinance", "member",
)
# fixed values: lines that open a section
HEADINGS = (
    r"(?i)^\s*(?:SEC(?:TION)?\.?\s+[\d.\-]+[A-Za-z]?)\s*[.:\-]?\s*(.*)$",
    r"(?i)^\s*(?:ARTICLE\s+[IVXLC\d]+)\s*[.:\-]?\s*(.*)$",
    r"(?i)^\s*(?:ITEM|AGENDA ITEM)\s+(?:NO\.?\s*)?([\w.\-]+)\s*[.:\-]?\s*(.*)$",
    r"^\s*(\d+(?:\.\d+){0,3})\s+([A-Z][A-Za-z].{4,90})$",
    r"(?i)^\s*(?:MOTION|MOVED|RESOLUTION|ORDINANCE)\b\s*[.:\-]?\s*(.*)$",
    r"^\s*([A-Z][A-Z \-&/,'()]{8,90})\s*$",
)
SINGLE_PURPOSE = r"(?i)\b(?:spe|spv|holdco|propco|project\s*co|acquisition\s*(?:co|corp)|[a-z]{1,3}\s*\d{1,4}\s*llc|solar\s*\d+|site\s*[a-z0-9]{1,4})\b"


def relief(raw: Column) -> Column:
    """All kinds of relief a description names, in the order of the vocabulary."""
    return F.array_compact(F.array(*[F.when(raw.rlike(p), F.lit(k)) for k, p in RELIEF]))


def _first(raw: Column, rules) -> Column:
    return F.coalesce(*[F.when(raw.rlike(p), F.lit(k)) for k, p in rules])


def use_class(raw: Column) -> Column:
    return _first(raw, USE_CLASS)


def outcome(raw: Column) -> Column:
    return _first(raw, OUTCOME)


def vote(raw: Column) -> Column:
    """(for, against, abstain) of a tally such as 4-1, 4 to 1 or 4:1-0; null for anything else."""
    form = r"^\s*(\d+)\s*(?:-|to|:)\s*(\d+)(?:\s*(?:-|to|:)\s*(\d+))?\s*$"
    part = lambda i: F.regexp_extract(raw, form, i)
    abstain = F.when(part(3) == "", F.lit(0)).otherwise(part(3).try_cast("int"))
    return F.when(raw.rlike(form), F.struct(part(1).try_cast("int").alias("for"), part(2).try_cast("int").alias("against"), abstain.alias("abstain")))


def document_kind(title: Column) -> Column:
    low = F.lower(title)
    return F.coalesce(*[F.when(low.contains(n), F.lit(k)) for n, k in KINDS], F.lit("other"))


def civic_date(raw: Column) -> Column:
    """The first of the usual forms that parses; null rather than a guess."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "M/d/yyyy h:mm a", "MMMM d, yyyy")
    return F.coalesce(*[F.try_to_timestamp(F.trim(raw), F.lit(f)).cast("date") for f in forms])


def organisation(raw: Column) -> Column:
    """What identifies a company: lower case, dotted initials joined, no punctuation, no trailing suffixes."""
    low = F.lower(raw)
    for n in range(6, 1, -1):  # runs of single letters with dots
        low = F.regexp_replace(low, r"\b" + r"([a-z])\." * n, "".join(f"${i}" for i in range(1, n + 1)))
    clean = F.trim(F.regexp_replace(F.regexp_replace(low, r"[^\w\s]", " "), r"\s+", " "))
    plain = "|".join(s for s in SUFFIXES if "." not in s)
    return F.trim(F.regexp_replace(clean, rf"(?:(?:^|\s)(?:{plain}))+$", ""))


def body(raw: Column) -> Column:
    """Abbreviations spelled out; a bare board or commission cannot be resolved and gives the empty name."""
    words = F.filter(F.split(F.regexp_replace(F.lower(raw), r"[^\w\s]", " "), r"\s+"), lambda w: w != "")
    table = F.create_map(*[F.lit(x) for kv in BODIES.items() for x in kv])
    full = F.array_join(F.transform(words, lambda w: F.coalesce(table[w], w)), " ")
    return F.when(full.isin("the board", "board", "the commission", "commission"), F.lit("")).otherwise(full)


def person(raw: Column) -> Column:
    """(surname, full): titles dropped, the surname the last word that is more than an initial."""
    words = F.transform(F.split(F.regexp_replace(F.lower(raw), r"[^\w\s.]", " "), r"\s+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    words = F.filter(words, lambda w: (w != "") & ~w.isin(*HONORIFICS))
    long = F.filter(words, lambda w: F.length(w) > 1)
    surname = F.coalesce(F.try_element_at(long, F.lit(-1)), F.try_element_at(words, F.lit(-1)), F.lit(""))
    return F.struct(surname.alias("surname"), F.array_join(words, " ").alias("full"))


def single_purpose(raw: Column) -> Column:
    core = organisation(raw)
    return raw.rlike(SINGLE_PURPOSE) | ((F.size(F.filter(F.split(core, " "), lambda w: w != "")) <= 2) & core.rlike(r"\d"))


def legibility(text: Column) -> Column:
    """0.40 share of plausible characters, 0.35 of plausible words, 0.25 of expected vocabulary; blank pages are legible."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    words = F.regexp_extract_all(t, F.lit(r"([A-Za-z][A-Za-z'\-]{1,})"), 1)
    plausible = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s.,;:'\"()\-/$%&#*\[\]]", "")) / F.length(t)
    shaped = F.size(F.filter(words, lambda w: F.length(w).between(2, 20))) / F.size(words)
    expected = F.least(F.size(F.array_intersect(F.transform(words, F.lower), F.array(*[F.lit(w) for w in EXPECTED]))) / 6.0, F.lit(1.0))
    return F.when(F.length(t) <= 24, 1.0).when(F.size(words) == 0, 0.0).otherwise(F.round(0.4 * plausible + 0.35 * shaped + 0.25 * expected, 3))


def heading(line: Column) -> Column:
    hit = F.lit(False)
    for p in HEADINGS:
        hit = hit | line.rlike(p)
    n = F.length(F.trim(line))
    return n.between(4, 120) & hit


def collapsed(text: Column) -> Column:
    """One blank for each run of white space, none in front of closing punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" ([.,;:!?)\]}%'\"])", "$1"))


def folded(text: Column) -> Column:
    """Curly quotes, dashes and odd blanks as plain ones, zero-width characters gone, at most two line ends in a row."""
    plain = F.translate(text, "‘’“”–—−   　", "''\"\"---    ")
    plain = F.regexp_replace(plain, "[​‌‍﻿­]", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\r\n?", "\n"), r"[ \t\f\x0B]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\w]+", " ")), " "), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3))))
    return F.array_distinct(grams)


def similarity(a: Column, b: Column) -> Column:
    """Shared part of the trigrams of two texts."""
    return F.try_divide(F.size(F.array_intersect(trigrams(a), trigrams(b))).cast("double"), F.size(F.array_union(trigrams(a), trigrams(b))).cast("double"))


def clock(ms: Column) -> Column:
    s = (ms / 1000).cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), (s % 60).cast("bigint"))


def general_election(year: Column) -> Column:
    """The Tuesday after the first Monday in November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "MON"), 1)
