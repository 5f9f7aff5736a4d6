"""Main text of web pages, by differencing with the nearest URLs and by markup.

Pages are ordered by (host, path). The lines of each page are aligned with those
of the nearest page before and the nearest behind it on the host, by a longest
common subsequence; pages with the same html count as one place in the order, so
that a copy is nobody's nearest page. A shared line is a template line if both
pages have it, or if it stands in a run of shared lines at the head or the tail
of the page; a line that one page shares amid its own text is a passage that
occurs twice. Pages that share ``COPY`` of their lines tell nothing about each
other.

Markup has a veto both ways. Where a page names its main part (article, main,
role main), the lines inside stay, whether shared or not, and those outside go.
Menus, headers, footers, sidebars, notices, adverts, forms and comments that the
markup names go everywhere; of a header inside the main part the headings stay,
and a main part is never judged by a mere part of its class name.

The order is cut into blocks of about as many pages, and the pages next to a
block's ends are sent along, so the text of a page depends on the table alone.
A host may have any number of blocks.

A null or empty page has the empty text. Repeated rows each return a row. A
null or odd URL counts as host and path ''.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPY = 0.8
TABLE_CELLS = 1 << 22
#: blocks are dealt to tasks by hash, so a task should have several; the ends of all of them are known to the driver
BLOCKS_A_TASK, MOST_BLOCKS = 16, 1 << 16
RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
SKIPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: words in class, id or role that name what is not the article, and words that may stand beside them
NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside masthead footer comment comments disqus respond reply replies share sharing social "
    "related recommended newsletter subscribe subscription signup login search searchbox toolbar pagination pager widget contentinfo complementary skip".split()
)
BESIDE = set("area bar bottom box body button buttons center container content entry form global group holder icon icons inner item items label left link links list main page panel post posts primary right row secondary section site slot top unit wrap wrapper".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_STYLED_AWAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[a-z]+")


def _names(token: str) -> set[str]:
    return set(_WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower()))


def _kind(name: str, attributes: str) -> str:
    """What an element is by its markup: out, header, main, or nothing."""
    if name in SKIPPED:
        return "out"
    found = "header" if name == "header" else "main" if name in MAIN else ""
    if not attributes or name in ("html", "body"):
        return found
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _STYLED_AWAY.search(value):
            return "out"
        if key == "role" and value.lower() == "main":
            found = "main"
        elif key in ("class", "id", "role"):
            for token in value.split():
                words = _names(token)
                if words & NAMES and (words <= NAMES if name in MAIN else words <= NAMES | BESIDE):
                    return "out"
                if "header" in words and words <= NAMES | BESIDE | {"header"} and name not in MAIN:
                    found = found or "header"
    return found


def _tokens(html: str):
    """(kind, name, value): text, open and close tokens, raw elements and comments left out."""
    at, n, lower = 0, len(html), None
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", "", html[at:]
            return
        if lt > at:
            yield "text", "", html[at:lt]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            if end < 0:
                return  # a comment that never ends
            at = end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, lt) or _LOOSE_TAG.match(html, lt)
        if not m:
            yield "text", "", "<"
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            yield "close", name, ""
        elif name in RAW and not m[3].endswith("/"):
            lower = html.lower() if lower is None else lower
            if len(lower) != n:  # lower-casing changed the length of some letter
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in html)
            end = lower.find("</" + name, at)
            stop = -1 if end < 0 else html.find(">", end)
            at = n if stop < 0 else stop + 1
        else:
            yield "open", name, m[3]


def lines(html: str | None) -> list[tuple[str, bool]]:
    """(line, whether it is inside a named main part) for each block in page order that the markup does not rule out."""
    tokens = list(_tokens(html or ""))
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    mains: list[list] = []  # name, open elements of it
    skipping, depth = "", 0
    header, deep, heading = "", 0, 0  # inside a header of the main part only headings count
    left: dict[str, int] = {}
    for kind, name, _ in tokens:
        if kind == "close":
            left[name] = left.get(name, 0) + 1

    def flush():
        line = " ".join("".join(text).split())
        text.clear()
        if line and (not header or heading):
            out.append((line, bool(mains)))

    for kind, name, value in tokens:
        if kind == "close":
            left[name] -= 1
        if skipping:
            if kind != "text" and name == skipping:
                depth += 1 if kind == "open" else -1
                if depth == 0 or kind == "open" and left.get(name, 0) < depth:
                    skipping = ""
            continue
        if kind == "text":
            text.append(unescape(value) if "&" in value else value)
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            text.append(" ")
        if name in HEADINGS:
            heading = max(0, heading + (1 if kind == "open" else -1))
        if kind == "close":
            for m in mains:
                m[1] -= m[0] == name
            if any(m[1] <= 0 for m in mains):
                flush()
                mains = [m for m in mains if m[1] > 0]
            if name == header:
                deep -= 1
                if deep == 0:
                    flush()
                    header = ""
            continue
        if name in VOID or value.endswith("/") or left.get(name, 0) <= 0:
            if name in MAIN:
                mains.append([name, 1])  # never closed
            continue
        what = _kind(name, value)
        if what == "out" or what == "header" and not mains:
            flush()
            skipping, depth = name, 1
            continue
        for m in mains:
            m[1] += m[0] == name
        deep += name == header
        if what == "header" and not header:
            flush()
            header, deep, heading = name, 1, 0
        elif what == "main":
            flush()
            mains.append([name, 1])
    flush()
    return out


def shared(a: list, b: list) -> np.ndarray:
    """Which items of ``a`` a longest common subsequence of ``a`` and ``b`` holds."""
    ids: dict = {}
    x = np.array([ids.setdefault(v, len(ids)) for v in a], dtype=np.int64)
    y = np.array([ids.setdefault(v, len(ids)) for v in b], dtype=np.int64)
    mask = np.zeros(len(x), dtype=bool)
    _align(x, y, mask)
    return mask


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common subsequences of all of ``x`` and each beginning of ``y``."""
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for v in x:
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + (y == v))
        row = np.maximum.accumulate(step)
    return row


def _align(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> None:
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    head = n if same.all() else int(np.argmin(same))
    mask[:head] = True
    x, y, mask, n = x[head:], y[head:], mask[head:], n - head
    if n:
        same = x[::-1][:n] == y[::-1][:n]
        tail = n if same.all() else int(np.argmin(same))
        if tail:
            mask[len(x) - tail :] = True
            x, y, mask = x[:-tail], y[:-tail], mask[: len(x) - tail]
    if not len(x) or not len(y):
        return
    if len(x) == 1:
        mask[0] = bool((y == x[0]).any())
        return
    if len(x) * len(y) > TABLE_CELLS:  # in halves, in linear memory
        half = len(x) // 2
        cut = int(np.argmax(_row(x[:half], y) + _row(x[half:][::-1], y[::-1])[::-1]))
        _align(x[:half], y[:cut], mask[:half])
        _align(x[half:], y[cut:], mask[half:])
        return
    table = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
    for i, v in enumerate(x):
        step = np.maximum(table[i], 0)
        step[1:] = np.maximum(table[i, 1:], table[i, :-1] + (y == v))
        table[i + 1] = np.maximum.accumulate(step)
    i, j = len(x), len(y)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            mask[i] = True


def template(own: list[str], neighbours: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(how many of the nearest pages share each line, whether it is a template line)."""
    times, tell = np.zeros(len(own), dtype=np.int64), 0
    for other in neighbours:
        both = shared(own, other)
        if both.sum() < COPY * max(len(own), len(other)):
            times += both
            tell += 1
    if tell > 1:
        return times, times == tell
    alone = np.flatnonzero(times == 0)
    if not len(alone) or alone[0] == 0 or alone[-1] == len(own) - 1:
        return times, times < 0
    at = np.arange(len(own))
    return times, (at < alone[0]) | (at > alone[-1])


def main_text(own: list[tuple[str, bool]], neighbours: list[list[tuple[str, bool]]]) -> tuple[str, int]:
    """The lines of a page that are left, given the lines of its nearest pages, and how many lines it shares with them."""
    times, gone = template([line for line, _ in own], [[line for line, _ in other] for other in neighbours])
    if any(inside for _, inside in own):
        kept = [line for line, inside in own if inside]
    else:
        kept = [line for (line, _), out in zip(own, gone.tolist(), strict=True) if not out]
    return "\n".join(kept), int((times > 0).sum())


def _order(host, path, key, mark) -> tuple:
    return host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass"), key is not None, key if key is not None else 0, mark


def _ends(batches, size: int):
    """The ends of each run of ``size`` pages in order: its first and last page, and the next to them on the host with another html."""
    rows: list[tuple] = []

    def cut(block):
        first, last = block[0], block[-1]
        behind = next((r for r in block if r[3] != first[3] or r[0] != first[0]), None)
        before = next((r for r in reversed(block) if r[3] != last[3] or r[0] != last[0]), None)
        return first, behind, before, last

    def out(found):
        ends = [[f[k] for f in found] for k in range(4)]
        columns = []
        for end in ends:
            columns += [[None if r is None else r[k] for r in end] for k in range(4)]
        types = [pa.string(), pa.string(), kind, pa.int64()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f"e{k}" for k in range(16)])

    kind = None
    for batch in batches:
        kind = batch.column(2).type
        rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        full = len(rows) // size * size
        if full:
            yield out([cut(rows[lo : lo + size]) for lo in range(0, full, size)])
            rows = rows[full:]
    if rows:
        yield out([cut(rows)])


def _context(blocks: list[tuple]) -> dict[tuple, list[int]]:
    """Which pages each block needs besides its own: the nearest before and behind it."""
    needed: dict[tuple, list[int]] = {}

    def look(order, end: int, near: int, far: int):
        """From each block to the one next to it: its near end, the page with another html beyond that, or what that block itself looked up."""
        found = past = None
        for i in order:
            own = blocks[i][end]
            if past is not None:
                if past[near][0] != own[0]:
                    found = None
                elif past[near][3] != own[3]:
                    found = past[near]
                elif past[far] is not None:
                    found = past[far] if past[far][0] == own[0] else None
            if found is not None:
                needed.setdefault(_order(*found), []).append(i)
            past = blocks[i]

    look(range(len(blocks)), 0, 3, 2)
    look(range(len(blocks) - 1, -1, -1), 3, 0, 1)
    return needed


_PARSED = ["block", "host", "path", "id", "mark", "own", "url", "text", "inside"]


def _parsed(batches, starts: list[tuple], needed: dict[tuple, list[int]]):
    """The lines of each page, in its own block and in those that need it besides. Columns: host, path, id, mark, url, html."""
    for batch in batches:
        rows: list[tuple] = []
        for host, path, key, mark, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = lines(html)
            page = (host, path, key, mark)
            text, inside = "\n".join(line for line, _ in found), "".join("01"[i] for _, i in found)
            at = _order(*page)
            rows.append((max(0, bisect_right(starts, at) - 1), *page, True, url, text, inside))
            rows += [(block, *page, False, url, text, inside) for block in needed.get(at, ())]
        if rows:
            types = [pa.int64(), pa.string(), pa.string(), batch.column(2).type, pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_PARSED)


def _stream(batches):
    """Texts of pages that come in order within their blocks; pages in a row with one html on one host are one place."""
    before: list | None = None
    now: list | None = None  # [(block, host, mark), lines, rows of the page]
    kind = None

    def done(behind):
        near = [place[1] for place in (before, behind) if place is not None and place[0][:2] == now[0][:2]]
        text, n = main_text(now[1], near) if now[2] else ("", 0)
        return [(*row, text, len(text), n) for row in now[2]]

    def out(rows):
        types = [kind, pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "url", "text", "n_chars", "n_shared"])

    for batch in batches:
        kind = batch.column(3).type
        rows: list[tuple] = []
        for block, host, _, key, mark, own, url, text, inside in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now[0] != (block, host, mark):
                place = [(block, host, mark), [(line, i == "1") for line, i in zip(text.split("\n"), inside, strict=bool(inside))], []]
                if now is not None:
                    rows += done(place)
                before, now = now, place
            if own:
                now[2].append((key, url))
        if rows:
            yield out(rows)
    if now is not None and now[2]:
        yield out(done(None))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_shared) of every page; ``n_shared`` counts its lines that a nearest page has too."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    part = lambda what: F.coalesce(F.lower(F.expr(f"try_parse_url(`{url_col}`, '{what}')")), F.lit(""))
    keys = [part("HOST").alias("host"), part("PATH").alias("path"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(html_col), F.lit(""))).alias("mark")]
    rows = pages.select(*keys, F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    order = ["host", "path", "id", "mark"]
    blocks = min(MOST_BLOCKS, BLOCKS_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = max(1, -(-pages.count() // blocks))
    ends = rows.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"e{4 * k} string, e{4 * k + 1} string, e{4 * k + 2} {kind}, e{4 * k + 3} bigint" for k in range(4))
    found = ends.mapInArrow(lambda b: _ends(b, size), schema).collect()
    blocks = sorted(([None if r[4 * k] is None else tuple(r[4 * k : 4 * k + 4]) for k in range(4)] for r in found), key=lambda e: _order(*e[0]))
    shared_ends = spark.sparkContext.broadcast(([_order(*e[0]) for e in blocks], _context(blocks)))
    parsed = rows.mapInArrow(lambda b: _parsed(b, *shared_ends.value), f"block bigint, host string, path string, id {kind}, mark bigint, own boolean, url string, text string, inside string")
    out = parsed.repartition("block").sortWithinPartitions("block", *order).mapInArrow(_stream, f"id {kind}, url string, text string, n_chars bigint, n_shared bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
