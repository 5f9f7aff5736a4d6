import datetime as dt
import json

from permrisk.sources import adapters

D = dt.date
ANSWER = "platform string, source string, answer string"


def test_events(spark):
    events = [
        {"EventId": 1, "EventBodyName": "Planning", "EventDate": "2024-03-04T00:00:00", "EventAgendaFile": "a.pdf", "EventVideoPath": "https://x.example/MediaPlayer.php?clip=3", "EventItems": [{"EventItemTitle": "t"}, {"EventItemMatterAttachments": [{"MatterAttachmentName": "Staff Report", "MatterAttachmentHyperlink": "r.pdf"}, {"MatterAttachmentName": "none"}]}]},
        {"EventId": 2, "EventDate": "2024-03-05T00:00:00", "EventComment": "Cancelled"}, {"EventId": 3, "EventDate": "soon"},
    ]
    rows = spark.createDataFrame([("legistar", "c", json.dumps(events)), ("legistar", "c", None), ("legistar", "c", "{"), ("unheard", "c", json.dumps(events)), ("granicus", "g", json.dumps(events[1:2]))], ANSWER)
    got = {(r.platform, r.external_id, r.body, r.held_on, r.title, r.cancelled, r.media, tuple(map(tuple, r.documents))) for r in adapters.meetings(rows).collect()}
    assert got == {
        ("legistar", "1", "Planning", D(2024, 3, 4), "Planning", False, "https://x.example/MediaPlayer.php?clip=3", (("agenda", "Planning agenda 2024-03-04", "a.pdf"), ("staff_report", "Staff Report", "r.pdf"))),
        ("legistar", "2", "unknown body", D(2024, 3, 5), "Cancelled", True, None, ()), ("granicus", "2", "unknown body", D(2024, 3, 5), "Cancelled", True, None, ()),
    }
    assert adapters.meetings(rows, "2024-03-05").count() == 2


def test_portal_in_both_shapes(spark):
    m = {"id": "9", "title": "T", "startsAt": "2024-02-01", "committee": "Board", "packetUrl": "p", "minutesUrl": "", "canceled": True, "videoUrl": "v"}
    rows = spark.createDataFrame([("opengov", "a", json.dumps([m])), ("opengov", "b", json.dumps({"meetings": [m, {"date": "2024-02-02"}, {"date": None}]}))], ANSWER)
    got = {(r.source, r.external_id, r.body, r.cancelled, r.media, tuple(map(tuple, r.documents))) for r in adapters.meetings(rows).collect()}
    full = ("9", "Board", True, "v", (("agenda", "Board agenda", "p"),))
    assert got == {("a", *full), ("b", *full), ("b", "2024-02-02", "unknown body", False, None, ())}


PAGE = """<div><h2>Planning <b>Commission</b></h2><table><tr><th>no day</th></tr>
<tr><td>March 4, 2024</td><td><a href="/a/1.pdf">Agenda</a> <a class=x href='rel.pdf' aria-label="Minutes"></a><a href="//v.example/w">Watch Now</a></td></tr>
<tr><td>3/4/2024 again</td><td><a href="z.pdf">Agenda</a></td></tr><tr><td>2024-05-01 CANCELED</td><td><a href="https://o.example/x">Agenda</a><a href="last.pdf">agenda</a></td></tr></table>
<h3>Board</h3><ul><li>03/04/2024 <a href='b.pdf'></a></li><li>03/05/2024 no link</li></ul></div>"""


def test_agenda_page(spark):
    rows = spark.createDataFrame([("civicplus", "https://c.example/site/", PAGE), ("civicplus", "https://d.example", None), ("granicus", "https://g.example", "<li>May 1 2024 <a href='m.mp4'>recording</a></li>")], ANSWER)
    got = {(r.source[8], r.external_id, r.cancelled, r.media, tuple(map(tuple, r.documents))) for r in adapters.meetings(rows).collect()}
    assert got == {
        ("c", "Planning Commission:2024-03-04", False, "https://v.example/w", (("agenda", "Planning Commission agenda 2024-03-04", "https://c.example/a/1.pdf"), ("minutes", "Planning Commission minutes 2024-03-04", "https://c.example/site/rel.pdf"), ("other", "Planning Commission watch now 2024-03-04", "https://v.example/w"))),
        ("c", "Planning Commission:2024-05-01", True, None, (("agenda", "Planning Commission agenda 2024-05-01", "https://c.example/site/last.pdf"),)),
        ("c", "Board:2024-03-04", False, None, (("other", "Board document 2024-03-04", "https://c.example/site/b.pdf"),)),
        ("g", "unknown body:2024-05-01", False, "https://g.example/m.mp4", (("other", "unknown body recording 2024-05-01", "https://g.example/m.mp4"),)),
    }


def test_documents_of_records_and_meetings(spark):
    files = {"result": [{"fileName": "Staff report.pdf", "type": {"text": "Staff Report"}, "uploadedDate": "2024-01-02T00:00:00"}, {"url": "u"}, {"type": {"text": "x"}}]}
    portal = [{"date": "2024-02-02", "agendaUrl": "a"}]
    rows = spark.createDataFrame([("accela", "s", json.dumps(files)), ("accela", "s", "no"), ("opengov", "o", json.dumps(portal)), ("municode", "m", "[]")], ANSWER)
    assert {tuple(r) for r in adapters.documents(rows).collect()} == {
        ("accela", "s", "staff_report", "Staff report.pdf", "Staff report.pdf", D(2024, 1, 2)), ("accela", "s", "other", "document", "u", None), ("opengov", "o", "agenda", "unknown body agenda", "a", D(2024, 2, 2)),
    }


def test_places_to_look(spark):
    sites = [
        ("legistar", "https://l.example", {"legistar_client": "loudoun"}), ("legistar", "https://l2.example", {}), ("granicus", "https://g.example/", None), ("granicus", "https://h.example", {"granicus_host": "https://v.example", "granicus_view_id": "7"}),
        ("granicus", "https://i.example", {"legistar_client": "i"}), ("civicplus", "https://c.example/", None), ("municode", "m", {"municode_state": "va", "municode_client_id": "12", "ecode360_url": "e"}), ("municode", "n", {"municode_state": "va", "municode_client_id": ""}), ("unheard", "x", {}), ("opengov", "o", {"opengov_tenant": "t"}),
    ]
    found: dict[str, set] = {}
    for r in adapters.discovered(spark.createDataFrame(sites, "platform string, root string, config map<string,string>")).collect():
        found.setdefault(r.root, set()).add(r.url)
    api = "https://webapi.legistar.com/v1"
    assert found == {
        "https://l.example": {f"{api}/loudoun/{x}" for x in ("Events", "Matters", "Bodies")}, "https://g.example/": {"https://g.example/ViewPublisher.php?view_id=2"}, "https://h.example": {"https://v.example/ViewPublisher.php?view_id=7"},
        "https://i.example": {f"{api}/i/{x}" for x in ("Events", "Matters", "Bodies")}, "https://c.example/": {f"https://c.example/{x}" for x in ("AgendaCenter", "AgendaCenter/Search/?term=&CIDs=all&startDate=&endDate=&dateRange=&dateSelector=", "ArchiveCenter")},
        "m": {"https://api.municode.com/codesContent?jobId=12", "https://api.municode.com/CodesToc?jobId=12", "e"}, "n": {"https://library.municode.com/va"}, "o": {"https://t.opengov.com/api/meetings"},
    }
    assert adapters.for_platform("unheard") is None and adapters.for_platform("accela").documents is adapters.record_documents
