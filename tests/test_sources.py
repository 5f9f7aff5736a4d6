import datetime as dt
import json

from permrisk.sources import civic


def test_api_meetings_and_documents(spark):
    events = [
        {"EventId": 1, "EventBodyName": "Planning Commission", "EventDate": "2024-03-04T00:00:00", "EventAgendaFile": "a.pdf", "EventMinutesFile": None, "EventVideoPath": "x clip_id=77", "EventItems": [{"EventItemTitle": "t", "EventItemMatterAttachments": [{"MatterAttachmentName": "Staff Report", "MatterAttachmentHyperlink": "r.pdf"}]}]},
        {"EventId": 2, "EventBodyName": "Board", "EventDate": "2023-01-01T00:00:00"}, {"EventId": 3, "EventBodyName": "Board", "EventDate": "soon"},
        {"EventId": 4, "EventBodyName": "Board", "EventDate": "2024-05-01T00:00:00", "EventComment": "CANCELLED"},
    ]
    rows = spark.createDataFrame([(json.dumps(events),), (None,), ("not json",)], "json string")
    got = sorted(civic.api_meetings(rows, "2024-01-01").collect())
    assert [(r.meeting_id, r.held_on, r.cancelled, r.media_url) for r in got] == [(1, dt.date(2024, 3, 4), False, "77"), (4, dt.date(2024, 5, 1), True, None)]
    assert sorted(tuple(r) for r in civic.api_documents(rows).collect()) == [(1, "agenda", "a.pdf"), (1, "staff_report", "r.pdf")]


def test_portal_answers_in_both_shapes(spark):
    m = {"id": "9", "title": "T", "date": "2024-02-01", "agendaUrl": "a", "packetUrl": "p"}
    rows = spark.createDataFrame([(json.dumps([m]),), (json.dumps({"meetings": [m]}),)], "json string")
    assert sorted((r.kind, r.url) for r in civic.portal_meetings(rows, "2024-01-01").collect()) == [("agenda", "a"), ("agenda", "a"), ("packet", "p"), ("packet", "p")]


def test_archive_rows(spark):
    html = "<table><tr><th>Body</th></tr><tr><td>Board</td><td>March 4, 2024</td><td><a href='x.pdf'>m</a></td></tr><tr><td>Board</td><td>3/4/2024</td></tr><tr><td>Old</td><td>1/1/1999</td></tr></table>"
    got = civic.archive_rows(spark.createDataFrame([(html,), (None,)], "html string"), "2020-01-01").collect()
    assert [(r.body, r.held_on) for r in got] == [("Board", dt.date(2024, 3, 4))]


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


def test_site_list_in_any_order_with_problems(spark):
    text = '# mine\nMW,County,Use,Name\n"1,200 MW",Loudoun,solar,"A, B"\n-3,Loudoun,solar,x\n5,Nowhere,solar,y\n5,loudoun,castle,z'
    sites, problems = civic.site_list(lines(spark, text), ["Loudoun"], ["solar"])
    assert [(r.label, r.capacity_mw, r.acres) for r in sites.collect()] == [("A, B", 1200.0, None)]
    assert sorted((r.n, r.reason) for r in problems.collect()) == [(3, "capacity is not a positive number"), (4, "unknown county"), (5, "unknown use class")]
    sites, problems = civic.site_list(lines(spark, "A\tLoudoun\tsolar\t10\t\t"), ["Loudoun"], ["solar"])
    assert sites.count() == 1 and problems.count() == 0


def test_ndjson_and_objects(spark, tmp_path):
    civic.write_ndjson(spark.createDataFrame([(1, "x"), (2, None)], "b int, a string"), str(tmp_path / "out"))
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert got == ['{"a":"x","b":1}', '{"b":2}']
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "g.txt").write_bytes(b"hello")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in civic.read_objects(spark, str(tmp_path / "*.*")).collect()}
    assert kinds == {"f.pdf": "pdf", "g.txt": "text"}


REGISTRY = """
jurisdictions:
  - {slug: loudoun, name: Loudoun, fips: 51107, seats: 9, quorum: 5, threshold: majority_present, term_years: 4, stagger_years: 2, deciders: 1}
  - {slug: "Bad One", name: Bad, fips: 5110, seats: 3, quorum: 5, threshold: loudest, term_years: 2, stagger_years: 4, deciders: 2}
  - {slug: twin, name: Twin, fips: 51107, seats: 3}
"""


def test_registry_and_label_files(spark, tmp_path):
    from permrisk.sources import registry

    (tmp_path / "r.yaml").write_text(REGISTRY)
    rows = registry.read_registry(spark, str(tmp_path / "r.yaml"))
    assert rows.count() == 3
    broken = sorted(tuple(r) for r in registry.registry_violations(rows).collect())
    assert broken == sorted([("Bad One", r) for r in ("slug has other characters", "fips is not five digits", "quorum exceeds the seats", "unknown threshold", "stagger exceeds the term", "not one decider")] + [("loudoun", "fips is not unique")])
    labels = [
        {"label_id": "a", "outcome": "denied", "filed_on": "2021-01-01", "decided_on": "2021-03-01", "votes_for": 4, "votes_against": 1, "sources": [{"kind": "primary", "url": "https://x.gov/1"}]},
        {"label_id": "a", "outcome": "approved", "filed_on": "2021-01-01", "votes_for": 4, "votes_against": 1, "sources": [{"kind": "press", "url": "https://x.gov/1"}, {"kind": "press", "url": "https://y.com/1"}]},
        {"label_id": "b", "outcome": "lost", "filed_on": "2021-05-01", "decided_on": "2021-03-01", "sources": [{"kind": "press", "url": "https://x.gov/1"}]},
        {"label_id": "c", "outcome": "pending", "filed_on": "2021-05-01", "sources": [{"kind": "primary", "url": "https://x.gov/1"}]},
    ]
    (tmp_path / "l.json").write_text(json.dumps({"decisions": labels}))
    got = registry.read_labels(spark, str(tmp_path / "l.json"))
    assert sorted(tuple(r) for r in registry.label_violations(got).collect()) == sorted(
        [("a", "tally against the outcome"), ("a", "settled without a date"), ("a", "label_id is not unique"), ("b", "unknown outcome"), ("b", "decided before it was filed"), ("b", "no primary source and not two hosts")]
    )
    graph = spark.createDataFrame([("x", "hand_labelled"), ("y", "extracted")], "label_id string, label_source string")
    assert sorted((r.label_id, r.label_source) for r in registry.reload_labels(graph, got.select("label_id").distinct()).collect()) == [("a", "hand_labelled"), ("b", "hand_labelled"), ("c", "hand_labelled"), ("y", "extracted")]
    (tmp_path / "p.yaml").write_text("platforms:\n- {slug: a, platform: legistar, confidence: 0.9}\n- {slug: b, platform: unknown, confidence: 0}\n")
    assert [r.slug for r in registry.read_platforms(spark, str(tmp_path / "p.yaml")).collect()] == ["a"]
