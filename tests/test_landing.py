"""Answers held to their schema, one broken rule at a time, and landed in batches that may be repeated."""

import copy
import json
import uuid

import pytest
from pyspark.sql import functions as F

from permrisk.functions import contract
from permrisk.sources import landing
from permrisk.sources.scratch import scratch_dir

SCHEMA = landing.decision_schema(["decision", "hearing"], ["board"], ["solar", "wind"], ["rezoning", "other"], ["approved", "denied", "pending"], ["noise", "water"])
TEXT = "The Board  voted 4-1 to approve case “SUP-7”.\nTwelve residents spoke about noise and water."
ITEM = {
    "event_type": "decision", "outcome": "approved", "confidence": 0.9, "evidence": [{"page": 1, "quote": "voted 4-1 to approve case \"SUP-7\""}], "body": "board", "use_class": "solar", "staff_recommendation": None, "case_number": "SUP-7",
    "applicant": "Sun LLC", "project_name": None, "vote": "4-1", "filed_on": "2024-02-29", "decided_on": None, "acres": 10, "capacity_mw": 2.5, "relief_sought": ["rezoning"], "objection_grounds": ["noise"], "conditions": [], "organised_opposition": True, "speakers_against": 12,
}
BREAKS = [
    ({"event_type": "party"}, "$.items[].event_type: not one of the allowed values"), ({"outcome": None}, "$.items[].outcome: not one of the allowed values"), ({"confidence": 1.5}, "$.items[].confidence: above 1"), ({"confidence": -0.1}, "$.items[].confidence: below 0"),
    ({"confidence": "high"}, "$.items[].confidence: not of type number"), ({"evidence": []}, "$.items[].evidence: fewer than 1 items"), ({"evidence": ITEM["evidence"] * 7}, "$.items[].evidence: more than 6 items"),
    ({"evidence": [{"page": 0, "quote": "long enough here"}]}, "$.items[].evidence[].page: below 1"), ({"evidence": [{"page": 1.5, "quote": "long enough here"}]}, "$.items[].evidence[].page: not of type integer"), ({"evidence": [{"page": 1, "quote": "short"}]}, "$.items[].evidence[].quote: shorter than 10"),
    ({"evidence": [{"page": 1, "quote": "x" * 501}]}, "$.items[].evidence[].quote: longer than 500"), ({"evidence": [{"page": 1}]}, "$.items[].evidence[]: quote is missing"), ({"evidence": [{"page": 1, "quote": "long enough here", "line": 3}]}, "$.items[].evidence[]: unknown member line"),
    ({"body": "club"}, "$.items[].body: not one of the allowed values"), ({"use_class": "oil"}, "$.items[].use_class: not one of the allowed values"), ({"staff_recommendation": "maybe"}, "$.items[].staff_recommendation: not one of the allowed values"),
    ({"case_number": "x" * 81}, "$.items[].case_number: longer than 80"), ({"case_number": 7}, "$.items[].case_number: not of type string or null"), ({"applicant": "x" * 301}, "$.items[].applicant: longer than 300"), ({"vote": "unanimous"}, "$.items[].vote: not of the pattern"),
    ({"filed_on": "2023-02-29"}, "$.items[].filed_on: not a date"), ({"decided_on": "1 May 2024"}, "$.items[].decided_on: not a date"), ({"acres": 0}, "$.items[].acres: not above 0"), ({"capacity_mw": -1}, "$.items[].capacity_mw: not above 0"),
    ({"relief_sought": ["magic"]}, "$.items[].relief_sought[]: not one of the allowed values"), ({"relief_sought": ["other"] * 9}, "$.items[].relief_sought: more than 8 items"), ({"relief_sought": "other"}, "$.items[].relief_sought: not of type array"),
    ({"objection_grounds": ["smell"]}, "$.items[].objection_grounds[]: not one of the allowed values"), ({"conditions": ["x" * 501]}, "$.items[].conditions[]: longer than 500"), ({"organised_opposition": "yes"}, "$.items[].organised_opposition: not of type boolean or null"),
    ({"speakers_against": -1}, "$.items[].speakers_against: below 0"), ({"speakers_against": 1.5}, "$.items[].speakers_against: not of type integer or null"), ({"mood": "good"}, "$.items[]: unknown member mood"),
]


def answers(spark, rows):
    return spark.createDataFrame([(str(d), c, t, a if a is None or isinstance(a, str) else json.dumps({"items": a})) for d, c, t, a in rows], "document_id string, county_id int, text string, answer string")


def told(spark, rows):
    return {(r.document_id, r.position): (r.status, r.problems) for r in landing.judged(answers(spark, rows), SCHEMA).collect()}


def test_each_rule_broken_once(spark):
    missing = [({k: v for k, v in ITEM.items() if k != name}, f"$.items[]: {name} is missing") for name in ("event_type", "outcome", "confidence", "evidence")]
    broken = [({**ITEM, **change}, message) for change, message in BREAKS] + missing
    got = told(spark, [(k, 1, TEXT, [item]) for k, (item, _) in enumerate(broken)])
    for k, (_, message) in enumerate(broken):
        assert got[str(k), 0] == ("schema_violation", [message])
    got = told(spark, [("no json", 1, TEXT, "{"), ("list", 1, TEXT, "[]"), ("bare", 1, TEXT, "{}"), ("none", 1, TEXT, None), ("empty", 1, TEXT, []), ("two", 1, TEXT, [ITEM, {**ITEM, "outcome": "x"}])])
    assert got == {("no json", 0): ("schema_violation", ["$: not JSON"]), ("list", 0): ("schema_violation", ["$: not of type object"]), ("bare", 0): ("schema_violation", ["$: items is missing"]), ("two", 0): ("schema_violation", ["$.items[].outcome: not one of the allowed values"])}


def test_unknown_keywords_are_refused():
    for schema in ({"oneOf": []}, {"type": "object", "properties": {"a": {"format": "uri"}}}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            contract.errors(F.lit(None).cast("variant"), schema)


def test_quotes_confidence_and_use(spark):
    item = lambda **k: {**ITEM, **k}
    lost = [{"page": 1, "quote": "voted 5-0 to approve"}]
    got = told(spark, [
        (1, 1, TEXT, [ITEM, item(evidence=ITEM["evidence"] + lost), item(confidence=0.59), item(confidence=0.6), item(use_class=None), item(evidence=lost, confidence=0.1)]), (2, 1, None, [ITEM]), (3, 1, "", [ITEM]),
    ])
    assert [got["1", k][0] for k in range(6)] == ["landed", "quote_failed", "review", "landed", "event_only", "quote_failed"]
    assert got["2", 0][0] == got["3", 0][0] == "quote_failed"


def state(spark, store):
    return {name: sorted(map(repr, landing.table(spark, store, name).select("*").collect())) for name in ("applications", "evidence", "review", "runs")}


def test_landing_twice_changes_nothing_and_later_items_tell_the_outcome(spark):
    store = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    late = {**copy.deepcopy(ITEM), "outcome": "denied", "vote": "2-3", "applicant": "Moon LLC"}
    first = answers(spark, [("d1", 1, TEXT, [ITEM, {**ITEM, "confidence": 0.2}]), ("d2", 2, TEXT, [{**ITEM, "case_number": None, "project_name": "Field"}]), ("d3", 1, TEXT, "broken"), ("d4", 3, TEXT, [])])
    landing.land(first, SCHEMA, store)
    one = state(spark, store)
    landing.land(first, SCHEMA, store)
    assert state(spark, store) == one
    rows = {(r.county_id, r.external_id): r for r in landing.table(spark, store, "applications").collect()}
    assert set(rows) == {(1, "SUP-7"), (2, "extracted:d2:Field")} and rows[1, "SUP-7"].outcome == "approved" and (rows[1, "SUP-7"].vote_for, rows[1, "SUP-7"].vote_against) == (4, 1)
    assert {r.document_id: (r.status, r.landed, r.discarded) for r in landing.table(spark, store, "runs").collect()} == {"d1": ("ok", 1, 0), "d2": ("ok", 1, 0), "d3": ("schema_violation", 0, 0), "d4": ("ok", 0, 0)}
    assert [r.document_id for r in landing.table(spark, store, "review").collect()] == ["d1"]
    landing.land(answers(spark, [("d5", 1, TEXT, [late]), ("d1", 1, TEXT, [late])]), SCHEMA, store)
    rows = {(r.county_id, r.external_id): r for r in landing.table(spark, store, "applications").collect()}
    got = rows[1, "SUP-7"]
    assert (got.outcome, got.vote_for, got.vote_against, got.applicant, got.document_id) == ("denied", 2, 3, "Sun LLC", "d1") and rows[2, "extracted:d2:Field"].outcome == "approved"
    assert sorted(r.document_id for r in landing.table(spark, store, "evidence").collect()) == ["d1", "d2", "d5"]


def test_a_batch_that_broke_off_is_landed_again(spark, monkeypatch):
    whole, store = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}", f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    batch = answers(spark, [("d1", 1, TEXT, [ITEM, {**ITEM, "confidence": 0.2}]), ("d2", 2, TEXT, [ITEM])])
    landing.land(batch, SCHEMA, whole)
    own, calls = landing._replaced, []

    def breaks(held, rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return own(held, rows)

    monkeypatch.setattr(landing, "_replaced", breaks)
    with pytest.raises(RuntimeError):
        landing.land(batch, SCHEMA, store)
    monkeypatch.setattr(landing, "_replaced", own)
    landing.land(batch, SCHEMA, store)
    assert state(spark, store) == state(spark, whole)


def test_rules_are_written_out_once(spark):
    """Each value stands in the expression once, and the plan evaluates the rules in one place."""
    assert len(str(contract.errors(F.col("v"), SCHEMA))) < 100_000
    plan = landing.judged(answers(spark, [("a", 1, TEXT, [ITEM])]), SCHEMA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$.items[].acres: not above 0") == 1
