"""Change detection, materiality, fan-out and the delivery queue."""

from __future__ import annotations

from permrisk.plans.graph import query

SINCE = "TIMESTAMP '2024-01-20 00:00:00'"
BASE = "CASE trigger_kind WHEN 'rule_changed' THEN 0.85 WHEN 'moratorium_on_agenda' THEN 0.90 WHEN 'moratorium_enacted' THEN 0.95 WHEN 'comparable_denied_nearby' THEN 0.60 WHEN 'litigation_filed' THEN 0.50 WHEN 'source_stale' THEN 0.25 END"


def _detected(d):
    """Three detectors: changes known since a day in watched counties, denials nearby, counties with stale sources."""
    age = d.seconds("TIMESTAMP '2024-01-31 00:00:00'", "last_success")
    return f"""
    watched AS (SELECT DISTINCT county_id FROM watch),
    found AS (
        SELECT c.county_id, c.trigger_kind, c.event_id AS subject_id FROM change c JOIN watched w ON w.county_id = c.county_id WHERE c.trigger_kind IS NOT NULL AND c.known_from >= {SINCE}
        UNION ALL
        SELECT DISTINCT w.county_id, 'comparable_denied_nearby', a.application_id FROM watched w JOIN county x ON x.county_id = w.county_id
            JOIN county y ON abs(x.cx - y.cx) <= 1 AND abs(x.cy - y.cy) <= 1 AND x.county_id <> y.county_id AND (x.cx - y.cx) * (x.cx - y.cx) + (x.cy - y.cy) * (x.cy - y.cy) <= 1
            JOIN application a ON a.county_id = y.county_id AND a.outcome = 'denied' AND a.decided_on >= DATE '2001-06-01'
        UNION ALL
        SELECT county_id, 'source_stale', -1 FROM source GROUP BY county_id HAVING min({age} / 86400) > 1 OR min({age} / 86400) IS NULL)"""


def detect_changes(d):
    return f"WITH {_detected(d).strip()} SELECT county_id, trigger_kind, subject_id FROM found"


def alerts(d):
    """One alert for each watch and change; sites of a subscriber raise the stakes; quiet ones keep their reason."""
    return f"""
    WITH {_detected(d).strip()},
    held AS (SELECT watch_id, subscriber_id, county_id, count(*) OVER (PARTITION BY subscriber_id) AS sites FROM watch),
    priced AS (
        SELECT DISTINCT h.watch_id, h.subscriber_id, f.county_id, f.trigger_kind, f.subject_id, least(1.0, {BASE} + CASE WHEN h.sites > 1 THEN least(h.sites / 20.0, 0.10) ELSE 0.0 END) AS materiality
        FROM found f JOIN held h ON h.county_id = f.county_id)
    SELECT watch_id, subscriber_id, county_id, trigger_kind, subject_id, round(materiality, 6) AS materiality, materiality < 0.35 AS suppressed FROM priced"""


def delivery_queue(d):
    """The next twenty of each subscriber by materiality; those tried five times wait for a person."""
    return f"""
    WITH {_detected(d).strip()},
    due AS (SELECT DISTINCT w.subscriber_id, w.watch_id, f.trigger_kind, f.subject_id, {BASE} AS materiality, f.subject_id % 7 AS attempts FROM found f JOIN watch w ON w.county_id = f.county_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY subscriber_id ORDER BY materiality DESC, subject_id, watch_id, trigger_kind) AS place FROM due WHERE attempts < 5 AND materiality >= 0.35)
    SELECT subscriber_id, watch_id, trigger_kind, subject_id, CAST(place AS INT) AS place FROM ranked WHERE place <= 20"""


def _alerts(d):
    """As :func:`alerts`: a watch is one row, so changes that differ make alerts that differ, and only the changes need to be told apart, not the alerts.

    Changes are few and their alerts many, so Spark is asked not to merge them into a task or two.
    """
    return f"""
    WITH {_detected(d).strip()},
    told AS (SELECT /*+ REPARTITION(256, county_id, trigger_kind, subject_id) */ DISTINCT county_id, trigger_kind, subject_id FROM found),
    sites AS (SELECT subscriber_id, count(*) AS sites FROM watch GROUP BY subscriber_id),
    held AS (SELECT w.watch_id, w.subscriber_id, w.county_id, s.sites FROM watch w JOIN sites s ON s.subscriber_id = w.subscriber_id),
    priced AS (SELECT h.watch_id, h.subscriber_id, f.county_id, f.trigger_kind, f.subject_id, least(1.0, {BASE} + CASE WHEN h.sites > 1 THEN least(h.sites / 20.0, 0.10) ELSE 0.0 END) AS materiality FROM told f JOIN held h ON h.county_id = f.county_id)
    SELECT watch_id, subscriber_id, county_id, trigger_kind, subject_id, round(materiality, 6) AS materiality, materiality < 0.35 AS suppressed FROM priced"""


def _delivery_queue(d):
    """As :func:`delivery_queue`: of one watch, none but the first twenty changes of its county can be among a subscriber's first twenty."""
    return f"""
    WITH {_detected(d).strip()},
    told AS (SELECT DISTINCT county_id, trigger_kind, subject_id, {BASE} AS materiality, subject_id % 7 AS attempts FROM found),
    first_of AS (SELECT *, row_number() OVER (PARTITION BY county_id ORDER BY materiality DESC, subject_id, trigger_kind) AS i FROM told WHERE attempts < 5 AND materiality >= 0.35),
    due AS (SELECT w.subscriber_id, w.watch_id, f.trigger_kind, f.subject_id, f.materiality FROM first_of f JOIN watch w ON w.county_id = f.county_id WHERE f.i <= 20),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY subscriber_id ORDER BY materiality DESC, subject_id, watch_id, trigger_kind) AS place FROM due)
    SELECT subscriber_id, watch_id, trigger_kind, subject_id, CAST(place AS INT) AS place FROM ranked WHERE place <= 20"""


def delivery_health(d):
    age = d.seconds("TIMESTAMP '2024-02-03 00:00:00'", "known_from")
    return f"""
    WITH sent AS (SELECT *, event_id % 5 = 0 AS pending, event_id % 7 AS attempts FROM change WHERE trigger_kind IS NOT NULL)
    SELECT trigger_kind, count(*) AS alerts, count(*) FILTER (WHERE pending) AS pending, count(*) FILTER (WHERE pending AND attempts >= 5) AS abandoned, round(max(CASE WHEN pending THEN {age} / 3600 END), 6) AS oldest_pending_hours
    FROM sent GROUP BY trigger_kind"""


def dead_letters(d):
    """Failures folded by subject: first and latest time, attempts, reopened if one came after the last success."""
    return """
    SELECT user_id AS subject, count(*) FILTER (WHERE event_type = 'error') AS attempts, min(CASE WHEN event_type = 'error' THEN ts END) AS first_on, max(CASE WHEN event_type = 'error' THEN ts END) AS latest_on,
           coalesce(max(CASE WHEN event_type = 'error' THEN ts END) > max(CASE WHEN event_type = 'view' THEN ts END), true) AS open
    FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') > 0"""


def attempt_counters(d):
    """Success and failure counters of each source, and the run of failures since its last success."""
    return """
    WITH tried AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed FROM events WHERE event_type IN ('error', 'view')),
    grouped AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM tried)
    SELECT user_id AS source_id, count(*) FILTER (WHERE NOT failed) AS successes, count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE failed AND since = 0) AS failures_in_a_row FROM grouped GROUP BY user_id"""


def verification_rate(d):
    return """
    SELECT application_id % 10 AS batch, count(*) AS quotes, count(*) FILTER (WHERE verified) AS verified, round(CAST(count(*) FILTER (WHERE verified) AS DOUBLE) / nullif(count(*), 0), 6) AS rate,
           CAST(count(*) FILTER (WHERE verified) AS DOUBLE) / nullif(count(*), 0) >= 0.99 AS safe FROM evidence GROUP BY application_id % 10"""


def event_log(d):
    """Filing and decision of each application as dated events, known no earlier than they occurred."""
    return f"""
    SELECT application_id, 'application_filed' AS event_type, filed_on AS occurred_on, {d.add_days('filed_on', 'application_id % 5')} AS known_from FROM application
    UNION ALL SELECT application_id, 'decision_rendered', decided_on, {d.add_days('decided_on', 'application_id % 3')} FROM application WHERE decided_on IS NOT NULL"""


def stale_features(d):
    """Applications without a feature snapshot (those of even id have one)."""
    return """
    WITH snapshot AS (SELECT application_id FROM application WHERE application_id % 2 = 0)
    SELECT a.application_id FROM application a WHERE NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.application_id = a.application_id)"""


QUERIES = {f"monitor_{f.__name__}": query(f) for f in (detect_changes, alerts, delivery_queue, delivery_health, dead_letters, attempt_counters, verification_rate, event_log, stale_features)}
# the oracles keep the plain statements
QUERIES |= {"monitor_alerts": (query(_alerts)[0], query(alerts)[1]), "monitor_delivery_queue": (query(_delivery_queue)[0], query(delivery_queue)[1])}
