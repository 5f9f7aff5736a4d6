"""Registry lookups, set rules on evidence, relabelling, and small public endpoints."""

from __future__ import annotations

from permrisk.plans.graph import query


def summary(d):
    """Each county with its members, elections, sources and instruments."""
    return """
    SELECT c.county_id, c.name, coalesce(m.n, 0) AS members, coalesce(e.n, 0) AS elections, coalesce(s.n, 0) AS sources, coalesce(i.n, 0) AS instruments
    FROM county c LEFT JOIN (SELECT county_id, count(*) AS n FROM member GROUP BY county_id) m ON m.county_id = c.county_id LEFT JOIN (SELECT county_id, count(*) AS n FROM election GROUP BY county_id) e ON e.county_id = c.county_id
    LEFT JOIN (SELECT county_id, count(*) AS n FROM source GROUP BY county_id) s ON s.county_id = c.county_id LEFT JOIN (SELECT county_id, count(*) AS n FROM instrument GROUP BY county_id) i ON i.county_id = c.county_id"""


def search(d):
    """Counties by a part of name, region or framework: at least two letters, the first eight of each query, never fuzzy."""
    return """
    WITH asked AS (SELECT 'an' AS q UNION ALL SELECT 'home' UNION ALL SELECT 'x' UNION ALL SELECT 'zz' UNION ALL SELECT '1'),
    hit AS (SELECT a.q, c.county_id, row_number() OVER (PARTITION BY a.q ORDER BY c.name, c.county_id) AS place FROM asked a JOIN county c ON length(a.q) >= 2 AND
            (lower(c.name) LIKE '%' || a.q || '%' OR coalesce(c.framework, '') LIKE '%' || a.q || '%'))
    SELECT q, county_id, CAST(place AS INT) AS place FROM hit WHERE place <= 8"""


def map_opacity(d):
    """Depth of record to opacity, linear between fixed points; no record counts as none."""
    return f"""
    WITH depth AS (SELECT c.county_id, coalesce(x.n, 0) AS n FROM county c LEFT JOIN (SELECT county_id, count(*) % 120 AS n FROM application GROUP BY county_id) x ON x.county_id = c.county_id)
    SELECT county_id, n, round(CASE WHEN n <= 5 THEN 0.12 + n / 5.0 * 0.12 WHEN n <= 25 THEN 0.24 + (n - 5) / 20.0 * 0.12 WHEN n <= 100 THEN 0.36 + (n - 25) / 75.0 * 0.12 ELSE 0.48 END, 6) AS opacity FROM depth"""


def zoning(d):
    return f"""
    SELECT p_type, count(*) AS parcels, count(*) FILTER (WHERE {d.matches('lower(p_name)', '(^| )(ring|bolt)s?( |$)')}) AS residential, count(*) FILTER (WHERE {d.matches('lower(p_name)', '^(red|blue)')}) AS coloured FROM part GROUP BY p_type"""


def member_match(d):
    """A name resolves by the body and the last part of the name, and only if one member fits."""
    return """
    WITH named AS (SELECT member_id, county_id, substring(name, 17, 2) AS surname FROM member),
    asked AS (SELECT DISTINCT county_id, surname FROM named),
    fit AS (SELECT a.county_id, a.surname, count(*) AS n, min(n.member_id) AS member_id FROM asked a JOIN named n ON n.county_id = a.county_id AND n.surname = a.surname GROUP BY a.county_id, a.surname)
    SELECT county_id, surname, CASE WHEN n = 1 THEN member_id END AS member_id, n FROM fit"""


def dataset_hash(d):
    """A hash of the rows in order, by county: any change of a row or of the order shows."""
    text = "STRING" if d.name == "spark" else "VARCHAR"
    return f"""
    SELECT county_id, count(*) AS n, {d.sha(d.joined(f"md5(CAST(application_id AS {text}) || '|' || outcome || '|' || use_class)", 'application_id'))} AS hash FROM application GROUP BY county_id"""


def daily_roots(d):
    return """
    SELECT decided_on AS day, max(application_id) AS last_seq, count(*) AS n, max_by(outcome, application_id) AS last_outcome FROM application WHERE decided_on IS NOT NULL GROUP BY decided_on"""


def structural_clusters(d):
    """Framework and band of discretion; clusters of one are joined to the largest of their framework."""
    return f"""
    WITH used AS (SELECT a.county_id, avg(CASE WHEN {d.overlap('r.relief', d.array("'A'"))} > 0 THEN 1.0 ELSE 0.0 END) AS share FROM application a JOIN relief r ON r.application_id = a.application_id GROUP BY a.county_id),
    banded AS (SELECT c.county_id, coalesce(c.framework, 'unknown') AS framework, CASE WHEN u.share >= 0.75 THEN 'high' WHEN u.share >= 0.72 THEN 'middle' ELSE 'low' END AS band FROM county c LEFT JOIN used u ON u.county_id = c.county_id),
    sized AS (SELECT framework, band, count(*) AS n FROM banded GROUP BY framework, band),
    best AS (SELECT framework, band, row_number() OVER (PARTITION BY framework ORDER BY n DESC, band) AS rn FROM sized)
    SELECT b.county_id, b.framework || ' ' || CASE WHEN s.n = 1 THEN x.band ELSE b.band END AS cluster FROM banded b JOIN sized s ON s.framework = b.framework AND s.band = b.band JOIN best x ON x.framework = b.framework AND x.rn = 1"""


def label_ids(d):
    """Suggested ids from names, with a number behind those already taken."""
    return f"""
    WITH base AS (SELECT p_partkey, {d.replace('lower(p_name)', '[^a-z0-9]+', '-')} AS slug FROM part),
    placed AS (SELECT p_partkey, slug, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM base)
    SELECT p_partkey, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS label_id FROM placed"""


def recalibrated(d):
    """Interval bounds through a calibration map, sorted, and widened to hold the probability."""
    f = lambda x: f"1 / (1 + exp(-(0.8 * ln(greatest(0.000001, least(0.999999, CAST({x} AS DOUBLE))) / (1 - greatest(0.000001, least(0.999999, CAST({x} AS DOUBLE))))) + 0.1)))"
    return f"""
    WITH mapped AS (SELECT doc_id, {f('p')} AS p, {f('lo')} AS a, {f('hi')} AS b FROM scored)
    SELECT doc_id, round(p, 6) AS p, round(least(a, b, p), 6) AS low, round(greatest(a, b, p), 6) AS high FROM mapped"""


def facts_supported(d):
    """A fact stands only if it has evidence and all of it is verified."""
    return """
    SELECT a.application_id, count(e.evidence_id) AS citations, coalesce(bool_and(e.verified), false) AS supported FROM application a LEFT JOIN evidence e ON e.application_id = a.application_id GROUP BY a.application_id"""


def second_pass(d):
    """Rows of a first reading that a second one does not confirm."""
    return """
    WITH first_one AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS finding FROM lineitem), second_one AS (SELECT DISTINCT l_orderkey AS id, l_returnflag AS finding FROM lineitem WHERE l_linenumber <= 2)
    SELECT f.id, f.finding FROM first_one f WHERE NOT EXISTS (SELECT 1 FROM second_one s WHERE s.id = f.id AND s.finding = f.finding)"""


def merged_clusters(d):
    """Applications after clusters were merged: the audit's survivors take over, everything else stays."""
    return """
    WITH audit AS (SELECT c_custkey AS loser, c_custkey - 1 AS winner FROM customer WHERE c_custkey % 20 = 5), reversed AS (SELECT loser FROM audit WHERE loser % 40 = 5)
    SELECT coalesce(m.winner, a.applicant_id) AS cluster_id, count(*) AS applications FROM application a LEFT JOIN (SELECT * FROM audit WHERE loser NOT IN (SELECT loser FROM reversed)) m ON m.loser = a.applicant_id GROUP BY 1"""


def request_metrics(d):
    """Requests by route and status in text exposition form."""
    text = "STRING" if d.name == "spark" else "VARCHAR"
    return f"""
    SELECT event_type, count(*) AS n, 'requests_total{{route="' || event_type || '"}} ' || CAST(count(*) AS {text}) AS line FROM events GROUP BY event_type"""


def neighbours(d):
    """The twelve nearest counties."""
    return """
    WITH ranked AS (SELECT a.county_id, b.county_id AS other_id, (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) AS d2,
                           row_number() OVER (PARTITION BY a.county_id ORDER BY (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy), b.county_id) AS place FROM county a JOIN county b ON a.county_id <> b.county_id)
    SELECT county_id, other_id, CAST(d2 AS BIGINT) AS d2, CAST(place AS INT) AS place FROM ranked WHERE place <= 12"""


def props(d):
    """A key of the JSON payload: present, extracted and cast."""
    return f"""
    SELECT event_type, count(*) FILTER (WHERE {d.json('props', 'k')} IS NOT NULL) AS with_key, count(*) FILTER (WHERE {d.json('props', 'absent')} IS NOT NULL) AS with_absent, CAST(sum(CAST({d.json('props', 'k')} AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type"""


QUERIES = {
    f"registry_{f.__name__}": query(f)
    for f in (summary, search, map_opacity, zoning, member_match, dataset_hash, daily_roots, structural_clusters, label_ids, recalibrated, facts_supported, second_pass, merged_clusters, request_metrics, neighbours, props)
}
