"""Search and investigation as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import features, investigation, rules, search
from vigil.plans.common import FEATURE_COLUMNS, accepted, detections, scored, sql
from vigil.session import written
from vigil.sources import adapter

QUERIES, SQL = {}, {}
PAGE_BODY = "SELECT event_id, source FROM accepted WHERE {} ORDER BY observed_at DESC, event_id DESC LIMIT 51"


def query(oracle: str | None = None, *needs: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = sql(oracle, *needs)
        return f

    return add


@query(PAGE_BODY.format("source IN ('github', 'okta') AND sensitivity IN ('high', 'critical') AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at <= TIMESTAMP '2024-01-25'"), "accepted")
def event_search_page(spark, d):
    found = search.filtered(accepted(spark, d), sources=["github", "okta"], sensitivities=["high", "critical"], start="2024-01-05 00:00:00", end="2024-01-25 00:00:00")
    return search.page(found, 50).select("event_id", "source")


@query(PAGE_BODY.format("(observed_at, event_id) < (TIMESTAMP '2024-01-20 00:00:00', 'event::x') AND category = 'access'"), "accepted")
def event_search_cursor(spark, d):
    return search.page(search.filtered(accepted(spark, d), categories=["access"]), 50, ("2024-01-20 00:00:00", "event::x")).select("event_id", "source")


@query(f"SELECT event_id FROM accepted WHERE contains(lower({search.SQL_TEXT}), 'user 7 dept')", "accepted")
def event_search_text(spark, d):
    return search.filtered(accepted(spark, d), text="User 7 dept").select("event_id")


@query(f"SELECT event_id FROM accepted WHERE list_has_all(string_split_regex(lower({search.SQL_TEXT}), '[^a-z0-9_]+'), ['github', 'geo3', 'high'])", "accepted")
def event_search_tokens(spark, d):
    return search.filtered(accepted(spark, d), tokens=["GitHub", "geo3", "high"]).select("event_id")


@query("SELECT event_id FROM accepted WHERE actor_email = 'user7@example.com' AND resource_name = 'res3'", "accepted")
def event_search_references(spark, d):
    return search.filtered(accepted(spark, d), principal="user7@example.com", resource="res3").select("event_id")


@query("SELECT event_id, sensitivity FROM accepted WHERE sensitivity IN ('critical', 'high') ORDER BY CASE sensitivity WHEN 'critical' THEN 4 ELSE 3 END DESC, event_id", "accepted")
def event_table_sort(spark, d):
    return search.sorted_by(search.filtered(accepted(spark, d), sensitivities=["critical", "high"]), "sensitivity").select("event_id", "sensitivity")


@query(f"SELECT event_id, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS observed_at, 'entity::' || principal_key AS principal_entity_id, floor(epoch(observed_at))::BIGINT AS observed_epoch, {search.SQL_TEXT} AS search_text FROM accepted", "accepted")
def search_documents(spark, d):
    return search.documents(accepted(spark, d)).select("event_id", "observed_at", "principal_entity_id", "observed_epoch", "search_text")


@query("SELECT actor_email, place, event_id FROM (SELECT *, row_number() OVER (PARTITION BY actor_email ORDER BY observed_at DESC, event_id DESC) AS place FROM accepted) WHERE place <= 5", "accepted")
def entity_timeline(spark, d):
    return search.timeline(accepted(spark, d), 5).select("actor_email", "place", "event_id")


@query("SELECT actor_email, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS events, count(DISTINCT source) AS sources, count(DISTINCT resource_id) AS resources, count(*) FILTER (sensitivity IN ('high', 'critical')) AS high_sensitivity, arg_max(event_id, (observed_at, event_id)) AS anchor_event FROM accepted GROUP BY actor_email", "accepted")
def entity_overview(spark, d):
    return investigation.entity_overview(accepted(spark, d))


_RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@query(
    f"""SELECT scenario, detection_id, place, group_place FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY {_RANK} DESC, score DESC, confidence DESC, title, detection_id) AS place FROM detections)
  JOIN (SELECT scenario, row_number() OVER (ORDER BY {_RANK} DESC, score DESC, confidence DESC, title, scenario) AS group_place FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY {_RANK} DESC, score DESC, confidence DESC, title, detection_id) AS p FROM detections) WHERE p = 1) USING (scenario)""",
    "detections",
)
def detection_queue(spark, d):
    return investigation.queue(detections(spark, d), "scenario").select("scenario", "detection_id", "place", "group_place")


@query("SELECT detection_id FROM detections WHERE severity = 'high' AND source IN ('github', 'okta') AND (contains(lower(title), 'geog') OR contains(lower(scenario), 'geog') OR contains(lower(principal_id), 'geog') OR contains(source, 'geog') OR len(list_filter(reasons, lambda r: contains(lower(r), 'geog'))) > 0)", "detections")
def detection_queue_filter(spark, d):
    return investigation.queue_filter(detections(spark, d), text="Geog", severity=["high"], source=["github", "okta"]).select("detection_id")


@query("SELECT detection_id FROM (SELECT d.*, CASE WHEN score >= 0.9 THEN 'closed' ELSE 'open' END AS s FROM detections d) WHERE s = 'open' ORDER BY observed_at DESC, detection_id DESC LIMIT 20 OFFSET 10", "detections")
def open_detection_page(spark, d):
    found = detections(spark, d)
    state = found.where("score >= 0.9").select("detection_id", F.lit("closed").alias("status"))
    return investigation.open_page(investigation.with_state(found, state), 10, 20).select("detection_id")


@query(" UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM detections GROUP BY ALL" for c in investigation.FACETS), "detections")
def queue_facets(spark, d):
    return investigation.facets(detections(spark, d))


@query("SELECT reason, source, n, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, reason) AS place FROM (SELECT source, reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY ALL)) WHERE place <= 6", "checked")
def top_dead_letter_reasons(spark, d):
    from pyspark.sql import Window

    from vigil.operators import normalize

    counted = normalize.checked(adapter.raw_events(spark, d)).where("reason IS NOT NULL").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "reason"))).where("place <= 6")


@query(
    """SELECT detection_id, place, name, weight FROM (SELECT detection_id, name, weight, row_number() OVER (PARTITION BY detection_id ORDER BY weight DESC, name) - 1 AS place FROM (
    SELECT detection_id, n AS name, CASE n WHEN 'new_action_for_principal' THEN 0.25 WHEN 'new_resource_for_principal' THEN 0.25 WHEN 'peer_group_rarity' THEN 0.15 WHEN 'sensitive_resource' THEN 0.15 WHEN 'privileged_activity' THEN 0.2 WHEN 'high_risk_action' THEN 0.2 WHEN 'external_share' THEN 0.2 WHEN 'new_geo' THEN 0.2 WHEN 'privileged_geo_combo' THEN 0.15 WHEN 'large_query' THEN 0.15 WHEN 'expected_transition' THEN -0.55 WHEN 'approved_travel' THEN -0.55 WHEN 'incident_response' THEN -0.65 WHEN 'finance_close_workflow' THEN -0.6 END::DOUBLE AS weight
    FROM (SELECT detection_id, unnest(attribution_names) AS n FROM detections) UNION ALL SELECT 'det-' || substr(sha256(event_id || ':' || scenario), 1, 12), 'model_distance', score FROM scored WHERE score >= 0.6::DOUBLE)) WHERE place < 3""",
    "detections", "scored",
)
def top_attributions(spark, d):
    return investigation.top_attributions(detections(spark, d))


_CASES = """cases AS (WITH RECURSIVE o AS (SELECT principal_id, detection_id, event_id, severity, observed_at, row_number() OVER (PARTITION BY principal_id ORDER BY observed_at, detection_id) AS i FROM detections),
  w AS (SELECT principal_id, detection_id, event_id, severity, observed_at, i, observed_at AS at, detection_id AS anchor FROM o WHERE i = 1
    UNION ALL SELECT o.principal_id, o.detection_id, o.event_id, o.severity, o.observed_at, o.i, CASE WHEN o.observed_at > w.at + INTERVAL 6 HOUR THEN o.observed_at ELSE w.at END, CASE WHEN o.observed_at > w.at + INTERVAL 6 HOUR THEN o.detection_id ELSE w.anchor END
    FROM w JOIN o ON o.principal_id = w.principal_id AND o.i = w.i + 1) SELECT *, 'case-' || anchor AS case_id FROM w)"""


@query("SELECT principal_id, detection_id, case_id FROM (WITH RECURSIVE " + _CASES + " SELECT * FROM cases)", "detections")
def case_groups(spark, d):
    return investigation.cases(detections(spark, d))


@query("SELECT case_id, principal_id, count(*) AS detections, count(DISTINCT event_id) AS events, arg_min(detection_id, (observed_at, detection_id)) AS primary_detection, max(CASE severity WHEN 'high' THEN 3 ELSE 2 END) AS severity_rank FROM (WITH RECURSIVE " + _CASES + " SELECT * FROM cases) GROUP BY ALL", "detections")
def case_summaries(spark, d):
    found = written(detections(spark, d).select("principal_id", "detection_id", "event_id", "observed_at", "severity"), "detections")
    return investigation.case_summaries(investigation.cases(found), found)


@query("SELECT detection_id, CASE WHEN observed_at < (SELECT max(observed_at) FROM raw) - INTERVAL 20 DAY THEN 'retention_expired' ELSE 'available' END AS state FROM detections", "detections", "raw")
def evidence_state(spark, d):
    from vigil.operators import stats

    raw = adapter.raw_events(spark, d)
    old = stats.expired(raw, 20).select("source", "source_event_id")
    return investigation.evidence(detections(spark, d), raw.join(old, ["source", "source_event_id"], "left_anti"))


@query("SELECT detection_id, n FROM detections JOIN (SELECT actor_email, count(*) AS n FROM accepted GROUP BY actor_email) ON actor_email = principal_id", "detections", "accepted")
def detection_timelines(spark, d):
    found = written(detections(spark, d).select("detection_id", "principal_id"), "detections")
    n = investigation.timelines(found, accepted(spark, d)).groupBy("principal_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, "principal_id").select("detection_id", "n")


def _for_comparison(spark, d):
    """Events for feature tables, the organisation, and scored events, each made once."""
    rows = written(scored(spark, d), "scored")
    return rows.select(*FEATURE_COLUMNS), written(adapter.principals(spark, d), "principals"), rows


@query(
    """WITH n AS (SELECT principal_key, count(DISTINCT peer_key) FILTER (peer_type = 'manager') AS m, count(DISTINCT peer_key) FILTER (peer_type = 'group') AS g FROM (SELECT * FROM manager_peers UNION ALL SELECT * FROM team_peers) GROUP BY ALL),
  s AS (SELECT department, count(*) AS n FROM static GROUP BY ALL), r AS (SELECT resource_key, department, count(DISTINCT a.principal_key) AS n FROM accessors a JOIN static USING (principal_key) GROUP BY ALL)
  SELECT detection_id, t.department, t.role, t.location, t.privilege_level, s.n - 1 AS department_peers, coalesce(m, 0) AS manager_peers, coalesce(g, 0) AS group_peers, coalesce(r.n, 0) AS peer_group_resource_principals
  FROM detections d JOIN static t USING (principal_key) JOIN s ON s.department = t.department LEFT JOIN r ON r.resource_key = d.resource_key AND r.department = t.department LEFT JOIN n ON n.principal_key = d.principal_key""",
    "detections", "static", "accessors", "manager_peers", "team_peers",
)
def peer_comparison(spark, d):
    events, org, found = _for_comparison(spark, d)
    static = written(features.static_profiles(events, org), "static")
    counts = features.peer_counts(static, org, adapter.teams(spark, d))
    return investigation.peer_comparison(rules.detections(found), static, counts, features.access_counts(events))


@query(
    """WITH n AS (SELECT principal_key, count(DISTINCT peer_key) FILTER (peer_type = 'manager') AS m, count(DISTINCT peer_key) FILTER (peer_type = 'group') AS g FROM (SELECT * FROM manager_peers UNION ALL SELECT * FROM team_peers) GROUP BY ALL),
  s AS (SELECT department, count(*) AS n FROM static GROUP BY ALL), r AS (SELECT resource_key, department, count(DISTINCT a.principal_key) AS n FROM accessors a JOIN static USING (principal_key) GROUP BY ALL)
  SELECT d.detection_id, t.department, t.role, t.location, t.privilege_level, s.n - 1 AS department_peers, coalesce(m, 0) AS manager_peers, coalesce(g, 0) AS group_peers,
    coalesce(r.n, 0) AS peer_group_resource_principals, d.principal_id, d.resource_id, array_to_string(d.reasons, ',') AS detection_reasons, s.n AS peer_group_principal_count,
    (SELECT count(*) FROM accepted x WHERE x.principal_key = d.principal_key) AS principal_total_events, e.prior_events AS principal_prior_event_count, e.prior_actions AS principal_prior_action_count,
    e.prior_resource AS principal_prior_resource_access_count, e.peer_resource AS peer_group_resource_access_count, e.geo_seen AS geo_seen_before
  FROM detections d JOIN context e USING (event_id) JOIN static t ON t.principal_key = d.principal_key JOIN s ON s.department = t.department
    LEFT JOIN r ON r.resource_key = d.resource_key AND r.department = t.department LEFT JOIN n ON n.principal_key = d.principal_key""",
    "detections", "static", "accessors", "manager_peers", "team_peers",
)
def peer_comparison_context(spark, d):
    """Peer comparison of every detection with action rows and what was known before its event."""
    events, org, rows = _for_comparison(spark, d)
    static = written(features.static_profiles(events, org), "static")
    counts = features.peer_counts(static, org, adapter.teams(spark, d))
    found = investigation.full_comparison(rules.detections(rows), rows, static, counts, features.access_counts(events))
    return found.withColumn("detection_reasons", F.array_join("detection_reasons", ","))


@query(
    """WITH s AS (SELECT department, count(DISTINCT actor_email) AS n FROM accepted GROUP BY ALL), r AS (SELECT department, resource_id, count(DISTINCT actor_email) AS n, count(*) AS k FROM accepted GROUP BY ALL)
  SELECT detection_id, s.n AS department_principals, r.n AS resource_principals, r.k AS resource_events FROM detections d JOIN accepted a USING (event_id) JOIN s ON s.department = a.department JOIN r ON r.department = a.department AND r.resource_id = a.resource_id""",
    "detections", "accepted",
)
def department_scan(spark, d):
    rows = written(scored(spark, d).select("event_id", "scenario", "score", "actor_email", "department", "resource_id"), "scored")
    found = rows.where(F.col("score") >= rules.MEDIUM).select(rules.detection_id(F.col("event_id"), F.col("scenario")).alias("detection_id"), "event_id")
    return investigation.department_scan(found, rows)


@query("SELECT event_id, source, verb, category, sensitivity, dt FROM accepted", "accepted")
def redacted_events(spark, d):
    return investigation.redacted(accepted(spark, d))


@query("SELECT count(*) FILTER (a AND b) AS \"both\", count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (b AND NOT a) AS right_only FROM (SELECT score >= 0.6::DOUBLE AS a, score >= 0.5::DOUBLE AND prior_events >= 10 AS b FROM scored)", "scored")
def mode_comparison(spark, d):
    from vigil.operators import rules
    from vigil.plans.common import scored

    rows = scored(spark, d)
    return investigation.compare(rules.detections(rows), rules.detections(rows.where("prior_events >= 10"), threshold=0.5))


@query(
    """WITH x AS (SELECT event_id, observed_at, score >= 0.6::DOUBLE AS a, score >= 0.5::DOUBLE AND prior_events >= 10 AS b FROM scored)
  SELECT side, place, event_id FROM (SELECT CASE WHEN a THEN 'left' ELSE 'right' END AS side, event_id, row_number() OVER (PARTITION BY a ORDER BY observed_at, event_id) AS place FROM x WHERE a <> b) WHERE place <= 10""",
    "scored",
)
def divergence_samples(spark, d):
    from vigil.operators import rules
    from vigil.plans.common import scored

    rows = scored(spark, d)
    return investigation.divergence_samples(rules.detections(rows), rules.detections(rows.where("prior_events >= 10"), threshold=0.5))
