"""Additive detection rules, their fusion, and detections.

Rules are data: a name for the attribution, a reason, a weight and a condition. They are added in the
given order in double arithmetic, group by group, which the thresholds depend on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.keys import detection_id
from vigil.functions.scalars import rounded

MEDIUM, HIGH, TOP = 0.60, 0.80, 0.99
MODEL_VERSION = "rules-heuristics-fusion-v1"
_NEW_GEO = "source = 'okta' AND prior_events >= 3 AND prior_geos > 0 AND NOT geo_seen"


@dataclass(frozen=True)
class Rule:
    group: str
    name: str
    reason: str
    weight: float
    when: str  # a condition that Spark and DuckDB read alike


#: Weights, reasons and conditions.
RULES = (
    Rule("novelty", "new_action_for_principal", "principal_has_not_performed_this_action_before", 0.25, "prior_events >= 3 AND prior_actions = 0"),
    Rule("novelty", "new_resource_for_principal", "principal_has_not_accessed_this_resource_before", 0.25, "prior_events >= 3 AND prior_resource = 0"),
    Rule("peers", "peer_group_rarity", "resource_is_rare_for_peer_group", 0.15, "peer_resource = 0 AND prior_events >= 3"),
    Rule("sensitivity", "sensitive_resource", "resource_is_sensitive", 0.15, "sensitivity IN ('high', 'critical')"),
    Rule("sensitivity", "privileged_activity", "privileged_identity_activity", 0.2, "privileged"),
    Rule("sensitivity", "high_risk_action", "action_has_exfiltration_characteristics", 0.2, "verb IN ('clone', 'archive_download', 'share_external', 'export')"),
    Rule("sensitivity", "external_share", "resource_shared_externally", 0.2, "external"),
    Rule("geography", "new_geo", "login_from_unfamiliar_geography", 0.2, _NEW_GEO),
    Rule("geography", "privileged_geo_combo", "privileged_login_combines_unfamiliar_geo_and_sensitive_access", 0.15, f"{_NEW_GEO} AND privileged"),
    Rule("volume", "large_query", "large_sensitive_query", 0.15, "source = 'snowflake' AND rows_read >= 100000"),
    Rule("suppression", "expected_transition", "activity_occurs_during_expected_transition_window", -0.55, "(expected_transition OR role_change_window)"),
    Rule("suppression", "approved_travel", "activity_occurs_during_approved_travel", -0.55, "approved_travel"),
    Rule("suppression", "incident_response", "activity_occurs_during_documented_incident_response", -0.65, "incident_response_window AND incident_ticket IS NOT NULL"),
    Rule("suppression", "finance_close_workflow", "activity_occurs_during_approved_finance_close_workflow", -0.60, "quarter_close_window AND approved_workflow"),
)
#: Scenario and title by the first condition that holds.
SCENARIOS = (
    (f"source = 'okta' AND geo IS NOT NULL AND ({_NEW_GEO})", "compromised_privileged_identity", "Privileged identity used from an unfamiliar geography"),
    ("source = 'github' AND verb IN ('clone', 'archive_download')", "unusual_repo_export", "Unusual repository clone or export"),
    ("source = 'gworkspace' AND external", "unusual_external_sharing", "Unusual external sharing of a sensitive document"),
    ("source = 'snowflake'", "unusual_data_access", "Unusual sensitive dataset access"),
    ("true", "general_behavioral_anomaly", "Behavioral anomaly"),
)


def _groups() -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for r in RULES:
        out.setdefault(r.group, []).append(r)
    return out


def _holds(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.when), F.lit(False))


def raw_score() -> Column:
    """The rules' weights, summed within each group and then over the groups, in order."""
    total = F.lit(0.0)
    for rules in _groups().values():
        part = F.lit(0.0)
        for r in rules:
            part = part + F.when(_holds(r), F.lit(r.weight)).otherwise(F.lit(0.0))
        total = total + part
    return total


def scored(context: DataFrame) -> DataFrame:
    """Adds score, reasons, attributions, scenario and title."""
    out = context.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(TOP), raw_score())))
    out = out.withColumn("reasons", F.array_compact(F.array(*(F.when(_holds(r), r.reason) for r in RULES))))
    entries = F.array_compact(F.array(*(F.when(_holds(r), F.struct(F.lit(r.name).alias("k"), F.lit(r.weight).alias("v"))) for r in RULES)))
    out = out.withColumn("attributions", F.map_from_entries(entries))
    kind, title = F.lit(None), F.lit(None)
    for condition, name, text in reversed(SCENARIOS):
        holds = F.coalesce(F.expr(condition), F.lit(False))
        kind, title = F.when(holds, name).otherwise(kind), F.when(holds, text).otherwise(title)
    return out.withColumn("truth", F.coalesce("scenario", F.lit("baseline"))).withColumn("scenario", kind).withColumn("title", title)


def detections(scored_events: DataFrame, threshold: float = MEDIUM, high: float = HIGH, version: str = MODEL_VERSION) -> DataFrame:
    """Detections of events that score at least the threshold."""
    c = F.col
    return scored_events.where(c("score") >= F.lit(threshold)).select(
        detection_id(c("event_id"), c("scenario")).alias("detection_id"), "event_id", "source", "observed_at", "scenario", "title",
        rounded(c("score"), 2).alias("score"), rounded(F.least(F.lit(0.55) + c("score") / F.lit(2.0), F.lit(TOP)), 2).alias("confidence"),
        F.when(c("score") >= F.lit(high), "high").otherwise("medium").alias("severity"), F.lit("open").alias("status"), F.lit(version).alias("model_version"),
        F.when(F.size("reasons") > 0, c("reasons")).otherwise(F.array(F.lit("embedding_distance_anomaly"))).alias("reasons"),
        F.map_concat("attributions", F.create_map(F.lit("model_distance"), "score")).alias("feature_attributions"),
        c("actor_email").alias("principal_id"), "principal_key", "resource_id", "resource_key", "source_event_id", "truth",
    )


def new_detections(found: DataFrame, known: DataFrame) -> DataFrame:
    """Detections whose id isn't known yet."""
    return found.join(known.select("detection_id"), "detection_id", "left_anti")


def detection_rows(found: DataFrame, tenant: str = "default") -> DataFrame:
    """The detection row of the lake."""
    payload = [x for x in found.columns if x not in ("observed_at",)]
    return found.select(F.lit("detection.v1").alias("detection_schema_version"), F.lit(tenant).alias("tenant_id"), "detection_id", F.col("observed_at").cast("string").alias("observed_at"), "scenario", "title", "score", "confidence", "severity", "status", "model_version", F.col("event_id").alias("primary_event_id"), F.to_json(F.struct(*payload)).alias("payload_json"))


def _sql_score() -> str:
    part = lambda rules: "(0::DOUBLE" + "".join(f" + CASE WHEN {r.when} THEN {r.weight}::DOUBLE ELSE 0::DOUBLE END" for r in rules) + ")"
    total = "0::DOUBLE"
    for rules in _groups().values():
        total = f"({total} + {part(rules)})"
    return f"greatest(0::DOUBLE, least({TOP}::DOUBLE, {total}))"


SQL = {
    "scored": f"""
  SELECT * EXCLUDE (scenario), coalesce(scenario, 'baseline') AS truth, {_sql_score()} AS score,
    list_filter([{", ".join(f"CASE WHEN {r.when} THEN '{r.reason}' END" for r in RULES)}], lambda x: x IS NOT NULL) AS reasons,
    list_filter([{", ".join(f"CASE WHEN {r.when} THEN '{r.name}' END" for r in RULES)}], lambda x: x IS NOT NULL) AS attribution_names,
    CASE {" ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in SCENARIOS)} END AS scenario, CASE {" ".join(f"WHEN {c} THEN '{t}'" for c, _, t in SCENARIOS)} END AS title
  FROM context""",
    "detections": f"""
  SELECT 'det-' || substr(sha256(event_id || ':' || scenario), 1, 12) AS detection_id, event_id, source, observed_at, scenario, title,
    floor(score * 100 + 0.5::DOUBLE) / 100 AS score, floor(least(0.55::DOUBLE + score / 2, {TOP}::DOUBLE) * 100 + 0.5::DOUBLE) / 100 AS confidence,
    CASE WHEN score >= {HIGH}::DOUBLE THEN 'high' ELSE 'medium' END AS severity, 'open' AS status, '{MODEL_VERSION}' AS model_version, reasons, attribution_names,
    actor_email AS principal_id, principal_key, resource_id, resource_key, source_event_id, truth
  FROM scored WHERE score >= {MEDIUM}::DOUBLE""",
}
