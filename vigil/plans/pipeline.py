"""Intake, normalization, context and detections as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.operators import context, normalize, rules
from vigil.plans.common import accepted, detections, scored, sql
from vigil.sources import adapter

QUERIES, SQL = {}, {}


def query(oracle: str | None = None, *needs: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = sql(oracle, *needs)
        return f

    return add


@query("SELECT source, source_event_id, reason FROM checked", "checked")
def raw_contract_validation(spark, d):
    return normalize.checked(adapter.raw_events(spark, d)).select("source", "source_event_id", "reason")


@query(
    f"""SELECT source_event_id, CASE WHEN coalesce(source_event_id, '') = '' THEN 'missing_source_event_id' WHEN observed_at IS NULL THEN 'missing_observed_at'
  WHEN source <> 'okta' THEN 'source_mismatch' WHEN source NOT IN {normalize.SOURCES} THEN 'unsupported_source' END AS reason FROM raw""",
    "raw",
)
def intake_check(spark, d):
    return adapter.raw_events(spark, d).select("source_event_id", normalize.intake_reason(F.lit("okta")).alias("reason"))


@query("SELECT source, reason, count(*) AS n, count(DISTINCT source_event_id) AS ids FROM checked WHERE reason IS NOT NULL GROUP BY ALL", "checked")
def dead_letter_reasons(spark, d):
    _, dead = normalize.split(normalize.checked(adapter.raw_events(spark, d)))
    return dead.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_event_id").alias("ids"))


@query("SELECT event_id, event_key, source, source_event_id, principal_key, resource_key, verb, category, provider, source_kind, dt, hour, late FROM accepted", "accepted")
def normalized_events(spark, d):
    return accepted(spark, d).select("event_id", "event_key", "source", "source_event_id", "principal_key", "resource_key", "verb", "category", "provider", "source_kind", "dt", "hour", "late")


@query(
    """SELECT source_event_id, source || '|' || actor_email || '|' || event_type || '|' || resource_id || '|' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS semantic_key
  FROM checked WHERE reason IS NULL""",
    "checked",
)
def semantic_keys(spark, d):
    valid, _ = normalize.split(normalize.checked(adapter.raw_events(spark, d)))
    return normalize.with_semantic_key(valid).select("source_event_id", "semantic_key")


@query("SELECT source, count(*) AS valid, count(DISTINCT (actor_email, event_type, resource_id, observed_at)) AS kept FROM checked WHERE reason IS NULL GROUP BY source", "checked")
def semantic_dedupe(spark, d):
    valid, _ = normalize.split(normalize.checked(adapter.raw_events(spark, d)))
    kept = normalize.deduplicated(normalize.keyed(valid)).groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    return valid.groupBy("source").agg(F.count(F.lit(1)).alias("valid")).join(kept, "source")


@query("SELECT source, count(*) AS n, count(*) FILTER (late) AS late FROM accepted GROUP BY source", "accepted")
def late_arrivals(spark, d):
    return accepted(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))


@query(
    """SELECT (SELECT count(*) FROM raw) AS raw_events, count(*) FILTER (reason IS NOT NULL) AS dead_letters, count(DISTINCT (source, source_event_id)) FILTER (reason IS NOT NULL) AS dead_letter_ids,
  (SELECT count(*) FROM accepted) AS accepted, (SELECT count(*) FILTER (late) FROM accepted) AS late, count(*) FILTER (reason IS NULL) - (SELECT count(*) FROM accepted) AS duplicates FROM checked""",
    "raw", "checked", "accepted",
)
def run_counters(spark, d):
    raw = adapter.raw_events(spark, d)
    return normalize.run_counters(raw, normalize.normalized(raw))


@query("SELECT event_id, prior_events, prior_actions, prior_resource, peer_resource, prior_geos, geo_seen FROM context", "context")
def detection_context(spark, d):
    return context.detection_context(accepted(spark, d)).select("event_id", "prior_events", "prior_actions", "prior_resource", "peer_resource", F.col("prior_geos").cast("long").alias("prior_geos"), "geo_seen")


@query("SELECT event_id, score, scenario, title, truth, array_to_string(reasons, ',') AS reasons, array_to_string(attribution_names, ',') AS attributions FROM scored", "scored")
def rule_scores(spark, d):
    return scored(spark, d).select("event_id", "score", "scenario", "title", "truth", F.array_join("reasons", ",").alias("reasons"), F.array_join(F.map_keys("attributions"), ",").alias("attributions"))


@query("SELECT detection_id, event_id, source, scenario, title, score, confidence, severity, status, principal_id, resource_id, array_to_string(reasons, ',') AS reasons FROM detections", "detections")
def heuristic_detections(spark, d):
    return detections(spark, d).select("detection_id", "event_id", "source", "scenario", "title", "score", "confidence", "severity", "status", "principal_id", "resource_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT detection_id, event_id FROM detections WHERE source <> 'okta'", "detections")
def new_detections(spark, d):
    found = detections(spark, d)
    return rules.new_detections(found, found.where("source = 'okta'")).select("detection_id", "event_id")


@query("SELECT detection_id, model_version, score, event_id AS primary_event_id FROM detections", "detections")
def detection_rows(spark, d):
    return rules.detection_rows(detections(spark, d)).select("detection_id", "model_version", "score", "primary_event_id")
