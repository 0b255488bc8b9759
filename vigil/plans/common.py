"""SQL fragments put together: each query's oracle starts from the same common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.operators import context, evaluation, features, normalize, rules, stats, tensors
from vigil.session import written
from vigil.sources import adapter

_WITH_NEEDS = (features, stats, evaluation, tensors)
FRAGMENTS = {k: v for m in (adapter, normalize, context, rules, *_WITH_NEEDS) for k, v in m.SQL.items()}
NEEDS = {"checked": ["raw"], "accepted": ["checked"], "context": ["accepted"], "scored": ["context"], "detections": ["scored"]} | {k: v for m in _WITH_NEEDS for k, v in m.NEEDS.items()}


def sql(body: str, *needs: str, before: str | None = None) -> str:
    """The query with all fragments that it needs; of accepted events, those before a time alone, if one is given."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in NEEDS.get(name, ()):
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    own = {"accepted": f"SELECT * FROM ({FRAGMENTS['accepted']}) WHERE observed_at < TIMESTAMP '{before}'"} if before else {}
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({own.get(n, FRAGMENTS[n])})" for n in order)
    body = f"SELECT * FROM ({body}) q" if body.lstrip().startswith("WITH") else body
    return f"WITH RECURSIVE {ctes}\n{body}" if order else body


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalized(adapter.raw_events(spark, sf_dir))


#: Columns of events that feature tables are made from.
FEATURE_COLUMNS = ("event_id", "observed_at", "source", "principal_key", "resource_key", "actor_email", "department", "role", "geo")


def feature_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted events' columns for feature tables, written down, so that several tables don't check and deduplicate them anew."""
    return written(accepted(spark, sf_dir).select(*FEATURE_COLUMNS), "events")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scored(context.detection_context(accepted(spark, sf_dir)))


#: Columns of events that rules, detections and observations are made from.
DETECTION_COLUMNS = (
    "event_id", "source", "observed_at", "actor_email", "department", "geo", "verb", "resource_id", "principal_key", "resource_key", "source_event_id", "scenario", "sensitivity", "privileged", "external", "rows_read",
    "expected_transition", "role_change_window", "approved_travel", "incident_response_window", "incident_ticket", "quarter_close_window", "approved_workflow",
)


def scored_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events without the columns that neither rules nor detections have: large inputs are written down for their context, whole rows."""
    return rules.scored(context.detection_context(accepted(spark, sf_dir).select(*DETECTION_COLUMNS)))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.detections(scored_narrow(spark, sf_dir))
