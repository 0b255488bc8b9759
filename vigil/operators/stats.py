"""Source statistics, capabilities, health, batch manifests and readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What each source must send.
CONTRACT = {
    "okta": ("Okta", ("login", "admin_change"), ("geo", "ip", "privileged")),
    "gworkspace": ("Google Workspace", ("view", "share_external"), ("external", "target_domain", "owner_email")),
    "github": ("GitHub", ("view", "archive_download"), ("bytes_transferred_mb", "resource_kind", "resource_name")),
    "snowflake": ("Snowflake", ("query", "export"), ("rows_read", "warehouse", "resource_name")),
}


def contract(spark: SparkSession) -> DataFrame:
    rows = [(s, name, sorted(kinds), sorted(fields)) for s, (name, kinds, fields) in CONTRACT.items()]
    return spark.createDataFrame(rows, "source string, display_name string, required_event_types array<string>, required_fields array<string>")


def source_stats(checked: DataFrame, events: DataFrame) -> DataFrame:
    """Per source: rows seen, accepted and dead, distinct dead ids, last times, and the anchor of recent windows."""
    raw = checked.groupBy("source").agg(
        F.count(F.lit(1)).alias("raw_events"),
        F.max("observed_at").alias("raw_last_seen"),
        F.count_if(F.col("reason").isNotNull()).alias("dead_letters"),
        F.count_distinct(F.when(F.col("reason").isNotNull(), F.col("source_event_id"))).alias("dead_letter_ids"),
        F.sort_array(F.collect_set("event_type")).alias("seen_event_types"),
    )
    kept = events.groupBy("source").agg(F.count(F.lit(1)).alias("normalized_events"), F.max("observed_at").alias("normalized_last_seen"))
    out = raw.join(kept, "source", "left").withColumn("normalized_events", F.coalesce("normalized_events", F.lit(0)))
    return out.withColumn("anchor", F.greatest("raw_last_seen", "normalized_last_seen"))


def daily_counts(checked: DataFrame, events: DataFrame) -> DataFrame:
    """Long form: source, kind (raw, normalized, dead_letter), day, count."""
    day = F.to_date("observed_at").alias("day")
    one = lambda df, kind: df.groupBy("source", day).agg(F.count(F.lit(1)).alias("n")).select("source", F.lit(kind).alias("kind"), "day", "n")
    return reduce(DataFrame.unionByName, [one(checked, "raw"), one(events, "normalized"), one(checked.where("reason IS NOT NULL"), "dead_letter")])


def as_maps(daily: DataFrame) -> DataFrame:
    """Per source and kind a map from day to count."""
    return daily.groupBy("source", "kind").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("day").cast("string"), "n")))).alias("counts"))


def recent_counts(daily: DataFrame, days: dict[str, int] | None = None) -> DataFrame:
    """Counts within the days up to each source's last day: one for raw and normalized, seven for dead letters."""
    days = days or {"raw": 1, "normalized": 1, "dead_letter": 7}
    span = F.lit(None)
    for kind, n in days.items():
        span = F.when(F.col("kind") == kind, n).otherwise(span)
    anchored = daily.withColumn("anchor", F.max("day").over(Window.partitionBy("source")))
    return anchored.where(F.date_diff("anchor", "day") < span).groupBy("source", "kind").agg(F.sum("n").alias("recent"))


def seen_fields(raw: DataFrame) -> DataFrame:
    """Names of the fields that a source's records have with a value."""
    names = [c for c in raw.columns if c != "source"]
    return raw.groupBy("source").agg(*(F.bool_or(F.col(c).isNotNull()).alias(c) for c in names)).select("source", F.sort_array(F.array_compact(F.array(*(F.when(F.col(c), c) for c in names)))).alias("fields"))


def capability(spark: SparkSession, checked: DataFrame, raw: DataFrame, events: DataFrame) -> DataFrame:
    """Contract against what was seen, with recent counts."""
    stats = source_stats(checked, events).select("source", "seen_event_types", "raw_events", "normalized_events", "dead_letters")
    recent = recent_counts(daily_counts(checked, events)).groupBy("source").pivot("kind", ["raw", "normalized", "dead_letter"]).agg(F.sum("recent"))
    rows = F.broadcast(contract(spark)).join(stats, "source", "left").join(seen_fields(raw), "source", "left").join(recent, "source", "left")  # four rows
    none = F.array().cast("array<string>")
    missing_types = F.array_except("required_event_types", F.coalesce("seen_event_types", none))
    missing_fields = F.array_except("required_fields", F.coalesce("fields", none))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select(
        "source", "display_name", missing_types.alias("missing_event_types"), missing_fields.alias("missing_fields"), (F.size("required_fields") - F.size(missing_fields)).alias("covered_fields"),
        zero("raw_events").alias("raw_events"), zero("normalized_events").alias("normalized_events"), zero("dead_letters").alias("dead_letters"), zero("raw").alias("raw_24h"), zero("normalized").alias("normalized_24h"), zero("dead_letter").alias("dead_letter_7d"),
    )


def health(matrix: DataFrame) -> DataFrame:
    """Label and number of issues of each source."""
    issues = F.size("missing_event_types") + F.size("missing_fields") + (F.col("dead_letters") > 0).cast("int")
    label = F.when(F.col("raw_events") == 0, "not seeded").when(F.size("missing_event_types") > 0, "blocked").when(issues > 0, "attention").otherwise("healthy")
    return matrix.select("source", issues.alias("issues"), label.alias("health"))


def batch_manifest(envelopes: DataFrame) -> DataFrame:
    """Per batch: records, first and last id, bounds of observation and receipt, distinct upstream batches, and a digest of the ids in order.

    A batch is bounded (an hour of a source), so its ids fit in one row.
    """
    field = lambda name: F.get_json_object("record_json", f"$.{name}")
    rows = envelopes.select("batch_id", "record_ordinal", "received_at", field("source_event_id").alias("id"), field("observed_at").alias("at"), F.get_json_object("metadata_json", "$.upstream_batch").alias("upstream"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_ordinal", "id"))), lambda x: x["id"]), "|")
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("at").alias("first_observed"), F.max("at").alias("last_observed"), F.min("received_at").alias("first_received"), F.max("received_at").alias("last_received"),
        F.sort_array(F.collect_set("upstream")).alias("upstream_batches"), F.sha2(ids, 256).alias("digest"),
    )


def fixture_report(spark: SparkSession, checked: DataFrame) -> DataFrame:
    """Per source: valid and invalid rows, and required event types that no valid row has."""
    found = checked.groupBy("source").agg(F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("invalid"), F.sort_array(F.collect_set(F.when(F.col("reason").isNull(), F.col("event_type")))).alias("seen"))
    rows = contract(spark).join(found, "source", "left")
    return rows.select("source", "valid", "invalid", F.array_except("required_event_types", "seen").alias("missing_event_types"))


def invalid_rows(checked: DataFrame) -> DataFrame:
    """Of a fixture bundle: every invalid row with its reason."""
    return checked.where("reason IS NOT NULL").select("source", "source_event_id", "reason")


def ops_metadata(events: DataFrame, dead: DataFrame) -> DataFrame:
    """Events and dead letters by source, of sources that have either."""
    one = events.groupBy("source").agg(F.count(F.lit(1)).alias("events"))
    other = dead.groupBy("source").agg(F.count(F.lit(1)).alias("dead_letters"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return one.join(other, "source", "full_outer").select("source", zero("events"), zero("dead_letters"))


def report(matrix: DataFrame, detections: DataFrame) -> DataFrame:
    """One row: sources, those with events, those that meet the contract, detections, and their scenarios."""
    seeded = F.col("normalized_events") > 0
    ready = seeded & (F.size("missing_event_types") == 0) & (F.size("missing_fields") == 0) & (F.col("dead_letters") == 0)
    sources = matrix.agg(F.count(F.lit(1)).alias("sources"), F.count_if(seeded).alias("seeded_sources"), F.count_if(ready).alias("contract_ready_sources"))
    found = detections.agg(F.count(F.lit(1)).alias("detections"), F.array_join(F.sort_array(F.collect_set("scenario")), ",").alias("scenarios"))
    return sources.join(F.broadcast(found))  # one row


def expired(events: DataFrame, days: int) -> DataFrame:
    """Rows older than so many days before the latest one; retention drops them."""
    last = events.agg(F.max("observed_at").alias("_last"))
    return events.join(F.broadcast(last)).where(F.col("observed_at") < F.col("_last") - F.expr(f"INTERVAL {days} DAYS")).drop("_last")  # one row


def index_cardinalities(events: DataFrame) -> DataFrame:
    """Distinct principal references, resource references and departments."""
    refs = lambda a, b: F.explode(F.array(F.col(a), F.concat(F.lit("entity::"), b)))
    one = lambda df, name: df.agg(F.count_distinct("x").alias("n")).select(F.lit(name).alias("index"), "n")
    return reduce(DataFrame.unionByName, [one(events.select(refs("actor_email", "principal_key").alias("x")), "principals"), one(events.select(refs("resource_id", "resource_key").alias("x")), "resources"), one(events.select(F.col("department").alias("x")), "departments")])


def index_sketches(events: DataFrame) -> DataFrame:
    """(index, day, sketch): a sketch of an index's references for each day of observation. Sketches of any days can be merged."""
    refs = F.array(
        F.struct(F.lit("principals").alias("index"), F.col("actor_email").alias("x")), F.struct(F.lit("principals").alias("index"), F.concat(F.lit("entity::"), "principal_key").alias("x")),
        F.struct(F.lit("resources").alias("index"), F.col("resource_id").alias("x")), F.struct(F.lit("resources").alias("index"), F.concat(F.lit("entity::"), "resource_key").alias("x")),
        F.struct(F.lit("departments").alias("index"), F.col("department").alias("x")),
    )
    rows = events.select(F.to_date("observed_at").alias("day"), F.explode(refs).alias("r")).where("r.x IS NOT NULL")
    return rows.groupBy("r.index", "day").agg(F.hll_sketch_agg("r.x", F.lit(14)).alias("sketch"))


def cardinalities(sketches: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range, index, n): estimated distinct references of the days of each range (name, first, last), within about 1 %."""
    few = ranges.select(F.col("name").alias("range"), "first", "last")
    rows = sketches.join(F.broadcast(few), F.col("day").between(F.col("first"), F.col("last")))  # ranges that a report asks for
    return rows.groupBy("range", "index").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


_FIELDS = ("source_event_id", "integration_id", "observed_at", "received_at", "actor_email", "actor_name", "department", "role", "event_type", "resource_id", "resource_name", "resource_kind", "sensitivity", "geo", "privileged", "external", "rows_read", "expected_transition", "role_change_window", "approved_travel", "incident_response_window", "incident_ticket", "quarter_close_window", "approved_workflow", "scenario", "actor_idx")
SQL = {
    "daily": """
  SELECT source, 'raw' AS kind, observed_at::DATE AS day, count(*) AS n FROM checked GROUP BY ALL UNION ALL SELECT source, 'normalized', observed_at::DATE, count(*) FROM accepted GROUP BY ALL
  UNION ALL SELECT source, 'dead_letter', observed_at::DATE, count(*) FROM checked WHERE reason IS NOT NULL GROUP BY ALL""",
    "recent": "SELECT source, kind, sum(n)::BIGINT AS recent FROM (SELECT *, max(day) OVER (PARTITION BY source) AS anchor FROM daily) WHERE anchor - day < CASE kind WHEN 'dead_letter' THEN 7 ELSE 1 END GROUP BY ALL",
    "fields": "SELECT source, list_sort(list_filter([" + ", ".join(f"CASE WHEN bool_or({c} IS NOT NULL) THEN '{c}' END" for c in _FIELDS) + "], lambda x: x IS NOT NULL)) AS fields FROM raw GROUP BY source",
    "contract": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{n}', {sorted(k)}, {sorted(f)})" for s, (n, k, f) in CONTRACT.items()) + ") v(source, display_name, required_event_types, required_fields)",
    "matrix": """
  WITH s AS (SELECT source, list(DISTINCT event_type) AS seen, count(*) AS raw_events, count(*) FILTER (reason IS NOT NULL) AS dead_letters FROM checked GROUP BY source),
  a AS (SELECT source, count(*) AS n FROM accepted GROUP BY source)
  SELECT c.source, display_name, list_filter(required_event_types, lambda x: NOT list_contains(seen, x)) AS missing_event_types, list_filter(required_fields, lambda x: NOT list_contains(fields, x)) AS missing_fields,
    raw_events, coalesce(a.n, 0) AS normalized_events, dead_letters, (SELECT coalesce(sum(recent), 0) FROM recent r WHERE r.source = c.source AND kind = 'raw')::BIGINT AS raw_24h,
    (SELECT coalesce(sum(recent), 0) FROM recent r WHERE r.source = c.source AND kind = 'normalized')::BIGINT AS normalized_24h, (SELECT coalesce(sum(recent), 0) FROM recent r WHERE r.source = c.source AND kind = 'dead_letter')::BIGINT AS dead_letter_7d
  FROM contract c LEFT JOIN s ON s.source = c.source LEFT JOIN a ON a.source = c.source LEFT JOIN fields f ON f.source = c.source""",
}
NEEDS = {"daily": ["checked", "accepted"], "recent": ["daily"], "fields": ["raw"], "contract": [], "matrix": ["contract", "checked", "accepted", "fields", "recent"]}
