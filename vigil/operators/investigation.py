"""Detection queues, facets, cases, peer comparison and entity overviews."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import written

FACETS = ("severity", "status", "source", "scenario", "principal_id")
CASE_GAP_HOURS = 6


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def with_state(detections: DataFrame, state: DataFrame) -> DataFrame:
    """The status that an analyst set, else open. ``state`` has detection_id and status."""
    set_ = state.select("detection_id", F.col("status").alias("_set"))
    return detections.join(set_, "detection_id", "left").withColumn("status", F.coalesce("_set", F.lit("open"))).drop("_set")


def queue_filter(detections: DataFrame, text: str | None = None, **wanted) -> DataFrame:
    """Detections whose columns are among the wanted values and whose texts contain the given one."""
    for column, values in wanted.items():
        if values:
            detections = detections.where(F.col(column).isin(*values))
    if text:
        low = text.lower()
        found = reduce(Column.__or__, [F.contains(F.lower(c), F.lit(low)) for c in ("title", "scenario", "principal_id", "source")])
        detections = detections.where(found | F.exists("reasons", lambda r: F.contains(F.lower(r), F.lit(low))))
    return detections


def _signal() -> list[Column]:
    return [severity_rank(F.col("severity")).desc(), F.desc("score"), F.desc("confidence"), F.asc("title"), F.asc("detection_id")]


def queue(detections: DataFrame, group: str) -> DataFrame:
    """Place of each detection in its group by signal, and the group's place by its first detection.

    Groups can be many (principals), so their places come from ranges that are numbered one by one.
    """
    in_group = Window.partitionBy(group).orderBy(*_signal())
    rows = detections.withColumn("place", F.row_number().over(in_group))
    tops = rows.where("place = 1").select(group, *(F.col(c).alias(f"top_{c}") for c in ("severity", "score", "confidence", "title")))
    order = [severity_rank(F.col("top_severity")).desc(), F.desc("top_score"), F.desc("top_confidence"), F.asc("top_title"), F.asc(group)]
    return rows.join(numbered(tops, order).select(group, "group_place"), group)


def numbered(rows: DataFrame, order: list[Column], to: str = "group_place") -> DataFrame:
    """The rows' places in an order, from 1, without bringing them into one task."""
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(to, (F.col("_before") + F.col("_own")).cast("int")).drop("_part", "_own", "_before")  # one row per partition


def open_page(detections: DataFrame, offset: int, limit: int) -> DataFrame:
    """Open detections, latest evidence first."""
    return detections.where("status = 'open'").orderBy(F.desc("observed_at"), F.desc("detection_id")).offset(offset).limit(limit)


def page_info(detections: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row: open detections in all, and whether there are more after the page."""
    return detections.where("status = 'open'").agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > offset + limit)


def anchors(detections: DataFrame, events: DataFrame) -> DataFrame:
    """(detection_id, event_id, observed_at, anchor): the events of each detection, and which of them is its anchor."""
    each = detections.select("detection_id", F.col("event_id").alias("first"), F.explode("event_ids").alias("event_id"))
    return each.join(events.select("event_id", "observed_at"), "event_id").select("detection_id", "event_id", "observed_at", (F.col("event_id") == F.col("first")).alias("anchor"))


def merged_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases of both tables: ids and timelines in union, evidence by object key, of which the first table's stays."""
    old = a.select("case_id", *(F.col(c).alias(f"a_{c}") for c in ("detection_ids", "timeline", "evidence")))
    both = old.join(b, "case_id", "full_outer")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    union = lambda c: F.array_sort(F.array_union(none(f"a_{c}", "array<string>"), none(c, "array<string>"))).alias(c)
    had, new = (none(c, "array<struct<object_key:string,state:string>>") for c in ("a_evidence", "evidence"))
    fresh = F.filter(new, lambda x: ~F.exists(had, lambda y: y["object_key"] == x["object_key"]))
    return both.select("case_id", union("detection_ids"), union("timeline"), F.concat(had, fresh).alias("evidence"))


def active(detections: DataFrame) -> DataFrame:
    """Open detections, in all and by source."""
    return detections.rollup("source").agg(F.count_if(F.col("status") == "open").alias("active")).select(F.coalesce("source", F.lit("__all__")).alias("source"), "active")


def facets(detections: DataFrame, columns=FACETS) -> DataFrame:
    """Count of each value of each column: one pass over the detections."""
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns)))
    return detections.select(pair.alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


def top_attributions(detections: DataFrame, n: int = 3) -> DataFrame:
    """The attributions with the largest weights, by name at ties."""
    entries = F.map_entries("feature_attributions")
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("w"), e["key"].alias("k"))))
    return detections.select("detection_id", F.posexplode(F.slice(ordered, 1, n)).alias("place", "e")).select("detection_id", F.col("place").cast("long").alias("place"), F.col("e.k").alias("name"), (-F.col("e.w")).alias("weight"))


def cases(detections: DataFrame, hours: int = CASE_GAP_HOURS) -> DataFrame:
    """Detections with the case they belong to: per principal in time order, a detection more than so many
    hours after its case's first one begins a new case.

    Where a case begins depends on where the one before began, so a principal's detections are read in order, one
    after the other; the task holds the running case alone, however many there are.
    """
    kinds = dict(detections.dtypes)
    rows = detections.select("principal_id", "detection_id", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("at"))
    rows = rows.repartition("principal_id").sortWithinPartitions("principal_id", "at", "detection_id")
    gap = hours * 3_600_000_000

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, began, anchor, fresh = None, None, None, True
        for b in batches:
            anchors_ = []
            for person, detection, at in zip(*(c.to_pylist() for c in b.columns)):
                if fresh or person != who or (at is not None and (began is None or at > began + gap)):
                    who, began, anchor, fresh = person, at, detection, False
                anchors_.append(f"case-{anchor}")
            yield pa.record_batch([b.column(0), b.column(1), pa.array(anchors_, pa.string())], ["principal_id", "detection_id", "case_id"])

    return rows.mapInArrow(work, f"principal_id {kinds['principal_id']}, detection_id {kinds['detection_id']}, case_id string")


def case_summaries(case_rows: DataFrame, detections: DataFrame) -> DataFrame:
    """Per case: detections, distinct events, first detection and highest severity."""
    rows = case_rows.join(detections.select("detection_id", "event_id", "observed_at", "severity"), "detection_id")
    return rows.groupBy("case_id", "principal_id").agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("event_id").alias("events"), F.min_by("detection_id", F.struct("observed_at", "detection_id")).alias("primary_detection"), F.max(severity_rank(F.col("severity"))).alias("severity_rank"))


def evidence(detections: DataFrame, raw: DataFrame) -> DataFrame:
    """Whether the raw row of each detection is still there."""
    kept = raw.select("source", "source_event_id").distinct().withColumn("_there", F.lit(True))
    return detections.join(kept, ["source", "source_event_id"], "left").select("detection_id", F.when(F.col("_there"), "available").otherwise("retention_expired").alias("state"))


def timelines(detections: DataFrame, events: DataFrame) -> DataFrame:
    """The events of principals with detections, a row each; a detection's timeline is those of its principal."""
    people = detections.select("principal_id").distinct()
    own = events.select(F.col("actor_email").alias("principal_id"), "event_id", "observed_at")
    return own.join(people, "principal_id", "left_semi").dropDuplicates(["event_id"])


def peer_comparison(detections: DataFrame, static: DataFrame, peer_counts: DataFrame, accessors: DataFrame) -> DataFrame:
    """For all detections: profile, peer counts by kind, department size, and department peers on the resource.

    Peer counts are those of ``features.peer_counts``, and resource counts join accessors with departments; pairs of peers are never made for it.
    """
    n = peer_counts.groupBy("principal_key").pivot("peer_type", ["manager", "group"]).agg(F.sum("peers"))
    size = static.groupBy("department").agg(F.count(F.lit(1)).alias("department_size"))
    on_resource = accessors.join(static.select("principal_key", "department"), "principal_key").groupBy("resource_key", "department").agg(F.count_distinct("principal_key").alias("peer_group_resource_principals"))
    rows = detections.select("detection_id", "principal_key", "resource_key").join(static.select("principal_key", "department", "role", "location", "privilege_level"), "principal_key")
    rows = rows.join(size, "department").join(on_resource, ["resource_key", "department"], "left").join(n, "principal_key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select("detection_id", "department", "role", "location", "privilege_level", (F.col("department_size") - 1).alias("department_peers"), zero("manager").alias("manager_peers"), zero("group").alias("group_peers"), zero("peer_group_resource_principals").alias("peer_group_resource_principals"))


#: Counters of prior history and their names in a peer comparison.
BEHAVIOUR = {"prior_events": "principal_prior_event_count", "prior_actions": "principal_prior_action_count", "prior_resource": "principal_prior_resource_access_count", "peer_resource": "peer_group_resource_access_count", "geo_seen": "geo_seen_before"}


def full_comparison(detections: DataFrame, context: DataFrame, static: DataFrame, peer_counts: DataFrame, accessors: DataFrame) -> DataFrame:
    """``peer_comparison`` with the principal's events by its action rows, the size of its group, what was known before the event, and the reasons.

    A detection of an event without context, or of a principal without action rows, has zeros and false there. One whose
    principal has no profile has no comparison by feature tables and no row here; ``department_scan`` serves it.
    """
    compared = peer_comparison(detections, static, peer_counts, accessors)
    total = accessors.groupBy("principal_key").agg(F.sum("access_count").alias("principal_total_events"))
    before = context.select("event_id", *(F.col(c).alias(to) for c, to in BEHAVIOUR.items()))
    own = detections.select("detection_id", "event_id", "principal_id", "principal_key", "resource_id", F.col("reasons").alias("detection_reasons"))
    rows = own.join(compared, "detection_id").join(total, "principal_key", "left").join(before, "event_id", "left").drop("event_id", "principal_key")
    counts = [c for c in rows.columns if c.startswith("principal_prior") or c in ("principal_total_events", "peer_group_resource_access_count")]
    filled = {c: F.coalesce(c, F.lit(0)).cast("long") for c in counts} | {"geo_seen_before": F.coalesce("geo_seen_before", F.lit(False))}
    return rows.withColumns(filled).withColumn("peer_group_principal_count", F.col("department_peers") + 1)


def department_scan(detections: DataFrame, events: DataFrame) -> DataFrame:
    """Without feature tables: principals of the department, and of those on the resource, from the events."""
    size = events.groupBy("department").agg(F.count_distinct("actor_email").alias("department_principals"))
    on_resource = events.groupBy("department", "resource_id").agg(F.count_distinct("actor_email").alias("resource_principals"), F.count(F.lit(1)).alias("resource_events"))
    rows = detections.select("detection_id", "event_id").join(events.select("event_id", "department", "resource_id"), "event_id")
    return rows.join(size, "department").join(on_resource, ["department", "resource_id"]).select("detection_id", "department_principals", "resource_principals", "resource_events")


def entity_overview(events: DataFrame) -> DataFrame:
    """One row per principal."""
    return events.groupBy("actor_email").agg(
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("events"), F.count_distinct("source").alias("sources"),
        F.count_distinct("resource_id").alias("resources"), F.count_if(F.lower("sensitivity").isin("high", "critical")).alias("high_sensitivity"), F.max_by("event_id", F.struct("observed_at", "event_id")).alias("anchor_event"),
    )


def redacted(events: DataFrame, allowed=("event_id", "source", "verb", "category", "sensitivity", "dt")) -> DataFrame:
    """The fields that operations may see."""
    return events.select(*allowed)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap of two sets of detections by event: counts of both, left only, right only."""
    x = a.select("event_id").distinct().withColumn("l", F.lit(1))
    y = b.select("event_id").distinct().withColumn("r", F.lit(1))
    both = x.join(y, "event_id", "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def divergence_samples(a: DataFrame, b: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` events that only one side detects, by time and id."""
    one = lambda x, y, side: x.join(y.select("event_id"), "event_id", "left_anti").select(F.lit(side).alias("side"), "event_id", "observed_at")
    rows = one(a, b, "left").unionByName(one(b, a, "right"))
    place = F.row_number().over(Window.partitionBy("side").orderBy("observed_at", "event_id"))
    return rows.withColumn("place", place).where(F.col("place") <= n).select("side", "place", "event_id")
