"""Lake round trips, transforms and streams as queries over the given events.

A stream reads a copy of the raw events that the query writes to the shared folder as a few files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.functions import scalars
from vigil.operators import context, features, normalize, rules, transforms
from vigil.plans.common import accepted, detections, feature_events, sql
from vigil.session import shared_path, written
from vigil.sources import adapter, lake
from vigil.streaming import intake, service

QUERIES, SQL = {}, {}


def query(oracle: str | None = None, *needs: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = sql(oracle, *needs)
        return f

    return add


#: Rows of a stream's file, about: what one task writes or reads.
FILE_ROWS = 250_000


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Raw events in four batches by time, each of as many files as its rows take."""
    raw = adapter.raw_events(spark, d)
    path, each = shared_path(spark, "raw"), max(1, -(-raw.count() // (4 * FILE_ROWS)))
    raw.repartitionByRange(4 * each, "observed_at").write.parquet(path)
    return intake.read_raw(spark, path, raw.schema, each)


#: Where a stream's input is cut; each part is a batch.
CUTS = ("2024-01-08", "2024-01-15", "2024-01-22")


def _parts(rows: DataFrame) -> list[DataFrame]:
    """The rows between the cuts; those without a time are in the first part."""
    cuts, at = [F.lit(c).cast("timestamp_ntz") for c in CUTS], F.col("observed_at")
    middle = [rows.where((at >= low) & (at < high)) for low, high in zip(cuts, cuts[1:])]
    return [rows.where(at.isNull() | (at < cuts[0])), *middle, rows.where(at >= cuts[-1])]


def _fed(parts: list[DataFrame], path: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Each part is written to the folder as one delivery of as many files as it takes, and is one batch of a stream that is started again for it."""
    for rows in parts:
        rows.write.option("maxRecordsPerFile", FILE_ROWS).mode("append").parquet(path)
        start(intake.read_raw(rows.sparkSession, path, rows.schema, None)).awaitTermination()


def _start(df: DataFrame, path: str, mode: str) -> StreamingQuery:
    if mode == "append":
        return df.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start(path)
    return df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start()


def _run(df: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """The rows that a stream gives over all files that are there, as a table."""
    path = shared_path(df.sparkSession, label)
    _start(df, path, mode).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("SELECT event_id, event_key, source, source_event_id FROM accepted", "accepted")
def normalized_lake_round_trip(spark, d):
    path = shared_path(spark, "normalized")
    lake.write_normalized(accepted(spark, d), path, hourly=False)
    return lake.read_normalized(spark, path).select("event_id", "event_key", "source", "source_event_id")


@query("SELECT event_id FROM accepted WHERE observed_at >= TIMESTAMP '2024-01-10' AND observed_at <= TIMESTAMP '2024-01-12'", "accepted")
def normalized_lake_range(spark, d):
    path = shared_path(spark, "normalized")
    lake.write_normalized(accepted(spark, d), path, hourly=False)
    return lake.read_normalized(spark, path, "2024-01-10T00:00:00.000000Z", "2024-01-12T00:00:00.000000Z").select("event_id")


@query("SELECT source, count(*) AS n, count(DISTINCT source_event_id) AS ids FROM raw GROUP BY source", "raw")
def raw_lake_round_trip(spark, d):
    path = shared_path(spark, "raw-lake")
    lake.write_raw(normalize.envelopes(adapter.raw_events(spark, d)), path, hourly=False)
    rows = normalize.landed(spark.read.parquet(path), "source string, source_event_id string, resource_id string")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_event_id").alias("ids"))


_DAYS = "(SELECT count(DISTINCT observed_at::DATE) FROM detections {})"
_EARLY = _DAYS.format("WHERE observed_at < TIMESTAMP '2024-01-15'")


@query(f"SELECT detection_id, event_id AS primary_event_id, score, {_EARLY} AS touched_0, {_DAYS.format('')} AS touched_1, {_EARLY} AS touched_2 FROM detections", "detections")
def detection_lake_append(spark, d):
    path = shared_path(spark, "detections")
    rows = rules.detection_rows(detections(spark, d))
    early = rows.where("observed_at < '2024-01-15'")
    parts = [lake.append_detections(df, path, hourly=False) for df in (early, rows, early)]  # the second time adds the late ones, the third nothing
    return lake.read_detections(spark, path).select("detection_id", "primary_event_id", "score", *(F.lit(n).cast("long").alias(f"touched_{i}") for i, n in enumerate(parts)))


@query("SELECT 'accessors' AS name, count(*) AS n FROM accessors UNION ALL SELECT 'history', count(*) FROM history UNION ALL SELECT 'static', count(*) FROM static", "accessors", "history", "static")
def feature_lake_round_trip(spark, d):
    path, e = shared_path(spark, "features"), feature_events(spark, d)
    lake.write_features({"accessors": features.accessors(e), "history": features.history(e), "static": features.static_profiles(e, adapter.principals(spark, d))}, path)
    one = lambda n: spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return one("accessors").unionByName(one("history")).unionByName(one("static"))


@query("SELECT source_event_id, CASE WHEN source = 'error' THEN 'no_source' END AS reason, CASE WHEN source = 'error' THEN '' WHEN source = 'okta' THEN 'check,route' ELSE 'check,route' END AS lineage, CASE WHEN source = 'error' THEN NULL WHEN source = 'okta' THEN 'identity' WHEN source = 'github' THEN 'code' END AS label FROM raw", "raw")
def transform_chain(spark, d):
    rows = transforms.with_metadata(adapter.raw_events(spark, d).select("source_event_id", "source")).withColumn("label", F.lit(None).cast("string"))
    routes = [(F.col("source") == "okta", transforms.mapping(label=F.lit("identity"))), (F.col("source").isin("github", "okta"), transforms.mapping(label=F.lit("code")))]
    out = transforms.chain(rows, [("check", transforms.checking(F.col("source") != "error", "no_source")), ("route", transforms.routing(routes))])
    return out.select("source_event_id", "reason", F.array_join("lineage", ",").alias("lineage"), "label")


@query("SELECT source, source_event_id, i, NULL::VARCHAR AS error FROM raw, range(0, 2) t(i) WHERE source = 'okta' AND i < 1 + (source_event_id::BIGINT % 2)", "raw")
def user_transform(spark, d):
    def f(row):
        return [{"source": row["source"], "source_event_id": row["source_event_id"], "i": i} for i in range(1 + int(row["source_event_id"]) % 2)]

    rows = adapter.raw_events(spark, d).where("source = 'okta'").select("source", "source_event_id")
    return transforms.user_transform(rows, f, "source string, source_event_id string, i long")


@query("SELECT count(*) AS n FROM accepted", "accepted")
def stream_accept(spark, d):
    path = shared_path(spark, "accepted")
    intake.accept(_stream(spark, d), path, f"{path}-state").awaitTermination()
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


#: Three deliveries of each hour of a source: as it is, again, and in every third hour with another payload first or in between.
_DELIVERIES = """SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN hour % 3 = 0 THEN ['new', 'repeat', 'repeat'] WHEN hour % 3 = 1 THEN ['new', 'conflict', 'repeat'] ELSE ['new', 'repeat', 'conflict'] END) AS kind
  FROM (SELECT DISTINCT source, strftime(received_at, '%Y%m%d%H') AS h, strftime(received_at, '%H')::INT AS hour FROM raw)) GROUP BY kind"""


@query(_DELIVERIES, "raw")
def stream_batch_acceptance(spark, d):
    """Batches of raw rows delivered three times, the second time within a micro-batch of the first, the third in a later one after a restart."""
    found = normalize.envelopes(adapter.raw_events(spark, d)).groupBy("batch_id").agg(F.sum(F.xxhash64("record_json").cast("decimal(38,0)")).cast("string").alias("payload_sha256"))
    first, root = written(found.withColumnRenamed("batch_id", "idempotency_key"), "batches"), shared_path(spark, "acceptance")
    hour = F.substring("idempotency_key", -2, 2).cast("int") % 3
    other = lambda n: F.when(hour == n, F.lit(None).cast("string")).otherwise(F.col("payload_sha256"))
    times = [first.withColumn("delivery", F.lit(1)), first.withColumn("payload_sha256", other(1)).withColumn("delivery", F.lit(2)), first.withColumn("payload_sha256", other(2)).withColumn("delivery", F.lit(3))]
    for part in (times[0].unionByName(times[1]), times[2]):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        intake.accept_batch_stream(intake.read_raw(spark, f"{root}/in", part.schema), root, "delivery").awaitTermination()
    refused = spark.read.parquet(f"{root}/refused").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return refused.unionByName(spark.read.parquet(f"{root}/accepted").agg(F.lit("new").alias("kind"), F.count(F.lit(1)).alias("n")))


@query("SELECT source, count(DISTINCT (actor_email, event_type, resource_id, observed_at)) AS n FROM checked WHERE reason IS NULL GROUP BY source", "checked")
def stream_deduplicate(spark, d):
    return _run(intake.deduplicated_stream(_stream(spark, d)).select("source", "semantic_key"), "dedupe").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, received_at::DATE AS day, count(*) AS dead_letters FROM checked WHERE reason IS NOT NULL GROUP BY ALL", "checked")
def stream_dead_letters(spark, d):
    return _run(intake.dead_letter_stream(_stream(spark, d)), "dead", "complete").select("source", F.to_date("day").alias("day"), "dead_letters")


@query("SELECT principal_key, window_start, count(*) AS resources FROM history GROUP BY ALL", "history")
def stream_history_windows(spark, d):
    events = intake.valid_stream(_stream(spark, d))
    return _run(intake.history_stream(events), "history", "complete").select("principal_key", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.size("resources").cast("long").alias("resources"))


def _over_accepted(spark: SparkSession, d: str, start: Callable[[DataFrame, str], StreamingQuery], schema: str) -> DataFrame:
    """The rows that a stream gives over accepted events in four batches in order of time."""
    columns = ("actor_email", "department", "event_id", "observed_at", "verb", "resource_id", "geo")
    events, root = written(accepted(spark, d).select(*columns), "accepted"), shared_path(spark, "context")
    _fed(_parts(events), f"{root}/in", lambda rows: start(rows, root))
    return spark.read.schema(schema).parquet(f"{root}/context").drop("batch")


@query("SELECT event_id, prior_events, prior_actions, prior_resource, prior_geos, geo_seen FROM context", "context")
def stream_context(spark, d):
    return _over_accepted(spark, d, service.start_context, service.CONTEXT)


@query("SELECT event_id, peer_resource FROM context", "context")
def stream_peer_context(spark, d):
    return _over_accepted(spark, d, service.start_peer_context, service.PEERS)


@query("SELECT 0::BIGINT AS differences FROM (SELECT count(*) FROM accepted)", "accepted")
def context_parity(spark, d):
    """Batch windows against the stream: rows that differ."""
    batch = context.detection_context(accepted(spark, d)).select("event_id", "prior_events", "prior_geos", "geo_seen").withColumn("prior_events", F.col("prior_events").cast("long")).withColumn("prior_geos", F.col("prior_geos").cast("long"))
    stream = _over_accepted(spark, d, service.start_context, service.CONTEXT).select("event_id", "prior_events", "prior_geos", "geo_seen")
    return transforms.parity(batch, stream).agg(F.count(F.lit(1)).alias("differences"))


@query("SELECT detection_id, event_id, score, severity FROM detections", "detections")
def stream_pipeline(spark, d):
    """The whole path in four batches, started again for each; equal to the batch path."""
    root = shared_path(spark, "service")
    _fed(_parts(adapter.raw_events(spark, d)), f"{root}/in", lambda rows: service.start(rows, root))
    return service.detections(spark, root).select("detection_id", "event_id", "score", "severity")


def run_dealt(spark: SparkSession, d: str, **how) -> str:
    """The whole path in four batches dealt by a hash, not by time, so that each has rows older than those before it; started again for each.

    Semantic duplicates come in one batch. ``how`` goes to ``service.start``. Returns the service's folder.
    """
    raw, root = adapter.raw_events(spark, d), shared_path(spark, "service")
    part = F.pmod(F.xxhash64("actor_email", "event_type", "resource_id", "observed_at"), F.lit(4))
    _fed([raw.where(part == i) for i in range(4)], f"{root}/in", lambda rows: service.start(rows, root, **how))
    return root


@query("SELECT detection_id, event_id, score, severity, array_to_string(reasons, ',') AS reasons FROM detections", "detections")
def stream_late_pipeline(spark, d):
    """Detections of batches with late rows, after all corrections."""
    root = run_dealt(spark, d)
    return service.detections(spark, root).select("detection_id", "event_id", "score", "severity", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT source, count(*) AS raw_events, count(*) FILTER (reason IS NOT NULL) AS dead_letters, count(*) FILTER (reason IS NULL AND received_at > observed_at + INTERVAL 12 HOUR) AS late_events, (SELECT count(*) FROM accepted a WHERE a.source = checked.source) AS accepted FROM checked GROUP BY source", "checked", "accepted")
def stream_statistics(spark, d):
    """Counts of all batches of the streamed path, summed."""
    root = shared_path(spark, "service")
    _fed(_parts(adapter.raw_events(spark, d)), f"{root}/in", lambda rows: service.start(rows, root))
    counted = service.table(spark, root, "stats").groupBy("source").agg(F.sum("raw_events").alias("raw_events"), F.sum("dead_letters").alias("dead_letters"), F.sum("late_events").alias("late_events"))
    kept = service.table(spark, root, "accepted").groupBy("source").agg(F.count(F.lit(1)).alias("accepted"))
    return counted.join(kept, "source", "left").fillna(0, ["accepted"])


_TABLES = """SELECT 'accessors' AS "table", resource_key AS k1, principal_key AS k2, source AS detail, access_count::DOUBLE AS n, round(accessor_weight, 9) AS weight FROM accessors
  UNION ALL SELECT 'history', principal_key, resource_key, strftime(window_start, '%Y-%m-%d %H:%M:%S'), 1, 1 FROM history
  UNION ALL SELECT 'static', principal_key, principal_id, concat_ws('|', department, role, location, employment_duration_bucket, privilege_level), 1, 1 FROM static
  UNION ALL SELECT 'collaboration', principal_key, collaborator_key, '', 1, round(co_access_weight, 9) FROM collaboration
  UNION ALL SELECT 'peers', principal_key, peer_key, peer_type, 1, round(peer_weight, 9) FROM peers"""


@query(_TABLES, "accessors", "history", "static", "collaboration", "peers")
def stream_feature_tables(spark, d):
    """All five feature tables as four batches with late rows left them, row by row in one form."""
    root, one = run_dealt(spark, d, tables=True), F.lit(1.0)
    now = service.features_now(spark, root, adapter.principals(spark, d), adapter.teams(spark, d))
    forms = {
        "accessors": ("resource_key", "principal_key", F.col("source"), F.col("access_count").cast("double"), F.round("accessor_weight", 9)),
        "history": ("principal_key", "resource_key", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), one, one),
        "static": ("principal_key", "principal_id", F.concat_ws("|", "department", "role", "location", "employment_duration_bucket", "privilege_level"), one, one),
        "collaboration": ("principal_key", "collaborator_key", F.lit(""), one, scalars.to_places("co_access_weight", 9)),
        "peers": ("principal_key", "peer_key", F.col("peer_type"), one, scalars.to_places("peer_weight", 9)),
    }
    rows = [now[name].select(F.lit(name).alias("table"), F.col(a).alias("k1"), F.col(b).alias("k2"), c.alias("detail"), n.alias("n"), w.alias("weight")) for name, (a, b, c, n, w) in forms.items()]
    return reduce(DataFrame.unionByName, rows)
