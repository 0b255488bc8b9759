"""Feature tables, statistics and capabilities as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import scalars
from vigil.operators import features, normalize, stats
from vigil.plans.common import accepted, feature_events, sql
from vigil.session import written
from vigil.sources import adapter

QUERIES, SQL = {}, {}


def query(oracle: str | None = None, *needs: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = sql(oracle, *needs)
        return f

    return add


def _static(spark, d):
    return features.static_profiles(accepted(spark, d), adapter.principals(spark, d))


@query("SELECT * FROM accessors", "accessors")
def accessor_weights(spark, d):
    return features.accessors(accepted(spark, d))


@query("SELECT principal_key, window_start::VARCHAR AS window_start, resource_key FROM history", "history")
def history_windows(spark, d):
    return features.history(accepted(spark, d)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT principal_key, count(*) AS n FROM history, (SELECT max(observed_at) AS m FROM accepted) WHERE window_start + INTERVAL 2 HOUR > m - INTERVAL 3 DAY AND window_start >= time_bucket(INTERVAL 2 HOUR, m - INTERVAL 3 DAY, TIMESTAMP '1970-01-01') + INTERVAL 2 HOUR GROUP BY ALL", "history", "accepted")
def history_trailing(spark, d):
    rows = features.history(accepted(spark, d), trailing_days=3)
    last = accepted(spark, d).agg(F.max("observed_at").alias("m"))
    first = F.window(F.col("m") - F.expr("INTERVAL 3 DAYS"), "2 hours")
    edge = last.select(first["end"].alias("edge"))
    return rows.join(F.broadcast(edge)).where("window_start >= edge").groupBy("principal_key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT principal_key, collaborator_key, round(co_access_weight, 9) AS co_access_weight FROM collaboration", "collaboration")
def co_access(spark, d):
    return features.collaboration(accepted(spark, d)).withColumn("co_access_weight", scalars.to_places("co_access_weight", 9))


@query("SELECT * FROM static", "static")
def static_latest(spark, d):
    return _static(spark, d)


@query("SELECT * FROM department_peers", "department_peers")
def department_peers(spark, d):
    return features.department_peers(_static(spark, d))


@query("SELECT * FROM manager_peers", "manager_peers")
def manager_peers(spark, d):
    return features.manager_peers(_static(spark, d), adapter.principals(spark, d))


@query("SELECT principal_key, peer_key, peer_type, round(peer_weight, 9) AS peer_weight FROM team_peers", "team_peers")
def team_peers(spark, d):
    return features.team_peers(_static(spark, d), adapter.principals(spark, d), adapter.teams(spark, d)).withColumn("peer_weight", scalars.to_places("peer_weight", 9))


@query("SELECT peer_type, count(*) AS n, count(DISTINCT principal_key) AS principals FROM peers GROUP BY ALL", "peers")
def peer_groups(spark, d):
    counts = features.peer_counts(written(_static(spark, d), "static"), written(adapter.principals(spark, d), "principals"), adapter.teams(spark, d))
    return counts.groupBy("peer_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("principals"))


@query("SELECT source, count(*) AS raw_events, max(observed_at) AS raw_last_seen, count(*) FILTER (reason IS NOT NULL) AS dead_letters, count(DISTINCT source_event_id) FILTER (reason IS NOT NULL) AS dead_letter_ids, (SELECT count(*) FROM accepted a WHERE a.source = c.source) AS normalized_events FROM checked c GROUP BY source", "checked", "accepted")
def source_stats(spark, d):
    raw = adapter.raw_events(spark, d)
    return stats.source_stats(normalize.checked(raw), normalize.normalized(raw)).select("source", "raw_events", "raw_last_seen", "dead_letters", "dead_letter_ids", "normalized_events")


@query("SELECT * FROM daily", "daily")
def daily_counts(spark, d):
    raw = adapter.raw_events(spark, d)
    return stats.daily_counts(normalize.checked(raw), normalize.normalized(raw))


@query("SELECT source, kind, count(*) AS days, max(n) AS most FROM daily GROUP BY ALL", "daily")
def daily_count_maps(spark, d):
    raw = adapter.raw_events(spark, d)
    maps = stats.as_maps(stats.daily_counts(normalize.checked(raw), normalize.normalized(raw)))
    return maps.select("source", "kind", F.size("counts").cast("long").alias("days"), F.array_max(F.map_values("counts")).alias("most"))


@query("SELECT * FROM recent", "recent")
def recent_counts(spark, d):
    raw = adapter.raw_events(spark, d)
    return stats.recent_counts(stats.daily_counts(normalize.checked(raw), normalize.normalized(raw)))


@query("SELECT source, array_to_string(fields, ',') AS fields FROM fields", "fields")
def seen_fields(spark, d):
    return stats.seen_fields(adapter.raw_events(spark, d)).select("source", F.array_join("fields", ",").alias("fields"))


_JOINED = "array_to_string(missing_event_types, ',') AS missing_event_types, array_to_string(missing_fields, ',') AS missing_fields"


def _matrix(spark, d):
    raw = adapter.raw_events(spark, d)
    return stats.capability(spark, normalize.checked(raw), raw, normalize.normalized(raw))


@query(f"SELECT source, display_name, {_JOINED}, (3 - len(missing_fields))::BIGINT AS covered_fields, raw_events, normalized_events, dead_letters, raw_24h, normalized_24h, dead_letter_7d FROM matrix", "matrix")
def capability_matrix(spark, d):
    return _matrix(spark, d).withColumn("covered_fields", F.col("covered_fields").cast("long")).withColumns({c: F.array_join(c, ",") for c in ("missing_event_types", "missing_fields")})


@query("SELECT source, (len(missing_event_types) + len(missing_fields) + (dead_letters > 0)::INT)::BIGINT AS issues, CASE WHEN raw_events = 0 THEN 'not seeded' WHEN len(missing_event_types) > 0 THEN 'blocked' WHEN len(missing_event_types) + len(missing_fields) + (dead_letters > 0)::INT > 0 THEN 'attention' ELSE 'healthy' END AS health FROM matrix ORDER BY issues DESC, source", "matrix")
def source_health(spark, d):
    return stats.health(_matrix(spark, d)).withColumn("issues", F.col("issues").cast("long")).orderBy(F.desc("issues"), "source")


@query(
    """SELECT 'batch-' || source || '-' || strftime(received_at, '%Y%m%d%H') AS batch_id, count(*) AS records, min(source_event_id) AS first_id, max(source_event_id) AS last_id, min(observed_at) AS first_observed, max(observed_at) AS last_observed,
  strftime(min(received_at), '%Y-%m-%dT%H:%M:%S.%fZ') AS first_received, 'up' AS upstream_batches, sha256(string_agg(source_event_id, '|' ORDER BY length(source_event_id), source_event_id)) AS digest FROM raw GROUP BY source, strftime(received_at, '%Y%m%d%H')""",
    "raw",
)
def batch_manifest(spark, d):
    rows = normalize.envelopes(adapter.raw_events(spark, d)).withColumn("metadata_json", F.lit('{"upstream_batch":"up"}'))
    found = stats.batch_manifest(rows).drop("last_received").withColumn("upstream_batches", F.array_join("upstream_batches", ","))
    return found.withColumns({c: scalars.parse_iso(F.col(c)).cast("timestamp_ntz") for c in ("first_observed", "last_observed")})


@query("SELECT c.source, count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason IS NOT NULL) AS invalid, array_to_string(list_sort(list_filter(any_value(c.required_event_types), lambda x: NOT list_contains(list(event_type) FILTER (reason IS NULL), x))), ',') AS missing_event_types FROM contract c JOIN checked k ON k.source = c.source GROUP BY c.source", "contract", "checked")
def fixture_report(spark, d):
    return stats.fixture_report(spark, normalize.checked(adapter.raw_events(spark, d))).withColumn("missing_event_types", F.array_join("missing_event_types", ","))


@query("SELECT source, source_event_id FROM raw, (SELECT max(observed_at) AS m FROM raw) WHERE observed_at < m - INTERVAL 20 DAY", "raw")
def raw_retention(spark, d):
    return stats.expired(adapter.raw_events(spark, d), 20).select("source", "source_event_id")


@query("SELECT 'principals' AS \"index\", count(DISTINCT x) AS n FROM (SELECT actor_email AS x FROM accepted UNION ALL SELECT 'entity::' || principal_key FROM accepted) UNION ALL SELECT 'resources', count(DISTINCT x) FROM (SELECT resource_id AS x FROM accepted UNION ALL SELECT 'entity::' || resource_key FROM accepted) UNION ALL SELECT 'departments', count(DISTINCT department) FROM accepted", "accepted")
def index_cardinalities(spark, d):
    return stats.index_cardinalities(accepted(spark, d))


#: Days of which cardinalities are asked.
RANGES = {"first_week": ("2024-01-01", "2024-01-07"), "ten_days": ("2024-01-05", "2024-01-14"), "all": ("2000-01-01", "2100-01-01")}


def _sql_exact(name: str, low: str, high: str) -> str:
    own = f"FROM accepted WHERE observed_at::DATE BETWEEN DATE '{low}' AND DATE '{high}'"
    both = lambda a, b: f"SELECT {a} AS x {own} UNION ALL SELECT 'entity::' || {b} {own}"
    parts = {"principals": both("actor_email", "principal_key"), "resources": both("resource_id", "resource_key"), "departments": f"SELECT department AS x {own}"}
    return " UNION ALL ".join(f"""SELECT '{name}' AS "range", '{i}' AS "index", count(DISTINCT x) AS exact, true AS within FROM ({q})""" for i, q in parts.items())


@query(" UNION ALL ".join(_sql_exact(n, *r) for n, r in RANGES.items()), "accepted")
def index_cardinality_ranges(spark, d):
    """Distinct references of ranges of days by merged daily sketches, held within 3 % of the exact numbers."""
    events = written(accepted(spark, d).select("observed_at", "actor_email", "principal_key", "resource_id", "resource_key", "department"), "events")
    sketches = written(stats.index_sketches(events), "sketches")
    ranges = spark.createDataFrame([(n, *r) for n, r in RANGES.items()], "name string, first string, last string").selectExpr("name", "to_date(first) AS first", "to_date(last) AS last")
    estimated = stats.cardinalities(sketches, ranges)
    exact = None
    for name, (low, high) in RANGES.items():
        one = stats.index_cardinalities(events.where(F.to_date("observed_at").between(F.to_date(F.lit(low)), F.to_date(F.lit(high))))).select(F.lit(name).alias("range"), "index", F.col("n").alias("exact"))
        exact = one if exact is None else exact.unionByName(one)
    return exact.join(estimated, ["range", "index"]).select("range", "index", "exact", (F.abs(F.col("n") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within"))


@query("SELECT t AS \"table\", n AS rows, t <> 'collaboration' AS required, true AS ready FROM (SELECT 'accessors' AS t, count(*) AS n FROM accessors UNION ALL SELECT 'history', count(*) FROM history UNION ALL SELECT 'static', count(*) FROM static UNION ALL SELECT 'collaboration', count(*) FROM collaboration UNION ALL SELECT 'peers', count(*) FROM peers)", "accessors", "history", "static", "collaboration", "peers")
def feature_readiness(spark, d):
    e, org = feature_events(spark, d), written(adapter.principals(spark, d), "principals")
    static = written(features.static_profiles(e, org), "static")
    peers = features.peer_counts(static, org, adapter.teams(spark, d)).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"))
    return features.readiness({"accessors": features.accessors(e), "history": features.history(e), "static": static}, counted={"collaboration": features.collaboration_size(e), "peers": peers})
