"""Vendor exports as queries: raw events are written as the sources' JSON lines, read back and mapped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.keys import idempotency_key
from vigil.functions.scalars import iso
from vigil.plans.common import sql
from vigil.session import shared_path
from vigil.sources import adapter, vendor
from vigil.streaming import intake

QUERIES, SQL = {}, {}


def query(oracle: str, *needs: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql(oracle, *needs)
        return f

    return add


def _record(source: str):
    """The record that a source would export for a raw event; fields that it lacks are null and so left out."""
    at, ingested = iso(F.col("observed_at")), F.when(F.col("rows_read") % 2 == 1, iso(F.col("received_at")))
    role = F.when(F.col("role") != "engineer", F.col("role"))
    level = F.when(F.col("sensitivity") != "internal", F.col("sensitivity"))
    name = lambda *xs: F.struct(*(x.alias(n) for n, x in xs))
    actor = lambda mail, shown: name((mail, F.col("actor_email")), (shown, F.col("actor_name")), ("department", F.col("department")), ("role", role))
    if source == "okta":
        target = F.when(F.col("resource_id").isNotNull(), F.array(name(("id", F.col("resource_id")), ("displayName", F.col("resource_name")), ("type", F.when(F.col("privileged"), "group"))))).otherwise(F.array())
        geo = name(("geographicalContext", name(("country", F.when(~F.col("privileged"), F.col("geo"))), ("state", F.when(F.col("approved_travel"), "away")))))
        return name(("uuid", F.col("source_event_id")), ("published", at), ("ingested_at", ingested), ("eventType", F.when(F.col("event_type") == "login", "user.session.start").otherwise("user.privilege.grant")), ("actor", actor("alternateId", "displayName")), ("client", geo), ("target", target), ("securityContext", name(("isPrivileged", F.when(F.col("privileged"), True)))), ("debugContext", name(("sensitivity", level))))
    if source == "gworkspace":
        share = F.col("event_type") == "share_external"
        return name(("id", name(("uniqueQualifier", F.col("source_event_id")), ("time", at))), ("ingested_at", ingested), ("activity", F.when(share, "share").when(F.col("expected_transition"), "edit").otherwise("view")), ("visibility", F.when(share & ~F.col("privileged"), "external")), ("target_domain", F.when(share, "example.net")), ("actor", actor("email", "profileName")), ("item", name(("id", F.coalesce("resource_id", F.lit("none"))), ("title", F.col("resource_name")), ("sensitivity", level))))
    if source == "github":
        action = F.when(F.col("event_type") == "archive_download", "repo.archive_download").when(F.col("event_type") == "view", "repo.view").otherwise("repo.other")
        return name(("id", F.col("source_event_id")), ("created_at", at), ("ingested_at", ingested), ("action", action), ("actor", actor("email", "display_name")), ("repo", name(("name", F.col("resource_name")), ("sensitivity", level))), ("transfer", name(("mb", F.when(F.col("rows_read") % 3 == 0, F.col("rows_read"))))))
    kind = F.when(F.col("event_type") == "export", "COPY").when(F.col("approved_travel"), "MERGE").otherwise("SELECT")
    shown = F.when(F.col("rows_read") % 5 != 0, F.col("actor_name"))
    return name(("QUERY_ID", F.col("source_event_id")), ("START_TIME", at), ("INGESTED_AT", ingested), ("QUERY_TYPE", kind), ("USER_NAME", F.col("actor_email")), ("DISPLAY_NAME", shown), ("DEPARTMENT", F.col("department")), ("ROLE_NAME", role), ("OBJECT_NAME", F.col("resource_name")), ("SENSITIVITY", level), ("WAREHOUSE_NAME", F.when(F.col("privileged"), "main")), ("ROWS_PRODUCED", F.when(F.col("rows_read") % 3 == 0, F.col("rows_read"))))


def _export(spark: SparkSession, d: str, source: str, files: int | None = None) -> str:
    """Writes the source's export as gzip JSON lines, some of which are broken."""
    path = shared_path(spark, f"export-{source}")
    rows = adapter.raw_events(spark, d).where(F.col("source") == source)
    broken = F.col("rows_read") % 97 == 0
    lines = rows.select(F.when(broken, F.concat(F.lit("broken "), "source_event_id")).otherwise(F.to_json(_record(source))).alias("value"))
    (lines if files is None else lines.repartition(files)).write.option("compression", "gzip").text(path)
    return path


def _exported(spark: SparkSession, d: str, source: str) -> DataFrame:
    """The export, read back."""
    return vendor.read_lines(spark, _export(spark, d, source), source)


def _mapped(spark: SparkSession, d: str, source: str) -> DataFrame:
    rows = vendor.mapped({source: _exported(spark, d, source).where("_corrupt IS NULL").drop("_corrupt")})
    return rows.drop("integration_id")


_ROLE = "CASE WHEN role <> 'engineer' THEN role ELSE 'unknown' END"
_RECEIVED = "CASE WHEN rows_read % 2 = 1 THEN received_at ELSE observed_at END"
_COMMON = f"source, source_event_id, observed_at, {_RECEIVED} AS received_at, actor_email, actor_name, department, {_ROLE} AS role"
_BODIES = {
    "okta": f"""SELECT {_COMMON}, CASE WHEN event_type = 'login' THEN 'login' END AS event_type, coalesce(resource_id, 'okta:unknown') AS resource_id, CASE WHEN resource_id IS NULL THEN 'Unknown Resource' ELSE resource_name END AS resource_name,
  CASE WHEN resource_id IS NOT NULL AND privileged THEN 'group' ELSE 'app' END AS resource_kind, CASE WHEN sensitivity <> 'internal' THEN sensitivity ELSE 'high' END AS sensitivity,
  CASE WHEN event_type = 'login' THEN 'user.session.start' ELSE 'user.privilege.grant' END AS vendor_event_type, CASE WHEN privileged THEN 'unknown' ELSE geo END || '-' || CASE WHEN approved_travel THEN 'away' ELSE 'unknown' END AS geo, 'unknown' AS ip, privileged,
  CASE WHEN event_type <> 'login' THEN 'unsupported_event_type' END AS mapping_error FROM raw WHERE source = 'okta' AND rows_read % 97 <> 0""",
    "gworkspace": f"""SELECT {_COMMON}, CASE WHEN event_type = 'share_external' THEN CASE WHEN privileged THEN 'view' ELSE 'share_external' END WHEN NOT expected_transition THEN 'view' END AS event_type,
  'gworkspace:doc/' || coalesce(resource_id, 'none') AS resource_id, resource_name, 'document' AS resource_kind, sensitivity, CASE WHEN event_type = 'share_external' THEN 'share' WHEN expected_transition THEN 'edit' ELSE 'view' END AS vendor_event_type,
  event_type = 'share_external' AND NOT privileged AS external, CASE WHEN event_type = 'share_external' THEN 'example.net' END AS target_domain, CASE WHEN event_type <> 'share_external' AND expected_transition THEN 'unsupported_event_type' END AS mapping_error
  FROM raw WHERE source = 'gworkspace' AND rows_read % 97 <> 0""",
    "github": f"""SELECT {_COMMON}, CASE WHEN event_type IN ('archive_download', 'view') THEN event_type END AS event_type, 'github:repo/' || resource_name AS resource_id, resource_name, 'repo' AS resource_kind, sensitivity,
  CASE event_type WHEN 'archive_download' THEN 'repo.archive_download' WHEN 'view' THEN 'repo.view' ELSE 'repo.other' END AS vendor_event_type, CASE WHEN rows_read % 3 = 0 THEN rows_read ELSE 0 END AS bytes_transferred_mb,
  CASE WHEN event_type NOT IN ('archive_download', 'view') THEN 'unsupported_event_type' END AS mapping_error FROM raw WHERE source = 'github' AND rows_read % 97 <> 0""",
    "snowflake": f"""SELECT {_COMMON.replace("actor_name", "CASE WHEN rows_read % 5 <> 0 THEN actor_name ELSE actor_email END AS actor_name")}, CASE WHEN event_type = 'export' THEN 'export' WHEN NOT approved_travel THEN 'query' END AS event_type,
  'snowflake:dataset/' || resource_name AS resource_id, resource_name, 'dataset' AS resource_kind, sensitivity, CASE WHEN event_type = 'export' THEN 'COPY' WHEN approved_travel THEN 'MERGE' ELSE 'SELECT' END AS vendor_event_type,
  CASE WHEN rows_read % 3 = 0 THEN rows_read ELSE 0 END AS rows_read, CASE WHEN privileged THEN 'main' ELSE 'unknown' END AS warehouse, CASE WHEN event_type <> 'export' AND approved_travel THEN 'unsupported_event_type' END AS mapping_error
  FROM raw WHERE source = 'snowflake' AND rows_read % 97 <> 0""",
}


@query(_BODIES["okta"], "raw")
def vendor_okta(spark, d):
    return _mapped(spark, d, "okta")


@query(_BODIES["gworkspace"], "raw")
def vendor_gworkspace(spark, d):
    return _mapped(spark, d, "gworkspace")


@query(_BODIES["github"], "raw")
def vendor_github(spark, d):
    return _mapped(spark, d, "github")


@query(_BODIES["snowflake"], "raw")
def vendor_snowflake(spark, d):
    return _mapped(spark, d, "snowflake")


@query("SELECT source, coalesce(mapping_error, '') AS mapping_error, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT source, mapping_error FROM ({b})" for b in _BODIES.values()) + " UNION ALL SELECT 'error', 'unsupported_source' FROM raw WHERE source = 'error') GROUP BY ALL", "raw")
def vendor_dispatch(spark, d):
    """All exports through the mapper of their source, one of which has none."""
    exports = {s: _exported(spark, d, s).where("_corrupt IS NULL").drop("_corrupt") for s in vendor.MAPPERS}
    exports["error"] = adapter.raw_events(spark, d).where("source = 'error'")
    return vendor.mapped(exports).groupBy("source", F.coalesce("mapping_error", F.lit("")).alias("mapping_error")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source_event_id AS id, rows_read % 97 = 0 AS broken FROM raw WHERE source = 'github'", "raw")
def vendor_broken_lines(spark, d):
    """Lines that are no JSON keep their text."""
    rows = _exported(spark, d, "github")
    return rows.select(F.coalesce("id", F.substring_index("_corrupt", " ", -1)).alias("id"), F.col("_corrupt").isNotNull().alias("broken"))


@query(
    f"""WITH r AS (SELECT source_event_id, row_number() OVER (ORDER BY observed_at, source_event_id) - 1 AS n, count(*) OVER () AS size FROM ({_BODIES["okta"]}))
  SELECT source_event_id, n // 60 AS page, 'collector:export:okta:default:' || (n // 60 * 60) || ':' || least(size, n // 60 * 60 + 60) AS idempotency_key, (n // 60 + 1) * 60 < size AS has_more FROM r WHERE n < 180""",
    "raw",
)
def vendor_pages(spark, d):
    """Three pages, each after the last row of the one before, with the key under which a page is handed in."""
    records, after, out = _mapped(spark, d, "okta"), None, None
    for number in range(3):
        found = vendor.page(records, after, 60)
        rows, more = vendor.page_rows(found, 60)
        n = rows.count()
        key = idempotency_key(F.lit("collector"), F.lit("export"), F.lit("okta"), F.lit("default"), F.lit(str(60 * number)), F.lit(str(60 * number + n)))
        one = rows.select("source_event_id", F.lit(number).cast("long").alias("page"), key.alias("idempotency_key")).join(F.broadcast(more))  # one row
        out = one if out is None else out.unionByName(one)
        last = rows.agg(F.max(F.struct(F.col("observed_at").cast("string"), "source_event_id")).alias("x")).first().x  # the cursor
        if last is None:
            break
        after = tuple(last)
    return out


@query("SELECT source, CASE WHEN source IN ('okta', 'gworkspace', 'github', 'snowflake') OR rows_read % 2 = 0 THEN source_event_id ELSE 'unknown' END AS vendor_id, count(*) AS n FROM raw GROUP BY ALL", "raw")
def vendor_ids(spark, d):
    """The id of each exported line, from whichever field its source has; some lines of other sources have none."""
    line = F.to_json(F.struct(F.when(F.col("rows_read") % 2 == 0, F.col("source_event_id")).alias("source_event_id"), "source"))
    for source in vendor.MAPPERS:
        line = F.when(F.col("source") == source, F.to_json(_record(source))).otherwise(line)
    return adapter.raw_events(spark, d).groupBy("source", vendor.vendor_id(line).alias("vendor_id")).agg(F.count(F.lit(1)).alias("n"))


_MAPPED = " UNION ALL ".join(f"SELECT source, source_event_id, event_type, resource_id, received_at, mapping_error FROM ({b})" for b in _BODIES.values())


@query(f"{_MAPPED} UNION ALL SELECT source, source_event_id, NULL, NULL, NULL, 'not_json' FROM raw WHERE source IN {tuple(vendor.MAPPERS)} AND rows_read % 97 = 0", "raw")
def stream_vendor(spark, d):
    """Exports of all sources as streams of three files each, a file a batch; with the lines that aren't JSON."""
    parts = []
    for source in vendor.MAPPERS:
        root = shared_path(spark, f"mapped-{source}")
        intake.map_lines(vendor.stream_lines(spark, _export(spark, d, source, 3), source), source, root).awaitTermination()
        parts.append(spark.read.parquet(f"{root}/events").select("source", "source_event_id", "event_type", "resource_id", "received_at", "mapping_error"))
        null = lambda kind: F.lit(None).cast(kind)
        broken = spark.read.parquet(f"{root}/broken").select("source", F.substring("line", 8, 40).alias("source_event_id"))
        parts.append(broken.select("*", null("string").alias("event_type"), null("string").alias("resource_id"), null("timestamp_ntz").alias("received_at"), F.lit("not_json").alias("mapping_error")))
    return reduce(DataFrame.unionByName, parts)
