"""Vendor exports (one JSON object per line) as raw events of the contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OKTA = "uuid string, published string, ingested_at string, eventType string, actor struct<alternateId:string,displayName:string,department:string,role:string>, client struct<ipAddress:string,geographicalContext:struct<country:string,state:string>>, target array<struct<id:string,displayName:string,type:string>>, securityContext struct<isPrivileged:boolean>, debugContext struct<sensitivity:string>"
GWORKSPACE = "id struct<uniqueQualifier:string,time:string>, ingested_at string, activity string, visibility string, target_domain string, actor struct<email:string,profileName:string,department:string,role:string>, item struct<id:string,title:string,sensitivity:string>"
GITHUB = "id string, created_at string, ingested_at string, action string, actor struct<email:string,display_name:string,department:string,role:string>, repo struct<name:string,sensitivity:string>, transfer struct<mb:bigint>"
SNOWFLAKE = "QUERY_ID string, START_TIME string, INGESTED_AT string, QUERY_TYPE string, USER_NAME string, DISPLAY_NAME string, DEPARTMENT string, ROLE_NAME string, OBJECT_NAME string, SENSITIVITY string, WAREHOUSE_NAME string, ROWS_PRODUCED bigint"
SCHEMAS = {"okta": OKTA, "gworkspace": GWORKSPACE, "github": GITHUB, "snowflake": SNOWFLAKE}


def read_lines(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Records of a JSON-lines file, gzip too; lines that aren't JSON keep their text in ``_corrupt``."""
    return spark.read.schema(f"{SCHEMAS[source]}, _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def stream_lines(spark: SparkSession, path: str, source: str, files_at_once: int = 1) -> DataFrame:
    """The same for files as they come into a folder."""
    lines = spark.readStream.schema(f"{SCHEMAS[source]}, _corrupt string").option("maxFilesPerTrigger", files_at_once)
    return lines.json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def parsed(lines: DataFrame, source: str, column: str = "value") -> DataFrame:
    """Records of a text column of JSON."""
    return lines.select(F.from_json(column, SCHEMAS[source]).alias("r")).select("r.*")


def vendor_id(line: Column) -> Column:
    """The id in a line of JSON of any source: the first field that a source has, else ``unknown``; also of lines that no mapper takes."""
    at = lambda path: F.get_json_object(line, path)
    nested = F.startswith(F.ltrim(at("$.id")), F.lit("{"))
    own = F.when(nested, F.coalesce(at("$.id.uniqueQualifier"), F.lit("unknown"))).otherwise(at("$.id"))
    return F.coalesce(at("$.uuid"), own, at("$.QUERY_ID"), at("$.source_event_id"), F.lit("unknown"))


def _or(value: Column | str, default: str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(default))


def _raw(source: str, ids: tuple[str, str, str], actor: tuple[str, Column, str, str], kind: Column, resource: tuple[Column, Column, Column, Column], vendor_kind: str, **extras: Column) -> list[Column]:
    """The contract's columns, then what is special to the source. ``ids``: event id, time, time of ingestion."""
    event_id, at, ingested = ids
    email, name, department, role = actor
    resource_id, title, resource_kind, sensitivity = resource
    ts = lambda c: F.try_to_timestamp(c).cast("timestamp_ntz")
    return [
        F.lit(source).alias("source"), F.col(event_id).alias("source_event_id"), F.lit(None).cast("string").alias("integration_id"), ts(F.col(at)).alias("observed_at"), ts(F.coalesce(ingested, at)).alias("received_at"),
        F.col(email).alias("actor_email"), name.alias("actor_name"), _or(department, "unknown").alias("department"), _or(role, "unknown").alias("role"), kind.alias("event_type"),
        resource_id.alias("resource_id"), title.alias("resource_name"), resource_kind.alias("resource_kind"), sensitivity.alias("sensitivity"), F.col(vendor_kind).alias("vendor_event_type"), *(v.alias(k) for k, v in extras.items()),
    ]


def okta(df: DataFrame) -> DataFrame:
    """Session starts are logins; the first target is the resource."""
    target = F.try_element_at("target", F.lit(1))
    geo = F.concat_ws("-", _or("client.geographicalContext.country", "unknown"), _or("client.geographicalContext.state", "unknown"))
    kind = F.when(F.col("eventType") == "user.session.start", "login")
    resource = _or(target["id"], "okta:unknown"), _or(target["displayName"], "Unknown Resource"), _or(target["type"], "app"), _or("debugContext.sensitivity", "high")
    actor = "actor.alternateId", F.col("actor.displayName"), "actor.department", "actor.role"
    return df.select(*_raw("okta", ("uuid", "published", "ingested_at"), actor, kind, resource, "eventType", geo=geo, ip=_or("client.ipAddress", "unknown"), privileged=F.coalesce("securityContext.isPrivileged", F.lit(False))))


def gworkspace(df: DataFrame) -> DataFrame:
    """Views and shares; a share to outside is external."""
    outside = F.coalesce(F.col("visibility") == "external", F.lit(False))
    kind = F.when(F.col("activity").isin("view", "share"), F.when((F.col("activity") == "share") & outside, "share_external").otherwise("view"))
    resource = F.concat(F.lit("gworkspace:doc/"), "item.id"), F.col("item.title"), F.lit("document"), _or("item.sensitivity", "internal")
    actor = "actor.email", F.col("actor.profileName"), "actor.department", "actor.role"
    return df.select(*_raw("gworkspace", ("id.uniqueQualifier", "id.time", "ingested_at"), actor, kind, resource, "activity", external=outside, target_domain=F.col("target_domain")))


def github(df: DataFrame) -> DataFrame:
    """Repository views and archive downloads."""
    kind = F.when(F.col("action") == "repo.archive_download", "archive_download").when(F.col("action") == "repo.view", "view")
    resource = F.concat(F.lit("github:repo/"), "repo.name"), F.col("repo.name"), F.lit("repo"), _or("repo.sensitivity", "internal")
    actor = "actor.email", F.col("actor.display_name"), "actor.department", "actor.role"
    return df.select(*_raw("github", ("id", "created_at", "ingested_at"), actor, kind, resource, "action", bytes_transferred_mb=F.coalesce("transfer.mb", F.lit(0))))


def snowflake(df: DataFrame) -> DataFrame:
    """Queries; a copy is an export."""
    kind = F.when(F.col("QUERY_TYPE") == "COPY", "export").when(F.col("QUERY_TYPE") == "SELECT", "query")
    resource = F.concat(F.lit("snowflake:dataset/"), "OBJECT_NAME"), F.col("OBJECT_NAME"), F.lit("dataset"), _or("SENSITIVITY", "internal")
    actor = "USER_NAME", F.coalesce("DISPLAY_NAME", "USER_NAME"), "DEPARTMENT", "ROLE_NAME"
    return df.select(*_raw("snowflake", ("QUERY_ID", "START_TIME", "INGESTED_AT"), actor, kind, resource, "QUERY_TYPE", rows_read=F.coalesce("ROWS_PRODUCED", F.lit(0)), warehouse=_or("WAREHOUSE_NAME", "unknown")))


MAPPERS = {"okta": okta, "gworkspace": gworkspace, "github": github, "snowflake": snowflake}


def mapped(exports: dict[str, DataFrame]) -> DataFrame:
    """All sources' exports as raw events with ``mapping_error``: an unknown source or event type."""

    def one(source: str, df: DataFrame) -> DataFrame:
        if source not in MAPPERS:
            return df.select(F.lit(source).alias("source"), F.lit("unsupported_source").alias("mapping_error"))
        rows = MAPPERS[source](df)
        return rows.withColumn("mapping_error", F.when(F.col("event_type").isNull(), "unsupported_event_type"))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(s, df) for s, df in exports.items()])


def page(records: DataFrame, after: tuple[str, str] | None, limit: int) -> DataFrame:
    """The records after a cursor (time, id), in that order, one more than the limit to tell whether more follow."""
    if after is not None:
        at, last = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        records = records.where((F.col("observed_at") > at) | ((F.col("observed_at") == at) & (F.col("source_event_id") > last)))
    return records.orderBy("observed_at", "source_event_id").limit(limit + 1)


def page_rows(found: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page's own rows, and a row that tells whether more follow. ``found`` has a row more than the page if so."""
    return found.orderBy("observed_at", "source_event_id").limit(limit), found.agg((F.count(F.lit(1)) > limit).alias("has_more"))
