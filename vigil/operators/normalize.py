"""Raw events to normalized events: checks, dead letters, action mapping, keys, duplicates, lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.keys import entity_key, event_key, semantic_key
from vigil.functions.scalars import ISO, is_late, iso, nonempty, partition_value

#: Fixed values of the raw contract, in its order.
REQUIRED = ("source", "source_event_id", "observed_at", "actor_email", "actor_name", "department", "role", "event_type", "resource_id", "resource_name", "resource_kind", "sensitivity")
#: Fixed values: (source, event_type, verb, category, provider, source_kind).
ACTIONS = (
    ("okta", "login", "login", "authentication", "okta", "identity"),
    ("okta", "admin_change", "admin_change", "administration", "okta", "identity"),
    ("gworkspace", "view", "read", "access", "google-workspace", "document"),
    ("gworkspace", "share_external", "share_external", "sharing", "google-workspace", "document"),
    ("github", "view", "read", "access", "github", "repo"),
    ("github", "clone", "clone", "code_access", "github", "repo"),
    ("github", "archive_download", "archive_download", "code_access", "github", "repo"),
    ("snowflake", "query", "query", "data_access", "snowflake", "dataset"),
    ("snowflake", "export", "export", "data_access", "snowflake", "dataset"),
)
SOURCES = tuple(dict.fromkeys(a[0] for a in ACTIONS))


def registry(spark: SparkSession) -> DataFrame:
    """The action registry, nine rows."""
    return spark.createDataFrame(list(ACTIONS), "source string, event_type string, verb string, category string, provider string, source_kind string")


def missing_fields(df: DataFrame) -> Column:
    """Sorted array of required fields that are null or empty."""
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    return F.sort_array(F.array_compact(F.array(*(F.when(blank(c), c) for c in REQUIRED))))


def intake_reason(declared_source: Column) -> Column:
    """Why intake refuses a record, or null: id and time are needed, the source must be known and the declared one."""
    return (
        F.when(nonempty(F.col("source_event_id")).isNull(), "missing_source_event_id")
        .when(F.col("observed_at").isNull(), "missing_observed_at")
        .when(F.col("source") != declared_source, "source_mismatch")
        .when(~F.col("source").isin(*SOURCES), "unsupported_source")
    )


def checked(raw: DataFrame) -> DataFrame:
    """Adds the action columns and ``reason``, null for valid rows. Missing fields come before source, source before event type."""
    actions = F.broadcast(registry(raw.sparkSession))  # nine rows
    out = raw.join(actions, ["source", "event_type"], "left")
    missing = missing_fields(raw)
    reason = (
        F.when(F.size(missing) > 0, F.concat(F.lit("missing_required_fields:"), F.array_join(missing, ",")))
        .when(~F.col("source").isin(*SOURCES), "unsupported_source")
        .when(F.col("verb").isNull(), "unsupported_event_type")
    )
    return out.withColumn("reason", reason)


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and dead letters."""
    return df.where("reason IS NULL"), df.where("reason IS NOT NULL")


def keyed(valid: DataFrame) -> DataFrame:
    """Adds event and entity keys and ids."""
    out = valid.withColumn("event_key", event_key(F.col("source"), F.col("source_event_id"), F.col("integration_id")))
    out = out.withColumn("principal_key", entity_key("principal", F.col("source"), F.col("actor_email"), F.col("source")))
    out = out.withColumn("resource_key", entity_key("resource", F.col("source"), F.col("resource_id"), F.col("provider")))
    return out.withColumn("event_id", F.concat(F.lit("event::"), "event_key"))


def with_semantic_key(df: DataFrame) -> DataFrame:
    return df.withColumn("semantic_key", semantic_key(F.col("source"), F.col("actor_email"), F.col("event_type"), F.col("resource_id"), iso(F.col("observed_at"))))


def first_of(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key. Keys are hashed before the shuffle, so rows move by eight bytes of key."""
    by = Window.partitionBy(F.xxhash64(key), key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def deduplicated(valid: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Valid rows without semantic duplicates and then without known event keys; ``seen`` has both keys of earlier rows."""
    rows = with_semantic_key(valid)
    if seen is not None:
        rows = rows.join(seen.select("semantic_key"), "semantic_key", "left_anti").join(seen.select("event_key"), "event_key", "left_anti")
    order = (F.length("source_event_id"), F.col("source_event_id"))
    return rows.transform(first_of, "semantic_key", *order).transform(first_of, "event_key", *order)


def normalized(raw: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Accepted events of raw rows, flat, with lateness and partition columns."""
    valid, _ = split(checked(raw))
    out = deduplicated(keyed(valid), seen)
    return out.withColumn("late", is_late(F.col("received_at"), F.col("observed_at"))).withColumn("dt", F.date_format("observed_at", "yyyy-MM-dd")).withColumn("hour", F.date_format("observed_at", "HH")).withColumn("source_partition", partition_value(F.col("source")))


def residual_attributes(raw: DataFrame) -> Column:
    """Every raw field outside the contract as a map of texts, nulls left out."""
    extra = [c for c in raw.columns if c not in (*REQUIRED, "integration_id")]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, extra)), F.array(*(F.col(c).cast("string") for c in extra))), lambda k, v: v.isNotNull())


def nested(events: DataFrame) -> DataFrame:
    """The flat columns as the nested event."""
    c = F.col
    role = F.struct(c("role").alias("role"))
    entity = lambda k: F.concat(F.lit("entity::"), c(k))
    return events.select(
        "event_id", "event_key", "integration_id", "source", "source_event_id",
        F.struct(c("actor_email").alias("id"), entity("principal_key").alias("entity_id"), c("principal_key").alias("entity_key"), F.lit("human").alias("kind"), c("source").alias("provider"), c("actor_email").alias("email"), c("actor_name").alias("display_name"), "department", role.alias("attributes")).alias("principal"),
        F.struct(c("resource_id").alias("id"), entity("resource_key").alias("entity_id"), c("resource_key").alias("entity_key"), c("resource_kind").alias("kind"), "provider", c("resource_name").alias("name"), "sensitivity").alias("resource"),
        F.struct("source", "verb", "category").alias("action"),
        iso(c("observed_at")).alias("observed_at"),
        F.struct("source_kind").alias("environment"),
        residual_attributes(events.select(*(x for x in events.columns if x in ATTRIBUTES))).alias("attributes"),
        F.struct("source", c("source_event_id").alias("raw_event_id"), iso(c("observed_at")).alias("observed_at")).alias("evidence"),
    )


#: Raw fields that go to the attributes of the nested event.
ATTRIBUTES = ("received_at", "geo", "privileged", "external", "rows_read", "expected_transition", "role_change_window", "approved_travel", "incident_response_window", "incident_ticket", "quarter_close_window", "approved_workflow", "scenario")


def lake_rows(events: DataFrame, tenant: str = "default") -> DataFrame:
    """The event row of the lake: flat keys and the nested event as JSON."""
    whole = nested(events)
    c = F.col
    return whole.select(
        F.lit("event.v1").alias("normalized_schema_version"), F.lit(tenant).alias("tenant_id"), "source", F.coalesce("integration_id", F.lit("default")).alias("integration_id"), "observed_at", "event_id", "event_key", "source_event_id",
        c("principal.entity_key").alias("principal_entity_key"), c("resource.entity_key").alias("resource_entity_key"), c("action.source").alias("action_source"), c("action.verb").alias("action_verb"), c("action.category").alias("action_category"),
        F.to_json(F.struct(*whole.columns)).alias("payload_json"),
    )


def new_dead_letters(dead: DataFrame, counted: DataFrame) -> DataFrame:
    """Dead letters, once each, that earlier runs haven't counted. Both have source and source_event_id."""
    keys = ["source", "source_event_id"]
    return dead.dropDuplicates(keys).join(counted.select(*keys), keys, "left_anti")


def run_counters(raw: DataFrame, events: DataFrame) -> DataFrame:
    """One row: rows seen, dead letters (rows and distinct ids), accepted, duplicates skipped, late."""
    found = checked(raw).agg(
        F.count(F.lit(1)).alias("raw_events"),
        F.sum(F.col("reason").isNotNull().cast("long")).alias("dead_letters"),
        F.count_distinct(F.when(F.col("reason").isNotNull(), F.struct("source", "source_event_id"))).alias("dead_letter_ids"),
    )
    kept = events.agg(F.count(F.lit(1)).alias("accepted"), F.sum(F.col("late").cast("long")).alias("late"))
    return found.join(F.broadcast(kept)).withColumn("duplicates", F.col("raw_events") - F.col("dead_letters") - F.col("accepted"))


def envelopes(raw: DataFrame, tenant: str = "default", batch: str = "batch") -> DataFrame:
    """Raw envelope rows: the record as JSON with its place in the batch. A batch is an hour of a source, so that none grows with the table."""
    fields = [c for c in raw.columns if c not in ("received_at", "actor_idx")]
    hour = F.coalesce(F.date_format("received_at", "yyyyMMddHH"), F.lit("none"))
    place = Window.partitionBy("source", hour).orderBy(F.length("source_event_id"), "source_event_id")
    return raw.select(
        F.lit(1).alias("raw_envelope_version"), F.lit(tenant).alias("tenant_id"), "source", F.coalesce("integration_id", F.lit("default")).alias("integration_id"), F.lit("push").alias("intake_kind"),
        F.concat_ws("-", F.lit(batch), "source", hour).alias("batch_id"), iso(F.col("received_at")).alias("received_at"), (F.row_number().over(place) - 1).alias("record_ordinal"), F.lit("{}").alias("metadata_json"), F.to_json(F.struct(*fields), {"timestampNTZFormat": ISO}).alias("record_json"),
    )


def landed(envelope: DataFrame, schema: str) -> DataFrame:
    """Records of envelopes with the envelope's columns beside them; a record's own field wins."""
    rows = envelope.withColumn("r", F.from_json("record_json", schema))
    own = rows.select("r.*").columns
    pick = lambda c: F.coalesce(F.col(f"r.{c}").cast("string"), F.col(c)).alias(c) if c in own else F.col(c)
    outer = [pick(c) for c in ("source", "integration_id", "batch_id", "received_at", "record_ordinal")]
    rest = [F.col(f"r.{c}") for c in own if c not in ("source", "integration_id", "batch_id", "received_at", "record_ordinal")]
    return rows.select(*outer, F.sha2("record_json", 256).alias("object_sha256"), *rest)


def _case() -> str:
    return " ".join(f"WHEN source = '{s}' AND event_type = '{t}' THEN " + "{" + f"'verb': '{v}', 'category': '{c}', 'provider': '{p}', 'source_kind': '{k}'" + "}" for s, t, v, c, p, k in ACTIONS)


_MISSING = ", ".join(f"CASE WHEN {c} IS NULL OR {c}::VARCHAR = '' THEN '{c}' END" for c in REQUIRED)
_EVK = "'evk_' || substr(sha256(source || '|' || coalesce(integration_id, '') || '|' || source_event_id), 1, 24)"
SQL = {
    "checked": f"""
  SELECT c.* EXCLUDE (a, missing), a.verb AS verb, a.category AS category, a.provider AS provider, a.source_kind AS source_kind,
    CASE WHEN len(missing) > 0 THEN 'missing_required_fields:' || array_to_string(missing, ',')
      WHEN source NOT IN {SOURCES} THEN 'unsupported_source' WHEN a IS NULL THEN 'unsupported_event_type' END AS reason
  FROM (SELECT raw.*, CASE {_case()} END AS a, list_sort(list_filter([{_MISSING}], lambda x: x IS NOT NULL)) AS missing FROM raw) c""",
    "accepted": f"""
  SELECT *, strftime(observed_at, '%Y-%m-%d') AS dt, strftime(observed_at, '%H') AS hour, received_at > observed_at + INTERVAL 12 HOUR AS late FROM (
    SELECT *, 'event::' || {_EVK} AS event_id, {_EVK} AS event_key,
      'enk_' || substr(sha256('principal|' || source || '|' || source || '|' || actor_email), 1, 24) AS principal_key,
      'enk_' || substr(sha256('resource|' || source || '|' || provider || '|' || resource_id), 1, 24) AS resource_key,
      row_number() OVER (PARTITION BY source, actor_email, event_type, resource_id, observed_at ORDER BY length(source_event_id), source_event_id) AS nth
    FROM checked WHERE reason IS NULL) WHERE nth = 1""",
}
