"""The given ``events`` table as raw events of the contract, and its organisation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import table


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw event per row, with a second copy of some under another id, as sources send them."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("et"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.unionByName(e.where("k % 10 = 5").withColumn("event_id", F.col("event_id") + 1_000_000_000))
    source = F.when(F.col("et") == "signup", "okta").when(F.col("et") == "view", "gworkspace").when(F.col("et") == "click", "github").when(F.col("et") == "purchase", "snowflake").otherwise("error")
    kind = F.expr(
        "CASE et WHEN 'signup' THEN IF(k % 10 = 9, 'admin_change', 'login') WHEN 'view' THEN IF(k % 4 = 0, 'share_external', 'view') "
        "WHEN 'click' THEN CASE WHEN k = 98 THEN 'push' WHEN k % 3 = 0 THEN 'archive_download' WHEN k % 3 = 1 THEN 'clone' ELSE 'view' END "
        "WHEN 'purchase' THEN IF(k % 2 = 0, 'export', 'query') ELSE 'error' END"
    )
    return e.select(
        source.alias("source"),
        F.col("event_id").cast("string").alias("source_event_id"),
        F.lit(None).cast("string").alias("integration_id"),
        F.col("ts").cast("timestamp_ntz").alias("observed_at"),
        F.expr("CAST(ts AS timestamp_ntz) + CASE WHEN k % 7 = 0 THEN make_dt_interval(0, k % 30, 0, 0) ELSE INTERVAL '2' MINUTE END").alias("received_at"),
        F.concat(F.lit("user"), "user_id", F.lit("@example.com")).alias("actor_email"),
        F.concat(F.lit("User "), "user_id").alias("actor_name"),
        F.concat(F.lit("dept"), F.col("user_id") % 8).alias("department"),
        F.expr("CASE user_id % 10 WHEN 0 THEN 'security-admin' WHEN 1 THEN 'manager' WHEN 2 THEN 'executive' WHEN 3 THEN 'staff-engineer' ELSE 'engineer' END").alias("role"),
        kind.alias("event_type"),
        F.when(F.col("k") != 99, F.concat("et", F.lit(":"), F.col("k") % 40)).alias("resource_id"),
        F.concat(F.lit("res"), F.col("k") % 40).alias("resource_name"),
        F.col("et").alias("resource_kind"),
        F.expr("CASE WHEN k >= 90 THEN 'critical' WHEN k >= 70 THEN 'high' ELSE 'internal' END").alias("sensitivity"),
        F.expr("concat('geo', (user_id + IF(k >= 80, k, 0)) % 7)").alias("geo"),
        F.expr("user_id % 10 = 0").alias("privileged"),
        F.expr("et = 'view' AND k % 4 = 0").alias("external"),
        F.floor(F.col("value") * 1000).cast("long").alias("rows_read"),
        F.expr("k % 20 = 3").alias("expected_transition"),
        F.lit(False).alias("role_change_window"),
        F.expr("k % 20 = 1").alias("approved_travel"),
        F.expr("k % 25 = 7").alias("incident_response_window"),
        F.expr("IF(k % 25 = 7, 'INC', NULL)").alias("incident_ticket"),
        F.expr("k % 25 = 8").alias("quarter_close_window"),
        F.expr("k % 25 = 8").alias("approved_workflow"),
        F.expr("CASE WHEN value >= 250 THEN 'slow_exfiltration' WHEN value >= 200 THEN 'account_takeover' ELSE 'baseline' END").alias("scenario"),
        F.col("user_id").alias("actor_idx"),
    )


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, email, manager_idx, department, role, location of every actor."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("idx")).distinct()
    return users.select(
        "idx",
        F.concat(F.lit("user"), "idx", F.lit("@example.com")).alias("email"),
        F.expr("CASE WHEN idx > 0 THEN CAST(floor((idx - 1) / 6) AS bigint) END").alias("manager_idx"),
        F.expr("CASE WHEN idx % 3 = 0 THEN concat('dept', idx % 5) END").alias("department"),
        F.lit(None).cast("string").alias("role"),
        F.expr("concat('site', idx % 4)").alias("location"),
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams with the numbers of their members."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("idx")).distinct()
    both = users.select(F.explode(F.array(F.concat(F.lit("a"), F.col("idx") % 12), F.concat(F.lit("b"), F.col("idx") % 5))).alias("team"), "idx")
    return both.groupBy("team").agg(F.sort_array(F.collect_list("idx")).alias("member_indices"))


#: The same as DuckDB's SQL, as common table expressions.
SQL = {
    "raw": """
  WITH e0 AS (SELECT event_id, ts, user_id, event_type AS et, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
  e AS (SELECT * FROM e0 UNION ALL SELECT event_id + 1000000000, ts, user_id, et, value, k FROM e0 WHERE k % 10 = 5)
  SELECT CASE et WHEN 'signup' THEN 'okta' WHEN 'view' THEN 'gworkspace' WHEN 'click' THEN 'github' WHEN 'purchase' THEN 'snowflake' ELSE 'error' END AS source,
    event_id::VARCHAR AS source_event_id, NULL::VARCHAR AS integration_id, ts AS observed_at,
    ts + CASE WHEN k % 7 = 0 THEN to_hours(k % 30) ELSE INTERVAL 2 MINUTE END AS received_at,
    'user' || user_id || '@example.com' AS actor_email, 'User ' || user_id AS actor_name, 'dept' || (user_id % 8) AS department,
    CASE user_id % 10 WHEN 0 THEN 'security-admin' WHEN 1 THEN 'manager' WHEN 2 THEN 'executive' WHEN 3 THEN 'staff-engineer' ELSE 'engineer' END AS role,
    CASE et WHEN 'signup' THEN CASE WHEN k % 10 = 9 THEN 'admin_change' ELSE 'login' END WHEN 'view' THEN CASE WHEN k % 4 = 0 THEN 'share_external' ELSE 'view' END
      WHEN 'click' THEN CASE WHEN k = 98 THEN 'push' WHEN k % 3 = 0 THEN 'archive_download' WHEN k % 3 = 1 THEN 'clone' ELSE 'view' END
      WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'export' ELSE 'query' END ELSE 'error' END AS event_type,
    CASE WHEN k <> 99 THEN et || ':' || (k % 40) END AS resource_id, 'res' || (k % 40) AS resource_name, et AS resource_kind,
    CASE WHEN k >= 90 THEN 'critical' WHEN k >= 70 THEN 'high' ELSE 'internal' END AS sensitivity,
    'geo' || ((user_id + CASE WHEN k >= 80 THEN k ELSE 0 END) % 7) AS geo, user_id % 10 = 0 AS privileged, et = 'view' AND k % 4 = 0 AS external,
    floor(value * 1000)::BIGINT AS rows_read, k % 20 = 3 AS expected_transition, false AS role_change_window, k % 20 = 1 AS approved_travel,
    k % 25 = 7 AS incident_response_window, CASE WHEN k % 25 = 7 THEN 'INC' END AS incident_ticket, k % 25 = 8 AS quarter_close_window, k % 25 = 8 AS approved_workflow,
    CASE WHEN value >= 250 THEN 'slow_exfiltration' WHEN value >= 200 THEN 'account_takeover' ELSE 'baseline' END AS scenario, user_id AS actor_idx FROM e""",
    "principals": """
  SELECT DISTINCT user_id AS idx, 'user' || user_id || '@example.com' AS email, CASE WHEN user_id > 0 THEN floor((user_id - 1) / 6)::BIGINT END AS manager_idx,
    CASE WHEN user_id % 3 = 0 THEN 'dept' || (user_id % 5) END AS department, NULL::VARCHAR AS role, 'site' || (user_id % 4) AS location FROM events""",
    "teams": """
  SELECT team, list(idx ORDER BY idx) AS member_indices FROM (SELECT DISTINCT 'a' || (user_id % 12) AS team, user_id AS idx FROM events
    UNION SELECT DISTINCT 'b' || (user_id % 5), user_id FROM events) GROUP BY team""",
}
