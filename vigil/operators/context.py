"""Context of each event from strictly earlier events, in order of time and then event id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators import prefix
from vigil.session import input_bytes

UNKNOWN_DEPARTMENT = "__unknown__"


#: Bytes of input up to which no principal can have more rows than a task may order.
MOST_BYTES = 256 << 20


def detection_context(events: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds the counters of prior history.

    Of an input of more than ``most_bytes`` one service account may have more rows than a task should order, so rows are
    cut into ranges of principal and time, and again of the department's resource and time (``prefix.ranks``). A smaller
    input is dealt out by principal once, and windows that add verb, resource or geography to it need no further shuffle.
    """
    rows = events.withColumn("_geo", F.nullif(F.col("geo"), F.lit(""))).withColumn("_dept", F.coalesce(F.nullif("department", F.lit("")), F.lit(UNKNOWN_DEPARTMENT)))
    size = input_bytes(events)
    rows = _by_windows(rows) if size is not None and size <= most_bytes else _by_ranges(rows)
    return rows.drop("_geo", "_dept")


def _by_ranges(rows: DataFrame) -> DataFrame:
    order = [F.col("observed_at"), F.col("event_id")]
    own = {"prior_events": [], "prior_actions": ["verb"], "prior_resource": ["resource_id"]}
    rows = prefix.ranks(rows, ["actor_email"], order, own, {"prior_geos": ("_geo", "geo_seen")})
    return prefix.ranks(rows, ["_dept", "resource_id"], order, {"peer_resource": []})


def _by_windows(rows: DataFrame) -> DataFrame:
    order = (F.col("observed_at"), F.col("event_id"))
    by = lambda *c: Window.partitionBy(*c).orderBy(*order)
    nth = lambda *c: F.row_number().over(by(*c))
    rows = rows.repartition("actor_email")
    rows = rows.withColumn("prior_events", nth("actor_email") - 1).withColumn("prior_actions", nth("actor_email", "verb") - 1)
    rows = rows.withColumn("prior_resource", nth("actor_email", "resource_id") - 1).withColumn("_geo_nth", nth("actor_email", "_geo"))
    first_geo = (F.col("_geo").isNotNull() & (F.col("_geo_nth") == 1)).cast("int")
    before = by("actor_email").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior_geos", F.coalesce(F.sum(first_geo).over(before), F.lit(0)))
    rows = rows.withColumn("geo_seen", F.col("_geo").isNotNull() & (F.col("_geo_nth") > 1))
    return rows.withColumn("peer_resource", nth("_dept", "resource_id") - 1).drop("_geo_nth")


SQL = {
    "context": f"""
  SELECT * EXCLUDE (geo_first), coalesce(sum(geo_first) OVER (PARTITION BY actor_email ORDER BY observed_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior_geos FROM (
    SELECT *, row_number() OVER (PARTITION BY actor_email ORDER BY observed_at, event_id) - 1 AS prior_events,
      row_number() OVER (PARTITION BY actor_email, verb ORDER BY observed_at, event_id) - 1 AS prior_actions,
      row_number() OVER (PARTITION BY actor_email, resource_id ORDER BY observed_at, event_id) - 1 AS prior_resource,
      row_number() OVER (PARTITION BY coalesce(nullif(department, ''), '{UNKNOWN_DEPARTMENT}'), resource_id ORDER BY observed_at, event_id) - 1 AS peer_resource,
      coalesce(geo, '') <> '' AND row_number() OVER (PARTITION BY actor_email, geo ORDER BY observed_at, event_id) > 1 AS geo_seen,
      CASE WHEN coalesce(geo, '') <> '' AND row_number() OVER (PARTITION BY actor_email, geo ORDER BY observed_at, event_id) = 1 THEN 1 ELSE 0 END AS geo_first
    FROM accepted)""",
}
