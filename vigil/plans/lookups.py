"""Look-ups, paging, reports, retries and change detection as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import scalars
from vigil.operators import evaluation, features, investigation, normalize, search, stats, tensors, transforms
from vigil.plans.common import accepted, detections, feature_events, scored, sql
from vigil.session import written
from vigil.sources import adapter
from vigil.streaming import intake

QUERIES, SQL = {}, {}


def query(oracle: str, *needs: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql(oracle, *needs)
        return f

    return add


_TIE = "('0x' || substr(sha256(event_id), 1, 16))::UBIGINT"


@query(f"SELECT event_id, (n - 1) // 40 AS page FROM (SELECT event_id, row_number() OVER (ORDER BY observed_at DESC, {_TIE} DESC) AS n FROM accepted) WHERE n <= 120", "accepted")
def event_search_after(spark, d):
    """Three pages, each after the last sort values of the one before."""
    rows, after, out = written(accepted(spark, d).select("event_id", "observed_at"), "events"), None, None
    for number in range(3):
        page = search.page_by_hash(rows, 40, after)
        one = page.select("event_id", F.lit(number).cast("long").alias("page"))
        out = one if out is None else out.unionByName(one)
        last = page.agg(F.min(F.struct(F.col("observed_at").cast("string"), "tie")).alias("x")).first().x  # the cursor
        if last is None:
            break
        after = (last[0], int(last[1]))
    return out


@query("SELECT event_id, source, source_event_id FROM accepted WHERE source_event_id = (SELECT min(source_event_id) FROM accepted)", "accepted")
def event_by_id(spark, d):
    rows = accepted(spark, d)
    wanted = rows.agg(F.min_by("event_id", "source_event_id")).first()[0]
    return search.by_id(rows, wanted).select("event_id", "source", "source_event_id")


@query("SELECT source, source_event_id, coalesce(received_at, observed_at) AS received FROM raw ORDER BY received DESC, source, source_event_id", "raw")
def raw_by_receipt(spark, d):
    return search.by_receipt(adapter.raw_events(spark, d)).select("source", "source_event_id", "received")


@query("SELECT event_id FROM accepted WHERE department = 'dept2' AND resource_name IN ('res1', 'res2', 'res3', 'res4') AND actor_email IN (SELECT actor_email FROM accepted WHERE privileged)", "accepted")
def postings_intersection(spark, d):
    rows = written(accepted(spark, d).select("event_id", "actor_email", "resource_name", "department", "privileged"), "events")
    people = rows.join(rows.where("privileged").select("actor_email").distinct(), "actor_email", "left_semi")
    return search.in_postings(rows, rows.where("department = 'dept2'"), rows.where("resource_name IN ('res1', 'res2', 'res3', 'res4')"), people).select("event_id")


@query("SELECT event_id FROM accepted WHERE department IN ('dept1', 'dept2', 'dept3') AND resource_id IN (SELECT resource_id FROM accepted WHERE verb = 'read') AND actor_email IN (SELECT actor_email FROM accepted WHERE privileged)", "accepted")
def postings_found(spark, d):
    """Events in three posting lists at once: of some departments, of resources that were read, and of people who were privileged once."""
    rows = written(accepted(spark, d).select("event_id", "actor_email", "resource_id", "department", "privileged", "verb"), "events")
    on = rows.where("verb = 'read'").select("resource_id").distinct()
    people = rows.where("privileged").select("actor_email").distinct()
    return search.in_postings(rows, rows.where("department IN ('dept1', 'dept2', 'dept3')"), rows.join(on, "resource_id", "left_semi"), rows.join(people, "actor_email", "left_semi")).select("event_id")


_CURSOR = "replace(replace(to_base64(encode('{\"observed_at\":\"' || strftime(observed_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '\",\"event_id\":\"' || event_id || '\"}')), '+', '-'), '/', '_')"


@query(f"SELECT event_id, {_CURSOR} AS cursor, event_id AS decoded, regexp_replace(resource_id || '(' || verb || ')', '([+^`:{{}}\"\\[\\]()~!\\\\*])', '\\\\\\1', 'g') AS escaped, ceil(epoch_us(observed_at) / 1e6)::BIGINT AS until FROM accepted", "accepted")
def cursors(spark, d):
    """Paging cursors, query escapes and the end of a range in whole seconds."""
    rows = accepted(spark, d)
    cursor = scalars.encode_cursor(F.struct(scalars.iso(F.col("observed_at")).alias("observed_at"), "event_id"))
    escaped = scalars.escape_query(F.concat("resource_id", F.lit("("), "verb", F.lit(")")))
    return rows.select("event_id", cursor.alias("cursor"), scalars.decode_cursor(cursor, "observed_at string, event_id string")["event_id"].alias("decoded"), escaped.alias("escaped"), scalars.epoch_ceiling(F.col("observed_at")).alias("until"))


@query("SELECT event_id FROM accepted WHERE observed_at >= TIMESTAMP '2024-01-03 04:05:07' AND observed_at < TIMESTAMP '2024-01-19 10:00:00'", "accepted")
def event_search_range(spark, d):
    """Events of a range whose bounds aren't whole seconds."""
    return search.within(accepted(spark, d), "2024-01-03 04:05:06.25", "2024-01-19 09:59:59.000001").select("event_id")


@query("SELECT source_event_id, privileged, rows_read, coalesce(incident_ticket, 'none') AS ticket, false AS wrong, '{\"event_type\":\"' || event_type || '\",\"source\":\"' || source || '\"}' AS canonical FROM raw", "raw")
def typed_attributes(spark, d):
    """Attributes of records by type, and JSON with sorted keys."""
    json = F.to_json(F.struct("source", "event_type", "privileged", "rows_read", "incident_ticket"))
    get = lambda *x: scalars.attribute(F.col("json"), *x)
    rows = adapter.raw_events(spark, d).withColumn("json", json)
    canonical = scalars.canonical_json(F.to_json(F.struct("source", "event_type")))
    return rows.select("source_event_id", get("privileged", "boolean", False).alias("privileged"), get("rows_read", "bigint", 0).alias("rows_read"), get("incident_ticket", "string", "none").alias("ticket"), get("rows_read", "boolean", False).alias("wrong"), canonical.alias("canonical"))


@query("SELECT count(*) AS n, bit_xor(('0x' || substr(md5(event_id), 1, 15))::BIGINT) AS hash FROM accepted", "accepted")
def input_signature(spark, d):
    return features.signature(accepted(spark, d), "event_id")


@query("WITH s AS (SELECT *, CASE WHEN score >= 0.9 THEN 'closed' ELSE 'open' END AS st FROM detections) SELECT source, count(*) FILTER (st = 'open') AS active FROM s GROUP BY source UNION ALL SELECT '__all__', count(*) FILTER (st = 'open') FROM s", "detections")
def active_detections(spark, d):
    found = written(detections(spark, d).select("detection_id", "source", "status", "score"), "detections")
    return investigation.active(investigation.with_state(found, found.where("score >= 0.9").select("detection_id", F.lit("closed").alias("status"))))


@query("SELECT count(*) AS total, count(*) > 30 AS has_more FROM detections WHERE score < 0.9", "detections")
def open_detection_total(spark, d):
    found = written(detections(spark, d).select("detection_id", "status", "score"), "detections")
    return investigation.page_info(investigation.with_state(found, found.where("score >= 0.9").select("detection_id", F.lit("closed").alias("status"))), 10, 20)


@query("SELECT d.detection_id, a.event_id, a.observed_at, a.event_id = d.event_id AS anchor FROM detections d JOIN accepted a ON a.event_id = d.event_id OR a.event_id IN (SELECT e.event_id FROM detections e WHERE e.principal_id = d.principal_id AND e.resource_id = d.resource_id)", "detections", "accepted")
def detection_events(spark, d):
    """Each detection with its events: here those of detections of its principal on its resource."""
    found = written(detections(spark, d).select("detection_id", "event_id", "principal_id", "resource_id"), "detections")
    listed = found.join(found.groupBy("principal_id", "resource_id").agg(F.collect_set("event_id").alias("event_ids")), ["principal_id", "resource_id"])
    return investigation.anchors(listed, accepted(spark, d))


@query(
    """WITH c AS (SELECT 'case-' || principal_id AS case_id, detection_id, event_id, severity = 'high' AS h, score >= 0.8 AS s FROM detections)
  SELECT case_id, array_to_string(list_sort(list(DISTINCT detection_id)), ',') AS detection_ids, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS timeline, count(DISTINCT event_id) AS evidence,
    count(DISTINCT event_id) FILTER (s) AS kept FROM c GROUP BY case_id""",
    "detections",
)
def merged_cases(spark, d):
    """Cases of strong detections merged with those of all."""
    found = written(detections(spark, d).select("detection_id", "event_id", "score", F.concat(F.lit("case-"), "principal_id").alias("case_id")), "detections")

    def grouped(rows: DataFrame, state: str) -> DataFrame:
        evidence = F.collect_set(F.struct(F.col("event_id").alias("object_key"), F.lit(state).alias("state")))
        return rows.groupBy("case_id").agg(F.collect_set("detection_id").alias("detection_ids"), F.collect_set("event_id").alias("timeline"), evidence.alias("evidence"))

    out = investigation.merged_cases(grouped(found.where("score >= 0.8"), "old"), grouped(found, "new"))
    kept = F.size(F.filter("evidence", lambda x: x["state"] == "old")).cast("long")
    return out.select("case_id", F.array_join("detection_ids", ",").alias("detection_ids"), F.array_join("timeline", ",").alias("timeline"), F.size("evidence").cast("long").alias("evidence"), kept.alias("kept"))


@query("SELECT count(*) AS sources, count(*) FILTER (normalized_events > 0) AS seeded_sources, count(*) FILTER (normalized_events > 0 AND len(missing_event_types) = 0 AND len(missing_fields) = 0 AND dead_letters = 0) AS contract_ready_sources, (SELECT count(*) FROM detections) AS detections, (SELECT string_agg(DISTINCT scenario, ',' ORDER BY scenario) FROM detections) AS scenarios FROM matrix", "matrix", "detections")
def report_metrics(spark, d):
    raw = adapter.raw_events(spark, d)
    return stats.report(stats.capability(spark, normalize.checked(raw), raw, normalize.normalized(raw)), detections(spark, d))


@query("SELECT source, source_event_id, reason FROM checked WHERE reason IS NOT NULL", "checked")
def fixture_invalid_rows(spark, d):
    return stats.invalid_rows(normalize.checked(adapter.raw_events(spark, d)))


@query("SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) AS events, coalesce(b.n, 0) AS dead_letters FROM (SELECT source, count(*) AS n FROM accepted GROUP BY source) a FULL JOIN (SELECT source, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY source) b ON a.source = b.source", "accepted", "checked")
def ops_metadata(spark, d):
    _, dead = normalize.split(normalize.checked(adapter.raw_events(spark, d)))
    return stats.ops_metadata(accepted(spark, d), dead)


@query("SELECT DISTINCT source, source_event_id FROM checked WHERE reason IS NOT NULL AND NOT starts_with(reason, 'missing')", "checked")
def new_dead_letters(spark, d):
    """Dead letters that an earlier run, of rows with missing fields, hasn't counted."""
    _, dead = normalize.split(normalize.checked(adapter.raw_events(spark, d)))
    counted = dead.where(F.startswith("reason", F.lit("missing")))
    return normalize.new_dead_letters(dead.unionByName(dead), counted).select("source", "source_event_id")


@query("SELECT source, count(*) AS n, round(avg(score), 9) AS mean FROM obs GROUP BY source", "obs")
def score_summary(spark, d):
    return evaluation.score_summary(evaluation.observations(scored(spark, d))).withColumn("mean", F.round("mean", 9))


@query("SELECT 'accessors' AS name, least(64, max(n)) AS \"limit\" FROM (SELECT count(*) AS n FROM accessors GROUP BY resource_key) UNION ALL SELECT 'history', least(64, max(n)) FROM (SELECT count(*) AS n FROM history GROUP BY principal_key, window_start)", "accessors", "history")
def padding_limits(spark, d):
    e = accepted(spark, d)
    one = lambda rows, by, column, name: tensors.padding_limits(rows.groupBy(*by).agg(F.collect_set(column).alias("x")), "x", 64).select(F.lit(name).alias("name"), F.col("limit").cast("long").alias("limit"))
    return one(features.accessors(e), ["resource_key"], "principal_key", "accessors").unionByName(one(features.history(e), ["principal_key", "window_start"], "resource_key", "history"))


_PADDED = "list_resize((list(t ORDER BY t))[1:4], 4, 0)"


@query(
    f"""WITH v AS (SELECT key, row_number() OVER (ORDER BY key) AS t FROM (SELECT DISTINCT resource_key AS key FROM history)), w AS (SELECT principal_key, window_start, {_PADDED} AS r, row_number() OVER (PARTITION BY principal_key ORDER BY window_start DESC) AS p FROM history JOIN v ON key = resource_key GROUP BY principal_key, window_start)
  SELECT principal_key AS principal, replace(list_resize(list(r ORDER BY window_start), 3, [0, 0, 0, 0])::VARCHAR, ' ', '') AS history FROM w WHERE p <= 3 GROUP BY principal_key""",
    "history",
)
def history_tensors(spark, d):
    h = features.history(accepted(spark, d))
    vocab = tensors.vocabulary(tensors.key_union([(h, "resource_key")]))
    rows = tensors.indexed(h, "resource_key", vocab, "idx").withColumnRenamed("principal_key", "principal")
    return tensors.history_tensors(rows, 3, 4).select("principal", F.to_json("history").alias("history"))


_KINDS = ", ".join(f"coalesce(any_value(x) FILTER (kind = '{k}'), [0, 0, 0, 0, 0])" for k in tensors.PEER_KINDS)


@query(
    f"""WITH p AS (SELECT principal_key, peer_key, 'department' AS kind FROM department_peers UNION ALL SELECT principal_key, peer_key, 'manager' FROM manager_peers UNION ALL SELECT principal_key, peer_key, 'group' FROM team_peers
    UNION ALL SELECT principal_key, collaborator_key, 'collaboration' FROM collaboration), t AS (SELECT principal_key, kind, list_resize((list(idx + 1 ORDER BY idx))[1:5], 5, 0) AS x FROM p JOIN vocab ON key = peer_key GROUP BY ALL)
  SELECT principal_key AS principal, replace([{_KINDS}]::VARCHAR, ' ', '') AS tokens FROM t GROUP BY principal_key""",
    "department_peers", "manager_peers", "team_peers", "collaboration", "vocab",
)
def peer_tensors(spark, d):
    """The first five peers of each of the four kinds, by number."""
    e, org = feature_events(spark, d), written(adapter.principals(spark, d), "principals")
    static, acc = written(features.static_profiles(e, org), "static"), written(features.accessors(e), "accessors")
    vocab = written(tensors.vocabulary(tensors.key_union([(acc, "principal_key"), (static, "principal_key")])), "vocabulary")
    first = {
        "department": features.first_department_peers(static, vocab, 5),
        "manager": tensors.indexed(features.manager_peers(static, org), "peer_key", vocab, "idx").withColumnRenamed("peer_weight", "weight"),
        "group": features.first_team_peers(features.team_members(static, org, adapter.teams(spark, d)), vocab, 5),
        "collaboration": features.first_collaborators(acc, vocab, 5),
    }
    rows = reduce(DataFrame.unionByName, [t.select(F.col("principal_key").alias("principal"), F.lit(k).alias("kind"), "idx", "weight") for k, t in first.items()])
    return tensors.peer_tensors(rows, 5).select("principal", F.to_json(F.transform("peers", lambda x: x["tokens"])).alias("tokens"))


@query("SELECT principal_key, coalesce(i, 0) AS role_idx FROM static LEFT JOIN (SELECT role AS r, row_number() OVER (ORDER BY role) AS i FROM (SELECT DISTINCT role FROM static WHERE role <> 'engineer')) ON r = role", "static")
def categorical_indices(spark, d):
    """Numbers of roles; those that the vocabulary lacks are 0."""
    static = features.static_profiles(accepted(spark, d), adapter.principals(spark, d))
    vocab = tensors.categorical_vocabulary(static.where("role <> 'engineer'"), "role").withColumnRenamed("value", "key")
    return tensors.indexed(static, "role", vocab, "role_idx", 0).select("principal_key", "role_idx")


@query("SELECT source_event_id, CASE WHEN source = 'okta' THEN 'dead' WHEN source = 'github' THEN 'late' ELSE 'good' END AS outcome, CASE WHEN source = 'okta' THEN 3 WHEN source = 'github' THEN 1 ELSE 0 END AS attempts FROM raw WHERE source <> 'error'", "raw")
def retries(spark, d):
    """A step that fails for one source always and for one the first time; three attempts, then a dead letter."""
    rows = transforms.with_metadata(adapter.raw_events(spark, d).select("source", "source_event_id"))
    rows = transforms.filtering(F.col("source") != "error")(rows)
    again, out = rows, []
    for attempt in range(3):
        tried = transforms.checking((F.col("source") != "okta") & ((F.col("source") != "github") | F.lit(attempt > 0)), "unavailable")(again)
        good, again, dead = transforms.retry_split(tried, 3)
        out += [good.withColumn("outcome", F.lit("late" if attempt else "good")), dead.withColumn("outcome", F.lit("dead"))]
    return reduce(DataFrame.unionByName, out).select("source_event_id", "outcome", "attempts")


@query("SELECT source = 'okta' AS dead, count(*) AS n FROM raw GROUP BY ALL", "raw")
def dead_letter_router(spark, d):
    rows = transforms.checking(F.col("source") != "okta", "refused")(transforms.with_metadata(adapter.raw_events(spark, d).select("source")))
    good, dead = transforms.split_dead(rows)
    return good.agg(F.count(F.lit(1)).alias("n")).select(F.lit(False).alias("dead"), "n").unionByName(dead.agg(F.count(F.lit(1)).alias("n")).select(F.lit(True).alias("dead"), "n"))


@query(
    """WITH b AS (SELECT 'batch-' || source || '-' || strftime(received_at, '%Y%m%d%H') AS idempotency_key, strftime(received_at, '%H')::INT AS h FROM raw GROUP BY ALL)
  SELECT CASE WHEN h % 3 = 0 THEN 'new' WHEN h % 3 = 1 THEN 'repeat' ELSE 'conflict' END AS kind, count(*) AS n FROM b GROUP BY ALL""",
    "raw",
)
def batch_acceptance(spark, d):
    """Batches against those accepted before: an hour in three is new, one the same again, one has another payload."""
    found = stats.batch_manifest(normalize.envelopes(adapter.raw_events(spark, d))).select(F.col("batch_id").alias("idempotency_key"), F.col("digest").alias("payload_sha256"))
    incoming = written(found, "batches")
    hour = F.substring("idempotency_key", -2, 2).cast("int") % 3
    known = incoming.where(hour > 0).withColumn("payload_sha256", F.when(hour == 2, F.lit("other")).otherwise(F.col("payload_sha256")))
    parts = zip(("new", "repeat", "conflict"), intake.accept_batches(incoming, known))
    return reduce(DataFrame.unionByName, [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in parts])


@query("SELECT count(*) AS fed, max(observed_at) AS watermark, (SELECT count(*) FROM accepted) AS indexed FROM accepted WHERE observed_at >= TIMESTAMP '2024-01-15'", "accepted")
def index_feed(spark, d):
    """Search documents that an index of the earlier ones lacks."""
    docs = written(search.documents(accepted(spark, d)), "documents")
    index = docs.where("observed_at < '2024-01-15'")
    fed = intake.index_feed(docs, index)
    out = fed.agg(F.count(F.lit(1)).alias("fed"), scalars.parse_iso(F.max("observed_at")).cast("timestamp_ntz").alias("watermark"))
    return out.join(F.broadcast(index.unionByName(fed).agg(F.count(F.lit(1)).alias("indexed"))))  # one row


@query("SELECT (SELECT count(*) FROM accepted) AS n, 2::BIGINT AS runs, (SELECT max(observed_at) FROM raw WHERE source <> 'okta') > (SELECT max(observed_at) FROM raw WHERE source = 'okta') AS stale", "accepted", "raw")
def recompute_decisions(spark, d):
    """A job over the events that runs at first, not over the same again, and over fewer again; and a run log's staleness."""
    rows, runs = written(accepted(spark, d).select("event_id", "source"), "events"), []
    last = None
    for df in (rows, rows, rows.where("source <> 'okta'")):
        last = intake.run_if_changed(features.signature(df, "event_id"), last, lambda: runs.append(1))
    log = adapter.raw_events(spark, d).groupBy(F.col("source").alias("job")).agg(F.max("observed_at").alias("finished_at"))
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("runs", F.lit(len(runs)).cast("long")).join(F.broadcast(intake.stale(log, "okta")))  # one row
