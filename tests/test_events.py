"""Small hand-made events with exact expectations."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from vigil.functions import keys, scalars
from vigil.operators import context, features, investigation, normalize, rules, tensors, transforms
from vigil.sources import vendor

BASE = {
    "source": "github", "integration_id": None, "actor_email": "ann@x.org", "actor_name": "Ann", "department": "eng", "role": "engineer", "event_type": "view", "resource_id": "repo1", "resource_name": "repo1", "resource_kind": "repo", "sensitivity": "high",
    "geo": None, "privileged": False, "external": False, "rows_read": 0, "expected_transition": False, "role_change_window": False, "approved_travel": False, "incident_response_window": False, "incident_ticket": None, "quarter_close_window": False, "approved_workflow": False, "scenario": None,
}
SCHEMA = (
    "source string, source_event_id string, integration_id string, observed_at timestamp_ntz, received_at timestamp_ntz, actor_email string, actor_name string, department string, role string, event_type string, resource_id string, resource_name string, resource_kind string, sensitivity string, "
    "geo string, privileged boolean, external boolean, rows_read long, expected_transition boolean, role_change_window boolean, approved_travel boolean, incident_response_window boolean, incident_ticket string, quarter_close_window boolean, approved_workflow boolean, scenario string"
)
NAMES = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]


def raw(spark, *rows):
    out = []
    for i, r in enumerate(rows):
        at = r.get("observed_at", dt.datetime(2024, 1, 1, 14) + dt.timedelta(minutes=i))
        out.append(tuple({**BASE, "source_event_id": f"e{i}", "received_at": at + dt.timedelta(minutes=1), **r, "observed_at": at}[n] for n in NAMES))
    return spark.createDataFrame(out, SCHEMA)


def test_known_event_key(spark):
    row = spark.range(1).select(keys.event_key(F.lit("okta"), F.lit("okta_evt_001")).alias("k")).first()
    assert row.k == "evk_a21e01a08fe9dd51bebd5310"


def test_reasons_in_order(spark):
    rows = raw(spark, {}, {"resource_id": None, "actor_name": ""}, {"source": "other"}, {"event_type": "push"}, {"source": "other", "role": None})
    reasons = {r.source_event_id: r.reason for r in normalize.checked(rows).collect()}
    assert reasons == {"e0": None, "e1": "missing_required_fields:actor_name,resource_id", "e2": "unsupported_source", "e3": "unsupported_event_type", "e4": "missing_required_fields:role"}


def test_duplicates_and_lateness(spark):
    at = dt.datetime(2024, 1, 1, 10)
    rows = raw(spark, {"observed_at": at}, {"observed_at": at}, {"observed_at": at, "resource_id": "repo2", "received_at": at + dt.timedelta(hours=13)})
    out = {r.source_event_id: r.late for r in normalize.normalized(rows).collect()}
    assert out == {"e0": False, "e2": True}
    seen = normalize.normalized(rows).select("semantic_key", "event_key")
    assert normalize.normalized(rows, seen).count() == 0


def scored(spark, *rows):
    return rules.scored(context.detection_context(normalize.normalized(raw(spark, *rows))))


def test_reads_then_archive_download(spark):
    found = rules.detections(scored(spark, {}, {}, {}, {"event_type": "archive_download", "resource_id": "repo9", "resource_name": "repo9"})).collect()
    assert [(d.scenario, d.severity) for d in found] == [("unusual_repo_export", "high")]
    assert found[0].feature_attributions["new_action_for_principal"] == 0.25 and "resource_is_rare_for_peer_group" in found[0].reasons


def test_approved_travel_suppresses(spark):
    rows = [{}, {}, {}, {"event_type": "archive_download", "resource_id": "repo9", "resource_name": "repo9", "approved_travel": True}]
    assert rules.detections(scored(spark, *rows)).count() == 0


def test_accessor_weights_and_windows(spark):
    e = normalize.normalized(raw(spark, {}, {}, {"actor_email": "bob@x.org", "observed_at": dt.datetime(2024, 1, 1, 16, 5)}))
    weights = sorted(r.accessor_weight for r in features.accessors(e).collect())
    assert [round(w, 6) for w in weights] == [0.333333, 0.666667]
    assert sorted(r.window_start.hour for r in features.history(e).collect()) == [14, 16]


def test_co_access(spark):
    rows = [{"resource_id": "a"}, {"resource_id": "a", "actor_email": "b@x"}, {"resource_id": "b"}, {"resource_id": "b", "actor_email": "b@x"}, {"resource_id": "b", "actor_email": "c@x"}]
    out = sorted(round(r.co_access_weight, 6) for r in features.collaboration(normalize.normalized(raw(spark, *rows))).collect())
    assert out == [0.333333] * 4 + [0.833333] * 2
    assert features.collaboration(normalize.normalized(raw(spark, *rows)), max_accessors=2).count() == 2


def test_overrides_and_peers(spark):
    e = normalize.normalized(raw(spark, {}, {"actor_email": "bob@x.org"}, {"actor_email": "cy@x.org"}))
    org = spark.createDataFrame([(1, "ann@x.org", 9, "sales", "executive", ""), (2, "bob@x.org", 9, None, None, "site1"), (3, "cy@x.org", 8, None, None, None), (9, "m", 7, None, None, None), (8, "n", 7, None, None, None)], "idx long, email string, manager_idx long, department string, role string, location string")
    static = features.static_profiles(e, org)
    ann = static.where("principal_id = 'ann@x.org'").first()
    assert (ann.department, ann.role, ann.privilege_level, ann.location, ann.employment_duration_bucket) == ("sales", "executive", "elevated", "unknown", "1-3yr")
    peers = features.manager_peers(static, org).collect()
    assert sorted(p.peer_weight for p in peers) == [0.5] * 4 + [1.0] * 2
    teams = spark.createDataFrame([("t", [1, 2]), ("u", [1, 2, 3]), ("v", [1])], "team string, member_indices array<long>")
    assert sorted(round(r.peer_weight, 4) for r in features.team_peers(static, org, teams).collect()) == [0.3333] * 4 + [0.8333] * 2


def test_cases_begin_anew_after_the_gap(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("d1", "p", at), ("d2", "p", at + dt.timedelta(hours=6)), ("d3", "p", at + dt.timedelta(hours=7)), ("d4", "q", at)]
    out = {r.detection_id: r.case_id for r in investigation.cases(spark.createDataFrame(rows, "detection_id string, principal_id string, observed_at timestamp_ntz")).collect()}
    assert out == {"d1": "case-d1", "d2": "case-d1", "d3": "case-d3", "d4": "case-d4"}


def test_vendor_exports(spark):
    line = '{"uuid":"u1","published":"2024-01-01T10:00:00Z","eventType":"user.session.start","actor":{"alternateId":"a@x","displayName":"A","department":"d","role":"r"},"client":{"ipAddress":"1.2.3.4","geographicalContext":{"country":"US"}},"target":[{"id":"app","displayName":"App","type":"Application"}],"securityContext":{"isPrivileged":true},"debugContext":{"sensitivity":"low"}}'
    lines = spark.createDataFrame([(line,), (line.replace("user.session.start", "other"),)], "value string")
    out = vendor.mapped({"okta": vendor.parsed(lines, "okta"), "zzz": lines.limit(1)}).collect()
    assert [(r.event_type, r.geo, r.privileged, r.mapping_error) for r in out] == [("login", "US-unknown", True, None), (None, "US-unknown", True, "unsupported_event_type"), (None, None, None, "unsupported_source")]


def test_pages_meet_every_row_once(spark):
    from vigil.operators import search

    e = normalize.normalized(raw(spark, *[{"resource_id": f"r{i}", "observed_at": dt.datetime(2024, 1, 1, i // 3)} for i in range(20)]))
    seen, cursor = [], None
    while True:
        rows = search.page(e, 6, cursor).collect()
        seen += [r.event_id for r in rows[:6]]
        if len(rows) <= 6:
            break
        cursor = (str(rows[5].observed_at), rows[5].event_id)
    assert len(seen) == len(set(seen)) == 20


def test_retries(spark):
    df = transforms.with_metadata(spark.range(3)).withColumn("reason", F.when(F.col("id") > 0, "bad")).withColumn("attempts", F.col("id").cast("int"))
    good, again, dead = transforms.retry_split(df, 3)
    assert [x.count() for x in (good, again, dead)] == [1, 1, 1]


def test_scalars(spark):
    r = spark.range(1).select(scalars.rounded(F.lit(0.285), 2).alias("a"), scalars.partition_value(F.lit(" A b/C ")).alias("b"), scalars.canonical_json(F.lit('{"b":1,"a":2}')).alias("c"), scalars.decode_cursor(scalars.encode_cursor(F.struct(F.lit("x").alias("k"))), "k string")["k"].alias("d"), scalars.escape_query(F.lit("a:b(c)")).alias("e"), scalars.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("f")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (0.28, "a_b_c", '{"a":2,"b":1}', "x", r"a\:b\(c\)", 1.0)


def test_tensors_have_fixed_lengths(spark):
    h = spark.createDataFrame([("p", i // 2, i) for i in range(9)], "principal string, window_start int, idx long")
    row = tensors.history_tensors(h, 3, 2).first()
    assert len(row.history) == 3 and all(len(w) == 2 for w in row.history) and row.history[-1] == [9, 0]
    p = spark.createDataFrame([("p", "manager", 4, 0.5), ("p", "group", 1, 0.25)], "principal string, kind string, idx long, weight double")
    peers = tensors.peer_tensors(p, 2).first().peers
    assert [x.tokens for x in peers] == [[0, 0], [5, 0], [2, 0], [0, 0]] and sum(sum(x.mask) for x in peers) == 2


def test_peers_are_counted_without_pairs(spark):
    """Counts and first peers against all pairs; a member that is listed twice, one without a profile, and two entries with one profile."""
    static = spark.createDataFrame([(f"p{i}", f"e{i}", f"d{i % 2}") for i in range(9)], "principal_key string, principal_id string, department string")
    org = spark.createDataFrame([(i, f"e{i % 11}", i // 3) for i in range(12)], "idx long, email string, manager_idx long")
    teams = spark.createDataFrame([("a", [0, 1, 2, 2, 9]), ("b", [1, 2, 3, 8, 7, 6]), ("c", [4]), ("d", [5, 9]), ("e", [0, 11, 7])], "team string, member_indices array<long>")
    pairs = features.peer_groups(static, org, teams)
    want = {(x.principal_key, x.peer_type): x.n for x in pairs.groupBy("principal_key", "peer_type").agg(F.count("*").alias("n")).collect()}
    assert {(x.principal_key, x.peer_type): x.n for x in features.peer_counts(static, org, teams).collect()} == want and want["p0", "group"] == 4
    numbers = spark.createDataFrame([(f"p{i}", 8 - i) for i in range(9)], "key string, idx long")
    for n in (1, 2, 5):
        first = lambda rows: {(k, i): round(w, 9) for k in {r[0] for r in rows} for i, w in sorted((i, w) for p, i, w in rows if p == k)[:n]}  # noqa: B023, E731
        found = features.first_team_peers(features.team_members(static, org, teams), numbers, n).collect()
        every = [(x.principal_key, 8 - int(x.peer_key[1:]), x.peer_weight) for x in features.team_peers(static, org, teams).collect()]
        assert first(found) == first(every)


def shuffled(plan) -> int:
    """Records that the shuffles of a plan that ran have written."""
    leaves, n = plan.collectLeaves(), 0
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName().endswith("QueryStageExec"):
            below = leaf.plan()
            if below.getClass().getSimpleName() == "ShuffleExchangeExec":
                n += below.metrics().apply("shuffleRecordsWritten").value()
            n += shuffled(below.children().head()) if below.children().size() == 1 else shuffled(below)
    return n


def test_department_peers_are_dealt_out(spark, monkeypatch):
    """Pairs of one large department come from several tasks, in runs, and equal all pairs; none without a key or a department."""
    monkeypatch.setattr(features, "PEERS", 16, raising=False)
    monkeypatch.setattr(features, "RUN", 3, raising=False)
    rows = [(f"p{i}", "d") for i in range(100)] + [("x", "e"), ("y", "e"), ("z", "f"), (None, "d"), ("n", None)]
    df = features.department_peers(spark.createDataFrame(rows, "principal_key string, department string")).withColumn("task", F.spark_partition_id())
    found = df.collect()
    want = sorted((a, b) for a, d in rows for b, e in rows if a and b and d and d == e and a != b)
    assert sorted((x.principal_key, x.peer_key) for x in found) == want and {(x.peer_type, x.peer_weight) for x in found} == {("department", 1.0)}
    own = [sum(x.task == t for x in found) for t in {x.task for x in found}]
    assert max(own) < len(found) / 2
    assert shuffled(df._jdf.queryExecution().executedPlan().executedPlan()) < len(found) / 4


def test_team_peers_without_shuffled_pairs(spark, monkeypatch):
    """Against all entries by hand: members twice in a team, two of one profile, one with two profiles, teams of one name, none and one member."""
    monkeypatch.setattr(features, "PEERS", 5, raising=False)
    monkeypatch.setattr(features, "RUN", 2, raising=False)
    static = [(f"p{i:02}", f"e{i}", "d") for i in range(40)] + [("p00b", "e0", "d")]
    org = [(i, f"e{i % 41}", 0) for i in range(44)] + [(7, "e8", 0), (7, "e7", 0), (9, "e30", 0)]
    teams = [("a", list(range(0, 44, 2))), ("b", list(range(0, 44, 3))), ("c", [1, 2, 2, 7, 8, 9, 42]), ("c", [3, 7, 9, 41, 0]), ("lone", [5]), ("none", []), (None, [1, 2]), ("whole", list(range(44)))]
    key = {e: max(k for k, x, _ in static if x == e) for _, e, _ in static}
    entries = [(t, len(m), i, key[e]) for t, m in teams if t and len(m) > 1 for i in m for j, e, _ in org if i == j and e in key]
    want = {}
    for t, n, i, p in entries:
        for u, _, j, q in entries:
            if t == u and i != j:
                want[p, q] = want.get((p, q), 0) + 1 / n
    frames = spark.createDataFrame(static, "principal_key string, principal_id string, department string"), spark.createDataFrame(org, "idx long, email string, manager_idx long"), spark.createDataFrame(teams, "team string, member_indices array<long>")
    found = features.team_peers(*frames).collect()
    assert len(found) == len(want) and {(x.principal_key, x.peer_key): round(x.peer_weight, 9) for x in found} == {k: round(v, 9) for k, v in want.items()}
    assert ("p00b", "p00b") in want and ("p07", "p08") in want
    monkeypatch.undo()
    plain = features.team_peers(frames[0].where("principal_key <> 'p00b'"), frames[1].where("idx < 40").distinct().where("idx = substr(email, 2)"), spark.createDataFrame([("t", list(range(40))), ("u", list(range(40)))], "team string, member_indices array<long>"))
    n = len(plain.collect())
    assert n == 40 * 39 and shuffled(plain._jdf.queryExecution().executedPlan().executedPlan()) < n / 4


def test_collaboration_by_blocks(spark, monkeypatch):
    """Blocks of three principals in stripes of two, against all pairs by hand; the number of rows without them."""
    monkeypatch.setattr(features, "BLOCK", 3)
    monkeypatch.setattr(features, "STRIPE", 2)
    rows = [(f"r{i * j % 5}", f"p{i}") for i in range(13) for j in range(7)] + [("lone", "p1"), ("r0", None)]
    events = spark.createDataFrame(rows, "resource_key string, principal_key string")
    counts, want = {}, {}
    for r, p in rows:
        counts.setdefault(r, {})[p] = counts.setdefault(r, {}).get(p, 0) + 1
    for own in counts.values():
        for x in own:
            for y in own:
                if x != y and x and y:
                    want[x, y] = want.get((x, y), 0) + min(own[x], own[y]) / len(own)
    found = features.collaboration(events)
    assert {(x.principal_key, x.collaborator_key): round(x.co_access_weight, 9) for x in found.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert features.collaboration_size(events).first().rows == len(want)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]


def test_queries_check_events_once(spark, sf):
    """Queries that need accepted events in several places read what was written."""
    from vigil.plans import registry

    for name in ("feature_set_round_trip", "feature_lake_round_trip", "department_scan"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "event_type" not in plan and "Window" not in plan, name


def test_detections_carry_no_other_columns(spark, sf, monkeypatch):
    """What large inputs write down for their context is what rules and detections need; detections are those of whole rows."""
    from vigil.plans import common

    given, plain = [], context.detection_context
    monkeypatch.setattr(context, "detection_context", lambda events: given.append(events.columns) or plain(events))
    narrow, whole = common.detections(spark, sf), rules.detections(common.scored(spark, sf))
    assert set(given[0]) == set(common.DETECTION_COLUMNS) < set(given[1]) and narrow.columns == whole.columns
    row = lambda df: df.drop("feature_attributions")
    assert row(narrow).exceptAll(row(whole)).count() == row(whole).exceptAll(row(narrow)).count() == 0 and narrow.count() > 0


def test_first_peers_of_departments_and_collaborators(spark):
    """First peers and their weights against all pairs; one alone in its department, one without others at its resource."""
    static = spark.createDataFrame([(f"p{i}", f"e{i}", f"d{i % 2}") for i in range(9)] + [("p9", "e9", "alone")], "principal_key string, principal_id string, department string")
    numbers = spark.createDataFrame([(f"p{i}", 9 - i) for i in range(10)], "key string, idx long")
    some = [(f"r{i * k % 4}", f"p{i}") for i in range(9) for k in range(1, 5)] + [("own", "p9")]
    when = F.lit("2024-01-01").cast("timestamp_ntz")
    events = spark.createDataFrame(some, "resource_key string, principal_key string").select("*", when.alias("observed_at"), F.lit("e").alias("event_id"), F.lit("okta").alias("source"))
    departments = [(x.principal_key, 9 - int(x.peer_key[1:]), x.peer_weight) for x in features.department_peers(static).collect()]
    together = [(x.principal_key, 9 - int(x.collaborator_key[1:]), x.co_access_weight) for x in features.collaboration(events).collect()]
    first = lambda rows, n: {(k, i): round(w, 9) for k in {r[0] for r in rows} for i, w in sorted((i, w) for p, i, w in rows if p == k)[:n]}
    for n in (1, 2, 5):
        assert first(features.first_department_peers(static, numbers, n).collect(), n) == first(departments, n)
        assert first(features.first_collaborators(features.accessors(events), numbers, n).collect(), n) == first(together, n)
    assert len(first(departments, 2)) == 18 and len(first(together, 1)) == 9


def test_peer_tensors_hold_all_four_kinds(spark, sf):
    import json

    from vigil.plans import registry

    kinds = [json.loads(x.tokens) for x in registry.queries()["peer_tensors"](spark, sf).collect()]
    assert all(any(sum(k[i]) for k in kinds) for i in range(4))


def test_weights_come_as_matrices(spark, monkeypatch):
    """Resources that many share by products, few by places, with any counts, in blocks that don't meet in parts; tasks hand over matrices, not pairs."""
    monkeypatch.setattr(features, "COLUMNS", 3)
    r = np.random.default_rng(6)
    rows = [(f"r{k}", f"p{i}", int(r.integers(1, 2 + k * 3))) for k in range(9) for i in range(60) if i % 3 == k % 3 and r.random() < (0.9 if k < 6 else 0.05)]
    counts = spark.createDataFrame(rows, "resource_key string, principal_key string, access_count long")
    by, want = {}, {}
    for k, p, c in rows:
        by.setdefault(k, {})[p] = c
    for own in by.values():
        for x in own:
            for y in own:
                if x != y:
                    want[x, y] = want.get((x, y), 0) + min(own[x], own[y]) / len(own)
    for block, dearer in ((4096, 40), (7, 40), (7, 0), (7, 10**9)):
        monkeypatch.setattr(features, "BLOCK", block)
        monkeypatch.setattr(features, "DEARER", dearer)
        found = features.weighed(counts)
        assert {(x.principal_key, x.collaborator_key): round(x.co_access_weight, 9) for x in found.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert "Generate" in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
