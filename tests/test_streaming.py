"""The keyed store, acceptance of batches, and the streamed path with late rows, against plain computations."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import context, features, normalize, rules
from vigil.plans import flows
from vigil.session import shared_path
from vigil.sources import adapter
from vigil.streaming import feature_tables, intake, service
from vigil.streaming import store as store_module
from vigil.streaming.store import KeyedStore, bloom, may_hold


def test_filter_has_no_false_negatives_and_few_false_positives():
    random = np.random.default_rng(5)
    for n in (1, 7, 5000):
        h = random.integers(-(2**63), 2**63, n)
        f = bloom(h)
        assert may_hold(f, h).all() and may_hold(f, random.integers(-(2**63), 2**63, 20_000)).sum() <= 1
        assert len(f) <= max(128, 8 * n)


SCHEMA = "key string, at timestamp_ntz, n long"


def day(i):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)


def asked(spark, keys):
    return spark.createDataFrame([(k, a, b) for k, a, b in keys], "key string, since timestamp_ntz, until timestamp_ntz")


def test_look_up_equals_a_join_and_opens_few_files(spark):
    store = KeyedStore(spark, shared_path(spark, "store"), "at", buckets=2, fan=3)
    rows, opened = [], []
    for batch in range(10):
        new = [(f"k{batch}-{i}", day(batch), i) for i in range(20)] + [("often", day(batch), batch)]
        wanted = [(k, None, None) for k, _, _ in rows[-45:-40] if k != "often"] + [("often", day(batch - 2), day(batch - 1)), ("never", None, None)]
        found, report = store.look_up(asked(spark, wanted), batch, SCHEMA)
        keys = {k for k, a, _ in wanted if a is None}
        assert sorted(map(tuple, found.collect())) == sorted(r for r in rows if r[0] in keys or (r[0] == "often" and day(batch - 2) <= r[1] <= day(batch - 1)))
        none, nothing = store.look_up(asked(spark, [("never", None, None), ("often", day(99), None)]), batch, SCHEMA)
        assert none.count() == 0 and nothing.opened == 0
        opened.append(report)
        store.append(spark.createDataFrame(new, SCHEMA), batch)
        rows += new
    # merges keep the number of files small; a look-up of recent keys doesn't open more as history grows
    assert max(o.live for o in opened) <= 2 * 3 * 3 and max(o.opened for o in opened[5:]) <= 5
    assert store.dead_files(9) and all("/batch=" in f for f in store.dead_files(9))
    # a batch that runs again leaves the same
    before, _ = store.look_up(asked(spark, [("often", None, None)]), 10, SCHEMA)
    n = before.count()
    store.append(spark.createDataFrame(rows[-21:], SCHEMA), 9)
    assert store.look_up(asked(spark, [("often", None, None)]), 10, SCHEMA)[0].count() == n == 10
    with pytest.raises(Exception):
        store.look_up(asked(spark, [("often", None, None)]), 12, SCHEMA)[0].count()  # a store that is lost isn't an empty one


def test_store_without_rows(spark):
    store = KeyedStore(spark, shared_path(spark, "store"), "at")
    store.append(spark.createDataFrame([], SCHEMA), 0)
    found, report = store.look_up(asked(spark, [("a", None, None)]), 1, SCHEMA)
    assert found.count() == 0 and report.opened == 0


def test_acceptance_puts_each_batch_in_one_result(spark):
    schema = "idempotency_key string, payload_sha256 string, at int"
    known = spark.createDataFrame([("a", "1", 0), ("b", None, 0), (None, "9", 0)], schema)
    given = [("a", "1", 1), ("a", None, 2), ("b", None, 3), ("b", "2", 4), (None, "9", 5), (None, None, 6), ("c", "3", 7), ("c", "3", 8), ("c", "4", 9), ("d", None, 10), ("d", None, 11), ("d", "5", 12)]
    parts = intake.accept_batches(spark.createDataFrame(given[::-1], schema), known, "at")
    assert [sorted(r.at for r in p.collect()) for p in parts] == [[7, 10], [1, 3, 5, 8, 11], [2, 4, 6, 9, 12]]
    assert [p.count() for p in intake.accept_batches(spark.createDataFrame(given, schema).limit(0), known, "at")] == [0, 0, 0]


def test_late_rows_are_corrected(spark, sf):
    """Batches in an order that is all late: the last days first."""
    raw, root = adapter.raw_events(spark, sf).where("actor_idx < 12").cache(), shared_path(spark, "service")
    expected = {r.detection_id: (r.event_id, r.score, r.severity, tuple(r.reasons)) for r in rules.detections(rules.scored(context.detection_context(normalize.normalized(raw)))).collect()}
    cuts = ["2024-01-21", "2024-01-11", "2024-01-01"]
    for number, (low, high) in enumerate(zip(cuts, ["2025-01-01", *cuts])):
        service.run_batch(raw.where((F.col("observed_at") >= F.lit(low).cast("timestamp_ntz")) & (F.col("observed_at") < F.lit(high).cast("timestamp_ntz"))), number, root)
    # the last batch once more, as after a failure
    service.run_batch(raw.where(F.col("observed_at") < F.lit(cuts[1]).cast("timestamp_ntz")), 2, root)
    found = {r.detection_id: (r.event_id, r.score, r.severity, tuple(r.reasons)) for r in service.detections(spark, root).collect()}
    assert found == expected and expected
    ops = service.table(spark, root, "detections")
    assert ops.where("op = 'delete'").count() > 0 and ops.where("late AND op = 'upsert'").count() >= 0
    # contexts after corrections equal the batch path's
    last = service._latest(spark.read.parquet(f"{root}/context").withColumn("version", F.col("batch")), "event_id").select("event_id", *service.COUNTS, "geo_seen")
    batch = context.detection_context(normalize.normalized(raw)).select("event_id", *(F.col(c).cast("long").alias(c) for c in service.COUNTS), "geo_seen")
    assert last.exceptAll(batch).count() == batch.exceptAll(last).count() == 0
    raw.unpersist()


def test_rows_in_order_open_no_scored_rows(spark, sf):
    raw, root = adapter.raw_events(spark, sf).where("actor_idx < 6").cache(), shared_path(spark, "service")
    for number, (low, high) in enumerate([("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2025-01-01")]):
        service.run_batch(raw.where((F.col("observed_at") >= F.lit(low).cast("timestamp_ntz")) & (F.col("observed_at") < F.lit(high).cast("timestamp_ntz"))), number, root)
    opened = {r.store: r.opened for r in service.table(spark, root, "look_ups").groupBy("store").agg(F.sum("opened").alias("opened")).collect()}
    assert opened["rows"] == 0
    assert service.table(spark, root, "detections").where("op = 'delete' OR late").count() == 0
    raw.unpersist()


EVENTS = "event_id string, observed_at timestamp_ntz, source string, principal_key string, resource_key string, actor_email string, department string, role string, geo string"


def accesses(n, seed):
    """Events over few keys with equal times, null and empty attributes, and a principal with a third of all rows."""
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        p = 0 if random.random() < 0.33 else int(random.integers(1, 9))
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=int(random.integers(0, 40)))
        text = lambda name: [None, "", f"{name}{int(random.integers(3))}"][int(random.integers(3))]
        rows.append((f"e{seed}-{i}", at, f"s{int(random.integers(2))}", f"p{p}", f"r{int(random.integers(6))}", f"u{p}@x", text("d"), text("role"), text("g")))
    return rows


def test_feature_tables_equal_those_of_all_events(spark):
    """In any order of batches, with an empty one, one that runs twice, and files that are merged meanwhile."""
    principals = spark.createDataFrame([(0, "u0@x", None, "d9", None, ""), (1, "u1@x", 0, None, "manager", "g1"), (2, "u2@x", 0, "", "", None)], "idx long, email string, manager_idx long, department string, role string, location string")
    teams = spark.createDataFrame([("t", [0, 1, 2])], "team string, member_indices array<long>")
    root, batches = shared_path(spark, "features"), [accesses(15, 1), [], accesses(40, 2), accesses(3, 3), accesses(25, 4), accesses(6, 5)]
    for number, rows in enumerate(batches):
        for _ in range(2 if number == 2 else 1):
            feature_tables.update(spark.createDataFrame(rows, EVENTS), number, root)
        if number in (2, 5):
            found = feature_tables.tables(spark, root, number, principals, teams)
            events = spark.createDataFrame([r for b in batches[: number + 1] for r in b], EVENTS).cache()
            static = features.static_profiles(events, principals)
            expected = {"accessors": features.accessors(events), "history": features.history(events), "static": static, "collaboration": features.collaboration(events), "peers": features.peer_groups(static, principals, teams)}
            assert set(found) == set(expected) == set(feature_tables.NAMES)
            for name, df in expected.items():
                plain = lambda t: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.select(df.columns).collect()), key=repr)
                assert plain(found[name]) == plain(df) and plain(df), name
            events.unpersist()


def test_changed_weights(spark):
    """Only pairs whose weight changes have a row; the changes lead from the weights before to those after."""
    schema = "key string, principal_key string, n long"
    was = {("r", "a"): 2, ("r", "b"): 5, ("r", "c"): 1, ("s", "a"): 1, ("s", "b"): 1, ("alone", "a"): 9}
    more = {("r", "a"): 1, ("s", "d"): 4, ("new", "b"): 2, ("new", "d"): 3, ("alone", "a"): 1}

    def weights(counts):
        out = {}
        for r in {k for k, _ in counts}:
            own = {p: n for (k, p), n in counts.items() if k == r}
            for x in own:
                for y in own:
                    if x != y:
                        out[x, y] = out.get((x, y), 0) + min(own[x], own[y]) / len(own)
        return out

    frame = lambda counts: spark.createDataFrame([(*k, n) for k, n in counts.items()], schema)
    found = {(r.key, r.collaborator_key): r.weight for r in feature_tables.changed_weights(frame(was), frame(more)).collect()}
    before, after = weights(was), weights({k: was.get(k, 0) + more.get(k, 0) for k in {*was, *more}})
    expected = {k: after[k] - before.get(k, 0) for k in after if abs(after[k] - before.get(k, 0)) > 1e-12}
    assert {k: round(v, 12) for k, v in found.items()} == {k: round(v, 12) for k, v in expected.items()}
    assert ("b", "c") not in found and ("a", "c") not in found  # r: b, c and the number of accessors are as before; of a and c the least is
    assert feature_tables.changed_weights(frame(was).limit(0), frame(more).limit(0)).count() == 0


def test_published_model_scores_what_it_knows(spark):
    """Pairs with both vectors and of the resource's own source, but for those left out; the others fall back to the rules."""
    vector = lambda x: [float(x), float((1 - x * x) ** 0.5)]
    resources = spark.createDataFrame([("r", "github", vector(1)), ("q", "okta", vector(0.6))], "resource_key string, source string, a array<double>")
    principals = spark.createDataFrame([("p", vector(0)), ("o", vector(1))], "principal_key string, c array<double>")
    left_out = spark.createDataFrame([("q", "o"), ("q", "o")], "resource_key string, principal_key string")
    policy = spark.createDataFrame([("github", 0.5, 0.9, "heldout:github", "x", 7), (None, 0.3, 0.4, "heldout", "y", None)], "source string, detection_threshold double, high_severity_threshold double, calibration_source string, calibration_reason string, pairs long")
    published = service.Published.publish(shared_path(spark, "published"), resources, principals, left_out, policy)
    rows = spark.createDataFrame(
        [("1", "r", "p", "github"), ("2", "r", "o", "github"), ("3", "r", "p", "okta"), ("4", "q", "p", "okta"), ("5", "q", "o", "okta"), ("6", "q", "z", "okta"), ("7", "r", "p", "github")],
        "event_id string, resource_key string, principal_key string, source string",
    ).withColumn("score", F.lit(0.1))
    found = {r.event_id: (r.model_score, r.policy_scope, r.detection_threshold) for r in published.scored(rows).collect()}
    assert found == {"1": (1.0, "github", 0.5), "2": (0.0, "github", 0.5), "3": (None, "global", 0.3), "4": (0.2, "global", 0.3), "5": (None, "global", 0.3), "6": (None, "global", 0.3), "7": (1.0, "github", 0.5)}
    assert published.scored(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        service.features_now(spark, shared_path(spark, "nothing"), rows, rows)


def test_files_of_a_bucket_are_cut_by_rows(spark, monkeypatch):
    """A batch of many rows goes to files of few, each with its filter; they are merged by batches, not by files."""
    monkeypatch.setattr(store_module, "MOST_ROWS", 50)
    monkeypatch.setattr(store_module, "CHUNK", 7)
    store = KeyedStore(spark, shared_path(spark, "store"), "at", buckets=2, fan=3)
    rows = [[(f"k{batch}-{i}", day(batch), i) for i in range(1000)] for batch in range(4)]
    for batch, new in enumerate(rows):
        store.append(spark.createDataFrame(new, SCHEMA), batch)
        live = [r.asDict() for r in store._listing(batch + 1).collect()]
        assert sum(f["rows"] for f in live) == 1000 * (batch + 1) and max(f["rows"] for f in live) <= 200
        assert {f["level"] for f in live} == ({0} if batch < 3 else {0, 1})
    wanted = [("k1-3", None, None), ("k3-999", None, None), *((f"never{i}", None, None) for i in range(40))]
    found, report = store.look_up(asked(spark, wanted), 4, SCHEMA)
    assert sorted(r.key for r in found.collect()) == ["k1-3", "k3-999"] and report.opened == 2 < report.live


def test_parts_of_a_stream_hold_every_row_in_many_files(spark, monkeypatch):
    monkeypatch.setattr(flows, "FILE_ROWS", 5)
    rows = spark.createDataFrame([(i, None if i == 0 else day(i % 30)) for i in range(100)], "i long, observed_at timestamp_ntz").coalesce(1)
    path, batches = shared_path(spark, "fed"), []

    def start(df):
        run = lambda part, number: batches.append((number, len(part.inputFiles()), [r.i for r in part.collect()]))
        return df.writeStream.foreachBatch(run).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()

    flows._fed(flows._parts(rows), path, start)
    assert [number for number, _, _ in batches] == [0, 1, 2, 3] and sorted(i for _, _, part in batches for i in part) == list(range(100))
    assert 0 in batches[0][2] and len(spark.read.parquet(path).inputFiles()) >= 20


def test_streamed_contexts_equal_batch_ones(spark):
    """Batches in order of time, with equal times, empty geographies and a principal with a third of all rows."""
    rows = spark.createDataFrame(accesses(150, 9), EVENTS).selectExpr("event_id", "observed_at", "actor_email", "department", "resource_key AS resource_id", "source AS verb", "geo").cache()
    root, cuts = shared_path(spark, "contexts"), ["2024-01-01 00:00", "2024-01-01 09:00", "2024-01-02 01:00", "2024-01-04 00:00"]
    parts = [rows.where(f"observed_at >= timestamp_ntz'{a}:00' AND observed_at < timestamp_ntz'{b}:00'") for a, b in zip(cuts, cuts[1:])]
    flows._fed(parts, f"{root}/in", lambda df: service.start_context(df, root))
    flows._fed(parts, f"{root}-p/in", lambda df: service.start_peer_context(df, f"{root}-p"))
    batch = context.detection_context(rows)
    for schema, path in ((service.CONTEXT, root), (service.PEERS, f"{root}-p")):
        found = spark.read.schema(schema).parquet(f"{path}/context").drop("batch")
        want = batch.select(*(F.col(f.name).cast(f.dataType) for f in found.schema))
        assert found.count() == 150 and found.exceptAll(want).count() == want.exceptAll(found).count() == 0
    rows.unpersist()


def test_batches_keep_no_pairs(spark):
    """Of accessors of one resource a batch keeps the counts; their pairs are made when the tables are read."""
    from vigil.session import children

    root = shared_path(spark, "features")
    one = [(f"e{i}", datetime.datetime(2024, 1, 1, 0, i), "s", f"p{i}", "r", f"u{i}@x", "d", "role", "g") for i in range(30)]
    for number in range(2):
        feature_tables.update(spark.createDataFrame(one[15 * number : 15 * number + 15], EVENTS), number, root)
    stores = children(spark, f"{root}/store/features")
    assert sum(spark.read.parquet(f"{root}/store/features/{name}/data").count() for name in stores) == 90
    principals = spark.createDataFrame([], "idx long, email string, manager_idx long, department string, role string, location string")
    found = feature_tables.tables(spark, root, 1, principals, spark.createDataFrame([], "team string, member_indices array<long>"))
    assert found["collaboration"].count() == 30 * 29


def test_stored_rows_move_once(spark, sf):
    """Whole stored rows go by event in one shuffle; finding one copy of each event takes none more."""
    root = flows.run_dealt(spark, sf)
    new = service.table(spark, root, "accepted").limit(40)
    _, (*_, cuts, stored, state) = service._in_context(service.Stores(spark, root), new, 4)
    try:
        once = stored.where("one")
        assert once.count() == stored.select("event_id").distinct().count() > 0
        tree = once._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in tree.split("InMemoryRelation")[0]
    finally:
        for frame in (cuts, stored, state):
            frame.unpersist()
