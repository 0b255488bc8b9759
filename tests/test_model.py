import numpy as np
from pyspark.sql import functions as F

from vigil.operators import model
from vigil.operators import evaluation, features, search, tensors
from vigil.plans.common import accepted, scored
from vigil.plans.model import ABLATIONS, QUERIES, _examples
from vigil.sources import adapter


def rows(r, fields, n, size):
    return [[[(int(r.integers(0, size)), float(r.random())) for _ in range(r.integers(0, 4))] for _ in range(fields)] for _ in range(n)]


def test_gradients_equal_finite_differences():
    r = np.random.default_rng(1)
    m = model.TwoTower(model.Tower((9,), 3, 5, 4), model.Tower((9, 7), 3, 5, 4, seed=5))
    for tower in (m.action, m.context):  # away from the bend of the hidden layer at empty sets
        tower.p["b1"] = r.normal(0, 0.5, 5)
    a, c = rows(r, 1, 6, 9), [rows(r, 2, 4, 7) for _ in range(6)]
    _, _, g_a, g_c = m.loss(a, c)
    for tower, g in ((m.action, g_a), (m.context, g_c)):
        for k, v in tower.p.items():
            for at in [tuple(int(r.integers(0, s)) for s in v.shape) for _ in range(4)]:
                was, step = v[at], 1e-6
                v[at] = was + step
                up = m.loss(a, c)[0]
                v[at] = was - step
                down = m.loss(a, c)[0]
                v[at] = was
                assert abs((up - down) / (2 * step) - g[k][at]) < 1e-4 * max(1, abs(g[k][at])), (k, at)


def test_packing_and_unit_length():
    r = np.random.default_rng(2)
    m = model.TwoTower(model.Tower((9,)), model.Tower((9, 7), seed=5))
    x = rows(r, 2, 5, 7)
    again = model.TwoTower.unpacked(m.packed())
    assert np.allclose(again.context.forward(x)[0], m.context.forward(x)[0])
    assert np.allclose(np.linalg.norm(m.context.forward(x)[0], axis=1), 1)


def test_training_lowers_the_loss_and_scores(spark, sf):
    examples, towers = _examples(spark, sf)
    trained, losses = model.train(examples.where("NOT held_out").drop("held_out"), towers, 4)
    assert len(losses) == 4 and losses[-1] < losses[0]
    scored = model.distances(examples.where("held_out").drop("held_out"), trained).persist()
    assert scored.where(F.exists("distances", lambda x: (x < 0) | (x > 1))).count() == 0
    metrics = {x.source: x for x in model.gate(model.retrieval(scored)).collect()}
    assert metrics["__all__"].pairs == scored.count() and 0 <= metrics["__all__"].win_rate <= 1
    assert all(0.05 <= x.detection_threshold <= 0.95 for x in model.calibrated(scored).collect())


def small_towers(spark):
    """80 accessors of one resource, 40 of another, contexts of two fields, and the same in NumPy."""
    acc = spark.createDataFrame([(f"r{k}", f"p{i}", 1.0 / n, "s") for k, n in ((0, 80), (1, 40)) for i in range(n)], "resource_key string, principal_key string, accessor_weight double, source string")
    people = spark.createDataFrame([(f"p{i}", i) for i in range(80)], "key string, idx long")
    fields = len(model.CONTEXT_FIELDS)
    sets = {f"p{i}": [[(i % 7, 0.5), (i % 5, 0.25)] if f == 0 else [(i % 3, 1.0)] if f == 5 else [] for f in range(fields)] for i in range(80)}
    context = spark.createDataFrame(list(sets.items()), f"principal_key string, context array<{model.SET}>")
    t = model.towers(model.members(acc, people, context))
    dense = model.TwoTower.unpacked(t.layers.packed())
    for tower, first, sizes in ((dense.action, 0, (80,)), (dense.context, 1, (7, *(80,) * (fields - 1)))):
        tower.sizes = sizes
        tower.p |= {f"e{f}": np.zeros((n, 8)) for f, n in enumerate(sizes)}
        for x in t.embeddings.collect():
            if (x.f == 0) == (first == 0):
                tower.p[f"e{x.f - first}"][x.i] = [x[f"e{j}"] for j in range(8)]
    actions = {f"r{k}": [[(i, 1.0 / n) for i in range(n)]] for k, n in ((0, 80), (1, 40))}
    pairs = [(f"r{i % 2}", f"p{i}", "s", [f"p{(i + j) % 80}" for j in (3, 11, 30)]) for i in range(40)]
    return t, dense, actions, sets, pairs, spark.createDataFrame(pairs, "resource_key string, principal_key string, source string, others array<string>")


def test_all_accessors_are_pooled(spark):
    t, dense, actions, _, _, _ = small_towers(spark)
    x = {r.key: r.x for r in model.pooled(t).where("side = 'a'").collect()}
    for k, (own,) in actions.items():
        assert np.allclose(x[k], sum(w * dense.action.p["e0"][i] for i, w in own))


def test_rounds_on_tables_equal_dense_rounds(spark):
    t, dense, actions, sets, pairs, rows = small_towers(spark)
    trained, losses = model.train(rows, t, 3)
    moments, want = {}, []
    for epoch in (1, 2, 3):
        total, _, g_a, g_c = dense.loss([actions[r] for r, *_ in pairs], [[sets[x] for x in (p, *o)] for _, p, _, o in pairs])
        want.append((total / len(pairs)) ** 0.5)
        for tower, own in ((dense.action, g_a), (dense.context, g_c)):
            for k, g in own.items():
                m, v = moments.get((id(tower), k), (0, 0))
                moments[id(tower), k] = m, v = 0.9 * m + 0.1 * g / len(pairs), 0.999 * v + 0.001 * (g / len(pairs)) ** 2
                tower.p[k] = tower.p[k] - 0.02 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    assert np.allclose(losses, want, rtol=1e-6)
    found = {(x.resource_key, x.principal_key): x.distances for x in model.distances(rows, trained).collect()}
    for r, p, _, o in pairs:
        a, c = dense.action.forward([actions[r]])[0][0], dense.context.forward([sets[x] for x in (p, *o)])[0]
        assert np.allclose(found[r, p], np.clip(1 - c @ a, 0, 1), atol=1e-4)


def test_all_pairs_are_scored(spark, sf):
    e = accepted(spark, sf)
    pairs = tensors.training_pairs(features.accessors(e), features.static_profiles(e, adapter.principals(spark, sf)))
    found = QUERIES["batch_model_scores"](spark, sf).persist()
    assert found.count() == pairs.count() and 0 < found.where("held_out").count() < found.count()
    rows = scored(spark, sf).limit(50).persist()
    policy = model.calibrated(found.where("held_out"))
    both = model.observations(rows, found.limit(found.count() // 2), policy).collect()
    assert len(both) == rows.count() and {x.scoring_mode for x in both} == {"model", "rules"}
    by_rules = {x.event_id: x.score for x in rows.collect()}
    assert all(abs(x.score - by_rules[x.event_id]) < 0.006 and x.threshold == 0.6 for x in both if x.scoring_mode == "rules")
    assert len(ABLATIONS) == 7 and "model_observations" in QUERIES


def test_embedding_equivalence_compares_two_ways(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "k long, e array<double>")
    assert [x.v for x in evaluation.numpy_units(rows, "k", "e", "v").orderBy("k").collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert evaluation.max_difference(rows.withColumnRenamed("e", "v"), evaluation.numpy_units(rows, "k", "e", "v"), "k", "v").first().max_difference > 3


def test_multi_scale_scores():
    e = np.eye(3)
    assert model.multi_scale(e[:0], np.array([])) == 0 and model.multi_scale(e[:1], np.array([0.4])) == 0.4
    assert model.multi_scale(np.repeat(e[:1], 5, axis=0), np.full(5, 0.7)) == 0.7  # copies add nothing
    assert abs(model.multi_scale(e, np.array([0.5, 0.6, 0.7])) - 1.8) < 1e-12  # three clusters
    near = np.array([[1, 0, 0], [0.99, 0.1411, 0], [0, 1, 0]])
    assert abs(model.multi_scale(near, np.array([0.2, 0.5, 0.3])) - 0.8) < 1e-12


def test_cluster_scores_equal_one_principal(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(40, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = r.random(40)
    data = [(i % 3, v[i].tolist(), float(s[i])) for i in range(40)] + [(0, v[0].tolist(), 0.0)]
    found = {x.principal: x.score for x in model.cluster_scores(spark.createDataFrame(data, "principal long, vector array<double>, score double")).collect()}
    for p in range(3):
        own = [i for i in range(40) if i % 3 == p]
        vectors, scores = v[own], s[own]
        if p == 0:
            vectors, scores = np.r_[vectors, v[:1]], np.r_[scores, 0.0]
        assert abs(found[p] - model.multi_scale(vectors, scores)) < 1e-9


def test_cluster_scores_in_blocks_equal_one_matrix(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(150, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = r.random(150)
    own = lambda i: (0, 1, None)[0 if i < 90 else 1 if i < 140 else 2]
    data = [(own(i), v[i].tolist(), float(s[i])) for i in range(150)] + [(0, v[0].tolist(), 0.0)] * 3
    df = spark.createDataFrame(data, "principal long, vector array<double>, score double")
    for most, delta in ((20, 0.3), (1, 0.3), (5, 0.05)):
        found = {x.principal: x.score for x in model.cluster_scores(df, delta, most_local=most, block=16).collect()}
        assert len(found) == 3
        for p in (0, 1, None):
            rows = [(np.array(x), y) for q, x, y in data if q == p]
            assert abs(found[p] - model.multi_scale(np.array([x for x, _ in rows]), np.array([y for _, y in rows]), delta)) < 1e-9


def test_peers_without_pairs_train_like_pairs(spark, sf):
    """Departments and collaborators by sums over groups, against every pair as a member of its context's set."""
    e, org = accepted(spark, sf).where("actor_idx < 14").cache(), adapter.principals(spark, sf)
    acc, static = features.accessors(e), features.static_profiles(e, org).cache()
    people = tensors.vocabulary(tensors.key_union([(acc, "principal_key"), (static, "principal_key")]))
    resources = tensors.vocabulary(tensors.key_union([(acc, "resource_key")]))
    vocabularies = {n: tensors.categorical_vocabulary(static, n) for n in model.CONTEXT_FIELDS[5:]}
    manager = features.manager_peers(static, org)
    context = model.contexts(static, features.history(e), manager, people, resources, vocabularies)
    together = features.collaboration(e).select("principal_key", F.col("collaborator_key").alias("peer_key"), F.lit("collaboration").alias("peer_type"), F.col("co_access_weight").alias("peer_weight"))
    paired = model.contexts(static, features.history(e), manager.unionByName(features.department_peers(static)).unionByName(together), people, resources, vocabularies)
    pairs = tensors.training_pairs(acc, static)
    profiled = tensors.vocabulary(tensors.key_union([(static, "principal_key")])).withColumnRenamed("key", "principal_key")
    rows = model.examples(pairs, tensors.negative_samples(pairs, profiled, 3)).cache()
    a = model.towers(model.members(acc, people, context), peers=model.peers_of(static, acc, people))
    b = model.towers(model.members(acc, people, paired))
    x, y = ({(r.side, r.key): r.x for r in model.pooled(t).collect()} for t in (a, b))
    assert x.keys() == y.keys() and all(np.allclose(x[k], y[k]) for k in x) and len({side for side, _ in x}) > 3
    (one, losses), (two, expected) = model.train(rows, a, 3), model.train(rows, b, 3)
    assert np.allclose(losses, expected, rtol=1e-9) and losses[-1] < losses[0]
    scores = [{(r.resource_key, r.principal_key): r.raw for r in model.distances(rows, t).collect()} for t in (one, two)]
    assert all(np.allclose(scores[0][k], scores[1][k], atol=1e-6) for k in scores[1])
    for f in (e, static, rows):
        f.unpersist()


def test_teams_are_pooled_without_pairs(spark):
    """Sums over teams against every pair of peers; a member listed twice counts twice, and one without a profile counts in the size."""
    static = spark.createDataFrame([(f"p{i}", f"e{i}") for i in range(9)], "principal_key string, principal_id string")
    org = spark.createDataFrame([(i, f"e{i}", None) for i in range(10)], "idx long, email string, manager_idx long")
    teams = spark.createDataFrame([("a", [0, 1, 2, 2, 9]), ("b", [1, 2, 3]), ("c", [4]), ("d", [5, 9]), ("e", [6, 7])], "team string, member_indices array<long>")
    numbers = spark.createDataFrame([(f"p{i}", i) for i in range(9)], "key string, idx long")
    peers = model.peers_of(static, None, numbers, ("department", "collaboration"), features.team_members(static, org, teams))
    values = spark.createDataFrame([(f"p{i}", float(i * i + 1)) for i in range(9)], "key string, v double")
    found = {x.key: x.v for x in peers.divided(model.GROUP, peers.spread(model.GROUP, values, ["v"]), ["v"]).collect()}
    pairs = features.team_peers(static, org, teams).collect()
    total = {}
    for x in pairs:
        total[x.principal_key] = total.get(x.principal_key, 0) + x.peer_weight
    want = {k: sum(x.peer_weight * (int(x.peer_key[1:]) ** 2 + 1) for x in pairs if x.principal_key == k) / w for k, w in total.items()}
    assert found.keys() == want.keys() == {"p0", "p1", "p2", "p3", "p6", "p7"} and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_contexts_hold_no_team_peers(spark, sf):
    """Members of sets grow with the events, not with a team's square."""
    _, towers = _examples(spark, sf)
    assert towers.members.where(F.col("f") == model.GROUP).isEmpty() and towers.peers.teams.count() > 0


def test_gate_has_a_case_for_each_reason(spark):
    good, bad = (0.5, 0.9, 0.2), (0.1, 0.9, 0.2)
    frame = lambda rows: spark.createDataFrame([(s, n, *m) for s, n, m in rows], "source string, pairs long, top_1 double, win_rate double, mean_margin double")
    judge = lambda rows, **more: model.activation(model.gate(frame(rows)), **more).first()
    both = [("__all__", 30, good), ("okta", 5, good), ("github", 9, good)]
    assert judge(both).eligible and judge(both).reason == "sampled_retrieval_gate_pass" and judge(both, training_pairs=9, final_loss=0.1).eligible
    cases = {
        "no_training_pairs": (both, {"training_pairs": 0, "final_loss": 0.1}), "final_loss_invalid": (both, {"training_pairs": 3, "final_loss": float("nan")}),
        "heldout_eval_missing": ([("__all__", 0, good)], {}), "sampled_top1_accuracy_below_threshold": ([("__all__", 30, bad), *both[1:]], {}),
        "pairwise_win_rate_below_threshold": ([("__all__", 30, (0.5, 0.5, 0.2)), *both[1:]], {}), "mean_margin_below_threshold": ([("__all__", 30, (0.5, 0.9, 0.0)), *both[1:]], {}),
        "source_gate_failed:github,okta": ([both[0], ("okta", 5, bad), ("github", 5, bad), ("snowflake", 5, good)], {}),
        "coverage_gate_failed:insufficient_covered_sources": ([*both[:2], ("github", 4, bad)], {}),
        "coverage_gate_failed:identity_source_coverage_missing": ([both[0], both[2], ("snowflake", 5, good)], {}),
        "coverage_gate_failed:resource_source_coverage_missing": ([*both[:2], ("other", 5, good)], {}),
    }
    for reason, (rows, more) in cases.items():
        found = judge(rows, **more)
        assert (found.eligible, found.reason) == (False, reason)
    assert judge(cases["final_loss_invalid"][0], training_pairs=3).covered == []


def test_policies_by_hand(spark):
    rows = [("__all__", 50, 0.2, 0.5, 0.52), ("okta", 3, 0.4, 0.3, 0.9), ("github", 2, 0.1, 0.2, 0.3), ("snowflake", 9, 0.98, 1.5, 1.6), ("gworkspace", 9, 0.01, 0.02, 0.9)]
    m = spark.createDataFrame(rows, "source string, pairs long, own_p95 double, other_p50 double, other_p90 double")
    found = {x.source: (x.detection_threshold, x.high_severity_threshold, x.calibration_source, x.calibration_reason.split("_")[0]) for x in model.policies(m).collect()}
    assert found == {
        None: (0.35, 0.52, "heldout", "heldout"), "okta": (0.6, 0.9, "heldout:okta", "fallback"),
        "snowflake": (0.99, 0.99, "heldout:snowflake", "heldout"), "gworkspace": (0.05, 0.9, "heldout:gworkspace", "heldout"),
    }
    events = spark.createDataFrame([("okta",), ("github",)], "source string")
    got = {x.source: (x.policy_scope, x.detection_threshold) for x in model.policy_of(events, model.policies(m)).collect()}
    assert got == {"okta": ("okta", 0.6), "github": ("global", 0.35)}
    assert {x.detection_threshold for x in model.policy_of(events, model.policies(m).limit(0)).collect()} == {0.6}


def greedy(vectors, sizes, delta):
    """The closest two clusters merge, one pair at a time."""
    clusters = [([i], float(n)) for i, n in enumerate(sizes)]
    cosine = np.clip(1 - vectors @ vectors.T, 0, 2)
    far = lambda a, b: sum(sizes[i] * sizes[j] * cosine[i, j] for i in a[0] for j in b[0]) / (a[1] * b[1])
    while len(clusters) > 1:
        d, i, j = min((far(clusters[i], clusters[j]), i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters)))
        if d > delta:
            break
        b = clusters.pop(j)
        clusters[i] = (clusters[i][0] + b[0], clusters[i][1] + b[1])
    return {tuple(sorted(c)) for c, _ in clusters}


def test_chain_of_neighbours_equals_closest_first():
    import time

    r = np.random.default_rng(8)
    for n in (1, 2, 3, 25, 40):
        for delta in (0.05, 0.3, 0.8, 2.0):
            v = r.normal(size=(n, 3))
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            sizes = r.integers(1, 6, n)
            label = model.average_linkage(v, sizes, delta)
            assert {tuple(np.flatnonzero(label == c).tolist()) for c in np.unique(label)} == greedy(v, sizes, delta)
    v = r.normal(size=(2048, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    began = time.perf_counter()
    model.average_linkage(v, np.ones(2048), 0.4)
    assert time.perf_counter() - began < 10  # about 1 s on an idle core


def test_forward_pass_by_expressions(spark):
    """As NumPy's, with a zero row; rows of a side without layers are left out; no rows give none."""
    layers = model.TwoTower(model.seeded_tower("a", 1, 3), model.seeded_tower("c", 2, 3), {"okta": model.seeded_tower("a|okta", 1, 3)})
    random = np.random.default_rng(4)
    rows = [(side, f"k{i}", random.normal(size=8 * (2 if side == "c" else 1)).tolist()) for i, side in enumerate(["a", "c", "a|okta"] * 5)] + [("c", "zero", [0.0] * 16)]
    x = spark.createDataFrame(rows, "side string, key string, x array<double>")
    table = model.layer_table(spark, layers)
    plain = lambda df: {(r.side, r.key): r.u for r in df.collect()}
    found, expected = plain(model.units_by_expressions(x.unionByName(x.where("key = 'zero'").withColumn("side", F.lit("none"))), table)), plain(model.units(x, layers))
    assert found.keys() == expected.keys() and len(found) == 16
    assert max(np.abs(np.array(found[k]) - np.array(expected[k])).max() for k in found) < 1e-12
    assert model.units_by_expressions(x.limit(0), table).count() == 0


def test_range_of_whole_seconds(spark):
    times = ["2024-01-01 00:00:00", "2024-01-01 00:00:00.5", "2024-01-01 00:00:01", "2024-01-01 00:00:01.9", "2024-01-01 00:00:02"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(times)] + [("none", None)], "event_id string, t string").withColumn("observed_at", F.col("t").cast("timestamp_ntz"))
    ids = lambda since, until: [r.event_id for r in search.within(rows, since, until).orderBy("event_id").collect()]
    assert ids("2024-01-01 00:00:00.1", None) == ["2", "3", "4"] and ids("2024-01-01 00:00:01", "2024-01-01 00:00:01.000001") == ["2", "3"]
    assert ids(None, "2024-01-01 00:00:01") == ["0", "1"] and ids(None, None) == ["0", "1", "2", "3", "4", "none"] and ids("2025-01-01", "2024-01-01") == []


def test_a_vector_goes_to_few_blocks(spark, monkeypatch):
    """However many vectors a principal has: each is dealt to a bounded number of blocks, compared in stripes, and nearest ones are those of all pairs."""
    monkeypatch.setattr(model, "STRIPE", 3)
    random = np.random.default_rng(8)
    v = random.normal(size=(200, 3))
    v = np.concatenate([v, v[:20]])  # equal distances
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([("p", i, x.tolist()) for i, x in enumerate(v)], "principal string, id long, v array<double>")
    found = {r.id: (r.d, r.other) for r in model._nearest(df, 4).collect()}
    d = np.clip(1 - v @ v.T, 0, 2)
    np.fill_diagonal(d, np.inf)
    assert len(found) == 220 and all(abs(found[i][0] - d[i].min()) < 1e-12 and d[i][found[i][1]] - d[i].min() < 1e-12 for i in range(220))
    dealt = model._dealt(df, 4).groupBy("id").count().agg(F.max("count")).first()[0]
    assert dealt == model.MOST_BLOCKS < 220 / 4


def test_principal_scores_have_every_active_principal(spark, sf):
    """All pairs are in the clusters, whichever source their resource is of."""
    rows, towers = _examples(spark, sf)
    unit = {(r.side != "c", r.key): np.array(r.u) for r in model.units(model.pooled(towers), towers.layers).collect()}
    pairs = rows.select("principal_key", "resource_key").distinct().collect()
    want = {}
    for p, r in pairs:
        want.setdefault(p, []).append((unit[True, r], min(1.0, max(0.0, 1 - unit[True, r] @ unit[False, p]))))
    found = {x.principal: x.score for x in QUERIES["principal_scores"](spark, sf).collect()}
    assert found.keys() == want.keys() and len(found) > 10
    assert all(abs(found[p] - model.multi_scale(np.stack([v for v, _ in x]), np.array([s for _, s in x]))) < 1e-6 for p, x in want.items())


def test_configurations_share_their_examples(spark, sf, monkeypatch):
    """Events are read once for all configurations, and each gives its row."""
    from vigil.plans import model as plans

    read, made = [], plans.feature_events
    monkeypatch.setattr(plans, "feature_events", lambda *a: read.append(a) or made(*a))
    monkeypatch.setattr(plans, "_MODELS", {})
    monkeypatch.setattr(model, "train", lambda rows, start, epochs: (start, [0.0]))
    found = {x.config: x for x in QUERIES["ablation"](spark, sf).collect()}
    assert set(found) == set(ABLATIONS) and len(read) == 1
    examples, towers = _examples(spark, sf, ABLATIONS["no_peers"])
    want = model.retrieval(model.distances(examples.where("held_out").drop("held_out"), towers)).where("source = '__all__'").first()
    assert abs(found["no_peers"].mean_margin - want.mean_margin) < 1e-9 and found["no_peers"].pairs == want.pairs
