"""Training and scoring of the two-tower model as queries; tests hold the parts against brute force."""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import scalars
from vigil.operators import evaluation, features, model, modes, normalize, rules, tensors
from vigil.plans import evaluation as metrics_sql
from vigil.plans import flows
from vigil.plans.common import accepted, detections, FEATURE_COLUMNS, feature_events, scored, sql
from vigil.session import shared_path, table, written
from vigil.sources import adapter
from vigil.streaming import service

QUERIES, SQL = {}, {}

#: Configurations of a query that run at once.
AT_ONCE = 7


def query(f):
    QUERIES[f.__name__] = f
    return f


def checked(oracle: str, *needs: str):
    def add(f):
        SQL[f.__name__] = sql(f"WITH {_FORWARD} {oracle}", *_NEEDS, *needs)
        return query(f)

    return add


_NEEDS = ("accessors", "static", "history", "department_peers", "manager_peers", "team_peers", "collaboration", "vocab", "pairs")
_SOURCES = list(normalize.SOURCES)
_HALF = "(('0x' || substr(md5({} || '|3|{}'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE"


def _sql_normal(key: str) -> str:
    return f"sqrt(-2::DOUBLE * ln({_HALF.format(key, 0)})) * cos(2 * pi() * {_HALF.format(key, 1)})"


_STATIC = model.CONTEXT_FIELDS[5:]
_DISTANCE = "1 - list_inner_product(a.u, c.u)"


def _rank(column: str, share: float) -> str:
    """The value at a share of the ranks; midway the even rank."""
    return f"list({column} ORDER BY {column})[round_even((count(*) - 1) * {share}::DOUBLE, 0)::BIGINT + 1]"


#: The forward pass of untrained towers in SQL: pooling, layers, unit vectors, distances of pairs and samples.
_FORWARD = f"""
  rvocab AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM (SELECT DISTINCT resource_key AS key FROM accessors)),
  windows AS (SELECT principal_key, resource_key, count(*) OVER (PARTITION BY principal_key, window_start) AS n, window_start FROM history),
  whist AS (SELECT principal_key, count(DISTINCT window_start) AS windows FROM history GROUP BY principal_key),
  mpeers AS (SELECT principal_key, peer_key, peer_type, peer_weight / sum(peer_weight) OVER (PARTITION BY principal_key, peer_type) AS w
    FROM (SELECT * FROM department_peers UNION ALL SELECT * FROM manager_peers UNION ALL SELECT * FROM team_peers UNION ALL SELECT principal_key, collaborator_key, 'collaboration', co_access_weight FROM collaboration)),
  members AS (SELECT 'a|' || source AS side, resource_key AS key, 99 + list_position({_SOURCES}, source) AS f, idx AS i, accessor_weight AS w FROM accessors JOIN vocab ON vocab.key = principal_key
    UNION ALL SELECT 'c', principal_key, 1, idx, sum(1::DOUBLE / n / windows) FROM windows JOIN whist USING (principal_key) JOIN rvocab ON rvocab.key = resource_key JOIN static USING (principal_key) GROUP BY ALL
    UNION ALL SELECT 'c', principal_key, CASE peer_type WHEN 'department' THEN 2 WHEN 'manager' THEN 3 WHEN 'group' THEN 4 ELSE 5 END, idx, w FROM mpeers JOIN vocab ON vocab.key = peer_key
    {" ".join(f"UNION ALL SELECT 'c', principal_key, {6 + k}, coalesce(i, 0), 1 FROM static LEFT JOIN (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS i FROM (SELECT DISTINCT {c} FROM static)) ON v = {c}" for k, c in enumerate(_STATIC))}),
  tabled AS (SELECT *, CASE WHEN f BETWEEN 2 AND 5 THEN 2 ELSE f END AS t FROM members WHERE f NOT IN (-1)),
  emb AS (SELECT t, i, j, 0.3::DOUBLE * {_sql_normal("'e|' || t || '|' || i || '|' || j")} AS e FROM (SELECT DISTINCT t, i FROM tabled), range(0, 8) r(j)),
  x AS (SELECT side, key, CASE WHEN f >= 100 THEN 0 ELSE greatest(f - 1, 0) END * 8 + j AS c, sum(w * e) AS x FROM tabled JOIN emb USING (t, i) GROUP BY ALL),
  w1 AS (SELECT side, c, h, {_sql_normal("side || '|w1|' || c || '|' || h")} / sqrt(n) AS w FROM (SELECT 'a|' || unnest({_SOURCES}) AS side, c, 8 AS n FROM range(0, 8) q(c) UNION ALL SELECT 'c', unnest(range(0, 72)), 72), range(0, 32) r(h)),
  w2 AS (SELECT side, h, o, {_sql_normal("side || '|w2|' || h || '|' || o")} / sqrt(32) AS w FROM (SELECT 'a|' || unnest({_SOURCES}) AS side UNION ALL SELECT 'c') s, range(0, 32) r(h), range(0, 16) q(o)),
  hid AS (SELECT side, key, h, greatest(0, sum(x * w)) AS v FROM x JOIN w1 USING (side, c) GROUP BY ALL),
  z AS (SELECT side, key, o, sum(v * w) + 0.01::DOUBLE AS z FROM hid JOIN w2 USING (side, h) GROUP BY ALL),
  u AS (SELECT side, key, list(z / greatest(1e-12, n) ORDER BY o) AS u FROM (SELECT *, sqrt(sum(z * z) OVER (PARTITION BY side, key)) AS n FROM z) GROUP BY side, key),
  held AS (SELECT resource_key, principal_key, source, row_number() OVER (ORDER BY sha256(resource_key || '|' || principal_key || '|' || source || ':7')) <= greatest(1, floor(count(*) OVER () * 0.2::DOUBLE)) AS held_out FROM pairs),
  people_ AS (SELECT principal_key, row_number() OVER (ORDER BY principal_key) - 1 AS idx, count(*) OVER () AS n FROM static),
  drawn AS (SELECT q.*, p.idx, p.n, unnest(range(1, 4)) AS i FROM pairs q JOIN people_ p USING (principal_key)),
  sampled AS (SELECT *, ('0x' || substr(sha256(resource_key || ':' || principal_key || ':' || source || ':' || i || ':7'), 1, 8))::BIGINT % (n - 1) AS y FROM drawn),
  slots AS (SELECT resource_key, principal_key, source, 0 AS slot, principal_key AS who FROM pairs
    UNION ALL SELECT s.resource_key, s.principal_key, s.source, s.i, o.principal_key FROM sampled s JOIN people_ o ON o.idx = CASE WHEN y >= s.idx THEN y + 1 ELSE y END),
  dist AS (SELECT resource_key, principal_key, source, slot, {_DISTANCE} AS r, greatest(0, least(1, {_DISTANCE})) AS d FROM slots JOIN u a ON a.side <> 'c' AND a.key = resource_key JOIN u c ON c.side = 'c' AND c.key = who),
  own AS (SELECT resource_key, principal_key, source, d, r FROM dist WHERE slot = 0),
  metric AS (SELECT o.source, o.r AS own, avg(s.r) AS other, (o.r <= min(s.r))::INT::DOUBLE AS top FROM own o JOIN dist s USING (resource_key, principal_key, source) WHERE slot > 0 GROUP BY o.resource_key, o.principal_key, o.source, o.r),
  metric2 AS (SELECT * FROM metric UNION ALL SELECT '__all__', own, other, top FROM metric),
  metrics AS (SELECT source, count(*) AS pairs, avg(top) AS top_1, avg((own < other)::INT) AS win_rate, avg(other - own) AS mean_margin, avg(own) AS own_mean, avg(other) AS other_mean,
    {_rank("own", 0.95)} AS own_p95, {_rank("other", 0.5)} AS other_p50, {_rank("other", 0.9)} AS other_p90 FROM metric2 GROUP BY source),
  judged AS (SELECT *, source = '__all__' OR pairs >= 5 AS judged, top_1 >= 0.15 AND win_rate >= 0.55 AND mean_margin > 0 AS good FROM metrics),
  gated AS (SELECT * EXCLUDE (judged, good), CASE WHEN judged THEN good END AS passes, CASE WHEN NOT judged THEN NULL WHEN good AND source = '__all__' THEN 'sampled_retrieval_gate_pass' WHEN good THEN 'source_sampled_retrieval_gate_pass'
    WHEN top_1 < 0.15 THEN 'sampled_top1_accuracy_below_threshold' WHEN win_rate < 0.55 THEN 'pairwise_win_rate_below_threshold' ELSE 'mean_margin_below_threshold' END AS reason FROM judged),
  raised AS (SELECT *, other_p50 > own_p95 AS apart, greatest(0.05::DOUBLE, least(CASE WHEN other_p50 > own_p95 THEN (own_p95 + other_p50) / 2 ELSE 0.6::DOUBLE END, 0.99::DOUBLE)) AS t FROM metrics WHERE source = '__all__' OR pairs >= 3),
  policy AS (SELECT CASE WHEN source <> '__all__' THEN source END AS source, round(t, 4) AS detection_threshold, round(greatest(t, least(greatest(t + 0.1::DOUBLE, least(greatest(other_p90, t + 0.05::DOUBLE), 0.99::DOUBLE)), 0.99::DOUBLE)), 4) AS high_severity_threshold,
    CASE WHEN source = '__all__' THEN 'heldout' ELSE 'heldout:' || source END AS calibration_source, CASE WHEN apart THEN 'heldout_midpoint_between_positive_p95_and_negative_p50' ELSE 'fallback_default_threshold_due_to_overlap' END AS calibration_reason,
    CASE WHEN source <> '__all__' THEN pairs END AS pairs FROM raised)"""


def _prepared(spark, d):
    """Examples with three negatives each, written down once, and the parts of towers (``_parts``)."""
    e, org = feature_events(spark, d), written(adapter.principals(spark, d), "principals")
    static, acc = written(features.static_profiles(e, org), "static"), written(features.accessors(e), "accessors")
    parts, profiled = _parts(spark, d, acc, static, features.history(e), org)
    pairs = tensors.held_out_pairs(tensors.training_pairs(acc, static))
    pairs = written(pairs, "pairs")
    negatives = tensors.negative_samples(pairs.drop("held_out"), profiled.withColumnRenamed("key", "principal_key"), 3)
    return written(model.examples(pairs, negatives), "examples"), parts


def _examples(spark, d, blank: tuple[str, ...] = ()):
    """Examples with three negatives each, written down once, and untrained towers over all members."""
    rows, parts = _prepared(spark, d)
    return rows, _untrained(parts, blank)


def _parts(spark, d, acc, static, history, org):
    """Accessors, numbered principals, contexts and peers, which towers of all configurations share, and the numbered principals that have a context."""
    people = written(tensors.vocabulary(tensors.key_union([(acc, "principal_key"), (static, "principal_key")])), "people")
    profiled = written(tensors.vocabulary(tensors.key_union([(static, "principal_key")])), "profiled")  # those with a context
    resources = written(tensors.vocabulary(tensors.key_union([(acc, "resource_key")])), "resources")
    vocabularies = {n: tensors.categorical_vocabulary(static, n) for n in model.CONTEXT_FIELDS[5:]}
    context = written(model.contexts(static, history, features.manager_peers(static, org), people, resources, vocabularies), "contexts")
    peers = model.peers_of(static, acc, people, members=features.team_members(static, org, adapter.teams(spark, d)))
    return (acc, people, context, peers), profiled


def _untrained(parts, blank: tuple[str, ...] = ()):
    """Untrained towers; ``blank`` names fields that are left out."""
    acc, people, context, peers = parts
    context = model.blanked(context, blank) if blank else context
    return model.towers(written(model.members(acc, people, context), "members"), peers=peers.without(blank))


def _each(spark, f, names) -> list:
    """What ``f`` gives for each name. Some run at once: their jobs are many and short, and one's tasks fill the cluster only at size."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(f), names))


#: Models by application and input folder, with the input's signature, so that queries on one model train it once; their tables are in the shared folder.
_MODELS: dict[tuple, tuple] = {}


def _signature(spark, d) -> tuple:
    """Number of the input's files and an order-free hash of their paths, sizes and times; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(d)
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def _once(spark, kind: str, d, make, blank: tuple[str, ...] = (), again: bool = False):
    """What was made of the same files before, or what is made now and then takes the place of what is there."""
    key, now = (spark.sparkContext.applicationId, kind, d, blank), _signature(spark, d)
    if again or key not in _MODELS or _MODELS[key][0] != now:
        _MODELS[key] = now, make()
    return _MODELS[key][1]


def _train(spark, d, epochs: int = 4, blank: tuple[str, ...] = (), prepared=None):
    rows, parts = prepared or _prepared(spark, d)
    towers = _untrained(parts, blank)
    trained, losses = model.train(rows.where("NOT held_out").drop("held_out"), towers, epochs)
    return rows, trained, losses


def _trained(spark, d, blank: tuple[str, ...] = (), prepared=None):
    return _once(spark, "trained", d, lambda: _train(spark, d, blank=blank, prepared=prepared), blank)


def _held_out(rows, trained):
    return model.distances(rows.where("held_out").drop("held_out"), trained)


@query
def train_two_tower(spark, d):
    """Loss before each round. Always trains, and leaves the model to the queries below."""
    losses = _once(spark, "trained", d, lambda: _train(spark, d), again=True)[2]
    return spark.createDataFrame(list(enumerate(losses)), "round long, loss double")


@query
def batch_model_scores(spark, d):
    """Distance of every pair and its samples, and whether the pair was held out from training."""
    rows, trained, _ = _trained(spark, d)
    return model.distances(rows, trained)


@query
def retrieval_metrics(spark, d):
    rows, trained, _ = _trained(spark, d)
    return model.gate(model.retrieval(_held_out(rows, trained)))


@query
def calibrated_policy(spark, d):
    rows, trained, _ = _trained(spark, d)
    return model.calibrated(_held_out(rows, trained))


@query
def model_activation(spark, d):
    """The gate's judgement of the trained model."""
    rows, trained, losses = _trained(spark, d)
    found = model.activation(model.gate(model.retrieval(_held_out(rows, trained))), rows.where("NOT held_out").count(), losses[-1] if losses else None)
    return found.withColumns({c: F.array_join(c, ",") for c in ("failing", "covered")})


@query
def model_observations(spark, d):
    """Every event with its pair's distance and its source's threshold, or else its score by rules."""
    rows, trained, _ = _trained(spark, d)
    found = written(model.distances(rows, trained), "distances")
    return model.observations(scored(spark, d), found, model.calibrated(found.where("held_out")))


PEERS = ("department", "manager", "group", "collaboration")
#: Configuration: fields that are left out.
ABLATIONS = {
    "full": (),
    "no_history": ("history",),
    "no_peers": PEERS,
    "no_collaboration": ("collaboration",),
    "no_static": model.CONTEXT_FIELDS[5:],
    "history_only": (*PEERS, *model.CONTEXT_FIELDS[5:]),
    "peers_only": ("history", *model.CONTEXT_FIELDS[5:]),
}


@query
def ablation(spark, d):
    """Retrieval with groups of context fields left out. The configurations have the same examples, contexts and peers, which are made once."""
    prepared = _prepared(spark, d)

    def one(name: str):
        rows, trained, _ = _trained(spark, d, ABLATIONS[name], prepared)
        return written(model.retrieval(_held_out(rows, trained)).where("source = '__all__'").withColumn("config", F.lit(name)), "ablation")

    return reduce(DataFrame.unionByName, _each(spark, one, ABLATIONS))


@query
def cluster_score(spark, d):
    """Multi-scale scores of the vectors of each label, scored by their distance to the first one."""
    e = table(spark, d, "embeddings").select("label", "vec_id", scalars.unit(F.col("embedding")).alias("vector"))
    first = e.agg(F.min_by("vector", "vec_id").alias("c"))
    rows = e.join(F.broadcast(first)).select(F.col("label").alias("principal"), "vector", scalars.cosine_distance(F.col("vector"), F.col("c")).alias("score"))  # one row
    return model.cluster_scores(rows, delta=0.9)


def _seeded(spark, d):
    """All pairs with their distances by untrained towers, whose weights follow from hashes, so that SQL has them too."""

    return _once(spark, "seeded", d, lambda: written(model.distances(*_examples(spark, d)), "distances"))


@checked("SELECT resource_key, principal_key, source, slot, round(d, 6) AS distance FROM dist")
def seeded_distances(spark, d):
    found = _seeded(spark, d).select("resource_key", "principal_key", "source", F.posexplode("distances").alias("slot", "distance"))
    return found.withColumn("slot", F.col("slot").cast("long")).withColumn("distance", F.round("distance", 6))


@checked(" SELECT side, key, place - 1 AS place, round(v, 6) AS value, true AS same FROM (SELECT side, key, unnest(u) AS v, unnest(range(1, 17)) AS place FROM u)")
def tower_vectors(spark, d):
    """Vectors of all resources and principals by towers in NumPy, and whether the forward pass by expressions gives the same."""
    _, towers = _examples(spark, d)
    rows = written(model.pooled(towers), "pooled")
    by_numpy, by_spark = model.units(rows, towers.layers), model.units_by_expressions(rows, model.layer_table(spark, towers.layers))
    both = by_numpy.join(by_spark.withColumnRenamed("u", "e"), ["side", "key"], "full")
    each = both.select("side", "key", F.posexplode(F.arrays_zip("u", "e")).alias("place", "z"))
    same = F.coalesce(F.abs(F.col("z.u") - F.col("z.e")) <= evaluation.TOLERANCE, F.lit(False))
    return each.select("side", "key", F.col("place").cast("long").alias("place"), F.round("z.u", 6).alias("value"), same.alias("same"))


_HUBER = "CASE WHEN m <= 1 THEN 0.5::DOUBLE * m * m ELSE m - 0.5::DOUBLE END"


@checked(
    f""", points AS (SELECT o.source, o.resource_key, o.principal_key, avg({_HUBER}) AS x FROM (SELECT s.*, greatest(0, {model.MARGIN}::DOUBLE + o.r - s.r) AS m FROM dist s JOIN own o USING (resource_key, principal_key, source) WHERE slot > 0) o GROUP BY ALL)
  SELECT source, count(*) AS pairs, round(sqrt(avg(x * x)), 6) AS loss FROM (SELECT source, x FROM points UNION ALL SELECT '__all__', x FROM points) GROUP BY source"""
)
def seeded_loss(spark, d):
    """The ranking loss that training starts from, per source."""
    return model.ranking_loss(_seeded(spark, d)).withColumn("loss", F.round("loss", 6))


_METRICS = ("top_1", "win_rate", "mean_margin", "own_mean", "other_mean", "own_p95", "other_p50", "other_p90")


@checked(f"SELECT source, pairs, passes, reason, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM gated")
def seeded_retrieval(spark, d):
    found = model.gate(model.retrieval(_seeded(spark, d)))
    return found.select("source", "pairs", "passes", "reason", *(F.round(c, 6).alias(c) for c in _METRICS))


@checked("SELECT * FROM policy")
def seeded_policy(spark, d):
    """Thresholds of each source and of all together, with where they come from."""
    return model.calibrated(_seeded(spark, d))


#: What the gate is asked about: all sources, and as if some had no held-out pairs.
GATES = {"all": "true", "no_identity": "source <> 'okta'", "no_resource": "source IN ('okta', 'other', '__all__')", "identity_and_one": "source IN ('okta', 'github', '__all__')", "nothing": "false"}


def _sql_gate(name: str, which: str) -> str:
    covered = "list_sort(list(source) FILTER (source <> '__all__' AND passes IS NOT NULL))"
    return f"""SELECT '{name}' AS variant, CASE WHEN n = 0 THEN 'heldout_eval_missing' WHEN len(failing) > 0 THEN 'source_gate_failed:' || array_to_string(failing, ',') WHEN overall AND why <> 'cross_domain_coverage_gate_pass' THEN 'coverage_gate_failed:' || why ELSE overall_reason END AS reason,
    n > 0 AND overall AND len(failing) = 0 AND why = 'cross_domain_coverage_gate_pass' AS eligible, CASE WHEN n > 0 THEN array_to_string(failing, ',') ELSE '' END AS failing, CASE WHEN n > 0 THEN array_to_string(covered, ',') ELSE '' END AS covered,
    n > 0 AND why = 'cross_domain_coverage_gate_pass' AS coverage_eligible, CASE WHEN n = 0 THEN 'heldout_eval_missing' ELSE why END AS coverage_reason
  FROM (SELECT *, CASE WHEN len(covered) < 2 THEN 'insufficient_covered_sources' WHEN NOT list_contains(covered, 'okta') THEN 'identity_source_coverage_missing' WHEN NOT list_has_any(covered, ['github', 'gworkspace', 'snowflake']) THEN 'resource_source_coverage_missing' ELSE 'cross_domain_coverage_gate_pass' END AS why
  FROM (SELECT coalesce(max(pairs) FILTER (source = '__all__'), 0) AS n, coalesce(bool_or(passes) FILTER (source = '__all__'), false) AS overall, max(reason) FILTER (source = '__all__') AS overall_reason,
    coalesce(list_sort(list(source) FILTER (source <> '__all__' AND NOT passes)), []) AS failing, coalesce({covered}, []) AS covered FROM gated WHERE {which}))"""


@checked(" SELECT * FROM (" + " UNION ALL ".join(_sql_gate(n, w) for n, w in GATES.items()) + ")")
def activation_gate(spark, d):
    """Whether the untrained model would be switched on, and why not, by what its sources have."""
    gated = written(model.gate(model.retrieval(_seeded(spark, d))), "gated")
    out = None
    for name, which in GATES.items():
        one = model.activation(gated.where(which)).select(F.lit(name).alias("variant"), "reason", "eligible", *(F.array_join(c, ",").alias(c) for c in ("failing", "covered")), "coverage_eligible", "coverage_reason")
        out = one if out is None else out.unionByName(one)
    return out


def _by_model(spark, d):
    return _once(spark, "modes", d, lambda: _scored_by_model(spark, d))


def _scored_by_model(spark, d):
    """Events scored by rules, with the model's scores of pairs that aren't held out; for the others the rules decide."""
    e, found = accepted(spark, d), _seeded(spark, d)
    requests = modes.scoring_requests(e, features.accessors(e), features.static_profiles(e, adapter.principals(spark, d)))
    known = found.where("NOT held_out").select("resource_key", "principal_key", F.round(F.get("distances", 0), 4).alias("model_score"))
    policy = model.calibrated(found).where("source IS NULL OR source <> 'okta'")  # one source takes the global policy
    return written(modes.with_model_scores(scored(spark, d), requests, known, policy), "modes")


_MODES = """, requests AS (SELECT a.event_id, a.resource_key, a.principal_key FROM accepted a SEMI JOIN accessors c ON c.resource_key = a.resource_key AND c.source = a.source SEMI JOIN static s ON s.principal_key = a.principal_key),
  known AS (SELECT resource_key, principal_key, round(d, 4) AS model_score FROM own JOIN held USING (resource_key, principal_key, source) WHERE NOT held_out),
  modes AS (SELECT s.*, k.model_score, coalesce(p.detection_threshold, g.detection_threshold) AS detection_threshold, CASE WHEN p.source IS NULL THEN 'global' ELSE s.source END AS policy_scope,
      greatest(coalesce(p.high_severity_threshold, g.high_severity_threshold), coalesce(p.detection_threshold, g.detection_threshold)) AS high_severity_threshold, coalesce(p.calibration_source, g.calibration_source) AS calibration_source, coalesce(p.calibration_reason, g.calibration_reason) AS calibration_reason
    FROM scored s LEFT JOIN (SELECT event_id, model_score FROM requests JOIN known USING (resource_key, principal_key)) k ON k.event_id = s.event_id LEFT JOIN (SELECT * FROM policy WHERE source <> 'okta') p ON p.source = s.source, (SELECT * FROM policy WHERE source IS NULL) g),
  final AS (SELECT *, coalesce(model_score, score) AS s, CASE WHEN model_score IS NULL THEN 0.6::DOUBLE ELSE detection_threshold END AS t FROM modes),
  found AS (SELECT 'det-' || substr(sha256(event_id || ':' || scenario), 1, 12) AS detection_id, event_id, source, scenario, floor(s * 100 + 0.5::DOUBLE) / 100 AS score, CASE WHEN s >= CASE WHEN model_score IS NULL THEN 0.8::DOUBLE ELSE high_severity_threshold END THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN model_score IS NULL THEN 'rules-heuristics-fusion-v1' ELSE 'two-tower-v1' END AS model_version, CASE WHEN model_score IS NOT NULL THEN policy_scope END AS policy_scope, CASE WHEN model_score IS NOT NULL THEN calibration_source END AS calibration_source, CASE WHEN model_score IS NOT NULL THEN calibration_reason END AS calibration_reason, CASE WHEN model_score IS NOT NULL THEN high_severity_threshold END AS high_threshold, CASE WHEN model_score IS NOT NULL THEN round(greatest(0, s - t), 4) END AS score_margin, CASE WHEN model_score IS NULL THEN 'no_model_score' END AS fallback_reason FROM final WHERE s >= t)"""


@checked(f"{_MODES} SELECT * FROM found", "accepted", "scored")
def model_detections(spark, d):
    """Detections by the model, with its policy by source, and by the rules where it has no score."""
    found = modes.model_detections(_by_model(spark, d))
    return found.select("detection_id", "event_id", "source", "scenario", "score", "severity", "model_version", "model_rationale.policy_scope", "model_rationale.calibration_source", "model_rationale.calibration_reason", F.col("model_rationale.high_severity_threshold").alias("high_threshold"), F.round("model_rationale.score_margin", 4).alias("score_margin"), "fallback_reason")


@checked(f"{_MODES} SELECT detection_id, event_id, source, scenario, score, severity, model_version, policy_scope, score_margin, fallback_reason FROM found", "accepted", "scored")
def stream_model_pipeline(spark, d):
    """The streamed path with a published model, in four batches with late rows: untrained towers' vectors, their policy, and the rules where they have no score."""
    rows, towers = _examples(spark, d)
    unit = written(model.units(model.pooled(towers), towers.layers), "units")
    found = written(model.distances(rows, towers, unit), "distances")
    side = lambda which, key, vector: unit.where(which).select(F.col("key").alias(key), F.col("u").alias(vector))
    sources = rows.select("resource_key", "source").distinct()  # every resource with a vector has a pair
    resources = side("side <> 'c'", "resource_key", "a").join(sources, "resource_key")
    policy = model.calibrated(found).where("source IS NULL OR source <> 'okta'")  # one source takes the global policy
    published = service.Published.publish(shared_path(spark, "published"), resources, side("side = 'c'", "principal_key", "c"), rows.where("held_out"), policy)
    out = service.detections(spark, flows.run_dealt(spark, d, published=published))
    return out.select("detection_id", "event_id", "source", "scenario", "score", "severity", "model_version", "policy_scope", F.round("score_margin", 4).alias("score_margin"), "fallback_reason")


@checked(
    f"""{_MODES} SELECT 'event' AS by, count(*) FILTER (a AND b) AS "both", count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (b AND NOT a) AS right_only FROM (SELECT score >= 0.6::DOUBLE AS a, s >= t AS b FROM final)
  UNION ALL SELECT 'detection', count(*) FILTER (a AND b), count(*) FILTER (a AND NOT b), count(*) FILTER (b AND NOT a) FROM (SELECT score >= 0.6::DOUBLE AS a, s >= t AS b FROM final)""",
    "accepted", "scored",
)
def detection_modes(spark, d):
    """Rules against the model: detections of both and of either alone."""
    return modes.comparison(written(detections(spark, d).select("detection_id", "event_id"), "rules"), written(modes.model_detections(_by_model(spark, d)).select("detection_id", "event_id"), "model"))


@checked(
    f"""{_MODES} SELECT 'all' AS kind, '' AS value, count(*) AS detections, count(DISTINCT event_id) AS events FROM found UNION ALL SELECT 'source', source, count(*), count(DISTINCT event_id) FROM found GROUP BY source
  UNION ALL SELECT 'scenario', scenario, count(*), count(DISTINCT event_id) FROM found GROUP BY scenario UNION ALL SELECT 'backing', CASE WHEN fallback_reason IS NULL THEN 'model' ELSE 'fallback' END, count(*), count(DISTINCT event_id) FROM found GROUP BY ALL""",
    "accepted", "scored",
)
def model_detection_summary(spark, d):
    return modes.summary(modes.model_detections(_by_model(spark, d)))


def _sql_report(mode: str, rows: str) -> str:
    rate = lambda of: f"floor(coalesce(count(*) FILTER ({of} AND detected)::DOUBLE / nullif(count(*) FILTER ({of}), 0), 0) * 100 + 0.5::DOUBLE) / 100"
    from vigil.operators.evaluation import QUANTILES

    ranks = " UNION ALL ".join(f"SELECT source, 'score_{n}' AS name, list(score ORDER BY score)[floor((count(*) - 1) * {p}::DOUBLE + 0.5)::BIGINT + 1] AS value FROM {rows} GROUP BY source" for n, p in QUANTILES.items())
    base, attack = "truth = 'baseline'", "truth <> 'baseline'"
    return f"""SELECT '{mode}' AS mode, * FROM (SELECT source, 'baseline_alert_rate' AS name, {rate(base)} AS value FROM {rows} GROUP BY source UNION ALL SELECT source, 'attack_recall', {rate(attack)} FROM {rows} GROUP BY source
  UNION ALL SELECT truth, 'scenario_recall', {rate("true")} FROM {rows} WHERE {attack} GROUP BY truth UNION ALL {ranks})"""


@checked(
    f"""{_MODES}, ro AS (SELECT source, truth, floor(score * 100 + 0.5::DOUBLE) / 100 AS score, score >= 0.6::DOUBLE AS detected FROM final), mo AS (SELECT source, truth, floor(s * 100 + 0.5::DOUBLE) / 100 AS score, s >= t AS detected FROM final)
  {_sql_report("rules", "ro")} UNION ALL {_sql_report("model", "mo")}""",
    "accepted", "scored",
)
def mode_report(spark, d):
    """Alert rates, recalls and score quantiles of both modes."""
    rows = _by_model(spark, d)
    return modes.report(written(evaluation.observations(rows, rules.MEDIUM), "obs"), "rules").unionByName(modes.report(written(modes.observations(rows), "obs"), "model"))


@query
def principal_scores(spark, d):
    """Every active principal over its distinct resources: distances of untrained towers, clustered by the resources' vectors."""
    rows, towers = _examples(spark, d)
    unit = written(model.units(model.pooled(towers), towers.layers), "units")
    vectors = unit.where("side <> 'c'").select(F.col("key").alias("resource_key"), F.col("u").alias("vector"))  # resources of sources with and without an own tower
    own = model.distances(rows, towers, unit).select("principal_key", "resource_key", "source", F.get("distances", 0).alias("score")).distinct()
    return model.cluster_scores(own.join(vectors, "resource_key").select(F.col("principal_key").alias("principal"), "vector", "score"))


SEEDED_ABLATIONS = ("no_history", "no_collaboration", "no_static")


def _ablated_sql(config: str) -> str:
    gone = ", ".join(str(model.CONTEXT_FIELDS.index(n) + 1) for n in ABLATIONS[config])
    return f"SELECT '{config}' AS config, * FROM (WITH {_FORWARD.replace('NOT IN (-1)', f'NOT IN ({gone})').replace(_DISTANCE, f'round({_DISTANCE}, 9)')} SELECT pairs, round(top_1, 6) AS top_1, round(win_rate, 6) AS win_rate, round(mean_margin, 6) AS mean_margin FROM metrics WHERE source = '__all__')"


def seeded_ablation(spark, d):
    """Retrieval by untrained towers without histories, without collaborators, and without static attributes."""
    rows, parts = _prepared(spark, d)

    def one(config: str):
        # contexts that became equal must tie, whatever the order of the sums
        found = model.distances(rows, _untrained(parts, ABLATIONS[config])).withColumn("raw", F.transform("raw", lambda x: F.round(x, 9)))
        named = model.retrieval(found).where("source = '__all__'").select(F.lit(config).alias("config"), "pairs", *(F.round(c, 6).alias(c) for c in ("top_1", "win_rate", "mean_margin")))
        return written(named, "ablation")

    return reduce(DataFrame.unionByName, _each(spark, one, SEEDED_ABLATIONS))


QUERIES["seeded_ablation"] = seeded_ablation
SQL["seeded_ablation"] = sql(" UNION ALL ".join(map(_ablated_sql, SEEDED_ABLATIONS)), *_NEEDS)


#: Days of history after which detection is tried, on the five days after them, of thirty.
COLD_DAYS, TEST_DAYS, ALL_DAYS, FIRST_DAY = (3, 7, 14, 20, 25), 5, 30, datetime.date(2024, 1, 1)


def _day(n: int) -> str:
    return (FIRST_DAY + datetime.timedelta(days=n)).isoformat()


_UPTO = {n: n + min(TEST_DAYS, ALL_DAYS - n) for n in COLD_DAYS}


def _sql_cold(days: int) -> str:
    """All feature tables built anew from the events before the day, where the query has one pass for all days."""
    metrics = metrics_sql.SCENARIO_METRICS.format(obs="tried")
    body = f"""WITH {_FORWARD}, tried AS (SELECT a.event_id, coalesce(scenario, 'baseline') AS truth, round(greatest(0, least(1, {_DISTANCE.replace("a.u", "r.u")})), 9) AS score
      FROM accepted a JOIN u r ON r.side <> 'c' AND r.key = a.resource_key JOIN u c ON c.side = 'c' AND c.key = a.principal_key WHERE a.observed_at >= TIMESTAMP '{_day(days)}'), {metrics.removeprefix("WITH ")}"""
    return f"SELECT {days} AS days, * FROM ({sql(body, *_NEEDS, 'accepted', before=_day(_UPTO[days]))})"


def _tried(events, towers):
    """Distance of each event's pair by untrained towers, with what the event truly is."""
    unit = written(model.units(model.pooled(towers), towers.layers), "units")
    a, c = unit.where("side <> 'c'").select(F.col("key").alias("resource_key"), F.col("u").alias("a")), unit.where("side = 'c'").select(F.col("key").alias("principal_key"), F.col("u").alias("c"))
    pairs = events.select("resource_key", "principal_key").distinct().join(a, "resource_key").join(c, "principal_key")
    scores = pairs.select("resource_key", "principal_key", F.round(model.clamped(1 - model.inner("a", "c")), 9).alias("score"))
    return events.join(scores, ["resource_key", "principal_key"]).select("event_id", F.coalesce("scenario", F.lit("baseline")).alias("truth"), "score")


def _told_apart(tried, by: str, values):
    """Rank metrics per value of a column and scenario, and over all scenarios."""
    tried, out = written(tried, "tried"), None
    for v in values:
        rows = evaluation.by_scenario(tried.where(F.col(by) == v), ("none",)).withColumn("for", F.concat(F.lit(f"{v}|"), "for"))
        out = rows if out is None else out.unionByName(rows)
    rows = written(out, "by-scenario")
    found = evaluation.rank_metrics(rows, "for", "event_id").join(rows.groupBy("for").agg(F.count_if(F.col("label") == 1).alias("attacks")), "for")
    part = F.split("for", "\\|")
    return found.select(part[0].alias(by), part[1].alias("scenario"), "attacks", *(F.round(c, 9).alias(c) for c in found.columns if c not in ("for", "attacks")))


def cold_start(spark, d):
    """How well events of the days after so many days of history are told apart by untrained towers, per scenario and in all."""
    days, org = list(_UPTO), written(adapter.principals(spark, d), "principals")
    events = written(features.with_snapshot(accepted(spark, d).select(*FEATURE_COLUMNS, "scenario"), [_day(n) for n in _UPTO.values()]), "snapshots")
    found = {name: written(df, f"nested-{name}") for name, df in features.nested(events, len(days)).items()}
    tried = None
    for i, n in enumerate(days):
        now = {name: df.where(F.col("snapshot") == i).drop("snapshot") for name, df in found.items()}
        parts, _ = _parts(spark, d, now["accessors"], written(features.profiles(now["latest"], org), "static"), now["history"], org)
        late = events.where((F.col("snapshot") <= i) & (F.col("observed_at") >= F.lit(_day(n)).cast("timestamp_ntz")))
        one = _tried(late, _untrained(parts)).select(F.lit(n).alias("days"), "event_id", "truth", "score")
        tried = one if tried is None else tried.unionByName(one)
    return _told_apart(tried, "days", days).withColumn("days", F.col("days").cast("int"))


QUERIES["cold_start"] = cold_start
SQL["cold_start"] = " UNION ALL ".join(map(_sql_cold, COLD_DAYS))


SCENARIO_ABLATIONS = ("full", *SEEDED_ABLATIONS, "no_peers", "history_only", "peers_only")


def _sql_tried(config: str) -> str:
    gone = ", ".join(str(model.CONTEXT_FIELDS.index(n) + 1) for n in ABLATIONS[config]) or "-1"
    metrics = metrics_sql.SCENARIO_METRICS.format(obs="tried")
    return f"""SELECT '{config}' AS config, * FROM (WITH {_FORWARD.replace('NOT IN (-1)', f'NOT IN ({gone})')}, tried AS (SELECT a.event_id, coalesce(scenario, 'baseline') AS truth, round(greatest(0, least(1, {_DISTANCE.replace("a.u", "r.u")})), 9) AS score
      FROM accepted a JOIN u r ON r.side <> 'c' AND r.key = a.resource_key JOIN u c ON c.side = 'c' AND c.key = a.principal_key), {metrics.removeprefix("WITH ")})"""


def scenario_ablation(spark, d):
    """How well attacks are told apart, per scenario, with groups of context fields left out of untrained towers."""
    events, org = written(accepted(spark, d).select(*FEATURE_COLUMNS, "scenario"), "events"), written(adapter.principals(spark, d), "principals")
    acc, static = written(features.accessors(events), "accessors"), written(features.static_profiles(events, org), "static")
    parts, _ = _parts(spark, d, acc, static, features.history(events), org)
    tried = _each(spark, lambda config: written(_tried(events, _untrained(parts, ABLATIONS[config])).withColumn("config", F.lit(config)), "tried"), SCENARIO_ABLATIONS)
    return _told_apart(reduce(DataFrame.unionByName, tried), "config", SCENARIO_ABLATIONS)


QUERIES["scenario_ablation"] = scenario_ablation
SQL["scenario_ablation"] = sql(" UNION ALL ".join(map(_sql_tried, SCENARIO_ABLATIONS)), *_NEEDS, "accepted")
