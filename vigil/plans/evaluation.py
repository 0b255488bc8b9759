"""Evaluation, vocabularies, tensors and vector functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import scalars
from vigil.operators import evaluation, features, tensors
from vigil.plans.common import accepted, scored, scored_narrow, sql
from vigil.session import table
from vigil.sources import adapter

QUERIES, SQL = {}, {}


def query(oracle: str | None = None, *needs: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = sql(oracle, *needs)
        return f

    return add


def _obs(spark, d):
    return evaluation.observations(scored_narrow(spark, d))


@query("SELECT kind, value, detections, events FROM (SELECT 'all' AS kind, '' AS value, count(*) AS detections, count(DISTINCT event_id) AS events FROM detections UNION ALL SELECT 'source', source, count(*), count(DISTINCT event_id) FROM detections GROUP BY source UNION ALL SELECT 'scenario', scenario, count(*), count(DISTINCT event_id) FROM detections GROUP BY scenario)", "detections")
def detection_summary(spark, d):
    return evaluation.detection_summary(scored(spark, d))


@query("SELECT source, count(*) AS n FROM accepted GROUP BY source UNION ALL SELECT '__all__', count(*) FROM accepted", "accepted")
def events_by_source(spark, d):
    return evaluation.events_by_source(accepted(spark, d))


@query("SELECT event_id, source, truth, score, detected FROM obs", "obs")
def event_observations(spark, d):
    return _obs(spark, d)


@query("SELECT truth, count(*) AS total, count(*) FILTER (detected) AS detected, floor(count(*) FILTER (detected)::DOUBLE / count(*) * 100 + 0.5::DOUBLE) / 100 AS recall FROM obs WHERE truth <> 'baseline' GROUP BY truth", "obs")
def scenario_recall(spark, d):
    return evaluation.scenario_recall(_obs(spark, d))


@query("SELECT source, count(*) FILTER (truth = 'baseline') AS baseline_events, count(*) FILTER (truth <> 'baseline') AS attack_events, floor(coalesce(count(*) FILTER (truth = 'baseline' AND detected)::DOUBLE / nullif(count(*) FILTER (truth = 'baseline'), 0), 0) * 100 + 0.5::DOUBLE) / 100 AS baseline_alert_rate, floor(coalesce(count(*) FILTER (truth <> 'baseline' AND detected)::DOUBLE / nullif(count(*) FILTER (truth <> 'baseline'), 0), 0) * 100 + 0.5::DOUBLE) / 100 AS attack_recall FROM obs GROUP BY source", "obs")
def source_behavior(spark, d):
    return evaluation.source_behaviour(_obs(spark, d))


@query("SELECT source, quantile, value FROM nearest", "nearest")
def score_quantiles(spark, d):
    return evaluation.nearest_rank(_obs(spark, d), "source")


@query("SELECT source, threshold, baseline_alert_rate, attack_recall FROM sweep", "sweep")
def threshold_sweep(spark, d):
    return evaluation.threshold_sweep(_obs(spark, d))


@query("SELECT source, count(*) AS candidates, coalesce(arg_max(threshold, (attack_recall, -threshold)) FILTER (baseline_alert_rate <= 0.05), arg_min(threshold, (baseline_alert_rate, threshold))) AS threshold, coalesce(arg_max(attack_recall, (attack_recall, -threshold)) FILTER (baseline_alert_rate <= 0.05), arg_min(attack_recall, (baseline_alert_rate, threshold))) AS attack_recall FROM sweep GROUP BY source", "sweep")
def recommended_thresholds(spark, d):
    return evaluation.recommended(evaluation.threshold_sweep(_obs(spark, d)))


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query("SELECT lang, round(CASE WHEN count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label <> 1) > 0 THEN (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1))::DOUBLE ELSE 0 END, 9) AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0::DOUBLE AS r FROM labelled) GROUP BY lang", "labelled")
def roc_auc(spark, d):
    return evaluation.roc_auc(_labelled(spark, d), "lang").withColumn("roc_auc", F.round("roc_auc", 9))


@query("SELECT lang, round(CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(p / pos::DOUBLE * tp / (tp + fp)) ELSE 0 END, 9) AS average_precision FROM (SELECT lang, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY lang) AS pos, sum(n) OVER (PARTITION BY lang) AS neg FROM (SELECT lang, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM labelled GROUP BY ALL) WINDOW w AS (PARTITION BY lang ORDER BY score DESC)) GROUP BY lang", "labelled")
def average_precision(spark, d):
    return evaluation.average_precision(_labelled(spark, d), "lang").withColumn("average_precision", F.round("average_precision", 9))


@query("SELECT lang, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN count(*) FILTER (label = 1 AND fp / neg::DOUBLE <= 0.1::DOUBLE) / max(pos)::DOUBLE ELSE 0 END AS tpr FROM ranked GROUP BY lang", "ranked")
def tpr_at_fpr(spark, d):
    return evaluation.tpr_at_fpr(_labelled(spark, d), "lang", "doc_id", 0.1)


@query("WITH h AS (SELECT actor_email, row_number() OVER (ORDER BY sha256(actor_email || ':7')) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT actor_email FROM accepted)) SELECT event_id, CASE WHEN observed_at < TIMESTAMP '2024-01-15' AND NOT held THEN 'train' WHEN observed_at >= TIMESTAMP '2024-01-15' AND held THEN 'test' ELSE 'unused' END AS part FROM accepted JOIN (SELECT actor_email, p <= floor(n * 0.3::DOUBLE) AS held FROM h) USING (actor_email)", "accepted")
def temporal_spatial_split(spark, d):
    return evaluation.temporal_spatial_split(accepted(spark, d), "2024-01-15 00:00:00", 0.3).select("event_id", "part")


@query("SELECT scenario, array_to_string(list_sort(list(DISTINCT actor_email)), ',') AS principals FROM accepted WHERE scenario <> 'baseline' GROUP BY scenario", "accepted")
def attackers(spark, d):
    return evaluation.attackers(accepted(spark, d)).withColumn("principals", F.array_join("principals", ","))


def _tables(spark, d):
    e = accepted(spark, d)
    return features.accessors(e), features.static_profiles(e, adapter.principals(spark, d))


@query("SELECT key, idx FROM vocab", "vocab")
def vocab_index(spark, d):
    a, s = _tables(spark, d)
    return tensors.vocabulary(tensors.key_union([(a, "principal_key"), (s, "principal_key")]))


@query("SELECT resource_key, list_resize((list(idx + 1 ORDER BY idx))[1:8], 8, 0) AS tokens, list_transform(list_resize((list(accessor_weight ORDER BY idx))[1:8], 8, 0), lambda x: round(x, 9)) AS weights, list_resize((list(true ORDER BY idx))[1:8], 8, false) AS mask FROM accessors JOIN vocab ON key = principal_key GROUP BY resource_key", "accessors", "vocab")
def padded_accessors(spark, d):
    a, s = _tables(spark, d)
    vocab = tensors.vocabulary(tensors.key_union([(a, "principal_key"), (s, "principal_key")]))
    return tensors.weighted_sets(tensors.indexed(a, "principal_key", vocab, "idx"), ["resource_key"], "idx", "accessor_weight", 8).withColumn("weights", F.transform("weights", lambda x: F.round(x, 9)))


@query("SELECT department AS value, row_number() OVER (ORDER BY department) AS idx FROM (SELECT DISTINCT department FROM static)", "static")
def categorical_vocabulary(spark, d):
    return tensors.categorical_vocabulary(_tables(spark, d)[1], "department")


@query("SELECT * FROM pairs", "pairs")
def training_pairs(spark, d):
    return tensors.training_pairs(*_tables(spark, d))


@query("SELECT resource_key, principal_key, source, row_number() OVER (ORDER BY sha256(resource_key || '|' || principal_key || '|' || source || ':7')) <= greatest(1, floor(count(*) OVER () * 0.2::DOUBLE)) AS held_out FROM pairs", "pairs")
def held_out_pairs(spark, d):
    return tensors.held_out_pairs(tensors.training_pairs(*_tables(spark, d)))


@query(
    """WITH p AS (SELECT principal_key, row_number() OVER (ORDER BY principal_key) - 1 AS idx, count(*) OVER () AS n FROM static),
  r AS (SELECT q.*, p.idx, p.n, unnest(range(1, 4)) AS i FROM pairs q JOIN p USING (principal_key)),
  w AS (SELECT *, ('0x' || substr(sha256(resource_key || ':' || principal_key || ':' || source || ':' || i || ':7'), 1, 8))::BIGINT % (n - 1) AS x FROM r)
  SELECT w.resource_key, w.principal_key, w.source, w.i, o.principal_key AS negative_key FROM w JOIN p o ON o.idx = CASE WHEN x >= w.idx THEN x + 1 ELSE x END""",
    "pairs", "static",
)
def negative_samples(spark, d):
    a, s = _tables(spark, d)
    people = tensors.vocabulary(tensors.key_union([(s, "principal_key")])).withColumnRenamed("key", "principal_key")
    return tensors.negative_samples(tensors.training_pairs(a, s), people, 3)


@query("WITH m AS (SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label) SELECT label, round(list_sum(c), 6) AS total FROM m")
def pooled_embedding(spark, d):
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v")).groupBy("label").agg(F.round(F.sum("v"), 6).alias("total"))


@query("WITH c AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(greatest(0, least(1, 1 - list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]))), 6) AS distance FROM embeddings, c")
def cosine_distance(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", scalars.unit(F.col("embedding")).alias("v"))
    first = e.agg(F.min_by("v", "vec_id").alias("c"))
    return e.join(F.broadcast(first)).select("vec_id", F.round(scalars.cosine_distance(F.col("v"), F.col("c")), 6).alias("distance"))  # one row


@query("SELECT count(*) AS n, 0::DOUBLE AS max_difference FROM embeddings")
def embedding_equivalence(spark, d):
    """Unit vectors by Spark's expressions against NumPy's."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    by_spark = e.select("vec_id", scalars.unit(F.col("embedding")).alias("v"))
    return evaluation.max_difference(by_spark, evaluation.numpy_units(e, "vec_id", "embedding", "v"), "vec_id", "v").withColumn("max_difference", F.round("max_difference", 6))


_AUC = "CASE WHEN count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label <> 1) > 0 THEN (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1))::DOUBLE ELSE 0 END"


def _sql_rate(rate: float) -> str:
    return f"CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN round(count(*) FILTER (label = 1 AND fp <= floor(neg * {rate}::DOUBLE + 1e-9)) / max(pos)::DOUBLE, 9) ELSE 0 END"


#: Metrics of each scenario and of all over a table of event_id, truth and score, whose name stands for ``obs``.
SCENARIO_METRICS = f"""WITH s AS (SELECT DISTINCT truth AS scenario FROM {{obs}} WHERE truth <> 'baseline' UNION ALL SELECT 'none' UNION ALL SELECT '__all__'),
  l AS (SELECT scenario, event_id, score, (truth <> 'baseline')::INT AS label FROM s JOIN {{obs}} ON truth = 'baseline' OR truth = scenario OR scenario = '__all__'),
  a AS (SELECT scenario, round({_AUC}, 9) AS roc_auc, count(*) FILTER (label = 1) AS attacks FROM (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY score) + (count(*) OVER (PARTITION BY scenario, score) - 1) / 2.0::DOUBLE AS r FROM l) GROUP BY scenario),
  c AS (SELECT scenario, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM l GROUP BY ALL),
  d AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY scenario) AS pos, sum(n) OVER (PARTITION BY scenario) AS neg FROM c WINDOW w AS (PARTITION BY scenario ORDER BY score DESC)),
  v AS (SELECT scenario, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN round(sum(p::DOUBLE / pos * tp / (tp + fp)), 9) ELSE 0 END AS average_precision FROM d GROUP BY scenario),
  k AS (SELECT *, sum((label <> 1)::INT) OVER (PARTITION BY scenario ORDER BY score DESC, event_id) AS fp, sum((label <> 1)::INT) OVER (PARTITION BY scenario) AS neg, sum(label) OVER (PARTITION BY scenario) AS pos FROM l),
  t AS (SELECT scenario, {", ".join(f"{_sql_rate(r)} AS {evaluation.rate_name(r)}" for r in evaluation.RATES)} FROM k GROUP BY scenario)
  SELECT a.scenario, attacks, roc_auc, average_precision, t.* EXCLUDE (scenario) FROM a JOIN v ON v.scenario = a.scenario JOIN t ON t.scenario = a.scenario"""


@query(SCENARIO_METRICS.format(obs="obs"), "obs")
def scenario_metrics(spark, d):
    """Area under the curve, average precision and true positive rates at 1, 0.1 and 0.01 % false ones, per scenario and in all; 0 where a class is empty."""
    rows = evaluation.by_scenario(_obs(spark, d), ("none",))
    found = evaluation.rank_metrics(rows, "for", "event_id").join(rows.groupBy("for").agg(F.count_if(F.col("label") == 1).alias("attacks")), "for")
    return found.select(F.col("for").alias("scenario"), "attacks", *(F.round(c, 9).alias(c) for c in found.columns if c not in ("for", "attacks")))
