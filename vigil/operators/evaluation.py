"""Evaluation of detections and scores: quantiles, sweeps, recall, rank metrics, splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import rounded
from vigil.operators import prefix
from vigil.session import written

QUANTILES = {"min": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}
#: Thresholds that a sweep always looks at.
FIXED_THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
BUDGET = 0.05


def observations(scored: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Event, source, truth, rounded score and whether it is detected."""
    return scored.select("event_id", "source", "truth", rounded(F.col("score"), 2).alias("score"), (F.col("score") >= F.lit(threshold)).alias("detected"))


def detection_summary(scored: DataFrame, threshold: float = 0.60) -> DataFrame:
    """Counts of detections in all, by source and by scenario, in one pass of grouping sets."""
    rows = scored.where(F.col("score") >= F.lit(threshold))
    grouped = rows.groupingSets([[], ["source"], ["scenario"]], "source", "scenario").agg(F.count(F.lit(1)).alias("detections"), F.count_distinct("event_id").alias("events"), F.grouping_id().alias("level"))
    return grouped.select(F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "source").otherwise("scenario").alias("kind"), F.coalesce("source", "scenario", F.lit("")).alias("value"), "detections", "events")


def events_by_source(events: DataFrame) -> DataFrame:
    """Counts by source and in all."""
    return events.rollup("source").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("source", F.lit("__all__")).alias("source"), "n")


def scenario_recall(obs: DataFrame) -> DataFrame:
    return obs.where("truth <> 'baseline'").groupBy("truth").agg(F.count(F.lit(1)).alias("total"), F.count_if("detected").alias("detected"), rounded(F.count_if("detected") / F.count(F.lit(1)), 2).alias("recall"))


def source_behaviour(obs: DataFrame) -> DataFrame:
    """Alert rate on baseline events and recall on attacks, per source."""
    base, attack = F.col("truth") == "baseline", F.col("truth") != "baseline"
    rate = lambda which: F.coalesce(F.count_if(which & F.col("detected")) / F.nullif(F.count_if(which), F.lit(0)), F.lit(0.0))
    return obs.groupBy("source").agg(F.count_if(base).alias("baseline_events"), F.count_if(attack).alias("attack_events"), rounded(rate(base), 2).alias("baseline_alert_rate"), rounded(rate(attack), 2).alias("attack_recall"))


def nearest_rank(obs: DataFrame, by: str, value: str = "score", quantiles: dict[str, float] | None = None, *, half_even: bool = False, most_rows: int = prefix.MOST_ROWS) -> DataFrame:
    """Exact nearest-rank quantiles: (group, quantile, value). A rank midway between two is rounded up, or with ``half_even`` to the even one.

    Values are counted first, so the running sum sees each distinct value once; a group with many is summed by ranges.
    """
    wanted = quantiles or QUANTILES
    counted = obs.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    rows = prefix.running(counted, [by], [F.col(value)], {"_upto": "_n"}, most_rows=most_rows)
    last = F.col("_upto") - 1
    rank = lambda p: F.rint((F.col("_upto_all") - 1) * F.lit(p)) if half_even else F.floor((F.col("_upto_all") - 1) * F.lit(p) + F.lit(0.5))
    ask = F.explode(F.array(*(F.struct(F.lit(n).alias("quantile"), rank(p).cast("long").alias("rank")) for n, p in wanted.items())))
    found = rows.select(by, value, "_n", last.alias("_last"), ask.alias("q")).where((F.col("q.rank") <= F.col("_last")) & (F.col("q.rank") > F.col("_last") - F.col("_n")))
    return found.select(by, F.col("q.quantile").alias("quantile"), F.col(value).alias("value"))


def score_summary(obs: DataFrame) -> DataFrame:
    return obs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))


def threshold_sweep(obs: DataFrame, current: float = 0.60) -> DataFrame:
    """(source, threshold, baseline alert rate, attack recall) for fixed, current and quantile thresholds.

    Observations are counted by score first, so that each threshold meets few rows.
    """
    counted = obs.groupBy("source", "score").agg(F.count_if(F.col("truth") == "baseline").alias("b"), F.count_if(F.col("truth") != "baseline").alias("a"))
    quantiles = nearest_rank(obs.where("truth = 'baseline'"), "source").groupBy("source").agg(F.collect_set(rounded(F.col("value"), 4)).alias("q"))
    fixed = F.array(*(F.lit(x) for x in sorted({*FIXED_THRESHOLDS, current})))
    sources = counted.select("source").distinct().join(quantiles, "source", "left")
    thresholds = sources.select("source", F.explode(F.array_distinct(F.concat(fixed, F.coalesce("q", F.array().cast("array<double>"))))).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    rate = lambda c: F.coalesce(F.sum(F.when(hit, F.col(c)).otherwise(0)) / F.nullif(F.sum(c), F.lit(0)), F.lit(0.0))
    return counted.join(thresholds, "source").groupBy("source", "threshold").agg(rounded(rate("b"), 2).alias("baseline_alert_rate"), rounded(rate("a"), 2).alias("attack_recall"))


def recommended(sweep: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Per source the threshold with the best recall within the budget, the lower at ties; else the least alert rate."""
    within = F.col("baseline_alert_rate") <= budget
    best = F.max_by(F.struct("threshold", "attack_recall"), F.when(within, F.struct("attack_recall", (-F.col("threshold")).alias("t"))))
    least = F.min_by(F.struct("threshold", "attack_recall"), F.struct("baseline_alert_rate", "threshold"))
    return sweep.groupBy("source").agg(F.coalesce(best, least).alias("r"), F.count(F.lit(1)).alias("candidates")).select("source", "candidates", F.col("r.threshold").alias("threshold"), F.col("r.attack_recall").alias("attack_recall"))


def _cumulative(rows: DataFrame, by: str, score: str, label: str, most_rows: int = prefix.MOST_ROWS) -> DataFrame:
    """Per group and distinct score, from the highest: positives, negatives, and both so far and in all."""
    counted = rows.groupBy(by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    found = prefix.running(counted, [by], [F.desc(score)], {"tp": "p", "fp": "n"}, most_rows=most_rows)
    return found.withColumnsRenamed({"tp_all": "pos", "fp_all": "neg"})


def _both(value: Column) -> Column:
    """The value, or 0 where a class is empty."""
    return F.when((F.max("pos") > 0) & (F.max("neg") > 0), value).otherwise(F.lit(0.0))


def roc_auc(rows: DataFrame, by: str, score: str = "score", label: str = "label", *, most_rows: int = prefix.MOST_ROWS) -> DataFrame:
    """Area under the ROC curve; pairs of equal scores count half."""
    return _roc_auc(_cumulative(rows, by, score, label, most_rows), by)


def _roc_auc(c: DataFrame, by: str) -> DataFrame:
    wins = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + 0.5 * F.col("n") * F.col("p"))
    return c.groupBy(by).agg(_both(F.try_divide(wins, F.max("pos") * F.max("neg"))).alias("roc_auc"))


def average_precision(rows: DataFrame, by: str, score: str = "score", label: str = "label", *, most_rows: int = prefix.MOST_ROWS) -> DataFrame:
    return _average_precision(_cumulative(rows, by, score, label, most_rows), by)


def _average_precision(c: DataFrame, by: str) -> DataFrame:
    return c.groupBy(by).agg(_both(F.sum(F.try_divide("p", "pos") * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"))


def tpr_at_fpr(rows: DataFrame, by: str, key: str, target: float, score: str = "score", label: str = "label", *, most_rows: int = prefix.MOST_ROWS) -> DataFrame:
    """True positive rate while the false positive rate stays within the target; ties go by key."""
    return _tpr_at_fpr(rows, _cumulative(rows, by, score, label, most_rows), by, key, (target,), score, label, most_rows).select(by, F.col("tprs")[0].alias("tpr"))


def _tpr_at_fpr(rows: DataFrame, c: DataFrame, by: str, key: str, targets: tuple[float, ...], score: str, label: str, most_rows: int) -> DataFrame:
    """(group, tprs): one rate for each target.

    A prefix ends at the first negative beyond the target, so what counts is how many positives stand
    before the (floor(target * N) + 1)-th negative. The score of that negative is found over counted scores;
    only the rows of these few scores are ordered.
    """
    limits = F.posexplode(F.array(*(F.floor(F.col("neg") * F.lit(t) + F.lit(1e-9)).cast("long") for t in targets))).alias("which", "allowed")
    # the group's row of the score at which the first negative too many stands; without one, all positives count
    at = c.select("*", limits).where((F.col("fp") > F.col("allowed")) & (F.col("fp") - F.col("n") <= F.col("allowed")))
    at = at.select(F.col(by).alias("_by"), F.col(score).alias("_at"), "which", (F.col("tp") - F.col("p")).alias("_above"), (F.col("allowed") - F.col("fp") + F.col("n")).alias("_left"))
    meets = F.col(by).eqNullSafe(F.col("_by")) & (F.col(score) == F.col("_at"))
    tied = rows.join(at, meets).select(by, "which", "_above", "_left", F.col(key).alias("_key"), (F.col(label) == 1).cast("long").alias("_p"), (F.col(label) != 1).cast("long").alias("_neg"))
    tied = prefix.running(tied, [by, "which"], [F.col("_key")], {"_fp": "_neg"}, most_rows=most_rows)
    more = tied.groupBy(by, "which").agg((F.sum(F.when(F.col("_fp") <= F.col("_left"), F.col("_p")).otherwise(0)) + F.max("_above")).alias("_hit"))
    hits = more.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("which", "_hit"))).alias("_hits"))  # one entry for each target
    whole = c.groupBy(by).agg(F.max("pos").alias("pos"), F.max("neg").alias("neg")).alias("w").join(hits.alias("h"), F.col(f"w.{by}").eqNullSafe(F.col(f"h.{by}")), "left")
    rate = lambda i: F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.try_divide(F.coalesce(F.try_element_at("_hits", F.lit(i)), F.col("pos")), F.col("pos"))).otherwise(F.lit(0.0))
    return whole.select(F.col(f"w.{by}").alias(by), F.array(*(rate(i) for i in range(len(targets)))).alias("tprs"))


#: False positive rates at which detection is reported.
RATES = (0.01, 0.001, 0.0001)


def rate_name(rate: float) -> str:
    """The column of a rate, which it names by its share in a million."""
    return f"tpr_at_{round(rate * 1_000_000)}_ppm"


def rank_metrics(rows: DataFrame, by: str, key: str, score: str = "score", label: str = "label", rates: tuple[float, ...] = RATES, *, most_rows: int = prefix.MOST_ROWS) -> DataFrame:
    """Area under the curve, average precision, and the true positive rate at each rate, of scores that are counted and summed once."""
    rows = written(rows.select(by, key, score, label), "labelled")
    c = written(_cumulative(rows, by, score, label, most_rows), "cumulative")
    found = _roc_auc(c, by).join(_average_precision(c, by), by).join(_tpr_at_fpr(rows, c, by, key, rates, score, label, most_rows), by)
    return found.select(by, "roc_auc", "average_precision", *(F.col("tprs")[i].alias(rate_name(r)) for i, r in enumerate(rates)))


def hashed_order(key: str, seed: int) -> Column:
    """A seeded pseudo-random order that every engine can make: the hex SHA-256 of key and seed."""
    return F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256)


def held_share(keys: DataFrame, key: str, share: float, seed: int = 7) -> DataFrame:
    """(key, held_out): the first share of the distinct keys in a seeded order.

    The hash at which the share ends is found over counts of the hashes' first four digits, so no task orders all keys.
    """
    people = keys.select(key).distinct().withColumn("_h", hashed_order(key, seed)).withColumn("_d", F.substring("_h", 1, 4))
    first = people.groupBy("_d").agg(F.count(F.lit(1)).alias("_c"))
    before = first.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_c").over(Window.partitionBy(F.lit(1))))  # 65,536 rows at most
    place = F.row_number().over(Window.partitionBy("_d").orderBy("_h"))
    rows = people.withColumn("_place", place).join(before.drop("_c"), "_d")
    return rows.select(key, (F.col("_before") + F.col("_place") <= F.floor(F.col("_all") * F.lit(share))).alias("held_out"))


def temporal_spatial_split(events: DataFrame, cut: str, share: float, seed: int = 7) -> DataFrame:
    """Train before the date; test from it on, for the held-out share of principals alone.

    The held-out principals are the first of a seeded order of distinct principals.
    """
    held = held_share(events, "actor_email", share, seed)
    rows = events.join(held, "actor_email").withColumn("early", F.col("observed_at") < F.lit(cut).cast("timestamp_ntz"))
    part = F.when(F.col("early") & ~F.col("held_out"), "train").when(~F.col("early") & F.col("held_out"), "test").otherwise("unused")
    return rows.withColumn("part", part)


def by_scenario(obs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (for, event_id, score, label): each scenario's events and all baseline ones, and everything for ``__all__``.

    ``more`` names scenarios that are reported even if no event has them.
    """
    written_ = obs.select("event_id", "score", "truth")
    names = written_.where("truth <> 'baseline'").select(F.col("truth").alias("for")).distinct()
    extra = written_.sparkSession.createDataFrame([(x,) for x in (*more, "__all__")], "`for` string")
    attack = written_.where("truth <> 'baseline'").select(F.explode(F.array("truth", F.lit("__all__"))).alias("for"), "event_id", "score", F.lit(1).alias("label"))
    base = written_.where("truth = 'baseline'").join(F.broadcast(names.unionByName(extra))).select("for", "event_id", "score", F.lit(0).alias("label"))  # a row per scenario
    return attack.unionByName(base)


def attackers(events: DataFrame) -> DataFrame:
    return events.where("coalesce(scenario, 'baseline') <> 'baseline'").groupBy("scenario").agg(F.sort_array(F.collect_set("actor_email")).alias("principals"))


def numpy_units(rows: DataFrame, key: str, vector: str, to: str) -> DataFrame:
    """The key and the vector at length 1, worked out by NumPy."""

    def work(batches):
        for b in batches:
            v = [np.asarray(x, float) for x in b.column(1).to_pylist()]
            out = [(x / n if (n := np.linalg.norm(x)) > 0 else x * 0).tolist() for x in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, to])

    return rows.select(key, vector).mapInArrow(work, f"{key} {dict(rows.dtypes)[key]}, {to} array<double>")


#: How far two ways to the same vectors may be apart.
TOLERANCE = 1e-9


def max_difference(a: DataFrame, b: DataFrame, key: str, vector: str) -> DataFrame:
    """Largest absolute difference of two tables of vectors."""
    rows = a.select(key, F.col(vector).alias("_a")).join(b.select(key, F.col(vector).alias("_b")), key)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))).alias("max_difference"))


_R2 = "floor(({}) * 100 + 0.5::DOUBLE) / 100"
SQL = {
    "obs": f"SELECT event_id, source, truth, {_R2.format('score')} AS score, score >= 0.6::DOUBLE AS detected FROM scored",
    "nearest": " UNION ALL ".join(f"SELECT source, '{n}' AS quantile, list(score ORDER BY score)[floor((count(*) - 1) * {p}::DOUBLE + 0.5)::BIGINT + 1] AS value FROM obs GROUP BY source" for n, p in QUANTILES.items()),
    "nearest_base": " UNION ALL ".join(f"SELECT source, list(score ORDER BY score)[floor((count(*) - 1) * {p}::DOUBLE + 0.5)::BIGINT + 1] AS value FROM obs WHERE truth = 'baseline' GROUP BY source" for p in QUANTILES.values()),
    "sweep": f"""
  WITH t AS (SELECT DISTINCT source, threshold FROM (SELECT DISTINCT source, unnest([{", ".join(f"{x}::DOUBLE" for x in FIXED_THRESHOLDS)}]) AS threshold FROM obs UNION ALL SELECT source, floor(value * 10000 + 0.5::DOUBLE) / 10000 FROM nearest_base))
  SELECT t.source, threshold, {_R2.format("coalesce(count(*) FILTER (truth = 'baseline' AND score >= threshold)::DOUBLE / nullif(count(*) FILTER (truth = 'baseline'), 0), 0)")} AS baseline_alert_rate,
    {_R2.format("coalesce(count(*) FILTER (truth <> 'baseline' AND score >= threshold)::DOUBLE / nullif(count(*) FILTER (truth <> 'baseline'), 0), 0)")} AS attack_recall
  FROM t JOIN obs ON obs.source = t.source GROUP BY t.source, threshold""",
    "labelled": "SELECT d.doc_id, lang, n_chars::DOUBLE AS score, quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
    "ranked": "SELECT *, sum((label <> 1)::INT) OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS fp, sum((label <> 1)::INT) OVER (PARTITION BY lang) AS neg, sum((label = 1)::INT) OVER (PARTITION BY lang) AS pos FROM labelled",
}
NEEDS = {"obs": ["scored"], "nearest": ["obs"], "nearest_base": ["obs"], "sweep": ["obs", "nearest_base"], "labelled": [], "ranked": ["labelled"]}
