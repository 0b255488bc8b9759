"""Running sums and ranks by ranges against plain windows, with a key that has most rows."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import context, evaluation, normalize, prefix
from vigil.sources import adapter


def skewed(spark, sf):
    """Accepted events in which one principal has half of the rows, and one resource of a department many."""
    e = normalize.normalized(adapter.raw_events(spark, sf))
    own = F.xxhash64("event_id") % 2 == 0
    e = e.withColumn("actor_email", F.when(own, F.lit("service@example.com")).otherwise(F.col("actor_email")))
    e = e.withColumn("department", F.when(F.xxhash64("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("one")))
    return e.withColumn("geo", F.when(F.xxhash64("event_id") % 5 == 0, F.lit(None)).when(F.xxhash64("event_id") % 5 == 1, F.lit("")).otherwise(F.col("geo"))).cache()


NAMES = ("prior_events", "prior_actions", "prior_resource", "peer_resource", "prior_geos")


def test_context_by_ranges_equals_windows(spark, sf):
    e = skewed(spark, sf)
    wanted = lambda df: df.select("event_id", *(F.col(c).cast("long").alias(c) for c in NAMES), "geo_seen")
    a, b = wanted(context.detection_context(e, most_bytes=1 << 62)), wanted(context.detection_context(e, most_bytes=0))
    assert a.count() == e.count() > 500 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    # no range has much more than the others, though one key has half of the rows
    cut = prefix.ranged(e.repartition(8), ["actor_email"], [F.col("observed_at"), F.col("event_id")])
    sizes = sorted(r["count"] for r in cut.groupBy(prefix.PART).count().collect())
    assert len(sizes) == 1 or sizes[-1] <= 4 * sizes[len(sizes) // 2]
    assert context.detection_context(e.limit(0), most_bytes=0).count() == 0
    e.unpersist()


def test_ranks_over_many_ranges(spark):
    """Groups that begin, end and lie within ranges; nulls as groups and values."""
    r = random.Random(7)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), i, r.choice(["x", "y", None]), r.choice(["p", "q", "r", "s", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, v string, g string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = prefix.ranks(df, ["k"], [F.col("at")], {"all": [], "same": ["v"]}, {"kinds": ("g", "seen")}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before: dict = {}
    expected = []
    for k, at, v, g in rows:
        had = before.setdefault(k, [0, {}, set()])
        expected.append((k, at, had[0], had[1].get(v, 0), len(had[2]), g in had[2] if g else False))
        had[0] += 1
        had[1][v] = had[1].get(v, 0) + 1
        had[2] |= {g} - {None}
    assert sorted(((x.k, x["at"], x["all"], x.same, x.kinds, x.seen) for x in found), key=lambda x: x[1]) == expected


@pytest.mark.parametrize("most_rows", [prefix.MOST_ROWS, 0])
def test_quantiles_and_rank_metrics(spark, most_rows):
    r = random.Random(3)
    rows = [(g, i, round(r.random(), 2 if g == "ties" else 9), int(r.random() < 0.3)) for g, n in (("ties", 400), ("fine", 700), ("none", 20)) for i in range(n)]
    rows = [(g, i, s, 0 if g == "none" else y) for g, i, s, y in rows]
    df = spark.createDataFrame(rows, "g string, id int, score double, label int").repartition(5)
    found = {(x.g, x.quantile): x.value for x in evaluation.nearest_rank(df, "g", most_rows=most_rows).collect()}
    metrics = {x.g: x for x in evaluation.rank_metrics(df, "g", "id", rates=(0.1, 0.01, 0.001, 0.0001), most_rows=most_rows).collect()}
    for g in ("ties", "fine", "none"):
        own = [x for x in rows if x[0] == g]
        scores = sorted(x[2] for x in own)
        assert all(found[g, q] == scores[int((len(scores) - 1) * p + 0.5)] for q, p in evaluation.QUANTILES.items())
        pos, neg = [x[2] for x in own if x[3] == 1], [x[2] for x in own if x[3] != 1]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else 0
        assert abs(metrics[g].roc_auc - auc) < 1e-9
        precision = 0.0
        for s in sorted(set(x[2] for x in own), reverse=True):
            tp, fp, p = sum(x >= s for x in pos), sum(x >= s for x in neg), sum(x == s for x in pos)
            precision += p / max(1, len(pos)) * tp / (tp + fp)
        assert abs(metrics[g].average_precision - (precision if pos and neg else 0)) < 1e-9
        ranked = sorted(own, key=lambda x: (-x[2], x[1]))
        for rate in (0.1, 0.01, 0.001, 0.0001):
            name = evaluation.rate_name(rate)
            fp = best = tp = 0
            for x in ranked:
                fp, tp = fp + (x[3] != 1), tp + (x[3] == 1)
                best = tp if neg and fp <= int(rate * len(neg) + 1e-9) else best
            assert abs(metrics[g][name] - (best / len(pos) if pos and neg else 0)) < 1e-12, (g, name)
