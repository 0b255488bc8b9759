"""Retention and appends by partition, and cases in order of time, against plain loops."""

import datetime
import os

from pyspark.sql import functions as F

from vigil.operators import investigation, normalize
from vigil.session import shared_path
from vigil.sources import adapter, lake


def files(path):
    at = path.removeprefix("file://")
    return {os.path.join(d, f) for d, _, names in os.walk(at) for f in names if f.endswith(".parquet")}


def test_expiry_touches_old_partitions_alone(spark, sf):
    path, archive = shared_path(spark, "lake"), shared_path(spark, "archive")
    rows = normalize.envelopes(adapter.raw_events(spark, sf)).cache()
    lake.write_raw(rows, path)
    before = files(path)
    dropped = lake.expire(spark, path, 20, archive)
    after = files(path)
    assert after < before and len({os.path.dirname(f) for f in before - after}) == dropped > 0
    left, gone = spark.read.parquet(path), spark.read.parquet(archive)
    assert left.count() + gone.count() == rows.count() and left.agg(F.min("dt")).first()[0] > gone.agg(F.max("dt")).first()[0]
    assert lake.expire(spark, path, 20, archive) == 0 and files(path) == after
    rows.unpersist()


def test_appends_read_their_own_hours(spark):
    path = shared_path(spark, "detections")
    frame = lambda rows: spark.createDataFrame([("default", i, t) for i, t in rows], "tenant_id string, detection_id string, observed_at string")
    first = [("a", "2024-01-01 05:00:00"), ("b", "2024-01-01 07:00:00"), ("c", "2024-01-02 05:00:00")]
    assert lake.append_detections(frame(first), path) == 3
    assert lake.append_detections(frame([*first[:1], ("d", "2024-01-01 05:30:00")]), path) == 1
    assert lake.append_detections(frame(first), path) == 3 and lake.append_detections(frame(first).limit(0), path) == 0
    assert sorted(r.detection_id for r in lake.read_detections(spark, path).collect()) == ["a", "b", "c", "d"]


def test_cases_follow_each_other(spark):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    hours = {"p": [0, 3, 6, 6.5, 12, 12.4, 13, 30], "q": [5], "r": [1, 1, 7, 7.01]}
    rows = [(p, f"{p}{i}", at(h)) for p, hs in hours.items() for i, h in enumerate(hs)]
    found = {r.detection_id: r.case_id for r in investigation.cases(spark.createDataFrame(rows[::-1], "principal_id string, detection_id string, observed_at timestamp_ntz").repartition(3)).collect()}
    for p, hs in hours.items():
        anchor = None
        for i, h in enumerate(hs):
            if anchor is None or h > hs[anchor] + 6:
                anchor = i
            assert found[f"{p}{i}"] == f"case-{p}{anchor}"
    assert len(found) == len(rows)


def test_tree_is_compressed(spark, sf):
    from vigil.plans import lakes

    files = lakes.QUERIES["tree_or_lake"](spark, sf).inputFiles()
    trees = [f for f in files if ".json" in f]
    assert trees and all(f.endswith(".json.gz") for f in trees)
