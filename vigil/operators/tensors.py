"""Vocabularies, padded model inputs, training pairs and negative samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import padded
from vigil.operators.evaluation import hashed_order
from vigil.session import written


def key_union(columns: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct keys of several tables' columns, as ``key``."""
    return reduce(DataFrame.unionByName, [df.select(F.col(c).alias("key")) for df, c in columns]).where("key IS NOT NULL").distinct()


def vocabulary(keys: DataFrame) -> DataFrame:
    """Dense numbers from 0 in the order of the keys.

    Keys are range-partitioned and numbered within partitions; the counts of the partitions before, of
    which there are few, are added. So no single task sees all keys. The ranges are written down, since
    the sampling that finds them could fall differently when a lost task is run again.
    """
    ranged = written(keys.select("key").repartitionByRange("key").sortWithinPartitions("key").withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part").orderBy("key")) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").select("key", (F.col("_before") + F.col("_own")).cast("long").alias("idx"))  # one row per partition


def indexed(df: DataFrame, column: str, vocabulary: DataFrame, to: str, default: int | None = None) -> DataFrame:
    """The number of each key; without a default rows of unknown keys are dropped."""
    vocab = vocabulary.select(F.col("key").alias(column), F.col("idx").alias(to))
    if default is None:
        return df.join(vocab, column)
    return df.join(vocab, column, "left").withColumn(to, F.coalesce(to, F.lit(default)))


def by_number(table: DataFrame, vocabularies: dict[str, DataFrame]) -> DataFrame:
    """The table with numbers in place of keys, columns named ``..._idx`` for ``..._key``; for export to trainers."""
    for column, vocab in vocabularies.items():
        table = indexed(table, column, vocab, column.removesuffix("_key") + "_idx").drop(column)
    return table


def by_key(table: DataFrame, vocabularies: dict[str, DataFrame]) -> DataFrame:
    """The other way round."""
    for column, vocab in vocabularies.items():
        number = column.removesuffix("_key") + "_idx"
        table = table.join(vocab.select(F.col("idx").alias(number), F.col("key").alias(column)), number).drop(number)
    return table


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def weighted_sets(rows: DataFrame, group: Sequence[str], idx: str, weight: str, n: int) -> DataFrame:
    """Per group: ``n`` tokens (number + 1, 0 as padding), weights and mask, by number."""
    first = top_n(rows, group, [F.col(idx)], n)
    sets = first.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(weight).cast("double").alias("w")))).alias("s"))
    return sets.select(*group, padded(F.transform("s", lambda x: x["i"] + 1), n, F.lit(0).cast("long")).alias("tokens"), padded(F.transform("s", lambda x: x["w"]), n, F.lit(0.0)).alias("weights"), padded(F.transform("s", lambda x: F.lit(True)), n, F.lit(False)).alias("mask"))


def history_tensors(rows: DataFrame, windows: int, resources: int) -> DataFrame:
    """Per principal: the latest windows, each with its first resources (number + 1), padded both ways. Rows: principal, window_start, idx."""
    each = rows.groupBy("principal", "window_start").agg(F.slice(F.sort_array(F.collect_set(F.col("idx") + 1)), 1, resources).alias("r"))
    latest = top_n(each, ["principal"], [F.desc("window_start")], windows)
    full = latest.withColumn("r", padded(F.col("r"), resources, F.lit(0).cast("long")))
    listed = full.groupBy("principal").agg(F.transform(F.sort_array(F.collect_list(F.struct("window_start", "r"))), lambda x: x["r"]).alias("w"))
    empty = F.array_repeat(F.lit(0).cast("long"), resources)
    return listed.select("principal", padded(F.col("w"), windows, empty).alias("history"))


PEER_KINDS = ("department", "manager", "group", "collaboration")


def peer_tensors(rows: DataFrame, n: int) -> DataFrame:
    """Per principal the weighted sets of the four kinds of peers, in fixed order. Rows: principal, kind, idx, weight."""
    sets = weighted_sets(rows, ["principal", "kind"], "idx", "weight", n)
    none = F.struct(F.array_repeat(F.lit(0).cast("long"), n).alias("tokens"), F.array_repeat(F.lit(0.0), n).alias("weights"), F.array_repeat(F.lit(False), n).alias("mask"))
    by_kind = sets.groupBy("principal").agg(*(F.max(F.when(F.col("kind") == k, F.struct("tokens", "weights", "mask"))).alias(k) for k in PEER_KINDS))
    return by_kind.select("principal", F.array(*(F.coalesce(k, none) for k in PEER_KINDS)).alias("peers"))


def padding_limits(sizes: DataFrame, column: str, cap: int) -> DataFrame:
    return sizes.agg(F.least(F.lit(cap), F.max(F.size(column))).alias("limit"))


def categorical_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Numbers from 1 of the distinct values in order; 0 is for unknown ones. For columns with few values."""
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return values.select("value", F.row_number().over(Window.orderBy("value")).cast("long").alias("idx"))


def training_pairs(accessors: DataFrame, static: DataFrame) -> DataFrame:
    """Distinct (resource, principal, source) whose principal has a profile."""
    return accessors.select("resource_key", "principal_key", "source").distinct().join(static.select("principal_key"), "principal_key", "left_semi")


def held_out_pairs(pairs: DataFrame, share: float = 0.2, seed: int = 7) -> DataFrame:
    """Marks the share of pairs that is held out: at least one of five or more, none of fewer. The order is by hash."""
    keyed = pairs.withColumn("_k", F.concat_ws("|", "resource_key", "principal_key", "source")).withColumn("_h", hashed_order("_k", seed))
    n = keyed.agg(F.count(F.lit(1)).alias("_all"))
    keep = F.when(F.col("_all") < 5, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(share))))
    # the n-th smallest hash, found over the hashes' first digits, bounds the held-out pairs
    place = F.row_number().over(Window.partitionBy(F.substring("_h", 1, 2)).orderBy("_h"))
    first = keyed.groupBy(F.substring("_h", 1, 2).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    before = first.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_d", "_before")  # 256 rows
    rows = keyed.withColumn("_p", place).join(F.broadcast(before), F.substring("_h", 1, 2) == F.col("_d")).join(F.broadcast(n))
    return rows.withColumn("held_out", F.col("_before") + F.col("_p") <= keep).select(*pairs.columns, "held_out")


def negative_samples(pairs: DataFrame, people: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """``k`` other principals for each pair, by hash; ``people`` has principal_key and dense idx."""
    n = people.agg(F.count(F.lit(1)).alias("_all"))
    rows = pairs.join(people, "principal_key").join(F.broadcast(n)).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(k))))
    text = F.concat_ws(":", "resource_key", "principal_key", "source", F.col("i").cast("string"), F.lit(str(seed)))
    draw = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % (F.col("_all") - 1)
    # numbers from the principal's own on move up by one, so the principal itself is never drawn
    rows = rows.withColumn("_other", F.when(draw >= F.col("idx"), draw + 1).otherwise(draw))
    return rows.drop("idx", "_all").join(people.select(F.col("principal_key").alias("negative_key"), F.col("idx").alias("_other")), "_other").drop("_other")


SQL = {
    "vocab": "SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM (SELECT DISTINCT key FROM (SELECT principal_key AS key FROM accessors UNION ALL SELECT principal_key FROM static))",
    "pairs": "SELECT DISTINCT resource_key, principal_key, source FROM accessors WHERE principal_key IN (SELECT principal_key FROM static)",
}
NEEDS = {"vocab": ["accessors", "static"], "pairs": ["accessors", "static"]}
