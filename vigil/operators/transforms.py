"""Row transforms with lineage and captured failures: filter, map, routes, dead letters, user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


def with_metadata(df: DataFrame) -> DataFrame:
    """Adds the columns that chains keep: lineage, reason and attempts."""
    return df.withColumn("lineage", F.array().cast("array<string>")).withColumn("reason", F.lit(None).cast("string")).withColumn("attempts", F.lit(0))


def filtering(condition: Column) -> Transform:
    """Rows for which the condition holds; failed rows pass."""
    return lambda df: df.where(condition | F.col("reason").isNotNull())


def mapping(**columns: Column) -> Transform:
    """Replaces columns of rows that haven't failed."""
    return lambda df: df.withColumns({k: F.when(F.col("reason").isNull(), v).otherwise(F.col(k)) if k in df.columns else F.when(F.col("reason").isNull(), v) for k, v in columns.items()})


def checking(condition: Column, reason: str) -> Transform:
    """Rows for which the condition doesn't hold fail with the reason."""
    return lambda df: df.withColumn("reason", F.coalesce("reason", F.when(~F.coalesce(condition, F.lit(False)), reason)))


def routing(routes: Sequence[tuple[Column, Transform]]) -> Transform:
    """Each row goes through the first route whose condition holds, or past all."""

    def run(df: DataFrame) -> DataFrame:
        place = F.lit(-1)
        for i, (condition, _) in reversed(list(enumerate(routes))):
            place = F.when(condition, i).otherwise(place)
        rows = df.withColumn("_route", place)
        parts = [f(rows.where(F.col("_route") == i)) for i, (_, f) in enumerate(routes)] + [rows.where("_route = -1")]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).drop("_route")

    return run


def chain(df: DataFrame, steps: Sequence[tuple[str, Transform]]) -> DataFrame:
    """The steps one after the other; each leaves its name in the lineage of rows that it didn't fail."""
    for name, step in steps:
        df = step(df).withColumn("lineage", F.when(F.col("reason").isNull(), F.array_append("lineage", F.lit(name))).otherwise(F.col("lineage")))
    return df


def split_dead(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("reason IS NULL"), df.where("reason IS NOT NULL")


def retry_split(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows, failed rows to try again, and failed rows that have had all their attempts."""
    tried = df.withColumn("attempts", F.when(F.col("reason").isNotNull(), F.col("attempts") + 1).otherwise(F.col("attempts")))
    bad = tried.where("reason IS NOT NULL")
    again = bad.where(F.col("attempts") < most).withColumn("reason", F.lit(None).cast("string"))
    return tried.where("reason IS NULL"), again, bad.where(F.col("attempts") >= most)


def user_transform(df: DataFrame, f: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """A Python function from one row to any number of rows. An error becomes a row with ``error``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out += [{**{n: None for n in names}, **x, "error": None} for x in f(row)]
                except ValueError as e:
                    out.append({**{n: row.get(n) for n in names}, "error": str(e)})
            yield pd.DataFrame(out, columns=[*names, "error"])

    return df.mapInPandas(run, f"{schema}, error string")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
