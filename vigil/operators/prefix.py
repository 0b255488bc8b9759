"""Running sums and ranks within groups of any size.

A window over a group orders all its rows in one task. Here rows are cut into ranges of (group, order) first, which splits
a large group over many tasks; each range is summed by itself, and what earlier ranges of the group hold is added. A range
boundary lies within one group at most, so the sums that are carried over are as few as the ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.session import written

#: Rows that one task may order: below, a plain window is taken.
MOST_ROWS = 1_000_000
PART = "_part"


def ranged(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The rows with the number of their range, written down, since ranges are drawn anew when they are read again."""
    return written(rows.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def same(left: str, right: str, names: list[str]) -> Column:
    """Equality of columns of two aliased tables, null with null."""
    return reduce(Column.__and__, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names])


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], *, most_rows: int = MOST_ROWS) -> DataFrame:
    """Adds for each (name, column) the column's sum over the group's rows up to this one, and as ``name_all`` over all of them.

    The order within a group must leave no ties.
    """
    rows = written(rows, "counted")
    if rows.count() <= most_rows:
        down, whole = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
        return rows.withColumns({k: v for name, c in sums.items() for k, v in ((name, F.sum(c).over(down)), (f"{name}_all", F.sum(c).over(whole)))})
    cut = ranged(rows, by, order)
    parts = cut.groupBy(*by, PART).agg(*(F.sum(c).alias(f"{name}_part") for name, c in sums.items()))
    group = Window.partitionBy(*by)
    earlier = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, PART, *(F.coalesce(F.sum(f"{n}_part").over(earlier), F.lit(0)).alias(f"{n}_before") for n in sums), *(F.sum(f"{n}_part").over(group).alias(f"{n}_all") for n in sums))
    inside = Window.partitionBy(PART, *by).orderBy(*order)
    cut = cut.withColumns({f"{n}_own": F.sum(c).over(inside) for n, c in sums.items()})
    found = cut.alias("r").join(parts.alias("p"), same("r", "p", [*by, PART]))
    return found.select(*(F.col(f"r.{c}").alias(c) for c in rows.columns), *((F.col(f"r.{n}_own") + F.col(f"p.{n}_before")).alias(n) for n in sums), *(F.col(f"p.{n}_all").alias(f"{n}_all") for n in sums))


def ranks(rows: DataFrame, by: list[str], order: list[Column], within: dict[str, list[str]], firsts: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds for each (name, columns) how many rows of the same ``by`` and columns come before; for each of ``firsts``,
    (name, (column, seen)), how many different values of the column come before, and whether this row's is among them.

    ``order`` must leave no ties; null values of a column of ``firsts`` don't count.
    """
    firsts = firsts or {}
    cut = ranged(rows, by, order)
    ends = cut.groupBy(*by).agg(F.min(PART).alias("_lo"), F.max(PART).alias("_hi")).where("_lo < _hi")
    # groups over several ranges: fewer than ranges
    inside = cut.alias("r").join(F.broadcast(ends).alias("e"), same("r", "e", by)).select("r.*")
    spare = {f.name: F.lit(None).cast(f.dataType) for f in cut.schema} | {"_w": F.lit(1).cast("long"), "_kind": F.lit(None).cast("string")}

    def shaped(df: DataFrame, **cols: Column) -> DataFrame:
        given = {**spare, **{c: F.col(c) for c in df.columns}, **cols}
        return df.select(*(given[c].alias(c) for c in (*cut.columns, "_w", "_kind")))

    both = shaped(cut)
    for kind, columns in {**within, **{f"{name}.": [c] for name, (c, _) in firsts.items()}}.items():
        counts = inside.groupBy(*by, *columns, PART).agg(F.count(F.lit(1)).alias("_c"))
        earlier = Window.partitionBy(*by, *columns).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        both = both.unionByName(shaped(counts.withColumn("_w", F.sum("_c").over(earlier)).where("_w > 0").drop("_c"), _kind=F.lit(kind)))
    for name, (column, _) in firsts.items():
        new = inside.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.min(PART).alias(PART)).groupBy(*by, PART).agg(F.count(F.lit(1)).alias("_c"))
        every = new.unionByName(inside.select(*by, PART, F.lit(0).cast("long").alias("_c")).distinct()).groupBy(*by, PART).agg(F.sum("_c").alias("_c"))
        earlier = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        both = both.unionByName(shaped(every.withColumn("_w", F.sum("_c").over(earlier)).where("_w > 0").drop("_c"), _kind=F.lit(name)))
    # carried counts come first in their range; all windows share one shuffle
    both = both.repartition(PART, *by)
    lead = (F.col("_kind").isNull().cast("int"), *order)
    window = lambda *c: Window.partitionBy(PART, *by, *c).orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
    weight = lambda kind: F.when(F.col("_kind").isNull(), 1).when(F.col("_kind") == kind, F.col("_w")).otherwise(0)
    before = lambda kind, c: F.coalesce(F.sum(weight(kind)).over(window(*c)), F.lit(0))
    both = both.withColumns({name: before(name, c) for name, c in within.items()} | {seen: F.col(column).isNotNull() & (before(f"{name}.", [column]) > 0) for name, (column, seen) in firsts.items()})
    for name, (column, seen) in firsts.items():
        new = F.when(F.col("_kind") == name, F.col("_w")).when(F.col("_kind").isNull() & F.col(column).isNotNull() & ~F.col(seen), 1).otherwise(0)
        both = both.withColumn(name, F.coalesce(F.sum(new).over(window()), F.lit(0)))
    return both.where("_kind IS NULL").drop("_w", "_kind", PART)
