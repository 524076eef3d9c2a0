"""Ordered operations over groups of any size.

A window over a group sorts it in one task. Here the rows are first spread by ranges of (group, order), so a hot group
stands in many tasks; each task works on its own stretch of a group, and what must cross from stretch to stretch
(counts, first and last values) travels in a table of one row per group and stretch. Groups that all fit in
`floor` rows take the plain window: the plan differs, the result does not.

Defined edge cases: rows of a null group are one group; ties in the order are broken by all columns of the order only,
so the order must be total where results depend on it; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from libroflow.session import cut

FLOOR = 500_000  # rows of one group that one task sorts


def _hot(df: DataFrame, group: str, floor: int) -> bool:
    return (df.groupBy(group).count().agg(F.max("count")).first()[0] or 0) > floor


def _stretched(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with `_part`, the number of their range; kept, so that a range once drawn stays."""
    return cut(df.repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))


def _joined(df: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    side = edges.withColumnRenamed(group, "_g").withColumnRenamed("_part", "_q")
    return df.join(side, df[group].eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_q"))).drop("_g", "_q")


def row_numbers(df: DataFrame, group: str, order: list[str], out: str, floor: int = FLOOR) -> DataFrame:
    """`out`: the place of a row in its group, from 1."""
    if not _hot(df, group, floor):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))
    rows = _stretched(df, group, order)
    sizes = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumn(out, F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)).cast("bigint"))
    return _joined(numbered, sizes.withColumn("_before", before).drop("_n"), group).withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def next_values(df: DataFrame, group: str, order: list[str], columns: dict[str, str], floor: int = FLOOR) -> DataFrame:
    """The values of the next row of the group: column -> name of the new column."""
    if not _hot(df, group, floor):
        w = Window.partitionBy(group).orderBy(*order)
        return df.withColumns({new: F.lead(c).over(w) for c, new in columns.items()})
    rows = _stretched(df, group, order)
    w = Window.partitionBy(group, "_part").orderBy(*order)
    firsts = rows.groupBy(group, "_part").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    edges = firsts.select(group, "_part", F.lead("_first").over(Window.partitionBy(group).orderBy("_part")).alias("_after"))
    at_end = F.lead(F.lit(True)).over(w).isNull()
    out = _joined(rows.withColumn("_end", at_end).withColumns({new: F.lead(c).over(w) for c, new in columns.items()}), edges, group)
    return out.withColumns({new: F.when(F.col("_end"), F.col(f"_after.{c}")).otherwise(F.col(new)) for c, new in columns.items()}).drop("_part", "_end", "_after")


def nearest_known(df: DataFrame, group: str, order: list[str], column: str, last: str, following: str, floor: int = FLOOR) -> DataFrame:
    """`last` and `following`: the values of the nearest rows before and after in the group where the column is not null."""
    upto, beyond = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    if not _hot(df, group, floor):
        w = Window.partitionBy(group).orderBy(*order)
        return df.withColumn(last, F.last(column, True).over(w.rowsBetween(*upto))).withColumn(following, F.first(column, True).over(w.rowsBetween(*beyond)))
    rows = _stretched(df, group, order)
    known = F.when(F.col(column).isNotNull(), F.struct(*order))
    ends = rows.groupBy(group, "_part").agg(F.max_by(column, known).alias("_l"), F.min_by(column, known).alias("_f"))
    parts = Window.partitionBy(group).orderBy("_part")
    edges = ends.select(group, "_part", F.last("_l", True).over(parts.rowsBetween(*upto)).alias("_before"), F.first("_f", True).over(parts.rowsBetween(*beyond)).alias("_after"))
    w = Window.partitionBy(group, "_part").orderBy(*order)
    near = rows.withColumn(last, F.last(column, True).over(w.rowsBetween(*upto))).withColumn(following, F.first(column, True).over(w.rowsBetween(*beyond)))
    return _joined(near, edges, group).withColumn(last, F.coalesce(last, "_before")).withColumn(following, F.coalesce(following, "_after")).drop("_part", "_before", "_after")
