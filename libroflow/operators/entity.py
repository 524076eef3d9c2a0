"""Volume-level people: qualified ids, attribute folding, numbered clusters and remapped references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from libroflow.functions.text import pad
from libroflow.operators.windows import row_numbers


def qualified(entry: Column, person: Column) -> Column:
    return F.concat_ws("-", entry, person)


def folded(df: DataFrame, group: list[str], order: list[str], fields: list[str], lists: list[str] = ()) -> DataFrame:
    """Records of a group merged: each field's distinct values, nulls left out, in the order they were first seen.

    Values are pre-aggregated by (group, value) with their first place, so what is gathered per group is bounded by
    its distinct values.
    """
    place = F.struct(*order)
    kinds = [(f, F.array(F.col(f).cast("string"))) for f in fields] + [(f, F.coalesce(F.col(f), F.array().cast("array<string>"))) for f in lists]
    long = df.select(*group, place.alias("_at"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), v.alias("v")) for f, v in kinds])).alias("x"))
    cells = long.select(*group, "_at", F.col("x.f").alias("f"), F.posexplode("x.v").alias("i", "v")).filter(F.col("v").isNotNull())
    firsts = cells.groupBy(*group, "f", "v").agg(F.min(F.struct("_at", "i")).alias("at"))
    gathered = firsts.groupBy(*group).pivot("f", [f for f, _ in kinds]).agg(F.array_sort(F.collect_list(F.struct("at", "v"))))
    return gathered.select(*group, *[F.coalesce(F.transform(F.col(f), lambda s: s["v"]), F.array().cast("array<string>")).alias(f) for f, _ in kinds])


def scalar_view(values: Column) -> Column:
    """The value of a folded field where there is exactly one."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def numbered(groups: DataFrame, volume: str, first: list[str], out: str) -> DataFrame:
    """Volume-unique ids `volume-P00001` in the order of first mention, numbered over the volume's groups only."""
    return row_numbers(groups, volume, first, "_n").withColumn(out, F.concat(F.col(volume).cast("string"), F.lit("-P"), pad(F.col("_n"), 5))).drop("_n")


def remapped(df: DataFrame, scope: str, ref: str, ids: DataFrame, old: str, new: str) -> DataFrame:
    """References replaced by the new id of their target; those that lead nowhere stay as they are."""
    side = ids.select(F.col(scope).alias("_s"), F.col(old).alias("_o"), F.col(new).alias("_n"))
    return df.join(side, (F.col(scope) == F.col("_s")) & (F.col(ref) == F.col("_o")), "left").withColumn(ref, F.coalesce("_n", ref)).drop("_s", "_o", "_n")


def picked(key: Column, terms: list[str], seed: str = "", none: str = "N/A") -> Column:
    """One of the terms for each key, by a hash of seed and key; `none` where there are no terms. The list travels as a
    literal."""
    if not terms:
        return F.lit(none)
    place = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("bigint") % len(terms)
    return F.element_at(F.array(*[F.lit(t) for t in terms]), (place + 1).cast("int"))


def event_ids(entry: Column, events: Column) -> Column:
    """Ids `entry-E00` by place."""
    return F.transform(events, lambda _, i: F.concat(entry, F.lit("-E"), pad(i, 2)))


def entry_numbers(entries: DataFrame, image: list[str], order: list[str], out: str) -> DataFrame:
    """Two-digit entry numbers per image."""
    return entries.withColumn(out, pad(F.row_number().over(Window.partitionBy(*image).orderBy(*order)), 2))


def outside_vocabulary(df: DataFrame, value: str, vocabulary: DataFrame, key: str) -> DataFrame:
    """Rows whose value is no term of the list `key`."""
    terms = vocabulary.filter(F.col("vocab_key") == key).select(F.explode("vocab").alias("_t"))
    return df.filter(F.col(value).isNotNull()).join(terms, F.col(value) == F.col("_t"), "left_anti")
