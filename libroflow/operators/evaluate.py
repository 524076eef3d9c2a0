"""Evaluation: soft field metrics, text similarity, box matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libroflow.functions.geometry import f_score, iou
from libroflow.functions.similarity import indel_ratio


def field_scores(truth: Column, test: Column, has_truth: Column, has_test: Column, similarity: Column) -> Column:
    """(tp, fp, fn, null_fp) of one field of one person; presence means that the key exists, null or not."""
    some = test.isNotNull() & (test != "")
    empty = truth.isNull() | (truth == "")
    row = lambda tp, fp, fn, nfp: F.struct(tp.cast("double").alias("tp"), fp.cast("double").alias("fp"), fn.cast("double").alias("fn"), nfp.cast("double").alias("null_fp"))
    zero, one = F.lit(0.0), F.lit(1.0)
    both = (
        F.when(empty & some, row(zero, zero, zero, one))
        .when(truth.isNotNull() & test.isNotNull(), row(similarity, 1 - similarity, 1 - similarity, zero))
        .when(truth.eqNullSafe(test), row(one, zero, zero, zero))
        .otherwise(row(zero, one, one, zero))
    )
    return F.when(has_truth & has_test, both).when(has_test, row(zero, one, zero, some.cast("int"))).when(has_truth, row(zero, zero, one, zero)).otherwise(row(zero, zero, zero, zero))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def micro(scores: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F of summed scores."""
    out = scores.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "null_fp")])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f", f_score(F.col("precision"), F.col("recall")))


def is_empty(c: Column) -> Column:
    """Null, or a list without elements."""
    return c.isNull() | (F.size(c) == 0)


def same_value(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Whether two texts are the same: both null, or at least so similar; equality where that is all that is asked."""
    alike = a == b if threshold >= 1 else indel_ratio(a, b) >= threshold
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(alike)


def same_list(a: Column, b: Column) -> Column:
    """Whether two lists hold the same members, order and repeats aside."""
    members = lambda c: F.array_sort(F.array_distinct(F.array_compact(c)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(members(a) == members(b))


def common_last(truth: DataFrame, test: DataFrame, on: list[str], truth_order: list[str], test_order: list[str]) -> DataFrame:
    """What truth and test share by the keys `on`, with the order columns of the last row of each side as structs `truth`
    and `test`: of repeated keys the last counts."""
    a = truth.groupBy(*on).agg(F.max(F.struct(*truth_order)).alias("truth"))
    return a.join(test.groupBy(*on).agg(F.max(F.struct(*test_order)).alias("test")), on)


def text_metric(pairs: DataFrame, truth: str, test: str) -> DataFrame:
    """One row: similarity and its complement summed over the pairs, and precision = recall = F = their mean."""
    s = text_similarity(pairs, truth, test).agg(F.sum("similarity").alias("tp"), F.sum(1 - F.col("similarity")).alias("fp"), F.count("similarity").alias("n"))
    return s.withColumn("f", ratio(F.col("tp"), F.col("n")))


def text_similarity(pairs: DataFrame, truth: str, test: str, out: str = "similarity") -> DataFrame:
    return pairs.withColumn(out, indel_ratio(F.col(truth), F.col(test)))


def greedy_matches(truth: Column, found: Column, threshold: float = 0.5) -> Column:
    """Number of found boxes that match one-to-one: each takes the first truth left with enough overlap."""
    left = F.transform(truth, lambda t, i: i)
    start = F.struct(left.alias("left"), F.lit(0).alias("n"))

    def step(acc: Column, box: Column) -> Column:
        hit = F.filter(acc["left"], lambda i: iou(F.get(truth, i), box) >= threshold)
        taken = F.get(hit, F.lit(0))
        return F.when(F.size(hit) > 0, F.struct(F.filter(acc["left"], lambda i: i != taken).alias("left"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    return F.aggregate(found, start, step, lambda s: s["n"])


_EDGES = ["box_id", "left", "top", "right", "bottom"]


def overlapping(a: DataFrame, b: DataFrame, image: str, tile: int = 200) -> DataFrame:
    """Pairs of boxes of one image that share area, by grid: each box goes to the tiles it covers, boxes meet in their
    tiles, and a pair counts only in the tile of its shared corner, so no pair comes twice."""

    def tiled(df: DataFrame, name: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / tile), F.floor((F.col(hi) - 1) / tile))
        real = df.filter((F.col("right") > F.col("left")) & (F.col("bottom") > F.col("top")))
        flat = [F.col(c).alias(f"{name}_{c}") for c in _EDGES]
        return real.select(F.col(image).alias(f"{name}_image"), *flat, F.explode(span("left", "right")).alias(f"{name}_x"), span("top", "bottom").alias("_ys")).withColumn(f"{name}_y", F.explode("_ys")).drop("_ys")

    met = tiled(a, "a").join(tiled(b, "b"), (F.col("a_image") == F.col("b_image")) & (F.col("a_x") == F.col("b_x")) & (F.col("a_y") == F.col("b_y")))
    x, y = F.greatest("a_left", "b_left"), F.greatest("a_top", "b_top")
    shared = (x < F.least("a_right", "b_right")) & (y < F.least("a_bottom", "b_bottom"))
    kept = met.filter(shared & (F.floor(x / tile) == F.col("a_x")) & (F.floor(y / tile) == F.col("a_y")))
    box = lambda name: F.struct(*[F.col(f"{name}_{c}").alias(c) for c in _EDGES]).alias(name)
    return kept.select(F.col("a_image").alias(image), box("a"), box("b"))


def box_pairs(a: DataFrame, b: DataFrame, image: str) -> DataFrame:
    """Overlapping pairs with their intersection over union."""
    return overlapping(a, b, image).withColumn("iou", iou(F.col("a"), F.col("b")))
