"""Boxes as (left, top, right, bottom), intervals, divisors and colour ramps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Length shared by two intervals; touching ones share 0."""
    return F.greatest(F.lit(0), F.least(a2, b2) - F.greatest(a1, b1))


def box_overlap(a: Column, b: Column) -> Column:
    """Area shared by two boxes; disjoint ones share 0."""
    return overlap(a["left"], a["right"], b["left"], b["right"]) * overlap(a["top"], a["bottom"], b["top"], b["bottom"])


def area(a: Column) -> Column:
    return (a["right"] - a["left"]) * (a["bottom"] - a["top"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    shared = box_overlap(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def f_score(p: Column, r: Column) -> Column:
    return F.when((p == 0) | (r == 0), 0.0).otherwise(2 * p * r / (p + r))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers by Euclid's steps: as many as the smaller one can need (its logarithm to
    the golden ratio), whatever its size."""
    x, y = F.abs(a).cast("bigint"), F.abs(b).cast("bigint")
    steps = F.ceil(1.4405 * F.log2(F.least(x, y).cast("double") + 1)).cast("int") + 2
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.when(s["y"] != 0, s["x"] % s["y"]).otherwise(F.lit(0).cast("bigint")).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(x.alias("x"), y.alias("y")), step)["x"]


def area_scores(shared: Column, truth: Column, found: Column) -> Column:
    """Precision, recall and F of areas: what is shared against all that was found and all that is true."""
    p, r = F.when(found > 0, shared / found).otherwise(0.0), F.when(truth > 0, shared / truth).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), f_score(p, r).alias("f"))


def to_corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    """(x, y, width, height) as (left, top, right, bottom)."""
    return F.struct(x.alias("left"), y.alias("top"), (x + w).alias("right"), (y + h).alias("bottom"))


def scale(c: Column, ratio: Column) -> Column:
    """A coordinate scaled and cut to a whole number."""
    return (c * ratio).cast("int")


def ramp(density: Column) -> Column:
    """Blue-to-red ramp for densities of 0 to 1, cut to whole numbers."""
    d = F.greatest(F.least(density, F.lit(1.0)), F.lit(0.0))
    return F.struct((255 * (1 - d)).cast("int").alias("blue"), F.lit(0).alias("green"), (255 * d).cast("int").alias("red"))
