"""Labels of page components: margin, text, facing page or other, from the density of their centres.

The page's side decides which steps of the density are cuts: `unbound` has one in the left half (margin, text), `recto`
two in the left third (facing page, margin, text), `verso` one in the left third and two in the right (margin, text,
facing page). A page whose steps are missing is all text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from libroflow.operators.layout import x_density
from libroflow.session import cut


def cuts(boxes: DataFrame, image: str, side: str, width: int, bins: int = 50) -> DataFrame:
    """(image, left_cuts, right_cuts): the bins whose step to the next is largest, as x positions in order."""
    steps = x_density(boxes, image, width, bins).withColumn("step", F.lead("density").over(Window.partitionBy(image).orderBy("bin")) - F.col("density")).filter(F.col("step").isNotNull())
    pages = boxes.select(image, side).distinct()
    third, two_thirds, half = int(bins / 3), int(bins * 2 / 3), bins // 2
    zone = F.when(F.col("bin") < F.when(F.col(side) == "unbound", half).otherwise(third), "left").when((F.col(side) == "verso") & (F.col("bin") >= two_thirds), "right")
    wanted = F.when((F.col(side) == "recto") | (F.col("zone") == "right"), 2).otherwise(1)
    # a single cut must be a real step; pairs are the two largest differences whatever they are
    placed = steps.join(pages, image).withColumn("zone", zone).filter(F.col("zone").isNotNull() & ((wanted == 2) | (F.abs("step") > 0)))
    rank = F.row_number().over(Window.partitionBy(image, "zone").orderBy(F.abs("step").desc(), "bin"))
    best = placed.withColumn("wanted", wanted).withColumn("rank", rank).filter(F.col("rank") <= F.col("wanted"))
    at = (F.col("bin") + 1) * F.lit(width / bins)
    return best.groupBy(image).agg(F.array_sort(F.collect_list(F.when(F.col("zone") == "left", at))).alias("left_cuts"), F.array_sort(F.collect_list(F.when(F.col("zone") == "right", at))).alias("right_cuts"))


def labelled(boxes: DataFrame, image: str, side: str, width: int, bins: int = 50) -> DataFrame:
    """The boxes with `label`."""
    c = boxes.join(cuts(boxes, image, side, width, bins), image, "left")
    centre = (F.col("left") + F.col("right")) / 2.0
    one, two, three = F.get("left_cuts", F.lit(0)), F.get("left_cuts", F.lit(1)), F.get("right_cuts", F.lit(0))
    both_right = F.get("right_cuts", F.lit(1)).isNotNull()
    unbound = F.when(one.isNotNull() & (centre < one), "margin").otherwise("text_region")
    recto = F.when(two.isNull(), "text_region").when(centre < one, "facing_folio").when(centre < two, "margin").otherwise("text_region")
    verso = F.when(one.isNull() | ~F.coalesce(both_right, F.lit(False)), "text_region").when(centre < one, "margin").when(centre > three, "facing_folio").otherwise("text_region")
    label = F.when(F.col(side) == "unbound", unbound).when(F.col(side) == "recto", recto).when(F.col(side) == "verso", verso).otherwise("text_region")
    return c.withColumn("label", label).drop("left_cuts", "right_cuts")


def pulled_in(boxes: DataFrame, image: str) -> DataFrame:
    """Text boxes that end left of the margin's right edge are margin."""
    edge = F.max(F.when(F.col("label") == "margin", F.col("right"))).over(Window.partitionBy(image))
    return boxes.withColumn("label", F.when((F.col("label") == "text_region") & (F.col("right") <= edge), "margin").otherwise(F.col("label")))


def sparse_to_other(boxes: DataFrame, image: str, tiles: int = 10, least: int = 2) -> DataFrame:
    """Text boxes that reach into a tile of the text region with fewer than `least` text boxes are other."""
    text = boxes.filter(F.col("label") == "text_region")
    w = Window.partitionBy(image)
    x0, y0 = F.min("left").over(w), F.min("top").over(w)
    tw, th = (F.max("right").over(w) - x0) / float(tiles), (F.max("bottom").over(w) - y0) / float(tiles)
    placed = text.withColumn("x0", x0).withColumn("y0", y0).withColumn("tw", tw).withColumn("th", th).filter("tw > 0 and th > 0")
    # a tile counts where the shared area is positive, so a box that only touches it does not
    span = lambda lo, hi, o, t: F.sequence(F.greatest(F.floor((F.col(lo) - F.col(o)) / F.col(t)), F.lit(0)), F.least(F.floor((F.col(hi) - F.col(o)) / F.col(t)), F.lit(tiles - 1)))
    shares = lambda k, lo, hi, o, t: F.least(F.col(hi) - F.col(o), (F.col(k) + 1) * F.col(t)) > F.greatest(F.col(lo) - F.col(o), F.col(k) * F.col(t))
    across = placed.withColumn("tx", F.explode(span("left", "right", "x0", "tw"))).filter(shares("tx", "left", "right", "x0", "tw"))
    cells = across.withColumn("ty", F.explode(span("top", "bottom", "y0", "th"))).filter(shares("ty", "top", "bottom", "y0", "th")).select(image, "box_id", "tx", "ty")
    count = cells.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(image, "tx", "ty")))
    low = count.filter(F.col("n") < least).select(F.col(image).alias("_i"), F.col("box_id").alias("_b")).distinct()
    return boxes.join(low, (F.col(image) == F.col("_i")) & (F.col("box_id") == F.col("_b")), "left").withColumn("label", F.when(F.col("_b").isNotNull(), "other").otherwise(F.col("label"))).drop("_i", "_b")


def odd_shapes(boxes: DataFrame, ratio: float = 5.0) -> DataFrame:
    """Very tall or wide boxes are other, facing pages excepted."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    odd = ((w > 0) & (h > ratio * w)) | ((h > 0) & (w > ratio * h))
    return boxes.withColumn("label", F.when(~F.col("label").isin("facing_folio", "other") & odd, "other").otherwise(F.col("label")))


def classified(boxes: DataFrame, image: str, side: str, width: int, max_area: int, bins: int = 50) -> DataFrame:
    """All label rules in order."""
    from libroflow.operators.layout import contained

    shaped = cut(odd_shapes(labelled(boxes, image, side, width, bins)))  # the rules below read it several times
    large = contained(shaped, image, max_area)
    sized = large.withColumn("label", F.when(F.col("other"), "other").otherwise(F.col("label"))).drop("other")
    return sparse_to_other(cut(pulled_in(sized, image)), image)
