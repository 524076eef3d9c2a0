"""Layout analysis on box, pixel and signal tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from libroflow.operators.evaluate import overlapping


def tall_or_wide(w: Column, h: Column, ratio: float = 5.0) -> Column:
    """Shapes that are no text blocks."""
    return (h > ratio * w) | (w > ratio * h)


def contained(boxes: DataFrame, image: str, max_area: int) -> DataFrame:
    """The boxes with `other`: too large, or wholly inside a box that is too large."""
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    large = boxes.filter(area > max_area)
    met = overlapping(large, boxes, image)
    inside = (F.col("b.left") >= F.col("a.left")) & (F.col("b.right") <= F.col("a.right")) & (F.col("b.top") >= F.col("a.top")) & (F.col("b.bottom") <= F.col("a.bottom"))
    held = met.select(F.col(image).alias("_i"), F.col("b.box_id").alias("_b"), inside.alias("_in")).groupBy("_i", "_b").agg(F.max("_in").alias("_in")).filter("_in").drop("_in")
    return boxes.join(held, (F.col(image) == F.col("_i")) & (F.col("box_id") == F.col("_b")), "left").withColumn("other", F.col("_b").isNotNull() | (area > max_area)).drop("_i", "_b")


def binarized(pixels: DataFrame, image: str, value: str, quantile: float = 0.1) -> DataFrame:
    """Pixels with `black`: below the exact quantile of their image."""
    bar = pixels.groupBy(image).agg(F.percentile(value, quantile).alias("_q"))
    return pixels.join(bar, image).withColumn("black", F.col(value) < F.col("_q")).drop("_q")


def colours(pixels: DataFrame, image: str, value: str, bar: float = 60.0) -> DataFrame:
    """(image, colour): two values are `bin`, little deviation (population) is `gray`, else `semi-bin`."""
    kind = F.when(F.count_distinct(value) <= 2, "bin").when(F.stddev_pop(value) < bar, "gray").otherwise("semi-bin")
    return pixels.groupBy(image).agg(kind.alias("colour"))


def folder_colours(files: DataFrame, folder: str, name: str, colour: str) -> DataFrame:
    """The colour of a folder of line images: that of its first file, or of its first two if they agree, else gray."""
    # the two smallest names by one aggregation; no folder is sorted
    firsts = files.groupBy(folder).agg(F.min(F.struct(name, colour)).alias("a"), F.count(F.lit(1)).alias("n"))
    others = files.join(firsts, folder).filter(F.col(name) != F.col(f"a.{name}")).groupBy(folder).agg(F.min(F.struct(name, colour)).alias("b"))
    vote = F.when(F.col("b").isNull() | (F.col(f"a.{colour}") == F.col(f"b.{colour}")), F.col(f"a.{colour}")).otherwise("gray")
    return firsts.join(others, folder, "left").select(folder, vote.alias(colour))


def tile_histogram(pixels: DataFrame, image: str, k: int) -> DataFrame:
    """White tiles per column of tiles: black first by columns, then by rows, where more than k/10 are black."""
    first = pixels.groupBy(image, F.floor(F.col("y") / k).alias("ty"), "x").agg((F.sum(F.col("black").cast("int")) > k / 10).alias("black"))
    second = first.groupBy(image, "ty", F.floor(F.col("x") / k).alias("tx")).agg((F.sum(F.col("black").cast("int")) > k / 10).alias("black"))
    return second.groupBy(image, "tx").agg(F.sum((~F.col("black")).cast("int")).alias("white"))


def spaces(series: DataFrame, image: str, at: str, value: str, multiplier: float = 1.2) -> DataFrame:
    """Stretches between runs above mean + multiplier x standard deviation (population); equality keeps the state, and
    a run that is open at the end gives nothing: (image, start, end)."""
    stats = series.groupBy(image).agg((F.avg(value) + multiplier * F.stddev_pop(value)).alias("_t"))
    w = Window.partitionBy(image).orderBy(at)
    state = series.join(stats, image).withColumn("_up", F.when(F.col(value) > F.col("_t"), 1).when(F.col(value) < F.col("_t"), 0))
    state = state.withColumn("_high", F.coalesce(F.last("_up", True).over(w), F.lit(0)))
    state = state.withColumn("_was", F.coalesce(F.lag("_high").over(w), F.lit(0)))
    falls = F.max(F.when((F.col("_was") == 1) & (F.col("_high") == 0), F.col(at))).over(w)
    return state.withColumn("_left", F.coalesce(falls, F.lit(0))).filter((F.col("_was") == 0) & (F.col("_high") == 1) & (F.col("_left") != F.col(at))).select(image, F.col("_left").alias("start"), F.col(at).alias("end"))


def runs(df: DataFrame, group: str, at: str, flag: Column, least: int) -> DataFrame:
    """Runs of at least `least` consecutive places where the flag holds: (group, start, end, length)."""
    kept = df.filter(flag).withColumn("_island", F.col(at) - F.row_number().over(Window.partitionBy(group).orderBy(at)))
    return kept.groupBy(group, "_island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least).drop("_island")


def x_density(boxes: DataFrame, image: str, width: int, bins: int) -> DataFrame:
    """Centres per bin, empty bins included, relative to the fullest bin of the image."""
    size = width / bins
    bin_ = F.least(F.greatest(F.floor((F.col("left") + F.col("right")) / 2.0 / size), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = boxes.groupBy(image, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = boxes.select(image).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    dense = grid.join(counts, [image, "bin"], "left").fillna(0, ["n"])
    top = F.max("n").over(Window.partitionBy(image))
    return dense.withColumn("density", F.when(top > 0, F.col("n") / top).otherwise(0.0))


def row_density(boxes: DataFrame, image: str) -> DataFrame:
    """Boxes over each row, by sweeping the edges: (image, top, bottom, n), rows without boxes left out."""
    edges = boxes.select(image, F.explode(F.array(F.struct(F.col("top").alias("y"), F.lit(1).alias("d")), F.struct(F.col("bottom").alias("y"), F.lit(-1).alias("d")))).alias("e"))
    steps = edges.groupBy(image, F.col("e.y").alias("y")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(image).orderBy("y")
    return steps.withColumn("n", F.sum("d").over(w)).withColumn("bottom", F.lead("y").over(w)).filter("n > 0").select(image, F.col("y").alias("top"), "bottom", "n")


def smoothed(series: DataFrame, group: str, at: str, value: str, k: int, out: str) -> DataFrame:
    """Moving average of 2k + 1 places, zeros beyond the ends."""
    w = Window.partitionBy(group).orderBy(at).rowsBetween(-k, k)
    return series.withColumn(out, F.sum(value).over(w) / (2 * k + 1))


def biggest_steps(series: DataFrame, group: str, at: str, value: str, most: int) -> DataFrame:
    """The largest differences to the next place, the first place among equals."""
    step = series.withColumn("step", F.lead(value).over(Window.partitionBy(group).orderBy(at)) - F.col(value)).filter(F.col("step").isNotNull())
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.abs("step").desc(), at))
    return step.withColumn("rank", rank).filter(F.col("rank") <= most)


def local_peaks(series: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """Places strictly above both neighbours."""
    w = Window.partitionBy(group).orderBy(at)
    return series.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b"))).drop("_a", "_b")


def prominent_peaks(series: DataFrame, group: str, at: str, value: str, distance: int, prominence: float, least: int, most: int, tries: int = 20) -> DataFrame:
    """Local peaks by distance and prominence, the prominence eased or tightened (at most `tries` times) until their
    number is within bounds. One signal is one image's rows."""

    def peaks(v: list[float], bar: float) -> list[int]:
        found = []
        for i in range(1, len(v) - 1):
            if v[i] > v[i - 1] and v[i] > v[i + 1]:
                low_l = low_r = v[i]
                for j in range(i - 1, -1, -1):
                    if v[j] > v[i]:
                        break
                    low_l = min(low_l, v[j])
                for j in range(i + 1, len(v)):
                    if v[j] > v[i]:
                        break
                    low_r = min(low_r, v[j])
                if v[i] - max(low_l, low_r) >= bar:
                    found.append(i)
        kept: list[int] = []
        for i in sorted(found, key=lambda i: (-v[i], i)):
            if all(abs(i - k) >= distance for k in kept):
                kept.append(i)
        return sorted(kept)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        bar, v = prominence, pdf[value].tolist()
        hits = peaks(v, bar)
        for _ in range(tries):
            if least <= len(hits) <= most:
                break
            bar = bar * 0.9 if len(hits) < least else bar * 1.1
            hits = peaks(v, bar)
        return pdf.iloc[hits][[group, at, value]]

    schema = ", ".join(f"{c} {t}" for c, t in series.select(group, at, value).dtypes)
    return series.select(group, at, value).groupBy(group).applyInPandas(run, schema)


def paragraph_breaks(lines: DataFrame, image: str, at: str, multiplier: float) -> DataFrame:
    """Places followed by a gap of at least `multiplier` times the image's mean gap."""
    gap = lines.withColumn("gap", F.lead(at).over(Window.partitionBy(image).orderBy(at)) - F.col(at))
    return gap.withColumn("_m", F.avg("gap").over(Window.partitionBy(image))).filter(F.col("gap") >= multiplier * F.col("_m")).drop("_m")


def column_breaks(lines: DataFrame, image: str, at: str, density: str, multiplier: float, low: float) -> DataFrame:
    """Paragraph breaks by gap or by density: a line followed by a gap of at least `multiplier` times the mean gap, or by a
    line whose density is below `low` times the mean. Of breaks on neighbouring lines, pair by pair from the top, the
    lower one stays. (image, at)"""
    w, every = Window.partitionBy(image).orderBy(at), Window.partitionBy(image)
    step = lines.withColumn("_n", F.row_number().over(w)).withColumn("_gap", F.lead(at).over(w) - F.col(at)).withColumn("_next", F.lead(density).over(w))
    step = step.withColumn("_mg", F.avg("_gap").over(every)).withColumn("_md", F.avg(density).over(every))
    found = step.filter((F.col("_gap") >= multiplier * F.col("_mg")) | (F.col("_next") < low * F.col("_md")))
    run = found.withColumn("_run", F.col("_n") - F.row_number().over(w))
    place = Window.partitionBy(image, "_run").orderBy(at)
    run = run.withColumn("_i", F.row_number().over(place)).withColumn("_last", F.lead(at).over(place).isNull())
    return run.filter((F.col("_i") % 2 == 0) | F.col("_last")).select(image, at)


def line_strips(cuts: DataFrame, image: str, at: str, end: str, least: int = 10) -> DataFrame:
    """Strips of lines between the cuts, from the top of the image: (image, top, bottom). Strips lower than `least` go; the
    rest below the last cut stays if it is that high, unless the strip above it went."""
    w = Window.partitionBy(image).orderBy("_c")
    once = cuts.groupBy(image, F.col(at).cast("bigint").alias("_c")).agg(F.max(F.col(end).cast("bigint")).alias("_e"))
    strip = once.withColumn("_t", F.coalesce(F.lag("_c").over(w), F.lit(0).cast("bigint"))).withColumn("_last", F.lead("_c").over(w).isNull()).withColumn("_e", F.max("_e").over(Window.partitionBy(image)))
    high = strip.filter(F.col("_c") - F.col("_t") >= least)
    own = F.struct(F.col("_t").alias("top"), F.col("_c").alias("bottom"))
    rest = F.when(F.col("_last") & (F.col("_e") - F.col("_c") >= least), F.struct(F.col("_c").alias("top"), F.col("_e").alias("bottom")))
    return high.select(image, F.explode(F.array_compact(F.array(own, rest))).alias("p")).select(image, "p.top", "p.bottom")


def row_sums(pixels: DataFrame, image: str, y: str, value: str) -> DataFrame:
    """(image, y, total): the ink of each row."""
    return pixels.groupBy(image, y).agg(F.sum(value).alias("total"))


def cut_boxes(boxes: DataFrame, cuts: DataFrame, image: str, row: str) -> DataFrame:
    """Boxes cut at the rows that run through them, the rest below the last cut included."""
    at = cuts.groupBy(F.col(image).alias("_i")).agg(F.sort_array(F.collect_set(row)).alias("rows"))
    inner = F.filter(F.coalesce("rows", F.array().cast("array<bigint>")), lambda r: (r > F.col("top")) & (r < F.col("bottom")))
    edges = F.concat(F.array(F.col("top").cast("bigint")), inner, F.array(F.col("bottom").cast("bigint")))
    parts = F.transform(F.sequence(F.lit(0), F.size(edges) - 2), lambda i: F.struct(F.get(edges, i).alias("top"), F.get(edges, i + 1).alias("bottom")))
    cut = boxes.join(at, F.col(image) == F.col("_i"), "left").withColumn("_p", parts)
    return cut.select(image, "box_id", "left", "right", F.posexplode("_p").alias("part", "edge")).select(image, "box_id", "part", "left", F.col("edge.top").alias("top"), "right", F.col("edge.bottom").alias("bottom"))


def hulls(boxes: list[list[int]], near: int) -> list[list[int]]:
    """Boxes (left, top, right, bottom) no further apart than `near` merged until nothing more merges, in order."""
    again = True
    while again:
        again, out = False, []
        for b in boxes:
            for o in out:
                if b[0] <= o[2] + near and o[0] <= b[2] + near and b[1] <= o[3] + near and o[1] <= b[3] + near:
                    o[:] = [min(o[0], b[0]), min(o[1], b[1]), max(o[2], b[2]), max(o[3], b[3])]
                    again = True
                    break
            else:
                out.append(list(b))
        boxes = out
    return sorted(boxes)


def _per_page(boxes: DataFrame, image: str, merge: Callable[[list[list[int]]], tuple[int, list[list[int]]]]) -> DataFrame:
    """(image, threshold, left, top, right, bottom): what `merge` makes of the boxes of each image, a page's components."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for i, held in zip(pdf[image], pdf["boxes"]):
                near, out = merge([[int(b[c]) for c in ("left", "top", "right", "bottom")] for b in held])
                rows += [(i, near, *h) for h in out]
            yield pd.DataFrame(rows, columns=[image, "threshold", "left", "top", "right", "bottom"])

    held = boxes.groupBy(image).agg(F.collect_list(F.struct("left", "top", "right", "bottom")).alias("boxes"))
    return held.mapInPandas(run, f"{image} {dict(boxes.dtypes)[image]}, threshold int, left bigint, top bigint, right bigint, bottom bigint")


def merged_boxes(boxes: DataFrame, image: str, threshold: int) -> DataFrame:
    """Boxes closer than the threshold merged into their hulls until nothing more merges."""
    return _per_page(boxes, image, lambda b: (threshold, hulls(b, threshold))).drop("threshold")


def adaptively_merged(boxes: DataFrame, image: str, wanted: tuple[int, int] = (2, 4), threshold: int = 20, bounds: tuple[int, int] = (0, 100), step: int = 5, tries: int = 10) -> DataFrame:
    """Boxes merged with a threshold that is raised or lowered by `step` per image, at most `tries` times and within its
    bounds, until their number is as wanted."""

    def merge(held: list[list[int]]) -> tuple[int, list[list[int]]]:
        near = threshold
        out = hulls(held, near)
        for _ in range(tries):
            to = near + step if len(out) > wanted[1] else near - step if len(out) < wanted[0] else near
            to = max(bounds[0], min(bounds[1], to))
            if to == near:
                break
            near, out = to, hulls(held, to)
        return near, out

    return _per_page(boxes, image, merge)


def best_of(df: DataFrame, group: str, candidate: str, score: str) -> DataFrame:
    """The candidate with the highest score, the first among equals."""
    return df.groupBy(group).agg(F.min_by(F.struct(candidate, score), F.struct((-F.col(score)).alias("s"), F.col(candidate).alias("c"))).alias("b")).select(group, f"b.{candidate}", f"b.{score}")
