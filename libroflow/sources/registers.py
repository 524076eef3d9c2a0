"""Readers of transcribed registers: line dialects and markup, as window state machines over the lines of each file.

All take a table of lines (source, line_no, line); `lines_of` makes one from text files. One file is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from libroflow.functions import text

HEADER = ["type", "country", "state", "city", "institution", "id", "title"]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, line) of all text files under a path; each file is split whole, so its lines keep their order."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("source"), "value")
    return files.select("source", F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).select("source", (F.col("i") + 1).alias("line_no"), "line")


def volume_header(lines: DataFrame) -> DataFrame:
    """One row per source with the attributes of its volume line; the id is a number."""
    head = lines.filter(F.col("line").contains("<volume"))
    return head.select("source", *[(F.regexp_extract("line", rf'\b{k}="([^"]*)"', 1)).alias("record_type" if k == "type" else "volume_id" if k == "id" else k) for k in HEADER]).withColumn("volume_id", F.col("volume_id").try_cast("bigint"))


def _window() -> tuple:
    w = Window.partitionBy("source").orderBy("line_no")
    return w, w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)


def _toggle(on: Column, off: Column, frame) -> Column:
    """State switched by the lines so far."""
    return F.coalesce(F.last(F.when(on, True).when(off, False), True).over(frame), F.lit(False))


def _joined(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each group: lines in order, closed up over hyphens."""
    ordered = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return ordered.withColumn("raw", text.join_lines(F.transform("_l", lambda s: s["line"]))).drop("_l")


def parse_markup(lines: DataFrame) -> DataFrame:
    """Entries (source, entry_id, raw) of register markup: volume, image, entry and partial elements, one per line.

    Entries are numbered per image; a partial entry that goes on over the next image counts on the first. Marginal
    notes and very short lines are left out; an entry without text takes no number.
    """
    w, upto, before = _window()
    line = text.clean_line(F.col("line"))
    t = lines.filter(~F.col("line").contains("<volume")).withColumn("line", line)
    has = F.col("line").contains
    opens, image, closes = has("<entry"), has("<image"), has("</entry")
    t = t.withColumn("kind", F.when(opens, "open").when(image, "image").when(closes, "close").when(has("<partial id"), "partial").when(has("</partial"), "end").when(has("<partial"), "resume").otherwise("text"))
    t = t.withColumn("images", F.sum((F.col("kind") == "image").cast("int")).over(upto))
    raw_id = F.when(F.col("kind") == "image", F.regexp_extract("line", r'id="?(\d+)', 1).try_cast("int"))
    t = t.withColumn("image", F.last(text.image_number(raw_id, F.col("images")), True).over(upto))
    t = t.withColumn("previous", F.last(F.when(F.col("kind") == "image", F.col("image")), True).over(before))
    t = t.withColumn("ends", F.sum((F.col("kind") == "end").cast("int")).over(upto))
    second = (F.col("kind") == "end") & (F.col("ends") % 2 == 0)
    t = t.withColumn("in_entry", _toggle(F.col("kind") == "open", F.col("kind") == "close", upto))
    t = t.withColumn("in_partial", _toggle(F.col("kind") == "partial", second, upto)).withColumn("between", _toggle((F.col("kind") == "end") & (F.col("ends") % 2 == 1), F.col("kind") == "resume", upto))
    t = t.withColumn("done", (F.col("kind") == "close") | second)
    t = t.withColumn("part", F.coalesce(F.sum(F.col("done").cast("int")).over(before), F.lit(0)))
    kept = t.filter((F.col("kind") == "text") & (F.col("in_entry") | (F.col("in_partial") & ~F.col("between"))) & ~text.marginal(F.col("line")))
    texts = _joined(kept, ["source", "part"])
    ends = t.filter("done").select("source", "part", "images", F.col("image"), (F.col("kind") == "end").alias("across"))
    entries = ends.join(texts, ["source", "part"]).filter(F.length("raw") > 0)
    plain = entries.withColumn("number", F.sum((~F.col("across")).cast("int")).over(Window.partitionBy("source", "images").orderBy("part")))
    # a partial entry is numbered after those that its first image had when the next image began
    per_image = plain.filter(~F.col("across")).groupBy(F.col("source").alias("_s"), (F.col("images") + 1).alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    full = plain.join(per_image, (F.col("source") == F.col("_s")) & (F.col("images") == F.col("_i")), "left")
    number = F.when(F.col("across"), F.coalesce("_n", F.lit(0)) + 1).otherwise(F.col("number"))
    on = F.when(F.col("across"), F.col("image") - 1).otherwise(F.col("image"))
    return full.select("source", F.col("part").alias("pos"), F.concat(text.pad(on, 4), F.lit("-"), text.pad(number, 2)).alias("entry_id"), "raw")


def parse_bound(lines: DataFrame) -> DataFrame:
    """Entries of the dialect with `IMG` lines (image and entry ids joined by underscores) and entries between
    `{left margin` and `{rubric` lines.

    Lines know the number of their `IMG` line only; it is met with its entries when they are whole, in place.
    """
    _, upto, before = _window()
    t = lines.filter(F.length("line") >= 1).withColumn("line", F.regexp_replace("line", r"ILL|[()\[\]*^]", ""))
    has = F.col("line").contains
    t = t.withColumn("kind", F.when(has("{left margin"), "open").when(has("{rubric"), "close").when(has("IMG"), "image").otherwise("text"))
    t = t.withColumn("in_entry", _toggle(F.col("kind") == "open", F.col("kind") == "close", upto)).withColumn("was_in", F.coalesce(F.lag("in_entry").over(Window.partitionBy("source").orderBy("line_no")), F.lit(False)))
    t = t.withColumn("img", F.sum((F.col("kind") == "image").cast("int")).over(upto))
    t = t.withColumn("done", (F.col("kind") == "close") & F.col("was_in")).withColumn("part", F.coalesce(F.sum(F.col("done").cast("int")).over(before), F.lit(0)))
    # one group for each `IMG` line (no part) and each entry, all of the partitions that the files are in
    image, kept = F.col("kind") == "image", (F.col("kind") == "text") & F.col("in_entry")
    t = t.withColumn("at", F.when(image, F.col("img"))).withColumn("part", F.when(~image, F.col("part")))
    each = t.groupBy("source", "at", "part").agg(
        F.max(F.when(image, F.col("line"))).alias("head"), F.min_by("img", F.when(F.col("kind") == "open", F.col("line_no"))).alias("begun"),
        F.max("done").alias("done"), F.array_sort(F.collect_list(F.when(kept, F.struct("line_no", "line")))).alias("_l"),
    )
    each = each.filter(F.col("part").isNull() | (F.col("done") & F.col("begun").isNotNull() & (F.size("_l") > 0))).withColumn("begun", F.coalesce("at", "begun"))
    # the entry's place among those begun on its image, whose line comes first
    w = Window.partitionBy("source", "begun").orderBy(F.col("part").asc_nulls_first())
    each = each.withColumn("place", F.count("part").over(w)).withColumn("head", F.first("head", True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ids = F.split(F.regexp_replace("head", r"\s", ""), "_")
    entry_id = F.concat(F.get(ids, F.lit(3)), F.coalesce(F.get(ids, (F.col("place") + 3).cast("int")), F.lit("")))
    return each.filter("part is not null").select("source", F.col("part").alias("pos"), entry_id.alias("entry_id"), text.join_lines(F.transform("_l", lambda s: s["line"])).alias("raw"))


def parse_signed(lines: DataFrame) -> DataFrame:
    """Entries of the dialect with `[left margin` ... `[signed]`, where `[f.` lines begin the next image."""
    _, upto, before = _window()
    t = lines.filter((F.length("line") >= 1) & ~F.col("line").contains("upper margin")).withColumn("line", F.regexp_replace("line", r"[()?¿]|\[ilegible\]|\[roto\]", ""))
    has = F.col("line").contains
    t = t.withColumn("kind", F.when(has("[left margin"), "open").when(has("[signed]"), "close").when(has("[f."), "image").otherwise("text"))
    t = t.withColumn("in_entry", _toggle(F.col("kind") == "open", F.col("kind") == "close", upto)).withColumn("was_in", F.coalesce(F.lag("in_entry").over(Window.partitionBy("source").orderBy("line_no")), F.lit(False)))
    t = t.withColumn("image", 1 + F.sum((F.col("kind") == "image").cast("int")).over(upto)).withColumn("done", (F.col("kind") == "close") & F.col("was_in"))
    t = t.withColumn("part", F.coalesce(F.sum(F.col("done").cast("int")).over(before), F.lit(0)))
    after_margin = F.when(F.length("line") >= 100, F.regexp_extract("line", r"margin.(.*)$", 1))
    before_sign = F.when(F.length("line") >= 50, F.substring_index("line", "[signed]", 1))
    t = t.withColumn("line", F.when(F.col("kind") == "open", after_margin).when(F.col("done"), before_sign).when(F.col("kind") == "text", F.col("line")))
    kept = t.filter(F.col("line").isNotNull() & (F.col("in_entry") | F.col("done")))
    texts = _joined(kept, ["source", "part"]).withColumn("raw", F.regexp_replace(text.squeeze_spaces(F.translate("raw", "[]", "")), r"^[ :]+|[ –]+$", ""))
    ends = t.filter("done").select("source", "part", "image").join(texts, ["source", "part"]).filter(F.length("raw") > 0)
    number = F.row_number().over(Window.partitionBy("source", "image").orderBy("part"))
    return ends.select("source", F.col("part").alias("pos"), F.concat(text.pad(F.col("image"), 4), F.lit("-"), text.pad(number, 2)).alias("entry_id"), "raw")


def long_lines(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Entries of well-formed markup with their lines of at least `least` characters; ids 1xxx are read as 0xxx."""
    rows = spark.read.format("xml").option("rowTag", "entry").load(path)
    body = "_VALUE" if "_VALUE" in rows.columns else rows.columns[-1]
    lines = F.filter(F.transform(F.split(F.col(body), "\n"), F.trim), lambda x: F.length(x) >= least)
    return rows.select(F.regexp_replace(F.col("_id").cast("string"), r"^1(?=\d{3})", "0").alias("entry_id"), lines.alias("lines"))


def line_log(lines: DataFrame) -> DataFrame:
    """(source, line_no, id, coords): what stands after a log line's last quote, its fifth field and the numbers of its
    sixth; the header line goes."""
    tail = F.split(F.substring_index("line", '"', -1), ",")
    return lines.filter((F.col("line_no") > 1) & (F.length("line") > 0)).select("source", "line_no", F.get(tail, F.lit(4)).alias("id"), F.filter(F.split(F.trim(F.get(tail, F.lit(5))), " +"), lambda x: x != "").alias("coords"))


def zipped(texts: DataFrame, log: DataFrame) -> DataFrame:
    """Line i of the text beside row i of the log; tabs and repeated spaces are one space."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("line_no"))
    left = texts.withColumn("i", n).select("source", "i", text.squeeze_spaces(F.regexp_replace("line", "\t", " ")).alias("text"))
    return log.withColumn("i", n).drop("line_no").join(left, ["source", "i"])
