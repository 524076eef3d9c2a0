"""Volume records, annotations and indexes in JSON; sinks that write only where a path is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RELATIONSHIP = "struct<related_person: string, relationship_type: string>"
PERSON = f"struct<id: string, name: string, titles: array<string>, rank: string, origin: string, ethnicity: string, age: string, legitimate: boolean, occupation: string, phenotype: string, free: boolean, relationships: array<{RELATIONSHIP}>>"
EVENT = "struct<type: string, principals: array<string>, witnesses: array<string>, date: string>"
ENTRY = f"struct<id: string, raw: string, normalized: string, data: struct<people: array<{PERSON}>, events: array<{EVENT}>>>"
VOLUME = f"type string, country string, state string, city string, institution string, id bigint, title string, entries array<{ENTRY}>"


def read_volumes(source: str | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Volume records of a path, or those already at hand."""
    if isinstance(source, DataFrame):
        return source
    return spark.read.schema(VOLUME).option("multiLine", True).json(source)


def entries_of(volumes: DataFrame) -> DataFrame:
    """One row per entry, with its place."""
    return volumes.select(F.col("id").alias("volume_id"), F.posexplode("entries").alias("pos", "e")).select("volume_id", "pos", F.col("e.id").alias("entry_id"), "e.raw", "e.normalized", "e.data")


def volume_records(entries: DataFrame, volumes: DataFrame) -> DataFrame:
    """Volume records from flat entries (volume_id, pos, entry_id, raw) and the volumes' metadata. One record holds one
    volume's entries, as the format has it."""
    listed = entries.groupBy("volume_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("entry_id").alias("id"), "raw"))).alias("_e"))
    listed = listed.select("volume_id", F.transform("_e", lambda s: F.struct(s["id"].alias("id"), s["raw"].alias("raw"))).alias("entries"))
    return volumes.join(listed, "volume_id", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<id: string, raw: string>>")))


def write_json(df: DataFrame, path: str | None = None) -> DataFrame:
    """The table itself; written as JSON lines only if a path is given."""
    if path:
        df.write.mode("overwrite").json(path)
    return df


def manual_boxes(annotations: DataFrame) -> DataFrame:
    """(image_id, coords): the text boxes of each image that are not in the margin; images without any stay, empty."""
    keep = F.filter("image.annotations", lambda a: (a["name"] == "text") & ~F.coalesce(a["attributes"]["margin"], F.lit(False)))
    return annotations.select(F.explode("images").alias("image")).select(F.regexp_replace("image.filename", r"\.[^.]*$", "").alias("image_id"), F.coalesce(F.transform(keep, lambda a: a["polygon"]), F.array().cast("array<array<bigint>>")).alias("coords"))


def trainable_boxes(annotations: DataFrame) -> DataFrame:
    """Text boxes that are whole and not in the margin, numbered per image from the top."""
    each = annotations.select(F.explode("images").alias("image")).select(F.regexp_replace("image.filename", r"\.[^.]*$", "").alias("image_id"), F.col("image.annotations").alias("all"))
    keep = F.filter("all", lambda a: (a["name"] == "text") & ~F.coalesce(a["attributes"]["partial"], F.lit(False)) & ~F.coalesce(a["attributes"]["margin"], F.lit(False)))
    ordered = F.array_sort(F.transform(keep, lambda a, i: F.struct(F.get(a["polygon"], F.lit(1)).alias("top"), i.alias("i"), a["polygon"].alias("coords"))))
    return each.select("image_id", F.posexplode(ordered).alias("n", "b")).select("image_id", (F.col("n") + 1).alias("number"), "b.coords")


def computed_boxes(results: DataFrame, texts: str = "original texts") -> DataFrame:
    """(image_id, coords) of segmentation results; empty items go."""
    return results.filter(F.col("image_id").isNotNull()).select("image_id", F.transform(F.col(f"`{texts}`"), lambda t: t["coords"]).alias("coords"))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """All image files under a folder, with their ids; one table for all folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).withColumn("image_id", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))


def appended(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with new rows, by column names; columns that one side lacks are null."""
    return index.unionByName(rows, allowMissingColumns=True)
