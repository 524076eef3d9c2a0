"""Rescue-column ingestion of JSON whose layout drifts between files.

The agreed layout is enforced on every object: members that carry an agreed name and type become typed values;
anything else (unknown name, other type) is kept as JSON in a rescue column. Unknown names that are approved, or
that the evidence shows to be an agreed field under another name, are promoted and their rescued values replayed
into the typed column. Each file's departures are reported.

Defined edge cases: a null value departs from nothing; null, blank and unparsable bodies give no rows (an
unparsable one carries no field, so nothing can be compared); an empty catalogue makes every path `added`;
repeated files report once; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libroflow.operators.shred import NO, NUMBER, YES, members, shred
from libroflow.session import cut, small

# Names under which agreed fields are known to arrive, approved for promotion.
APPROVED = {
    "entries.raw": ["raw_text", "transcription", "text"],
    "entries.data.events.principals": ["principal", "principal_ids", "principle"],
    "entries.data.events.witnesses": ["witness", "testigos"],
    "entries.data.people.ethnicity": ["ethnicitiy", "ethnicty", "etnicity", "ethnic_origin", "nation"],
    "entries.data.people.phenotype": ["phenotpye", "phenotype_label", "fenotipo"],
    "entries.data.people.occupation": ["ocupation", "occupations", "profession"],
    "entries.data.people.origin": ["birthplace", "origen"],
    "entries.data.people.rank": ["military_rank"],
    "entries.data.people.free": ["freed", "is_free", "status"],
    "entries.data.people.legitimate": ["legitimacy", "is_legitimate", "legitimate_birth"],
}

MAX_CATALOGUE = 10_000
MAX_NAMES = 20_000


def approved_paths(approved: dict[str, list[str]] = APPROVED) -> dict[str, str]:
    """found path -> agreed path."""
    return {f"{p.rpartition('.')[0]}.{n}".lstrip("."): p for p, names in approved.items() for n in names}


def catalogue_of(catalogue: DataFrame) -> dict[str, str]:
    """path -> JSON type; the layout is a bounded description, its size is checked."""
    rows = small(catalogue.select("field_path", "json_type").filter(F.col("field_path").isNotNull()), MAX_CATALOGUE)
    if rows is None:
        raise ValueError(f"a layout of more than {MAX_CATALOGUE} fields is no catalogue")
    return {r[0]: r[1] for r in rows}


def squash(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def edits(a: str, b: str) -> int:
    """Edit distance with transpositions of neighbours."""
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        prev2, prev = prev, row
    return prev[-1]


def same_name(found: str, agreed: str) -> bool:
    """A misspelling, plural or other writing of one name: at most one edit per four letters, equal first letter."""
    a, b = squash(found), squash(agreed)
    return a == b or len(b) >= 4 and a[:1] == b[:1] and edits(a, b) <= max(1, len(b) // 4)


def detect(cells: DataFrame, kinds: dict[str, str], aliases: dict[str, str]) -> dict[str, str]:
    """Promotions shown by the evidence: an unknown name that is another writing of exactly one agreed name beside it.
    The names are compared where they are; only those that match reach the driver, their number is checked."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path in pdf["path"]:
                at, _, name = path.rpartition(".")
                near = [k for k in kinds if k.rpartition(".")[0] == at and same_name(name, k.rpartition(".")[2])]
                if len(near) == 1:
                    rows.append((path, near[0]))
            yield pd.DataFrame(rows, columns=["path", "agreed"])

    unknown = cells.select("path").filter(~F.col("path").isin([*kinds, *aliases])).distinct()
    found = small(unknown.mapInPandas(run, "path string, agreed string"), MAX_NAMES)
    if found is None:
        raise ValueError(f"more than {MAX_NAMES} names like agreed ones: this is another layout")
    return {r[0]: r[1] for r in found}


def departures(cells: DataFrame, key: str, kinds: dict[str, str], aliases: dict[str, str], spark: SparkSession) -> DataFrame:
    """(key, field_path, change, catalogue_path) from one row per file, path, agreed path and JSON type."""
    layout = spark.createDataFrame([(p, t) for p, t in kinds.items()] or [("", "none")], "layout_path string, json_type string")
    layout = layout.filter(F.col("json_type") != "none")
    seen = cells.join(F.broadcast(layout), F.col("canon") == F.col("layout_path"), "left")
    leaf = lambda c: F.substring_index(c, ".", -1)
    agreed, change = F.col("layout_path").isNotNull(), lambda name, at: F.struct(F.lit(name).alias("change"), at.alias("catalogue_path"))
    found = F.array(
        F.when(agreed & (leaf(F.col("path")) != leaf(F.col("canon"))), change("renamed", F.col("canon"))),
        F.when(agreed & (F.col("kind") != "null") & (F.col("kind") != F.col("json_type")), change("type_changed", F.col("canon"))),
        F.when(~agreed, change("added", F.lit(""))),
    )
    changed = seen.select(key, F.col("path").alias("field_path"), F.explode(F.array_compact(found)).alias("x")).select(key, "field_path", "x.change", "x.catalogue_path")
    have = cells.groupBy(key).agg(F.collect_set("canon").alias("have"))  # bounded by the distinct paths of one file
    removed = have.select(key, F.explode(F.array_except(F.array(*[F.lit(p) for p in kinds]), "have")).alias("field_path")) if kinds else have.select(key, F.lit("").alias("field_path")).limit(0)
    removed = removed.select(key, "field_path", F.lit("removed").alias("change"), F.col("field_path").alias("catalogue_path"))
    return changed.unionByName(removed).distinct()


def agreed_paths(cells: DataFrame, key: str, aliases: dict[str, str]) -> DataFrame:
    """Adds `canon`, the agreed path: every name on the way that stands for an agreed one is replaced by it."""

    def canonical(path: str) -> str:
        at = ""
        for name in path.split("."):
            at = f"{at}.{name}" if at else name
            at = aliases.get(at, at)
        return at

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for b in it:
            paths = b.column(1).to_pylist()
            if len(known) > 100_000:
                known.clear()
            for p in set(paths) - known.keys():
                known[p] = canonical(p)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([known[p] for p in paths], pa.string())], names=[key, "path", "kind", "canon"])

    return cells.mapInArrow(run, f"{key} bigint, path string, kind string, canon string")


def ingest(files: DataFrame, key: str, body: str, catalogue: DataFrame, approved: dict[str, list[str]] = APPROVED) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Shredded nodes with enforced names, the report of departures, and the promotions used.

    The report parses each body once, for its distinct members; the nodes are parsed when they are read.
    """
    kinds = catalogue_of(catalogue)
    aliases = {k: v for k, v in approved_paths(approved).items() if v in kinds and k not in kinds}
    cells = cut(members(files, key, body))
    aliases = aliases | dict(sorted(detect(cells, kinds, aliases).items()))
    report = departures(agreed_paths(cells, key, aliases), key, kinds, aliases, files.sparkSession)
    return shred(files, key, body, kinds, aliases), report, aliases


def replay(scalar, json_type: str):
    """A rescued scalar read as the agreed type; null where it can't be (it then stays in the rescue column)."""
    if json_type == "boolean":
        low = F.lower(F.trim(scalar))
        return F.when(low.isin(YES), F.lit("true")).when(low.isin(NO), F.lit("false"))
    if json_type == "number":
        return F.regexp_extract(scalar, NUMBER, 1)
    return scalar


def conform(nodes: DataFrame, key: str, record_path: str, kinds: dict[str, str]) -> DataFrame:
    """One consistent table of the objects at `record_path`: a typed column per agreed scalar member, an array column
    per agreed list of scalars, and `_rescued`, the JSON object of all that is not in a typed column, with the
    members of the record's agreed inner objects. Lists of objects are tables of their own, read at their own path.
    Of a field under several names, one value is in the column and the others are in `_rescued`.
    """
    prefix = f"{record_path}." if record_path else ""
    own = {p[len(prefix):]: t for p, t in kinds.items() if p.startswith(prefix) and "." not in p[len(prefix):]}
    nested = {p.rpartition(".")[0] for p in kinds}
    spark_type = {"string": "string", "number": "double", "boolean": "boolean"}
    objects = nodes.filter((F.col("canon") == record_path) & (F.col("kind") == "object")).select(F.col(key).alias("_k"), F.col("node").alias("_n"), "pos_path")
    members = nodes.filter(F.col("parent").isNotNull()).select(key, "node", "parent", "label", "path", "canon", "kind", "scalar", "raw")
    rescued = F.collect_set(F.when(F.col("raw").isNotNull(), F.struct(F.col("path").alias("k"), F.col("raw").alias("v"))))
    none = F.array().cast("array<struct<k: string, v: string>>")
    aggs = [rescued.alias("_all")]
    for f, t in own.items():
        full = prefix + f
        if t in spark_type:  # one value at most has the agreed path
            direct = F.when((F.col("canon") == full) & (F.col("kind") == t), F.col("scalar"))
            again = F.when((F.col("canon") == full) & F.col("kind").isin("string", "number", "boolean"), replay(F.col("scalar"), t))
            text = F.coalesce(F.max(direct), F.max(F.when(again != "", again)))
            aggs.append(text.cast(spark_type[t]).alias(f))
        elif full not in nested and t == "array":
            lone = F.when((F.col("canon") == full) & F.col("kind").isin("string", "number", "boolean"), F.col("scalar"))
            aggs.append(F.array_sort(F.collect_set(lone)).alias(f"_lone_{f}"))
    cells = members.filter(F.col("label").isNotNull()).groupBy(F.col(key), F.col("parent")).agg(*aggs)
    out = objects.join(cells, (F.col("_k") == F.col(key)) & (F.col("_n") == F.col("parent")), "left").drop(key, "parent")
    for f, t in own.items():
        full = prefix + f
        if t == "object":
            inside = members.filter((F.col("canon") == full) & (F.col("kind") == "object")).select(F.col(key).alias("_ka"), F.col("node").alias("_a"), F.col("parent").alias("_pa"))
            more = members.filter("label is not null and raw is not null").join(inside, (F.col(key) == F.col("_ka")) & (F.col("parent") == F.col("_a"))).groupBy("_ka", "_pa").agg(rescued.alias("_more"))
            out = out.join(more, (F.col("_k") == F.col("_ka")) & (F.col("_n") == F.col("_pa")), "left").withColumn("_all", F.concat(F.coalesce("_all", none), F.coalesce("_more", none))).drop("_ka", "_pa", "_more")
        elif t == "array" and full not in nested:
            arrays = members.filter((F.col("canon") == full) & (F.col("kind") == "array")).select(F.col(key).alias("_ka"), F.col("node").alias("_a"), F.col("parent").alias("_pa"))
            items = nodes.filter((F.col("canon") == full) & F.col("label").isNull() & F.col("scalar").isNotNull()).select(F.col(key).alias("_ki"), F.col("parent").alias("_pi"), F.struct("ordinal", "scalar").alias("_item"))
            lists = arrays.join(items, (F.col("_ka") == F.col("_ki")) & (F.col("_a") == F.col("_pi"))).groupBy("_ka", "_pa").agg(F.transform(F.array_sort(F.collect_list("_item")), lambda s: s["scalar"]).alias(f"_list_{f}"))
            out = out.join(lists, (F.col("_k") == F.col("_ka")) & (F.col("_n") == F.col("_pa")), "left").drop("_ka", "_pa")
            out = out.withColumn(f, F.coalesce(f"_list_{f}", F.when(F.size(f"_lone_{f}") > 0, F.col(f"_lone_{f}")))).drop(f"_list_{f}", f"_lone_{f}")
    text = F.to_json(F.map_from_entries(F.array_sort(F.coalesce("_all", none))))
    return out.withColumn("_rescued", text).drop("_all").withColumnRenamed("_k", key).withColumnRenamed("_n", "node")
