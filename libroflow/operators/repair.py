"""Validation and repair of extracted people, events and relationships, on exploded edge tables.

The nested input is shredded once; each rule is a set operation, and what a rule drops goes to a failures table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libroflow.operators.windows import nearest_known, next_values

# Relationship types and their inverses; the dependent side of unequal ones; event types' principals.
INVERSE = {"parent": "child", "child": "parent", "enslaver": "slave", "slave": "enslaver", "spouse": "spouse", "godparent": "godchild", "godchild": "godparent"}
DEPENDENT = ["child", "slave", "godchild"]
PRINCIPALS = {"marriage": 2, "baptism": 1}


def inverse(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in INVERSE.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def valid_json(c: Column, member: str = "people") -> Column:
    """Whether the text is a JSON object with the member."""
    return F.coalesce(F.array_contains(F.json_object_keys(c), member), F.lit(False))


def named_people(people: Column) -> Column:
    """People that have the keys id and name; people is an array of JSON texts, a null value counts as present."""
    return F.filter(people, lambda p: F.array_contains(F.json_object_keys(p), "id") & F.array_contains(F.json_object_keys(p), "name"))


def known_only(ids: Column, known: Column) -> Column:
    """References that lead to somebody of the same entry, repeats kept."""
    return F.filter(ids, lambda x: F.array_contains(known, x))


def edge_problems(edges: DataFrame, scope: str, src: str, dst: str, rel: str, people: DataFrame, person: str) -> DataFrame:
    """The edges with `problem`: the first rule broken (missing person, missing type, invalid type, unknown person), or
    null. Every edge is kept once per occurrence."""
    known = people.select(F.col(scope).alias("_s"), F.col(person).alias("_p")).distinct()
    joined = edges.join(known, (F.col(scope) == F.col("_s")) & (F.col(dst) == F.col("_p")), "left")
    problem = F.when(F.col(dst).isNull(), "missing related_person").when(F.col(rel).isNull(), "missing relationship_type").when(~F.col(rel).isin(list(INVERSE)), "invalid relationship_type").when(F.col("_p").isNull(), "unknown person")
    return joined.withColumn("problem", problem).drop("_s", "_p")


def event_problem(kind: Column, principals: Column) -> Column:
    """What is wrong with an event: its type or principals are missing, or it has the wrong number of them."""
    wrong = F.lit(False)
    for k, n in PRINCIPALS.items():
        wrong = wrong | ((kind == k) & (F.size(principals) != n))
    return F.when(kind.isNull(), "missing type").when(principals.isNull(), "missing principals").when(wrong, "wrong number of principals")


def fill_text(value: Column, json_type: Column) -> Column:
    """A nullable text property: of a list its first text, of anything else the text or null."""
    return F.when(json_type == "array", F.get(F.from_json(value, "array<string>"), F.lit(0))).when(json_type.isin("string", "number", "boolean"), value)


def reciprocal(edges: DataFrame, scope: str, src: str, dst: str, rel: str, principals: DataFrame, person: str) -> DataFrame:
    """Reciprocity repair on a snapshot: (scope, src, dst, rel, fate).

    A missing reverse is added (`added`); a reverse that is the inverse stays (`kept`); one that is neither the inverse
    nor the same type, or where neither end is a principal, is dropped in both directions; the same type both ways is
    rewritten with the principal as the dependent side (`rewritten`), the source if both are principals.
    """
    snap = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.col(scope).alias("s"), F.col(src).alias("a"), F.col(dst).alias("b"), F.col(rel).alias("r"), "pos")
    last = snap.groupBy("s", "a", "b").agg(F.max_by("r", "pos").alias("r"))
    back = last.select(F.col("s").alias("s2"), F.col("a").alias("b2"), F.col("b").alias("a2"), F.col("r").alias("rb"))
    lead = principals.select(F.col(scope).alias("s3"), F.col(person).alias("p3")).distinct()
    pairs = last.join(back, (F.col("s") == F.col("s2")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")), "left").drop("s2", "a2", "b2")
    pairs = pairs.join(lead.withColumnRenamed("p3", "pa"), (F.col("s") == F.col("s3")) & (F.col("a") == F.col("pa")), "left").drop("s3")
    pairs = pairs.join(lead.withColumnRenamed("p3", "pb"), (F.col("s") == F.col("s3")) & (F.col("b") == F.col("pb")), "left").drop("s3")
    principal_a, principal_b = F.col("pa").isNotNull(), F.col("pb").isNotNull()
    # both rows of a pair must come to one verdict: the smaller end is looked at first
    first_a = principal_a & (~principal_b | (F.col("a") <= F.col("b")))
    fate = F.when(F.col("rb").isNull(), "one way").when(F.col("rb") == inverse(F.col("r")), "kept").when((F.col("rb") != F.col("r")) | ~(principal_a | principal_b), "dropped").otherwise("rewritten")
    judged = pairs.withColumn("fate", fate).withColumn("first_a", first_a)
    depends = F.col("r").isin(DEPENDENT)
    own = F.when(F.col("first_a"), F.when(depends, inverse(F.col("r"))).otherwise(F.col("r"))).otherwise(F.when(depends, F.col("r")).otherwise(inverse(F.col("r"))))
    stay = judged.filter(F.col("fate").isin("kept", "one way")).select("s", "a", "b", "r", F.lit("kept").alias("fate"))
    add = judged.filter("fate = 'one way'").select("s", F.col("b").alias("a"), F.col("a").alias("b"), inverse(F.col("r")).alias("r"), F.lit("added").alias("fate"))
    new = judged.filter("fate = 'rewritten'").select("s", "a", "b", own.alias("r"), "fate")
    return stay.unionByName(add).unionByName(new).select(F.col("s").alias(scope), F.col("a").alias(src), F.col("b").alias(dst), F.col("r").alias(rel), "fate")


def failed_outputs(failures: DataFrame, key: str, body: str, order: str) -> DataFrame:
    """The failed outputs, one per key: the body logged first."""
    return failures.groupBy(key).agg(F.min_by(body, order).alias(body))


def stitched(entries: DataFrame, volume: str, order: list[str], verdict: str, raw: str) -> DataFrame:
    """Partial entries across images put together: a `beginning` followed by an `end` takes its text, and every `end`
    goes. A trailing beginning stays as it is."""
    entries = next_values(entries, volume, order, {verdict: "_verdict", raw: "_raw"})
    joined = F.when((F.col(verdict) == "beginning") & (F.col("_verdict") == "end"), F.concat_ws(" ", F.col(raw), F.col("_raw"))).otherwise(F.col(raw))
    return entries.withColumn("_joined", joined).filter(F.coalesce(F.col(verdict) != "end", F.lit(True))).withColumn(raw, F.col("_joined")).drop("_joined", "_verdict", "_raw")


WHOLE_DATE = r"^\d{4}-\d{2}-\d{2}$"


def back_filled(df: DataFrame, group: str, order: list[str], date: str, out: str, kind: str | None = None, whole: str | None = None) -> DataFrame:
    """Undated rows between two dated ones get the range `last/next`. Where a pattern `whole` is given, only dates that fit
    it are carried; where `kind` names the column of the event's type, births stay undated."""
    carried = F.col(date) if whole is None else F.when(F.col(date).rlike(whole), F.col(date))
    near = nearest_known(df.withColumn("_whole", carried), group, order, "_whole", "_last", "_next")
    may = F.lit(True) if kind is None else F.coalesce(F.col(kind) != "birth", F.lit(True))
    return near.withColumn(out, F.coalesce(F.col(date), F.when(may, F.concat("_last", F.lit("/"), "_next")))).drop("_whole", "_last", "_next")
