"""Consolidating pairwise matches into groups: minimum labels over contracted edges, with pointer jumping.

Each round gives every node the smallest label among itself and its neighbours, jumps pointers twice (four steps along
the labels), and contracts the edges to the labels reached; it ends when no edge joins two labels. Paths stay paths
under relabelling and a group's smallest id keeps itself, so the last label of a group is its smallest id. Each
round is checkpointed.
The edges need no join for the minimum (a map-side combined aggregation), and look-ups of labels go through
`hot_lookup`, so a giant group or a node in a third of all pairs stays spread over the executors.

Defined edge cases: a null flag is no match; null or empty id lists and null ids add nothing; a record compared
with itself is a group of its own; repeated pairs count once; no decisions give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libroflow.session import apart, cut, drop, hot_keys, hot_lookup, moved, sized

SMALL_ROWS, SMALL_BYTES = 100_000, 8 << 20  # a table of labels no larger is sent to the tasks instead of shuffled


def _follow(left: DataFrame, key: str, labels: DataFrame, rows: int, few: bool, hot: DataFrame | None = None) -> DataFrame:
    """`left` with the label of `key` in a column `_p`; labels: (id, p). few: the labels' size is checked and small."""
    side = labels.select(F.col("id").alias("_id"), F.col("p").alias("_p"))
    out = left.join(F.broadcast(side), F.col(key) == F.col("_id"), "left") if few else hot_lookup(left, key, side, "_id", rows, hot=hot)
    return out.drop("_id")


def _jump(parent: DataFrame, rows: int, few: bool) -> DataFrame:
    """Two rounds of pointer jumping: every node takes its label's label, twice; parent: (id, p), checkpointed."""
    for _ in range(2):
        parent = _follow(parent, "p", parent, rows, few).select("id", F.coalesce("_p", "p").alias("p"))
    return parent


def components(star: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """(id, group) from pairs (u, v), where every id occurs as some u (paired with itself if with nobody)."""
    spark = star.sparkSession
    own = apart(spark)
    pairs = star.select("u", "v")
    held = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    edges = moved(held, own)
    levels: list[tuple[DataFrame, int, bool]] = []
    sized(own, edges.count())
    while True:
        # each node's smallest neighbour, combined before the shuffle, and how many pairs it is in
        lowest = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        nodes, rows, most, size = lowest.agg(F.count(F.lit(1)), F.sum("n"), F.max("n"), F.sum(F.octet_length(F.col("u").cast("string")))).first()
        if not nodes:
            break
        sized(own, rows)
        few = nodes <= small_rows and size <= SMALL_BYTES // 2
        roots = cut(_jump(lowest.select(F.col("u").alias("id"), F.least("u", "m").alias("p")), nodes, few))
        levels.append((roots, nodes, few))
        hot = hot_keys(lowest, "u", "n", rows)  # both ends of the pairs have the same counts
        a = _follow(edges, "u", roots, rows, few, hot).select("v", F.col("_p").alias("pu"))
        b = _follow(a, "v", roots, rows, few, hot).select("pu", F.col("_p").alias("pv"))
        edges = cut(b.filter("pu != pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct())
        drop(held, lowest)
        held = edges
    # the labels of later rounds are followed from the last, the smallest, up to the first, which has every node
    done, few = None, False
    for roots, nodes, small in reversed(levels):
        sized(own, nodes)
        done, few = (cut(_follow(roots, "p", done, nodes, few).select("id", F.coalesce("_p", "p").alias("p"))) if done is not None else roots), small
    out = moved(done if done is not None else edges.select(F.col("u").alias("id"), F.col("v").alias("p")), spark)
    return out.select("id", F.col("p").alias("group"))


def group_ids(decisions: DataFrame, left: str, right: str, flag: str) -> DataFrame:
    """(id, group): every id in a true decision, with the smallest id linked to it directly or indirectly."""
    none = F.array().cast("array<string>")
    ids = F.array_distinct(F.filter(F.concat(F.coalesce(left, none), F.coalesce(right, none)), lambda x: x.isNotNull()))
    pairs = decisions.filter(F.col(flag)).select(ids.alias("ids")).filter(F.size("ids") > 0)
    return components(pairs.select(F.explode("ids").alias("u"), F.array_min("ids").alias("v")))
