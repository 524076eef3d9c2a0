"""Ordered operations over hot groups equal plain windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from libroflow.operators.windows import nearest_known, next_values, row_numbers
from libroflow.session import cut


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(0 if rng.random() < 0.6 else None if rng.random() < 0.1 else rng.randint(1, 5), i, None if rng.random() < 0.7 else f"v{rng.randint(0, 9)}", "clash") for i in rng.sample(range(5000), 1200)]
    return cut(spark.createDataFrame(data, "g bigint, k bigint, v string, _rest string"))


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("floor", [50, 10**6])
def test_windows(spark, rows, floor):
    w = Window.partitionBy("g").orderBy("k")
    assert same(rows.withColumn("n", F.row_number().over(w).cast("bigint")), row_numbers(rows, "g", ["k"], "n", floor))
    assert same(rows.withColumn("a", F.lead("v").over(w)).withColumn("b", F.lead("k").over(w)), next_values(rows, "g", ["k"], {"v": "a", "k": "b"}, floor))
    want = rows.withColumn("a", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("b", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    assert same(want, nearest_known(rows, "g", ["k"], "v", "a", "b", floor))


def test_empty(spark, rows):
    none = rows.limit(0)
    assert row_numbers(none, "g", ["k"], "n").count() == next_values(none, "g", ["k"], {"v": "a"}).count() == nearest_known(none, "g", ["k"], "v", "a", "b").count() == 0
