

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from libroflow.functions import dates, geometry, similarity, text
from libroflow.operators import entity, evaluate, layout, provider, repair, select
from libroflow.session import cut, hot_lookup, small


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.clean_line(F.lit(" [margin]a  [b] = c"))) == "a b c"
    assert one(spark, text.clean_line(F.lit("<x> [b]"))) == "<x> [b]"
    assert one(spark, text.marginal(F.lit("Partida 8236"))) and one(spark, text.marginal(F.lit("corto")))
    assert not one(spark, text.marginal(F.lit("tos ochenta y cinco yo")))
    assert one(spark, text.join_lines(F.array(F.lit("ocho-"), F.lit("cientos y"), F.lit("dos")))) == "ochocientos y dos"
    assert one(spark, text.build_entry(F.array(F.lit("a"), F.lit(""), F.lit("b-"), F.lit("-c")))) == "a c"
    assert one(spark, text.build_entry(F.array(F.lit("")))) == ""
    assert one(spark, text.pad(F.lit(12345), 4)) == "12345" and one(spark, text.pad(F.lit(7), 2)) == "07"
    assert one(spark, text.image_number(F.lit(1006), F.lit(3))) == 6


@pytest.mark.parametrize("value, s, e", [("1797", "1797-01-01", "1797-12-31"), ("1796-02", "1796-02-01", "1796-02-28"), ("1798-01-__", "1798-01-01", "1798-01-31"), ("1798-03-04/1799", "1798-03-04", "1798-03-04"), ("x", None, None)])
def test_dates(spark, value, s, e):
    assert one(spark, dates.complete_date(F.lit(value), "s")) == s
    assert one(spark, dates.complete_date(F.lit(value), "e")) == e


def test_geometry(spark):
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("left", "top", "right", "bottom"))])
    assert one(spark, geometry.iou(box(0, 0, 50, 50), box(0, 0, 40, 40))) == pytest.approx(0.64)
    assert one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    assert one(spark, geometry.box_overlap(box(0, 0, 1, 1), box(1, 0, 2, 1))) == 0
    assert one(spark, geometry.gcd(F.lit(1071), F.lit(462))) == 21
    assert one(spark, geometry.f_score(F.lit(1 / 3), F.lit(0.5))) == pytest.approx(0.4)


def test_greedy(spark):
    t = [(0, 0, 50, 50), (60, 60, 90, 90)]
    f = [(0, 0, 40, 40), (0, 0, 45, 45), (200, 200, 210, 210)]
    arr = lambda bs: F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(b, ("left", "top", "right", "bottom"))]) for b in bs])
    assert one(spark, evaluate.greedy_matches(arr(t), arr(f))) == 1


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.text("abcé", max_size=6), st.text("abcé", max_size=6)), min_size=8, max_size=8))
def test_indel(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.indel_ratio(F.col("a"), F.col("b")).alias("r"))
    for a, b, r in df.collect():
        assert r == pytest.approx(1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b)))


def test_overlapping_is_exact(spark):
    """The grid join finds each pair that shares area, once."""
    boxes = [(1, i, (i * 137) % 700, (i * 91) % 650, (i * 137) % 700 + 30 + (i * 53) % 420, (i * 91) % 650 + 20 + (i * 29) % 300) for i in range(40)]
    df = spark.createDataFrame(boxes, "image long, box_id long, left long, top long, right long, bottom long")
    got = sorted((r.a.box_id, r.b.box_id) for r in evaluate.overlapping(df, df, "image").collect())
    want = sorted((a[1], b[1]) for a in boxes for b in boxes if max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5]))
    assert got == want


def test_reciprocity(spark):
    edges = spark.createDataFrame(
        [(1, "a", "b", "parent", 0), (2, "a", "b", "parent", 0), (2, "b", "a", "child", 0), (3, "a", "b", "child", 0), (3, "b", "a", "child", 0), (4, "a", "b", "spouse", 0), (4, "b", "a", "child", 0), (5, "a", "b", "parent", 0), (5, "b", "a", "parent", 0), (6, "a", None, "parent", 0)],
        "e long, src string, dst string, rel string, pos int",
    )
    lead = spark.createDataFrame([(3, "b"), (5, "a")], "e long, p string")
    got = sorted(map(tuple, repair.reciprocal(edges, "e", "src", "dst", "rel", lead, "p").collect()))
    assert got == sorted([(1, "a", "b", "parent", "kept"), (1, "b", "a", "child", "added"), (2, "a", "b", "parent", "kept"), (2, "b", "a", "child", "kept"), (3, "a", "b", "child", "rewritten"), (3, "b", "a", "parent", "rewritten"), (5, "a", "b", "parent", "rewritten"), (5, "b", "a", "child", "rewritten")])


def test_repair_rules(spark):
    assert one(spark, repair.valid_json(F.lit('{"people": null}'))) and not one(spark, repair.valid_json(F.lit("{bad")))
    assert one(spark, repair.named_people(F.array(F.lit('{"id": null, "name": 1}'), F.lit('{"id": 2}')))) == ['{"id": null, "name": 1}']
    assert one(spark, repair.known_only(F.array(F.lit("a"), F.lit("x"), F.lit("a")), F.array(F.lit("a")))) == ["a", "a"]
    assert one(spark, repair.event_problem(F.lit("marriage"), F.array(F.lit("a")))) == "wrong number of principals"
    assert one(spark, repair.fill_text(F.lit('["x", "y"]'), F.lit("array"))) == "x"


def test_stitch_and_back_fill(spark):
    df = spark.createDataFrame([(1, 1, "beginning", "a"), (1, 2, "end", "b"), (1, 3, "complete", "c"), (1, 4, "beginning", "d")], "v int, i int, verdict string, raw string")
    assert [r.raw for r in repair.stitched(df, "v", ["i"], "verdict", "raw").orderBy("i").collect()] == ["a b", "c", "d"]
    d = spark.createDataFrame([(1, 1, None), (1, 2, "x"), (1, 3, None), (1, 4, "y"), (1, 5, None)], "v int, i int, d string")
    assert [r.o for r in repair.back_filled(d, "v", ["i"], "d", "o").orderBy("i").collect()] == [None, "x", "x/y", "y", None]


def test_selection(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "a", "x")], "id int, k string, t string")
    assert select.matching(df, None).count() == 3
    assert select.matching(df, {"k": "a", "t": "x"}, "or").count() == 3 and select.matching(df, {"k": "a", "t": "x"}, "and").count() == 1
    assert select.capped(df, "id", 2).count() == 2 and select.by_strategy(df, {}, "?").count() == 3


def test_entities(spark):
    df = spark.createDataFrame([(1, 2, "B", ["x", None]), (1, 1, "A", None), (1, 3, "A", ["y", "x"]), (2, 1, None, [])], "g int, k int, n string, t array<string>")
    got = {r.g: (r.n, r.t) for r in entity.folded(df, ["g"], ["k"], ["n"], ["t"]).collect()}
    assert got[1] == (["A", "B"], ["x", "y"])
    n = entity.numbered(spark.createDataFrame([(9, 5), (9, 2)], "v int, f int"), "v", ["f"], "id").orderBy("f").collect()
    assert [r.id for r in n] == ["9-P00001", "9-P00002"]


def test_layout(spark):
    s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([0, 9, 0, 0, 9, 9, 0, 0])], "g int, i int, v double")
    assert [(r.start, r.end) for r in layout.spaces(s, "g", "i", "v", 0.5).orderBy("end").collect()] == [(0, 1), (2, 4)]
    assert [(r.start, r.end) for r in layout.runs(s, "g", "i", F.col("v") > 0, 2).collect()] == [(4, 5)]
    b = spark.createDataFrame([(1, 0, 0, 10, 10), (1, 15, 0, 25, 10), (1, 100, 100, 110, 110)], "g long, left long, top long, right long, bottom long")
    assert sorted((r.left, r.right) for r in layout.merged_boxes(b, "g", 6).collect()) == [(0, 25), (100, 110)]
    p = layout.prominent_peaks(s, "g", "i", "v", 1, 1.0, 1, 5).collect()
    assert [r.i for r in p] == [1]


def test_provider(spark):
    df = spark.createDataFrame([(1, "q1"), (2, "q2")], "k long, raw string")
    chats = provider.conversations(df, F.array(F.lit("sys")), F.array(F.struct(F.lit("ex").alias("raw"), F.lit("an").alias("answer"))), F.col("raw"))
    first = chats.orderBy("k").first().messages
    assert [(m.role, m.content) for m in first] == [("system", "sys"), ("user", "ex"), ("assistant", "an"), ("user", "q1")]
    stored = chats.filter("k = 1").select(provider.request_hash(F.col("messages")).alias("request"), F.lit("A1").alias("answer"))
    assert {r.k: r.answer for r in provider.replay(chats, stored).collect()} == {1: "A1", 2: None}
    assert {r.k: r.answer for r in provider.answered(chats, "k", lambda cs: [c[-1]["content"].upper() for c in cs]).collect()} == {1: "Q1", 2: "Q2"}

    def broken(_):
        raise OSError

    assert {r.answer for r in provider.answered(chats, "k", broken).collect()} == {None}


def test_hot_lookup(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    right = spark.range(1500).select(F.col("id").alias("r"), (F.col("id") * 10).alias("v"))
    got = hot_lookup(left, "k", right, "r", 3000, floor=100).collect()
    assert len(got) == 3000 and all(x.v == (x.k * 10 if x.k < 1500 else None) for x in got)
    assert small(left, 10) is None and len(small(right.limit(3), 10)) == 3
    assert cut(right).count() == 1500




def test_pipeline(spark):
    from libroflow.plans.pipeline import volume_edges, volume_events, volume_people

    people = spark.createDataFrame([(5, 0, "1-01", "P1"), (5, 0, "1-01", "P2"), (5, 1, "1-02", "P1")], "volume_id long, pos int, entry_id string, person_id string")
    links = spark.createDataFrame([("5-1-01-P2", "g"), ("5-1-02-P1", "g")], "mention_id string, group string")
    ids = {(r.entry_id, r.person_id): r.cluster_id for r in volume_people(people, links).collect()}
    assert ids == {("1-01", "P1"): "5-P00001", ("1-01", "P2"): "5-P00002", ("1-02", "P1"): "5-P00002"}
    named = volume_people(people, links)
    edges = spark.createDataFrame([(5, "1-01", "P1", "P2", "parent"), (5, "1-02", "P1", "P9", "spouse"), (5, "1-02", "P1", "P1", "friend")], "volume_id long, entry_id string, src string, dst string, rel string")
    assert sorted((r.src, r.dst, r.rel) for r in volume_edges(edges, named).collect()) == [("5-P00001", "5-P00002", "parent"), ("5-P00002", "P9", "spouse")]
    events = spark.createDataFrame([(5, "1-01", 0, "baptism", "d", ["P2", "P1", "P2"], ["P9"]), (5, "1-02", 0, "burial", None, None, None)], "volume_id long, entry_id string, event_pos int, type string, date string, principals array<string>, witnesses array<string>")
    got = {r.event_id: (r.principals, r.witnesses) for r in volume_events(events, named).collect()}
    assert got == {"1-01-E00": (["5-P00002", "5-P00001"], ["P9"]), "1-02-E00": ([], [])}


def test_sparse_components(spark):
    from libroflow.operators import folio

    boxes = [(1, i, "unbound", 500, 10 * i, 600, 10 * i + 9, "text_region") for i in range(10)] + [(1, 99, "unbound", 900, 400, 910, 410, "text_region")]
    df = spark.createDataFrame(boxes, "image long, box_id long, side string, left long, top long, right long, bottom long, label string")
    got = {r.box_id: r.label for r in folio.sparse_to_other(df, "image").collect()}
    assert got[99] == "other" and sum(v == "text_region" for v in got.values()) == 10
    shapes = spark.createDataFrame([(1, 0, 0, 10, 100, "text_region"), (2, 0, 0, 10, 100, "facing_folio")], "box_id long, left long, top long, right long, bottom long, label string")
    assert {r.box_id: r.label for r in folio.odd_shapes(shapes).collect()} == {1: "other", 2: "facing_folio"}
