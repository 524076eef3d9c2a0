import json

import pytest
from pyspark.sql import functions as F

from libroflow.operators.drift import approved_paths, conform, departures, edits, ingest, same_name, squash
from libroflow.operators.shred import LINK_PATHS, entity, entry_links, inner_values, shred

KINDS = {
    "id": "number", "title": "string", "entries": "array", "entries.id": "string", "entries.data": "object", "entries.data.people": "array", "entries.data.people.id": "string",
    "entries.data.people.name": "string", "entries.data.people.free": "boolean", "entries.data.people.titles": "array", "entries.data.people.ethnicity": "string", "entries.data.people.relationships": "array",
    "entries.data.people.relationships.related_person": "string", "entries.data.people.relationships.relationship_type": "string", "entries.data.events": "array", "entries.data.events.type": "string",
    "entries.data.events.principals": "array", "entries.data.events.witnesses": "array",
}
BODY = {
    "id": 7, "title": "T", "extra": {"a": 1},
    "entries": [{
        "id": "0001-01",
        "data": {
            "people": [
                {"id": "P01", "name": "A", "free": "no", "titles": "Don", "ethnicty": "Angola", "relationships": [{"related_person": " p2", "relationship_type": "parent"}, {"related_person": "P09", "relationship_type": "spouse"}, {"related_person": "P08", "relationship_type": "spouse"}, {"related_person": None, "relationship_type": "spouse"}]},
                {"id": "0001-01-P02", "name": "B", "free": True, "titles": ["Fray", "Doña"], "ethnicity": None, "relationships": {"related_person": "P1", "relationship_type": "child"}},
            ],
            "events": [{"type": "baptism", "principal": "P02", "witnesses": ["0001-01-p1", "0002-01-P01"]}],
        },
    }],
}


def files(spark, rows):
    return spark.createDataFrame([(k, b if b is None or isinstance(b, str) else json.dumps(b), "clash") for k, b in rows], "file_id bigint, body string, label string")


def catalogue(spark, kinds=None):
    return spark.createDataFrame(list((KINDS if kinds is None else kinds).items()), "field_path string, json_type string")


def test_links(spark):
    nodes = shred(files(spark, [(1, BODY), (1, BODY), (2, None), (3, ""), (4, "{bad"), (5, {})]), "file_id", "body", KINDS, approved_paths(), LINK_PATHS)
    got = sorted(map(tuple, entry_links(nodes, "file_id").collect()))
    assert got == [
        (1, 1, "event", 1, "principal", 2), (1, 1, "event", 1, "witness", 0), (1, 1, "event", 1, "witness", 1),
        (1, 1, "person", 1, "parent", 2), (1, 1, "person", 1, "spouse", 0), (1, 1, "person", 2, "child", 1),
    ]


def test_shred_keeps_everything(spark):
    """Rebuilding the JSON from the nodes gives the body back."""
    rows = shred(files(spark, [(1, BODY)]), "file_id", "body").collect()
    kids = {}
    for r in sorted(rows, key=lambda r: r.ordinal):
        kids.setdefault(r.parent, []).append(r)

    def build(r):
        if r.kind == "object":
            return {k.label: build(k) for k in kids.get(r.node, [])}
        if r.kind == "array":
            return [build(k) for k in kids.get(r.node, [])]
        return None if r.kind == "null" else r.scalar if r.kind == "string" else json.loads(r.scalar)

    assert build(kids[None][0]) == BODY


def test_entity_and_conform(spark):
    nodes = shred(files(spark, [(1, BODY)]), "file_id", "body", KINDS, approved_paths())
    people = {r.id: r for r in entity(nodes, "file_id", "entries.data.people", ["id", "name"]).collect()}
    assert people["P01"].pos_path == [1, 1] and people["0001-01-P02"].name == "B"
    table = {r.name: r for r in conform(nodes, "file_id", "entries.data.people", KINDS).collect()}
    assert (table["A"].free, table["A"].titles, table["A"].ethnicity) == (False, ["Don"], "Angola")
    assert (table["B"].free, table["B"].titles, table["B"].ethnicity) == (True, ["Fray", "Doña"], None)
    assert json.loads(table["A"]._rescued)["entries.data.people.titles"] == '"Don"'


def test_departures(spark):
    _, report, used = ingest(files(spark, [(1, BODY), (1, BODY), (2, None)]), "file_id", "body", catalogue(spark))
    got = sorted(map(tuple, report.collect()))
    p = "entries.data.people"
    assert got == sorted([
        (1, "extra", "added", ""), (1, "extra.a", "added", ""), (1, f"{p}.ethnicty", "renamed", f"{p}.ethnicity"), (1, f"{p}.free", "type_changed", f"{p}.free"),
        (1, f"{p}.titles", "type_changed", f"{p}.titles"), (1, f"{p}.relationships", "type_changed", f"{p}.relationships"),
        (1, "entries.data.events.principal", "renamed", "entries.data.events.principals"), (1, "entries.data.events.principal", "type_changed", "entries.data.events.principals"),
    ])
    assert used[f"{p}.ethnicty"] == f"{p}.ethnicity"


def test_removed_and_empty(spark):
    _, report, _ = ingest(files(spark, [(1, {"id": "x"})]), "file_id", "body", catalogue(spark, {"id": "number", "title": "string"}))
    assert sorted(map(tuple, report.collect())) == [(1, "id", "type_changed", "id"), (1, "title", "removed", "title")]
    _, none, _ = ingest(files(spark, []), "file_id", "body", catalogue(spark))
    assert none.count() == 0
    _, added, _ = ingest(files(spark, [(1, {"a": 1})]), "file_id", "body", spark.createDataFrame([], "field_path string, json_type string"))
    assert [tuple(r) for r in added.collect()] == [(1, "a", "added", "")]


def test_two_names_of_one_field(spark):
    """The agreed name comes first, then the one that can be read; the other value is rescued, or in the child table."""
    kinds = KINDS | {"entries.data.people.occupation": "string"}
    person = lambda **x: {"entries": [{"id": "1", "data": {"people": [{"id": "P1", **x}], "events": [], "note": 5}}]}
    rows = [(1, person(ethnicity="Angola", ethnicitiy="Congo")), (2, person(ethnicity=None, ethnicitiy="Congo")), (3, person(free="perhaps", freed=True)), (4, person(ethnicitiy="Congo", nation="Mina")), (5, person(occupation=["a", "b"], ocupation="c")), (6, person(titles=["Don", {"x": 1}]))]
    nodes = shred(files(spark, rows), "file_id", "body", kinds, approved_paths())
    got = {r.file_id: r for r in conform(nodes, "file_id", "entries.data.people", kinds).collect()}
    kept = lambda k: {p.rpartition(".")[2]: json.loads(v) for p, v in json.loads(got[k]._rescued).items()}
    assert (got[1].ethnicity, kept(1)) == ("Angola", {"ethnicitiy": "Congo"})
    assert (got[2].ethnicity, kept(2)) == ("Congo", {})
    assert (got[3].free, kept(3)) == (True, {"free": "perhaps"})
    assert (got[4].ethnicity, kept(4)) == ("Congo", {"nation": "Mina"})
    assert (got[5].occupation, kept(5)) == ("c", {"occupation": ["a", "b"]})
    assert (got[6].titles, kept(6)) == (["Don"], {"titles": ["Don", {"x": 1}]})
    people = {r.file_id: r for r in entity(nodes, "file_id", "entries.data.people", ["id", "ethnicity", "free"]).collect()}
    assert [people[k].ethnicity for k in (1, 2, 4)] == ["Angola", "Congo", "Congo"] and people[3].free == "true"
    below = {(r.file_id, r.field, r.value) for r in inner_values(nodes, "file_id", {"entries.data.people": "person"}, [("entries.data.people", ["id", "ethnicity", "free", "occupation"])]).collect()}
    assert {(1, "ethnicitiy", "Congo"), (3, "free", "perhaps"), (4, "nation", "Mina"), (5, "occupation", "a"), (5, "occupation", "b")} <= below
    assert {json.loads(r._rescued)["entries.data.note"] for r in conform(nodes, "file_id", "entries", kinds).collect()} == {"5"}


def test_names():
    assert edits("phenotpye", "phenotype") == 1 and squash("Is_Free") == "isfree"
    assert same_name("Ethnicity", "ethnicity") and same_name("ocupation", "occupation") and not same_name("notes", "name")


def test_inner_values(spark):
    """Lists and objects in place of scalars, and lists, keep all their values."""
    person = {"id": "P01", "name": "A", "titles": ["Don", "Fray"], "occupation": ["smith", "scribe"], "relationships": [{"related_person": "P02", "relationship_type": "spouse", "note": "x"}]}
    body = {"entries": [{"id": "1", "data": {"people": [person, {"id": "P02", "titles": "Doña"}], "events": [{"type": "burial", "date": {"year": 1700, "day": {"n": 3}}, "principal": "P01"}]}}]}
    nodes = shred(files(spark, [(1, body), (2, None)]), "file_id", "body", KINDS | {"entries.data.people.occupation": "string", "entries.data.events.date": "string"}, approved_paths())
    flat = [("entries.data.people", ["id", "name", "occupation"]), ("entries.data.people.relationships", ["related_person", "relationship_type"]), ("entries.data.events", ["type", "date"])]
    got = sorted(tuple(r)[2:] for r in inner_values(nodes, "file_id", {"entries.data.people": "person", "entries.data.events": "event"}, flat).collect())
    assert got == sorted([
        ("person", 1, "titles", "", "1", "Don"), ("person", 1, "titles", "", "2", "Fray"), ("person", 1, "occupation", "", "1", "smith"), ("person", 1, "occupation", "", "2", "scribe"),
        ("person", 1, "relationships", "note", "1", "x"), ("person", 2, "titles", "", "1", "Doña"), ("event", 1, "date", "year", "", "1700"), ("event", 1, "date", "day.n", "", "3"), ("event", 1, "principals", "", "1", "P01"),
    ])


def test_odd_bodies(spark):
    """Bodies that are no objects, are nested very deeply or are very long."""
    deep, long = "[" * 200_000 + "]" * 200_000, {"id": 1, "title": "x" * 300_000, "entries": []}
    rows = [(1, "5"), (2, "null"), (3, '"text"'), (4, deep), (5, long), (6, "[]")]
    nodes = shred(files(spark, rows), "file_id", "body", KINDS, approved_paths())
    assert {r.file_id: r.kind for r in nodes.filter("parent is null").collect()} == {1: "number", 2: "null", 3: "string", 4: "invalid", 5: "object", 6: "array"}
    _, report, _ = ingest(files(spark, rows), "file_id", "body", catalogue(spark))
    assert {r.file_id for r in report.collect()} == {5} and conform(nodes, "file_id", "", KINDS).count() == 1
