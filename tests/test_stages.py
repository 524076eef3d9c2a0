"""The extraction chain on a small fixture."""

import json

from pyspark.sql import functions as F

from libroflow.operators import provider, stages
from libroflow.plans.pipeline import extracted
from libroflow.streaming.ingest import handled

KINDS = {
    "entries": "array", "entries.data": "object", "entries.data.people": "array", "entries.data.events": "array", "entries.data.people.id": "string", "entries.data.people.name": "string", "entries.data.people.occupation": "string",
    "entries.data.people.titles": "array", "entries.data.people.relationships": "array", "entries.data.people.relationships.related_person": "string", "entries.data.people.relationships.relationship_type": "string",
    "entries.data.events.type": "string", "entries.data.events.date": "string", "entries.data.events.principals": "array", "entries.data.events.witnesses": "array",
}
ANSWER = {
    "people": [
        {"id": "P01", "name": "A", "occupation": ["smith", "scribe"], "titles": "Don", "relationships": [{"related_person": "P02", "relationship_type": "parent"}, {"related_person": "P09", "relationship_type": "parent"}, {"related_person": "P02", "relationship_type": "friend"}, {"relationship_type": "child"}, {"related_person": "P02", "relationship_type": "spouse", "note": 1}]},
        {"id": "P02", "name": None}, {"id": "P03"}, {"name": "D"},
    ],
    "events": [{"type": "baptism", "principal": "P02", "date": 1700}, {"type": "marriage", "principals": ["P01", "P08"]}, {"principals": []}, {"type": "burial"}, {"type": "burial", "principals": ["P02", "P07"], "date": "1701"}],
}


def chain(spark, answers):
    entries = spark.createDataFrame([(k, 1, f"text {k}", "clash") for k in range(1, 6)] + [(9, 1, None, "clash")], "entry_key bigint, volume_id bigint, normalized string, kind string")
    volumes = spark.createDataFrame([(1, "Cuba", "baptism", None)], "volume_id bigint, country string, record_type string, state string")
    told = [(["extraction"], 1, "List people."), (["normalization"], 1, "x")]
    asked = stages.requests(entries, volumes, told, "extraction", F.col("normalized"))
    stored = asked.filter("normalized is not null").select("entry_key", provider.request_hash(F.col("messages")).alias("request")).join(spark.createDataFrame(answers, "entry_key bigint, answer string"), "entry_key").drop("entry_key")
    return extracted(entries, volumes, told, stored, KINDS)


def test_chain(spark):
    out = chain(spark, [(1, json.dumps(ANSWER)), (2, "{broken"), (3, json.dumps({"events": []})), (4, json.dumps({"people": [], "events": []}))])
    assert sorted(r.entry_key for r in out["rejected"].collect()) == [2, 3]
    assert sorted((r.kind, r.pos, r.sub_pos, r.problem) for r in out["problems"].collect()) == [
        ("event", 2, 0, "wrong number of principals"), ("event", 3, 0, "missing type"), ("event", 4, 0, "missing principals"), ("person", 3, 0, "missing name"), ("person", 4, 0, "missing id"),
        ("relationship", 1, 2, "unknown person"), ("relationship", 1, 3, "invalid relationship_type"), ("relationship", 1, 4, "missing related_person"), ("relationship", 1, 5, "too many members"),
    ]
    assert [tuple(r) for r in out["failures"].collect()] == [(1, 1, 9, "missing name")]
    people = {r.id: r for r in out["people"].collect()}
    assert set(people) == {"P01", "P02"} and (people["P01"].occupation, people["P01"].titles, people["P01"].listed) == ("smith", ["Don"], ["occupation"]) and people["P02"].titles == []
    assert sorted((r.event_pos, r.type, r.date, r.principals) for r in out["events"].filter("type is not null").collect()) == [(1, "baptism", None, ["P02"]), (4, "burial", None, []), (5, "burial", "1701", ["P02"])]
    assert [(r.pos, r.related_person, r.relationship_type) for r in out["relationships"].collect()] == [(1, "P02", "parent")]


def test_no_answers(spark):
    out = chain(spark, [])
    assert all(out[k].count() == 0 for k in ("rejected", "problems", "failures", "people", "events", "relationships"))


def test_requests(spark):
    entries = spark.createDataFrame([(1, 1, "raw")], "entry_key bigint, volume_id bigint, raw string")
    volumes = spark.createDataFrame([(1, "Cuba", "baptism", None)], "volume_id bigint, country string, record_type string, state string")
    shots = spark.createDataFrame([("baptism", i, f"q{i}", f"a{i}") for i in (3, 1, 2)] + [("burial", 0, "x", "y"), (None, 0, "x", "y")], "record_type string, example_key bigint, raw string, answer string")
    got = stages.requests(entries, volumes, [(["normalization"], 1, "Do.")], "normalization", F.col("raw"), shots, 2).first().messages
    assert [m.content for m in got] == ["Do.", "q1", "a1", "q2", "a2", "raw"]
    block = stages.transcription_requests(spark.createDataFrame([("0001-01",)], "block_id string"), F.lit("Read."), "host", spark.createDataFrame([("0000-01", "text")], "block_id string, text string"))
    assert len(block.first().messages) == 4 and len(stages.transcription_requests(block.select("block_id"), F.lit("Read."), "host", fine_tuned=True).first().messages) == 2
    words = spark.createDataFrame([(1, " Beginning"), (2, "END"), (3, "perhaps"), (4, None)], "i int, a string").select("i", stages.verdict(F.col("a")).alias("v"))
    assert [r.v for r in words.orderBy("i").collect()] == ["beginning", "end", "complete", "complete"]
    lines = spark.createDataFrame([("e", 2, "b"), ("e", 1, "a"), ("e", 3, None)], "entry string, n int, text string")
    assert stages.line_transcripts(lines, "entry", ["n"], "text").first().text == "a b"


def test_handled():
    assert handled({}, str)["statusCode"] == 400 and handled({"body": ""}, str)["statusCode"] == 400
    assert handled({"body": "x"}, lambda b: {"n": len(b)}) == {"statusCode": 200, "body": '{"n": 1}'}
