import json

from pyspark.sql import functions as F

from libroflow.plans import sources
from libroflow.sources import registers, volumes
from libroflow.streaming.ingest import entries_stream

MARKUP = """<?xml version="1.0"?>
<register>
<volume type="baptism" country="Cuba" state="Norte" city="Altamar" institution="Parroquia" id="419" title="Libro 1">
<image id="1006" type="jpg">
<entry id="1">
Partida 8236
En esta Santa Iglesia de Altamar a veinte de mayo de mil ochocien-
tos ochenta y cinco,  yo el cura bautice a Eva [roto] Justina
</entry>
<entry id="2">
Martelo
</entry>
<entry id="3">
En esta santa iglesia bautice a otra criatura del mismo lugar
</entry>
<partial id="4">
En esta santa iglesia comienza una partida que sigue en
</partial>
<image id="1007" type="jpg">
<partial>
la vuelta de esta hoja y aqui termina del todo por fin
</partial>
<entry id="1">
En este nuevo folio bautice a una nina llamada Maria de los Angeles
</entry>
"""


def _lines(spark, text, source="a"):
    return spark.createDataFrame([(source, i, x) for i, x in enumerate(text.split("\n"), 1)], "source string, line_no int, line string")


def test_markup(spark):
    got = {r.entry_id: r.raw for r in registers.parse_markup(_lines(spark, MARKUP)).collect()}
    assert got == {
        "0006-01": "En esta Santa Iglesia de Altamar a veinte de mayo de mil ochocientos ochenta y cinco, yo el cura bautice a Eva Justina",
        "0006-02": "En esta santa iglesia bautice a otra criatura del mismo lugar",
        "0006-03": "En esta santa iglesia comienza una partida que sigue en la vuelta de esta hoja y aqui termina del todo por fin",
        "0007-01": "En este nuevo folio bautice a una nina llamada Maria de los Angeles",
    }
    head = registers.volume_header(_lines(spark, MARKUP)).first()
    assert (head.volume_id, head.record_type, head.title) == (419, "baptism", "Libro 1")


def test_signed_dialect(spark):
    text = "[left margin\nEn siete dias del mes casé a Juan-\nito con Maria (sic)?\n[signed]\n[f. 2\n[left margin\notra partida\n[signed]"
    got = {r.entry_id: r.raw for r in registers.parse_signed(_lines(spark, text)).collect()}
    assert got == {"0001-01": "En siete dias del mes casé a Juanito con Maria sic", "0002-01": "otra partida"}


def test_bound_dialect(spark):
    text = "VOL_12_x_y\nIMG_a_b_0001_-A_-B\n{left margin Juan\nprimera linea\n{rubric\n{left margin\nsegunda (ILL) li-\nnea\n{rubric"
    got = {r.entry_id: r.raw for r in registers.parse_bound(_lines(spark, text)).collect()}
    assert got == {"0001-A": "primera linea", "0001-B": "segunda linea"}


def test_bound_ids_are_met_once(spark):
    """A long `IMG` line isn't carried by the lines and entries after it; lines of a file have as many exchanges as its text."""
    ids = "_".join(f"-{i * 7919 % 100_003}" for i in range(3000))
    lines = [(f"{s}", k, x) for s in range(4) for k, x in enumerate(["{left margin", "none", "{rubric", f"IMG_a_b_{s}_{ids}", *["{left margin", "uno", "dos", "{rubric"] * 200, "IMG_a_b_9_-z", "{left margin", "tres", "{rubric"])]
    sc = spark.sparkContext
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None))}
    old, most = stages(), "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(most)
    spark.conf.set(most, -1)  # as with tables that are too large to send around
    rows = registers.parse_bound(spark.createDataFrame(lines, "source string, line_no int, line string")).collect()
    spark.conf.set(most, usual)
    want = {(f"{s}", 1 + k, f"{s}-{k * 7919 % 100_003}", "uno dos") for s in range(4) for k in range(200)}
    assert {tuple(r) for r in rows} == want | {(f"{s}", 0, None, "none") for s in range(4)} | {(f"{s}", 201, "9-z", "tres") for s in range(4)} and len(rows) == 808
    assert sum(n for k, n in stages().items() if k not in old) < 3 * 4 * len(ids)


def test_bound_parse_numbers_every_entry(spark, tmp_path):
    """An image may have more than 2000 entries."""
    (tmp_path / "entries.parquet").mkdir()
    rows = [(k, 7, "0003-01", "una linea") for k in range(2100)]
    spark.createDataFrame(rows, "entry_key bigint, volume_id bigint, entry_id string, raw string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "entries.parquet"))
    assert {tuple(r) for r in sources.bound_parse(spark, str(tmp_path)).collect()} == {("7/3", f"3-{k}", "una linea") for k in range(1, 2101)}


def test_empty_sources(spark):
    assert registers.parse_markup(_lines(spark, "")).count() == 0
    assert registers.parse_signed(_lines(spark, "")).count() == 0


def test_line_log_and_zip(spark):
    log = registers.line_log(_lines(spark, 'h\n"x, y",a,b,c,id1,1 2  3\n"z",a,b,c,id2,4'))
    rows = registers.zipped(_lines(spark, "uno\tdos   tres\ncuatro"), log).orderBy("i").collect()
    assert [(r.id, r.coords, r.text) for r in rows] == [("id1", ["1", "2", "3"], "uno dos tres"), ("id2", ["4"], "cuatro")]


def test_volume_round_trip(spark, tmp_path):
    record = {"type": "baptism", "id": 5, "entries": [{"id": "0001-01", "raw": "a"}, {"id": "0001-02", "raw": None}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "v.json").write_text(json.dumps(record))
    entries = volumes.entries_of(volumes.read_volumes(str(tmp_path / "in"), spark))
    assert [(r.volume_id, r.pos, r.entry_id, r.raw) for r in entries.orderBy("pos").collect()] == [(5, 0, "0001-01", "a"), (5, 1, "0001-02", None)]
    meta = spark.createDataFrame([(5, "t"), (6, "u")], "volume_id bigint, title string")
    back = {r.volume_id: [e.id for e in r.entries] for r in volumes.volume_records(entries, meta).collect()}
    assert back == {5: ["0001-01", "0001-02"], 6: []}
    q = entries_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df.select("entry_id", F.length("raw").alias("n")))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_annotations(spark):
    body = {"images": [{"filename": "x-1.jpg", "annotations": [{"name": "text", "polygon": [1, 9, 3, 4], "attributes": {"partial": False, "margin": False}}, {"name": "text", "polygon": [1, 2, 3, 4], "attributes": {"partial": True, "margin": False}}, {"name": "text", "polygon": [1, 1, 1, 1], "attributes": {"partial": False, "margin": True}}]}, {"filename": "x-2.jpg", "annotations": []}]}
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(body)]))
    assert {r.image_id: r.coords for r in volumes.manual_boxes(df).collect()} == {"x-1": [[1, 9, 3, 4], [1, 2, 3, 4]], "x-2": []}
    assert [(r.image_id, r.number, r.coords) for r in volumes.trainable_boxes(df).collect()] == [("x-1", 1, [1, 9, 3, 4])]
