from pyspark.sql import functions as F

from libroflow.llm.language import OTHER, address_suffix, declared, fit, identify, paragraphs_of, words_of

TEXT = {
    "es": "El cura de esta iglesia bautizó a una niña que nació en la villa y fue su padrino el vecino de este lugar",
    "pt": "Nesta igreja batizou o padre uma menina que nasceu na freguesia e foi seu padrinho um morador desta terra",
    "en": "The priest of this church baptised a girl who was born in the town and her sponsor was a man of that place",
    "fr": "Le curé de cette église a baptisé une fille qui est née dans la ville et le parrain fut un habitant de ce lieu",
    "la": "In hac ecclesia baptizavi infantem filiam legitimam coniugum huius loci et patrini fuerunt quos de cognatione admonui",
}


def test_words():
    assert words_of("Él, BAUTIZÓ; niña-2") == [b"el", b"bautizo", b"nina", b"2"] and words_of("") == []
    assert paragraphs_of("a\r\n\n  \nb") == ["a", "b"]


def test_declared(spark):
    names = ["es", "ES", "es-CU", " español ", "castellano", "Portuguese", "fra", "latín", "und", "xx", "", None]
    got = [r.x for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, lang string").orderBy("i").select(declared(__import__("pyspark.sql.functions", fromlist=["col"]).col("lang")).alias("x")).collect()]
    assert got == ["es", "es", "es", "es", "es", "pt", "fr", "la", None, None, None, None]


def test_fit_survives_wrong_labels():
    rows = [(t, x) for x, t in TEXT.items() for _ in range(8)] + [(TEXT["es"], "en"), (TEXT["fr"], "la")]
    model = fit(rows)
    assert model.likelihoods([words_of(t) for t in TEXT.values()]).argmax(axis=1).tolist() == [0, 1, 2, 3, 4]
    assert fit([]).likelihoods([[]]).tolist() == [[0.0] * 5]


def test_identify(spark):
    rows = [(i, t, x, "s", 1, "c") for i, (x, t) in enumerate(TEXT.items())]
    rows += [(10, TEXT["es"] + "\n\n" + TEXT["fr"][:60], "es", None, None, "c"), (11, TEXT["en"], "la", "s", 1, "c"), (12, None, "es", "s", 1, "c"), (13, " \n ", "es", "s", 1, "c"), (14, "123 456", None, "s", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, volume_id bigint, mixed string")
    got = {(r.doc_id, r.par_no): r for r in identify(docs).collect()}
    assert {k for k in got} == {(i, 1) for i in range(5)} | {(10, 1), (10, 2), (11, 1), (14, 1)}
    assert [got[i, 1].lang for i in range(5)] == list(TEXT) and all(got[i, 1].label_ok and not got[i, 1].mixed for i in range(5))
    assert got[10, 2].lang == "fr" and got[10, 1].mixed and got[11, 1].lang == "en" and not got[11, 1].label_ok
    assert all(0 < r.confidence <= 1 for r in got.values())
    assert identify(docs.limit(0)).count() == 0


def test_suffix(spark):
    rows = ["http://archivo.example.es/a?b", "user@diocese.org.pt", "example.co.uk:80/x", "localhost", "10.0.0.1", "", None]
    assert [r.x for r in spark.createDataFrame([(i, a) for i, a in enumerate(rows)], "i int, a string").orderBy("i").select(address_suffix(F.col("a")).alias("x")).collect()] == ["es", "pt", "uk", None, None, None, None]


def test_suffix_is_evidence_and_own_votes_are_not(spark):
    """A text that could be of two languages goes with its suffix; a lone document has no say in its own prior."""
    rows = [(i, TEXT["es"] if i % 2 else TEXT["pt"], None, "s", 1, "es" if i % 2 else "pt") for i in range(200)]
    rows += [(1000, "1742 1743", None, "s", 1, "es"), (1001, "1742 1743", None, "s", 1, "pt"), (1002, TEXT["fr"], None, "t", 9, "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, volume_id bigint, place string")
    got = {r.doc_id: r for r in identify(docs, suffix="place").collect()}
    assert (got[1000].lang, got[1001].lang, got[1002].lang) == ("es", "pt", "fr")
    assert {r.doc_id: r.lang for r in identify(docs).collect()}[1002] == "fr"


def test_other_languages(spark):
    german = "Der Pfarrer dieser Kirche taufte heute ein Kind welches gestern hier geboren wurde und dessen Vater ein Bauer aus unserem Dorf war"
    rows = [(i, t, x, "s", 1) for i, (x, t) in enumerate(list(TEXT.items()) * 8)] + [(100, german, None, "s", 1), (101, f"{german}\n{TEXT['es']}", "es", "s", 1)]
    got = {(r.doc_id, r.par_no): r for r in identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, volume_id bigint")).collect()}
    assert got[100, 1].lang == OTHER and got[100, 1].confidence <= 0.2 and got[100, 1].doc_lang == OTHER
    assert (got[101, 1].lang, got[101, 2].lang) == (OTHER, "es") and got[101, 2].mixed
    assert all(got[i, 1].lang != OTHER for i in range(40))
