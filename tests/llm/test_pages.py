from libroflow.llm.pages import Page, Speller, heads, is_head, is_page, line_kinds, repaired

COUNTS = {w: 500 for w in "iglesia parroquial de la bauticé solemnemente vecinos licencia nombre verdad cuaderno en el quedó anotado y los santos óleos feligreses esta partida".split()} | {"Macadilla": 50, "Pedro": 80}
HEADS = heads("Libro 16 de Bautismos, 1686-1706", "Parroquia de San Onofre de Dorasende", "Dorasende")


def page(raw, wanted=HEADS):
    return Page(raw, wanted, Speller(COUNTS))


def test_heads_and_numbers():
    for line in ("LIBRO 16 DE BAUTISMOS", "Libro 16 de Bautismos — Dorasende 204", "Bautcsmos de Dorasende", "Parroquia de San Onofre de Dorasende. Bautismos 7"):
        assert is_head(line, HEADS), line
    assert not is_head("iglesia parroquial de Dorasende", HEADS) and not is_head("Dorasende, uno de abril", HEADS)
    for line in ("46", "[192]", "f. 267", "ccxii", "- 147 -", "fol. 172 v.", "Fo 128 vta", "Pág. 9", "99."):
        assert is_page(line, "texto"), line
    for line in ("36.", "mil", "vale.", "folha 54.", "1742 años", ""):
        assert not is_page(line, "anotado en el cuaderno"), line


def test_kinds():
    p = page("en la igle\nLIBRO 16 DE BAUTISMOS\nsia parroquial de Maca-\n\n46\ndilla, bauticé\nlos sant0s veciiios de verclad,\ny anotado en el cuaderno\n36.")
    assert sorted(p.found) == [(1, "break"), (2, "header"), (3, "break"), (5, "page_no"), (7, "misread")]
    assert " ".join(p.paragraphs()) == "en la iglesia parroquial de Macadilla, bauticé los santos vecinos de verdad, y anotado en el cuaderno 36."


def test_splits_and_merges():
    """Words run together and words in many pieces, over spaces, line ends and hyphens, with misread letters in them."""
    text = lambda raw: " ".join(page(raw).paragraphs())
    assert text("en dela iglesia ylos santos") == "en de la iglesia y los santos"
    assert text("en la igle si a y los santos") == "en la iglesia y los santos"
    assert text("los ve ci nos de verdad") == "los vecinos de verdad"
    assert text("en la igle\nsi a y los") == "en la iglesia y los" and page("en la igle\nsi a y los").found == {(1, "break")}
    assert text("en la so-\nlem-\nnemente") == "en la solemnemente" and page("en la so-\nlem-\nnemente").found == {(1, "break"), (2, "break")}
    assert text("en la igle\nsiay los santos") == "en la iglesia y los santos"
    p = page("en de|a igle\ns!a ylos")
    assert " ".join(p.paragraphs()) == "en de la iglesia y los" and p.found == {(1, "misread"), (1, "break"), (2, "misread")}
    assert text("en Pedrode Macadilla") == "en Pedro de Macadilla"
    assert text("un zapatero") == "un zapatero"


def test_many_confusions():
    """No number of confusions in a word is too many."""
    s = Speller(COUNTS | {"sollicitassent": 40})
    assert s.read("5o||!(!†@55€n†")[1:3] == ("sollicitassent", (0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13))


def test_misread_over_a_break():
    assert (1, "break") in page("de la igle=\nsia parroquial").found
    assert not page("de la iglesia -").found


def test_paragraphs():
    p = page("en la iglesia parroquial de Macadilla quedó\nanotado.\n\nEn el nombre de Pedro quedó anotado en la\npartida.")
    assert len(p.paragraphs()) == 2


def test_tables(spark):
    e = spark.createDataFrame([(1, 5, "de la igle-\nsia y los santos", "c"), (1, 5, "de la igle-\nsia y los santos", "c"), (2, None, "46", "c"), (3, 5, "", "c"), (4, 5, None, "c"), (None, 5, "x", "c")], "entry_key bigint, volume_id bigint, raw string, kind string")
    v = spark.createDataFrame([(5, "Libro 1 de Bautismos, 1", "Parroquia de X", "X")], "volume_id bigint, title string, institution string, city string")
    assert sorted(map(tuple, line_kinds(e, v).collect())) == [(1, 1, "break"), (2, 1, "page_no")]
    assert {r.entry_key: r.text for r in repaired(e, v).collect()} == {1: "de la iglesia y los santos"}
    assert line_kinds(e.limit(0), v).count() == 0
