import random

import pytest

from libroflow.llm.canonical import ALIASES, Lexicon, _room, folded, map_terms, osa, plain

TERMS = {"titles": ["Don", "Doña", "Fray", "Presbítero", "Señora"], "occupation": ["Carpenter", "Cleric", "Mason", "Shoemaker", "Tailor"], "phenotype": ["moreno", "pardo", "blanco"], "ethnicity": ["Angola", "Popó", "Macuá", "Gallego"]}


@pytest.mark.parametrize("field, value, term", [
    ("titles", "DN.", "Don"), ("titles", "el señor don ", "Don"), ("titles", "D.ª", "Doña"), ("titles", "Presb.o (sic)", "Presbítero"), ("titles", "[roto]", ""), ("titles", "su majestad", ""), ("titles", "", ""),
    ("occupation", "padr ecura", "Cleric"), ("occupation", "maestro de albañilería", "Mason"), ("occupation", "sapatero", "Shoemaker"), ("occupation", "maestro sastre ?", "Tailor"), ("occupation", "hidalgo", ""), ("occupation", "preso en la cárcel", ""),
    ("phenotype", "mor.o", "moreno"), ("phenotype", "vlanco", "blanco"), ("phenotype", "pardo claro", "pardo"), ("phenotype", "casado", ""), ("phenotype", "s/c", ""),
    ("ethnicity", "de nación nagola", "Angola"), ("ethnicity", "naciónsmacuá", "Macuá"), ("ethnicity", "de Galicia", "Gallego"), ("ethnicity", "bozal", ""), ("ethnicity", "nación ignorada", ""),
])
def test_terms(field, value, term):
    assert Lexicon(TERMS[field], ALIASES[field]).term(value) == term


def test_longest_mention_wins():
    lex = Lexicon(["Cook", "Sea cook"], {})
    assert lex.term("an old sea cook") == "Sea cook" and lex.term("cook of the house") == "Cook"


def test_spelling():
    assert plain("D.ª  Íñigo (sic) [roto]") == "da inigo" and folded("quarterón".replace("ó", "o")) == folded("cuarteron")
    assert osa("angola", "nagola", 2) == 1 and osa("a", "abcd", 2) == 3


def test_map_terms(spark):
    rows = [(1, ["Don", "Dn.", None, "x"], None, "moreno", "angolla", "c"), (1, ["Don", "Dn.", None, "x"], None, "moreno", "angolla", "c"), (2, None, "CURA", None, None, "c"), (3, [], "", None, None, "c"), (None, ["Dn."], None, None, None, "c"), (4, ["y" * 20000], None, None, None, "c")]
    m = spark.createDataFrame(rows, "mention_key bigint, titles array<string>, occupation string, phenotype string, ethnicity string, term string")
    v = spark.createDataFrame([*TERMS.items(), ("other", None)], "vocab_key string, vocab array<string>")
    got = sorted(map(tuple, map_terms(m, v).collect()))
    assert got == [(1, "ethnicity", 1, "Angola"), (1, "titles", 2, "Don"), (1, "titles", 4, ""), (2, "occupation", 1, "Cleric"), (3, "occupation", 1, ""), (4, "titles", 1, "")]
    assert map_terms(m.limit(0), v).count() == 0
    assert map_terms(m, v.limit(0)).count() > 0


def test_aliases_from_a_table(spark):
    table = spark.createDataFrame([("occupation", "Mason", "cantero"), ("occupation", "Mason", "albañil"), ("occupation", None, "x"), ("titles", "Don", "dn")], "field string, term string, alias string")
    m = spark.createDataFrame([(1, ["Dn."], "canteros"), (2, None, "albanil de oficio"), (3, ["fr"], "sastre")], "mention_key bigint, titles array<string>, occupation string")
    v = spark.createDataFrame([("titles", TERMS["titles"]), ("occupation", TERMS["occupation"])], "vocab_key string, vocab array<string>")
    got = sorted(map(tuple, map_terms(m, v, ["titles", "occupation"], table).collect()))
    assert got == [(1, "occupation", 1, "Mason"), (1, "titles", 1, "Don"), (2, "occupation", 1, "Mason"), (3, "occupation", 1, ""), (3, "titles", 1, "")]


def test_long_lists_are_searched_by_index():
    """The index finds what holding a value against every name finds."""
    rng = random.Random(8)
    names = {"".join(rng.choice("abdelmnorst") for _ in range(rng.randint(3, 9))) for _ in range(400)}
    lex = Lexicon(sorted(names), {})
    for _ in range(300):
        v = list(rng.choice(sorted(names)))
        v[rng.randrange(len(v))] = rng.choice("abdelmnorst")
        v = "".join(v)
        want = {t: min(osa(v, t, 2), 9) for t in lex.near[0].tokens if osa(v, t, min(_room(len(v)), _room(len(t)))) <= min(_room(len(v)), _room(len(t)))}
        assert lex.near[0].edits({v}) == want


def test_misspellings_need_no_alias():
    """Recall on one random edit in terms and aliases of five letters or more, without any listed misspelling."""
    rng = random.Random(2)
    total = right = 0
    for field, terms in TERMS.items():
        lex = Lexicon(terms, ALIASES[field])
        for name, term in lex.names.items():
            if len(name) >= 5:
                for _ in range(10):
                    x = list(name)
                    i = rng.randrange(len(x))
                    x[i : i + 1] = rng.choice(([], [rng.choice("aeiorst")], [x[i], rng.choice("aeiorst")]))
                    total += 1
                    right += lex.term("".join(x)) == term
    assert right >= 0.95 * total
