"""Mapping of free-entered values to the terms of a controlled list.

A multi-pattern automaton over the terms and their aliases finds embedded mentions in the value (whole words, longest
non-overlapping match wins, the leftmost among equals); it runs over the plain spelling and again over a spelling
folded by the period's interchangeable letters. Values without a mention go to token-set similarity: every token of an
alias must have a nearly equal token in the value. What remains stands for no term.

Defined edge cases: null values give no row; an empty or blank value stands for no term; a value equal to a term letter
for letter is not reported; a field without a list has no terms; repeated rows come once; very long values are
searched whole; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libroflow.session import bounded

# Other names of terms (other languages, genders, short forms), without accents and in lower case, dots and
# marks left out. Misspellings are left to the similarity.
ALIASES = {
    "titles": {
        "Don": "d, dn, dom, senor don",
        "Doña": "da, dona, senora dona",
        "Fray": "fr, frai, frey, frei",
        "Licenciado": "lic, ldo, licdo, lcdo",
        "Bachiller": "br, bachr, bchr, bach",
        "Presbítero": "pbro, presb, presbo, pro",
        "Maestro": "mro, mtro, maesse, maese, mestre",
        "Señora": "sra, sora, senhora",
        "Monseñor": "mons, monsr, monsenhor",
        "Hermano": "hno, hermo, irmao",
        "Reverendo": "rev, rdo, revdo",
        "Marqués": "marqs, mqs",
    },
    "ethnicity": {
        "Angola": "angolo",
        "Benguela": "",
        "Macuá": "",
        "Popó": "",
        "Songo": "",
        "Canario": "canaria, canarias, canro",
        "Gallego": "gallega, galicia, gayego, galego",
        "Genovés": "genovesa, genova, ginoves",
        "Irlandés": "irlandesa, irlanda, irish",
        "Vizcaíno": "vizcaina, vizcaya",
    },
    "phenotype": {
        "moreno": "morena, morenos, morenas, moro",
        "pardo": "parda, pardos, pardas, pdo, pda",
        "blanco": "blanca, blancos, blancas, blco, blca, branco, branca",
        "indio": "india, indios, indias, ynda, yndo",
        "mestizo": "mestiza, mestizos, mestizas",
        "zambo": "zamba, zambos, zambas",
        "trigueño": "triguena, triguenos, triguenas",
        "cuarterón": "cuarterona, cuarterones, cuartn",
        "negro": "negra, negros, negras, preto, preta",
    },
    "occupation": {
        "Carpenter": "carpintero, carpinteiro, carpinto, carpintera",
        "Mason": "albanil, albanileria, pedreiro, cantero",
        "Midwife": "partera, parteira, comadrona",
        "Tailor": "sastre, alfaiate, sastra",
        "Blacksmith": "herrero, ferreiro",
        "Notary": "notario, escribano, essno, esno, tabeliao, escrivao",
        "Sailor": "marinero, marinheiro, marino, hombre de mar, mariner",
        "Soldier": "soldado",
        "Cook": "cocinero, cocinera, cozinheira, cozinheiro",
        "Laundress": "lavandera, lavadeira, washerwoman",
        "Shoemaker": "zapatero, sapateiro, zapatera",
        "Merchant": "comerciante, mercader, mercador, tratante",
        "Farmer": "labrador, labradora, lavrador, agricultor",
        "Sacristan": "sacristan, sacristao",
        "Baker": "panadero, panadera, padeiro",
        "Cleric": "clerigo, cura, sacerdote, padre, padre cura, priest, presbitero",
        "Musician": "musico, organista",
        "Cooper": "tonelero, tanoeiro, barrel maker",
    },
}

MOST_ALIASES = 200_000
FIELDS = ["titles", "occupation", "phenotype", "ethnicity"]


def plain(value: str) -> str:
    """Lower case without accents; editors' marks gone, inner dots closed up, other marks to spaces."""
    t = unicodedata.normalize("NFKD", value.replace("ª", ".a").replace("º", ".o")).lower()
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = re.sub(r"\(\s*s[ic]{1,2}c?\s*\)|\[\s*sic\s*\]", " ", t)
    t = re.sub(r"\[[^\]]*\]", " ", t)
    t = re.sub(r"(?<=[a-z])[.']+(?=[a-z])", "", t)
    return " ".join(re.sub(r"[^a-z0-9]+", " ", t).split())


_FOLDS = [("ph", "f"), ("gue", "je"), ("gui", "ji"), ("y", "i"), ("h", ""), ("qua", "kua"), ("quo", "kuo"), ("qu", "k"), ("ce", "se"), ("ci", "si"), ("ge", "je"), ("gi", "ji"), ("c", "k"), ("z", "s"), ("v", "b")]


def folded(text: str) -> str:
    """One spelling for the letters that old hands exchange (b/v, s/z/c, i/y, c/qu/k, h, doubled letters)."""
    for a, b in _FOLDS:
        text = text.replace(a, b)
    return re.sub(r"([a-z])\1+", r"\1", text)


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with neighbour transpositions, most + 1 when beyond."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2, prev = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, prev2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return prev[-1]


def _room(n: int) -> int:
    return 0 if n <= 2 else 1 if n <= 6 else 2


FAR = 99


def _letters(text: str) -> int:
    """The set of a text's letters, as bits; an edit changes at most two members."""
    out = 0
    for c in text:
        out |= 1 << (ord(c) & 63)
    return out


class _Tokens:
    """The tokens of a list of names, and the names closed up: an index by letters and length for those nearly equal to a
    given token, so that a value is held against a few names of a long list."""

    def __init__(self, names: dict[str, str]):
        held: dict[str, set[str]] = {}
        for name in names:
            for t in (*name.split(), name.replace(" ", "")):
                held.setdefault(t, set()).add(name)
        self.tokens, self.held = list(held), held
        self.letters = np.array([_letters(t) for t in self.tokens], np.uint64)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.rooms = np.array([_room(len(t)) for t in self.tokens], np.int64)

    def edits(self, values: set[str]) -> dict[str, int]:
        """Token -> edits to the nearest of the values that may still be the same word."""
        out: dict[str, int] = {}
        for v in values:
            room = np.minimum(self.rooms, _room(len(v)))
            close = np.flatnonzero((np.bitwise_count(self.letters ^ np.uint64(_letters(v))) <= 2 * room) & (np.abs(self.sizes - len(v)) <= room))
            for i in close.tolist():
                t = self.tokens[i]
                most = min(int(room[i]), out.get(t, FAR) - 1)
                if most >= 0 and (d := osa(v, t, most)) <= most:
                    out[t] = d
        return out

    def aliases(self, edits: dict[str, int]) -> set[str]:
        return {a for t in edits for a in self.held[t]}


class Lexicon:
    """Automata and token index of one field."""

    def __init__(self, terms: list[str], aliases: dict[str, str]):
        import ahocorasick

        names: dict[str, str] = {}
        for t in terms:
            names.setdefault(plain(t), t)
        for t, text in aliases.items():
            if t in terms:
                for a in text.split(","):
                    names.setdefault(plain(a), t)
        self.names = {a: t for a, t in names.items() if a}
        self.folds: dict[str, str] = {}
        for a, t in self.names.items():
            if len(f := folded(a)) >= 4:
                self.folds.setdefault(f, t)
        self.exact, self.loose = ahocorasick.Automaton(), ahocorasick.Automaton()
        for auto, words in ((self.exact, self.names), (self.loose, self.folds)):
            for w in words:
                auto.add_word(f" {w} ", w)
            if words:
                auto.make_automaton()
        self.near = tuple(_Tokens(names) for names in (self.names, self.folds))
        self.cache: dict[str, str] = {}

    @staticmethod
    def mentions(auto, text: str) -> list[str]:
        """Non-overlapping mentions, longest first, the leftmost among equals."""
        if not len(auto):
            return []
        found = sorted(((end - len(w) - 1, end, w) for end, w in auto.iter(f" {text} ")), key=lambda x: (x[0] - x[1], x[0]))
        taken: list[tuple[int, int, str]] = []
        for a, b, w in found:
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, w))
        return [w for _, _, w in taken]

    def similar(self, text: str) -> str:
        """The term of the alias whose every token is nearly in the value, also when spaces were lost or moved."""
        tokens = text.split()
        grams = set(tokens) | {"".join(tokens)} | {a + b for a, b in zip(tokens, tokens[1:])}
        best = None
        for names, index, wide in ((self.names, self.near[0], False), (self.folds, self.near[1], True)):
            edits = index.edits({folded(x) for x in grams} if wide else grams)
            for alias in index.aliases(edits):
                parts, whole = alias.split(), alias.replace(" ", "")
                cost = min(sum(edits.get(part, FAR) for part in (parts if len(tokens) >= len(parts) else [whole])), edits.get(whole, FAR))
                if cost < FAR:
                    rank = (cost + wide * 0.5, -len(whole), alias)
                    if best is None or rank < best[0]:
                        best = (rank, names[alias])
        return best[1] if best else ""

    def inside(self, text: str) -> str:
        """A term glued to its neighbour, the space lost or misread as a letter (`nacionsmacua`): the longest name
        of four letters or more at either end of a token."""
        hits = []
        for t in text.split():
            for i in range(1, len(t)):
                hits += [x for x in (t[:i], t[i:]) if len(x) >= 4 and x in self.names]
        return self.names[max(hits, key=lambda x: (len(x), x))] if hits else ""

    def term(self, value: str) -> str:
        out = self.cache.get(value)
        if out is None:
            text = plain(value)
            if not text:
                out = ""
            elif hit := self.mentions(self.exact, text):
                out = self.names[hit[0]]
            elif hit := self.mentions(self.loose, folded(text)):
                out = self.folds[hit[0]]
            else:
                out = self.similar(text) or self.inside(text)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[value] = out
        return out


def alias_table(aliases: DataFrame) -> dict[str, dict[str, str]]:
    """Aliases from a table (field, term, alias), in the form of ALIASES."""
    out: dict[str, dict[str, str]] = {}
    for field, term, alias in bounded(aliases.select("field", "term", "alias").filter("field is not null and term is not null and alias is not null").distinct(), "aliases", MOST_ALIASES):
        terms = out.setdefault(field, {})
        terms[term] = f"{terms[term]}, {alias}" if term in terms else alias
    return out


def map_terms(mentions: DataFrame, vocabulary: DataFrame, fields: list[str] = FIELDS, aliases: dict | DataFrame = ALIASES) -> DataFrame:
    """(mention_key, field, pos, term) of every value that is not a term letter for letter; term is '' if none fits.

    aliases: field -> term -> names parted by commas, or a table (field, term, alias).
    """
    if isinstance(aliases, DataFrame):
        aliases = alias_table(aliases)
    rows = bounded(vocabulary.filter(F.col("vocab_key").isin(fields)).select("vocab_key", F.to_json(F.coalesce("vocab", F.array().cast("array<string>"))).alias("terms")), "lists of terms", 10_000)
    import json

    terms: dict[str, list[str]] = {f: [] for f in fields}
    for key, text in rows:
        terms[key] += [t for t in json.loads(text) if t]
    types = dict(mentions.dtypes)

    def unknown(f: str) -> F.Column:
        """The field's values that are no term, with their places."""
        own = F.transform(F.col(f), lambda x, i: F.struct((i + 1).cast("int").alias("pos"), x.alias("value"))) if types[f].startswith("array") else F.array(F.struct(F.lit(1).alias("pos"), F.col(f).alias("value")))
        known = F.array(*[F.lit(t) for t in terms[f]]) if terms[f] else F.array().cast("array<string>")
        kept = F.filter(own, lambda x: x["value"].isNotNull() & ~F.array_contains(known, x["value"]))
        return F.transform(kept, lambda x: F.struct(F.lit(f).alias("field"), x["pos"].alias("pos"), x["value"].alias("value")))

    parts = [unknown(f) for f in fields]
    none = F.array().cast("array<struct<field: string, pos: int, value: string>>")
    values = mentions.filter(F.col("mention_key").isNotNull()).select(F.col("mention_key").cast("bigint").alias("mention_key"), F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("x")).select("mention_key", "x.field", "x.pos", "x.value")
    schema = pa.schema([("mention_key", pa.int64()), ("field", pa.string()), ("pos", pa.int32()), ("term", pa.string())])
    wanted = {f: aliases.get(f, {}) for f in fields}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = {f: Lexicon(terms[f], wanted[f]) for f in terms}
        for b in it:
            found = [lexicons[f].term(v) for f, v in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.string())], schema=schema)

    return values.mapInArrow(run, "mention_key bigint, field string, pos int, term string").distinct()
