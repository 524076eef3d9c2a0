"""Languages of documents and paragraphs by Bayesian evidence fusion.

A naive Bayes model over words (with word endings for unseen ones) is fitted on a bounded sample of labelled rows and
gives every paragraph's text likelihood. It is combined with the declared language (its reliability measured over
all documents), with the address suffix (how much more frequent a language is under it than elsewhere), and with
priors of the host: counts per source and volume, smoothed towards their source, which is smoothed towards the whole
corpus. All counts come from grouped aggregation over every document, and a document's own vote is taken out of
those it is judged by. A paragraph hardly any word of which is known is of an `other` language, with low confidence.

Parameters: SAMPLE labelled rows at most are read for the fit; everything else covers all rows.

Defined edge cases: rows without an id are left out; null, empty and blank texts have no paragraph and give no row; a null
source, volume or suffix is one of its own; a text with no letters at all takes its prior; a corpus without any usable
label takes the built-in function words alone; repeated rows come once; clashing extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libroflow.session import cut, small

LANGS = ["es", "pt", "en", "fr", "la"]
OTHER = "other"
SAMPLE = 3000
BYTES = 128 << 20  # of text in the sample, at most
ROUNDS = 2
STRENGTH = 20.0  # documents that the next wider prior counts for
KNOWN = 0.15  # a paragraph of LEAST words or more with a smaller share of known ones is of an other language
LEAST = 12
STAY = 0.9  # prior weight that a paragraph is in its document's language

# Names under which a language is declared, without accents and in lower case.
NAMES = {
    "es": ["es", "spa", "esp", "espanol", "espanhol", "espagnol", "castellano", "castelhano", "spanish", "hispanica"],
    "pt": ["pt", "por", "portugues", "portuguese", "portugais", "lusitana"],
    "en": ["en", "eng", "ingles", "english", "anglais", "anglica"],
    "fr": ["fr", "fra", "fre", "frances", "french", "francais", "gallica"],
    "la": ["la", "lat", "latin", "latim", "latina", "latine"],
}
# Function words with which the model starts.
SEEDS = {
    "es": "el la los las de del y que en por con para su se no fue sus años una lo al".split(),
    "pt": "o a os as do da dos das e que em por com para seu sua se nao foi aos uma ao no na".split(),
    "en": "the of and to in that was for with his her by on at from as is it be which".split(),
    "fr": "le la les de du des et que en par avec pour son sa se ne fut une au dans est".split(),
    "la": "et in est ad cum de ex qui quae quod ut anno die fuit eius per ego non ab huius".split(),
}


def _table() -> bytes:
    out = bytearray(b" " * 256)
    for i in range(256):
        base = unicodedata.normalize("NFKD", bytes([i]).decode("latin-1"))[0].lower()
        if base.isascii() and base.isalnum():
            out[i] = ord(base)
    return bytes(out)


TABLE = _table()


def words_of(text: str) -> list[bytes]:
    """Lower-case words without accents; one pass over bytes."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.encode("latin-1", "replace").translate(TABLE).split()


def paragraphs_of(text: str) -> list[str]:
    return [p for p in re.split(r"[\r\n]+", text) if p.strip()]


def declared(lang) -> F.Column:
    """The code a declared language stands for, null where it names none."""
    low = F.lower(F.trim(lang))
    plain = F.translate(low, "áàâãäéèêëíìîïóòôõöúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    head = F.regexp_extract(plain, r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(head.isin(names), code).otherwise(out)
    return out


class Model:
    """Word and ending log-likelihoods per language."""

    def __init__(self, counts: list[Counter], alpha: float = 0.5):
        total = Counter()
        for c in counts:
            total.update(c)
        kept = [w for w, n in total.items() if n >= 2]
        ends = [Counter() for _ in counts]
        for e, c in zip(ends, counts):
            for w, n in c.items():
                e[w[-3:]] += n
        size = [sum(c.values()) + alpha * (len(total) + 1) for c in counts]
        rows = np.array([[np.log((c[w] + alpha) / s) for c, s in zip(counts, size)] for w in kept] or np.zeros((0, len(counts))))
        tails = sorted({t for e in ends for t in e})
        tail_size = [sum(e.values()) + alpha * (len(tails) + 1) for e in ends]
        tail_rows = np.array([[np.log((e[t] + alpha) / s) for e, s in zip(ends, tail_size)] for t in tails] or np.zeros((0, len(counts))))
        center = lambda m: m - m.max(axis=1, keepdims=True) if len(m) else m
        self.matrix = np.concatenate([np.zeros((1, len(counts))), np.maximum(center(rows), -6.0), np.maximum(center(tail_rows), -3.0) * 0.5])
        self.word = {w: i for i, w in enumerate(kept, 1)}
        self.tail = {t: i for i, t in enumerate(tails, 1 + len(kept))}
        self.cache: dict[bytes, int] = {}

    def ids(self, words: list[bytes]) -> list[int]:
        known, cache, tail = self.word, self.cache, self.tail
        if len(cache) > 500_000:
            cache.clear()
        out = []
        for w in words:
            i = known.get(w)
            if i is None:
                i = cache.get(w)
                if i is None:
                    i = cache[w] = 0 if w.isdigit() else tail.get(w[-3:], 0)
            out.append(i)
        return out

    def scores(self, groups: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """One row of log-likelihoods per group of words, and whether hardly any word of the group is known."""
        sizes = np.array([len(g) for g in groups])
        flat = np.array(self.ids([w for g in groups for w in g]), dtype=np.int64)
        out, known = np.zeros((len(groups), self.matrix.shape[1])), np.zeros(len(groups))
        if len(flat):
            full, starts = self._starts(sizes)
            out[full] = np.add.reduceat(self.matrix[flat], starts, axis=0)
            known[full] = np.add.reduceat(((flat > 0) & (flat <= len(self.word))).astype(np.float64), starts)
        return out, (sizes >= LEAST) & (known < KNOWN * sizes)

    def likelihoods(self, groups: list[list[bytes]]) -> np.ndarray:
        return self.scores(groups)[0]

    @staticmethod
    def _starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = sizes > 0
        return full, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, declared code). Paragraphs are re-assigned by the model before each further round, as declared
    languages may be wrong and texts mixed."""
    counts = [Counter({w.encode("latin-1", "replace").translate(TABLE): 20 for w in SEEDS[x]}) for x in LANGS]
    pars = [(words_of(p), LANGS.index(code)) for text, code in rows for p in paragraphs_of(text)]
    for w, k in pars:
        counts[k].update(w)
    model = Model(counts)
    for _ in range(ROUNDS if pars else 0):
        best = model.likelihoods([w for w, _ in pars]).argmax(axis=1)
        counts = [Counter({w.encode("latin-1", "replace").translate(TABLE): 1 for w in SEEDS[x]}) for x in LANGS]
        for (w, _), k in zip(pars, best):
            counts[k].update(w)
        model = Model(counts)
    return model


def fit_on(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows, chosen by a hash of the id."""
    labelled = docs.select("doc_id", "text", declared(F.col("lang")).alias("code")).filter(F.col("code").isNotNull() & F.col("text").isNotNull())
    # the ids are chosen before any text is gathered
    chosen = labelled.select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id").alias("h")).orderBy("h", "_id").limit(sample)
    rows = small(labelled.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi").select("text", "code"), 2 * sample, BYTES)
    if rows is None:  # very long texts: fewer of them say as much
        return fit_on(docs, sample // 2)
    return fit([(r[0], r[1]) for r in rows])


def _score(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("volume_id", pa.int64()), ("suffix", pa.string()), ("code", pa.int32()), ("chars", pa.list_(pa.int64())), ("ll", pa.list_(pa.float64())), ("top", pa.int32()), ("foreign", pa.list_(pa.bool_()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            heads = [b.column(i).to_pylist() for i in range(5)]
            docs, groups, chars = [], [], []
            for k, text in enumerate(b.column(5)):
                pars = paragraphs_of(text.as_py() or "")
                if pars:
                    docs.append((k, len(pars)))
                    chars.append([len(p) for p in pars])
                    groups += [words_of(p) for p in pars]
            if not docs:
                continue
            ll, odd = model.scores(groups)
            at, out_ll, top, out_odd = 0, [], [], []
            for _, n in docs:
                part = ll[at : at + n]
                out_odd.append(odd[at : at + n])
                at += n
                out_ll.append(part.ravel())
                top.append(int(part.sum(axis=0).argmax()))
            keep = [k for k, _ in docs]
            cols = [[h[k] for k in keep] for h in heads] + [chars, out_ll, top, out_odd]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    return run


def host_counts(scored: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray, float]:
    """Votes for each language per (source, volume) beside those of its source, and per suffix; the corpus' votes; how often
    a declared code is right."""
    n = len(LANGS)
    votes = [F.sum((F.col("top") == i).cast("double")).alias(f"n{i}") for i in range(n)]
    row = scored.agg(*votes, F.sum(((F.col("code") == F.col("top")) & (F.col("code") >= 0)).cast("double")), F.sum((F.col("code") >= 0).cast("double"))).first()
    corpus = np.array([row[i] or 0.0 for i in range(n)])
    reliable = ((row[n] or 0.0) + 8) / ((row[n + 1] or 0.0) + 10)
    cells = scored.groupBy("source", "volume_id").agg(*votes)
    hosts = cells.groupBy(F.col("source").alias("_source")).agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(n)])
    both = cells.join(hosts, F.col("source").eqNullSafe(F.col("_source")))
    hosted = both.select(F.col("source").alias("h_source"), F.col("volume_id").alias("h_volume"), F.array(*[f"n{i}" for i in range(n)]).alias("cell"), F.array(*[f"s{i}" for i in range(n)]).alias("host"))
    suffixes = scored.groupBy(F.col("suffix").alias("x_suffix")).agg(*votes).select("x_suffix", F.array(*[f"n{i}" for i in range(n)]).alias("under"))
    return hosted, suffixes, corpus, reliable


def _fuse(reliable: float, corpus: np.ndarray, suffixed: bool):
    n = len(LANGS)
    schema = pa.schema([("doc_id", pa.int64()), ("par_no", pa.int32()), ("chars", pa.int64()), ("lang", pa.string()), ("confidence", pa.float64()), ("doc_lang", pa.string()), ("doc_confidence", pa.float64()), ("mixed", pa.bool_()), ("label_ok", pa.bool_())])

    def softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for doc, code, chars, ll, top, odd, *votes in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "code", "chars", "ll", "top", "foreign", "cell", "host", "under")]):
                ll = np.array(ll).reshape(-1, n)
                own = np.arange(n) == top
                cell, host, under, every = (np.maximum(np.array(x) - own, 0.0) for x in (*votes, corpus))  # without this text's own vote
                share = (every + 1) / (every.sum() + n)
                prior = (host + STRENGTH * share) / (host.sum() + STRENGTH)
                prior = (cell + STRENGTH * prior) / (cell.sum() + STRENGTH)
                lift = (under + STRENGTH * share) / (under.sum() + STRENGTH) / share
                base = np.log(prior) + (np.log(lift) if suffixed else 0.0)
                if code >= 0:
                    said = np.full(n, np.log((1 - reliable) / (n - 1)))
                    said[code] = np.log(reliable)
                    base = base + said
                whole = softmax(base + ll.sum(axis=0))
                pars = softmax(np.log(STAY * whole + (1 - STAY) / n) + ll)
                best = pars.argmax(axis=1)
                weight = np.bincount(best, weights=chars, minlength=n)
                main = int(weight.argmax())
                share = float((pars[:, main] * np.array(chars)).sum() / max(1, sum(chars)))
                mixed = len(set(best.tolist())) > 1
                strange = sum(c for c, x in zip(chars, odd) if x) * 2 > sum(chars)
                for i, k in enumerate(best):
                    # what is known of an other language is only that it is none of these
                    lang, sure = (OTHER, float(pars[i, k]) / n) if odd[i] else (LANGS[k], float(pars[i, k]))
                    out.append((doc, i + 1, chars[i], lang, sure, OTHER if strange else LANGS[main], share / n if strange else share, mixed or any(odd) and not all(odd), code == main and not strange))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def address_suffix(address: F.Column) -> F.Column:
    """The last label of the host of an address, null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(address)), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})\.?$", 1), F.lit(""))


def identify(docs: DataFrame, sample: int = SAMPLE, suffix: str | None = None) -> DataFrame:
    """One row per non-blank paragraph: language and confidence, with those of its document, whether the document
    mixes languages, and whether the declared language is the document's.

    suffix: a column with the address suffix (`address_suffix`), or what else tells where a document is from.
    """
    docs = docs.filter(F.col("doc_id").isNotNull())
    model = fit_on(docs, sample)
    index = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LANGS]), declared(F.col("lang"))) - 1, F.lit(-1)).cast("int")
    told = F.col(suffix).cast("string") if suffix else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint"), "source", F.col("volume_id").cast("bigint"), told.alias("suffix"), F.when(declared(F.col("lang")).isNull(), -1).otherwise(index).alias("code"), "text")
    scored = cut(rows.mapInArrow(_score(model), "doc_id bigint, source string, volume_id bigint, suffix string, code int, chars array<bigint>, ll array<double>, top int, foreign array<boolean>"))
    hosts, suffixes, corpus, reliable = host_counts(scored)
    bound = lambda df, *keys: F.broadcast(df) if small(df.select(*keys), 200_000) is not None else df
    fed = scored.join(bound(hosts, "h_source", "h_volume"), F.col("source").eqNullSafe(F.col("h_source")) & F.col("volume_id").eqNullSafe(F.col("h_volume")))
    fed = fed.join(bound(suffixes, "x_suffix"), F.col("suffix").eqNullSafe(F.col("x_suffix"))) if suffix else fed.withColumn("under", F.array(*[F.lit(0.0)] * len(LANGS)))
    fed = fed.select("doc_id", "code", "chars", "ll", "top", "foreign", "cell", "host", "under")
    return fed.mapInArrow(_fuse(reliable, corpus, suffix is not None), "doc_id bigint, par_no int, chars bigint, lang string, confidence double, doc_lang string, doc_confidence double, mixed boolean, label_ok boolean")
