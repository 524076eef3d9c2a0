"""Repair of text from scanned pages.

Running heads (matched with the volume's title, institution and place) and page numbers are set aside. The remaining
lines are one character stream, over which word segmentation is decoded jointly by dynamic programming: a word may
run over any number of breaks in the stream (hyphens at line ends are cheap, plain line ends cost a little, spaces
more), a token may be split where no break stands, and letters may be read through the scanner's confusions, each at
a cost beside that of the word in a model counted over the whole corpus. Paragraph boundaries are chosen by dynamic
programming over the lines' lengths, endings and gaps.

The stream is decoded in islands: a space between two known words is final unless a token that is no word stands
there, so what lies between such spaces is decoded by itself, and islands that recur are decoded once.

The word model counts the tokens inside lines only, where words are whole, and keeps those above a share of all tokens.

Defined edge cases: null and empty texts have no lines; blank lines are counted but are of no kind; an entry whose volume
is unknown has no running heads; repeated rows come once; very long texts are decoded whole; a hyphen on the last
text line is no break; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libroflow.llm.canonical import osa
from libroflow.session import bounded, cut, small

SHARE = 2e-6  # a word is known from this share of all tokens on: 500,000 words at most
LONGEST = 40  # a token of more letters is no word
SPLIT = 3.0  # cost of a word boundary where no break stands
JOIN = {"hyphen": -5.0, "line": 2.0, "space": 6.0}  # cost of a break inside a word
ALONE = 40.0  # cost of a word that ends at a hyphen
SHORTEST = 3  # known words of so many letters may be pieces of their neighbours
RATIO = 10  # a reading through a confusion must be so much more frequent than the token as it stands

# What the scanner makes of a letter.
CONFUSIONS = [("€", "e"), ("†", "t"), ("@", "a"), ("ſ", "s"), ("·", ""), ("!", "i"), ("!", "l"), ("(", "c"), ("0", "o"), ("5", "s"), ("1", "l"), ("1", "i"), ("|", "l"), ("\\/", "v"), ("9", "g"), ("6", "b"), ("8", "b"), ("ii", "n"), ("ii", "u"), ("cl", "d"), ("rn", "m"), ("li", "h"), ("vv", "w"), ("iii", "m")]
SIGNS = set("€†@ſ·|\\")
_BAD: dict[str, list[tuple[str, str]]] = {}
for _b, _g in CONFUSIONS:
    _BAD.setdefault(_b[0], []).append((_b, _g))
HYPHENS = "-=¬–"
# Words that a number follows in running text.
NUMBERED = {"cuaderno", "caderno", "número", "numero", "folha", "folio", "libro", "livro", "n", "núm", "num"}

_PAGE = re.compile(r"^\W*(?:(?:f|ff|fo|fol|folio|folios|p|pp|pg|pág|pag|página|pagina|fls?|folha)\W*)?(?:\d{1,4}\s*(?:[rv]|vt[ao]|vuelt[ao]|verso|recto|bis)?|m{0,3}(?:cm|cd|d?c{0,3})(?:x?c|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\W*$", re.I)
_EDGE = " .,;:()[]{}\"'«»—?"


class _Bare(dict):
    """Each character as its lower-case letters and digits without accents; filled as characters come."""

    def __missing__(self, code: int) -> str:
        out = self[code] = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if c.isalnum())
        return out


_BARE = _Bare()


def bare(text: str) -> str:
    """Letters and digits only, lower case, no accents."""
    return text.translate(_BARE)


def heads(title: str | None, institution: str | None, city: str | None) -> list[str]:
    """The running heads a volume can have."""
    name = (title or "").split(",")[0].strip()
    kind = name.split()[-1] if name else ""
    out = [name, f"{name}{city}" if name and city else "", f"{kind} de {city}" if kind and city else "", f"{institution}{kind}" if institution and kind else ""]
    return [b for x in out if len(b := bare(x)) >= 8]


@lru_cache(10_000)
def _parts(head: str, most: int) -> list[str]:
    """A head in so many parts that `most` edits leave one of them whole; exchanged neighbours may touch two."""
    n = 2 * most + 1
    return [p for i in range(n) if (p := head[len(head) * i // n : len(head) * (i + 1) // n])]


def is_head(line: str, wanted: list[str]) -> bool:
    b = bare(line)
    if len(b) < 7:
        return False
    short = re.sub(r"\d{1,4}$", "", b)
    for form in (b, short) if short != b else (b,):
        for h in wanted:
            most = 1 if len(h) < 14 else 2
            if form == h or abs(len(form) - len(h)) <= most and any(p in form for p in _parts(h, most)) and osa(form, h, most) <= most:
                return True
    return False


def is_page(line: str, before: str) -> bool:
    """before: the text line above."""
    t = line.strip()
    if not t or len(t) > 18 or not re.search(r"[0-9ivxlcdm]", t, re.I) or not _PAGE.match(t) or not re.search(r"\w", t):
        return False
    if not re.search(r"\d", t) and not re.sub(r"\W", "", t).islower():
        return False
    if re.fullmatch(r"(?:folha|folio)?\s*\d+[.,]", t):  # a sentence's end may look like a page number
        last = before.strip().split()[-1].lower().strip(_EDGE) if before.strip() else ""
        if last in NUMBERED or t.startswith("folha") or len(last) > 5 and any(len(w) > 5 and osa(bare(last), bare(w), 2) <= 2 for w in NUMBERED):
            return False
    return True


def core(token: str) -> str:
    return token.strip(_EDGE)


def _count_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in it:
        for t in b.column(0).to_pylist():
            for line in t.split("\n"):
                for w in line.split()[1:-1]:
                    w = w.strip(_EDGE)
                    if w and len(w) <= LONGEST and w[0].isalpha():
                        counts[w if w.islower() else w[0] + w[1:].lower()] += 1
        if len(counts) > 300_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts = Counter()
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def word_counts(texts: DataFrame, text: str, share: float = SHARE) -> dict[str, int]:
    """Words of the corpus above `share` of all tokens (and at least 3 times): at most 1/share of them."""
    counts = cut(texts.select(text).filter(F.col(text).isNotNull()).mapInArrow(_count_rows, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = bounded(counts.filter(F.col("n") >= max(3, total * share)), "words", int(1 / share) + 1, 256 << 20)
    return {w: n for w, n in rows}


class Speller:
    """Costs of tokens, and their reading through confusions."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = sum(counts.values()) or 1
        self.words = sorted({w.lower() for w in counts})
        self.cache: dict[str, tuple[float, str, tuple[int, ...], bool]] = {}
        self.islands: dict[tuple, list] = {}
        self.tokens: dict[str, tuple[bool, str, bool]] = {}

    def begins(self, prefix: str) -> bool:
        """Whether a known word begins so."""
        at = bisect_left(self.words, prefix)
        return at < len(self.words) and self.words[at].startswith(prefix)

    def count(self, word: str) -> int:
        return max(self.counts.get(word, 0), self.counts.get(word[:1].upper() + word[1:], 0))

    def readings(self, w: str) -> dict[str, tuple[int, ...]]:
        """Known words that w is through any number of confusions: word -> places in w of the misread letters, the
        fewest. A walk over w that goes on while known words begin with what was read."""
        out: dict[str, tuple[int, ...]] = {}
        stack: list[tuple[int, str, tuple[int, ...]]] = [(0, "", ())]
        while stack:
            at, built, places = stack.pop()
            if at == len(w):
                if places and built != w and self.count(built) and (built not in out or len(places) < len(out[built])):
                    out[built] = places
                continue
            for bad, good in _BAD.get(w[at], ()):
                if w.startswith(bad, at) and self.begins(built + good):
                    stack.append((at + len(bad), built + good, (*places, at)))
            if self.begins(built + w[at]):
                stack.append((at + 1, built + w[at], places))
        return out

    def read(self, token: str) -> tuple[float, str, tuple[int, ...], bool]:
        """(cost, reading, places of misread letters, whether the reading is a known word) of a token without outer marks."""
        hit = self.cache.get(token)
        if hit is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            cost, reading, places = self._read(token)
            known = reading in self.counts or reading.lower() in self.counts or (reading[:1] + reading[1:].lower()) in self.counts
            hit = self.cache[token] = (cost, reading, places, known)
        return hit

    def _read(self, token: str) -> tuple[float, str, tuple[int, ...]]:
        if len(token) > LONGEST or not any(c.isalpha() for c in token):
            return 4.0 + 0.6 * max(0, len(token) - LONGEST), token, ()
        lower = token[0].islower() or not token[0].isalpha()
        key = token.lower() if lower else token[0] + token[1:].lower()
        mine = self.counts.get(key, 0)
        if not lower:
            mine = max(mine, self.counts.get(key.lower(), 0))
        best = None
        signed = any(c in SIGNS for c in token)
        if lower or signed or any(c in "0!(1569" for c in token[1:]):
            if not re.fullmatch(r"\d+(?:bre|o|a|os|as|ro|to|no)\W*", key):
                for y, places in self.readings(key.lower()).items():
                    n = self.count(y)
                    if n >= 3 and n >= RATIO * max(mine, 1 if signed else 0) and (n >= 20 or not mine):
                        rank = (len(places), -n, y)
                        if best is None or rank < best[0]:
                            best = (rank, y, places)
        if best:
            return math.log(self.total / -best[0][1]) + 3.0 * len(best[2]), best[1], best[2]
        if signed and lower:
            return 14.0, token, tuple(i for i, c in enumerate(token) if c in SIGNS)
        if mine:
            return math.log(self.total / mine), token, ()
        if "." in token:
            return 11.0, token, ()
        return (13.0 + 0.6 * len(token) if lower else 11.0 + 0.4 * len(token)), token, ()

    def token(self, token: str) -> tuple[bool, str, bool]:
        """(whether it is a word as it stands, its reading by itself with its outer marks, whether that undoes misreadings)."""
        hit = self.tokens.get(token)
        if hit is None:
            if len(self.tokens) > 300_000:
                self.tokens.clear()
            c = core(token)
            plain = c in self.counts or c.lower() in self.counts
            _, reading, places, _ = self.read(c)
            hit = self.tokens[token] = (plain, Page._dress(token, reading) if places else token, bool(places))
        return hit

    def piece(self, text: str, noisy: bool = True) -> tuple[float, str, tuple[int, ...]] | None:
        """The reading of a part of a token, None if it is no known word. Letters are read through confusions only where
        a sign or digit stands (`noisy`: one may)."""
        n = max(self.counts.get(text, 0), self.counts.get(text.lower(), 0))
        if n:
            return math.log(self.total / n), text, ()
        if noisy and any(c in SIGNS or c in "0!(1569" for c in text):
            cost, reading, places, known = self.read(text)
            if known and places:
                return cost, reading, places
        return None


def _mergeable(tok: str, nxt: str, joint: str) -> bool:
    """Whether a word may run over the break between two tokens."""
    if joint == "hyphen":
        return True
    if joint == "space" and not (tok[-1].isalpha() and (len(tok) > 1 or tok.islower())):
        return False
    return not (tok[-1] in ".,;:)" or nxt[:1].isupper() and not tok.isupper() or not nxt[:1].isalnum() and nxt[:1] not in SIGNS and nxt[:1] not in "!(")


def _run(first: str, last: str) -> str:
    """Two tokens as one, without outer marks."""
    return (first.lstrip(_EDGE.replace("(", "")) if first[:1] != "(" else first[1:]) + last.rstrip(_EDGE)


def decode(tokens: tuple[str, ...], joints: tuple[str, ...], tail: str, speller: Speller) -> list[tuple[str, int, int, list[int], list[int]]]:
    """Words of an island, (text, first token, last token, tokens with misread letters, tokens broken at a line end), by
    dynamic programming over its characters. joints: the breaks between its tokens, all of which a word may run over;
    tail: what follows the last one.
    """
    n = len(tokens)
    cores = [core(t) for t in tokens]
    lead = [t.find(c) if c else 0 for t, c in zip(tokens, cores)]
    # tokens that stand for no word can be split between any two letters
    inner = [range(1, len(c)) if 3 <= len(c) <= LONGEST and all(x.isalnum() or x in SIGNS for x in c) and not c.isdigit() and not speller.read(c)[3] else () for c in cores]
    noisy = any(x in SIGNS or x in "0!(1569" for t in tokens for x in t)
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}

    def offer(to: tuple[int, int], cost: float, arc: tuple) -> None:
        if to not in best or cost < best[to][0]:
            best[to] = (cost, arc)

    for k in range(n):
        for off in (0, *inner[k]):
            if (k, off) not in best:
                continue
            here = best[k, off][0]
            text, joined, j = (tokens[k].lstrip(_EDGE.replace("(", "")) if tokens[k][:1] != "(" else tokens[k][1:]) if off == 0 else tokens[k][lead[k] + off :], 0.0, k
            while True:
                follows = joints[j] if j < n - 1 else tail
                # to the end of token j
                if j == k and off == 0:
                    found = speller.read(cores[k])[:3]
                elif off == 0:
                    cost, reading, places, known = speller.read(text.rstrip(_EDGE))
                    found = (cost, reading, places) if known or all(x == "hyphen" for x in joints[k:j]) else None
                else:
                    found = speller.piece(text.rstrip(_EDGE), noisy)
                if found:
                    offer((j + 1, 0), here + found[0] + joined + (ALONE if follows == "hyphen" else 0.0), ((k, off), found[1], found[2]))
                # into token j
                before = text[: len(text) - len(tokens[j])] if j > k else ""
                for end in inner[j]:
                    if j == k and end <= off:
                        continue
                    part = before + (cores[j][:end] if j > k else cores[j][off:end])
                    if found := speller.piece(part, noisy):
                        offer((j, end), here + found[0] + joined + SPLIT, ((k, off), found[1], found[2]))
                    elif not noisy and not speller.begins(part.lower()):
                        break  # no known word goes on from here
                if j == n - 1 or len(text) > LONGEST:
                    break
                joined += JOIN[joints[j]]
                j += 1
                text += tokens[j]
    out = []
    at = (n, 0)
    while at != (0, 0):
        (k, off), reading, places = best[at][1]
        j, end = (at[0] - 1, None) if at[1] == 0 else at
        begin = lead[k] + off if off else 0
        pieces = [tokens[x][(begin if x == k else 0) : (lead[j] + end if x == j and end is not None else None)] for x in range(k, j + 1)]
        where, passed = [], 0 if off else -(lead[k] if tokens[k][:1] != "(" else 1)
        for x, p in zip(range(k, j + 1), pieces):
            passed += len(p)
            where += [x] * (passed - len(where))
        text = "".join(pieces)
        bad = sorted({where[min(p, len(where) - 1)] for p in places})
        broken = [x for x in range(k, j) if joints[x] != "space"]
        out.append((Page._dress(text, reading) if places else text, k, j, bad, broken))
        at = (k, off)
    return out[::-1]


class Page:
    """The lines of an entry, their kinds, and the decoded words."""

    def __init__(self, raw: str, wanted: list[str], speller: Speller):
        self.lines = raw.split("\n")
        self.found: set[tuple[int, str]] = set()
        self.text: list[int] = []
        most = max(map(len, wanted), default=0) + 10  # letters of a head with a page number; spaced out, four times as long
        before = ""
        for i, line in enumerate(self.lines):
            if not line.strip():
                continue
            if len(line) <= 4 * most and is_head(line, wanted):
                self.found.add((i + 1, "header"))
            elif is_page(line, before):
                self.found.add((i + 1, "page_no"))
            else:
                self.text.append(i)
                before = line
        self.words: list[tuple[str, int, int]] = []  # word, first line, last line
        self._decode(speller)

    def _decode(self, speller: Speller) -> None:
        tokens: list[str] = []
        lines: list[int] = []
        joints: list[str] = []  # what follows each token
        for k, i in enumerate(self.text):
            parts = self.lines[i].split()
            joint = "line"
            if parts and parts[-1][-1] in HYPHENS and k < len(self.text) - 1:
                parts[-1] = parts[-1].rstrip(HYPHENS)
                parts = parts if parts[-1] else parts[:-1]
                joint = "hyphen"
            if parts:
                tokens += parts
                lines += [i] * len(parts)
                joints += ["space"] * (len(parts) - 1) + [joint]
        n = len(tokens)
        if not n:
            return
        joints[-1] = "line"
        alone = [speller.token(t) for t in tokens]
        plain = [x[0] for x in alone]
        start = 0
        for k in range(n):
            if k < n - 1:
                joint = joints[k]
                if joint == "space":
                    near = not plain[k] or not plain[k + 1] or len(tokens[k]) <= SHORTEST and k > start and not plain[k - 1] or len(tokens[k + 1]) <= SHORTEST and k + 2 < n and joints[k + 1] == "space" and not plain[k + 2]
                    if near and _mergeable(tokens[k], tokens[k + 1], joint):
                        continue
                elif _mergeable(tokens[k], tokens[k + 1], joint):
                    continue
            if k == start and plain[k] and joints[k] != "hyphen":
                if alone[k][2]:
                    self.found.add((lines[k] + 1, "misread"))
                self.words.append((alone[k][1], lines[k], lines[k]))
            elif k == start + 1 and joints[start] == "line" and plain[start] and plain[k] and joints[k] != "hyphen" and not alone[start][2] and not alone[k][2] and not speller.read(_run(tokens[start], tokens[k]))[3]:
                # two words on either side of a line end that are none together
                self.words += [(alone[x][1], lines[x], lines[x]) for x in (start, k)]
            else:
                self._island(tuple(tokens[start : k + 1]), tuple(joints[start:k]), joints[k] if k < n - 1 else "", lines[start : k + 1], speller)
            start = k + 1

    def _island(self, tokens: tuple[str, ...], joints: tuple[str, ...], tail: str, lines: list[int], speller: Speller) -> None:
        key = (tokens, joints, tail)
        words = speller.islands.get(key)
        if words is None:
            if len(speller.islands) > 200_000:
                speller.islands.clear()
            words = speller.islands[key] = decode(tokens, joints, tail, speller)
        for text, k, j, bad, broken in words:
            self.found.update((lines[x] + 1, "misread") for x in bad)
            self.found.update((lines[x] + 1, "break") for x in broken)
            self.words.append((text, lines[k], lines[j]))

    @staticmethod
    def _dress(token: str, reading: str) -> str:
        """The reading with the token's outer marks and case."""
        c = core(token)
        at = token.find(c) if c else 0
        reading = reading[:1].upper() + reading[1:] if c[:1].isupper() else reading
        return token[:at] + reading + token[at + len(c) :]

    def paragraphs(self) -> list[str]:
        """Continuous text; boundaries by dynamic programming over the text lines."""
        if not self.words:
            return []
        lines = self.text
        widths = sorted(len(self.lines[i]) for i in lines)
        usual = widths[len(widths) // 2] or 1
        carried = {a for _, a, b in self.words if a != b}
        gain = []
        for k in range(len(lines) - 1):
            i, j = lines[k], lines[k + 1]
            gap = any(not self.lines[x].strip() for x in range(i + 1, j))
            ends = self.lines[i].rstrip().endswith((".", ":", "!", "?"))
            short = len(self.lines[i].rstrip()) < 0.7 * usual
            starts = self.lines[j].lstrip()[:1].isupper()
            gain.append(-99.0 if i in carried else 1.0 * gap + 2.0 * ends + 2.0 * short + 0.5 * starts - 3.5)
        # states: the paragraph so far has one line, or more; a paragraph of one line costs a little
        one, more, steps = 0.0, -math.inf, []
        for g in gain:
            ended = max(one - 0.5, more)
            steps.append((one - 0.5 > more, one > more))
            one, more = ended + g, max(one, more)
        single, cuts = one - 0.5 > more, []
        for k in range(len(steps) - 1, -1, -1):
            if single:
                cuts.append(k + 1)
                single = steps[k][0]
            else:
                single = steps[k][1]
        start_of = {lines[c] for c in cuts}
        out: list[list[str]] = [[]]
        seen = self.words[0][1]
        for w, a, b in self.words:
            if a != seen and any(x in start_of for x in range(seen + 1, a + 1)):
                out.append([])
            out[-1].append(w)
            seen = b
        return [" ".join(p) for p in out if p]


def _with_heads(entries: DataFrame, volumes: DataFrame) -> DataFrame:
    known = volumes.filter(F.col("volume_id").isNotNull()).groupBy("volume_id").agg(F.min(F.struct("title", "institution", "city")).alias("v"))
    named = known.select(F.col("volume_id").alias("_v"), "v.title", "v.institution", "v.city")
    side = F.broadcast(named) if small(named, 100_000) is not None else named
    base = entries.filter(F.col("entry_key").isNotNull() & F.col("raw").isNotNull()).select(F.col("entry_key").cast("bigint").alias("entry_key"), "volume_id", "raw")
    return base.join(side, F.col("volume_id") == F.col("_v"), "left").select("entry_key", "title", "institution", "city", "raw")


def _pages(counts: dict[str, int], make, schema: pa.Schema):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, known = Speller(counts), {}
        for b in it:
            rows: list[tuple] = []
            for key, title, institution, city, raw in zip(*[c.to_pylist() for c in b.columns]):
                v = (title, institution, city)
                if v not in known:
                    known[v] = heads(*v)
                rows += make(key, Page(raw, known[v], speller))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def line_kinds(entries: DataFrame, volumes: DataFrame) -> DataFrame:
    """(entry_key, line_no, kind): heads, page numbers, lines that break a word, and lines with misread letters."""
    counts = word_counts(entries, "raw")
    schema = pa.schema([("entry_key", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string())])
    return _with_heads(entries, volumes).mapInArrow(_pages(counts, lambda key, page: [(key, n, k) for n, k in sorted(page.found)], schema), "entry_key bigint, line_no int, kind string").distinct()


def repaired(entries: DataFrame, volumes: DataFrame) -> DataFrame:
    """(entry_key, par_no, text): continuous text in paragraphs."""
    counts = word_counts(entries, "raw")
    schema = pa.schema([("entry_key", pa.int64()), ("par_no", pa.int32()), ("text", pa.string())])
    return _with_heads(entries, volumes).mapInArrow(_pages(counts, lambda key, page: [(key, i, p) for i, p in enumerate(page.paragraphs(), 1)], schema), "entry_key bigint, par_no int, text string").distinct()
