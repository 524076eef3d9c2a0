"""Scalar text functions: clean-up of register lines, marginal notes, joining of lines, ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers that transcribers put into the text, removed wherever they stand.
MARKERS = ["[margin]", "[roto]", "[signed]", "<margin>", "</margin>", "&lt;insert&gt;", "&lt;/insert&gt;", "&lt;blurry&gt;", "&lt;/blurry&gt;"]


MARKER_PATTERN = "|".join(re.escape(m) for m in MARKERS)


def strip_markers(c: Column) -> Column:
    return F.regexp_replace(c, MARKER_PATTERN, "")


def strip_brackets(c: Column) -> Column:
    """Brackets, braces and equals signs go, but only from lines without markup."""
    return F.when(c.contains("<"), c).otherwise(F.translate(c, "[]{}=", ""))


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def drop_one_space(c: Column) -> Column:
    """One leading space."""
    return F.regexp_replace(c, "^ ", "")


def clean_line(c: Column) -> Column:
    """Markers, brackets, repeated spaces and one leading space removed, in this order."""
    return drop_one_space(squeeze_spaces(strip_brackets(strip_markers(c))))


def marginal(c: Column) -> Column:
    """Whether a line is a marginal note. The length counts the line feed; capitals have a head start of one."""
    words = F.split(c, " ")
    plain = F.size(F.filter(words, lambda w: F.lower(w) == w))
    n = F.length(c) + 1
    return (n < 10) | ((n < 30) & (1 + F.size(words) - plain >= plain))


def join_lines(lines: Column) -> Column:
    """Lines put together: a final hyphen is dropped and the word closed up, else a space follows; one final space goes."""
    parts = F.transform(lines, lambda x: F.when(x.endswith("-"), F.regexp_replace(x, "-$", "")).otherwise(F.concat(x, F.lit(" "))))
    return F.regexp_replace(squeeze_spaces(F.array_join(parts, "")), " $", "")


def build_entry(lines: Column) -> Column:
    """The block rule: empty lines are skipped; a line beginning with a hyphen replaces the text's last character; after
    each line but the last either a final hyphen goes or a space is added."""
    kept = F.filter(lines, lambda x: F.length(x) > 0)
    n = F.size(lines)
    numbered = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("t"), (i + 1 == n).alias("last"))), lambda s: F.length(s["t"]) > 0)

    def step(acc: Column, s: Column) -> Column:
        put = F.when(s["t"].startswith("-") & (F.length(acc) > 0), F.concat(acc.substr(F.lit(1), F.length(acc) - 1), s["t"].substr(F.lit(2), F.length(s["t"])))).otherwise(F.concat(acc, s["t"]))
        return F.when(put.endswith("-"), put.substr(F.lit(1), F.length(put) - 1)).when(~s["last"], F.concat(put, F.lit(" "))).otherwise(put)

    return F.when(F.size(kept) == 0, F.lit("")).otherwise(F.aggregate(numbered, F.lit(""), step))


def pad(c: Column, width: int) -> Column:
    """Zero padding that never cuts."""
    s = c.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def image_number(c: Column, seen: Column) -> Column:
    """Image ids padded with a leading 1: above 1000 while fewer than 500 images were seen they count modulo 1000."""
    return F.when((c > 1000) & (seen < 500), c % 1000).otherwise(c)


def before_dash(c: Column) -> Column:
    return F.substring_index(c, "-", 1)


def after_last_dash(c: Column) -> Column:
    return F.substring_index(c, "-", -1)


def basename(c: Column) -> Column:
    """File name without directories and extension."""
    return F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]*$", "")


def image_url(bucket: str, key: Column, colour: str = "color") -> Column:
    return F.format_string(f"https://{bucket}/%s-{colour}.jpg", key)
