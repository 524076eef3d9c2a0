"""Selection of examples, instructions and items; volume metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Countries whose registers are in Spanish, record types and their phrases, subjects of the catalogue.
SPANISH = ["Colombia", "Cuba", "Mexico", "United States"]
PHRASES = {"baptism": "baptismal register", "marriage": "marriage register", "burial": "burial register"}
SUBJECTS = [("Baptisms", "baptism"), ("Marriages", "marriage"), ("Burials", "burial")]


def matching(df: DataFrame, keywords: dict[str, object] | None, mode: str = "or") -> DataFrame:
    """Rows where any (`or`) or all (any other mode) of the keywords are equal; no keywords keep all rows."""
    if not keywords:
        return df
    tests = [F.coalesce(F.col(k) == F.lit(v), F.lit(False)) for k, v in keywords.items()]
    return df.filter(reduce((lambda a, b: a | b) if mode == "or" else (lambda a, b: a & b), tests))


# Which properties of the volume each example strategy compares.
STRATEGIES = {"v": ["volume_id"], "l": ["language"], "t": ["record_type"], "lt": ["language", "record_type"], "i": ["institution", "record_type"]}


def by_strategy(examples: DataFrame, volume: dict[str, object], strategy: str) -> DataFrame:
    """Examples like the volume in the strategy's properties; an unknown strategy keeps all."""
    return matching(examples, {k: volume.get(k) for k in STRATEGIES.get(strategy, [])}, "and")


def capped(df: DataFrame, key: str, most: int, seed: str = "0") -> DataFrame:
    """At most `most` rows, chosen by a hash of seed and key (a sampling operator)."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(most)


def line_examples(images: DataFrame, volumes: DataFrame, keywords: dict[str, object] | None, mode: str = "or", colour: str | None = None, most: int = 10, seed: str = "0") -> DataFrame:
    """Transcribed images (image_id, volume_id, colour) of the volumes that match, of one colour if it is given, and at most
    `most` of them (a sampling operator)."""
    kept = images.join(matching(volumes, keywords, mode).select("volume_id").distinct(), "volume_id", "left_semi")
    return capped(kept if colour is None else kept.filter(F.col("colour") == colour), "image_id", most, seed)


def language_of(country: Column) -> Column:
    return F.when(country.isin(SPANISH), "Spanish").otherwise("Portuguese")


def transcription_language(country: Column) -> Column:
    """The rule of the transcription stage, which differs from `language_of`."""
    return F.when(country == "Brazil", "Portuguese").otherwise("Spanish")


def phrase_of(record_type: Column) -> Column:
    out = F.lit("sacramental record")
    for k, v in PHRASES.items():
        out = F.when(record_type == k, v).otherwise(out)
    return out


def type_of(subjects: Column) -> Column:
    """Record type by the first subject found, in fixed priority."""
    out = F.lit(None).cast("string")
    for subject, kind in reversed(SUBJECTS):
        out = F.when(F.array_contains(subjects, subject), kind).otherwise(out)
    return out


def catalogued(catalogue: DataFrame, wanted: DataFrame, identifier: str, subjects: str, order: list[str]) -> DataFrame:
    """The catalogue's first row for each wanted identifier, with the record type that its subjects tell; identifiers that
    are not in the catalogue stay, with nulls."""
    rest = [c for c in catalogue.columns if c != identifier]
    first = catalogue.filter(F.col(identifier).isNotNull()).groupBy(identifier).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_c"))
    out = wanted.select(identifier).distinct().join(first, identifier, "left").select(identifier, *[F.col(f"_c.{c}").alias(c) for c in rest])
    return out.withColumn("record_type", type_of(F.col(subjects)))


def instructions_for(volumes: DataFrame, instructions: list[tuple[list[str], int, str]], mode: str) -> DataFrame:
    """Every volume's instructions: those whose cases are all among mode, language and type (and state for
    transcription), by sequence. The instructions are a short list that travels as a literal."""
    lang = transcription_language(F.col("country")) if mode == "transcription" else language_of(F.col("country"))
    words = F.array(F.lit(mode), lang, F.col("record_type"), *([F.col("state")] if mode == "transcription" else []))
    rows = F.array(*[F.struct(F.array(*[F.lit(c) for c in cases]).alias("cases"), F.lit(seq).alias("sequence"), F.lit(i).alias("pos"), F.lit(text).alias("text")) for i, (cases, seq, text) in enumerate(instructions)])
    fit = F.filter(rows, lambda r: F.forall(r["cases"], lambda c: F.coalesce(F.array_contains(words, c), F.lit(False))))
    ordered = F.array_sort(F.transform(fit, lambda r: F.struct(r["sequence"].alias("sequence"), r["pos"].alias("pos"), r["text"].alias("text"))))
    return volumes.withColumn("instructions", F.transform(ordered, lambda r: r["text"]))


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str], take: str, name: str) -> DataFrame:
    """Left outer join to the first right row by `order`; unmatched rows stay, with null."""
    best = right.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])).groupBy(*on).agg(F.min_by(take, F.struct(*order)).alias(name))
    return left.join(best, on, "left")


def in_order(left: DataFrame, right: DataFrame, on: list[str], group: str, order: list[str]) -> DataFrame:
    """Inner join that keeps the left side's order within each group, as `place` from 1."""
    return left.join(right, on).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def with_prefix(items: DataFrame, key: str, chosen: DataFrame, prefix: str) -> DataFrame:
    """Items whose key begins, up to its first dash, with one of the chosen prefixes, as texts."""
    side = chosen.select(F.col(prefix).cast("string").alias("_p"))
    return items.join(side, F.substring_index(F.col(key), "-", 1) == F.col("_p"), "left_semi")


def unindexed(items: DataFrame, wanted: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Items that are wanted and not indexed yet."""
    return items.join(wanted.select(key), key, "left_semi").join(index.select(key), key, "left_anti")


def width_band(boxes: DataFrame, image: str, slack: int = 50) -> DataFrame:
    """Boxes about as wide as the widest of their image that is not much taller than wide."""
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    widest = F.coalesce(F.max(F.when(h <= 3 * w, w)).over(Window.partitionBy(image)), F.lit(0))
    return boxes.withColumn("_w", w).withColumn("_m", widest).filter(F.col("_w").between(F.col("_m") - slack, F.col("_m") + slack)).drop("_w", "_m")
