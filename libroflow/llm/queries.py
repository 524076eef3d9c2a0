"""Queries of the problems solved in this subpackage, and the SQL they can be compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libroflow.llm.canonical import map_terms
from libroflow.llm.consensus import ranked, record_values, survivors
from libroflow.llm.groups import group_ids
from libroflow.llm.language import identify
from libroflow.llm.leakage import leaks
from libroflow.llm.packing import pack_all, token_counts
from libroflow.llm.pages import line_kinds, repaired
from libroflow.llm.variants import variant_people
from libroflow.session import cut, small, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_terms(table(spark, sf_dir, "person_mentions"), table(spark, sf_dir, "vocabulary"))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that p1_found answers for, and whether each answer is a term of the field's list or none."""
    terms = table(spark, sf_dir, "vocabulary").filter("vocab_key is not null").select(F.col("vocab_key").alias("_f"), F.explode("vocab").alias("_t")).distinct()
    found = p1_found(spark, sf_dir).join(terms, (F.col("field") == F.col("_f")) & (F.col("term") == F.col("_t")), "left")
    return found.select("mention_key", "field", "pos", (F.col("_t").isNotNull() | (F.col("term") == "")).alias("listed"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_people(table(spark, sf_dir, "person_mentions"))


def _values(spark: SparkSession, sf_dir: str, weighted: bool = False) -> DataFrame:
    return record_values(table(spark, sf_dir, "person_records"), table(spark, sf_dir, "source_trust"), weighted)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rank: the stated rules let one record outweigh all below it, which no vote can change."""
    return ranked(_values(spark, sf_dir)).select(F.col("grp").alias("group_id"), "field", F.col("record").alias("record_key"))


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By vote: the record closest to the weighted consensus of its group, and its distance in tokens."""
    return survivors(_values(spark, sf_dir, True)).select(F.col("grp").alias("group_id"), "field", F.col("record").alias("record_key"), "distance")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_ids(table(spark, sf_dir, "match_decisions"), "left_ids", "right_ids", "is_match").select(F.col("id").alias("mention_id"), F.col("group").alias("group_id"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with the country of their volume, which stands for the address suffix they lack."""
    known = table(spark, sf_dir, "volumes").filter("volume_id is not null").groupBy(F.col("volume_id").alias("_v")).agg(F.min("country").alias("_country"))
    side = F.broadcast(known) if small(known, 100_000) is not None else known
    return table(spark, sf_dir, "documents").join(side, F.col("volume_id") == F.col("_v"), "left")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_placed(spark, sf_dir), suffix="_country").filter(F.col("mixed") | ~F.col("label_ok")).select("doc_id", "par_no", "lang").distinct()


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and paragraph."""
    return identify(_placed(spark, sf_dir), suffix="_country").distinct()


def p10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paragraphs of each document have a language, and whether all have it with a confidence."""
    found = identify(_placed(spark, sf_dir), suffix="_country").distinct()
    sure = F.col("confidence").between(0.0, 1.0) & F.col("doc_confidence").between(0.0, 1.0) & F.col("lang").isNotNull()
    return found.groupBy("doc_id").agg(F.countDistinct("par_no").alias("paragraphs"), F.min(sure).alias("sure"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_kinds(table(spark, sf_dir, "entries"), table(spark, sf_dir, "volumes"))


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every entry, by paragraph."""
    return repaired(table(spark, sf_dir, "entries"), table(spark, sf_dir, "volumes"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of every capacity."""
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pack_all(sizes, "doc_id", "n_tokens", table(spark, sf_dir, "pack_sizes")).withColumnRenamed("item", "doc_id")


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every document is whole in the containers of each capacity: all its tokens once and in order, in one piece
    unless it is longer than the capacity, and in no container that is over it."""
    sizes = token_counts(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc_id").alias("_d"), F.col("n_tokens").alias("size"))
    packs = table(spark, sf_dir, "pack_sizes").select("pack_id", "capacity_tokens").distinct()
    placed = cut(p8_pack(spark, sf_dir))
    full = placed.groupBy(F.col("container").alias("_c"), F.col("pack_id").alias("_k")).agg(F.sum("n_tokens").alias("held"))
    own = placed.join(full, (F.col("container") == F.col("_c")) & (F.col("pack_id") == F.col("_k")))
    docs = own.groupBy("pack_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("start_token").alias("starts"), F.max(F.col("start_token") + F.col("n_tokens")).alias("last"), F.max("held").alias("held"))
    ok = (F.col("got") == F.col("size")) & (F.col("last") == F.col("size")) & (F.col("starts") == F.col("pieces")) & (F.col("pieces") == F.greatest(F.ceil(F.col("size") / F.col("capacity_tokens")), F.lit(1))) & (F.col("held") <= F.col("capacity_tokens"))
    return docs.join(sizes, F.col("doc_id") == F.col("_d")).join(packs, "pack_id").select("pack_id", "doc_id", ok.alias("whole"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p3_found": p3_found, "p4_found": p4_found, "p4_consensus": p4_consensus, "p5_found": p5_found, "p7_found": p7_found, "p7_text": p7_text, "p8_pack": p8_pack, "p8_checks": p8_checks, "p9_found": p9_found, "p10_found": p10_found, "p10_languages": p10_languages, "p10_paragraphs": p10_paragraphs}

_VALUES = " UNION ".join(f"SELECT mention_key, '{f}' AS field, 1 AS pos, {f} AS v FROM person_mentions" for f in ("occupation", "phenotype", "ethnicity"))

ORACLES = {
    "p1_values": f"""WITH v AS ({_VALUES} UNION SELECT mention_key, 'titles', i, titles[i] FROM (SELECT mention_key, titles, unnest(range(1, len(titles) + 1))::INT AS i FROM person_mentions)),
        t AS (SELECT DISTINCT vocab_key AS field, unnest(vocab) AS v FROM vocabulary)
        SELECT mention_key, field, pos::INT AS pos, true AS listed FROM v ANTI JOIN t USING (field, v) WHERE v IS NOT NULL AND mention_key IS NOT NULL""",
    "p8_checks": "SELECT pack_id, doc_id, true AS whole FROM pack_sizes, (SELECT DISTINCT doc_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)",
    "p10_paragraphs": "SELECT * FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[\\r\\n]+'), lambda x: regexp_matches(x, '\\S'))) AS paragraphs, true AS sure FROM documents WHERE text IS NOT NULL) WHERE paragraphs > 0",
    "p5_found": """
        WITH RECURSIVE d AS (
            SELECT list_distinct(list_filter(list_concat(coalesce(left_ids, []), coalesce(right_ids, [])), lambda x: x IS NOT NULL)) AS ids
            FROM match_decisions WHERE is_match),
        e AS (SELECT DISTINCT unnest(ids) AS u, list_min(ids) AS v FROM d),
        s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
        r(u, v) AS (SELECT u, v FROM s UNION SELECT r.u, s.v FROM r JOIN s ON r.v = s.u)
        SELECT u AS mention_id, min(v) AS group_id FROM r GROUP BY u""",
    "p4_found": """
        WITH ph(x) AS (VALUES (''), ('-'), ('--'), ('?'), ('??'), ('...'), ('n/a'), ('s/d'), ('none'), ('null'), ('unknown'), ('desconocido'), ('no consta'), ('ilegible'), ('[roto]')),
        b AS (SELECT DISTINCT group_id, record_key, occupation, titles, mentions, r.updated_at,
                     coalesce(t.trust, 4611686018427387904) AS low
              FROM person_records r LEFT JOIN source_trust t ON t.source = r.source WHERE group_id IS NOT NULL),
        o AS (SELECT group_id, 'occupation' AS field, record_key, 0 AS p0, low, updated_at, row_number() OVER (PARTITION BY group_id ORDER BY low, updated_at DESC NULLS LAST, record_key) AS k
              FROM b WHERE occupation IS NOT NULL AND lower(trim(occupation)) NOT IN (SELECT x FROM ph)),
        tv AS (SELECT group_id, record_key, low, updated_at, unnest(titles) AS x FROM b),
        tt AS (SELECT DISTINCT group_id, record_key, low, updated_at FROM tv WHERE x IS NOT NULL AND lower(trim(x)) NOT IN (SELECT x FROM ph)),
        t AS (SELECT group_id, 'titles' AS field, record_key, row_number() OVER (PARTITION BY group_id ORDER BY updated_at DESC NULLS LAST, low, record_key) AS k FROM tt),
        mv AS (SELECT group_id, record_key, low, updated_at, unnest(mentions) AS x FROM b),
        mm AS (SELECT group_id, record_key, low, updated_at, count(DISTINCT regexp_replace(regexp_replace(trim(x), '^0+([0-9])', '\\1'), '-0+([0-9])', '-\\1')) AS n
               FROM mv WHERE x IS NOT NULL AND lower(trim(x)) NOT IN (SELECT x FROM ph) GROUP BY ALL),
        m AS (SELECT group_id, 'mentions' AS field, record_key, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, low, updated_at DESC NULLS LAST, record_key) AS k FROM mm)
        SELECT group_id, field, record_key FROM o WHERE k = 1
        UNION ALL SELECT group_id, field, record_key FROM t WHERE k = 1
        UNION ALL SELECT group_id, field, record_key FROM m WHERE k = 1""",
}
