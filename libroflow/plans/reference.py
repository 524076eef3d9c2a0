"""Queries of the reference's operators over the driver's tables, each with the SQL it is compared with.

The driver's tables are no page images, so boxes, pixels and signals are read off columns of like shape:
boxes from the lines of an order (one image per order), pixels from embeddings (an 8 x 8 grid per vector).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from libroflow.functions import dates, geometry, similarity, text
from libroflow.operators import entity, evaluate, folio, layout, repair, select
from libroflow.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with the SQL it is compared with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- text ------------------------------------------------------------------------------------------------------------

_CLEAN = r"""regexp_replace(regexp_replace(CASE WHEN contains(s, '<') THEN s ELSE translate(s, '[]{}=', '') END, ' {2,}', ' ', 'g'), '^ ', '')"""
_STRIP = r"""regexp_replace(%s, '\[margin\]|\[roto\]|\[signed\]|<margin>|</margin>|&lt;insert&gt;|&lt;/insert&gt;|&lt;blurry&gt;|&lt;/blurry&gt;', '', 'g')"""
_LINES = f"""l AS (SELECT entry_key, i AS line_no, {_STRIP % "string_split(raw, chr(10))[i]"} AS s
     FROM (SELECT entry_key, raw, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS i FROM entries WHERE raw IS NOT NULL)),
    c AS (SELECT entry_key, line_no, {_CLEAN} AS line FROM l)"""
_MARGINAL = "(length(line) + 1 < 10 OR (length(line) + 1 < 30 AND 1 + len(list_filter(string_split(line, ' '), lambda w: lower(w) <> w)) >= len(list_filter(string_split(line, ' '), lambda w: lower(w) = w))))"


def _entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entries").filter(F.col("raw").isNotNull())
    return e.select("entry_key", F.posexplode(F.split("raw", "\n")).alias("i", "line")).select("entry_key", (F.col("i") + 1).cast("bigint").alias("line_no"), text.clean_line(F.col("line")).alias("line"))


@query(f"WITH {_LINES} SELECT entry_key, line_no, line FROM c")
def text_line_clean(spark, sf_dir):
    return _entry_lines(spark, sf_dir)


@query(f"WITH {_LINES} SELECT entry_key, line_no, {_MARGINAL} AS marginal FROM c")
def text_marginal_filter(spark, sf_dir):
    return _entry_lines(spark, sf_dir).select("entry_key", "line_no", text.marginal(F.col("line")).alias("marginal"))


@query(f"""WITH {_LINES}, k AS (SELECT DISTINCT entry_key, line_no, line FROM c WHERE NOT {_MARGINAL})
    SELECT entry_key, regexp_replace(regexp_replace(string_agg(CASE WHEN line LIKE '%-' THEN regexp_replace(line, '-$', '') ELSE line || ' ' END, '' ORDER BY line_no), ' {{2,}}', ' ', 'g'), ' $', '') AS raw
    FROM k GROUP BY entry_key""")
def text_dehyphen_join(spark, sf_dir):
    e = table(spark, sf_dir, "entries").filter(F.col("raw").isNotNull()).select("entry_key", "raw").distinct()
    lines = F.transform(F.split("raw", "\n"), text.clean_line)
    kept = F.filter(lines, lambda x: ~text.marginal(x))
    return e.withColumn("k", kept).filter(F.size("k") > 0).select("entry_key", text.join_lines(F.col("k")).alias("raw"))


@query("""WITH t AS (SELECT entry_key, string_split(raw, chr(10)) AS ls FROM (SELECT DISTINCT entry_key, raw FROM entries WHERE raw IS NOT NULL)),
    n AS (SELECT entry_key, list_filter(list_transform(range(1, len(ls) + 1), lambda i: {'t': ls[i], 'last': i = len(ls)}), lambda s: length(s.t) > 0) AS k FROM t)
    SELECT entry_key, coalesce(list_reduce(list_prepend({'t': '', 'last': false}, k), lambda a, s: {'t': (
        CASE WHEN (CASE WHEN s.t LIKE '-%' AND length(a.t) > 0 THEN a.t[1:length(a.t) - 1] || s.t[2:] ELSE a.t || s.t END) LIKE '%-'
             THEN (CASE WHEN s.t LIKE '-%' AND length(a.t) > 0 THEN a.t[1:length(a.t) - 1] || s.t[2:] ELSE a.t || s.t END)[1:-2]
             WHEN NOT s.last THEN (CASE WHEN s.t LIKE '-%' AND length(a.t) > 0 THEN a.t[1:length(a.t) - 1] || s.t[2:] ELSE a.t || s.t END) || ' '
             ELSE (CASE WHEN s.t LIKE '-%' AND length(a.t) > 0 THEN a.t[1:length(a.t) - 1] || s.t[2:] ELSE a.t || s.t END) END), 'last': s.last}).t, '') AS body FROM n""")
def text_build_entry(spark, sf_dir):
    e = table(spark, sf_dir, "entries").filter(F.col("raw").isNotNull()).select("entry_key", "raw").distinct()
    return e.select("entry_key", text.build_entry(F.split("raw", "\n")).alias("body"))


@query("""SELECT DISTINCT mention_id, split_part(mention_id, '-', 1) AS volume, regexp_extract(mention_id, '[^-]*$') AS person,
    lpad(split_part(entry_id, '-', 1), greatest(4, length(split_part(entry_id, '-', 1)))::INT, '0') AS image,
    'https://images.example/' || entry_id || '-color.jpg' AS url
    FROM person_mentions JOIN (SELECT DISTINCT entry_key, entry_id FROM entries) USING (entry_key)""")
def id_surgery(spark, sf_dir):
    m = table(spark, sf_dir, "person_mentions").select("mention_id", "entry_key").distinct()
    e = table(spark, sf_dir, "entries").select("entry_key", "entry_id").distinct()
    j = m.join(e, "entry_key")
    return j.select("mention_id", text.before_dash(F.col("mention_id")).alias("volume"), text.after_last_dash(F.col("mention_id")).alias("person"), text.pad(text.before_dash(F.col("entry_id")), 4).alias("image"), text.image_url("images.example", F.col("entry_id")).alias("url")).distinct()


@query(f"""WITH {_LINES}, k AS (SELECT DISTINCT entry_key, line_no, line FROM c WHERE NOT {_MARGINAL}),
    t AS (SELECT entry_key, regexp_replace(regexp_replace(string_agg(CASE WHEN line LIKE '%-' THEN regexp_replace(line, '-$', '') ELSE line || ' ' END, '' ORDER BY line_no), ' {{2,}}', ' ', 'g'), ' $', '') AS raw FROM k GROUP BY entry_key),
    e AS (SELECT DISTINCT entry_key, volume_id, split_part(entry_id, '-', 1)::INT AS image FROM entries WHERE volume_id IS NOT NULL)
    SELECT volume_id::VARCHAR || '/' || image::VARCHAR AS source, lpad(image::VARCHAR, 4, '0') || '-' || lpad(row_number() OVER (PARTITION BY volume_id, image ORDER BY entry_key)::VARCHAR, 2, '0') AS entry_id, raw
    FROM e JOIN t USING (entry_key) WHERE length(raw) > 0""")
def register_parse(spark, sf_dir):
    """The entries written as register markup, one file per image, and parsed again."""
    from libroflow.sources.registers import parse_markup

    e = table(spark, sf_dir, "entries").filter(F.col("raw").isNotNull() & F.col("volume_id").isNotNull()).select("entry_key", "volume_id", text.before_dash(F.col("entry_id")).cast("int").alias("image"), "raw").distinct()
    n = F.row_number().over(Window.partitionBy("volume_id", "image").orderBy("entry_key"))
    begin = F.when(F.col("n") == 1, F.array(F.format_string('<image id="%d" type="jpg">', "image"))).otherwise(F.array().cast("array<string>"))
    body = F.concat(begin, F.array(F.lit('<entry id="1">')), F.split("raw", "\n"), F.array(F.lit("</entry>")))
    source = F.concat_ws("/", F.col("volume_id").cast("string"), F.col("image").cast("string"))
    lines = e.withColumn("n", n).select(source.alias("source"), "n", F.posexplode(body).alias("i", "line")).select("source", (F.col("n").cast("bigint") * 10**9 + F.col("i")).alias("line_no"), "line")
    return parse_markup(lines).select("source", "entry_id", "raw")


# -- selection -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, record_type FROM documents WHERE lang = 'es' OR record_type = 'letter'")
def fewshot_or(spark, sf_dir):
    return select.matching(table(spark, sf_dir, "documents"), {"lang": "es", "record_type": "letter"}, "or").select("doc_id", "lang", "record_type")


@query("SELECT doc_id, lang, record_type FROM documents WHERE lang = 'es' AND record_type = 'letter'")
def fewshot_and(spark, sf_dir):
    return select.matching(table(spark, sf_dir, "documents"), {"lang": "es", "record_type": "letter"}, "and").select("doc_id", "lang", "record_type")


@query("""SELECT volume_id, CASE WHEN country IN ('Colombia', 'Cuba', 'Mexico', 'United States') THEN 'Spanish' ELSE 'Portuguese' END AS language, record_type
    FROM volumes WHERE record_type = 'marriage' AND CASE WHEN country IN ('Colombia', 'Cuba', 'Mexico', 'United States') THEN 'Spanish' ELSE 'Portuguese' END = 'Spanish'""")
def fewshot_strategy_lt(spark, sf_dir):
    v = table(spark, sf_dir, "volumes").withColumn("language", select.language_of(F.col("country")))
    return select.by_strategy(v, {"language": "Spanish", "record_type": "marriage"}, "lt").select("volume_id", "language", "record_type")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'es' ORDER BY md5('7' || doc_id::VARCHAR), doc_id LIMIT 10")
def fewshot_cap(spark, sf_dir):
    return select.capped(select.matching(table(spark, sf_dir, "documents"), {"lang": "es"}), "doc_id", 10, "7").select("doc_id", "lang")


@query("""SELECT entry_key, 'https://images.example/' || entry_id || '-color.jpg' AS url, raw FROM
    (SELECT DISTINCT entry_key, entry_id, raw, volume_id FROM entries) SEMI JOIN (SELECT volume_id FROM volumes WHERE record_type = 'baptism' AND country = 'Cuba') USING (volume_id)""")
def htr_examples(spark, sf_dir):
    wanted = select.matching(table(spark, sf_dir, "volumes"), {"record_type": "baptism", "country": "Cuba"}, "and")
    e = table(spark, sf_dir, "entries").select("entry_key", "entry_id", "raw", "volume_id").distinct()
    return e.join(wanted.select("volume_id"), "volume_id", "left_semi").select("entry_key", text.image_url("images.example", F.col("entry_id")).alias("url"), "raw")


_INSTRUCTIONS = [(["normalization"], 1, "Modernise the spelling."), (["normalization", "Spanish"], 3, "Expand Spanish abbreviations."), (["normalization", "Portuguese"], 3, "Expand Portuguese abbreviations."), (["extraction"], 1, "List people."), (["normalization", "baptism"], 2, "Keep the godparents."), (["normalization", "Spanish", "burial"], 2, "Keep the cause of death.")]
_INSTRUCTION_ROWS = ", ".join(f"({c!r}, {s}, {i}, {t!r})" for i, (c, s, t) in enumerate(_INSTRUCTIONS))


@query(f"""WITH i(cases, seq, pos, text) AS (VALUES {_INSTRUCTION_ROWS}),
    v AS (SELECT volume_id, ['normalization', CASE WHEN country IN ('Colombia', 'Cuba', 'Mexico', 'United States') THEN 'Spanish' ELSE 'Portuguese' END, record_type] AS words FROM volumes)
    SELECT volume_id, string_agg(text, '|' ORDER BY seq, pos) AS instructions FROM v JOIN i ON list_has_all(words, cases) GROUP BY volume_id""")
def instruction_subset(spark, sf_dir):
    return select.instructions_for(table(spark, sf_dir, "volumes"), _INSTRUCTIONS, "normalization").select("volume_id", F.array_join("instructions", "|").alias("instructions"))


@query("""SELECT volume_id, CASE WHEN country IN ('Colombia', 'Cuba', 'Mexico', 'United States') THEN 'Spanish' ELSE 'Portuguese' END AS language,
    CASE WHEN country = 'Brazil' THEN 'Portuguese' ELSE 'Spanish' END AS transcription_language,
    CASE record_type WHEN 'baptism' THEN 'baptismal register' WHEN 'marriage' THEN 'marriage register' WHEN 'burial' THEN 'burial register' ELSE 'sacramental record' END AS phrase FROM volumes""")
def volume_metadata(spark, sf_dir):
    c = F.col("country")
    return table(spark, sf_dir, "volumes").select("volume_id", select.language_of(c).alias("language"), select.transcription_language(c).alias("transcription_language"), select.phrase_of(F.col("record_type")).alias("phrase"))


@query("""WITH s AS (SELECT volume_id, CASE record_type WHEN 'baptism' THEN ['Registers', 'Baptisms'] WHEN 'marriage' THEN ['Marriages', 'Registers'] ELSE ['Burials'] END AS subjects FROM volumes)
    SELECT volume_id, CASE WHEN list_contains(subjects, 'Baptisms') THEN 'baptism' WHEN list_contains(subjects, 'Marriages') THEN 'marriage' WHEN list_contains(subjects, 'Burials') THEN 'burial' END AS kind FROM s""")
def catalogue_type(spark, sf_dir):
    subjects = F.when(F.col("record_type") == "baptism", F.array(F.lit("Registers"), F.lit("Baptisms"))).when(F.col("record_type") == "marriage", F.array(F.lit("Marriages"), F.lit("Registers"))).otherwise(F.array(F.lit("Burials")))
    return table(spark, sf_dir, "volumes").select("volume_id", select.type_of(subjects).alias("kind"))


@query("""WITH e AS (SELECT DISTINCT entry_key, entry_id, volume_id, raw, normalized FROM entries), r AS (SELECT volume_id, raw, arg_min(entry_id, entry_key) AS entry FROM e WHERE raw IS NOT NULL AND volume_id IS NOT NULL GROUP BY volume_id, raw)
    SELECT e.entry_key, r.entry FROM e LEFT JOIN r ON e.volume_id = r.volume_id AND e.raw = r.raw WHERE e.normalized IS NOT NULL""")
def example_entry_join(spark, sf_dir):
    e = table(spark, sf_dir, "entries").select("entry_key", "entry_id", "volume_id", "raw", "normalized").distinct()
    return select.first_match(e.filter(F.col("normalized").isNotNull()), e, ["volume_id", "raw"], ["entry_key"], "entry_id", "entry").select("entry_key", "entry")


@query("""SELECT DISTINCT volume_id FROM volumes SEMI JOIN documents USING (volume_id) ANTI JOIN extraction_files USING (volume_id)""")
def unindexed_items(spark, sf_dir):
    return select.unindexed(table(spark, sf_dir, "volumes").select("volume_id"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "extraction_files"), "volume_id").distinct()


@query("""SELECT v.volume_id, coalesce(n::VARCHAR, 'N/A') AS files, n FROM volumes v LEFT JOIN (SELECT volume_id, count(*) AS n FROM extraction_files GROUP BY 1) USING (volume_id)""")
def eval_left_join_na(spark, sf_dir):
    n = table(spark, sf_dir, "extraction_files").groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "volumes").join(n, "volume_id", "left").select("volume_id", F.coalesce(F.col("n").cast("string"), F.lit("N/A")).alias("files"), "n")


@query("""WITH e AS (SELECT DISTINCT entry_key, volume_id, raw FROM entries WHERE raw IS NOT NULL)
    SELECT entry_key, 'system:' || CASE record_type WHEN 'baptism' THEN 'baptismal register' WHEN 'marriage' THEN 'marriage register' WHEN 'burial' THEN 'burial register' ELSE 'sacramental record' END || '|user:' || raw AS conversation
    FROM e JOIN volumes USING (volume_id)""")
def conversation_build(spark, sf_dir):
    from libroflow.operators.provider import conversations

    e = table(spark, sf_dir, "entries").filter(F.col("raw").isNotNull()).select("entry_key", "volume_id", "raw").distinct().join(table(spark, sf_dir, "volumes"), "volume_id")
    chats = conversations(e, F.array(select.phrase_of(F.col("record_type"))), F.array().cast("array<struct<raw: string, answer: string>>"), F.col("raw"))
    return chats.select("entry_key", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("conversation"))


# -- windows and ids -------------------------------------------------------------------------------------------------

_VERDICT = "CASE WHEN raw LIKE '%.' THEN 'complete' WHEN raw LIKE '%,' OR raw LIKE '%-' THEN 'beginning' ELSE 'end' END"


@query(f"""WITH e AS (SELECT DISTINCT entry_key, volume_id, entry_id, raw, {_VERDICT} AS verdict FROM entries WHERE raw IS NOT NULL),
    w AS (SELECT *, lead(verdict) OVER o AS nv, lead(raw) OVER o AS nr FROM e WINDOW o AS (PARTITION BY volume_id ORDER BY entry_id, entry_key))
    SELECT entry_key, CASE WHEN verdict = 'beginning' AND nv = 'end' THEN raw || ' ' || nr ELSE raw END AS raw FROM w WHERE verdict <> 'end'""")
def partial_stitch(spark, sf_dir):
    verdict = F.when(F.col("raw").endswith("."), "complete").when(F.col("raw").endswith(",") | F.col("raw").endswith("-"), "beginning").otherwise("end")
    e = table(spark, sf_dir, "entries").filter(F.col("raw").isNotNull()).select("entry_key", "volume_id", "entry_id", "raw").distinct().withColumn("verdict", verdict)
    return repair.stitched(e, "volume_id", ["entry_id", "entry_key"], "verdict", "raw").select("entry_key", "raw")


@query("""WITH e AS (SELECT DISTINCT entry_key, volume_id, entry_id, strftime(loaded_at, '%Y-%m-%d') AS day FROM entries)
    SELECT entry_key, coalesce(day, last_value(day IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || '/' || first_value(day IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS filled
    FROM e WINDOW o AS (PARTITION BY volume_id ORDER BY entry_id, entry_key)""")
def date_backfill(spark, sf_dir):
    e = table(spark, sf_dir, "entries").select("entry_key", "volume_id", "entry_id", F.date_format("loaded_at", "yyyy-MM-dd").alias("day")).distinct()
    return repair.back_filled(e, "volume_id", ["entry_id", "entry_key"], "day", "filled").select("entry_key", "filled")


_DATE_TEXT = "CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y') WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m') WHEN '5-LOW' THEN strftime(o_orderdate, '%Y-%m') || '-__' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query(f"""WITH t AS (SELECT o_orderkey, {_DATE_TEXT} AS d FROM orders),
    p AS (SELECT o_orderkey, d, try_cast(split_part(d, '-', 1) AS INT) AS y, try_cast(split_part(d, '-', 2) AS INT) AS m, try_cast(split_part(d, '-', 3) AS INT) AS dd FROM t),
    q AS (SELECT o_orderkey, d, printf('%04d-%02d-%02d', y, coalesce(m, 1), coalesce(dd, 1)) AS first_day,
        printf('%04d-%02d-%02d', y, coalesce(m, 12), coalesce(dd, [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][coalesce(m, 12)])) AS last_day FROM p)
    SELECT o_orderkey, d, first_day, last_day, first_day || '/' || last_day AS span FROM q""")
def date_complete(spark, sf_dir):
    day = lambda f: F.date_format("o_orderdate", f)
    d = F.when(F.col("o_orderpriority") == "1-URGENT", day("yyyy")).when(F.col("o_orderpriority") == "2-HIGH", day("yyyy-MM")).when(F.col("o_orderpriority") == "5-LOW", F.concat(day("yyyy-MM"), F.lit("-__"))).otherwise(day("yyyy-MM-dd"))
    t = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d")).withColumn("p", dates.parse_date(F.col("d")))
    t = t.withColumn("first_day", dates.start_of(F.col("p"))).withColumn("last_day", dates.end_of(F.col("p")))
    return t.select("o_orderkey", "d", "first_day", "last_day", F.concat_ws("/", "first_day", "last_day").alias("span"))


@query("""WITH w AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS a, strftime(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), '%Y-%m-%d') AS b FROM orders)
    SELECT o_orderkey, list_transform(string_split(a, '-'), lambda x: x::INT) <= list_transform(string_split(b, '-'), lambda x: x::INT) AS in_order FROM w""")
def date_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("p", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return o.select("o_orderkey", dates.not_after(dates.parse_date(F.date_format("o_orderdate", "yyyy-MM")), dates.parse_date(F.date_format("p", "yyyy-MM-dd"))).alias("in_order"))


@query("""WITH e AS (SELECT DISTINCT entry_key, volume_id, split_part(entry_id, '-', 1) AS image FROM entries)
    SELECT entry_key, lpad(row_number() OVER (PARTITION BY volume_id, image ORDER BY entry_key)::VARCHAR, 2, '0') AS number FROM e""")
def entry_numbering(spark, sf_dir):
    e = table(spark, sf_dir, "entries").select("entry_key", "volume_id", text.before_dash(F.col("entry_id")).alias("image")).distinct()
    return entity.entry_numbers(e, ["volume_id", "image"], ["entry_key"], "number").select("entry_key", "number")


@query("""WITH m AS (SELECT DISTINCT mention_id, len(relationships) AS n FROM person_mentions WHERE len(relationships) > 0)
    SELECT mention_id, mention_id || '-E' || lpad(i::VARCHAR, 2, '0') AS event_id FROM (SELECT mention_id, unnest(range(n)) AS i FROM m)""")
def event_ids(spark, sf_dir):
    m = table(spark, sf_dir, "person_mentions").select("mention_id", "relationships").filter(F.size("relationships") > 0).distinct()
    return m.select("mention_id", F.explode(entity.event_ids(F.col("mention_id"), F.col("relationships"))).alias("event_id"))


# -- json and repair -------------------------------------------------------------------------------------------------


@query("""SELECT event_id, json_valid(props) AND json_exists(props, '$.k') AS ok, json_extract_string(props, '$.k') AS k FROM events""")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", repair.valid_json(F.col("props"), "k").alias("ok"), F.get_json_object("props", "$.k").alias("k"))


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, sf_dir, "person_mentions").select("entry_key", "person_id", "relationships").distinct()
    edges = m.select("entry_key", "person_id", F.posexplode("relationships").alias("pos", "r")).select("entry_key", "person_id", "pos", F.col("r.related_person").alias("related_person"), F.col("r.relationship_type").alias("relationship_type"))
    return edges, m.select("entry_key", "person_id").distinct()


_EDGES = """m AS (SELECT DISTINCT entry_key, person_id, relationships FROM person_mentions), people AS (SELECT DISTINCT entry_key, person_id FROM m),
    e AS (SELECT entry_key, person_id, i - 1 AS pos, relationships[i].related_person AS related_person, relationships[i].relationship_type AS relationship_type
          FROM (SELECT *, unnest(range(1, len(relationships) + 1)) AS i FROM m WHERE len(relationships) > 0))"""
_TYPES = "('parent', 'child', 'enslaver', 'slave', 'spouse', 'godparent', 'godchild')"
_PROBLEM = f"""CASE WHEN related_person IS NULL THEN 'missing related_person' WHEN relationship_type IS NULL THEN 'missing relationship_type'
    WHEN relationship_type NOT IN {_TYPES} THEN 'invalid relationship_type' WHEN p.person_id IS NULL THEN 'unknown person' END"""


@query(f"""WITH {_EDGES} SELECT e.entry_key, e.person_id, e.pos::INT AS pos, {_PROBLEM} AS problem FROM e LEFT JOIN people p ON p.entry_key = e.entry_key AND p.person_id = e.related_person""")
def edge_validation(spark, sf_dir):
    edges, people = _edges(spark, sf_dir)
    return repair.edge_problems(edges, "entry_key", "person_id", "related_person", "relationship_type", people.withColumnRenamed("person_id", "known"), "known").select("entry_key", "person_id", "pos", "problem")


@query(f"""WITH {_EDGES} SELECT problem, count(*) AS n FROM (SELECT {_PROBLEM} AS problem FROM e LEFT JOIN people p ON p.entry_key = e.entry_key AND p.person_id = e.related_person) WHERE problem IS NOT NULL GROUP BY problem""")
def failure_summary(spark, sf_dir):
    return edge_validation(spark, sf_dir).filter(F.col("problem").isNotNull()).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


_INV = "CASE {0} WHEN 'parent' THEN 'child' WHEN 'child' THEN 'parent' WHEN 'enslaver' THEN 'slave' WHEN 'slave' THEN 'enslaver' WHEN 'spouse' THEN 'spouse' WHEN 'godparent' THEN 'godchild' WHEN 'godchild' THEN 'godparent' END"


@query(f"""WITH {_EDGES}, lead AS (SELECT DISTINCT entry_key, person_id FROM person_mentions WHERE age = 'infant'),
    last AS (SELECT entry_key AS s, person_id AS a, related_person AS b, arg_max(relationship_type, pos) AS r FROM e WHERE person_id IS NOT NULL AND related_person IS NOT NULL AND person_id <> related_person GROUP BY ALL),
    j AS (SELECT l.s, l.a, l.b, l.r, k.r AS rb, pa.person_id IS NOT NULL AS la, pb.person_id IS NOT NULL AS lb FROM last l LEFT JOIN last k ON k.s = l.s AND k.a = l.b AND k.b = l.a
          LEFT JOIN lead pa ON pa.entry_key = l.s AND pa.person_id = l.a LEFT JOIN lead pb ON pb.entry_key = l.s AND pb.person_id = l.b),
    f AS (SELECT *, la AND (NOT lb OR a <= b) AS first_a, r IN ('child', 'slave', 'godchild') AS dep, CASE WHEN rb IS NULL THEN 'one way' WHEN rb = {_INV.format('r')} THEN 'kept' WHEN rb <> r OR NOT (la OR lb) THEN 'dropped' ELSE 'rewritten' END AS fate FROM j)
    SELECT s AS entry_key, a AS person_id, b AS related_person, r AS relationship_type, 'kept' AS fate FROM f WHERE fate IN ('kept', 'one way')
    UNION ALL SELECT s, b, a, {_INV.format('r')}, 'added' FROM f WHERE fate = 'one way'
    UNION ALL SELECT s, a, b, CASE WHEN first_a = dep THEN {_INV.format('r')} ELSE r END, fate FROM f WHERE fate = 'rewritten'""".replace("CASE WHEN first_a = dep THEN", "CASE WHEN (first_a AND dep) OR (NOT first_a AND NOT dep) THEN"))
def reciprocity_repair(spark, sf_dir):
    edges, _ = _edges(spark, sf_dir)
    lead = table(spark, sf_dir, "person_mentions").filter(F.col("age") == "infant").select("entry_key", F.col("person_id").alias("lead"))
    return repair.reciprocal(edges, "entry_key", "person_id", "related_person", "relationship_type", lead, "lead")


@query("""WITH m AS (SELECT DISTINCT mention_key, entry_key, person_id, relationships FROM person_mentions), ids AS (SELECT entry_key, person_id, min(mention_key)::VARCHAR AS new FROM m GROUP BY ALL),
    r AS (SELECT mention_key, entry_key, unnest(relationships).related_person AS ref FROM m WHERE len(relationships) > 0)
    SELECT mention_key, coalesce(new, ref) AS ref FROM r LEFT JOIN ids ON ids.entry_key = r.entry_key AND ids.person_id = r.ref""")
def id_remap(spark, sf_dir):
    m = table(spark, sf_dir, "person_mentions").select("mention_key", "entry_key", "person_id", "relationships").distinct()
    ids = m.groupBy("entry_key", "person_id").agg(F.min("mention_key").cast("string").alias("new"))
    refs = m.select("mention_key", "entry_key", F.explode("relationships").alias("r")).select("mention_key", "entry_key", F.col("r.related_person").alias("ref"))
    return entity.remapped(refs, "entry_key", "ref", ids, "person_id", "new").select("mention_key", "ref")


# -- entities --------------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT DISTINCT mention_key, volume_id, name FROM person_mentions WHERE name IS NOT NULL),
    g AS (SELECT volume_id, name, min(mention_key) AS first_key, count(*) AS mentions FROM m GROUP BY ALL)
    SELECT volume_id, name, mentions, volume_id::VARCHAR || '-P' || lpad(row_number() OVER (PARTITION BY volume_id ORDER BY first_key)::VARCHAR, 5, '0') AS cluster_id FROM g""")
def cluster_ids(spark, sf_dir):
    m = table(spark, sf_dir, "person_mentions").filter(F.col("name").isNotNull()).select("mention_key", "volume_id", "name").distinct()
    groups = m.groupBy("volume_id", "name").agg(F.min("mention_key").alias("first_key"), F.count(F.lit(1)).alias("mentions"))
    return entity.numbered(groups, "volume_id", ["first_key"], "cluster_id").select("volume_id", "name", "mentions", "cluster_id")


@query("""WITH r AS (SELECT DISTINCT group_id, record_key, name, occupation, titles FROM person_records WHERE group_id IS NOT NULL),
    n AS (SELECT group_id, string_agg(name, '|' ORDER BY k) AS v FROM (SELECT group_id, name, min(record_key) AS k FROM r WHERE name IS NOT NULL GROUP BY ALL) GROUP BY 1),
    o AS (SELECT group_id, string_agg(occupation, '|' ORDER BY k) AS v FROM (SELECT group_id, occupation, min(record_key) AS k FROM r WHERE occupation IS NOT NULL GROUP BY ALL) GROUP BY 1),
    t AS (SELECT group_id, string_agg(t, '|' ORDER BY k) AS v FROM (SELECT group_id, titles[i] AS t, min({'k': record_key, 'i': i}) AS k FROM (SELECT *, unnest(range(1, len(titles) + 1)) AS i FROM r WHERE len(titles) > 0) WHERE titles[i] IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
    SELECT g.group_id, coalesce(n.v, '') AS names, coalesce(o.v, '') AS occupations, coalesce(t.v, '') AS titles
    FROM (SELECT group_id FROM n UNION SELECT group_id FROM o UNION SELECT group_id FROM t) g LEFT JOIN n USING (group_id) LEFT JOIN o USING (group_id) LEFT JOIN t USING (group_id)""")
def merge_attributes(spark, sf_dir):
    r = table(spark, sf_dir, "person_records").filter(F.col("group_id").isNotNull()).select("group_id", "record_key", "name", "occupation", "titles").distinct()
    out = entity.folded(r, ["group_id"], ["record_key"], ["name", "occupation"], ["titles"])
    return out.select("group_id", F.array_join("name", "|").alias("names"), F.array_join("occupation", "|").alias("occupations"), F.array_join("titles", "|").alias("titles"))


@query("""WITH v AS (SELECT unnest(vocab) AS t FROM vocabulary WHERE vocab_key = 'phenotype')
    SELECT phenotype, count(DISTINCT mention_key) AS n FROM person_mentions WHERE phenotype IS NOT NULL AND phenotype NOT IN (SELECT t FROM v) GROUP BY 1""")
def vocab_conformance(spark, sf_dir):
    m = table(spark, sf_dir, "person_mentions").select("mention_key", "phenotype").distinct()
    return entity.outside_vocabulary(m, "phenotype", table(spark, sf_dir, "vocabulary"), "phenotype").groupBy("phenotype").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT DISTINCT mention_id, titles FROM person_mentions), v AS (SELECT vocab FROM vocabulary WHERE vocab_key = 'titles')
    SELECT mention_id, vocab[(('0x' || substr(md5(mention_id), 1, 8))::BIGINT % len(vocab)) + 1] AS term FROM m, v""")
def vocabulary_pick(spark, sf_dir):
    """A term for every mention, picked by a hash of its id; the list travels as a literal of checked size."""
    from libroflow.session import bounded

    rows = bounded(table(spark, sf_dir, "vocabulary").filter(F.col("vocab_key") == "titles").select(F.explode("vocab").alias("t")), "terms", 10_000)
    m = table(spark, sf_dir, "person_mentions").select("mention_id", "titles").distinct()
    return m.select("mention_id", entity.picked(F.col("mention_id"), [r[0] for r in rows]).alias("term"))


_FIRST_NAMES, _LAST_NAMES = ["Ana", "Juan", "Luisa", "Mateo", "Rosa"], ["Alba", "Cruz", "Luna"]


@query(f"""WITH m AS (SELECT DISTINCT mention_id FROM person_mentions)
    SELECT mention_id, {_FIRST_NAMES}[(('0x' || substr(md5('f' || mention_id), 1, 8))::BIGINT % 5) + 1] || ' ' || {_LAST_NAMES}[(('0x' || substr(md5('l' || mention_id), 1, 8))::BIGINT % 3) + 1] AS name, 'N/A' AS rank_title FROM m""")
def synthetic_people(spark, sf_dir):
    """Invented names by a hash of the id; a field without a list has none."""
    m, key = table(spark, sf_dir, "person_mentions").select("mention_id").distinct(), F.col("mention_id")
    return m.select("mention_id", F.concat_ws(" ", entity.picked(key, _FIRST_NAMES, "f"), entity.picked(key, _LAST_NAMES, "l")).alias("name"), entity.picked(key, []).alias("rank_title"))


@query("""WITH e AS (SELECT DISTINCT entry_key, entry_id, volume_id, CASE entry_key % 3 WHEN 0 THEN 'gray' ELSE 'bin' END AS colour FROM entries)
    SELECT entry_key AS image_id, entry_id, colour FROM e SEMI JOIN (SELECT volume_id FROM volumes WHERE record_type = 'baptism' OR country = 'Cuba') USING (volume_id) WHERE colour = 'gray' ORDER BY md5('3' || entry_key::VARCHAR), entry_key LIMIT 10""")
def line_examples(spark, sf_dir):
    """Ten images of one colour of the matching volumes."""
    e = table(spark, sf_dir, "entries").select(F.col("entry_key").alias("image_id"), "entry_id", "volume_id", F.when(F.col("entry_key") % 3 == 0, "gray").otherwise("bin").alias("colour")).distinct()
    return select.line_examples(e, table(spark, sf_dir, "volumes"), {"record_type": "baptism", "country": "Cuba"}, "or", "gray", 10, "3").select("image_id", "entry_id", "colour")


@query("""SELECT DISTINCT entry_id, 'https://images.example/' || entry_id || '-color-rgb.jpg' AS url FROM entries WHERE entry_id IS NOT NULL""")
def rgb_urls(spark, sf_dir):
    from libroflow.operators.provider import rgb_url

    e = table(spark, sf_dir, "entries").filter("entry_id is not null").select("entry_id").distinct()
    return e.select("entry_id", rgb_url(text.image_url("images.example", F.col("entry_id"))).alias("url"))


# -- evaluation ------------------------------------------------------------------------------------------------------

_INDEL = """CASE WHEN a = b THEN 1.0 ELSE 2.0 * list_reduce(string_split(a, ''), lambda p, ch: list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN substring(b, j::INT, 1) = ch THEN p[j] + 1 ELSE greatest(p[j + 1], acc[j]) END), [0]), list_transform(range(0, length(b) + 1), lambda z: 0))[-1] / (length(a) + length(b)) END"""
_FIRST = "WITH r AS (SELECT DISTINCT group_id, record_key, name, occupation, origin FROM person_records WHERE group_id IS NOT NULL), f AS (SELECT group_id, min(record_key) AS k FROM r GROUP BY 1), t AS (SELECT r.* FROM r JOIN f ON r.record_key = f.k)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record beside its group's first one."""
    r = table(spark, sf_dir, "person_records").filter(F.col("group_id").isNotNull()).select("group_id", "record_key", "name", "occupation", "origin").distinct()
    first = r.groupBy("group_id").agg(F.min_by(F.struct("name", "occupation", "origin"), "record_key").alias("truth"), F.min("record_key").alias("k"))
    return r.join(first, "group_id").filter(F.col("record_key") != F.col("k"))


@query(f"""{_FIRST}, p AS (SELECT r.record_key, t.name AS a, r.name AS b FROM r JOIN t USING (group_id) WHERE r.record_key <> t.record_key AND length(t.name) > 0 AND length(r.name) > 0)
    SELECT record_key, round({_INDEL}, 6) AS similarity FROM p""")
def indel_ratio(spark, sf_dir):
    p = _pairs(spark, sf_dir).filter((F.length("truth.name") > 0) & (F.length("name") > 0))
    return p.select("record_key", F.round(similarity.indel_ratio(F.col("truth.name"), F.col("name")), 6).alias("similarity"))


@query(f"""{_FIRST}, p AS (SELECT t.name AS a, r.name AS b FROM r JOIN t USING (group_id) WHERE r.record_key <> t.record_key AND length(t.name) > 0 AND length(r.name) > 0), s AS (SELECT {_INDEL} AS x FROM p)
    SELECT round(sum(x), 3) AS tp, round(sum(1 - x), 3) AS fp, count(x) AS n, round(avg(x), 6) AS f FROM s""")
def text_metric(spark, sf_dir):
    p = _pairs(spark, sf_dir).filter((F.length("truth.name") > 0) & (F.length("name") > 0)).select(F.col("truth.name").alias("a"), F.col("name").alias("b"))
    return evaluate.text_metric(p, "a", "b").select(F.round("tp", 3).alias("tp"), F.round("fp", 3).alias("fp"), "n", F.round("f", 6).alias("f"))


@query("SELECT DISTINCT mention_key, titles IS NULL OR len(titles) = 0 AS no_titles, relationships IS NULL OR len(relationships) = 0 AS no_links FROM person_mentions")
def empty_fields(spark, sf_dir):
    return table(spark, sf_dir, "person_mentions").select("mention_key", evaluate.is_empty(F.col("titles")).alias("no_titles"), evaluate.is_empty(F.col("relationships")).alias("no_links")).distinct()


@query(f"""{_FIRST}, l AS (SELECT 'occupation' AS field, t.occupation AS a, r.occupation AS b FROM r JOIN t USING (group_id) WHERE r.record_key <> t.record_key
        UNION ALL SELECT 'origin', t.origin, r.origin FROM r JOIN t USING (group_id) WHERE r.record_key <> t.record_key),
    s AS (SELECT field, coalesce(a, '') = '' AND coalesce(b, '') <> '' AS nf, a, b, CASE WHEN length(a) > 0 AND length(b) > 0 THEN {_INDEL} WHEN a = b THEN 1.0 ELSE 0.0 END AS sim FROM l),
    c AS (SELECT field, CASE WHEN nf THEN 0 WHEN a IS NOT NULL AND b IS NOT NULL THEN sim WHEN a IS NULL AND b IS NULL THEN 1 ELSE 0 END AS tp,
        CASE WHEN nf THEN 0 WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 - sim WHEN a IS NULL AND b IS NULL THEN 0 ELSE 1 END AS fp, CASE WHEN nf THEN 1 ELSE 0 END AS null_fp FROM s),
    g AS (SELECT field, sum(tp) AS tp, sum(fp) AS fp, sum(null_fp) AS null_fp FROM c GROUP BY 1)
    SELECT field, round(tp, 4) AS tp, round(fp, 4) AS fp, round(null_fp::DOUBLE, 4) AS null_fp, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fp), 4) AS f FROM g""")
def field_metrics(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    long = p.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"truth.{f}").alias("a"), F.col(f).alias("b")) for f in ("occupation", "origin")])).alias("x")).select("x.*")
    scored = long.select("field", evaluate.field_scores(F.col("a"), F.col("b"), F.lit(True), F.lit(True), similarity.indel_ratio(F.col("a"), F.col("b"))).alias("s")).select("field", "s.*")
    out = evaluate.micro(scored, ["field"])
    return out.select("field", *[F.round(c, 4).alias(c) for c in ("tp", "fp", "null_fp", "precision", "f")])


_BOXES = """raw_b AS (SELECT l_orderkey AS image, l_linenumber AS box_id, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity)::INT AS q, round(min(l_discount) * 100)::INT AS d FROM lineitem GROUP BY ALL),
    boxes AS (SELECT image, box_id, ((pk * 37) % 900)::BIGINT AS "left", ((sk * 53 + box_id * 90) % 1200)::BIGINT AS top, ((pk * 37) % 900 + 20 + q * 6)::BIGINT AS "right", ((sk * 53 + box_id * 90) % 1200 + 15 + d * 12)::BIGINT AS bottom FROM raw_b)"""
_IOU = """(greatest(0, least(a."right", b."right") - greatest(a."left", b."left")) * greatest(0, least(a.bottom, b.bottom) - greatest(a.top, b.top)))"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box_id")).agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_quantity").cast("int").alias("q"), F.round(F.min("l_discount") * 100).cast("int").alias("d"))
    left, top = (F.col("pk") * 37) % 900, (F.col("sk") * 53 + F.col("box_id") * 90) % 1200
    corners = geometry.to_corners(left, top, 20 + F.col("q") * 6, 15 + F.col("d") * 12)
    return li.withColumn("c", corners).select("image", "box_id", *[F.col(f"c.{x}").cast("bigint").alias(x) for x in ("left", "top", "right", "bottom")])


def _halves(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The odd boxes of an image as the truth, the even ones as found."""
    return boxes.filter("box_id % 2 = 1"), boxes.filter("box_id % 2 = 0")


@query(f"""WITH {_BOXES} SELECT a.image, a.box_id AS truth_id, b.box_id AS found_id, round({_IOU}::DOUBLE / ((a."right" - a."left") * (a.bottom - a.top) + (b."right" - b."left") * (b.bottom - b.top) - {_IOU}), 6) AS iou
    FROM boxes a JOIN boxes b ON a.image = b.image WHERE a.box_id % 2 = 1 AND b.box_id % 2 = 0 AND {_IOU} > 0""")
def iou_pairs(spark, sf_dir):
    truth, found = _halves(_boxes(spark, sf_dir))
    return evaluate.box_pairs(truth, found, "image").select("image", F.col("a.box_id").alias("truth_id"), F.col("b.box_id").alias("found_id"), F.round("iou", 6).alias("iou"))


@query(f"""WITH {_BOXES}, p AS (SELECT a.image, {_IOU}::DOUBLE / ((a."right" - a."left") * (a.bottom - a.top) + (b."right" - b."left") * (b.bottom - b.top) - {_IOU}) AS iou
        FROM boxes a JOIN boxes b ON a.image = b.image WHERE a.box_id % 2 = 1 AND b.box_id % 2 = 0 AND {_IOU} > 0),
    n AS (SELECT image, sum((box_id % 2 = 1)::INT) AS truths, sum((box_id % 2 = 0)::INT) AS found FROM boxes GROUP BY 1), h AS (SELECT image, count(*) AS hits FROM p WHERE iou > 0.1 GROUP BY 1)
    SELECT n.image, round(CASE WHEN found > 0 THEN coalesce(hits, 0) / found ELSE 0 END, 6) AS precision, round(CASE WHEN truths > 0 THEN coalesce(hits, 0) / truths ELSE 0 END, 6) AS recall FROM n LEFT JOIN h USING (image)""")
def box_metrics_nonexclusive(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    truth, found = _halves(boxes)
    hits = evaluate.box_pairs(truth, found, "image").filter("iou > 0.1").groupBy("image").agg(F.count(F.lit(1)).alias("hits"))
    n = boxes.groupBy("image").agg(F.sum((F.col("box_id") % 2 == 1).cast("int")).alias("truths"), F.sum((F.col("box_id") % 2 == 0).cast("int")).alias("found"))
    both = n.join(hits, "image", "left").fillna(0, ["hits"])
    return both.select("image", F.round(evaluate.ratio(F.col("hits"), F.col("found")), 6).alias("precision"), F.round(evaluate.ratio(F.col("hits"), F.col("truths")), 6).alias("recall"))


@query(f"""WITH RECURSIVE {_BOXES}, t AS (SELECT image, box_id, row_number() OVER (PARTITION BY image ORDER BY box_id) AS k, b AS box FROM (SELECT image, box_id, {{'l': "left", 't': top, 'r': "right", 'b': bottom}} AS b FROM boxes WHERE box_id % 2 = 1)),
    f AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY box_id) AS k, {{'l': "left", 't': top, 'r': "right", 'b': bottom}} AS box FROM boxes WHERE box_id % 2 = 0),
    o AS (SELECT f.image, f.k AS fk, t.k AS tk FROM f JOIN t USING (image), LATERAL (SELECT greatest(0, least(f.box.r, t.box.r) - greatest(f.box.l, t.box.l)) * greatest(0, least(f.box.b, t.box.b) - greatest(f.box.t, t.box.t)) AS i) x
          WHERE i::DOUBLE / nullif((f.box.r - f.box.l) * (f.box.b - f.box.t) + (t.box.r - t.box.l) * (t.box.b - t.box.t) - i, 0) >= 0.1),
    n AS (SELECT f.image, f.k AS fk, list_sort(coalesce(list(o.tk) FILTER (o.tk IS NOT NULL), [])) AS ts FROM f LEFT JOIN o ON o.image = f.image AND o.fk = f.k GROUP BY ALL),
    g(image, fk, used) AS (SELECT image, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT image FROM f)
        UNION ALL SELECT g.image, n.fk, CASE WHEN len(list_filter(n.ts, lambda x: NOT list_contains(g.used, x))) > 0 THEN list_append(g.used, list_filter(n.ts, lambda x: NOT list_contains(g.used, x))[1]) ELSE g.used END FROM g JOIN n ON n.image = g.image AND n.fk = g.fk + 1)
    SELECT image, max(len(used))::INT AS matches FROM g GROUP BY image""")
def box_metrics_greedy(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    shape = F.struct("box_id", "left", "top", "right", "bottom")
    each = boxes.groupBy("image").agg(F.array_sort(F.collect_list(F.when(F.col("box_id") % 2 == 1, shape))).alias("truth"), F.array_sort(F.collect_list(F.when(F.col("box_id") % 2 == 0, shape))).alias("found"))
    return each.filter(F.size("found") > 0).select("image", evaluate.greedy_matches(F.col("truth"), F.col("found"), 0.1).alias("matches"))


@query(f"""WITH {_BOXES}, w AS (SELECT image, box_id, "right" - "left" AS w, coalesce(max(CASE WHEN bottom - top <= 3 * ("right" - "left") THEN "right" - "left" END) OVER (PARTITION BY image), 0) AS m FROM boxes)
    SELECT image, box_id FROM w WHERE w BETWEEN m - 50 AND m + 50""")
def width_band_filter(spark, sf_dir):
    return select.width_band(_boxes(spark, sf_dir), "image").select("image", "box_id")


@query(f"""WITH {_BOXES} SELECT b.image, b.box_id, ("right" - "left") * (bottom - top) > 25000 OR EXISTS (SELECT 1 FROM boxes a WHERE a.image = b.image AND (a."right" - a."left") * (a.bottom - a.top) > 25000
    AND b."left" >= a."left" AND b."right" <= a."right" AND b.top >= a.top AND b.bottom <= a.bottom) AS other FROM boxes b""")
def containment_filter(spark, sf_dir):
    return layout.contained(_boxes(spark, sf_dir), "image", 25000).select("image", "box_id", "other")


@query(f"""WITH {_BOXES} SELECT image, box_id, (bottom - top) > 5.0 * ("right" - "left") OR ("right" - "left") > 5.0 * (bottom - top) AS odd, (bottom - top) > 50 AND ("right" - "left") > 50 AS big FROM boxes""")
def aspect_filter(spark, sf_dir):
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    return _boxes(spark, sf_dir).select("image", "box_id", layout.tall_or_wide(w, h).alias("odd"), ((h > 50) & (w > 50)).alias("big"))


@query(f"""WITH {_BOXES} SELECT image, min("left") AS x0, min(top) AS y0, max("right") AS x1, max(bottom) AS y1, sum(("right" - "left") * (bottom - top))::BIGINT AS pixels, count(*) AS n FROM boxes GROUP BY image""")
def region_hull(spark, sf_dir):
    return _boxes(spark, sf_dir).groupBy("image").agg(F.min("left").alias("x0"), F.min("top").alias("y0"), F.max("right").alias("x1"), F.max("bottom").alias("y1"), F.sum((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))).alias("pixels"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BOXES}, c AS (SELECT image, least(greatest(floor(("left" + "right") / 2.0 / 125.0), 0), 9)::INT AS bin, count(*) AS n FROM boxes GROUP BY ALL),
    g AS (SELECT image, unnest(range(10))::INT AS bin FROM (SELECT DISTINCT image FROM boxes))
    SELECT g.image, g.bin, round(coalesce(n, 0) / max(coalesce(n, 0)) OVER (PARTITION BY g.image), 6) AS density FROM g LEFT JOIN c ON c.image = g.image AND c.bin = g.bin""")
def xdensity_bins(spark, sf_dir):
    return layout.x_density(_boxes(spark, sf_dir), "image", 1250, 10).select("image", "bin", F.round("density", 6).alias("density"))


@query(f"""WITH {_BOXES}, s AS (SELECT image, y, sum(d)::BIGINT AS d FROM (SELECT image, top AS y, 1 AS d FROM boxes UNION ALL SELECT image, bottom, -1 FROM boxes) GROUP BY ALL),
    w AS (SELECT image, y, (sum(d) OVER (PARTITION BY image ORDER BY y))::BIGINT AS n, lead(y) OVER (PARTITION BY image ORDER BY y) AS z FROM s)
    SELECT image, y AS top, z AS bottom, n FROM w WHERE n > 0""")
def row_density(spark, sf_dir):
    return layout.row_density(_boxes(spark, sf_dir), "image")


@query(f"""WITH {_BOXES}, u AS (SELECT image, unnest(range("left" // 200, ("right" - 1) // 200 + 1)) AS tx, top, bottom FROM boxes WHERE bottom > top), t AS (SELECT image, tx, unnest(range(top // 200, (bottom - 1) // 200 + 1)) AS ty FROM u)
    SELECT image, tx, ty, count(*) AS n FROM t GROUP BY ALL HAVING count(*) < 3""")
def tile_coverage(spark, sf_dir):
    b = _boxes(spark, sf_dir).filter("bottom > top")
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / 200), F.floor((F.col(hi) - 1) / 200))
    tiles = b.withColumn("tx", F.explode(span("left", "right"))).withColumn("ty", F.explode(span("top", "bottom")))
    return tiles.groupBy("image", "tx", "ty").agg(F.count(F.lit(1)).alias("n")).filter("n < 3")


@query(f"""WITH {_BOXES}, g AS (SELECT image, top, lead(top) OVER (PARTITION BY image ORDER BY top) - top AS gap FROM (SELECT DISTINCT image, top FROM boxes)), m AS (SELECT *, avg(gap) OVER (PARTITION BY image) AS a FROM g)
    SELECT image, top, gap FROM m WHERE gap >= 1.5 * a""")
def paragraph_breaks(spark, sf_dir):
    return layout.paragraph_breaks(_boxes(spark, sf_dir).select("image", "top").distinct(), "image", "top", 1.5).select("image", "top", "gap")


@query(f"""WITH {_BOXES}, g AS (SELECT image, top, lead(top) OVER (PARTITION BY image ORDER BY top) - top AS gap FROM (SELECT DISTINCT image, top FROM boxes)), m AS (SELECT *, avg(gap) OVER (PARTITION BY image) AS a FROM g),
    k AS (SELECT image, top + gap // 2 AS y FROM m WHERE gap >= 1.5 * a),
    e AS (SELECT b.image, b.box_id, unnest(list_sort(list_distinct(list_concat([b.top, b.bottom], coalesce(list(k.y) FILTER (k.y > b.top AND k.y < b.bottom), []))))) AS y FROM boxes b LEFT JOIN k USING (image) GROUP BY b.image, b.box_id, b.top, b.bottom)
    SELECT image, box_id, y AS top, z AS bottom FROM (SELECT image, box_id, y, lead(y) OVER (PARTITION BY image, box_id ORDER BY y) AS z FROM e) WHERE z IS NOT NULL""")
def cut_rectangles(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    cuts = layout.paragraph_breaks(boxes.select("image", "top").distinct(), "image", "top", 1.5).select("image", (F.col("top") + F.floor(F.col("gap") / 2)).alias("y"))
    return layout.cut_boxes(boxes, cuts, "image", "y").select("image", "box_id", "top", "bottom")


# Each round every box grows to the hull of those near it; those of one group end as one hull.
_HULLS = ", ".join(f"""h{i} AS (SELECT DISTINCT a.image, min(b.x0) AS x0, min(b.y0) AS y0, max(b.x1) AS x1, max(b.y1) AS y1 FROM h{i - 1} a JOIN h{i - 1} b ON a.image = b.image AND a.x0 <= b.x1 + 20 AND b.x0 <= a.x1 + 20 AND a.y0 <= b.y1 + 20 AND b.y0 <= a.y1 + 20 GROUP BY a.image, a.x0, a.y0, a.x1, a.y1)""" for i in range(1, 13))


@query(f"""WITH {_BOXES}, h0 AS (SELECT DISTINCT image, "left" AS x0, top AS y0, "right" AS x1, bottom AS y1 FROM boxes), {_HULLS} SELECT image, x0, y0, x1, y1 FROM h12""")
def merged_boxes(spark, sf_dir):
    return layout.merged_boxes(_boxes(spark, sf_dir), "image", 20).toDF("image", "x0", "y0", "x1", "y1")


@query(None)
def adaptive_boxes(spark, sf_dir):
    return layout.adaptively_merged(_boxes(spark, sf_dir), "image").toDF("image", "threshold", "x0", "y0", "x1", "y1")


@query(f"""WITH {_BOXES}, g AS (SELECT image, top, "right" - "left" AS d FROM boxes QUALIFY row_number() OVER (PARTITION BY image, top ORDER BY box_id) = 1),
    s AS (SELECT *, row_number() OVER w AS n, lead(top) OVER w - top AS gap, lead(d) OVER w AS nd FROM g WINDOW w AS (PARTITION BY image ORDER BY top)), m AS (SELECT *, avg(gap) OVER (PARTITION BY image) AS mg, avg(d) OVER (PARTITION BY image) AS md FROM s),
    f AS (SELECT *, n - row_number() OVER (PARTITION BY image ORDER BY top) AS run FROM m WHERE gap >= 1.5 * mg OR nd < 0.5 * md), k AS (SELECT *, row_number() OVER w AS i, lead(top) OVER w IS NULL AS last FROM f WINDOW w AS (PARTITION BY image, run ORDER BY top))
    SELECT image, top FROM k WHERE i % 2 = 0 OR last""")
def column_breaks(spark, sf_dir):
    """Breaks by gap or by density, the width of a line's first box standing for its density."""
    lines = _boxes(spark, sf_dir).groupBy("image", "top").agg(F.min_by(F.col("right") - F.col("left"), "box_id").alias("density"))
    return layout.column_breaks(lines, "image", "top", "density", 1.5, 0.5)


@query(f"""WITH {_BOXES}, c AS (SELECT DISTINCT image, top AS c, max(bottom) OVER (PARTITION BY image) AS e FROM boxes),
    s AS (SELECT image, coalesce(lag(c) OVER w, 0) AS t, c, e, lead(c) OVER w IS NULL AS last FROM c WINDOW w AS (PARTITION BY image ORDER BY c)), h AS (SELECT * FROM s WHERE c - t >= 40)
    SELECT image, t AS top, c AS bottom FROM h UNION ALL SELECT image, c, e FROM h WHERE last AND e - c >= 40""")
def line_strips(spark, sf_dir):
    return layout.line_strips(_boxes(spark, sf_dir), "image", "top", "bottom", 40)


@query(f"""WITH {_BOXES}, a AS (SELECT * FROM boxes WHERE box_id % 2 = 1), b AS (SELECT * FROM boxes WHERE box_id % 2 = 0), s AS (SELECT a.image, sum({_IOU}) AS shared FROM a JOIN b ON a.image = b.image GROUP BY 1),
    t AS (SELECT image, sum(CASE WHEN box_id % 2 = 1 THEN ("right" - "left") * (bottom - top) ELSE 0 END) AS truth, sum(CASE WHEN box_id % 2 = 0 THEN ("right" - "left") * (bottom - top) ELSE 0 END) AS found FROM boxes GROUP BY 1),
    p AS (SELECT image, CASE WHEN found > 0 THEN coalesce(shared, 0) / found ELSE 0 END AS p, CASE WHEN truth > 0 THEN coalesce(shared, 0) / truth ELSE 0 END AS r FROM t LEFT JOIN s USING (image))
    SELECT image, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(CASE WHEN p = 0 OR r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)::DOUBLE AS f FROM p""")
def area_scores(spark, sf_dir):
    """Precision and recall of areas, the odd boxes of an image as the truth."""
    boxes = _boxes(spark, sf_dir)
    truth, found = _halves(boxes)
    shared = evaluate.overlapping(truth, found, "image").groupBy("image").agg(F.sum(geometry.box_overlap(F.col("a"), F.col("b"))).alias("shared"))
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    sums = boxes.groupBy("image").agg(F.sum(F.when(F.col("box_id") % 2 == 1, area).otherwise(0)).alias("truth"), F.sum(F.when(F.col("box_id") % 2 == 0, area).otherwise(0)).alias("found"))
    scores = geometry.area_scores(F.coalesce("shared", F.lit(0)), F.col("truth"), F.col("found"))
    return sums.join(shared, "image", "left").withColumn("s", scores).select("image", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f")])


@query(f"""WITH {_BOXES} SELECT image, box_id, gcd("right" - "left", bottom - top) AS g, ("left" * 0.75)::DOUBLE AS exact, trunc("left" * 0.75)::INT AS scaled FROM boxes""")
def gcd_and_scale(spark, sf_dir):
    return _boxes(spark, sf_dir).select("image", "box_id", geometry.gcd(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")).alias("g"), (F.col("left") * F.lit(0.75)).alias("exact"), geometry.scale(F.col("left"), F.lit(0.75)).alias("scaled"))


# -- pixels and signals ----------------------------------------------------------------------------------------------

_PIXELS = """pixels AS (SELECT vec_id AS image, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    bars AS (SELECT image, quantile_cont(v, 0.1) AS q FROM pixels GROUP BY 1), bw AS (SELECT p.image, y, x, v, v < q AS black FROM pixels p JOIN bars USING (image))"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "v")).select("image", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


@query(f"WITH {_PIXELS} SELECT image, y, round(sum(v), 6) AS total FROM pixels GROUP BY ALL")
def row_sums(spark, sf_dir):
    return layout.row_sums(_pixels(spark, sf_dir), "image", "y", "v").withColumn("total", F.round("total", 6))


@query(f"WITH {_PIXELS} SELECT image, y, x, black FROM bw")
def quantile_binarize(spark, sf_dir):
    return layout.binarized(_pixels(spark, sf_dir), "image", "v").select("image", "y", "x", "black")


_COLOURS = "col AS (SELECT image, CASE WHEN count(DISTINCT v) <= 2 THEN 'bin' WHEN stddev_pop(v) < 0.125 THEN 'gray' ELSE 'semi-bin' END AS colour FROM pixels GROUP BY 1)"


@query(f"WITH {_PIXELS}, {_COLOURS} SELECT image, colour FROM col")
def binarized_colour(spark, sf_dir):
    return layout.colours(_pixels(spark, sf_dir), "image", "v", 0.125)


@query(f"""WITH {_PIXELS}, {_COLOURS}, f AS (SELECT label, image, colour, row_number() OVER (PARTITION BY label ORDER BY image) AS k FROM col JOIN embeddings ON vec_id = image)
    SELECT label, CASE WHEN count(DISTINCT colour) = 1 THEN min(colour) ELSE 'gray' END AS colour FROM f WHERE k <= 2 GROUP BY label""")
def folder_colour(spark, sf_dir):
    files = layout.colours(_pixels(spark, sf_dir), "image", "v", 0.125).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), "label"), "image")
    return layout.folder_colours(files, "label", "image", "colour")


_HISTOGRAM = """f AS (SELECT image, y // 2 AS ty, x, sum(black::INT) > 0.2 AS black FROM bw GROUP BY ALL), s AS (SELECT image, ty, x // 2 AS tx, sum(black::INT) > 0.2 AS black FROM f GROUP BY ALL),
    hist AS (SELECT image, tx, sum((NOT black)::INT)::BIGINT AS white FROM s GROUP BY ALL)"""


@query(f"WITH {_PIXELS}, {_HISTOGRAM} SELECT image, tx::BIGINT AS tx, white FROM hist")
def tile_histogram(spark, sf_dir):
    return layout.tile_histogram(layout.binarized(_pixels(spark, sf_dir), "image", "v"), "image", 2)


_COUNTS = """c AS (SELECT user_id, date_diff('hour', TIMESTAMP '2024-01-01', ts)::BIGINT AS hour, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL)"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600)
    return table(spark, sf_dir, "events").groupBy("user_id", hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {_COUNTS}, t AS (SELECT user_id, avg(n) + 1.2 * stddev_pop(n) AS bar FROM c GROUP BY 1),
    s AS (SELECT c.user_id, hour, coalesce(last_value(CASE WHEN n > bar THEN 1 WHEN n < bar THEN 0 END IGNORE NULLS) OVER (PARTITION BY c.user_id ORDER BY hour), 0) AS high FROM c JOIN t USING (user_id)),
    l AS (SELECT *, coalesce(lag(high) OVER (PARTITION BY user_id ORDER BY hour), 0) AS was FROM s),
    f AS (SELECT *, coalesce(max(CASE WHEN was = 1 AND high = 0 THEN hour END) OVER (PARTITION BY user_id ORDER BY hour), 0) AS lft FROM l)
    SELECT user_id, lft AS first_hour, hour AS next_hour FROM f WHERE was = 0 AND high = 1 AND lft <> hour""")
def spaces(spark, sf_dir):
    return layout.spaces(_hours(spark, sf_dir), "user_id", "hour", "n").select("user_id", F.col("start").alias("first_hour"), F.col("end").alias("next_hour"))


@query(f"""WITH {_COUNTS}, k AS (SELECT user_id, hour, hour - row_number() OVER (PARTITION BY user_id ORDER BY hour) AS island FROM c)
    SELECT user_id, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS length FROM k GROUP BY user_id, island HAVING count(*) >= 2""")
def signature_runs(spark, sf_dir):
    return layout.runs(_hours(spark, sf_dir), "user_id", "hour", F.col("n") > 0, 2).select("user_id", F.col("start").alias("first_hour"), F.col("end").alias("last_hour"), "length")


@query(f"""WITH {_COUNTS} SELECT user_id, hour, round(sum(total) OVER (PARTITION BY user_id ORDER BY hour ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 4) AS smooth FROM c""")
def smoothing(spark, sf_dir):
    return layout.smoothed(_hours(spark, sf_dir), "user_id", "hour", "total", 2, "smooth").select("user_id", "hour", F.round("smooth", 4).alias("smooth"))


@query(f"""WITH {_COUNTS}, d AS (SELECT user_id, hour, lead(n) OVER (PARTITION BY user_id ORDER BY hour) - n AS step FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(step) DESC, hour) AS rank FROM d WHERE step IS NOT NULL)
    SELECT user_id, hour, step, rank::INT AS rank FROM r WHERE rank <= 2""")
def diff_top2(spark, sf_dir):
    return layout.biggest_steps(_hours(spark, sf_dir), "user_id", "hour", "n", 2).select("user_id", "hour", "step", "rank")


@query(f"""WITH {_COUNTS}, w AS (SELECT user_id, hour, total, lag(total) OVER o AS a, lead(total) OVER o AS b FROM c WINDOW o AS (PARTITION BY user_id ORDER BY hour)) SELECT user_id, hour, total FROM w WHERE total > a AND total > b""")
def local_peaks(spark, sf_dir):
    return layout.local_peaks(_hours(spark, sf_dir), "user_id", "hour", "total").select("user_id", "hour", "total")


@query(None)
def prominent_peaks(spark, sf_dir):
    return layout.prominent_peaks(_hours(spark, sf_dir), "user_id", "hour", "total", 2, 5.0, 2, 20)


@query(f"""WITH {_COUNTS}, r AS (SELECT user_id, hour, total, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, hour) AS k FROM c) SELECT user_id, hour, total FROM r WHERE k = 1""")
def best_candidate(spark, sf_dir):
    return layout.best_of(_hours(spark, sf_dir), "user_id", "hour", "total")


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), m AS (SELECT user_id, n / (max(n) OVER ()) AS d FROM c) SELECT user_id, trunc(255 * (1 - d))::INT AS blue, trunc(255 * d)::INT AS red FROM m""")
def density_colours(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    top = c.agg(F.max("n")).first()[0] or 1  # one number
    return c.select("user_id", geometry.ramp(F.col("n") / F.lit(top)).alias("c")).select("user_id", "c.blue", "c.red")


# -- page components -------------------------------------------------------------------------------------------------

_SIDES = """sided AS (SELECT *, ['unbound', 'recto', 'verso'][(image % 3 + 1)::INT] AS side FROM boxes)"""
_LABELS = f"""{_SIDES}, cnt AS (SELECT image, least(greatest(floor(("left" + "right") / 2.0 / 62.5), 0), 19)::INT AS bin, count(*) AS n FROM boxes GROUP BY ALL),
    grid AS (SELECT image, side, unnest(range(20))::INT AS bin FROM (SELECT DISTINCT image, side FROM sided)),
    dens AS (SELECT g.image, g.side, g.bin, coalesce(n, 0) / max(coalesce(n, 0)) OVER (PARTITION BY g.image) AS d FROM grid g LEFT JOIN cnt c ON c.image = g.image AND c.bin = g.bin),
    stp AS (SELECT image, side, bin, lead(d) OVER (PARTITION BY image ORDER BY bin) - d AS step FROM dens),
    zon AS (SELECT *, CASE WHEN bin < CASE WHEN side = 'unbound' THEN 10 ELSE 6 END THEN 'left' WHEN side = 'verso' AND bin >= 13 THEN 'right' END AS zone FROM stp WHERE step IS NOT NULL),
    rnk AS (SELECT *, CASE WHEN side = 'recto' OR zone = 'right' THEN 2 ELSE 1 END AS wanted, row_number() OVER (PARTITION BY image, zone ORDER BY abs(step) DESC, bin) AS k
            FROM zon WHERE zone IS NOT NULL AND (side = 'recto' OR zone = 'right' OR abs(step) > 0)),
    cut AS (SELECT image, list_sort(list((bin + 1) * 62.5) FILTER (zone = 'left')) AS l, list_sort(list((bin + 1) * 62.5) FILTER (zone = 'right')) AS r FROM rnk WHERE k <= wanted GROUP BY image),
    lab AS (SELECT s.*, CASE side WHEN 'unbound' THEN CASE WHEN ("left" + "right") / 2.0 < l[1] THEN 'margin' ELSE 'text_region' END
        WHEN 'recto' THEN CASE WHEN l[2] IS NULL THEN 'text_region' WHEN ("left" + "right") / 2.0 < l[1] THEN 'facing_folio' WHEN ("left" + "right") / 2.0 < l[2] THEN 'margin' ELSE 'text_region' END
        ELSE CASE WHEN l[1] IS NULL OR r[2] IS NULL THEN 'text_region' WHEN ("left" + "right") / 2.0 < l[1] THEN 'margin' WHEN ("left" + "right") / 2.0 > r[1] THEN 'facing_folio' ELSE 'text_region' END END AS label
        FROM sided s LEFT JOIN cut USING (image))"""


def _sided(spark, sf_dir):
    side = F.when(F.col("image") % 3 == 0, "unbound").when(F.col("image") % 3 == 1, "recto").otherwise("verso")
    return _boxes(spark, sf_dir).withColumn("side", side)


@query(f"WITH {_BOXES}, {_LABELS} SELECT image, box_id, label FROM lab")
def component_labels(spark, sf_dir):
    return folio.labelled(_sided(spark, sf_dir), "image", "side", 1250, 20).select("image", "box_id", "label")


@query(f"""WITH {_BOXES}, {_LABELS}, m AS (SELECT *, max(CASE WHEN label = 'margin' THEN "right" END) OVER (PARTITION BY image) AS edge FROM lab)
    SELECT image, box_id, CASE WHEN label = 'text_region' AND "right" <= edge THEN 'margin' ELSE label END AS label FROM m""")
def component_margins(spark, sf_dir):
    return folio.pulled_in(folio.labelled(_sided(spark, sf_dir), "image", "side", 1250, 20), "image").select("image", "box_id", "label")


@query(f"""WITH {_BOXES}, {_LABELS}, sh AS (SELECT *, CASE WHEN label NOT IN ('facing_folio', 'other') AND ("right" > "left" AND bottom - top > 5 * ("right" - "left") OR bottom > top AND "right" - "left" > 5 * (bottom - top)) THEN 'other' ELSE label END AS label2 FROM lab),
    big AS (SELECT * FROM boxes WHERE ("right" - "left") * (bottom - top) > 25000),
    held AS (SELECT DISTINCT b.image, b.box_id FROM boxes b JOIN big a ON a.image = b.image AND a."left" <= b."left" AND b."right" <= a."right" AND a.top <= b.top AND b.bottom <= a.bottom WHERE b."right" > b."left" AND b.bottom > b.top UNION SELECT image, box_id FROM big),
    sz AS (SELECT sh.*, CASE WHEN held.box_id IS NOT NULL THEN 'other' ELSE label2 END AS label3 FROM sh LEFT JOIN held USING (image, box_id)),
    pu AS (SELECT *, CASE WHEN label3 = 'text_region' AND "right" <= max(CASE WHEN label3 = 'margin' THEN "right" END) OVER (PARTITION BY image) THEN 'margin' ELSE label3 END AS label4 FROM sz),
    tx AS (SELECT *, min("left") OVER w AS x0, min(top) OVER w AS y0, (max("right") OVER w - min("left") OVER w) / 10.0::DOUBLE AS tw, (max(bottom) OVER w - min(top) OVER w) / 10.0::DOUBLE AS th FROM pu WHERE label4 = 'text_region' WINDOW w AS (PARTITION BY image)),
    ca AS (SELECT *, unnest(range(10)) AS cx FROM tx WHERE tw > 0 AND th > 0), cb AS (SELECT *, unnest(range(10)) AS cy FROM ca WHERE least("right" - x0, (cx + 1) * tw) > greatest("left" - x0, cx * tw)),
    cc AS (SELECT image, box_id, count(*) OVER (PARTITION BY image, cx, cy) AS n FROM cb WHERE least(bottom - y0, (cy + 1) * th) > greatest(top - y0, cy * th)),
    low AS (SELECT DISTINCT image, box_id FROM cc WHERE n < 2)
    SELECT pu.image, pu.box_id, CASE WHEN low.box_id IS NOT NULL THEN 'other' ELSE label4 END AS label FROM pu LEFT JOIN low USING (image, box_id)""")
def component_classes(spark, sf_dir):
    return folio.classified(_sided(spark, sf_dir), "image", "side", 1250, 25000, 20).select("image", "box_id", "label")


@query("""WITH m AS (SELECT DISTINCT volume_id, entry_key, person_id, name FROM person_mentions), e AS (SELECT DISTINCT entry_key, entry_id FROM entries),
    j AS (SELECT volume_id, entry_key, entry_id, person_id, volume_id::VARCHAR || '-' || entry_id || '-' || person_id AS mention_id, coalesce(name, '') || '|' || volume_id::VARCHAR AS g FROM m JOIN e USING (entry_key)),
    k AS (SELECT volume_id, CASE WHEN g LIKE '|%' THEN mention_id ELSE g END AS g, mention_id, entry_key, person_id FROM j),
    f AS (SELECT volume_id, g, min({'pos': entry_key, 'person_id': person_id}) AS first FROM k GROUP BY ALL),
    n AS (SELECT volume_id, g, volume_id::VARCHAR || '-P' || lpad(row_number() OVER (PARTITION BY volume_id ORDER BY first)::VARCHAR, 5, '0') AS cluster_id FROM f)
    SELECT mention_id, cluster_id FROM k JOIN n USING (volume_id, g)""")
def volume_people(spark, sf_dir):
    """Mentions of one name in one volume as one person, numbered in order of first mention."""
    from libroflow.plans.pipeline import volume_people as build

    m = table(spark, sf_dir, "person_mentions").select("volume_id", "entry_key", "person_id", "name").distinct()
    people = m.join(table(spark, sf_dir, "entries").select("entry_key", "entry_id").distinct(), "entry_key").withColumn("pos", F.col("entry_key"))
    named = people.filter(F.length("name") > 0).select(F.concat_ws("-", F.col("volume_id").cast("string"), "entry_id", "person_id").alias("mention_id"), F.concat("name", F.lit("|"), F.col("volume_id").cast("string")).alias("group"))
    return build(people, named).select("mention_id", "cluster_id")
