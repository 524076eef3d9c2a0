"""Queries of sources and sinks: tables written in the formats of the registers and read again, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from libroflow.functions import text
from libroflow.operators import provider, repair, select
from libroflow.plans.reference import _BOXES, _boxes
from libroflow.session import table
from libroflow.sources import registers, volumes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _written(spark: SparkSession, sf_dir: str, head, begin: str, end: str, per_image: bool) -> DataFrame:
    """Entries as the lines of a file: one per image, or one per volume with its images in order."""
    e = table(spark, sf_dir, "entries").filter("raw is not null and volume_id is not null").select("entry_key", "volume_id", text.before_dash(F.col("entry_id")).cast("int").alias("image"), F.regexp_replace("raw", r"[^a-z \n-]", "").alias("raw")).repartition("volume_id", "image").distinct()
    source = F.concat_ws("/", F.col("volume_id").cast("string"), F.col("image").cast("string")) if per_image else F.col("volume_id").cast("string")
    n = F.row_number().over(Window.partitionBy("volume_id", "image").orderBy("entry_key"))
    rows = e.withColumn("n", n).withColumn("head", F.when(F.col("n") == 1, F.array(head)).otherwise(F.array().cast("array<string>")))
    body = F.concat("head", F.array(F.lit(begin)), F.split("raw", "\n"), F.array(F.lit(end)))
    at = (F.col("image").cast("bigint") * 10**6 + F.col("n")) * 10**6
    return rows.select(source.alias("source"), at.alias("at"), F.posexplode(body).alias("i", "line")).select("source", (F.col("at") + F.col("i")).alias("line_no"), "line")


# The lines of an entry without blank ones, closed up over hyphens.
_RAW = r"""e AS (SELECT DISTINCT entry_key, volume_id, split_part(entry_id, '-', 1)::INT AS image, regexp_replace(raw, '[^a-z \n-]', '', 'g') AS raw FROM entries WHERE raw IS NOT NULL AND volume_id IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY volume_id, image ORDER BY entry_key) AS n FROM e),
    l AS (SELECT volume_id, image, n, i, string_split(raw, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS i FROM n)),
    t AS (SELECT volume_id, image, n, regexp_replace(regexp_replace(string_agg(CASE WHEN line LIKE '%-' THEN regexp_replace(line, '-$', '') ELSE line || ' ' END, '' ORDER BY i), ' {2,}', ' ', 'g'), ' $', '') AS raw FROM l WHERE length(line) >= 1 GROUP BY ALL)"""


@query(f"""WITH {_RAW} SELECT volume_id::VARCHAR || '/' || image::VARCHAR AS source, image::VARCHAR || '-' || row_number() OVER (PARTITION BY volume_id, image ORDER BY n)::VARCHAR AS entry_id, raw FROM t""")
def bound_parse(spark, sf_dir):
    """Entries written in the dialect of `IMG` lines, and parsed again."""
    entries = F.count(F.lit(1)).over(Window.partitionBy("volume_id", "image"))  # as many ids as the image has entries
    ids = F.array_join(F.transform(F.sequence(F.lit(1), entries.cast("int")), lambda i: F.concat(F.lit("-"), i.cast("string"))), "_")
    lines = _written(spark, sf_dir, F.concat(F.lit("IMG_a_b_"), F.col("image").cast("string"), F.lit("_"), ids), "{left margin", "{rubric", True)
    return registers.parse_bound(lines).select("source", "entry_id", "raw")


@query(f"""WITH {_RAW}, d AS (SELECT *, dense_rank() OVER (PARTITION BY volume_id ORDER BY image) AS place FROM t),
    s AS (SELECT volume_id, place, n, regexp_replace(raw, '^[ :]+|[ –]+$', '', 'g') AS raw FROM d)
    SELECT volume_id::VARCHAR AS source, lpad((place + 1)::VARCHAR, 4, '0') || '-' || lpad(row_number() OVER (PARTITION BY volume_id, place ORDER BY n)::VARCHAR, 2, '0') AS entry_id, raw FROM s WHERE length(raw) > 0""")
def signed_parse(spark, sf_dir):
    """Entries written in the dialect of `[signed]` lines, one file per volume, and parsed again."""
    return registers.parse_signed(_written(spark, sf_dir, F.lit("[f. vto"), "[left margin", "[signed]", False)).select("source", "entry_id", "raw")


@query("""WITH e AS (SELECT DISTINCT entry_key, volume_id, entry_id, string_split(raw, chr(10))[1] AS first FROM entries WHERE raw IS NOT NULL AND volume_id IS NOT NULL)
    SELECT volume_id::VARCHAR AS source, entry_id AS id, entry_key::VARCHAR || ' 7' AS coords, regexp_replace(replace(first, chr(9), ' '), ' {2,}', ' ', 'g') AS text FROM e""")
def log_and_text(spark, sf_dir):
    """A log of lines beside the text of the same lines, matched by place."""
    e = table(spark, sf_dir, "entries").filter("raw is not null and volume_id is not null").select("entry_key", F.col("volume_id").cast("string").alias("source"), "entry_id", F.get(F.split("raw", "\n"), F.lit(0)).alias("first")).distinct()
    key = F.col("entry_key") + 1
    row = F.concat(F.lit('"a, ""b""",1,2,3,'), "entry_id", F.lit(","), F.col("entry_key").cast("string"), F.lit(" 7"))
    head = e.select("source").distinct().select("source", F.lit(1).cast("bigint").alias("line_no"), F.lit("text,a,b,c,id,coords").alias("line"))
    log = registers.line_log(head.unionByName(e.select("source", key.alias("line_no"), row.alias("line"))))
    return registers.zipped(e.select("source", key.alias("line_no"), F.col("first").alias("line")), log).select("source", "id", F.array_join("coords", " ").alias("coords"), "text")


_ANNOTATED = f"""WITH {_BOXES}, a AS (SELECT *, CASE WHEN box_id % 5 = 0 THEN 'drawing' ELSE 'text' END AS name, box_id % 3 = 0 AS margin, box_id % 4 = 0 AS partial FROM boxes)"""


def _annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as the annotation tool exports them."""
    each = F.struct("box_id", F.when(F.col("box_id") % 5 == 0, "drawing").otherwise("text").alias("name"), F.struct((F.col("box_id") % 3 == 0).alias("margin"), (F.col("box_id") % 4 == 0).alias("partial")).alias("attributes"), F.array("left", "top", "right", "bottom").alias("polygon"))
    held = _boxes(spark, sf_dir).groupBy("image").agg(F.array_sort(F.collect_list(each)).alias("annotations"))
    return held.select(F.array(F.struct(F.concat(F.col("image").cast("string"), F.lit(".jpg")).alias("filename"), "annotations")).alias("images"))


@query(f"""{_ANNOTATED} SELECT image::VARCHAR AS image_id, coalesce(string_agg("left"::VARCHAR || ',' || top::VARCHAR, ' ' ORDER BY box_id) FILTER (WHERE name = 'text' AND NOT margin), '') AS corners FROM a GROUP BY image""")
def manual_boxes(spark, sf_dir):
    boxes = volumes.manual_boxes(_annotations(spark, sf_dir))
    corners = F.transform("coords", lambda b: F.concat(F.get(b, F.lit(0)).cast("string"), F.lit(","), F.get(b, F.lit(1)).cast("string")))
    return boxes.select("image_id", F.array_join(corners, " ").alias("corners"))


@query(f"""{_ANNOTATED} SELECT image::VARCHAR AS image_id, row_number() OVER (PARTITION BY image ORDER BY top, box_id)::INT AS number, "left", bottom FROM a WHERE name = 'text' AND NOT margin AND NOT partial""")
def trainable_boxes(spark, sf_dir):
    return volumes.trainable_boxes(_annotations(spark, sf_dir)).select("image_id", F.col("number").cast("int").alias("number"), F.get("coords", F.lit(0)).alias("left"), F.get("coords", F.lit(3)).alias("bottom"))


@query(f"""WITH {_BOXES} SELECT image::VARCHAR AS image_id, count(*) AS n, min(top) AS first_top FROM boxes WHERE image % 7 <> 0 GROUP BY image""")
def computed_boxes(spark, sf_dir):
    """Boxes of segmentation results; empty items go."""
    made = _boxes(spark, sf_dir).groupBy("image").agg(F.collect_list(F.struct(F.array("left", "top", "right", "bottom").alias("coords"))).alias("original texts"))
    results = made.withColumn("image_id", F.when(F.col("image") % 7 != 0, F.col("image").cast("string")))
    return volumes.computed_boxes(results).select("image_id", F.size("coords").cast("bigint").alias("n"), F.array_min(F.transform("coords", lambda c: F.get(c, F.lit(1)))).alias("first_top"))


@query("""WITH e AS (SELECT DISTINCT entry_key, volume_id, entry_id, raw FROM entries), l AS (SELECT volume_id, string_agg(coalesce(entry_id, '') || '=' || length(raw)::VARCHAR, '|' ORDER BY entry_key) AS v FROM e WHERE raw IS NOT NULL GROUP BY 1)
    SELECT volumes.volume_id, title, coalesce(v, '') AS entries FROM volumes LEFT JOIN l USING (volume_id)""")
def volume_records(spark, sf_dir):
    """Volume records with their entries in order."""
    e = table(spark, sf_dir, "entries").filter("raw is not null").select("volume_id", F.col("entry_key").alias("pos"), "entry_id", "raw").distinct()
    out = volumes.volume_records(e, table(spark, sf_dir, "volumes"))
    return out.select("volume_id", "title", F.array_join(F.transform("entries", lambda x: F.concat(F.coalesce(x["id"], F.lit("")), F.lit("="), F.length(x["raw"]).cast("string"))), "|").alias("entries"))


@query("""SELECT DISTINCT '{"messages":[{"role":"system","content":"Modernise the spelling."},{"role":"user","content":' || to_json(raw)::VARCHAR || '},{"role":"assistant","content":' || to_json(normalized)::VARCHAR || '}]}' AS value FROM entries WHERE raw IS NOT NULL AND normalized IS NOT NULL""")
def fine_tuning_lines(spark, sf_dir):
    """One JSON line per example with a modern reading."""
    e = table(spark, sf_dir, "entries").filter("raw is not null and normalized is not null").select("raw", "normalized").distinct()
    return provider.fine_tuning_records(e, F.array(F.lit("Modernise the spelling.")), F.col("raw"), F.col("normalized"))


@query("""SELECT DISTINCT entry_key, entry_id, NULL::VARCHAR AS colour FROM entries UNION ALL SELECT DISTINCT entry_key + 1000000, entry_id, 'gray' FROM entries WHERE normalized IS NOT NULL""")
def index_append(spark, sf_dir):
    """An index with new rows, which have a column more."""
    e = table(spark, sf_dir, "entries")
    new = e.filter("normalized is not null").select((F.col("entry_key") + 1000000).alias("entry_key"), "entry_id", F.lit("gray").alias("colour")).distinct()
    return volumes.appended(e.select("entry_key", "entry_id").distinct(), new)


@query("""WITH c AS (SELECT volume_id, title, city, CASE record_type WHEN 'baptism' THEN ['Registers', 'Baptisms'] WHEN 'marriage' THEN ['Marriages', 'Registers'] ELSE ['Burials'] END AS subjects FROM volumes),
    w AS (SELECT DISTINCT volume_id FROM documents WHERE volume_id IS NOT NULL)
    SELECT volume_id, title, city, CASE WHEN list_contains(subjects, 'Baptisms') THEN 'baptism' WHEN list_contains(subjects, 'Marriages') THEN 'marriage' WHEN list_contains(subjects, 'Burials') THEN 'burial' END AS record_type FROM w LEFT JOIN c USING (volume_id)""")
def catalogue_lookup(spark, sf_dir):
    """The catalogue's entries of the volumes that documents come from."""
    subjects = F.when(F.col("record_type") == "baptism", F.array(F.lit("Registers"), F.lit("Baptisms"))).when(F.col("record_type") == "marriage", F.array(F.lit("Marriages"), F.lit("Registers"))).otherwise(F.array(F.lit("Burials")))
    catalogue = table(spark, sf_dir, "volumes").select("volume_id", "title", "city", subjects.alias("subjects"))
    wanted = table(spark, sf_dir, "documents").filter("volume_id is not null")
    return select.catalogued(catalogue, wanted, "volume_id", "subjects", ["title"]).select("volume_id", "title", "city", "record_type")


@query("""WITH w AS (SELECT DISTINCT entry_id, 'https://images.example/' || entry_id || '-color.jpg' AS url FROM entries WHERE entry_id IS NOT NULL AND volume_id IS NOT NULL), k AS (SELECT DISTINCT split_part(entry_id, '-', 1) AS prefix FROM entries WHERE normalized IS NOT NULL)
    SELECT entry_id, url FROM w SEMI JOIN k ON split_part(w.entry_id, '-', 1) = k.prefix""")
def images_of_volumes(spark, sf_dir):
    """Images whose id begins with an id of the chosen set."""
    w = table(spark, sf_dir, "entries").filter("entry_id is not null and volume_id is not null").select("entry_id", text.image_url("images.example", F.col("entry_id")).alias("url")).distinct()
    chosen = table(spark, sf_dir, "entries").filter("normalized is not null").select(text.before_dash(F.col("entry_id")).alias("prefix")).distinct()
    return select.with_prefix(w, "entry_id", chosen, "prefix")


@query("""WITH e AS (SELECT DISTINCT event_id, user_id, CASE WHEN value > 50 THEN strftime(ts, '%Y-%m-%d') WHEN value > 25 THEN strftime(ts, '%Y-%m') END AS day, event_type FROM events),
    n AS (SELECT *, CASE WHEN length(day) = 10 THEN day END AS whole FROM e)
    SELECT event_id, coalesce(day, CASE WHEN event_type <> 'click' THEN last_value(whole IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || '/' || first_value(whole IGNORE NULLS) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END) AS filled
    FROM n WINDOW o AS (PARTITION BY user_id ORDER BY event_id)""")
def event_dates(spark, sf_dir):
    """Undated events between whole dates get their range, births excepted (here those of one type)."""
    day = F.when(F.col("value") > 50, F.date_format("ts", "yyyy-MM-dd")).when(F.col("value") > 25, F.date_format("ts", "yyyy-MM"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", day.alias("day"), F.when(F.col("event_type") == "click", "birth").otherwise(F.col("event_type")).alias("kind")).distinct()
    return repair.back_filled(e, "user_id", ["event_id"], "day", "filled", "kind", repair.WHOLE_DATE).select("event_id", "filled")
