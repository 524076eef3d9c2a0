"""Queries of the extraction chain and of publication by volume, each with the SQL it is compared with.

The answers of the model are the bodies of extraction_files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libroflow.operators import entity, evaluate, select, stages
from libroflow.operators.drift import approved_paths, catalogue_of
from libroflow.operators.repair import INVERSE
from libroflow.operators.shred import shred
from libroflow.plans import pipeline
from libroflow.plans.reference import _INSTRUCTION_ROWS, _INSTRUCTIONS
from libroflow.plans.training import _RELATED, _scalar_sql
from libroflow.session import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of people, events and relationships; parsed once, as each rule reads them."""
    kinds = catalogue_of(table(spark, sf_dir, "field_catalogue"))
    return cut(shred(table(spark, sf_dir, "extraction_files"), "file_id", "body", kinds, approved_paths(), columns=["node", "parent", "label", "path", "canon", "pos_path", "kind", "scalar"]))


_PRINCIPAL_NAMES = ["principals", "principal", "principal_ids", "principle"]
_TYPES = ", ".join(f"'{t}'" for t in INVERSE)
# Entries, people, events and principals of the bodies.
_BODIES = f"""WITH e AS (SELECT file_id, i AS entry_pos, json_extract(body, '$.entries[' || (i - 1) || ']') AS e FROM (SELECT file_id, body, unnest(range(1, json_array_length(body, '$.entries')::INT + 1)) AS i FROM extraction_files)),
    p AS (SELECT file_id, entry_pos, i AS pos, json_extract(e, '$.data.people[' || (i - 1) || ']') AS x FROM (SELECT *, unnest(range(1, json_array_length(e, '$.data.people')::INT + 1)) AS i FROM e)),
    v AS (SELECT file_id, entry_pos, i AS pos, json_extract(e, '$.data.events[' || (i - 1) || ']') AS x FROM (SELECT *, unnest(range(1, json_array_length(e, '$.data.events')::INT + 1)) AS i FROM e)),
    ids AS (SELECT DISTINCT file_id, entry_pos, x ->> '$.id' AS id FROM p WHERE json_type(x, '$.id') NOT IN ('ARRAY', 'OBJECT', 'NULL')),
    names(name) AS (VALUES {", ".join(f"('{n}')" for n in _PRINCIPAL_NAMES)}),
    m AS (SELECT file_id, entry_pos, pos, json_extract(x, '$.' || name) AS w FROM v, names),
    w AS (SELECT file_id, entry_pos, pos, 1 AS i, true AS alone, w ->> '$' AS who FROM m WHERE json_type(w) NOT IN ('ARRAY', 'OBJECT', 'NULL')
          UNION ALL SELECT file_id, entry_pos, pos, i, false, a[i] ->> '$' FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM (SELECT *, CASE json_type(w) WHEN 'ARRAY' THEN w ELSE '[]'::JSON END::JSON[] AS a FROM m)) WHERE json_type(a[i]) NOT IN ('ARRAY', 'OBJECT', 'NULL')),
    k2 AS (SELECT w.file_id, w.entry_pos, w.pos, list(who ORDER BY i, who) AS principals FROM w LEFT JOIN ids ON ids.file_id = w.file_id AND ids.entry_pos = w.entry_pos AND ids.id = who WHERE alone OR id IS NOT NULL GROUP BY ALL),
    f AS (SELECT v.file_id, v.entry_pos, v.pos, v.x, CASE WHEN json_type(x, '$.type') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN x ->> '$.type' END AS type, CASE WHEN json_type(x, '$.date') = 'VARCHAR' THEN x ->> '$.date' END AS date, coalesce(principals, []) AS principals
          FROM v LEFT JOIN k2 ON k2.file_id = v.file_id AND k2.entry_pos = v.entry_pos AND k2.pos = v.pos WHERE json_type(x) = 'OBJECT'),
    g AS (SELECT *, NOT (coalesce(type = 'marriage', false) AND len(principals) <> 2 OR coalesce(type = 'baptism', false) AND len(principals) <> 1) AS kept FROM f)"""
_PROBLEMS = f"""{_BODIES}, {_RELATED.replace("FROM n)", "FROM p)")},
    l AS (SELECT file_id, entry_pos, pos, i AS sub_pos, all_of[i] AS x, all_of[i] ->> '$.related_person' AS who, all_of[i] ->> '$.relationship_type' AS kin FROM (SELECT *, unnest(range(1, len(all_of) + 1)) AS i FROM r) WHERE json_type(all_of[i]) = 'OBJECT'),
    a AS (SELECT file_id, entry_pos, 'person' AS kind, pos, 0 AS sub_pos, CASE WHEN NOT list_contains(json_keys(x), 'id') THEN 'missing id' WHEN NOT list_contains(json_keys(x), 'name') THEN 'missing name' END AS problem FROM p WHERE json_type(x) = 'OBJECT'
          UNION SELECT file_id, entry_pos, 'event', pos, 0, CASE WHEN NOT list_contains(json_keys(x), 'type') THEN 'missing type' WHEN NOT list_has_any(json_keys(x), {_PRINCIPAL_NAMES}) THEN 'missing principals' WHEN NOT kept THEN 'wrong number of principals' END FROM g
          UNION SELECT l.file_id, l.entry_pos, 'relationship', pos, sub_pos, CASE WHEN who IS NULL THEN 'missing related_person' WHEN kin IS NULL THEN 'missing relationship_type' WHEN kin NOT IN ({_TYPES}) THEN 'invalid relationship_type' WHEN id IS NULL THEN 'unknown person' WHEN len(json_keys(x)) > 2 THEN 'too many members' END
                FROM l LEFT JOIN ids ON ids.file_id = l.file_id AND ids.entry_pos = l.entry_pos AND ids.id = who),
    b AS (SELECT file_id, entry_pos::INT AS entry_pos, kind, pos::INT AS pos, sub_pos::INT AS sub_pos, problem FROM a WHERE problem IS NOT NULL)"""


@query(f"{_PROBLEMS} SELECT * FROM b")
def extraction_problems(spark, sf_dir):
    """The failure log of people, events and relationships."""
    return stages.problems(_answers(spark, sf_dir), "file_id")


@query(f"""{_PROBLEMS} SELECT file_id, entry_pos, count(*) AS failures, arg_min(problem, {{'s': list_position(['person', 'event', 'relationship'], kind), 'p': pos, 'q': sub_pos, 't': problem}}) AS first_problem FROM b GROUP BY ALL""")
def extraction_failures(spark, sf_dir):
    """The failed outputs, one per entry."""
    return stages.failed_entries(stages.problems(_answers(spark, sf_dir), "file_id"), "file_id")


def _first_text(field: str) -> str:
    names = [field, *[k.rpartition(".")[2] for k, v in approved_paths().items() if v == f"entries.data.people.{field}"]]
    alone = _scalar_sql("entries.data.people", field, field in ("legitimate", "free")).rpartition(" AS ")[0]
    lists = [f"(list_filter(CASE json_type(x, '$.{n}') WHEN 'ARRAY' THEN x -> '$.{n}' ELSE '[]'::JSON END::JSON[], lambda j: json_type(j) = 'VARCHAR')[1]) ->> '$'" for n in names]
    return f"coalesce({alone}, {', '.join(lists)}) AS {field}"


def _was_list(field: str) -> str:
    """A list that no scalar under another name replaced."""
    names = [field, *[k.rpartition(".")[2] for k, v in approved_paths().items() if v == f"entries.data.people.{field}"]]
    any_list = " OR ".join(f"coalesce(json_type(x, '$.{n}') = 'ARRAY', false)" for n in names)
    scalar = _scalar_sql("entries.data.people", field).rpartition(" AS ")[0]
    return f"CASE WHEN ({any_list}) AND {scalar} IS NULL THEN '{field}' END"


@query(f"""{_BODIES} SELECT file_id, entry_pos::INT AS entry_pos, pos::INT AS person_pos, CASE WHEN json_type(x, '$.id') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN x ->> '$.id' END AS id, CASE WHEN json_type(x, '$.name') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN x ->> '$.name' END AS name,
    {", ".join(_first_text(f) for f in stages.NULLABLE)},
    array_to_string(CASE json_type(x, '$.titles') WHEN 'ARRAY' THEN list_transform(list_filter((x -> '$.titles')::JSON[], lambda j: json_type(j) NOT IN ('ARRAY', 'OBJECT', 'NULL')), lambda j: j ->> '$') WHEN 'VARCHAR' THEN [x ->> '$.titles'] ELSE [] END, '|') AS titles,
    array_to_string(list_filter([{", ".join(_was_list(f) for f in stages.NULLABLE)}], lambda f: f IS NOT NULL), '|') AS listed
    FROM p WHERE json_type(x) = 'OBJECT' AND list_has_all(json_keys(x), ['id', 'name'])""")
def filled_people(spark, sf_dir):
    """People that pass, their properties filled."""
    out = stages.filled_people(_answers(spark, sf_dir), "file_id")
    return out.withColumn("titles", F.array_join("titles", "|")).withColumn("listed", F.array_join("listed", "|"))


@query(f"{_BODIES} SELECT file_id, entry_pos::INT AS entry_pos, pos::INT AS event_pos, type, date, array_to_string(principals, '|') AS principals, kept FROM g")
def filled_events(spark, sf_dir):
    """Events with their known principals."""
    return stages.filled_events(_answers(spark, sf_dir), "file_id").withColumn("principals", F.array_join("principals", "|"))


# -- publication -----------------------------------------------------------------------------------------------------

_VOLUME = """m AS (SELECT DISTINCT volume_id, entry_key, person_id, name FROM person_mentions), e AS (SELECT DISTINCT entry_key, entry_id FROM entries),
    j AS (SELECT volume_id, entry_key, entry_id, person_id, volume_id::VARCHAR || '-' || entry_id || '-' || person_id AS mention_id, coalesce(name, '') || '|' || volume_id::VARCHAR AS g FROM m JOIN e USING (entry_key)),
    k AS (SELECT volume_id, CASE WHEN g LIKE '|%' THEN mention_id ELSE g END AS g, mention_id, entry_key, entry_id, person_id FROM j),
    f AS (SELECT volume_id, g, min({'pos': entry_key, 'person_id': person_id}) AS first FROM k GROUP BY ALL),
    n AS (SELECT volume_id, g, volume_id::VARCHAR || '-P' || lpad(row_number() OVER (PARTITION BY volume_id ORDER BY first)::VARCHAR, 5, '0') AS cluster_id FROM f),
    c AS (SELECT DISTINCT volume_id, entry_id, person_id, cluster_id FROM k JOIN n USING (volume_id, g))"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "person_mentions").select("volume_id", "entry_key", "person_id", "name").distinct()
    people = m.join(table(spark, sf_dir, "entries").select("entry_key", "entry_id").distinct(), "entry_key").withColumn("pos", F.col("entry_key"))
    named = people.filter(F.length("name") > 0).select(F.concat_ws("-", F.col("volume_id").cast("string"), "entry_id", "person_id").alias("mention_id"), F.concat("name", F.lit("|"), F.col("volume_id").cast("string")).alias("group"))
    return pipeline.volume_people(people, named.distinct())


@query(f"""WITH {_VOLUME}, r AS (SELECT DISTINCT p.volume_id, entry_id, person_id AS src, x.related_person AS dst, x.relationship_type AS rel FROM (SELECT volume_id, entry_key, person_id, unnest(relationships) AS x FROM person_mentions) p JOIN e USING (entry_key))
    SELECT DISTINCT r.volume_id, coalesce(a.cluster_id, src) AS src, coalesce(b.cluster_id, dst) AS dst, rel FROM r LEFT JOIN c a ON a.volume_id = r.volume_id AND a.entry_id = r.entry_id AND a.person_id = src
    LEFT JOIN c b ON b.volume_id = r.volume_id AND b.entry_id = r.entry_id AND b.person_id = dst WHERE rel IN ({_TYPES})""")
def volume_edges(spark, sf_dir):
    """Relationships between the people of each volume."""
    m = table(spark, sf_dir, "person_mentions").select("volume_id", "entry_key", F.col("person_id").alias("src"), F.explode("relationships").alias("x"))
    edges = m.join(table(spark, sf_dir, "entries").select("entry_key", "entry_id").distinct(), "entry_key").select("volume_id", "entry_id", "src", F.col("x.related_person").alias("dst"), F.col("x.relationship_type").alias("rel")).distinct()
    return pipeline.volume_edges(edges, _people(spark, sf_dir).select("volume_id", "entry_id", "person_id", "cluster_id").distinct())


@query(f"""{_BODIES}, en AS (SELECT file_id, entry_pos, e ->> '$.id' AS entry_id FROM e),
    q AS (SELECT p.file_id, entry_id, x ->> '$.id' AS person_id, min({{'a': entry_pos, 'b': pos}}) AS first FROM p JOIN en USING (file_id, entry_pos) WHERE entry_id IS NOT NULL AND x ->> '$.id' IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, file_id::VARCHAR || '-P' || lpad(row_number() OVER (PARTITION BY file_id ORDER BY first, person_id)::VARCHAR, 5, '0') AS cluster_id FROM q),
    h AS (SELECT g.file_id, en.entry_id, g.entry_pos, g.pos, type, date, principals[:2] AS principals FROM g JOIN en ON en.file_id = g.file_id AND en.entry_pos = g.entry_pos WHERE en.entry_id IS NOT NULL),
    u AS (SELECT *, unnest(CASE WHEN len(principals) > 0 THEN range(1, len(principals) + 1) ELSE [0] END) AS i FROM h)
    SELECT u.file_id, u.entry_id, u.entry_id || '-E' || lpad((pos - 1)::VARCHAR, 2, '0') AS event_id, type, date, coalesce(string_agg(coalesce(cluster_id, principals[i]), '|' ORDER BY i) FILTER (WHERE i > 0), '') AS principals
    FROM u LEFT JOIN c ON c.file_id = u.file_id AND c.entry_id = u.entry_id AND c.person_id = principals[i] GROUP BY u.file_id, u.entry_id, u.entry_pos, pos, type, date""")
def volume_events(spark, sf_dir):
    """Events of each file's record, with numbered ids and their principals as people of the record."""
    nodes = _answers(spark, sf_dir)
    at = F.col("pos_path")
    ids = nodes.filter((F.col("canon") == "entries.id") & F.col("scalar").isNotNull()).select("file_id", at[0].alias("entry_pos"), F.col("scalar").alias("entry_id"))
    own = nodes.filter((F.col("canon") == f"{stages.PEOPLE}.id") & F.col("scalar").isNotNull() & (F.size("pos_path") == 2)).select("file_id", at[0].alias("entry_pos"), F.struct(at[0].alias("a"), at[1].alias("b")).alias("pos"), F.col("scalar").alias("person_id"))
    people = own.join(ids, ["file_id", "entry_pos"]).groupBy(F.col("file_id").alias("volume_id"), "entry_id", "person_id").agg(F.min("pos").alias("pos"))
    events = stages.filled_events(nodes, "file_id").join(ids, ["file_id", "entry_pos"])
    events = events.select(F.col("file_id").alias("volume_id"), "entry_id", "entry_pos", (F.col("event_pos") - 1).alias("event_pos"), "type", "date", "principals", F.array().cast("array<string>").alias("witnesses"))
    # entries that share an id in a file are told apart by their place
    out = pipeline.volume_events(events, pipeline.volume_people(people), extra=["entry_pos"])
    return out.select(F.col("volume_id").alias("file_id"), "entry_id", "event_id", "type", "date", F.array_join("principals", "|").alias("principals"))


_MERGED = ["name", "rank_title", "origin", "occupation", "phenotype", "is_free"]


def _folded_sql(field: str, values: str) -> str:
    return f"{field}_ AS (SELECT group_id, string_agg(v, '|' ORDER BY k) AS v FROM (SELECT group_id, v, min(k) AS k FROM ({values}) WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"


_LISTED = "SELECT group_id, {0}[i] AS v, {{'k': record_key, 'i': i}} AS k FROM (SELECT *, unnest(range(1, len({0}) + 1)) AS i FROM r WHERE len({0}) > 0)"


@query(f"""WITH r AS (SELECT DISTINCT group_id, record_key, {", ".join(_MERGED)}, titles, mentions FROM person_records WHERE group_id IS NOT NULL),
    {", ".join([_folded_sql(f, f"SELECT group_id, {f}::VARCHAR AS v, {{'k': record_key, 'i': 0}} AS k FROM r") for f in _MERGED] + [_folded_sql(f, _LISTED.format(f)) for f in ("titles", "mentions")])}
    SELECT group_id, {", ".join(f"coalesce({f}_.v, '') AS {f}" for f in [*_MERGED, "titles", "mentions"])},
           CASE WHEN phenotype_.v IS NOT NULL AND phenotype_.v NOT LIKE '%|%' THEN phenotype_.v END AS one_phenotype
    FROM (SELECT DISTINCT group_id FROM ({" UNION ALL ".join(f"SELECT group_id FROM {f}_" for f in [*_MERGED, "titles", "mentions"])})) {" ".join(f"LEFT JOIN {f}_ USING (group_id)" for f in [*_MERGED, "titles", "mentions"])}""")
def merged_people(spark, sf_dir):
    """The records of each person merged, all attributes and lists, with the view of a field that has one value."""
    fields = ["group_id", "record_key", *_MERGED, "titles", "mentions"]
    r = table(spark, sf_dir, "person_records").filter(F.col("group_id").isNotNull()).select(*fields).distinct()
    out = entity.folded(r, ["group_id"], ["record_key"], _MERGED, ["titles", "mentions"])
    return out.select("group_id", *[F.array_join(f, "|").alias(f) for f in [*_MERGED, "titles", "mentions"]], entity.scalar_view(F.col("phenotype")).alias("one_phenotype"))


# -- requests --------------------------------------------------------------------------------------------------------

@query(f"""WITH e AS (SELECT DISTINCT entry_key, volume_id, raw, normalized FROM entries WHERE raw IS NOT NULL), i(cases, seq, pos, text) AS (VALUES {_INSTRUCTION_ROWS}),
    v AS (SELECT volume_id, record_type, ['normalization', CASE WHEN country IN ('Colombia', 'Cuba', 'Mexico', 'United States') THEN 'Spanish' ELSE 'Portuguese' END, record_type] AS words FROM volumes),
    s AS (SELECT volume_id, string_agg('system:' || text, '|' ORDER BY seq, pos) AS told FROM v JOIN i ON list_has_all(words, cases) GROUP BY 1),
    x AS (SELECT record_type, entry_key, e.raw, normalized, row_number() OVER (PARTITION BY record_type ORDER BY entry_key, e.raw, normalized) AS n FROM e JOIN v USING (volume_id) WHERE normalized IS NOT NULL AND record_type IS NOT NULL),
    t AS (SELECT record_type, string_agg('user:' || raw || '|assistant:' || normalized, '|' ORDER BY n) AS shots FROM x WHERE n <= 2 GROUP BY 1)
    SELECT entry_key, concat_ws('|', told, shots, 'user:' || raw) AS conversation FROM e JOIN v USING (volume_id) LEFT JOIN s USING (volume_id) LEFT JOIN t USING (record_type) WHERE normalized IS NULL""")
def normalization_requests(spark, sf_dir):
    """The entries without a modern reading as requests, with instructions and two examples of their record type."""
    e = table(spark, sf_dir, "entries").filter(F.col("raw").isNotNull()).select("entry_key", "volume_id", "raw", "normalized").distinct()
    volumes = table(spark, sf_dir, "volumes")
    examples = e.filter("normalized is not null").join(volumes.select("volume_id", "record_type"), "volume_id").select("record_type", F.col("entry_key").alias("example_key"), "raw", F.col("normalized").alias("answer"))
    asked = stages.requests(e.filter("normalized is null").select("entry_key", "volume_id", "raw"), volumes, _INSTRUCTIONS, "normalization", F.col("raw"), examples, 2)
    return asked.select("entry_key", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("conversation"))


@query("""SELECT DISTINCT entry_id AS block_id, '[{"type":"image_url","image_url":{"url":"https://images.example/' || entry_id || '-color.jpg"}},{"type":"image_url","image_url":{"url":"https://images.example/' || entry_id || '-pooled.jpg"}}]' AS question FROM entries WHERE entry_id IS NOT NULL""")
def transcription_requests(spark, sf_dir):
    """Blocks of writing as requests for their transcription."""
    blocks = table(spark, sf_dir, "entries").filter("entry_id is not null").select(F.col("entry_id").alias("block_id")).distinct()
    asked = stages.transcription_requests(blocks, F.lit("Transcribe the block."), "images.example")
    return asked.select("block_id", F.element_at("messages", -1)["content"].alias("question"))


# -- evaluation ------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT volume_id, entry_id, max(entry_key) AS truth FROM entries WHERE entry_id IS NOT NULL GROUP BY ALL),
    x AS (SELECT file_id, volume_id, i, json_extract(body, '$.entries[' || (i - 1) || ']') ->> '$.id' AS entry_id FROM (SELECT file_id, volume_id, body, unnest(range(1, json_array_length(body, '$.entries')::INT + 1)) AS i FROM extraction_files)),
    s AS (SELECT volume_id, entry_id, max({'f': file_id, 'i': i}) AS test FROM x WHERE entry_id IS NOT NULL GROUP BY ALL)
    SELECT volume_id, entry_id, truth, test.f AS test_file, test.i::INT AS test_pos FROM t JOIN s USING (volume_id, entry_id)""")
def common_entries(spark, sf_dir):
    """Entries that truth and test share; of those that share an id the last counts."""
    at = F.col("pos_path")
    files = table(spark, sf_dir, "extraction_files")
    found = _answers(spark, sf_dir).filter((F.col("canon") == "entries.id") & F.col("scalar").isNotNull()).select("file_id", at[0].alias("i"), F.col("scalar").alias("entry_id")).join(files.select("file_id", "volume_id").distinct(), "file_id")
    truth = table(spark, sf_dir, "entries").filter("entry_id is not null")
    both = evaluate.common_last(truth, found, ["volume_id", "entry_id"], ["entry_key"], ["file_id", "i"])
    return both.select("volume_id", "entry_id", F.col("truth.entry_key").alias("truth"), F.col("test.file_id").alias("test_file"), F.col("test.i").alias("test_pos"))


@query(f"""{_BODIES} SELECT file_id, string_agg(DISTINCT k, '|' ORDER BY k) AS fields FROM (SELECT file_id, unnest(json_keys(x)) AS k FROM p UNION ALL SELECT file_id, unnest(json_keys(x)) FROM v) GROUP BY 1""")
def field_union(spark, sf_dir):
    """All names under which members of people and events come in each file."""
    nodes = _answers(spark, sf_dir)
    inside = nodes.filter(F.col("label").isNotNull() & F.col("path").rlike(r"^entries\.data\.(people|events)\.[^.]+$"))
    return inside.groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("fields"))


@query("""WITH s AS (SELECT DISTINCT mention_key, entry_key, volume_id FROM person_mentions), t AS (SELECT entry_key, min(raw) AS raw FROM entries WHERE raw IS NOT NULL GROUP BY 1)
    SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY mention_key) AS place, mention_key, raw FROM s JOIN t USING (entry_key)""")
def slot_transcripts(spark, sf_dir):
    """Annotated slots with their transcripts, in the slots' order; those without one go."""
    slots = table(spark, sf_dir, "person_mentions").select("mention_key", "entry_key", "volume_id").distinct()
    texts = table(spark, sf_dir, "entries").filter("raw is not null").groupBy("entry_key").agg(F.min("raw").alias("raw"))
    return select.in_order(slots, texts, ["entry_key"], "volume_id", ["mention_key"]).select("volume_id", F.col("place").cast("bigint").alias("place"), "mention_key", "raw")


@query("""WITH r AS (SELECT DISTINCT group_id, record_key, occupation, titles FROM person_records WHERE group_id IS NOT NULL), f AS (SELECT group_id, min(record_key) AS k FROM r GROUP BY 1),
    p AS (SELECT r.group_id, r.record_key, a.occupation AS a, r.occupation AS b, a.titles AS ta, r.titles AS tb FROM r JOIN f USING (group_id) JOIN r a ON a.group_id = r.group_id AND a.record_key = f.k WHERE r.record_key <> f.k)
    SELECT group_id, record_key, CASE WHEN a IS NULL OR b IS NULL THEN a IS NULL AND b IS NULL ELSE a = b END AS same_occupation, CASE WHEN ta IS NULL OR tb IS NULL THEN ta IS NULL AND tb IS NULL ELSE list_sort(list_distinct(list_filter(ta, lambda x: x IS NOT NULL))) = list_sort(list_distinct(list_filter(tb, lambda x: x IS NOT NULL))) END AS same_titles FROM p""")
def compared_values(spark, sf_dir):
    """Values of each person's first record beside those of the others: texts by their likeness, lists by their members."""
    r = table(spark, sf_dir, "person_records").filter("group_id is not null").select("group_id", "record_key", "occupation", "titles").distinct()
    first = r.groupBy("group_id").agg(F.min_by(F.struct("record_key", "occupation", "titles"), "record_key").alias("a"))
    p = r.join(first, "group_id").filter("record_key != a.record_key")
    return p.select("group_id", "record_key", evaluate.same_value(F.col("a.occupation"), F.col("occupation"), 1.0).alias("same_occupation"), evaluate.same_list(F.col("a.titles"), F.col("titles")).alias("same_titles"))
