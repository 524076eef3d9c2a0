"""Queries of problems 2 and 6 over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libroflow.operators.drift import approved_paths, catalogue_of, conform, ingest
from libroflow.operators.shred import LINK_COLUMNS, LINK_PATHS, NO, YES, entity, entry_links, inner_values, shred
from libroflow.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest(table(spark, sf_dir, "extraction_files"), "file_id", "body", table(spark, sf_dir, "field_catalogue"))[1]


def _conformed(spark: SparkSession, sf_dir: str, at: str, *places: str) -> DataFrame:
    """The consistent table of the objects at a path, with its rescue column and the names of their places."""
    catalogue = table(spark, sf_dir, "field_catalogue")
    nodes, _, _ = ingest(table(spark, sf_dir, "extraction_files"), "file_id", "body", catalogue)
    out = conform(nodes, "file_id", at, catalogue_of(catalogue))
    return out.withColumns({p: F.col("pos_path")[i] for i, p in enumerate(places)}).drop("node", "pos_path")


def p2_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conformed(spark, sf_dir, "entries.data.people", "entry_pos", "person_pos")


def p2_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conformed(spark, sf_dir, "entries.data.people.relationships", "entry_pos", "person_pos", "relationship_pos")


def p2_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conformed(spark, sf_dir, "entries.data.events", "entry_pos", "event_pos")


def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and events are tables of their own."""
    return _conformed(spark, sf_dir, "entries", "entry_pos")


def p2_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headers of the files; entries are a table of their own."""
    return _conformed(spark, sf_dir, "")


def _nodes(spark: SparkSession, sf_dir: str, only: set[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    kinds = catalogue_of(table(spark, sf_dir, "field_catalogue"))
    return shred(table(spark, sf_dir, "extraction_files"), "file_id", "body", kinds, approved_paths(), only, columns)


def _flat(spark: SparkSession, sf_dir: str, at: str, fields: list[str]) -> DataFrame:
    """The entity at a path; only its own members are walked."""
    only = {at, *(f"{at}.{f}" for f in fields)}
    return entity(_nodes(spark, sf_dir, only, LINK_COLUMNS), "file_id", at, fields)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry_links(_nodes(spark, sf_dir, LINK_PATHS, LINK_COLUMNS), "file_id")


def p6_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat people table, linked to its entry by position."""
    return _flat(spark, sf_dir, "entries.data.people", _PEOPLE).select("file_id", F.col("pos_path")[0].alias("entry_pos"), F.col("pos_path")[1].alias("person_pos"), *_PEOPLE)


def p6_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat events table, linked to its entry by position."""
    return _flat(spark, sf_dir, "entries.data.events", _EVENTS).select("file_id", F.col("pos_path")[0].alias("entry_pos"), F.col("pos_path")[1].alias("event_pos"), *_EVENTS)


def p6_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat entries table."""
    return _flat(spark, sf_dir, "entries", _ENTRIES).select("file_id", F.col("pos_path")[0].alias("entry_pos"), *_ENTRIES)


def p6_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat relationships table, linked to its person by position."""
    at = F.col("pos_path")
    return _flat(spark, sf_dir, "entries.data.people.relationships", _RELATIONS).select("file_id", at[0].alias("entry_pos"), at[1].alias("person_pos"), at[2].alias("relationship_pos"), *_RELATIONS)


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child table of people and events: every scalar that is in no column of the other flat tables."""
    nodes, flat = _nodes(spark, sf_dir), [("entries.data.people", _PEOPLE), ("entries.data.people.relationships", _RELATIONS), ("entries.data.events", _EVENTS)]
    return inner_values(nodes, "file_id", {"entries.data.people": "person", "entries.data.events": "event"}, flat)


QUERIES = {"p2_found": p2_found, "p2_people": p2_people, "p2_relationships": p2_relationships, "p2_events": p2_events, "p2_entries": p2_entries, "p2_volumes": p2_volumes, "p6_found": p6_found, "p6_people": p6_people, "p6_events": p6_events, "p6_entries": p6_entries, "p6_relationships": p6_relationships, "p6_values": p6_values}


def _sql_list(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, b in rows)


# Each JSON node with its path without array places, the agreed path and the JSON type.
_CELLS = f"""al(found, agreed) AS (VALUES {_sql_list(sorted(approved_paths().items()))}),
    t AS (SELECT file_id, regexp_replace(substr(fullkey, 3), '\\[[0-9]+\\]', '', 'g') AS path, fullkey, type, value, atom, regexp_matches(fullkey, '\\]$') AS element FROM extraction_files, json_tree(body) WHERE fullkey <> '$'),
    c AS (SELECT file_id, path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
          coalesce(agreed, k.field_path, path) AS canon
          FROM (SELECT DISTINCT file_id, path, type FROM t WHERE NOT element) LEFT JOIN al ON found = path LEFT JOIN field_catalogue k ON lower(k.field_path) = lower(path))"""

_PEOPLE = ["id", "name", "rank", "origin", "ethnicity", "age", "legitimate", "occupation", "phenotype", "free"]
_EVENTS = ["type", "date"]
_ENTRIES = ["id", "raw"]
_RELATIONS = ["related_person", "relationship_type"]
_NODES = """e AS (SELECT file_id, i AS entry_pos, json_extract(body, '$.entries[' || (i - 1) || ']') AS e FROM (SELECT file_id, body, unnest(range(1, json_array_length(body, '$.entries')::INT + 1)) AS i FROM extraction_files)),
    n AS (SELECT file_id, entry_pos, i AS pos, json_extract(e, '$.data.{0}[' || (i - 1) || ']') AS x FROM (SELECT *, unnest(range(1, json_array_length(e, '$.data.{0}')::INT + 1)) AS i FROM e))"""


_WORDS = ", ".join(f"'{w}'" for w in [*YES, *NO])


def _scalar_sql(at: str, field: str, boolean: bool = False, x: str = "x") -> str:
    """The scalar text that stands for the field: under its own name, else under the first of the others; for a boolean
    those that can be read as one come first."""
    names = [field, *[k.rpartition(".")[2] for k, v in approved_paths().items() if v == f"{at}.{field}"]]
    each = [f"CASE WHEN json_type({x}, '$.{n}') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN {x} ->> '$.{n}' END" for n in names]
    fit = [f"CASE WHEN lower(trim({c})) IN ({_WORDS}) THEN {c} END" for c in each] if boolean else []
    return f"coalesce({', '.join([*fit, *each])}, NULL) AS {field}"


def _conformed_sql(rows: str, at: str, places: list[str], fields: dict[str, str], inner: str = "") -> str:
    """The consistent table of the objects x of `rows`. Each member gets its agreed path; among several of one scalar field
    the first that can be read wins; what is in no column is rescued as JSON text."""
    prefix, key = f"{at}." if at else "", ", ".join(["file_id", *places])
    kind = "CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END"
    own = lambda f: f"canon = '{prefix}{f}' AND NOT lost"
    cast = {
        "string": lambda f: f"max(CASE WHEN {own(f)} AND kind NOT IN ('array', 'object', 'null') THEN s END)",
        "number": lambda f: f"max(CASE WHEN {own(f)} AND kind NOT IN ('array', 'object', 'null') THEN TRY_CAST(s AS DOUBLE) END)",
        "boolean": lambda f: f"max(CASE WHEN {own(f)} AND kind NOT IN ('array', 'object', 'null') THEN CASE WHEN lower(trim(s)) IN ({', '.join(f"'{w}'" for w in YES)}) THEN true WHEN lower(trim(s)) IN ({', '.join(f"'{w}'" for w in NO)}) THEN false END END)",
        "list": lambda f: f"""coalesce(nullif(flatten(list(CASE WHEN canon = '{prefix}{f}' AND kind = 'array' THEN list_transform(list_filter((CASE kind WHEN 'array' THEN v ELSE '[]'::JSON END)::JSON[], lambda j: json_type(j) NOT IN ('ARRAY', 'OBJECT', 'NULL')), lambda j: j ->> '$') END)), []),
            list_sort(list(DISTINCT s) FILTER (WHERE canon = '{prefix}{f}' AND kind IN ('string', 'number', 'boolean'))))""",
    }
    nests = f"SELECT DISTINCT regexp_replace(field_path, '[.][^.]+$', '') FROM field_catalogue WHERE field_path LIKE '%.%'"  # noqa: F541
    under = f"UNION ALL SELECT {key}, '{inner}.' || k, 1, json_extract(x, '$.{inner}.\"' || k || '\"') FROM (SELECT *, unnest(json_keys(x, '$.{inner}')) AS k FROM n WHERE json_type(x, '$.{inner}') = 'OBJECT')" if inner else ""
    return f"""WITH al(found, agreed, place) AS (VALUES {", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(approved_paths().items()))}), nests(p) AS ({nests}), n AS ({rows}),
        m AS (SELECT {key}, k AS name, 0 AS deep, json_extract(x, '$.\"' || k || '\"') AS v FROM (SELECT *, unnest(json_keys(x)) AS k FROM n WHERE json_type(x) = 'OBJECT') {under}),
        c AS (SELECT {key}, deep, '{prefix}' || name AS path, coalesce(agreed, c1.field_path, '{prefix}' || name) AS canon, place, v, v ->> '$' AS s, {kind} AS kind
              FROM m LEFT JOIN al ON found = '{prefix}' || name LEFT JOIN field_catalogue c1 ON lower(c1.field_path) = lower('{prefix}' || name)),
        w AS (SELECT c.*, json_type AS wanted, p IS NOT NULL AS nest, kind <> 'null' AND coalesce(json_type IN ('string', 'number', 'boolean'), false) AS plays,
              kind NOT IN ('array', 'object') AND (kind = json_type OR json_type = 'string' OR json_type = 'boolean' AND lower(trim(s)) IN ({_WORDS}) OR json_type = 'number' AND regexp_matches(s, '^ *-?[0-9]+([.][0-9]+)? *$')) AS fit
              FROM c LEFT JOIN field_catalogue f ON f.field_path = canon LEFT JOIN nests ON p = canon),
        r AS (SELECT *, plays AND row_number() OVER (PARTITION BY {key}, canon, plays ORDER BY NOT fit, kind IN ('array', 'object'), path <> canon, place NULLS LAST, path) > 1 AS lost FROM w),
        q AS (SELECT *, wanted IS NULL OR lost OR (kind <> 'null' AND kind <> wanted)
              OR (wanted = 'array' AND kind = 'array' AND len(list_filter((CASE kind WHEN 'array' THEN v ELSE '[]'::JSON END)::JSON[], lambda j: json_type(j) <> 'NULL' AND (json_type(j) = 'ARRAY' OR (json_type(j) = 'OBJECT') <> nest))) > 0) AS kept FROM r),
        g AS (SELECT {key}, {"".join(f"{cast[t](f)} AS {f}, " for f, t in fields.items())}
              map_from_entries(list_sort(list({{'k': path, 'v': CASE WHEN kind = 'string' THEN to_json(s) ELSE v END::VARCHAR}}) FILTER (WHERE kept))) AS kept FROM q GROUP BY ALL)
        SELECT {", ".join(f"n.{k}" for k in key.split(", "))}, {"".join(f"g.{f}, " for f in fields)} coalesce(to_json(g.kept)::VARCHAR, '{{}}') AS _rescued FROM n LEFT JOIN g ON {" AND ".join(f"g.{k} = n.{k}" for k in key.split(", "))} WHERE json_type(x) = 'OBJECT'"""


# A reference as its number within the entry, and the entry it names.
_REF = "regexp_replace(regexp_replace(upper(trim(%s)), '^[0-9]+-[0-9]+-', ''), '^P0*([0-9])', 'P\\1')"

# Scalars below people and events, with the member they are in, what follows it without array places, and those places.
_VALUES = f"""al(found, agreed) AS (VALUES {_sql_list(sorted(approved_paths().items()))}),
    s AS (SELECT file_id, substr(fullkey, 3) AS k, atom ->> '$' AS value, regexp_extract(fullkey, '^[$][.]entries[[]([0-9]+)[]][.]data[.](people|events)[[]([0-9]+)[]][.]([^.[]+)(.*)$', ['e', 'kin', 'p', 'name', 'rest']) AS x FROM extraction_files, json_tree(body) WHERE type NOT IN ('ARRAY', 'OBJECT', 'NULL')),
    m AS (SELECT file_id, x.e::INT + 1 AS entry_pos, x.kin AS kin, x.p::INT + 1 AS pos, x.rest AS rest, value, coalesce(agreed, 'entries.data.' || x.kin || '.' || x.name) AS canon FROM s LEFT JOIN al ON found = 'entries.data.' || x.kin || '.' || x.name WHERE x.kin <> ''),
    v AS (SELECT file_id, entry_pos, kin, pos, canon[length('entries.data.' || kin) + 2:] AS field, ltrim(regexp_replace(rest, '[[][0-9]+[]]', '', 'g'), '.') AS member, value,
          CASE WHEN json_type = 'array' AND rest NOT LIKE '[%' THEN [1] ELSE [] END || list_transform(regexp_extract_all(rest, '[[]([0-9]+)[]]', 1), lambda i: i::INT + 1) AS places FROM m LEFT JOIN field_catalogue ON field_path = canon)"""

_RELATED = """r AS (SELECT file_id, entry_pos, pos, CASE json_type(x, '$.relationships') WHEN 'ARRAY' THEN (x -> '$.relationships')::JSON[] WHEN 'OBJECT' THEN [x -> '$.relationships'] ELSE [] END AS all_of FROM n)"""
_ENTRY_ROWS = "SELECT file_id, i::INT AS entry_pos, json_extract(body, '$.entries[' || (i - 1) || ']') AS x FROM (SELECT file_id, body, unnest(range(1, json_array_length(body, '$.entries')::INT + 1)) AS i FROM extraction_files)"
_TEXTS = lambda *names: dict.fromkeys(names, "string")

ORACLES = {
    "p2_people": _conformed_sql(f"WITH {_NODES.format('people')} SELECT file_id, entry_pos::INT AS entry_pos, pos::INT AS person_pos, x FROM n", "entries.data.people", ["entry_pos", "person_pos"],
        _TEXTS("age", "ethnicity", "id", "name", "occupation", "origin", "phenotype", "rank") | {"free": "boolean", "legitimate": "boolean", "titles": "list"}),
    "p2_relationships": _conformed_sql(f"WITH {_NODES.format('people')}, {_RELATED} SELECT file_id, entry_pos::INT AS entry_pos, pos::INT AS person_pos, i::INT AS relationship_pos, all_of[i] AS x FROM (SELECT *, unnest(range(1, len(all_of) + 1)) AS i FROM r)",
        "entries.data.people.relationships", ["entry_pos", "person_pos", "relationship_pos"], _TEXTS(*_RELATIONS)),
    "p2_events": _conformed_sql(f"WITH {_NODES.format('events')} SELECT file_id, entry_pos::INT AS entry_pos, pos::INT AS event_pos, x FROM n", "entries.data.events", ["entry_pos", "event_pos"], _TEXTS("type", "date") | {"principals": "list", "witnesses": "list"}),
    "p2_entries": _conformed_sql(_ENTRY_ROWS, "entries", ["entry_pos"], _TEXTS("id", "raw"), "data"),
    "p2_volumes": _conformed_sql("SELECT file_id, body::JSON AS x FROM extraction_files", "", [], _TEXTS("city", "country", "institution", "state", "title", "type") | {"id": "number"}),
    "p6_entries": """SELECT file_id, i::INT AS entry_pos, CASE WHEN json_type(e, '$.id') NOT IN ('ARRAY', 'OBJECT', 'NULL') THEN e ->> '$.id' END AS id,
        %s FROM (SELECT file_id, i, json_extract(body, '$.entries[' || (i - 1) || ']') AS e FROM (SELECT file_id, body, unnest(range(1, json_array_length(body, '$.entries')::INT + 1)) AS i FROM extraction_files))""" % _scalar_sql("entries", "raw", x="e"),
    "p6_relationships": f"""WITH {_NODES.format("people")}, {_RELATED}
        SELECT file_id, entry_pos::INT AS entry_pos, pos::INT AS person_pos, i::INT AS relationship_pos, all_of[i] ->> '$.related_person' AS related_person, all_of[i] ->> '$.relationship_type' AS relationship_type
        FROM (SELECT *, unnest(range(1, len(all_of) + 1)) AS i FROM r) WHERE json_type(all_of[i]) = 'OBJECT'""",
    "p6_values": f"""WITH {_VALUES} SELECT file_id, entry_pos, CASE kin WHEN 'people' THEN 'person' ELSE 'event' END AS parent_kind, pos AS parent_pos, field, member, array_to_string(places, '.') AS places, value FROM v
        WHERE NOT (member = '' AND len(places) = 0 AND (kin = 'people' AND field IN ({", ".join(f"'{f}'" for f in _PEOPLE)}) OR kin = 'events' AND field IN ('type', 'date')))
        AND NOT (kin = 'people' AND field = 'relationships' AND len(places) = 1 AND member IN ('related_person', 'relationship_type'))""",
    "p6_people": f"""WITH {_NODES.format("people")} SELECT file_id, entry_pos::INT AS entry_pos, pos::INT AS person_pos, {", ".join(_scalar_sql("entries.data.people", f, f in ("legitimate", "free")) for f in _PEOPLE)} FROM n""",
    "p6_events": f"""WITH {_NODES.format("events")} SELECT file_id, entry_pos::INT AS entry_pos, pos::INT AS event_pos, {", ".join(_scalar_sql("entries.data.events", f) for f in ("type", "date"))} FROM n""",
    "p2_found": f"""WITH {_CELLS}
        SELECT DISTINCT file_id, path AS field_path, 'renamed' AS change, canon AS catalogue_path FROM c SEMI JOIN field_catalogue f ON f.field_path = canon WHERE path <> canon
        UNION SELECT file_id, path, 'type_changed', canon FROM c JOIN field_catalogue f ON f.field_path = canon WHERE kind <> 'null' AND kind <> f.json_type
        UNION SELECT file_id, path, 'added', '' FROM c ANTI JOIN field_catalogue f ON f.field_path = canon
        UNION SELECT file_id, field_path, 'removed', field_path FROM (SELECT DISTINCT file_id FROM c) x, field_catalogue f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.file_id = x.file_id AND c.canon = f.field_path)""",
    "p6_found": f"""WITH e AS (SELECT file_id, i AS entry_pos, json_extract(body, '$.entries[' || (i - 1) || ']') AS e FROM (SELECT file_id, body, unnest(range(1, json_array_length(body, '$.entries')::INT + 1)) AS i FROM extraction_files)),
        p AS (SELECT file_id, entry_pos, i AS pos, json_extract(e, '$.data.people[' || (i - 1) || ']') AS p FROM (SELECT *, unnest(range(1, json_array_length(e, '$.data.people')::INT + 1)) AS i FROM e)),
        v AS (SELECT file_id, entry_pos, i AS pos, json_extract(e, '$.data.events[' || (i - 1) || ']') AS v FROM (SELECT *, unnest(range(1, json_array_length(e, '$.data.events')::INT + 1)) AS i FROM e)),
        ids AS (SELECT file_id, entry_pos, {_REF % "p ->> '$.id'"} AS id, min(pos) AS child FROM p GROUP BY ALL),
        r AS (SELECT file_id, entry_pos, 'person' AS parent_kind, pos AS parent_pos, unnest(CASE json_type(p -> '$.relationships') WHEN 'ARRAY' THEN (p -> '$.relationships')::JSON[] WHEN 'OBJECT' THEN [p -> '$.relationships'] ELSE [] END) AS x FROM p),
        k(name, role) AS (VALUES ('principals', 'principal'), ('principal', 'principal'), ('principal_ids', 'principal'), ('principle', 'principal'), ('witnesses', 'witness'), ('witness', 'witness'), ('testigos', 'witness')),
        w AS (SELECT file_id, entry_pos, 'event' AS parent_kind, pos AS parent_pos, role, json_extract(v, '$.' || name) AS m FROM v, k),
        l AS (SELECT file_id, entry_pos, parent_kind, parent_pos, x ->> '$.relationship_type' AS role, x ->> '$.related_person' AS ref FROM r
              UNION ALL SELECT file_id, entry_pos, parent_kind, parent_pos, role, unnest(CASE json_type(m) WHEN 'ARRAY' THEN (m)::VARCHAR[] WHEN 'VARCHAR' THEN [m ->> '$'] ELSE [] END) FROM w)
        SELECT DISTINCT l.file_id, l.entry_pos::INT AS entry_pos, parent_kind, parent_pos::INT AS parent_pos, role, coalesce(child, 0)::INT AS child_pos
        FROM l LEFT JOIN ids ON ids.file_id = l.file_id AND ids.entry_pos = l.entry_pos AND ids.id = {_REF % "ref"} WHERE trim(ref) <> ''""",
}
