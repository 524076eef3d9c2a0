"""Adjacency-table shredding of nested JSON and pivoting of the nodes into entity tables.

`shred` turns each body into one row per JSON node: node number, parent, label, ordinal and scalar, so any
nesting becomes a flat table. `entity` joins object nodes with their scalar children and pivots them.
`entry_links` resolves the references between entries, people and events.

Defined edge cases: a body without a key is left out; a null, blank or unparsable body gives no node except one of kind `invalid` for text that is
not JSON or nested beyond what the parser takes; empty objects and arrays give their own node only; a repeated key keeps its last value; repeated
input rows give repeated nodes under the same key (results that promise distinct rows are made distinct).
Columns of the input other than key and body are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from libroflow.session import cut

NODE_COLUMNS = {"node": "bigint", "parent": "bigint", "label": "string", "ordinal": "int", "path": "string", "canon": "string", "pos_path": "array<int>", "kind": "string", "scalar": "string", "raw": "string"}
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
_CHUNK = 100_000

# Words that stand for yes and for no.
YES = ["true", "yes", "y", "1", "si", "sí", "sim", "oui", "legitimate", "legítimo", "legitimo", "legítima", "legitima", "free", "freed", "libre", "livre"]
NO = ["false", "no", "n", "0", "não", "nao", "non", "illegitimate", "natural", "enslaved", "slave", "esclavo", "esclava"]
_WORDS = {*YES, *NO}
NUMBER = r"^\s*(-?\d+(?:\.\d+)?)\s*$"
_NUMBER = re.compile(NUMBER)


def kind_of(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def castable(v, wanted: str) -> bool:
    """Whether a value can be read as the agreed scalar type."""
    kind = kind_of(v)
    if kind in ("null", "array", "object"):
        return False
    if kind == wanted or wanted == "string":
        return True
    text = v if kind == "string" else json.dumps(v)
    return bool(_NUMBER.match(text)) if wanted == "number" else text.strip().lower() in _WORDS


def _settle(kids: list[list], kinds: dict[str, str], order: dict[str, int]) -> None:
    """Where a scalar field comes under several names in one object, one value stands for it: the first that can be read
    as its type, else the first there is, its own name before the others and those in their fixed order. The agreed
    path of the rest is taken away, so that they are kept as unknown members."""
    named: dict[str, list[list]] = {}
    for kid in kids:
        if kinds.get(kid[4]) in ("string", "number", "boolean") and kid[0] is not None:
            named.setdefault(kid[4], []).append(kid)
    for canon, rivals in named.items():
        if len(rivals) > 1:
            rank = lambda kid: (not castable(kid[0], kinds[canon]), isinstance(kid[0], (list, dict)), kid[5] != canon, order.get(kid[5], len(order)), kid[3])  # noqa: B023, E731
            for kid in sorted(rivals, key=rank)[1:]:
                kid[4] = None


def _walk(key, body, kinds, aliases, order, nests, only, out) -> None:
    try:
        root = json.loads(body)
    except (ValueError, RecursionError):
        out.append((key, 0, None, None, 1, "", "", [], "invalid", body, body))
        return
    # (value, parent node, label, ordinal, path, canonical path, positions, is array element)
    stack = [(root, None, None, 1, "", "", [], False)]
    number = 0
    while stack:
        v, parent, label, ordinal, path, canon, pos, element = stack.pop()
        node, number = number, number + 1
        kind = kind_of(v)
        wanted = kinds.get(canon)
        if wanted == "array" and kind not in ("array", "null") and not element:
            pos = [*pos, 1]  # a lone value where the layout has a list is its only element
        if only is None or only.get(canon):
            rescued = canon not in kinds and path != "" or wanted is not None and kind not in (wanted, "null") and not element
            text = v if kind == "string" else json.dumps(v, ensure_ascii=False) if kind not in ("object", "array", "null") else None
            if wanted == "array" and kind == "array" and not element:  # elements that no column and no table takes
                rescued = any(x is not None and (isinstance(x, list) or isinstance(x, dict) is not (canon in nests)) for x in v)
            raw = json.dumps(v, ensure_ascii=False, separators=(",", ":")) if rescued and not element else None
            out.append((key, node, parent, label, ordinal, path, canon, pos, kind, text, raw))
        if kind == "object":
            kids, renamed = [], False
            for i, (k, x) in enumerate(v.items(), 1):
                c = f"{canon or path}.{k}" if path else k
                agreed = aliases.get(c, c)
                renamed |= agreed is not c
                if only is None or agreed in only:
                    kids.append([x, k, i, f"{path}.{k}" if path else k, agreed, c])
            if renamed:
                _settle(kids, kinds, order)
            for x, k, i, p, c, _ in reversed(kids):
                stack.append((x, node, k, i, p, c, pos, False))
        elif kind == "array":
            for i in range(len(v), 0, -1):
                stack.append((v[i - 1], node, None, i, path, canon, [*pos, i], True))


def _arrow(fields: dict[str, str]) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in fields.items()])


def _bodies(df: DataFrame, key: str, body: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & F.col(body).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(body).alias(body))


def shred(df: DataFrame, key: str, body: str, kinds: dict[str, str] | None = None, aliases: dict[str, str] | None = None, only: set[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row per JSON node of `body`.

    kinds: the agreed layout, path -> JSON type; `raw` keeps the JSON of every value outside it.
    aliases: found path -> agreed path; `canon` has the agreed path, `path` the one found. A scalar field under several
    names in one object has one agreed value (see `_settle`); `canon` of the others is null and `raw` keeps them.
    pos_path: 1-based positions in all enclosing arrays.
    only: agreed paths whose nodes are wanted; nothing else is walked. columns: the columns of them, all by default.
    """
    kinds, aliases = kinds or {}, aliases or {}
    order = {p: i for i, p in enumerate(aliases)}
    nests = {p.rpartition(".")[0] for p in kinds}  # lists of these are lists of objects
    # wanted paths are true, those on the way to them false
    walked = None if only is None else {".".join(p.split(".")[:n]): False for p in only for n in range(len(p.split(".")) + 1)} | dict.fromkeys(only, True)
    full = {key: "bigint", **NODE_COLUMNS}
    kept = full if columns is None else {c: full[c] for c in [key, *columns]}
    places, types = [list(full).index(c) for c in kept], _arrow(kept)

    def batch(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[i], t.type) for i, t in zip(places, types)], schema=types)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for b in it:
            for k, text in zip(b.column(0), b.column(1)):
                if (t := text.as_py()) is None or not t.strip():
                    continue
                _walk(k.as_py(), t, kinds, aliases, order, nests, walked, rows)
                if len(rows) >= _CHUNK:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    return _bodies(df, key, body).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kept.items()))


def members(df: DataFrame, key: str, body: str) -> DataFrame:
    """Distinct (key, path, kind) of the members of all objects, without their values: what a report of the layout needs
    of a body is gathered where it is parsed."""
    fields = {key: "bigint", "path": "string", "kind": "string"}
    types = _arrow(fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[tuple[str, str], str] = {}
        for b in it:
            rows: list[tuple] = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    stack = [("", json.loads(text.as_py()))]
                except (ValueError, RecursionError):
                    continue
                seen: set[tuple[str, str]] = set()
                while stack:
                    path, v = stack.pop()
                    if isinstance(v, dict):
                        for name, x in v.items():
                            if (p := below.get((path, name))) is None:
                                if len(below) > 100_000:
                                    below.clear()
                                p = below[path, name] = f"{path}.{name}" if path else name
                            seen.add((p, kind_of(x)))
                            if isinstance(x, (dict, list)):
                                stack.append((p, x))
                    elif isinstance(v, list):
                        stack += [(path, x) for x in v if isinstance(x, (dict, list))]
                rows += [(k, *x) for x in seen]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)

    return _bodies(df, key, body).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in fields.items())).distinct()


def entity(nodes: DataFrame, key: str, path: str, fields: list[str]) -> DataFrame:
    """The objects at agreed path `path`, joined with their scalar children and pivoted to one row per object.

    Columns: key, node, parent, pos_path, then one string column per field (null where absent). Objects and children
    meet in one grouping by the object's node, combined before the shuffle.
    """
    full = {f: f"{path}.{f}" if path else f for f in fields}
    own = (F.col("canon") == path) & (F.col("kind") == "object")
    child = F.col("canon").isin(list(full.values())) & F.col("scalar").isNotNull()
    head = F.max(F.when(own, F.struct("node", "parent", "pos_path"))).alias("_head")
    pivot = nodes.filter(own | child).groupBy(F.col(key), F.when(own, F.col("node")).otherwise(F.col("parent")).alias("_o")).agg(head, *[F.max(F.when(~own & (F.col("canon") == p), F.col("scalar"))).alias(f) for f, p in full.items()])
    return pivot.filter("_head is not null").select(key, "_head.node", "_head.parent", "_head.pos_path", *fields)


def inner_values(nodes: DataFrame, key: str, parents: dict[str, str], flat: list[tuple[str, list[str]]]) -> DataFrame:
    """(key, entry_pos, parent_kind, parent_pos, field, member, places, value): every scalar below the objects at the paths
    of `parents` (path -> kind) that is no scalar member of an entity of `flat` (path, fields).

    field: the agreed member of the parent; member: the path below it, without array places; places: the 1-based places
    in the arrays below the parent, joined by dots (a lone value where the layout has a list is at place 1).
    """
    depth = {p: len(p.split(".")) for p, _ in parents.items()}
    nodes = nodes.withColumn("_path", F.coalesce("canon", "path"))  # a field under several names: the others by their names
    at = F.coalesce(*[F.when(F.startswith("_path", F.lit(f"{p}.")), F.lit(p)) for p in parents])
    skip = F.lit(False)
    for path, fields in flat:
        owner = next(p for p in parents if path == p or path.startswith(f"{p}."))
        lists = 2 + path.count(".") - owner.count(".")  # a list for the entries, the parents and each level below
        skip |= F.coalesce(F.col("canon"), F.lit("")).isin([f"{path}.{f}" for f in fields]) & F.col("label").isNotNull() & (F.size("pos_path") == lists)
    below = nodes.filter(F.col("scalar").isNotNull()).withColumn("_at", at).filter(F.col("_at").isNotNull() & ~skip)
    parts, n = F.split("_path", r"\."), F.coalesce(*[F.when(F.col("_at") == p, F.lit(d)) for p, d in depth.items()])
    kind = F.coalesce(*[F.when(F.col("_at") == p, F.lit(k)) for p, k in parents.items()])
    rest = F.array_join(F.slice(parts, n + 2, F.size(parts)), ".")
    places = F.array_join(F.slice("pos_path", 3, F.size("pos_path")).cast("array<string>"), ".")
    return below.select(key, F.col("pos_path")[0].alias("entry_pos"), kind.alias("parent_kind"), F.col("pos_path")[1].alias("parent_pos"), parts[n].alias("field"), rest.alias("member"), places.alias("places"), F.col("scalar").alias("value"))


_AT, _REL = "entries.data.people", "entries.data.people.relationships"
_ROLES = {"entries.data.events.principals": "principal", "entries.data.events.witnesses": "witness"}
#: The agreed paths that links are made of, and the columns of their nodes.
LINK_PATHS = {"entries", "entries.id", _AT, f"{_AT}.id", _REL, f"{_REL}.related_person", f"{_REL}.relationship_type", *_ROLES}
LINK_COLUMNS = ["node", "parent", "canon", "pos_path", "kind", "scalar"]


def local_ref(c) -> F.Column:
    """The reading of a person reference within its entry: `P4`, ` p04` and `0006-02-P04` are all `P4`."""
    t = F.upper(F.trim(c))
    return F.regexp_replace(F.regexp_replace(t, r"^\d+-\d+-", ""), r"^P0*(?=\d)", "P")


def entry_links(nodes: DataFrame, key: str) -> DataFrame:
    """Distinct links (key, entry_pos, parent_kind, parent_pos, role, child_pos) of the shredded bodies.

    A reference to nobody has child_pos 0; a reference that is null or blank is no link. Where two people of an
    entry share an id, the first is meant. A reference naming another entry is to nobody of this one.
    """
    nodes = cut(nodes)  # the bodies are parsed once; what follows reads the flat nodes
    at = F.col("pos_path")
    pad = lambda c: F.regexp_replace(F.regexp_replace(c, r"^0+(?=\d)", ""), r"-0+(?=\d)", "-")
    # an id carries the place of its object; people's ids meet the id of their entry in one window over the entry
    own = lambda path, depth: nodes.filter((F.col("canon") == path) & F.col("scalar").isNotNull() & (F.size("pos_path") == depth))
    people = own(f"{_AT}.id", 2).select(key, at[0].alias("entry_pos"), at[1].alias("child"), F.col("scalar").alias("person"), F.lit(None).cast("string").alias("entry"))
    entries = own("entries.id", 1).select(key, at[0].alias("entry_pos"), F.lit(None).cast("int").alias("child"), F.lit(None).cast("string").alias("person"), F.col("scalar").alias("entry"))
    placed = people.unionByName(entries).withColumn("entry", F.max("entry").over(Window.partitionBy(key, "entry_pos"))).filter("person is not null")
    ids = placed.groupBy(F.col(key).alias("k1"), F.col("entry_pos").alias("e1"), local_ref(F.col("person")).alias("id1")).agg(F.min("child").alias("child"), pad(F.trim(F.max("entry"))).alias("entry_id"))
    rel = entity(nodes, key, _REL, ["related_person", "relationship_type"]).select(key, at[0].alias("entry_pos"), F.lit("person").alias("parent_kind"), at[1].alias("parent_pos"), F.col("relationship_type").alias("role"), F.col("related_person").alias("ref"))
    principal, _ = _ROLES
    event = nodes.filter(F.col("canon").isin(list(_ROLES)) & F.col("kind").isin("string", "number")).select(key, at[0].alias("entry_pos"), F.lit("event").alias("parent_kind"), at[1].alias("parent_pos"), F.when(F.col("canon") == principal, _ROLES[principal]).otherwise("witness").alias("role"), F.col("scalar").alias("ref"))
    refs = rel.unionByName(event).filter(F.trim("ref") != "").select(key, "entry_pos", "parent_kind", "parent_pos", "role", local_ref(F.col("ref")).alias("want"), pad(F.regexp_extract(F.trim("ref"), r"^(\d+-\d+)-", 1)).alias("named"))
    joined = refs.join(ids, (F.col(key) == F.col("k1")) & (F.col("entry_pos") == F.col("e1")) & (F.col("want") == F.col("id1")), "left")
    here = (F.col("named") == "") | F.col("entry_id").isNull() | (F.col("named") == F.col("entry_id"))
    return joined.select(key, F.col("entry_pos").cast("int").alias("entry_pos"), "parent_kind", F.col("parent_pos").cast("int").alias("parent_pos"), "role", F.coalesce(F.when(here, F.col("child")), F.lit(0)).cast("int").alias("child_pos")).distinct()
