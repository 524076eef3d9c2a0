"""The model stages as tables: requests, replayed answers, and the chain that validates and repairs what comes back.

    requests(entries, ...)  ->  provider.replay or provider.answered  ->  shred  ->  problems, filled_people, filled_events

Every rule is a set operation on the nodes of all answers; what a rule finds wrong is a row of `problems`, so nothing
is dropped without a trace. Where the pipeline this follows writes the text `None` for titles that are null, there are none here.

Defined edge cases: answers without a key, null, blank or unparsable ones have no nodes (`rejected` lists those that
are no JSON or lack people); a field under several names has one agreed value (see `shred`); repeated answers under
one key give repeated nodes, so their problems are counted once; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from libroflow.operators.provider import conversations, message
from libroflow.operators.repair import INVERSE, PRINCIPALS, valid_json
from libroflow.operators.select import instructions_for
from libroflow.operators.shred import entity

PEOPLE, EVENTS, RELATIONS = "entries.data.people", "entries.data.events", "entries.data.people.relationships"
#: Properties of a person that may be null.
NULLABLE = ["rank", "origin", "ethnicity", "age", "legitimate", "occupation", "phenotype", "free"]


# -- requests --------------------------------------------------------------------------------------------------------


def requests(entries: DataFrame, volumes: DataFrame, instructions: list[tuple[list[str], int, str]], mode: str, question: Column, examples: DataFrame | None = None, shots: int = 3) -> DataFrame:
    """Entries with their `messages`: the volume's instructions, at most `shots` examples of its record type, the question.

    examples: record_type, example_key, raw, answer; the first by key are taken.
    """
    told = instructions_for(volumes, instructions, mode).select("volume_id", "record_type", "instructions")
    none = F.array().cast("array<struct<raw: string, answer: string>>")
    if examples is None:
        asked = entries.join(told, "volume_id").withColumn("examples", none)
    else:
        held = _first_few(examples.filter("record_type is not null").select("record_type", F.struct("example_key", "raw", "answer").alias("e")), shots)
        asked = entries.join(told, "volume_id").join(held, "record_type", "left").withColumn("examples", F.coalesce(F.transform("examples", lambda e: F.struct(e["raw"].alias("raw"), e["answer"].alias("answer"))), none))
    return conversations(asked, F.col("instructions"), F.col("examples"), question)


def _first_few(rows: DataFrame, shots: int) -> DataFrame:
    """The first rows of each record type; each task leaves out what can't be among them before anything is shuffled."""
    rank = F.row_number().over(Window.partitionBy("record_type").orderBy("e"))
    return rows.withColumn("_n", rank).filter(F.col("_n") <= shots).groupBy("record_type").agg(F.array_sort(F.collect_list("e")).alias("examples"))


def image_parts(colour_url: Column, pooled_url: Column) -> Column:
    """The content of a question about a block of writing: its image in colour and pooled."""
    part = lambda url: F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url"))
    return F.to_json(F.array(part(colour_url), part(pooled_url)))


def transcription_requests(blocks: DataFrame, instruction: Column, host: str, examples: DataFrame | None = None, fine_tuned: bool = False) -> DataFrame:
    """Blocks (block_id) with the `messages` that ask for their transcription; a fine-tuned model gets no examples.

    examples: block_id, text; a short list that travels as a literal.
    """
    url = lambda c, kind: F.concat(F.lit(f"https://{host}/"), c, F.lit(f"-{kind}.jpg"))
    shots = [] if fine_tuned or examples is None else examples.orderBy("block_id").limit(20).collect()
    said = [m for r in shots for m in (message("user", image_parts(url(F.lit(r["block_id"]), "color"), url(F.lit(r["block_id"]), "pooled"))), message("assistant", F.lit(r["text"])))]
    return blocks.withColumn("messages", F.array(message("system", instruction), *said, message("user", image_parts(url(F.col("block_id"), "color"), url(F.col("block_id"), "pooled")))))


def completeness_requests(entries: DataFrame, raw: str = "raw") -> DataFrame:
    """Entries with the `messages` that ask whether they are complete, a beginning or an end."""
    told = F.lit("Say whether this entry is complete, a beginning or an end. Answer with one of these words.")
    return entries.withColumn("messages", F.array(message("system", told), message("user", F.col(raw))))


def verdict(answer: Column) -> Column:
    """The verdict on an entry; anything but a beginning or an end is complete."""
    word = F.lower(F.trim(answer))
    return F.when(word.isin("beginning", "end"), word).otherwise("complete")


def line_transcripts(lines: DataFrame, entry: str, order: list[str], text: str) -> DataFrame:
    """(entry, text): the transcribed lines of each entry in order, joined by spaces; lines without an answer add nothing."""
    gathered = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(*order, text))))
    return lines.groupBy(entry).agg(F.array_join(F.transform(gathered, lambda s: s[text]), " ").alias(text))


# -- validation ------------------------------------------------------------------------------------------------------


def rejected(answers: DataFrame, answer: str) -> DataFrame:
    """The answers that are no JSON object with people, which no later step sees."""
    return answers.filter(~valid_json(F.col(answer)))


def member_names(nodes: DataFrame, key: str, path: str) -> DataFrame:
    """(_k, _n, names): the agreed names of the members of each object at `path`, whatever their values."""
    inside = F.col("label").isNotNull() & F.coalesce("canon", "path").rlike("^" + path.replace(".", r"\.") + r"\.[^.]+$")
    return nodes.filter(inside).groupBy(F.col(key).alias("_k"), F.col("parent").alias("_n")).agg(F.collect_set(F.substring_index(F.coalesce("canon", "path"), ".", -1)).alias("names"))


def _named(nodes: DataFrame, key: str, path: str, fields: list[str]) -> DataFrame:
    names = member_names(nodes, key, path)
    out = entity(nodes, key, path, fields).join(names, (F.col(key) == F.col("_k")) & (F.col("node") == F.col("_n")), "left").drop("_k", "_n")
    return out.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def _lacks(name: str) -> Column:
    return ~F.array_contains("names", name)


def person_ids(nodes: DataFrame, key: str) -> DataFrame:
    """(_k, _e, _id): the ids of the people of each entry, letter for letter."""
    own = nodes.filter((F.col("canon") == f"{PEOPLE}.id") & F.col("scalar").isNotNull() & (F.size("pos_path") == 2))
    return own.select(F.col(key).alias("_k"), F.col("pos_path")[0].alias("_e"), F.col("scalar").alias("_id")).distinct()


def people_problems(nodes: DataFrame, key: str) -> DataFrame:
    """People that lack the member id or name; one that is null is there."""
    at = F.col("pos_path")
    problem = F.when(_lacks("id"), "missing id").when(_lacks("name"), "missing name")
    return _named(nodes, key, PEOPLE, ["id"]).select(key, at[0].alias("entry_pos"), F.lit("person").alias("kind"), at[1].alias("pos"), F.lit(0).alias("sub_pos"), problem.alias("problem")).filter("problem is not null")


def event_problems(nodes: DataFrame, key: str) -> DataFrame:
    """Events that lack the member type or principals, or have the wrong number of known principals for their type."""
    at = F.col("pos_path")
    members = _named(nodes, key, EVENTS, ["type"]).select(key, at[0].alias("entry_pos"), at[1].alias("pos"), "names", "type")
    counted = filled_events(nodes, key).select(F.col(key).alias("_k"), F.col("entry_pos").alias("_e"), F.col("event_pos").alias("_v"), "kept")
    problem = F.when(_lacks("type"), "missing type").when(_lacks("principals"), "missing principals").when(~F.col("kept"), "wrong number of principals")
    joined = members.join(counted, (F.col(key) == F.col("_k")) & (F.col("entry_pos") == F.col("_e")) & (F.col("pos") == F.col("_v")), "left")
    return joined.select(key, "entry_pos", F.lit("event").alias("kind"), "pos", F.lit(0).alias("sub_pos"), problem.alias("problem")).filter("problem is not null")


def relationship_problems(nodes: DataFrame, key: str) -> DataFrame:
    """Relationships with the first rule they break: no related person, no type, a type that is none, a person who is not in
    the entry, more than two members."""
    at = F.col("pos_path")
    rel = _named(nodes, key, RELATIONS, ["related_person", "relationship_type"]).select(key, at[0].alias("entry_pos"), at[1].alias("pos"), at[2].alias("sub_pos"), "names", "related_person", "relationship_type")
    known = person_ids(nodes, key)
    joined = rel.join(known, (F.col(key) == F.col("_k")) & (F.col("entry_pos") == F.col("_e")) & (F.col("related_person") == F.col("_id")), "left")
    problem = F.when(F.col("related_person").isNull(), "missing related_person").when(F.col("relationship_type").isNull(), "missing relationship_type").when(~F.col("relationship_type").isin(list(INVERSE)), "invalid relationship_type").when(F.col("_id").isNull(), "unknown person").when(F.size("names") > 2, "too many members")
    return joined.select(key, "entry_pos", F.lit("relationship").alias("kind"), "pos", "sub_pos", problem.alias("problem")).filter("problem is not null")


def problems(nodes: DataFrame, key: str) -> DataFrame:
    """The failure log: (key, entry_pos, kind, pos, sub_pos, problem)."""
    return people_problems(nodes, key).unionByName(event_problems(nodes, key)).unionByName(relationship_problems(nodes, key)).distinct()


def failed_entries(found: DataFrame, key: str) -> DataFrame:
    """The failed outputs, one row per entry: how often it failed, and how first."""
    first = F.min(F.struct(F.array_position(F.array(F.lit("person"), F.lit("event"), F.lit("relationship")), F.col("kind")).alias("step"), "pos", "sub_pos", "problem"))
    return found.groupBy(key, "entry_pos").agg(F.count(F.lit(1)).alias("failures"), first.alias("_f")).select(key, "entry_pos", "failures", F.col("_f.problem").alias("first_problem"))


# -- repair ----------------------------------------------------------------------------------------------------------


def filled_people(nodes: DataFrame, key: str) -> DataFrame:
    """People with id and name: every nullable property as text (of a list its first text) or null, titles as a list (a lone
    value is its only element), and `listed`, the properties that were lists."""
    at = F.col("pos_path")
    bad = people_problems(nodes, key).select(F.col(key).alias("_k"), F.col("entry_pos").alias("_e"), F.col("pos").alias("_p"))
    fields = {f: f"{PEOPLE}.{f}" for f in ["id", "name", *NULLABLE, "titles"]}
    own = nodes.filter(((F.col("canon") == PEOPLE) & (F.col("kind") == "object")) | F.col("canon").isin(list(fields.values())))
    own = own.filter(F.size("pos_path") >= 2).withColumn("_e0", at[0]).withColumn("_p0", at[1])
    alone = lambda f: F.max(F.when((F.col("canon") == fields[f]) & F.col("label").isNotNull(), F.col("scalar")))
    first = lambda f: F.min_by(F.col("scalar"), F.when((F.col("canon") == fields[f]) & F.col("label").isNull() & (F.col("kind") == "string"), at[2]))
    lists = lambda f: F.max(((F.col("canon") == fields[f]) & (F.col("kind") == "array") & F.col("label").isNotNull()).cast("int")) == 1
    titles = F.transform(F.array_sort(F.collect_list(F.when((F.col("canon") == fields["titles"]) & F.col("scalar").isNotNull(), F.struct(at[2].alias("i"), F.col("scalar").alias("v"))))), lambda s: s["v"])
    listed = F.array_compact(F.array(*[F.when(F.col(f"_l_{f}"), F.lit(f)) for f in NULLABLE]))
    out = own.groupBy(key, "_e0", "_p0").agg(alone("id").alias("id"), alone("name").alias("name"), *[F.coalesce(alone(f), first(f)).alias(f) for f in NULLABLE], titles.alias("titles"), *[lists(f).alias(f"_l_{f}") for f in NULLABLE])
    good = out.join(bad, (out[key] == F.col("_k")) & (F.col("_e0") == F.col("_e")) & (F.col("_p0") == F.col("_p")), "left_anti")
    return good.select(key, F.col("_e0").alias("entry_pos"), F.col("_p0").alias("person_pos"), "id", "name", *NULLABLE, "titles", listed.alias("listed"))


def filled_events(nodes: DataFrame, key: str) -> DataFrame:
    """Events with their type, their date if it is a text, their principals (of a list those in the entry, a lone value as its
    only element), and `kept`: whether their type has that number of principals."""
    at = F.col("pos_path")
    events = entity(nodes, key, EVENTS, ["type"]).select(key, at[0].alias("entry_pos"), at[1].alias("event_pos"), "type")
    dates = nodes.filter((F.col("canon") == f"{EVENTS}.date") & (F.col("kind") == "string") & F.col("label").isNotNull()).select(F.col(key).alias("_kd"), at[0].alias("_ed"), at[1].alias("_vd"), F.col("scalar").alias("date"))
    named = nodes.filter((F.col("canon") == f"{EVENTS}.principals") & F.col("scalar").isNotNull()).select(F.col(key).alias("_kp"), at[0].alias("_ep"), at[1].alias("_vp"), at[2].alias("i"), F.col("label").isNotNull().alias("alone"), F.col("scalar").alias("who"))
    real = named.join(person_ids(nodes, key), (F.col("_kp") == F.col("_k")) & (F.col("_ep") == F.col("_e")) & (F.col("who") == F.col("_id")), "left").filter("alone or _id is not null")
    lists = real.groupBy("_kp", "_ep", "_vp").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "who"))), lambda s: s["who"]).alias("principals"))
    out = events.join(dates, (F.col(key) == F.col("_kd")) & (F.col("entry_pos") == F.col("_ed")) & (F.col("event_pos") == F.col("_vd")), "left")
    out = out.join(lists, (F.col(key) == F.col("_kp")) & (F.col("entry_pos") == F.col("_ep")) & (F.col("event_pos") == F.col("_vp")), "left")
    out = out.withColumn("principals", F.coalesce("principals", F.array().cast("array<string>")))
    wrong = F.lit(False)
    for kind, n in PRINCIPALS.items():
        wrong |= F.coalesce(F.col("type") == kind, F.lit(False)) & (F.size("principals") != n)
    return out.select(key, "entry_pos", "event_pos", "type", "date", "principals", (~wrong).alias("kept"))
