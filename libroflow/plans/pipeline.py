"""The whole path from transcribed entries to volume-level people, relationships and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libroflow.functions.text import pad
from libroflow.operators import provider, stages
from libroflow.operators.entity import numbered, qualified
from libroflow.operators.drift import approved_paths
from libroflow.operators.repair import INVERSE
from libroflow.operators.shred import shred
from libroflow.session import cut


def volume_people(people: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(volume_id, entry_id, person_id, mention_id, cluster_id): every mention with its volume-level person.

    people: volume_id, pos (place in the volume), entry_id, person_id. links: mention_id and group, the decided groups
    of mentions; without them every mention is its own person.
    """
    m = people.withColumn("mention_id", qualified(F.concat(F.col("volume_id").cast("string"), F.lit("-"), F.col("entry_id")), F.col("person_id")))
    grouped = m.withColumn("group", F.col("mention_id")) if links is None else m.join(links.select("mention_id", "group"), "mention_id", "left").withColumn("group", F.coalesce("group", "mention_id"))
    firsts = grouped.groupBy("volume_id", "group").agg(F.min(F.struct("pos", "person_id")).alias("first"))
    ids = numbered(firsts, "volume_id", ["first"], "cluster_id").select("volume_id", "group", "cluster_id")
    return grouped.join(ids, ["volume_id", "group"]).select("volume_id", "entry_id", "person_id", "mention_id", "cluster_id")


def volume_edges(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Relationships between volume-level people; ends that resolve to nobody stay as they are, invalid types go."""
    ids = people.select("volume_id", "entry_id", "person_id", "cluster_id")
    a = ids.select(*["volume_id", "entry_id"], F.col("person_id").alias("src"), F.col("cluster_id").alias("src_id"))
    b = ids.select(*["volume_id", "entry_id"], F.col("person_id").alias("dst"), F.col("cluster_id").alias("dst_id"))
    both = edges.filter(F.col("rel").isin(list(INVERSE))).join(a, ["volume_id", "entry_id", "src"], "left").join(b, ["volume_id", "entry_id", "dst"], "left")
    return both.select("volume_id", F.coalesce("src_id", "src").alias("src"), F.coalesce("dst_id", "dst").alias("dst"), "rel").distinct()


def volume_events(events: DataFrame, people: DataFrame, most: int = 2, extra: list[str] = ()) -> DataFrame:
    """Events with ids `entry-E00` and their people remapped; more than `most` principals are cut to the first ones.

    events: volume_id, entry_id, event_pos (from 0), type, date, principals, witnesses; extra: more columns that tell
    events apart.
    """
    lists = F.array(F.struct(F.lit("principal").alias("role"), F.slice(F.coalesce("principals", F.array().cast("array<string>")), 1, most).alias("who")), F.struct(F.lit("witness").alias("role"), F.coalesce("witnesses", F.array().cast("array<string>")).alias("who")))
    flat = events.withColumn("x", F.explode(lists)).select("volume_id", "entry_id", *extra, "event_pos", "type", "date", "x.role", F.posexplode_outer("x.who").alias("place", "person_id"))
    ids = people.select("volume_id", "entry_id", "person_id", "cluster_id")
    named = flat.join(ids, ["volume_id", "entry_id", "person_id"], "left").withColumn("who", F.coalesce("cluster_id", "person_id"))
    gathered = lambda role: F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == role) & F.col("who").isNotNull(), F.struct("place", "who")))), lambda s: s["who"])
    out = named.groupBy("volume_id", "entry_id", *extra, "event_pos", "type", "date").agg(gathered("principal").alias("principals"), gathered("witness").alias("witnesses"))
    return out.withColumn("event_id", F.concat("entry_id", F.lit("-E"), pad(F.col("event_pos"), 2)))


def extracted(entries: DataFrame, volumes: DataFrame, instructions: list[tuple[list[str], int, str]], stored: DataFrame, kinds: dict[str, str], examples: DataFrame | None = None, text: str = "normalized") -> dict[str, DataFrame]:
    """The extraction stage as one chain: the entries' requests, the answers stored for them, those rejected, the log of what
    is wrong in the rest, and the people, relationships and events that pass.

    entries: entry_key, volume_id and the text; stored: request and answer (see `provider.replay`); kinds: the agreed
    layout of a volume's record, in which an answer is the data of one entry.
    """
    asked = stages.requests(entries.filter(F.col(text).isNotNull()), volumes, instructions, "extraction", F.col(text), examples)
    answers = cut(provider.replay(asked, stored).select("entry_key", "volume_id", "answer"))
    rejected = stages.rejected(answers.filter("answer is not null"), "answer")
    good = answers.join(rejected.select("entry_key"), "entry_key", "left_anti").filter("answer is not null")
    body = good.select("entry_key", F.concat(F.lit('{"entries":[{"data":'), "answer", F.lit("}]}")).alias("body"))
    nodes = cut(shred(body, "entry_key", "body", kinds, approved_paths()))
    wrong = cut(stages.problems(nodes, "entry_key"))
    at = ["entry_key", "pos", "sub_pos"]
    bad = wrong.filter("kind = 'relationship'").select(*at).distinct()
    relations = stages.entity(nodes, "entry_key", stages.RELATIONS, ["related_person", "relationship_type"]).select("entry_key", F.col("pos_path")[1].alias("pos"), F.col("pos_path")[2].alias("sub_pos"), "related_person", "relationship_type")
    return {
        "requests": asked, "answers": answers, "rejected": rejected, "problems": wrong, "failures": stages.failed_entries(wrong, "entry_key"),
        "people": stages.filled_people(nodes, "entry_key"), "events": stages.filled_events(nodes, "entry_key").filter("kept").drop("kept"), "relationships": relations.join(bad, at, "left_anti"),
    }
