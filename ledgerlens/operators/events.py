"""Timeline events: evidence that is near in time and shares an entity or says like things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.labels import event_label
from ledgerlens.operators.graph import components
from ledgerlens.operators.temporal import band_join
from ledgerlens.operators.vectors import pairs_above
from ledgerlens.runtime import Scratch

#: Seconds between the starts of two nodes of an event at most, and the cosine that two texts must exceed.
WINDOW, ALIKE = 30.0, 0.75


def event_edges(nodes: DataFrame, mentions: DataFrame, window: float = WINDOW, alike: float = ALIKE) -> DataFrame:
    """(a, b): nodes of one case that start within ``window`` seconds (the bound is in) and share an entity or have texts above ``alike``.

    Nodes have case_id, node_id, start_time and text_embedding (of one dimension, or null); mentions entity_id and node_id. Times
    meet in slots, entities by themselves, vectors in slots of time, so that no pair is made that is far apart.
    """
    timed = nodes.filter("start_time is not null and case_id is not null")
    named = mentions.join(timed.select("case_id", "node_id", "start_time"), "node_id").withColumn("key", F.concat_ws("|", "case_id", "entity_id"))
    shared = band_join(named.select("key", "node_id", "start_time").distinct(), "key", "start_time", window, "node_id").select(F.col("node_id").alias("a"), F.col("b_node_id").alias("b"))
    # A pair within the window lies in one slot or in two neighbouring ones: each row joins its own slot and the one before.
    slot = F.floor(F.col("start_time") / window)
    slots = timed.filter("text_embedding is not null").withColumn("slot", F.explode(F.array(slot - 1, slot))).withColumn("key", F.concat_ws("|", "case_id", "slot"))
    like = pairs_above(slots, "key", "node_id", "text_embedding", alike).select("a", "b").distinct()
    at = timed.select("node_id", "start_time")
    near = like.join(at.select(F.col("node_id").alias("a"), F.col("start_time").alias("ta")), "a").join(at.select(F.col("node_id").alias("b"), F.col("start_time").alias("tb")), "b")
    return shared.unionByName(near.filter(F.abs(F.col("ta") - F.col("tb")) <= window).select("a", "b")).distinct()


def timeline_events(nodes: DataFrame, mentions: DataFrame, window: float = WINDOW, alike: float = ALIKE) -> tuple[DataFrame, DataFrame]:
    """The events (case_id, event_id, description, start_time, end_time, members) and the links (event_id, node_id).

    An event is a component of event_edges(), so it has two members at least; its id is its smallest node's. See
    event_edges() for the columns; nodes have end_time too.
    """
    grouped = components(event_edges(nodes, mentions, window, alike), "a", "b")
    links = Scratch(nodes.sparkSession).cut(grouped.select(F.col("component").alias("event_id"), F.col("node").alias("node_id")), "event_links")
    inside = links.join(nodes.select("case_id", "node_id", "start_time", "end_time"), "node_id")
    events = inside.groupBy("case_id", "event_id").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count(F.lit(1)).alias("members"))
    return events.select("case_id", "event_id", event_label(F.col("members"), F.col("start_time"), F.col("end_time")).alias("description"), "start_time", "end_time", "members"), links
