"""The graph of a case as nodes and edges of one shape, and its filter by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.labels import evidence_label, seconds_label
from ledgerlens.functions.media import shortened

NODE, EDGE = ["id", "label", "type", "weight", "detail", "node_id"], ["source", "target", "type", "weight", "detail"]


def top_entities(entities: DataFrame, most: int = 150) -> DataFrame:
    """The entities of each case that are mentioned most; equal ones go by id. Each task keeps its own best before they meet."""
    order = Window.partitionBy("case_id").orderBy(F.desc("mention_count"), "id")
    return entities.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


def co_occurrences(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, weight): pairs of the given entities, and the nodes that name both."""
    own = mentions.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("node_id", "entity_id").distinct()
    a, b = own.withColumnRenamed("entity_id", "source"), own.withColumnRenamed("entity_id", "target")
    return a.join(b, "node_id").filter("target > source").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def bridges(links: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(identity_id, entity_id), each once: an identity and an entity of the same node."""
    own = mentions.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    return links.filter("identity_id is not null").select("identity_id", "node_id").join(own.select("node_id", "entity_id"), "node_id").select("identity_id", "entity_id").distinct()


def shown_nodes(edges: DataFrame, event_links: DataFrame) -> DataFrame:
    """(node_id): the nodes at the ends of claims' edges and those of events, each once."""
    ends = edges.select(F.explode(F.array("node_a", "node_b")).alias("node_id")).filter("node_id is not null")
    return ends.union(event_links.select("node_id")).distinct()


def graph_nodes(entities: DataFrame, identities: DataFrame, nodes: DataFrame, files: DataFrame, events: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, label, type, weight, detail, node_id): entities, identities, shown evidence and events; ids bear their kind."""
    none = F.lit(None).cast("string")
    e = entities.select(F.concat(F.lit("entity:"), "id").alias("id"), F.col("canonical_name").alias("label"), F.col("entity_type").alias("type"), F.col("mention_count").cast("double").alias("weight"), none.alias("detail"), none.alias("node_id"))
    i = identities.select(F.concat(F.lit("identity:"), "identity_id").alias("id"), F.coalesce(F.nullif("display_name", F.lit("")), F.lit("Unnamed identity")).alias("label"), F.lit("identity").alias("type"), F.lit(1.0).alias("weight"), none.alias("detail"), none.alias("node_id"))
    own = nodes.join(shown, "node_id", "left_semi").join(files.select("source_file_id", "file_name"), "source_file_id")
    detail = F.coalesce(F.nullif("claim", F.lit("")), shortened(F.coalesce("text_content", F.lit("")), 160))
    v = own.select(F.concat(F.lit("node:"), "node_id").alias("id"), evidence_label(F.col("node_type"), F.col("page_number"), F.col("start_time"), F.col("file_name")).alias("label"), F.lit("evidence").alias("type"), F.lit(1.0).alias("weight"), detail.alias("detail"), "node_id")
    span = F.concat(seconds_label(F.col("start_time")), F.lit(" – "), seconds_label(F.col("end_time")))
    t = events.select(F.concat(F.lit("event:"), "event_id").alias("id"), F.coalesce(F.nullif("description", F.lit("")), F.lit("Untitled event")).alias("label"), F.lit("event").alias("type"), F.lit(1.0).alias("weight"), span.alias("detail"), none.alias("node_id"))
    return e.unionByName(i).unionByName(v).unionByName(t)


def graph_edges(pairs: DataFrame, bridged: DataFrame, edges: DataFrame, event_links: DataFrame) -> DataFrame:
    """(source, target, type, weight, detail): co-occurrences, identities' links, claims' edges and events' members."""
    none = F.lit(None).cast("string")
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    c = pairs.select(named("entity", "source").alias("source"), named("entity", "target").alias("target"), F.lit("co_occurs_with").alias("type"), F.col("weight").cast("double").alias("weight"), none.alias("detail"))
    b = bridged.select(named("identity", "identity_id").alias("source"), named("entity", "entity_id").alias("target"), F.lit("identity_link").alias("type"), F.lit(1.0).alias("weight"), none.alias("detail"))
    r = edges.select(named("node", "node_a").alias("source"), named("node", "node_b").alias("target"), F.lower("relationship_type").alias("type"), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)).alias("weight"), F.col("explanation").alias("detail"))
    t = event_links.select(named("event", "event_id").alias("source"), named("node", "node_id").alias("target"), F.lit("belongs_to").alias("type"), F.lit(1.0).alias("weight"), none.alias("detail"))
    return c.unionByName(b).unionByName(r).unionByName(t)


def of_categories(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes of some types, and the edges with both ends among them."""
    kept = nodes.filter(F.col("type").isin(kinds))
    ids = kept.select("id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return kept, edges.select(*EDGE)
