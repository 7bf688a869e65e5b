"""Packs of evidence with their relations, edges of a node, relations about a subject."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAIM_EDGES = ["CONTRADICTS", "CORROBORATES"]


def all_of(clauses: list[Column | None]) -> Column:
    """The conjunction of the clauses that are given; true where none is."""
    return reduce(lambda a, b: a & b, [c for c in clauses if c is not None], F.lit(True))


def equal_if_given(column: str, value: object | None) -> Column | None:
    return None if value is None else F.col(column) == value


def pattern(text: str, escaped: bool = False) -> str:
    """A LIKE pattern for a part of a text; its own wildcards count as such unless escaped."""
    return "%" + (text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if escaped else text) + "%"


def naming(entities: DataFrame, name: str, escaped: bool = False) -> DataFrame:
    """Entities whose normalised name holds ``name``, in small letters."""
    return entities.filter(F.col("normalized_name").like(pattern(name.lower(), escaped)))


def nodes_naming(mentions: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    return mentions.join(naming(entities, name).select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("node_id").distinct()


def entities_with_nodes(mentions: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """(entity_id, canonical_name, node_ids): the entities of that name with their nodes, each once, in order."""
    own = naming(entities, name).select(F.col("id").alias("entity_id"), "canonical_name")
    return mentions.join(own, "entity_id").groupBy("entity_id", "canonical_name").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


def both_ends(edges: DataFrame, near: str, far: str, *cols: str) -> DataFrame:
    """Each edge from either of its ends: (near, far, ...)."""
    ends = F.explode(F.array(F.struct(F.col(near).alias("near"), F.col(far).alias("far")), F.struct(F.col(far).alias("near"), F.col(near).alias("far"))))
    return edges.select(ends.alias("_e"), *cols).select("_e.near", "_e.far", *cols)


def evidence_pack(nodes: DataFrame, files: DataFrame, edges: DataFrame, mentions: DataFrame | None = None, entities: DataFrame | None = None, case_id: str | None = None, entity: str | None = None, start: float | None = None, end: float | None = None, only_conflicts: bool = False) -> DataFrame:
    """Nodes of a case, entity and window, each with the relations it is part of; filters narrow together.

    Nodes have node_id, source_file_id, node_type, start_time, end_time, page_number, claim, text_content; files source_file_id,
    case_id, file_name; edges node_a, node_b, relationship_type, confidence, explanation. The window is closed on both sides;
    a node without times is left out only where a window is asked for. Relations are in the order of type and falling
    confidence, those without one last. ``only_conflicts`` keeps nodes with a relation.
    """
    own = nodes.select("node_id", "source_file_id", "node_type", "start_time", "end_time", "page_number", "claim", "text_content")
    rows = own.join(files.select("source_file_id", "case_id", "file_name"), "source_file_id")
    window = [None if start is None else F.col("end_time") >= start, None if end is None else F.col("start_time") <= end]
    rows = rows.filter(all_of([equal_if_given("case_id", case_id), *window]))
    if entity:
        rows = rows.join(nodes_naming(mentions, entities, entity), "node_id", "left_semi")
    kinds = nodes.select(F.col("node_id").alias("far"), F.col("node_type").alias("far_type"))
    ends = both_ends(edges.filter(F.col("relationship_type").isin(CLAIM_EDGES)), "node_a", "node_b", "relationship_type", "confidence", "explanation")
    # Ends of nodes outside the pack are gone before the lists are gathered.
    ends = ends.join(rows.select(F.col("node_id").alias("near")), "near", "left_semi").join(kinds, "far")
    order = F.struct("relationship_type", F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("o"), F.col("far").alias("other_node_id"), F.col("far_type").alias("other_node_type"), "confidence", "explanation")
    lists = ends.groupBy(F.col("near").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: s.dropFields("o")).alias("relations"))
    out = rows.join(lists, "node_id", "inner" if only_conflicts else "left")
    none = F.array().cast(lists.schema["relations"].dataType)
    return out.select("node_id", "node_type", "start_time", "end_time", "page_number", "claim", "text_content", "file_name", F.coalesce("relations", none).alias("relations"))


def in_order(pack: DataFrame) -> DataFrame:
    return pack.orderBy(F.col("start_time").asc_nulls_last(), F.col("page_number").asc_nulls_last(), "node_id")


def node_edges(alignments: DataFrame, edges: DataFrame, mentions: DataFrame, links: DataFrame) -> DataFrame:
    """(near, far, kind, score): every edge of every table from its node's end; those of alignments and claims from both.

    Alignments have a, b, kind, score; edges node_a, node_b, relationship_type, confidence; mentions node_id, entity_id,
    confidence; links node_id, identity_id, confidence.
    """
    drawn = both_ends(alignments, "a", "b", "kind", "score")
    claimed = both_ends(edges.select("node_a", "node_b", F.col("relationship_type").alias("kind"), F.col("confidence").alias("score")), "node_a", "node_b", "kind", "score")
    named = mentions.select(F.col("node_id").alias("near"), F.col("entity_id").alias("far"), F.lit("MENTIONS").alias("kind"), F.col("confidence").alias("score"))
    linked = links.select(F.col("node_id").alias("near"), F.col("identity_id").alias("far"), F.lit("IDENTITY_LINK").alias("kind"), F.col("confidence").alias("score"))
    return drawn.unionByName(claimed).unionByName(named).unionByName(linked)


def other_end(a: Column, b: Column, own: Column) -> Column:
    return F.when(a == own, b).otherwise(a)


def relations_about(edges: DataFrame, nodes: DataFrame, files: DataFrame, subject: str | None, kinds: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Edges of claims with both their ends' types and files; with a subject, those whose explanation, claims or texts hold it, in any case."""
    side = lambda s: nodes.join(files.select("source_file_id", "file_name"), "source_file_id").select(F.col("node_id").alias(f"node_{s}"), F.col("node_type").alias(f"type_{s}"), F.col("file_name").alias(f"file_{s}"), F.col("claim").alias(f"claim_{s}"), F.col("text_content").alias(f"text_{s}"))
    own = edges.select("node_a", "node_b", "relationship_type", "confidence", "explanation")
    both = own.filter(F.col("relationship_type").isin(kinds or CLAIM_EDGES)).join(side("a"), "node_a").join(side("b"), "node_b")
    if subject:
        held = [F.col(c).ilike(pattern(subject)) for c in ("explanation", "claim_a", "claim_b", "text_a", "text_b")]
        both = both.filter(reduce(lambda x, y: x | y, [F.coalesce(h, F.lit(False)) for h in held]))
    return both.orderBy("relationship_type", F.col("confidence").desc_nulls_last(), "node_a", "node_b").limit(limit).select("relationship_type", "node_a", "node_b", "type_a", "type_b", "file_a", "file_b", "confidence", "explanation")


def co_mentioned(mentions: DataFrame, entities: DataFrame, subject: str, limit: int = 10) -> DataFrame:
    """(entity_id, canonical_name, entity_type, shared_nodes, sample_node): other entities in the nodes that name the subject."""
    named = naming(entities, subject).select(F.col("id").alias("entity_id"))
    there = mentions.join(named, "entity_id", "left_semi").select("node_id", F.col("entity_id").alias("subject_id"))
    others = mentions.select("node_id", "entity_id").join(there, "node_id").filter("entity_id <> subject_id")
    counted = others.groupBy("entity_id").agg(F.countDistinct("node_id").alias("shared_nodes"), F.min("node_id").alias("sample_node"))
    top = counted.join(entities.select(F.col("id").alias("entity_id"), "canonical_name", "entity_type"), "entity_id").orderBy(F.desc("shared_nodes"), "canonical_name", "entity_id").limit(limit)
    return top.select("entity_id", "canonical_name", "entity_type", "shared_nodes", "sample_node")
