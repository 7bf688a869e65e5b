"""Claims of nodes, pairs of them that are worth judging, and verdicts as edges.

Claims have case_id, node_id, claim and text_embedding. Extractor and judge are injected: functions of a series (two
series) of texts that give a series of answers, as a model would; their answers are read by functions.answers.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.answers import claim as read_claim
from ledgerlens.functions.answers import explanation
from ledgerlens.functions.answers import verdict as read_verdict
from ledgerlens.functions.vector import cosine
from ledgerlens.operators.vectors import guarded

#: Nodes of one entity that are paired, cosine of two texts under which a pair isn't judged, pairs judged at most.
NODES, ALIKE, PAIRS = 25, 0.3, 500
# The verdicts that become edges.
EDGES = {"contradicts": "CONTRADICTS", "corroborates": "CORROBORATES"}


def extract_claims(nodes: DataFrame, extractor: Callable[[pd.Series], pd.Series], longest: int = 4_000) -> DataFrame:
    """(node_id, claim) of pending nodes with text: null where the extractor found none, so that it isn't asked again."""
    ask = F.pandas_udf(lambda texts: extractor(texts), "string")
    pending = nodes.filter("claim_extracted_at is null and text_content <> ''")
    return pending.select("node_id", read_claim(ask(F.substring("text_content", 1, longest))).alias("claim"))


def store_claims(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """The nodes with their new claims; what was tried counts as extracted, with a claim or without."""
    new = claims.select("node_id", F.col("claim").alias("_claim"), F.lit(True).alias("_tried"))
    both = nodes.join(new, "node_id", "left")
    return both.withColumn("claim", F.when(F.col("_tried"), F.col("_claim")).otherwise(F.col("claim"))).withColumn("claim_extracted_at", F.when(F.col("_tried"), F.current_timestamp()).otherwise(F.col("claim_extracted_at"))).drop("_claim", "_tried")


def _group_pairs(groups: DataFrame, group: str, origin: str) -> DataFrame:
    a, b = groups.select(group, F.col("node_id").alias("a")), groups.select(group, F.col("node_id").alias("b"))
    return a.join(b, group).filter("a < b").select("a", "b", F.lit(origin).alias("origin"))


def candidate_pairs(mentions: DataFrame, alignments: DataFrame, event_links: DataFrame, cap: int = NODES) -> DataFrame:
    """(node_a, node_b, origins): pairs of nodes of one entity, alignment or event, each once with all that led to it.

    Mentions have entity_id, node_id; alignments a, b, kind; event links event_id, node_id. Of an entity the first ``cap``
    nodes by id are paired: that is the operator's own rule. No pair is made of nodes of other groups.
    """
    order = Window.partitionBy("entity_id").orderBy("node_id")
    capped = mentions.select("entity_id", "node_id").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap)
    named = _group_pairs(capped, "entity_id", "entity")
    linked = alignments.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("kind").alias("origin"))
    events = _group_pairs(event_links.select("event_id", "node_id").distinct(), "event_id", "SAME_EVENT")
    every = named.unionByName(linked).unionByName(events)
    return every.groupBy(F.col("a").alias("node_a"), F.col("b").alias("node_b")).agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def prefilter(pairs: DataFrame, claims: DataFrame, least: float = ALIKE) -> DataFrame:
    """The pairs with claim_a, claim_b and ``reason``: null for those to judge, else ``no_claim`` or ``below_similarity``. A missing vector keeps a pair."""
    side = lambda s: claims.filter("claim is not null").select(F.col("node_id").alias(f"node_{s}"), F.col("claim").alias(f"claim_{s}"), F.col("text_embedding").alias(f"v{s}"))
    both = pairs.join(side("a"), "node_a", "left").join(side("b"), "node_b", "left")
    far = F.col("va").isNotNull() & F.col("vb").isNotNull() & (cosine(F.col("va"), F.col("vb")) < least)
    reason = F.when(F.col("claim_a").isNull() | F.col("claim_b").isNull(), "no_claim").when(far, "below_similarity")
    return both.withColumn("reason", reason).drop("va", "vb")


def tally(filtered: DataFrame) -> DataFrame:
    """One row: pairs proposed, left to judge, and left out by reason."""
    count = lambda r: F.count(F.when(F.col("reason") == r, 1)).alias(r)
    return filtered.agg(F.count(F.lit(1)).alias("proposed"), F.count(F.when(F.col("reason").isNull(), 1)).alias("to_judge"), count("no_claim"), count("below_similarity"))


def judge_pairs(filtered: DataFrame, judge: Callable[[pd.Series, pd.Series], pd.Series], most: int = PAIRS) -> DataFrame:
    """(node_a, node_b, relationship_type, confidence, explanation, origins, claim_a, claim_b): edges of the pairs that aren't unrelated.

    More than ``most`` pairs to judge are an error, as judging costs a model's time; an answer that can't be read gives no edge.
    """
    left = guarded(filtered.filter("reason is null"), most, "pairs to judge")
    ask = F.pandas_udf(lambda a, b: judge(a, b), "string")
    said = left.withColumn("answer", ask("claim_a", "claim_b")).withColumn("v", read_verdict(F.col("answer")))
    kind = F.when(F.col("v.relation") == "contradicts", EDGES["contradicts"]).when(F.col("v.relation") == "corroborates", EDGES["corroborates"])
    return said.withColumn("relationship_type", kind).filter("relationship_type is not null").select("node_a", "node_b", "relationship_type", F.col("v.confidence").alias("confidence"), explanation(F.col("answer")).alias("explanation"), "origins", "claim_a", "claim_b")


def replace_claim_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """All edges but those of claims, and the new ones, each pair and type once."""
    rest = edges.filter(~F.col("relationship_type").isin(list(EDGES.values())))
    return rest.unionByName(new.dropDuplicates(["node_a", "node_b", "relationship_type"]), allowMissingColumns=True)
