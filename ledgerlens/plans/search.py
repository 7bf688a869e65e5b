"""Search: keyword and vector hits, floors and gates, and their merge."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import KEYWORD, MAX_TERMS, MIN_TERM, SEARCH_STOPWORDS, match_count, snippet
from ledgerlens.functions.vector import cosine_to

# Floors, gates relative to the best hit, and weights of the two spaces.
FLOOR = {"visual": 0.24, "text": 0.25}
GATE = {"visual": 0.85, "text": 0.60}
WEIGHT = {"visual": 0.45, "text": 0.55}
#: The columns that may be searched.
SPACES = {"visual": "clip_embedding", "text": "text_embedding"}


def over_fetch(limit: int) -> int:
    return min(3 * limit, 200)


def keyword_hits(nodes: DataFrame, id_col: str, text: str, terms: list[str], limit: int) -> DataFrame:
    """(<id_col>, matches, score): texts with most of the terms, the shorter first."""
    n = match_count(F.col(text), terms)
    hits = nodes.select(id_col, n.alias("matches"), F.length(text).alias("_size")).filter("matches > 0")
    return hits.orderBy(F.desc("matches"), "_size", id_col).limit(limit).select(id_col, "matches", (F.col("matches") / len(terms)).alias("score"))


def vector_hits(nodes: DataFrame, id_col: str, vector: str, query: list[float], limit: int) -> DataFrame:
    """(<id_col>, score): the nearest vectors by cosine. Each task keeps its own best before they are merged."""
    return nodes.select(id_col, cosine_to(F.col(vector), query).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def floor_and_gate(hits: DataFrame, space: str, floor: float | None = None, gate: float | None = None) -> DataFrame:
    """Hits that reach the floor and the share of the best hit; the best is a frame of one row."""
    floor, gate = FLOOR[space] if floor is None else floor, GATE[space] if gate is None else gate
    above = hits.filter(F.col("score") >= floor)
    best = above.agg(F.max("score").alias("_best"))
    return above.join(F.broadcast(best), F.col("score") >= F.col("_best") * gate).drop("_best")


def hybrid(visual: DataFrame, text: DataFrame, id_col: str, limit: int) -> DataFrame:
    """(<id_col>, score, matched_on): weighted sums of both spaces; tags are those of the hits (a list ``matched_on``), else the space's name."""
    parts = []
    for name, df in (("visual", visual), ("text", text)):
        tags = F.col("matched_on") if "matched_on" in df.columns else F.array(F.lit(name))
        parts.append(df.select(id_col, (F.col("score") * WEIGHT[name]).alias("part"), tags.alias("tags")))
    merged = parts[0].unionByName(parts[1]).groupBy(id_col).agg(F.sum("part").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("matched_on"))
    return best_first(merged, id_col).limit(limit)


def best_first(hits: DataFrame, id_col: str) -> DataFrame:
    """By falling score; scores that differ only in their last digits are equal, and go by id."""
    return hits.orderBy(F.desc(F.round("score", 12)), id_col)


def fold_keywords(text: DataFrame, keyword: DataFrame, id_col: str) -> DataFrame:
    """(<id_col>, score, matched_on): both kinds of hits; a cosine wins over a keyword score, and the tags say which found it."""
    both = text.select(id_col, F.col("score").alias("_t")).join(keyword.select(id_col, F.col("score").alias("_k")), id_col, "full_outer")
    tags = F.array_compact(F.array(F.when(F.col("_k").isNotNull(), "keyword"), F.when(F.col("_t").isNotNull(), "text")))
    return both.select(id_col, F.coalesce("_t", "_k").alias("score"), tags.alias("matched_on"))


def space_hits(nodes: DataFrame, space: str, query: list[float], limit: int, id_col: str = "node_id") -> DataFrame:
    """(<id_col>, score) of one space: its nearest vectors that reach floor and gate. Only the columns of SPACES are searched."""
    if space not in SPACES:
        raise ValueError(f"no such space: {space}")
    column = SPACES[space]
    there = nodes.filter(F.size(column) == len(query))
    return floor_and_gate(vector_hits(there, id_col, column, query, over_fetch(limit)), space)


def search(nodes: DataFrame, words: str, visual: list[float] | None, text: list[float] | None, mode: str = "hybrid", case_id: str | None = None, limit: int = 40) -> DataFrame:
    """(node_id, score, matched_on): the best nodes for a question in words, and its vectors in the spaces where there is an encoder.

    Nodes have node_id, case_id, text_content, text_embedding, clip_embedding. A blank question finds nothing; a space without
    a vector is left out. Scores are weighted only where both spaces meet. Equal scores go by id.
    """
    if mode not in ("hybrid", "visual", "text"):
        raise ValueError(f"no such mode: {mode}")
    rows = nodes if case_id is None else nodes.filter(F.col("case_id") == case_id)
    none = rows.limit(0).select("node_id", F.lit(0.0).alias("score"), F.array(F.lit("")).alias("matched_on"))
    if not words.strip():
        return none
    seen = read = None
    if mode != "text":
        seen = space_hits(rows, "visual", visual, limit).withColumn("matched_on", F.array(F.lit("visual"))) if visual else none
    if mode != "visual":
        near = space_hits(rows, "text", text, limit) if text else none.select("node_id", "score")
        terms = search_terms(words)
        found = keyword_hits(rows.filter("text_content is not null"), "node_id", "text_content", terms, over_fetch(limit)) if terms else none
        read = fold_keywords(near, found, "node_id")
    if mode == "hybrid":
        return hybrid(seen, read, "node_id", limit)
    return best_first(seen if read is None else read, "node_id").limit(limit)


def search_terms(words: str) -> list[str]:
    """The terms of a question, as functions.text.keywords() takes them from a column."""
    long = (w.lower() for w in re.findall(KEYWORD, words) if len(w) >= MIN_TERM)
    return list(dict.fromkeys(w for w in long if w not in SEARCH_STOPWORDS))[:MAX_TERMS]


def shown_hits(hits: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Hits as they are shown: with a snippet, the score to four places, and what their node and file are."""
    own = hits.join(nodes.select("node_id", "source_file_id", "node_type", "start_time", "end_time", "page_number", "text_content"), "node_id").join(files.select("source_file_id", "file_name", "file_type", "case_id"), "source_file_id")
    return own.select("node_id", "source_file_id", "file_name", "file_type", "case_id", "node_type", "start_time", "end_time", "page_number", snippet(F.col("text_content")).alias("snippet"), F.round("score", 4).alias("score"), "matched_on")
