"""Questions: intent, facts by intent, and an answer by a model or from a template.

Tables of a case: nodes (node_id, source_file_id, node_type, start_time, end_time, page_number, text_content, claim,
text_embedding), files (source_file_id, case_id, file_name), entities (id, entity_type, canonical_name, normalized_name),
mentions (entity_id, node_id), edges (node_a, node_b, relationship_type, confidence, explanation), identities
(identity_id, display_name) and links (identity_id, node_id, via). Facts are (rank, label, detail, node_id).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.labels import LEADS, NO_FACTS, NO_QUESTION
from ledgerlens.functions.text import QUESTION_STOPWORDS, intent, keywords, seconds_in, snippet, subject
from ledgerlens.operators.identity import identities_matching, identities_of_nodes, identity_evidence
from ledgerlens.plans.pack import co_mentioned, evidence_pack, nodes_naming, relations_about
from ledgerlens.plans.search import keyword_hits, vector_hits

#: Seconds round a time that a question names, facts at most, cosine from which a text may answer, identities that a name may mean.
AROUND, LIMIT, FLOOR, NAMED = 30.0, 10, 0.2, 3


@dataclass
class Question:
    kind: str
    subject: str | None
    seconds: float | None
    before: bool | None
    terms: list[str]


@dataclass
class Case:
    nodes: DataFrame
    files: DataFrame
    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame
    identities: DataFrame
    links: DataFrame


def read_question(spark: SparkSession, text: str) -> Question:
    """The intent and what the question names; the expressions are those that a whole column of questions goes through."""
    q = F.lit(text)
    r = spark.range(1).select(intent(q).alias("kind"), subject(q).alias("subject"), seconds_in(q).alias("seconds"), q.rlike(r"(?i)\bbefore\b").alias("b"), q.rlike(r"(?i)\bafter\b").alias("a"), keywords(q, QUESTION_STOPWORDS).alias("terms")).first()
    return Question(r.kind, r.subject, r.seconds, True if r.b else False if r.a else None, r.terms)


def where(start: Column, end: Column, page: Column) -> Column:
    """The times of a node, its page, or nothing."""
    return F.when(start.isNotNull(), F.format_string("at %.1f-%.1fs ", start, F.coalesce(F.nullif(end, F.lit(0.0)), start))).when(page.isNotNull(), F.concat(F.lit("at p"), page, F.lit(" "))).otherwise("")


def content() -> Column:
    return F.coalesce(snippet(F.col("text_content"), 220), F.lit(""))


def node_facts(case: Case, ids: DataFrame) -> DataFrame:
    """(node_id, label, detail) of the nodes of ``ids``."""
    rows = case.nodes.join(ids, "node_id", "left_semi").join(case.files.select("source_file_id", "file_name"), "source_file_id")
    label = F.concat("node_type", F.lit(" "), where(F.col("start_time"), F.col("end_time"), F.col("page_number")), F.lit("in "), "file_name")
    return rows.select("node_id", "start_time", "page_number", label.alias("label"), content().alias("detail"))


def _ranked(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in an order, numbered: ordering a few rows needs one task only after the limit."""
    few = rows.orderBy(*order).limit(limit)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "label", "detail", "node_id")


def entity_facts(case: Case, name: str | None, limit: int = LIMIT) -> DataFrame | None:
    if not name:
        return None
    some = nodes_naming(case.mentions, case.entities, name).orderBy("node_id").limit(limit)
    return _ranked(node_facts(case, some), [F.col("start_time").asc_nulls_last(), F.col("page_number").asc_nulls_last(), F.col("node_id")], limit)


def contradiction_facts(case: Case, name: str | None, limit: int = LIMIT) -> DataFrame:
    got = relations_about(case.edges, case.nodes, case.files, name, limit=limit)
    label = F.concat("relationship_type", F.lit(" between "), "type_a", F.lit(" in "), "file_a", F.lit(" and "), "type_b", F.lit(" in "), "file_b")
    rows = got.select("relationship_type", "confidence", "node_a", "node_b", label.alias("label"), F.coalesce("explanation", F.lit("")).alias("detail"), F.col("node_a").alias("node_id"))
    return _ranked(rows, [F.col("relationship_type"), F.col("confidence").desc_nulls_last(), F.col("node_a"), F.col("node_b")], limit)


def identity_facts(case: Case, name: str | None, limit: int = LIMIT) -> DataFrame | None:
    """The evidence of up to NAMED identities of that name, each cut to the limit."""
    if not name:
        return None
    some = identities_matching(case.identities, name).orderBy("display_name", "identity_id").limit(NAMED)
    seen = identity_evidence(case.links, case.nodes, case.files).join(some.select("identity_id", "display_name"), "identity_id")
    order = [F.col("start_time").asc_nulls_last(), F.col("page_number").asc_nulls_last(), F.col("node_id")]
    cut = seen.withColumn("_n", F.row_number().over(Window.partitionBy("identity_id").orderBy(*order))).filter(F.col("_n") <= limit)
    at = F.when(F.col("start_time").isNotNull(), F.format_string(" at %.1fs", "start_time")).otherwise("")
    label = F.concat(F.coalesce("display_name", F.lit("unnamed identity")), F.lit(": "), "node_type", at, F.lit(" in "), "file_name", F.lit(" (via "), "via", F.lit(")"))
    return _ranked(cut.select("identity_id", "_n", label.alias("label"), content().alias("detail"), "node_id"), [F.col("identity_id"), F.col("_n")], NAMED * limit)


def co_occurrence_facts(case: Case, name: str | None, limit: int = LIMIT) -> DataFrame | None:
    """Other entities of the nodes that name the subject, then the identities of these nodes."""
    if not name:
        return None
    others = co_mentioned(case.mentions, case.entities, name, limit)
    first = others.select(F.lit(0).alias("part"), (-F.col("shared_nodes")).alias("o"), F.col("canonical_name").alias("label0"), F.concat("canonical_name", F.lit(" ("), "entity_type", F.lit(")")).alias("label"), F.concat(F.lit("co-mentioned in "), "shared_nodes", F.lit(" shared node(s)")).alias("detail"), F.col("sample_node").alias("node_id"))
    some = nodes_naming(case.mentions, case.entities, name).orderBy("node_id").limit(limit)
    known = identities_of_nodes(case.links, case.identities, some).select(F.coalesce("display_name", F.lit("unnamed identity")).alias("label"), "via").distinct()
    then = known.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("o"), F.col("label").alias("label0"), "label", F.concat(F.lit("linked to this evidence via "), "via").alias("detail"), F.lit(None).cast("string").alias("node_id"))
    return _ranked(first.unionByName(then), [F.col("part"), F.col("o"), F.col("label0"), F.col("detail")], 2 * limit)


def timeline_facts(case: Case, q: Question, limit: int = LIMIT) -> DataFrame | None:
    """Evidence before, after or round a time: one that the question names, else the subject's first (before) or last."""
    anchor = q.seconds
    if anchor is None and q.subject:
        named = nodes_naming(case.mentions, case.entities, q.subject)
        r = case.nodes.join(named, "node_id", "left_semi").agg(F.min("start_time").alias("first"), F.max("end_time").alias("last")).first()
        anchor = r.first if q.before else r.last
    if anchor is None:
        return None
    start, end = (None, anchor) if q.before is True else (anchor, None) if q.before is False else (max(0.0, anchor - AROUND), anchor + AROUND)
    pack = evidence_pack(case.nodes, case.files, case.edges, start=start, end=end)
    at = F.when(F.col("start_time").isNotNull(), F.format_string("%.1fs", "start_time")).otherwise("?")
    rows = pack.select("start_time", "page_number", F.concat("node_type", F.lit(" at "), at, F.lit(" in "), "file_name").alias("label"), content().alias("detail"), "node_id")
    return _ranked(rows, [F.col("start_time").asc_nulls_last(), F.col("page_number").asc_nulls_last(), F.col("node_id")], limit)


def general_facts(case: Case, q: Question, vector: list[float] | None = None, limit: int = LIMIT) -> DataFrame:
    """Texts with the question's words, then those that are near in meaning and not among them, cut to the limit."""
    hits = case.nodes.limit(0).select("node_id", F.lit(0).alias("part"), F.lit(0.0).alias("o"), F.lit(0).alias("size"))
    if q.terms:
        found = keyword_hits(case.nodes.filter("text_content is not null"), "node_id", "text_content", q.terms, limit).join(case.nodes.select("node_id", F.length("text_content").alias("size")), "node_id")
        hits = hits.unionByName(found.select("node_id", F.lit(0).alias("part"), (-F.col("matches")).cast("double").alias("o"), "size"))
    if vector is not None:
        near = vector_hits(case.nodes.filter(F.size("text_embedding") == len(vector)), "node_id", "text_embedding", vector, limit).filter(F.col("score") >= FLOOR)
        hits = hits.unionByName(near.join(hits.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(1).alias("part"), (-F.col("score")).alias("o"), F.lit(0).alias("size")))
    rows = hits.join(node_facts(case, hits.select("node_id")), "node_id")
    return _ranked(rows, [F.col("part"), F.col("o"), F.col("size"), F.col("node_id")], limit)


def facts(case: Case, q: Question, vector: list[float] | None = None, limit: int = LIMIT) -> DataFrame:
    """The facts for a question by its intent; what finds nothing gives way to a general search."""
    by = {"entity": lambda: entity_facts(case, q.subject, limit), "contradiction": lambda: contradiction_facts(case, q.subject, limit), "identity": lambda: identity_facts(case, q.subject, limit), "co_occurrence": lambda: co_occurrence_facts(case, q.subject, limit), "timeline": lambda: timeline_facts(case, q, limit)}
    got = by[q.kind]() if q.kind in by else None
    return general_facts(case, q, vector, limit) if got is None or got.isEmpty() else got


def answer(kind: str, found: DataFrame, complete: Callable[[str], str | None] | None = None, question: str = "") -> str:
    """The model's answer over the facts where there is one and it says something, else a lead, the number of facts and a line for each."""
    rows = found.orderBy("rank").collect()  # LIMIT facts, or a few times as many
    if not rows:
        return NO_FACTS
    lines = "\n".join(f"- {r.label}: {r.detail}" if r.detail else f"- {r.label}" for r in rows)
    if complete is not None:
        said = complete(f"Answer only from the facts.\nQuestion: {question}\nFacts:\n{lines}")
        if said and said.strip():
            return said.strip()
    return f"{LEADS.get(kind, 'Evidence found')} ({len(rows)} item(s)):\n{lines}"


def ask(spark: SparkSession, case: Case, question: str, encode: Callable[[str], list[float] | None] | None = None, complete: Callable[[str], str | None] | None = None) -> tuple[str, str]:
    """(intent, answer) of a question."""
    text = re.sub(r"^\s+|\s+$", "", question)
    if not text:
        return "general", NO_QUESTION
    q = read_question(spark, text)
    return q.kind, answer(q.kind, facts(case, q, encode(text) if encode else None), complete, text)
