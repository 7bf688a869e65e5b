"""Queries pN_... of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.components import connected_groups
from ledgerlens.llm.leakage import find_leaks
from ledgerlens.llm.names import variant_groups, variant_pairs
from ledgerlens.llm.ocr import build_lexicon, find_noise, repair_pages
from ledgerlens.llm.packing import pack
from ledgerlens.llm.pii import find_pii, redact
from ledgerlens.llm.residue import find_residue
from ledgerlens.llm.similar import similar_pairs, similar_vectors
from ledgerlens.llm.split import split_oversized
from ledgerlens.runtime import ship
from ledgerlens.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "p1_found",
    """
    WITH RECURSIVE pairs AS (
      SELECT DISTINCT upper(regexp_replace(coalesce(alignment_type, ''), '^\\s+|\\s+$', '', 'g')) AS alignment_type, node_a_id AS a, node_b_id AS b
      FROM source_alignment WHERE trim(node_a_id) <> '' AND trim(node_b_id) <> ''
    ), links AS (
      SELECT alignment_type, a, b FROM pairs UNION SELECT alignment_type, b, a FROM pairs
    ), reach AS (
      SELECT DISTINCT alignment_type, a AS node_id, a AS other FROM links
      UNION
      SELECT r.alignment_type, r.node_id, l.b FROM reach AS r JOIN links AS l ON l.alignment_type = r.alignment_type AND l.a = r.other
    )
    SELECT alignment_type, min(other) AS group_id, node_id FROM reach GROUP BY alignment_type, node_id
    """,
)
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return connected_groups(table(spark, folder, "source_alignment"))


@query("p5_found", "SELECT DISTINCT id AS node_id FROM evidence_node WHERE length(text_content) > 4000")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "evidence_node")).filter("piece_no = 1").select(F.col("id").alias("node_id"))


@query("p5_pieces")
def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "evidence_node")).withColumnRenamed("id", "node_id")


@query("p8_containers")
def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


@query("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_residue(table(spark, folder, "documents")).filter("is_residue").select("doc_id")


@query("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("item_id", "doc_id")


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(variant_groups(table(spark, folder, "entity")))


#: The vectors of evidence_node that are searched: name, column and dimension.
VECTOR_FIELDS = {"text": ("text_embedding", 384), "clip": ("clip_embedding", 512)}


@query("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(similar_vectors(table(spark, folder, "evidence_node"), VECTOR_FIELDS, k=5, least=0.7))


@query("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "evidence_node")
    return find_noise(nodes.filter("node_type = 'page'"), lexicon=build_lexicon(nodes)).withColumnRenamed("id", "node_id")


@query("p7_paragraphs")
def p7_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "evidence_node")
    return repair_pages(nodes.filter("node_type = 'page'"), lexicon=build_lexicon(nodes)).withColumnRenamed("id", "node_id")


@query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = find_pii(table(spark, folder, "evidence_node"))
    return found.select(F.col("id").alias("node_id"), "pii_type", "pii_text").distinct()


@query("p4_redacted")
def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact(table(spark, folder, "evidence_node")).withColumnRenamed("id", "node_id")
