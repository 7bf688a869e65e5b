"""Reports: coverage, summaries of the graph, listings in their orders, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.media import findings



def last(column: str) -> Column:
    return F.col(column).asc_nulls_last()


def pack_order() -> list[Column]:
    return [last("start_time"), last("page_number")]


def file_order() -> list[Column]:
    return [last("page_number"), last("start_time"), last("created_at")]


def enrich_order() -> list[Column]:
    return [F.col("source_file_id"), last("page_number"), last("start_time")]


def relation_order() -> list[Column]:
    return [F.col("relationship_type"), F.col("confidence").desc_nulls_last()]


def index_coverage(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, total, visual, text): nodes of each case and those with a vector; the row with a null case is the whole."""
    flags = nodes.select("source_file_id", F.col("clip_embedding").isNotNull().cast("long").alias("v"), F.col("text_embedding").isNotNull().cast("long").alias("t"))
    # Counted by file first, so that the join meets one row for each file.
    by_file = flags.groupBy("source_file_id").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum("t").alias("t"))
    own = by_file.join(files.select("source_file_id", "case_id"), "source_file_id")
    return own.rollup("case_id").agg(F.sum("n").alias("total"), F.sum("v").alias("visual"), F.sum("t").alias("text"))


def audio_coverage(nodes: DataFrame) -> DataFrame:
    """(node_type, total, with_embedding, missing)."""
    got = nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("total"), F.count("audio_embedding").alias("with_embedding"))
    return got.withColumn("missing", F.col("total") - F.col("with_embedding"))


def type_counts(df: DataFrame, scope: str, kind: str, name: str) -> DataFrame:
    """(<scope>, <name>): a map from type to count."""
    by = df.groupBy(scope, kind).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy(scope).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias(name))


def graph_summary(cases: DataFrame, counted: dict[str, DataFrame], typed: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """A row for each case_id: the count of each frame of ``counted`` (all have case_id) and the type map of each of ``typed`` (frame, type column)."""
    out = cases.select("case_id").distinct()
    for name, df in counted.items():
        out = out.join(df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name)), "case_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    for name, (df, kind) in typed.items():
        out = out.join(type_counts(df, "case_id", kind, name), "case_id", "left")
    return out


def findings_digest(nodes: DataFrame, latest: int = 8, most: int = 12) -> DataFrame:
    """(case_id, findings): what models concluded about the latest enriched nodes, each line once, in order. Nodes have case_id, node_id, enriched_at, metadata."""
    newest = Window.partitionBy("case_id").orderBy(F.desc("enriched_at"), "node_id")
    some = nodes.filter("enriched_at is not null").withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= latest)
    lines = some.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("n", findings(F.col("metadata")).alias("f")))).alias("all"))
    return lines.select("case_id", F.slice(F.array_distinct(F.flatten(F.transform("all", lambda s: s["f"]))), 1, most).alias("findings"))


def distinct_in_order(df: DataFrame, key: str, order: list[Column], value: str, most: int) -> DataFrame:
    """(<key>, <value>, at): the first ``most`` distinct values of each key in order of their first appearance."""
    first = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*order)).alias("_at"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_at", value))
    return first.withColumn("at", place).filter(F.col("at") <= most).select(key, value, "at")


def newest_first(df: DataFrame, at: str, id_col: str, limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.col(at).desc_nulls_last(), id_col)
    return out if limit is None else out.limit(limit)


def roll_up(report: DataFrame) -> DataFrame:
    """One row of a run's report (status, node_count): all nodes, and the files of each status."""
    by = report.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("node_count").alias("nodes"))
    return by.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("total_nodes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "files")))).alias("files_by_status"))


def entity_groups(mentions: DataFrame, key: str = "entity_id", least: int = 2) -> DataFrame:
    """(<key>, node_ids): the groups of ``least`` distinct nodes and more; of entities or of events."""
    return mentions.groupBy(key).agg(F.array_sort(F.collect_set("node_id")).alias("node_ids")).filter(F.size("node_ids") >= least)


def candidates(nodes: DataFrame, kinds: list[str] | None = None, with_text: bool = False, with_vector: str | None = None, timed: bool = False) -> DataFrame:
    """The nodes that a step takes: of some types, with text, with a vector, with times; each filter reaches the scan."""
    if kinds is not None:
        nodes = nodes.filter(F.col("node_type").isin(kinds))
    if with_text:
        nodes = nodes.filter("text_content <> ''")
    if with_vector:
        nodes = nodes.filter(F.col(with_vector).isNotNull())
    return nodes.filter("start_time is not null and end_time is not null") if timed else nodes
