"""A case folder made into tables: scan, registration, extraction of what is new, each file on its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.labels import integrity_note
from ledgerlens.operators.merge import replace_by_key
from ledgerlens.runtime import Scratch
from ledgerlens.sources.processors import Registry, extract, node_rows


@dataclass
class Ingested:
    files: DataFrame
    nodes: DataFrame
    report: DataFrame


def register_files(stored: DataFrame, scanned: DataFrame, case_id: str) -> DataFrame:
    """Scanned files (file_path, sha256, ...) with their id, ``known`` where the case has that content, and the previous hash where the path's content changed.

    Ids depend on case and content alone, so a file that comes again is the same row. Two paths of equal content are one file: the smaller path's.
    """
    one = scanned.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in scanned.columns if c != "sha256"]), "file_path").alias("f")).select("sha256", "f.*")
    own = stored.filter(F.col("case_id") == case_id)
    last = own.groupBy("file_path").agg(F.max_by("sha256", F.struct("registered_at", "id")).alias("last_hash"))
    known = own.select("sha256", F.lit(True).alias("known")).distinct()
    got = one.join(last, "file_path", "left").join(known, "sha256", "left")
    named = got.withColumn("case_id", F.lit(case_id)).withColumn("id", F.sha2(F.concat_ws("\u0001", F.lit("file"), F.lit(case_id), "sha256"), 256))
    return named.withColumn("known", F.coalesce("known", F.lit(False))).withColumn("previous_hash", F.when(F.col("last_hash") != F.col("sha256"), F.col("last_hash"))).drop("last_hash")


def split_unchanged(registered: DataFrame, nodes: DataFrame, reprocess: bool = False) -> tuple[DataFrame, DataFrame]:
    """The files to extract, and those whose nodes stay: content as before, nodes there, no wish to do it again. The latter have total and enriched."""
    stats = nodes.groupBy(F.col("source_file_id").alias("id")).agg(F.count(F.lit(1)).alias("total"), F.count("enriched_at").alias("enriched"))
    both = registered.join(stats, "id", "left")
    keep = F.col("total").isNotNull() & F.col("previous_hash").isNull() & ~F.lit(reprocess)
    return both.filter(~keep), both.filter(keep)


def ingest(scanned: DataFrame, stored_files: DataFrame, stored_nodes: DataFrame, case_id: str, registry: Registry, reprocess: bool = False) -> Ingested:
    """The new tables and a report (file_name, media_type, status, node_count, detail) of a scan.

    Scanned rows have file_path, file_name, media_type, sha256, size_bytes, declared_type, detected_mime, type_mismatch and
    status; those ``skipped`` by the scan are only reported. Nodes of extracted files replace what these had; files that fail keep theirs.
    """
    scratch = Scratch(scanned.sparkSession)
    good = scanned.filter("status = 'registered'").drop("status", "detail")
    registered = scratch.cut(register_files(stored_files, good, case_id), "registered")
    todo, kept = split_unchanged(registered, stored_nodes, reprocess)
    got = scratch.cut(extract(todo.select(F.col("id").alias("source_file_id"), "file_path", "file_name", "media_type", "sha256"), registry), "extracted")
    fresh = node_rows(got)
    for c in stored_nodes.columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(stored_nodes.schema[c].dataType))
    nodes = replace_by_key(stored_nodes, fresh.select(*stored_nodes.columns), "source_file_id")
    new = registered.filter("not known").withColumn("registered_at", F.current_timestamp())
    files = stored_files.unionByName(new.select(*[c for c in stored_files.columns if c in new.columns]), allowMissingColumns=True)
    note = integrity_note(F.col("previous_hash"), F.col("type_mismatch"), F.col("declared_type"), F.col("file_name"), F.col("detected_mime"))
    done = got.groupBy("source_file_id").agg(F.max("status").alias("status"), F.max("detail").alias("why"), F.count("draft").alias("node_count")).withColumnRenamed("source_file_id", "id")
    told = registered.join(done, "id").select("file_name", "media_type", "status", "node_count", F.nullif(F.concat_ws("; ", "why", note), F.lit("")).alias("detail"))
    same = kept.select("file_name", "media_type", F.lit("unchanged").alias("status"), F.col("total").alias("node_count"), F.concat(F.lit("identical to last ingest; "), "total", F.lit(" node(s), "), "enriched", F.lit(" enriched")).alias("detail"))
    left = scanned.filter("status = 'skipped'").select("file_name", F.coalesce("media_type", F.lit("unknown")).alias("media_type"), "status", F.lit(0).cast("long").alias("node_count"), "detail")
    return Ingested(files, nodes, told.unionByName(same).unionByName(left))
