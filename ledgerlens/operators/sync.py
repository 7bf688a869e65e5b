"""Clocks of sources brought together: anchors by sound, sight and identity, offsets, and times of the case.

Anchors have case_id, source_a, source_b, time_a, time_b and method. Source a is a case's reference: the first
registered. An offset is the time in b less the time in a; as in the reference it is added to b's times, and ``sign``
turns that round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.labels import consistency, method_label
from ledgerlens.operators.merge import upsert
from ledgerlens.operators.vectors import cross_above
from ledgerlens.runtime import Scratch

#: Cosines that two sounds and two pictures must exceed, confidence of an identity's anchor, seconds within which anchors agree.
SOUND, SIGHT, SURE, AGREE = 0.9, 0.85, 0.95, 1.0
METHODS = ("audio", "visual", "identity")
#: Differences from the middle that an offset keeps.
RESIDUALS = 20


def source_pairs(files: DataFrame) -> DataFrame:
    """(case_id, source_a, source_b): each source of a case against the first registered one."""
    first = files.groupBy("case_id").agg(F.min_by("source_file_id", F.struct("registered_at", "source_file_id")).alias("source_a"))
    return files.select("case_id", F.col("source_file_id").alias("source_b")).distinct().join(first, "case_id").filter("source_a <> source_b").select("case_id", "source_a", "source_b")


def _like(rows: DataFrame, pairs: DataFrame, vector: str, least: float) -> DataFrame:
    """(case_id, source_a, source_b, time_a, time_b, similarity): rows (source_file_id, row_id, start_time, vector) of both sources that are alike."""
    key = F.concat_ws("|", "source_a", "source_b")
    a = pairs.withColumn("pair", key).join(rows, F.col("source_a") == F.col("source_file_id")).select("pair", "row_id", vector)
    b = pairs.withColumn("pair", key).join(rows, F.col("source_b") == F.col("source_file_id")).select("pair", "row_id", vector)
    met = cross_above(a, b, "pair", "row_id", vector, least)
    at = rows.select("row_id", "start_time")
    timed = met.join(at.select(F.col("row_id").alias("a"), F.col("start_time").alias("time_a")), "a").join(at.select(F.col("row_id").alias("b"), F.col("start_time").alias("time_b")), "b")
    return timed.join(pairs.withColumn("pair", key), "pair").select("case_id", "source_a", "source_b", "time_a", "time_b", F.col("score").alias("similarity"))


def audio_anchors(rows: DataFrame, pairs: DataFrame, vector: str = "audio_embedding", least: float = SOUND) -> DataFrame:
    """Anchors of like sounds, with the five-second cluster of the time in a (cut towards zero)."""
    return _like(rows, pairs, vector, least).withColumn("cluster", (F.col("time_a") / 5.0).cast("int")).withColumn("method", F.lit("audio"))


def visual_anchors(rows: DataFrame, pairs: DataFrame, vector: str = "clip_embedding", least: float = SIGHT) -> DataFrame:
    """Anchors of like pictures, each with its consistency: how near its offset is to the middle of those of the same whole second. None is rejected."""
    met = _like(rows, pairs, vector, least).withColumn("offset", F.col("time_b") - F.col("time_a")).withColumn("bin", F.bround("offset", 0).cast("int"))
    keys = ["case_id", "source_a", "source_b", "bin"]
    spread = F.when(F.count(F.lit(1)) == 1, 0.1).otherwise(F.stddev_pop("offset"))
    bins = met.groupBy(*keys).agg(F.percentile("offset", F.lit(0.5)).alias("middle"), spread.alias("spread"))
    scored = met.join(bins, keys).withColumn("consistency", consistency(F.col("offset"), F.col("middle"), F.col("spread")))
    return scored.select("case_id", "source_a", "source_b", "time_a", "time_b", "similarity", "consistency", F.lit("visual").alias("method"))


def identity_anchors(appearances: DataFrame, pairs: DataFrame) -> DataFrame:
    """The n-th appearance of a cluster in a with its n-th in b; what the longer list has beyond is left. Appearances have source_file_id, face_cluster_id and start_time."""
    order = Window.partitionBy("source_file_id", "face_cluster_id").orderBy("start_time")
    nth = appearances.filter("face_cluster_id is not null and start_time is not null").withColumn("n", F.row_number().over(order)).select("source_file_id", "face_cluster_id", "n", "start_time")
    a = nth.select(F.col("source_file_id").alias("source_a"), "face_cluster_id", "n", F.col("start_time").alias("time_a"))
    b = nth.select(F.col("source_file_id").alias("source_b"), "face_cluster_id", "n", F.col("start_time").alias("time_b"))
    zipped = pairs.join(a, "source_a").join(b, ["source_b", "face_cluster_id", "n"])
    return zipped.select("case_id", "source_a", "source_b", "face_cluster_id", "time_a", "time_b", F.lit(SURE).alias("similarity"), F.lit("identity").alias("method"))


def estimate_offsets(anchors: list[DataFrame], agree: float = AGREE) -> DataFrame:
    """(case_id, source_a, source_b, offset_seconds, confidence, method, anchor_count, residuals_sec) of each pair of sources with an anchor.

    The offset is the median, the confidence the share of anchors within ``agree`` of it (the bound is in).
    """
    keys = ["case_id", "source_a", "source_b"]
    rows = None
    for a in anchors:
        own = a.select(*keys, "method", (F.col("time_b") - F.col("time_a")).alias("d"))
        rows = own if rows is None else rows.unionByName(own)
    rows = Scratch(rows.sparkSession).cut(rows, "anchors")  # read three times
    counts = [F.count(F.when(F.col("method") == m, 1)).alias(m) for m in METHODS]
    middle = rows.groupBy(*keys).agg(F.percentile("d", F.lit(0.5)).alias("offset_seconds"), F.count(F.lit(1)).alias("anchor_count"), *counts)
    apart = rows.join(middle.select(*keys, "offset_seconds"), keys).withColumn("r", F.col("d") - F.col("offset_seconds"))
    # Only the first few of each pair are gathered.
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("method", "d"))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= RESIDUALS, F.struct("n", "r")))), lambda s: s["r"])
    said = apart.withColumn("n", order).groupBy(*keys).agg(F.avg((F.abs("r") <= agree).cast("double")).alias("confidence"), kept.alias("residuals_sec"))
    out = middle.join(said, keys).withColumn("method", method_label({m: F.col(m) for m in METHODS}))
    return out.select(*keys, "offset_seconds", "confidence", "method", "anchor_count", "residuals_sec")


def upsert_offsets(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["case_id", "source_a", "source_b"])


def complete_cases(pairs: DataFrame, offsets: DataFrame) -> DataFrame:
    """(case_id): the cases of which every pair of sources has an offset."""
    found = pairs.join(offsets.select("case_id", "source_a", "source_b", F.lit(True).alias("ok")), ["case_id", "source_a", "source_b"], "left")
    return found.groupBy("case_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all")).filter("all").select("case_id")


def case_times(nodes: DataFrame, pairs: DataFrame, offsets: DataFrame, sign: int = 1) -> DataFrame:
    """(node_id, case_time) of timed nodes (node_id, case_id, source_file_id, start_time): the reference's own time, the others' with their offset.

    Only cases of which every pair has an offset get times; a node that can't get one isn't in the result.
    """
    offsets = Scratch(offsets.sparkSession).cut(offsets, "offsets")
    whole = complete_cases(pairs, offsets)
    shift = offsets.select("case_id", F.col("source_b").alias("source_file_id"), (sign * F.col("offset_seconds")).alias("shift"))
    zero = pairs.select("case_id", F.col("source_a").alias("source_file_id")).distinct().withColumn("shift", F.lit(0.0))
    moves = shift.unionByName(zero).join(whole, "case_id", "left_semi")
    return nodes.filter("start_time is not null").join(moves, ["case_id", "source_file_id"]).select("node_id", (F.col("start_time") + F.col("shift")).alias("case_time"))


def sync_status(offsets: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, source_a_name, source_b_name, offset_seconds, confidence, method, anchor_count), with the sources' names."""
    name = lambda side: files.select(F.col("source_file_id").alias(f"source_{side}"), F.col("file_name").alias(f"source_{side}_name"))
    return offsets.join(name("a"), "source_a").join(name("b"), "source_b").select("case_id", "source_a_name", "source_b_name", "offset_seconds", "confidence", "method", "anchor_count")
