"""Faces of pictures and turns of voices: models run over frames and tracks, one picture or track at a time.

A detector gives (bbox, confidence, vector) of each face of a path; a diarizer (start, end, speaker, vector) of each turn. What isn't
there any more is skipped; a picture that fails costs its own faces only. Ids depend on what was found where, so a
second run over the same evidence gives the same rows and replaces the first's.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.media import audio_path
from ledgerlens.functions.vector import centroids
from ledgerlens.operators.identity import stable_id
from ledgerlens.sources.models import VOICE_DIMS, LazyModel

#: Confidence under which a face is left out.
LEAST, FACE_DIMS = 0.5, 512


def frames_of(nodes: DataFrame) -> DataFrame:
    """(case_id, source_file_id, node_id, start_time, end_time, frame_path): every frame of a segment, and the pictures themselves."""
    own = ["case_id", "source_file_id", "node_id", "start_time", "end_time"]
    framed = nodes.filter("node_type = 'scene_segment'").select(*own, F.explode("metadata.frames").alias("f")).select(*own, F.col("f.path").alias("frame_path"))
    pictures = nodes.filter("node_type = 'image'").select(*own, F.col("file_path").alias("frame_path"))
    return framed.unionByName(pictures).filter("frame_path is not null").distinct()


def _spread(rows: DataFrame, schema: str, columns: list[str], path: str, model: LazyModel, read) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model.load()
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                if own is None or not os.path.exists(row[path]):
                    continue
                try:
                    found = own(row[path])
                except Exception:  # one picture or track must not stop the others
                    continue
                out += read(row, found)
            yield pd.DataFrame(out, columns=columns)

    return rows.repartition(path).mapInPandas(run, schema)


def detect_faces(nodes: DataFrame, detector: LazyModel, pending: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """(face_id, case_id, source_file_id, node_id, start_time, end_time, frame_path, confidence, embedding) of all faces that are sure enough; of ``pending`` nodes (node_id) only, where given."""
    rows = frames_of(nodes if pending is None else nodes.join(pending, "node_id", "left_semi"))
    keep = rows.columns

    def read(row: dict, found: list) -> list[tuple]:
        return [(*[row[c] for c in keep], ",".join(f"{x:.2f}" for x in box), float(c), [float(x) for x in v]) for box, c, v in found if c >= least and len(v) == FACE_DIMS]

    schema = "case_id string, source_file_id string, node_id string, start_time double, end_time double, frame_path string, bbox string, confidence double, embedding array<float>"
    got = _spread(rows, schema, [*keep, "bbox", "confidence", "embedding"], "frame_path", detector, read)
    return got.withColumn("face_id", stable_id("face", F.col("node_id"), F.col("frame_path"), F.col("bbox"))).dropDuplicates(["face_id"])


def nodes_without_faces(nodes: DataFrame, faces: DataFrame) -> DataFrame:
    return nodes.filter(F.col("node_type").isin("scene_segment", "image")).select("node_id").join(faces.select("node_id"), "node_id", "left_anti")


def tracks_of(nodes: DataFrame) -> DataFrame:
    """(case_id, source_file_id, track): the sound of each source once, that of its earliest node."""
    sound = nodes.select("case_id", "source_file_id", "node_id", "start_time", audio_path(F.col("metadata"), F.col("node_type"), F.col("file_path")).alias("track")).filter("track is not null")
    order = F.struct(F.coalesce("start_time", F.lit(float("inf"))).alias("o"), "node_id")
    return sound.groupBy("case_id", "source_file_id").agg(F.min_by("track", order).alias("track"))


def diarize(nodes: DataFrame, diarizer: LazyModel) -> DataFrame:
    """(voice_id, case_id, source_file_id, start_time, end_time, speaker_label, embedding) of the turns in each source's sound."""

    def read(row: dict, found: list) -> list[tuple]:
        return [(row["case_id"], row["source_file_id"], float(a), float(b), str(who), [float(x) for x in v]) for a, b, who, v in found if b > a and len(v) == VOICE_DIMS]

    schema = "case_id string, source_file_id string, start_time double, end_time double, speaker_label string, embedding array<float>"
    got = _spread(tracks_of(nodes), schema, ["case_id", "source_file_id", "start_time", "end_time", "speaker_label", "embedding"], "track", diarizer, read)
    return got.withColumn("voice_id", stable_id("voice", F.col("source_file_id"), F.col("start_time").cast("string"), F.col("end_time").cast("string"), F.col("speaker_label"))).dropDuplicates(["voice_id"])


def cluster_table(rows: DataFrame, cluster: str) -> DataFrame:
    """(case_id, <cluster>, representative_embedding, members): each cluster's mean vector, of length one, and its size. Rows without a cluster take no part."""
    own = rows.filter(F.col(cluster).isNotNull())
    mean = centroids(own, cluster, "embedding").withColumnRenamed("centroid", "representative_embedding")
    return own.groupBy("case_id", cluster).agg(F.count(F.lit(1)).alias("members")).join(mean, cluster).select("case_id", cluster, "representative_embedding", "members")
