"""Faces and voices made into identities: presence by windows, overlap, matching, links to nodes.

Face rows have case_id, source_file_id, node_id, start_time, end_time, face_cluster_id; voice rows case_id,
source_file_id, start_time, end_time, voice_cluster_id. Rows without a cluster take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.graph import greedy_matching
from ledgerlens.operators.merge import keep_latest
from ledgerlens.operators.temporal import windows_covered

#: Width of a window in seconds, windows that a cluster must be present in, and share of windows that two must have in common (exceeded).
WINDOW, LEAST_WINDOWS, SHARE = 5.0, 3, 0.5
#: Nodes that a voice is linked to.
SPEAKING = ["scene_segment", "audio_track"]


def stable_id(kind: str, *parts: Column) -> Column:
    """An id that is the same on every run, from a row's natural key."""
    return F.sha2(F.concat_ws("\u0001", F.lit(kind), *parts), 256)


def presence(rows: DataFrame, cluster: str, window: float = WINDOW) -> DataFrame:
    """(source_file_id, <cluster>, window_no): the windows of each source in which a cluster is present, each once."""
    return windows_covered(rows.filter(F.col(cluster).isNotNull()), ["source_file_id", cluster], "start_time", "end_time", window)


def presence_intervals(rows: DataFrame, cluster: str) -> DataFrame:
    """(source_file_id, <cluster>, intervals): the times of each cluster in each source, in order."""
    there = rows.filter(F.col(cluster).isNotNull())
    return there.groupBy("source_file_id", cluster).agg(F.array_sort(F.collect_list(F.struct("start_time", "end_time"))).alias("intervals"))


def sources_with_both(faces: DataFrame, voices: DataFrame) -> DataFrame:
    """The sources that have a clustered face and a clustered voice."""
    own = lambda df, c: df.filter(F.col(c).isNotNull()).select("source_file_id").distinct()
    return own(faces, "face_cluster_id").join(own(voices, "voice_cluster_id"), "source_file_id", "left_semi")


def overlap_pairs(faces: DataFrame, voices: DataFrame, window: float = WINDOW, least: int = LEAST_WINDOWS) -> DataFrame:
    """(source_file_id, face_cluster_id, voice_cluster_id, shared, overlap): Jaccard shares of windows, of clusters with ``least`` windows each, none of pairs that share no window."""
    sides = []
    for rows, cluster in ((faces, "face_cluster_id"), (voices, "voice_cluster_id")):
        seen = presence(rows, cluster, window)
        size = seen.groupBy("source_file_id", cluster).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        sides.append((seen.join(size, ["source_file_id", cluster], "left_semi"), size.withColumnRenamed("n", f"n_{cluster}")))
    (f, nf), (v, nv) = sides
    shared = f.join(v, ["source_file_id", "window_no"]).groupBy("source_file_id", "face_cluster_id", "voice_cluster_id").agg(F.count(F.lit(1)).alias("shared"))
    both = shared.join(nf, ["source_file_id", "face_cluster_id"]).join(nv, ["source_file_id", "voice_cluster_id"])
    union = F.col("n_face_cluster_id") + F.col("n_voice_cluster_id") - F.col("shared")
    return both.select("source_file_id", "face_cluster_id", "voice_cluster_id", "shared", (F.col("shared") / union).alias("overlap"))


def match_identities(pairs: DataFrame, cases: DataFrame, share: float = SHARE) -> DataFrame:
    """One pair for each face and each voice of a case, by falling overlap above ``share``; equal ones go by the clusters' names. ``cases`` has source_file_id and case_id."""
    named = pairs.join(cases, "source_file_id")
    return greedy_matching(named, "case_id", "face_cluster_id", "voice_cluster_id", "overlap", share)


def spoken_snippets(segments: DataFrame, voices: DataFrame, limit: int = 3) -> DataFrame:
    """(voice_cluster_id, snippets): up to ``limit`` distinct texts of segments (source_file_id, start_time, end_time, text_content) that overlap a voice's turns, in order."""
    met = _overlapping(segments.filter(F.length("text_content") > 0).select("source_file_id", "start_time", "end_time", "text_content"), voices)
    first = met.groupBy("voice_cluster_id", "text_content").agg(F.min("start_time").alias("at"))
    w = Window.partitionBy("voice_cluster_id").orderBy("at", "text_content")
    some = first.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)
    return some.groupBy("voice_cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text_content"))), lambda s: s["text_content"]).alias("snippets"))


def _overlapping(nodes: DataFrame, voices: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Nodes with each voice cluster whose turns overlap them, [start, end) against [start, end), by slots of time."""
    slots = lambda df: df.filter(F.col("end_time") >= F.col("start_time")).withColumn("_slot", F.explode(F.sequence(F.floor(F.col("start_time") / bucket), F.floor(F.col("end_time") / bucket))))
    n = slots(nodes)
    v = slots(voices.filter("voice_cluster_id is not null").select("source_file_id", "start_time", "end_time", "voice_cluster_id")).select("source_file_id", "_slot", F.col("start_time").alias("_s"), F.col("end_time").alias("_e"), "voice_cluster_id")
    return n.join(v, ["source_file_id", "_slot"]).filter((F.col("start_time") < F.col("_e")) & (F.col("end_time") > F.col("_s"))).drop("_slot", "_s", "_e").distinct()


def nodes_of_voices(nodes: DataFrame, voices: DataFrame) -> DataFrame:
    """(voice_cluster_id, node_id): the segments and tracks that a voice's turns overlap."""
    timed = nodes.filter(F.col("node_type").isin(SPEAKING)).select("source_file_id", "node_id", "start_time", "end_time")
    return _overlapping(timed, voices).select("voice_cluster_id", "node_id").distinct()


def nodes_of_faces(faces: DataFrame) -> DataFrame:
    return faces.filter("face_cluster_id is not null").select("face_cluster_id", "node_id").distinct()


def build_identities(faces: DataFrame, voices: DataFrame, nodes: DataFrame, cases: DataFrame, names: DataFrame | None = None, window: float = WINDOW, least: int = LEAST_WINDOWS, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """Identities (case_id, identity_id, display_name, face_cluster_id, voice_cluster_id, source_file_id, overlap_ratio, shared_windows) and links (case_id, identity_id, node_id, via, confidence).

    ``names`` gives a voice cluster its name (voice_cluster_id, display_name); without one an identity stays unnamed. A node
    is linked to an identity once: by the face where both would link it.
    """
    matched = match_identities(overlap_pairs(faces, voices, window, least), cases, share)
    identities = matched.withColumn("identity_id", stable_id("identity", F.col("case_id"), F.col("face_cluster_id"), F.col("voice_cluster_id")))
    if names is None:
        identities = identities.withColumn("display_name", F.lit(None).cast("string"))
    else:
        identities = identities.join(names.select("voice_cluster_id", "display_name"), "voice_cluster_id", "left")
    identities = identities.select("case_id", "identity_id", "display_name", "face_cluster_id", "voice_cluster_id", "source_file_id", F.round("overlap", 4).alias("overlap_ratio"), F.col("shared").alias("shared_windows"))
    own = ["case_id", "identity_id", "node_id"]
    by_face = identities.join(nodes_of_faces(faces), "face_cluster_id").select(*own, F.lit("face").alias("via"), F.col("overlap_ratio").alias("confidence"))
    by_voice = identities.join(nodes_of_voices(nodes, voices), "voice_cluster_id").select(*own, F.lit("voice").alias("via"), F.col("overlap_ratio").alias("confidence"))
    return identities, keep_latest(by_face.unionByName(by_voice), own, [F.col("via")])  # face stands before voice


def assign_clusters(rows: DataFrame, labels: DataFrame, id_col: str, cluster: str) -> DataFrame:
    """The rows with their cluster; those without one get null, so a rerun clears what it doesn't find again."""
    return rows.drop(cluster).join(labels.select(id_col, cluster), id_col, "left")


def clear_identities(faces: DataFrame, voices: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faces and voices without identity_id, and links without those to identities."""
    off = lambda df: df.withColumn("identity_id", F.lit(None).cast("string"))
    return off(faces), off(voices), links.filter("relationship_type <> 'IDENTITY_LINK'")


def identity_evidence(links: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(identity_id, node_id, node_type, start_time, page_number, text_content, file_name, via), those without a time last."""
    got = links.join(nodes, "node_id").join(files.select("source_file_id", "file_name"), "source_file_id")
    return got.select("identity_id", "node_id", "node_type", "start_time", "page_number", "text_content", "file_name", "via")


def identities_of_nodes(links: DataFrame, identities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, identity_id, display_name, via), each once."""
    return links.join(nodes.select("node_id").distinct(), "node_id", "left_semi").join(identities.select("identity_id", "display_name"), "identity_id").select("node_id", "identity_id", "display_name", "via").distinct()


def identities_matching(identities: DataFrame, name: str) -> DataFrame:
    return identities.filter(F.lower("display_name").contains(name.lower()))


def identity_by_prefix(identities: DataFrame, prefix: str) -> DataFrame:
    """The identity whose id begins with ``prefix``; 32 characters and more are a whole id."""
    if len(prefix) >= 32:
        return identities.filter(F.col("identity_id") == prefix)
    return identities.filter(F.col("identity_id").startswith(prefix)).orderBy("identity_id").limit(1)


def kinds_of_link(links: DataFrame) -> DataFrame:
    """(identity_id, kinds, both): the ways in which an identity is linked, and whether by face and voice."""
    got = links.groupBy("identity_id").agg(F.array_sort(F.collect_set("via")).alias("kinds"))
    return got.withColumn("both", F.array_contains("kinds", "face") & F.array_contains("kinds", "voice"))
