"""The graph of a case, built in fifteen steps that stand alone: a step that fails or can't run leaves a status.

Tables: nodes (case_id, node_id, source_file_id, node_type, start_time, end_time, page_number, text_content, metadata, text_embedding,
clip_embedding, audio_embedding, claim, claim_extracted_at), files (case_id, source_file_id, file_name, registered_at), and
where models have run faces (case_id, source_file_id, node_id, face_id, start_time, end_time, embedding) and voices (case_id,
source_file_id, voice_id, start_time, end_time, embedding). All cases are built in one run: every step is keyed by case.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.answers import display_name
from ledgerlens.functions.answers import entities as read_entities
from ledgerlens.functions.media import detected_entities
from ledgerlens.functions.text import normalize_name
from ledgerlens.operators import claims as C
from ledgerlens.operators import identity as I
from ledgerlens.operators import sync as S
from ledgerlens.operators.events import timeline_events
from ledgerlens.operators.graph import average_linkage, density_clusters
from ledgerlens.operators.temporal import overlap_join
from ledgerlens.operators.vectors import cross_above, pairs_above
from ledgerlens.plans.detect import detect_faces, diarize, nodes_without_faces
from ledgerlens.plans.pipeline import Pipeline, Status
from ledgerlens.plans.reports import audio_coverage
from ledgerlens.runtime import Scratch
from ledgerlens.sources.models import LazyModel

Frames = dict[str, DataFrame]


@dataclass
class Settings:
    """Thresholds of the steps, and which of them run."""

    similar: float = 0.8
    referenced: float = 0.7
    described: float = 0.3
    least_overlap: float = 0.0
    face_eps: float = 0.4
    voice_cut: float = 0.4
    pairs: int = C.PAIRS
    off: frozenset[str] = frozenset()


@dataclass
class Agents:
    """Models behind the steps, each a function of texts; a missing one leaves its steps skipped, with that reason."""

    entities: Callable[[str], str] | None = None
    claims: Callable[[str], str] | None = None
    judge: Callable[[str, str], str] | None = None
    names: Callable[[str], str] | None = None
    faces: LazyModel | None = None
    voices: LazyModel | None = None
    prompts: Callable[[str], list[float] | None] | None = None


def mentioned(nodes: DataFrame, extract: Callable[[str], str] | None, longest: int = 4_000) -> DataFrame:
    """(case_id, node_id, name, kind, source): what the texts name and what detectors saw."""
    parts = []
    if extract is not None:
        ask = F.pandas_udf(lambda texts: texts.map(extract), "string")
        said = nodes.filter("text_content <> ''").select("case_id", "node_id", F.explode(read_entities(ask(F.substring("text_content", 1, longest)))).alias("e"))
        parts.append(said.select("case_id", "node_id", "e.name", "e.kind", F.lit("llm_extraction").alias("source")))
    seen = nodes.select("case_id", "node_id", F.explode(detected_entities(F.col("metadata"))).alias("e"))
    parts.append(seen.select("case_id", "node_id", "e.name", "e.kind", F.lit("object_detection").alias("source")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def entity_tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (case_id, id, entity_type, canonical_name, normalized_name, mention_count, node_count) and mentions (entity_id, node_id, mention_text, source).

    The first spelling wins, by node; mention_count counts every finding, node_count the nodes.
    """
    named = found.withColumn("normalized_name", normalize_name(F.col("name"))).filter("normalized_name <> ''")
    keyed = named.withColumn("entity_id", I.stable_id("entity", F.col("case_id"), F.col("kind"), F.col("normalized_name")))
    entities = keyed.groupBy("case_id", F.col("entity_id").alias("id"), F.col("kind").alias("entity_type"), "normalized_name").agg(
        F.min_by("name", F.struct("node_id", "source", "name")).alias("canonical_name"), F.count(F.lit(1)).alias("mention_count"), F.countDistinct("node_id").alias("node_count")
    )
    mentions = keyed.groupBy("entity_id", "node_id").agg(F.min_by(F.struct("name", "source"), F.struct("source", "name")).alias("m"))
    return entities, mentions.select("entity_id", "node_id", F.col("m.name").alias("mention_text"), F.col("m.source").alias("source"))


def temporal_alignment(nodes: DataFrame, least: float) -> DataFrame:
    """(case_id, a, b, kind, score): nodes of one source and of unlike types that overlap by ``least`` seconds; touching ones do at 0."""
    timed = nodes.filter("start_time is not null and end_time is not null").select("case_id", "node_id", "source_file_id", "node_type", "start_time", "end_time")
    met = overlap_join(timed, timed, "source_file_id", "start_time", "end_time", touching=True).filter("node_id < b_node_id and node_type <> b_node_type")
    return met.filter(F.col("overlap_sec") >= least).select("case_id", F.col("node_id").alias("a"), F.col("b_node_id").alias("b"), F.lit("ALIGNS_WITH").alias("kind"), F.col("overlap_sec").alias("score"))


def like_edges(nodes: DataFrame, vector: str, least: float, kind: str) -> DataFrame:
    return pairs_above(nodes, "case_id", "node_id", vector, least).select("case_id", "a", "b", F.lit(kind).alias("kind"), "score")


def references(nodes: DataFrame, least: float) -> DataFrame:
    """Pages and the segments of the same case that look like them, from page to segment."""
    side = lambda kind: nodes.filter(F.col("node_type") == kind)
    return cross_above(side("page"), side("scene_segment"), "case_id", "node_id", "clip_embedding", least).select("case_id", "a", "b", F.lit("REFERENCES").alias("kind"), "score")


def describes(nodes: DataFrame, encode: Callable[[str], list[float] | None], least: float) -> DataFrame:
    """Transcripts and the pictures that their words describe: the text goes through the pictures' encoder."""

    @F.pandas_udf("array<float>")
    def prompt(texts: pd.Series) -> pd.Series:
        return texts.map(encode)

    spoken = nodes.filter("metadata.transcript.text <> ''").select("case_id", "node_id", prompt(F.col("metadata.transcript.text")).alias("clip_embedding"))
    shown = nodes.filter(F.col("node_type").isin("scene_segment", "image")).select("case_id", "node_id", "clip_embedding")
    met = cross_above(spoken, shown, "case_id", "node_id", "clip_embedding", least).filter("a <> b")
    return met.select("case_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit("DESCRIBES").alias("kind"), "score").groupBy("case_id", "a", "b", "kind").agg(F.max("score").alias("score"))


def named_voices(nodes: DataFrame, voices: DataFrame, extract: Callable[[str], str]) -> DataFrame:
    """(voice_cluster_id, display_name): the name that the first snippet of a voice yields, of those that yield one."""
    snippets = I.spoken_snippets(nodes.filter("text_content <> ''"), voices).select("voice_cluster_id", F.posexplode("snippets").alias("n", "text"))
    ask = F.pandas_udf(lambda texts: texts.map(extract), "string")
    said = snippets.withColumn("display_name", display_name(ask("text"))).filter("display_name is not null")
    return said.groupBy("voice_cluster_id").agg(F.min_by("display_name", "n").alias("display_name"))


def needing(what: object, reason: str) -> None:
    if what is None:
        raise LookupError(reason)


def graph_pipeline(settings: Settings | None = None, agents: Agents | None = None) -> Pipeline:
    """The fifteen steps in their order, over the frames of the tables; later steps read what earlier ones gave."""
    s, a = settings or Settings(), agents or Agents()

    def entities(f: Frames) -> Frames:
        found = mentioned(f["nodes"], a.entities)
        made, named = entity_tables(found)
        return {"entities": made, "mentions": named}

    def claim_extraction(f: Frames) -> Frames:
        needing(a.claims, "skipped: no model extracts claims")
        got = C.extract_claims(f["nodes"], lambda texts: texts.map(a.claims))
        return {"claims": f["nodes"].select("case_id", "node_id", "text_embedding").join(got, "node_id")}

    def contradictions(f: Frames) -> Frames:
        needing(a.judge, "skipped: no model judges claims")
        linked = f["alignments"].filter(F.col("kind").isin("REFERENCES", "ALIGNS_WITH", "DESCRIBES"))
        pairs = C.candidate_pairs(f["mentions"], linked, f["event_links"])
        kept = C.prefilter(pairs, f["claims"])
        return {"claim_edges": C.judge_pairs(kept, lambda x, y: pd.Series([a.judge(p, q) for p, q in zip(x, y)]), s.pairs)}

    def fusion(f: Frames) -> Frames:
        names = named_voices(f["nodes"], f["clustered_voices"], a.names) if a.names else None
        cases = f["files"].select("source_file_id", "case_id")
        made, links = I.build_identities(f["clustered_faces"], f["clustered_voices"], f["nodes"], cases, names)
        return {"identities": made, "identity_links": links}

    def sync(f: Frames) -> Frames:
        pairs = S.source_pairs(f["files"])
        rows = f["nodes"].filter("start_time is not null").withColumnRenamed("node_id", "row_id")
        anchors = [S.audio_anchors(rows, pairs), S.visual_anchors(rows, pairs)]
        if "clustered_faces" in f:
            anchors.append(S.identity_anchors(f["clustered_faces"], pairs))
        offsets = S.estimate_offsets(anchors)
        return {"offsets": offsets, "case_times": S.case_times(f["nodes"], pairs, offsets)}

    def linking(f: Frames) -> Frames:
        needing(a.prompts, "skipped: no encoder of texts for pictures")
        return {"described": describes(f["nodes"], a.prompts, s.described)}

    def events(f: Frames) -> Frames:
        made, links = timeline_events(f["nodes"], f["mentions"])
        return {"events": made, "event_links": links}

    def all_alignments(f: Frames) -> Frames:
        out = f["temporal"]
        for name in ("similar", "referenced", "described"):
            if name in f:
                out = out.unionByName(f[name])
        return {"alignments": out}

    def faces_found(f: Frames) -> Frames:
        """New faces of nodes that have none yet, beside those there are."""
        old = f.get("faces")
        needing(a.faces or old, "skipped: no model detects faces")
        if a.faces is None:
            return {}
        new = detect_faces(f["nodes"], a.faces, None if old is None else nodes_without_faces(f["nodes"], old))
        return {"faces": new if old is None else old.unionByName(new, allowMissingColumns=True)}

    def voices_found(f: Frames) -> Frames:
        """The turns of all voices, found anew: those there were give way."""
        needing(a.voices or f.get("voices"), "skipped: no model tells voices apart")
        return {"voices": diarize(f["nodes"], a.voices)} if a.voices else {}

    faces = lambda f: {"clustered_faces": I.assign_clusters(f["faces"], density_clusters(f["faces"], "case_id", "face_id", "embedding", s.face_eps).withColumnRenamed("cluster", "face_cluster_id"), "face_id", "face_cluster_id")}
    voices = lambda f: {"clustered_voices": I.assign_clusters(f["voices"], average_linkage(f["voices"], "case_id", "voice_id", "embedding", s.voice_cut).withColumnRenamed("cluster", "voice_cluster_id"), "voice_id", "voice_cluster_id")}
    steps: list[tuple[str, list[str], Callable[[Frames], Frames]]] = [
        ("entities", ["nodes"], entities),
        ("temporal_alignment", ["nodes"], lambda f: {"temporal": temporal_alignment(f["nodes"], s.least_overlap)}),
        ("similarity", ["nodes"], lambda f: {"similar": like_edges(f["nodes"], "clip_embedding", s.similar, "SIMILAR_TO")}),
        ("face_detection", ["nodes"], faces_found),
        ("face_clustering", ["faces"], faces),
        ("document_video_linking", ["nodes"], lambda f: {"referenced": references(f["nodes"], s.referenced)}),
        ("transcript_visual_linking", ["nodes"], linking),
        ("audio_alignment_prep", ["nodes"], lambda f: {"audio_coverage": audio_coverage(f["nodes"]), **all_alignments(f)}),
        ("timeline_events", ["nodes", "mentions"], events),
        ("claim_extraction", ["nodes"], claim_extraction),
        ("contradiction_detection", ["claims", "mentions", "alignments", "event_links"], contradictions),
        ("voice_diarization", ["nodes"], voices_found),
        ("voice_clustering", ["voices"], voices),
        ("identity_fusion", ["clustered_faces", "clustered_voices"], fusion),
        ("timeline_sync", ["nodes", "files"], sync),
    ]
    out = Pipeline()
    for name, needs, run in steps:
        out.step(name, needs, run, enabled=name not in s.off)
    return out


def build_graph(frames: Frames, settings: Settings | None = None, agents: Agents | None = None) -> tuple[Frames, list[Status]]:
    """All frames that the steps gave, each written to the shared folder, and a status for each step."""
    scratch = Scratch(next(iter(frames.values())).sparkSession)
    return graph_pipeline(settings, agents).run(frames, scratch.cut)
