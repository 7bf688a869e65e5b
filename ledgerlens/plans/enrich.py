"""Nodes enriched by models: each node on its own, results merged back into the table."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.labels import SECTIONS
from ledgerlens.functions.media import METADATA
from ledgerlens.sources.models import AUDIO_DIMS, IMAGE_DIMS, TEXT_DIMS, Models
from ledgerlens.sources.processors import Registry

#: Characters of an error that are kept, characters of a page's own text from which its image isn't read, frames that are looked at.
ERROR, ENOUGH, FRAMES = 2_000, 40, 8
RESULT = f"node_id string, text_content string, text_embedding array<float>, clip_embedding array<float>, audio_embedding array<float>, metadata {METADATA}, error string"
NODE = ["node_id", "node_type", "start_time", "end_time", "page_number", "text_content", "file_path", "metadata"]


@dataclass
class Result:
    """What was found about a node; features without a value have a reason."""

    sections: dict[str, str | None] = field(default_factory=dict)
    vectors: dict[str, list[float] | None] = field(default_factory=dict)
    metadata: dict[str, object] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)

    def ask(self, models: Models, feature: str, *args: object) -> object | None:
        """A model's answer; where it is missing, fails or says nothing, the reason is kept."""
        own, reason = models.get(feature)
        if own is None:
            self.skipped[feature] = reason or "unavailable"
            return None
        try:
            got = own(*args)
        except Exception as e:
            self.skipped[feature] = str(e)[:ERROR]
            return None
        if got is None:
            self.skipped.setdefault(feature, "nothing found")
        return got

    def text(self) -> str | None:
        said = [f"{name}: {self.sections[name].strip()}" for name in SECTIONS if (self.sections.get(name) or "").strip()]
        return "\n\n".join(said) or None


Analyzer = Callable[[dict, Models], Result]


def _look(r: Result, models: Models, image: str | None) -> None:
    """Vector, objects, caption and words of one picture."""
    if not image:
        r.skipped["image"] = "no picture"
        return
    r.vectors["clip_embedding"] = r.ask(models, "image_encoder", image)
    if (found := r.ask(models, "detector", [image])) is not None:
        r.metadata["detections"] = summarise(found)
    if caption := r.ask(models, "captioner", image):
        r.metadata["caption"] = caption
        r.sections["Visual description"] = caption
    if (lines := r.ask(models, "ocr", image)) is not None:
        sure = [c for _, c in lines if c is not None]
        r.metadata["ocr"] = {"text": "\n".join(t for t, _ in lines), "line_count": len(lines), "mean_confidence": round(sum(sure) / len(sure), 4) if sure else None}
        r.sections["On-screen text"] = r.metadata["ocr"]["text"]


def summarise(boxes: list[tuple[str, float]]) -> dict:
    """Count and best confidence of each label."""
    best = {label: max(float(c) for other, c in boxes if other == label) for label in {b[0] for b in boxes}}
    counts = Counter(label for label, _ in boxes)
    return {"labels": {k: {"count": n, "max_confidence": best[k]} for k, n in sorted(counts.items())}, "total": len(boxes)}


def _listen(r: Result, models: Models, path: str | None, node: dict) -> None:
    """Speech and sounds of a node's time."""
    if not path:
        r.skipped["audio"] = "no sound"
        return
    start, end = node["start_time"], node["end_time"]
    segments = r.ask(models, "asr", path)
    if segments is not None:
        own = [s for s in segments if (end is None or s["start"] < end) and (start is None or s["end"] > start)]
        spoken = " ".join(t for s in own if (t := s["text"].strip()))
        r.metadata["transcript"] = {"text": spoken, "language": own[0].get("language") if own else None, "segments": [{k: s[k] for k in ("start", "end", "text")} for s in own]}
        r.sections["Transcript"] = spoken
    if (heard := r.ask(models, "audio_tagger", path, start, end)) is not None:
        events, vector = heard
        r.metadata["audio_events"] = [{"label": a, "probability": float(p)} for a, p in events]
        r.vectors["audio_embedding"] = vector


def analyze_segment(node: dict, models: Models) -> Result:
    r, m = Result(), node["metadata"] or {}
    frames = [f["path"] for f in m.get("frames") or [] if f.get("path")]
    shown = frames[len(frames) // 2] if frames else None
    if shown:
        r.metadata["representative_frame"] = shown
        some = frames if len(frames) <= FRAMES else [frames[int(i * len(frames) / FRAMES)] for i in range(FRAMES)]
        if (score := r.ask(models, "violence", some)) is not None:
            r.metadata["violence"] = {"score": float(score), "frames_scored": len(some)}
    _look(r, models, shown)
    _listen(r, models, m.get("audio_path"), node)
    return r


def analyze_track(node: dict, models: Models) -> Result:
    r = Result()
    _listen(r, models, (node["metadata"] or {}).get("audio_path") or node["file_path"], node)
    return r


def analyze_image(node: dict, models: Models) -> Result:
    r = Result()
    _look(r, models, node["file_path"])
    return r


def analyze_page(node: dict, models: Models) -> Result:
    """A page with text of its own isn't read again from its picture."""
    r, own = Result(), (node["text_content"] or "").strip()
    r.sections["Document text"] = own
    if len(own) < ENOUGH:
        lines = r.ask(models, "ocr", node["file_path"]) if node["file_path"] else None
        if lines:
            sure = [c for _, c in lines if c is not None]
            r.metadata["ocr"] = {"text": "\n".join(t for t, _ in lines), "line_count": len(lines), "mean_confidence": round(sum(sure) / len(sure), 4) if sure else None}
            r.sections["On-screen text"] = r.metadata["ocr"]["text"]
    else:
        r.skipped["ocr"] = "page has text"
    r.vectors["clip_embedding"] = r.ask(models, "image_encoder", node["file_path"]) if node["file_path"] else None
    return r


def default_analyzers() -> Registry:
    return Registry().register("scene_segment", analyze_segment).register("audio_track", analyze_track).register("image", analyze_image).register("page", analyze_page)


def to_enrich(nodes: DataFrame, only_pending: bool = True, kinds: list[str] | None = None) -> DataFrame:
    """The nodes (with id as node_id) that are to be enriched; the order of a listing is reports.enrich_order()."""
    if only_pending:
        nodes = nodes.filter("enriched_at is null")
    if kinds is not None:
        nodes = nodes.filter(F.col("node_type").isin(kinds))
    return nodes.withColumnRenamed("id", "node_id").select("source_file_id", *NODE)


def enrich(pending: DataFrame, models: Models, analyzers: Registry | None = None) -> DataFrame:
    """RESULT's columns of each pending node: what its analyzer found, or the error that it met. No node stops another.

    Nodes of one source meet in one task, so that a model that keeps what it read of a file reads it once.
    """
    own = analyzers or default_analyzers()

    def one(node: dict) -> tuple:
        analyze = own.get(node["node_type"])
        if analyze is None:
            return (node["node_id"], None, None, None, None, None, f"no analyzer for {node['node_type']}")
        try:
            r = analyze(node, models)
            text = r.text()
            if text:
                r.vectors["text_embedding"] = r.ask(models, "text_encoder", text)
            checked = {}
            for name, dims in (("text_embedding", TEXT_DIMS), ("clip_embedding", IMAGE_DIMS), ("audio_embedding", AUDIO_DIMS)):
                v = r.vectors.get(name)
                if v is not None and len(v) != dims:
                    r.skipped[name] = f"{len(v)} dimensions instead of {dims}"
                    v = None
                checked[name] = v
            if r.skipped:
                r.metadata["enrichment_skipped"] = r.skipped
            return (node["node_id"], text, *checked.values(), r.metadata or None, None)
        except Exception as e:  # one node must not stop the others
            return (node["node_id"], None, None, None, None, None, str(e)[:ERROR] or type(e).__name__)

    columns = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            nodes = b.astype(object).where(b.notna(), None).to_dict("records")
            for node in nodes:
                node["metadata"] = json.loads(node["metadata"]) if node["metadata"] else None
            yield pd.DataFrame([one(n) for n in nodes], columns=columns)

    plain = pending.select(*[F.to_json("metadata").alias("metadata") if c == "metadata" else F.col(c) for c in ["source_file_id", *NODE]])
    return plain.repartition("source_file_id").mapInPandas(run, RESULT)


def merged_metadata(old: Column, new: Column, schema: StructType) -> Column:
    """Field by field: the new value where there is one, else the old."""
    return F.struct(*[F.coalesce(new[f.name], old[f.name]).alias(f.name) for f in schema.fields])


def write_back(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """The nodes with their results: text kept where there is no new one, vectors as they came (null too), metadata merged, the error cleared.

    A node that failed keeps all its values, gets the error (cut) and counts as enriched, so that it isn't tried again unasked.
    """
    vectors = ["text_embedding", "clip_embedding", "audio_embedding"]
    r = results.select(F.col("node_id").alias("id"), F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in ("text_content", *vectors, "metadata", "error")])
    both = nodes.join(r, "id", "left")
    done, failed = F.col("_there") & F.col("_error").isNull(), F.col("_there") & F.col("_error").isNotNull()
    new = {c: F.when(done, F.col(f"_{c}")).otherwise(F.col(c)) for c in vectors}
    new["text_content"] = F.when(done, F.coalesce("_text_content", "text_content")).otherwise(F.col("text_content"))
    new["metadata"] = F.when(done, merged_metadata(F.col("metadata"), F.col("_metadata"), nodes.schema["metadata"].dataType)).otherwise(F.col("metadata"))
    new["enriched_at"] = F.when(F.col("_there"), F.current_timestamp()).otherwise(F.col("enriched_at"))
    new["enrichment_error"] = F.when(failed, F.substring("_error", 1, ERROR)).when(done, F.lit(None)).otherwise(F.col("enrichment_error"))
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in nodes.columns])


def run_record(nodes: DataFrame, case_id: str, models: Models, settings: dict[str, str]) -> DataFrame:
    """One row for the table of runs: which models were there, and the settings."""
    row = [(case_id, models.availability(), {k: str(v) for k, v in settings.items()})]
    return nodes.sparkSession.createDataFrame(row, "case_id string, model_availability map<string,string>, settings map<string,string>").withColumn("started_at", F.current_timestamp())
