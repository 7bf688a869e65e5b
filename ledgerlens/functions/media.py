"""Expressions over a node's nested metadata: frames, detections, transcripts, text read from images.

Metadata is a struct; what a record lacks is null. Lists stay lists: nothing is exploded only to be gathered again.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import squeeze

# Classes of the detector that stand for entities, and those that a summary points out.
DETECTED_KINDS = {
    "person": "person", "knife": "weapon", "scissors": "weapon", "baseball bat": "weapon", "gun": "weapon", "pistol": "weapon", "rifle": "weapon", "cell phone": "phone", "car": "vehicle", "truck": "vehicle", "bus": "vehicle", "motorcycle": "vehicle", "bicycle": "vehicle",
}
NOTABLE = ["knife", "scissors", "baseball bat", "gun", "pistol", "rifle"]

#: The struct that the engine writes; every expression below takes any struct with the fields that it names.
METADATA = """struct<segment_index:int,segmentation:string,duration_sec:double,width:int,height:int,codec:string,normalised:boolean,mode:string,format:string,render_zoom:double,text_chars:int,text_truncated:boolean,audio_path:string,frames:array<struct<timestamp:double,path:string>>,representative_frame:string,caption:string,
 violence:struct<score:double,frames_scored:int>,detections:struct<labels:map<string,struct<count:bigint,max_confidence:double>>,total:int,notable:array<string>>,ocr:struct<text:string,line_count:int,mean_confidence:double>,
 transcript:struct<text:string,language:string,segments:array<struct<start:double,end:double,text:string>>>,audio_events:array<struct<label:string,probability:double>>,enrichment_skipped:map<string,string>>""".replace("\n ", "")


def frame_time(frames: Column, path: Column) -> Column:
    """The timestamp of the first frame with that path."""
    return F.get(F.filter(frames, lambda f: f["path"] == path), 0)["timestamp"]


def middle(items: Column) -> Column:
    """The element at half the length; null of an empty list."""
    return F.get(items, F.floor(F.size(items) / 2).cast("int"))


def subsample(items: Column, limit: int) -> Column:
    """At most ``limit`` elements, evenly spaced from the first."""
    n = F.size(items)
    return F.when(n <= limit, items).otherwise(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.get(items, F.floor(i * n / limit).cast("int"))))


def audio_path(metadata: Column, node_type: Column, file_path: Column) -> Column:
    return F.coalesce(metadata["audio_path"], F.when(node_type == "audio_track", file_path))


def thumbnail(metadata: Column, node_type: Column, file_path: Column) -> Column:
    """An image's or page's own file; of a segment the representative frame, else its first frame with a path."""
    framed = F.get(F.filter(metadata["frames"], lambda f: f["path"].isNotNull()), 0)["path"]
    return F.when(node_type.isin("image", "page"), file_path).when(node_type == "scene_segment", F.coalesce(metadata["representative_frame"], framed))


def detection_labels(metadata: Column) -> Column:
    """The detected labels in order; an empty list where nothing was detected."""
    return F.coalesce(F.array_sort(F.map_keys(metadata["detections"]["labels"])), F.array().cast("array<string>"))


def summarise_detections(boxes: Column) -> Column:
    """(labels, total, notable) of boxes (label, confidence): count and best confidence of each label."""
    named = F.array_sort(F.array_distinct(F.transform(boxes, lambda b: b["label"])))
    of = lambda label: F.filter(boxes, lambda b: b["label"] == label)
    entry = lambda label: F.struct(F.size(of(label)).cast("long").alias("count"), F.array_max(F.transform(of(label), lambda b: b["confidence"])).alias("max_confidence"))
    labels = F.map_from_arrays(named, F.transform(named, entry))
    return F.struct(labels.alias("labels"), F.size(boxes).alias("total"), F.array_intersect(named, F.array(*map(F.lit, NOTABLE))).alias("notable"))


def detected_entities(metadata: Column) -> Column:
    """(name, kind, confidence) for each detected label that stands for an entity; others are left out."""
    kinds = F.create_map(*map(F.lit, chain.from_iterable(DETECTED_KINDS.items())))
    found = F.transform(F.map_entries(metadata["detections"]["labels"]), lambda e: F.struct(e["key"].alias("name"), F.try_element_at(kinds, e["key"]).alias("kind"), e["value"]["max_confidence"].alias("confidence")))
    return F.array_sort(F.filter(found, lambda e: e["kind"].isNotNull()))


def read_lines(lines: Column) -> Column:
    """(text, line_count, mean_confidence) of recognised lines (text, confidence): the mean over those that have one."""
    sure = F.filter(F.transform(lines, lambda x: x["confidence"]), lambda c: c.isNotNull())
    mean = F.when(F.size(sure) > 0, F.round(F.aggregate(sure, F.lit(0.0), lambda s, c: s + c) / F.size(sure), 4))
    return F.struct(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"), F.size(lines).alias("line_count"), mean.alias("mean_confidence"))


def spoken(segments: Column) -> Column:
    """The text of a transcript: its segments, trimmed, those without text left out, with blanks between."""
    return F.array_join(F.filter(F.transform(segments, lambda s: F.trim(s["text"])), lambda t: t != ""), " ")


def spoken_between(segments: Column, start: Column, end: Column) -> Column:
    """The segments that overlap [start, end)."""
    return F.filter(segments, lambda s: (s["start"] < end) & (s["end"] > start))


def violence(logits: Column, violent: int) -> Column:
    """The share of the first ``violent`` prompts: a softmax for each frame's logits, averaged over the frames; null without frames."""
    def soft(row: Column) -> Column:
        top = F.array_max(row)
        powers = F.transform(row, lambda x: F.exp(x - top))
        total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
        return F.aggregate(F.slice(powers, 1, violent), F.lit(0.0), lambda s, x: s + x) / total

    return F.when(F.size(logits) > 0, F.aggregate(F.transform(logits, soft), F.lit(0.0), lambda s, x: s + x) / F.size(logits))


def page_zoom(width: Column, height: Column, zoom: float, max_pixels: int) -> Column:
    """The zoom at which a page is rendered within the budget of pixels, never under a tenth."""
    base = F.greatest(width * height, F.lit(1.0))
    return F.when(base * zoom * zoom <= max_pixels, F.lit(float(zoom))).otherwise(F.greatest(F.sqrt(F.lit(float(max_pixels)) / base), F.lit(0.1)))


def node_card(row: dict[str, Column]) -> list[Column]:
    """A node as a list shows it, without its metadata."""
    m = row["metadata"]
    return [
        *[row[c].alias(c) for c in ("id", "node_type", "start_time", "end_time", "page_number", "text_content", "created_at")],
        row["enriched_at"].isNotNull().alias("enriched"), row["clip_embedding"].isNotNull().alias("has_visual_vector"), row["text_embedding"].isNotNull().alias("has_text_vector"),
        thumbnail(m, row["node_type"], row["file_path"]).isNotNull().alias("has_thumbnail"), m["caption"].alias("caption"), detection_labels(m).alias("detections"),
    ]


def node_detail(row: dict[str, Column]) -> list[Column]:
    """A node in full: its card and what its metadata holds."""
    m = row["metadata"]
    own = [m["duration_sec"].alias("duration_sec"), m["violence"]["score"].alias("violence"), F.greatest(F.size(m["frames"]), F.lit(0)).alias("frame_count")]
    return [*node_card(row), *own, *[m[c].alias(c) for c in ("transcript", "ocr", "audio_events")]]


def shortened(text: Column, limit: int) -> Column:
    s = squeeze(text)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…")))


def findings(metadata: Column) -> Column:
    """What the models concluded about a node, a line each, in a fixed order."""
    m = metadata
    said = lambda lead, text, limit: F.when(F.trim(text) != "", F.concat(F.lit(f"{lead}: “"), shortened(text, limit), F.lit("”")))
    labels = detection_labels(m)
    heard = F.filter(F.slice(m["audio_events"], 1, 3), lambda e: (e["label"] != "") & e["probability"].isNotNull())
    events = F.transform(heard, lambda e: F.format_string("%s (%.2f)", e["label"], e["probability"]))
    return F.array_compact(F.array(
        said("Described", m["caption"], 110),
        said("Read on screen", m["ocr"]["text"], 90),
        F.when(F.size(labels) > 0, F.concat(F.lit("Objects detected: "), F.array_join(F.slice(labels, 1, 6), ", "))),
        said("Transcribed", m["transcript"]["text"], 110),
        F.when(F.size(events) > 0, F.concat(F.lit("Audio events: "), F.array_join(events, ", "))),
    ))


def skipped_features(reasons: dict[str, Column]) -> Column:
    """The features that have a reason why they are missing, with it."""
    pairs = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(k).alias("k"), c.alias("v"))) for k, c in reasons.items()]))
    return F.map_from_entries(pairs)


def populated(features: dict[str, Column]) -> Column:
    """The names of the features that aren't null."""
    return F.array_compact(F.array(*[F.when(c.isNotNull(), F.lit(k)) for k, c in features.items()]))
