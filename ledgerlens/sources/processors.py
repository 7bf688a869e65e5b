"""Files made into drafts of nodes: a registry of processors by media type, each file on its own.

A processor takes a file (a dict with file_path, file_name, sha256) and gives drafts (dicts of DRAFT's fields). What opens
videos and documents is injected, or found where its library is installed; images and WAV files are read from their own
headers. A file that can't be read is a row with an error, not an exception.
"""

from __future__ import annotations

import math
import struct
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.media import METADATA

DRAFT = f"struct<node_type:string,start_time:double,end_time:double,page_number:int,text_content:string,file_path:string,metadata:{METADATA}>"
#: Limits of a file, and what they bound.
MAX_PIXELS, MAX_PAGES, MAX_PAGE_CHARS, MAX_SECONDS, MAX_FRAMES = 50_000_000, 2_000, 1_000_000, 7_200.0, 3_600
WINDOW, INTERVAL, ZOOM = 30.0, 2.0, 2.0

Draft = dict[str, object]


class MediaError(Exception):
    """A file that can't be processed, and why."""


def windows(duration: float, width: float = WINDOW) -> list[tuple[float, float]]:
    """Windows of one width, the last short; a single full one where the duration isn't known."""
    count = math.ceil(duration / width) if duration and duration > 0 else 0
    return [(k * width, min((k + 1) * width, duration)) for k in range(count)] or [(0.0, width)]


def segments_of(duration: float, boundaries: list[tuple[float, float]] | None, width: float = WINDOW) -> tuple[list[tuple[float, float]], str]:
    """The scenes that a detector found, else fixed windows; and which of the two."""
    return (list(boundaries), "content") if boundaries else (windows(duration, width), "fixed")


def stream_duration(stream: float | None, container: float | None) -> float:
    """A stream's own duration, else its container's, else 0."""
    return next((float(d) for d in (stream, container) if d and d > 0), 0.0)


def image_size(head: bytes) -> tuple[int, int, str]:
    """Width, height and format from the first bytes of an image."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return (*struct.unpack(">II", head[16:24]), "PNG")
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h), "BMP"
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        if head[12:16] == b"VP8X":
            return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little"), "WEBP"
        if head[12:16] == b"VP8L":
            bits = int.from_bytes(head[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "WEBP"
        w, h = struct.unpack("<HH", head[26:30])
        return w & 0x3FFF, h & 0x3FFF, "WEBP"
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head):
            if head[at] != 0xFF:
                at += 1
                continue
            kind = head[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h, "JPEG"
            at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD9 or kind == 1 else 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    raise MediaError("cannot read image: unknown format")


@dataclass
class ImageProcessor:
    max_pixels: int = MAX_PIXELS

    def __call__(self, file: dict) -> list[Draft]:
        with open(file["file_path"], "rb") as f:
            width, height, kind = image_size(f.read(1 << 18))
        if width * height > self.max_pixels:
            raise MediaError(f"{file['file_name']} has {width * height} pixels, over the limit of {self.max_pixels}")
        return [{"node_type": "image", "file_path": file["file_path"], "metadata": {"width": width, "height": height, "format": kind}}]


def wav_duration(path: str) -> float:
    with wave.open(path, "rb") as w:
        return w.getnframes() / float(w.getframerate() or 1)


@dataclass
class AudioProcessor:
    """One track from 0 to its end. ``normalise`` gives the path of a mono 16 kHz WAV file of a file; a WAV file may stand for itself."""

    normalise: Callable[[dict], str] | None = None

    def __call__(self, file: dict) -> list[Draft]:
        path = self.normalise(file) if self.normalise else file["file_path"]
        try:
            seconds = wav_duration(path)
        except (wave.Error, EOFError) as e:
            raise MediaError(f"cannot read {file['file_name']}: {e}") from e
        return [{"node_type": "audio_track", "start_time": 0.0, "end_time": seconds, "file_path": path, "metadata": {"duration_sec": seconds, "normalised": self.normalise is not None, "audio_path": path}}]


@dataclass
class VideoProcessor:
    """A segment for each scene or window, with its frames. ``probe`` gives (stream duration, container duration, width, height, codec) of a path."""

    probe: Callable[[str], tuple[float | None, float | None, int, int, str]] | None = None
    detect: Callable[[str], list[tuple[float, float]] | None] | None = None
    sample: Callable[[str, list[tuple[int, float]]], list[tuple[int, float, str]]] | None = None
    extract_audio: Callable[[dict], str | None] | None = None
    window: float = WINDOW
    interval: float = INTERVAL

    def __call__(self, file: dict) -> list[Draft]:
        if self.probe is None:
            raise MediaError("no library opens videos here")
        path = file["file_path"]
        stream, container, width, height, codec = self.probe(path)
        duration = stream_duration(stream, container)
        if duration > MAX_SECONDS:
            raise MediaError(f"{file['file_name']} lasts {duration:.0f} s, over the limit of {MAX_SECONDS:.0f}")
        segments, kind = segments_of(duration, self.detect(path) if self.detect else None, self.window)
        targets = [(i, t) for i, (a, b) in enumerate(segments) for t in _targets(a, b, self.interval)][:MAX_FRAMES]
        frames: dict[int, list[dict]] = {}
        for i, at, where in self.sample(path, targets) if self.sample else ():
            frames.setdefault(i, []).append({"timestamp": at, "path": where})
        audio = self.extract_audio(file) if self.extract_audio else None
        said = {"segmentation": kind, "width": width, "height": height, "codec": codec, "audio_path": audio}
        return [{"node_type": "scene_segment", "start_time": a, "end_time": b, "file_path": path, "metadata": {**said, "segment_index": i, "duration_sec": b - a, "frames": frames.get(i, [])}} for i, (a, b) in enumerate(segments)]


def _targets(start: float, end: float, interval: float) -> list[float]:
    return [start + k * interval for k in range(math.ceil((end - start) / interval))]


@dataclass
class PdfProcessor:
    """A page for each page, its text cut at a limit. ``open_pages`` gives (text, width, height) of each page; it raises for what it can't open."""

    open_pages: Callable[[str], list[tuple[str, float, float]]] | None = None
    render: Callable[[dict, int, float], str | None] | None = None
    max_pages: int = MAX_PAGES
    max_chars: int = MAX_PAGE_CHARS

    def __call__(self, file: dict) -> list[Draft]:
        if self.open_pages is None:
            raise MediaError("no library opens documents here")
        pages = self.open_pages(file["file_path"])
        if len(pages) > self.max_pages:
            raise MediaError(f"{file['file_name']} has {len(pages)} pages, over the limit of {self.max_pages}")
        out = []
        for n, (text, width, height) in enumerate(pages, 1):
            cut, base = (text or "")[: self.max_chars], max(width * height, 1.0)
            zoom = ZOOM if base * ZOOM**2 <= MAX_PIXELS else max((MAX_PIXELS / base) ** 0.5, 0.1)
            image = self.render(file, n, zoom) if self.render else None
            said = {"render_zoom": round(zoom, 3), "width": int(width * zoom), "height": int(height * zoom), "text_chars": len(cut), "text_truncated": len(text or "") > len(cut)}
            out.append({"node_type": "page", "page_number": n, "text_content": cut, "file_path": image, "metadata": said})
        return out


@dataclass
class Registry:
    """Processors, or analyzers, by key; one is added without touching what uses them."""

    items: dict[str, Callable] = field(default_factory=dict)

    def register(self, key: str, item: Callable) -> Registry:
        self.items[key] = item
        return self

    def get(self, key: str) -> Callable | None:
        return self.items.get(key)

    def supports(self, key: str) -> bool:
        return key in self.items


def default_registry() -> Registry:
    """Processors of images and WAV files; videos and documents need a library, and ``doc`` files have none."""
    return Registry().register("image", ImageProcessor()).register("audio", AudioProcessor()).register("video", VideoProcessor()).register("pdf", PdfProcessor())


def extract(files: DataFrame, registry: Registry, tasks: int | None = None) -> DataFrame:
    """(source_file_id, status, detail, draft_no, draft) of files (source_file_id, file_path, file_name, media_type, sha256).

    A file has a row for each draft with the status ``ok``; one row without a draft where it has none (``ok``), where its type
    has no processor (``skipped``) or where it failed (``failed``, with the reason). Files are spread over tasks one by one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file in b.to_dict("records"):
                own, key = registry.get(file["media_type"]), file["source_file_id"]
                if own is None:
                    rows.append((key, "skipped", f"no processor for {file['media_type']}", None, None))
                    continue
                try:
                    drafts = own(file)
                except Exception as e:  # one file must not stop the others
                    rows.append((key, "failed", str(e)[:2000], None, None))
                    continue
                rows += [(key, "ok", None, n, d) for n, d in enumerate(drafts)] or [(key, "ok", None, None, None)]
            yield pd.DataFrame(rows, columns=["source_file_id", "status", "detail", "draft_no", "draft"]).astype({"draft_no": "Int32"})

    spread = files.repartition(*([tasks] if tasks else []), "source_file_id")
    return spread.mapInPandas(run, f"source_file_id string, status string, detail string, draft_no int, draft {DRAFT}")


def node_rows(extracted: DataFrame) -> DataFrame:
    """The nodes (id, source_file_id, ...) of extract()'s drafts; ids depend on the source and the draft's place alone."""
    got = extracted.filter("draft is not null")
    return got.select(F.sha2(F.concat_ws("\u0001", F.lit("node"), "source_file_id", "draft_no"), 256).alias("id"), "source_file_id", "draft.*")


def sampling_targets(segments: DataFrame, key: str, interval: float = INTERVAL, most: int = MAX_FRAMES) -> DataFrame:
    """(<key>, segment_no, target): times from each segment's start, one every ``interval`` seconds before its end, at most ``most`` of a key in their order. Segments have start_time and end_time."""
    count = F.ceil((F.col("end_time") - F.col("start_time")) / interval)
    # How many targets lie before a segment tells which of its own are within the bound: none is made beyond it.
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("segment_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = segments.withColumn("_n", F.greatest(count, F.lit(0)).cast("long")).withColumn("_left", F.least(F.col("_n"), F.lit(most) - before))
    made = rows.filter("_left > 0").select(key, "segment_no", "start_time", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_left") - 1)).alias("_k"))
    return made.select(key, "segment_no", (F.col("start_time") + F.col("_k") * F.lit(float(interval))).alias("target"))


def sniffed_mime(head: Column) -> Column:
    """The MIME type that the first bytes of a file tell; null where they tell none."""
    is_ = lambda at, *hexes: F.hex(F.substring(head, at + 1, len(hexes[0]) // 2)).isin(*hexes)
    riff = is_(0, "52494646")
    return (
        F.when(is_(0, "25504446"), "application/pdf").when(is_(0, "89504E47"), "image/png").when(is_(0, "FFD8FF"), "image/jpeg").when(is_(0, "424D"), "image/bmp").when(is_(0, "49492A00", "4D4D002A"), "image/tiff")
        .when(riff & is_(8, "57454250"), "image/webp").when(riff & is_(8, "57415645"), "audio/wav").when(riff & is_(8, "41564920"), "video/avi").when(is_(0, "1A45DFA3"), "video/matroska")
        .when(is_(4, "66747970") & is_(8, "4D344120"), "audio/mp4").when(is_(4, "66747970") & is_(8, "68656963", "68656978"), "image/heic").when(is_(4, "66747970"), "video/mp4")
        .when(is_(0, "494433") | is_(0, "FFFB", "FFF3", "FFF2"), "audio/mpeg").when(is_(0, "664C6143"), "audio/flac").when(is_(0, "4F676753"), "audio/ogg").when(is_(0, "FFF1", "FFF9"), "audio/aac")
        .when(is_(0, "D0CF11E0"), "application/msword").when(is_(0, "7B5C727466"), "application/rtf")
    )
