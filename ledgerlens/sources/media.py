"""Media types of files: by content, by declaration, by name; and the scan of a case folder."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.processors import sniffed_mime

#: Bytes that are read at a time, and that tell a file's type.
PIECE, HEAD = 1 << 20, 64

# Extensions and MIME types of each media type.
EXTENSIONS = {"video": "mp4 mov avi mkv webm m4v", "audio": "wav mp3 m4a flac aac ogg", "image": "jpg jpeg png bmp tiff tif webp heic", "pdf": "pdf", "doc": "doc docx rtf odt txt"}
MIME = {
    "application/pdf": "pdf", "application/msword": "doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "doc", "application/rtf": "doc", "text/rtf": "doc", "application/vnd.oasis.opendocument.text": "doc", "application/octet-stream": "video",
}
MIME_FAMILIES = {"video": "video", "audio": "audio", "image": "image", "text": "doc"}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(pairs.items()))), key)


def media_type_of_mime(mime: Column) -> Column:
    """Null for a MIME type that no rule knows."""
    return F.coalesce(_lookup(MIME, mime), _lookup(MIME_FAMILIES, F.split_part(mime, F.lit("/"), F.lit(1))))


def media_type_of_name(name: Column) -> Column:
    by_extension = {e: kind for kind, all_ in EXTENSIONS.items() for e in all_.split()}
    return _lookup(by_extension, F.lower(F.regexp_extract(name, r"[.]([A-Za-z0-9]+)$", 1)))


def scan_case_folder(spark: SparkSession, folder: str, max_bytes: int = 2 << 30, declared: DataFrame | None = None) -> DataFrame:
    """(file_path, relative_path, file_name, media_type, size_bytes, sha256, declared_type, detected_mime, type_mismatch, status, detail), in the order of the paths.

    Hidden files and those in hidden or linked folders are left out, and so are files of no known type. A file above the size limit, one
    that leads out of the folder and one that can't be read are ``skipped`` with the reason, unread. Paths and sizes come
    from the listing; executors read the first bytes for the type and hash the rest in pieces. ``declared`` has
    relative_path, declared_type (config.declared_files()); what the content says goes before it, and it before the name.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size_bytes"))
    path = F.regexp_replace("path", "^file:(//)?(?=/)", "")
    base = os.path.abspath(folder) if "://" not in folder else folder.rstrip("/")
    rows = listed.select(path.alias("file_path"), "size_bytes").withColumn("relative_path", F.expr(f"substring(file_path, {len(base) + 2})"))
    rows = rows.filter(~F.concat(F.lit("/"), "relative_path").rlike(r"/[.]")).withColumn("file_name", F.element_at(F.split("relative_path", "/"), -1))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [_inspect(p, base, n, max_bytes) for p, n in zip(b["file_path"], b["size_bytes"])]
            got = pd.DataFrame(out, columns=["linked", "head", "sha256", "detail"])
            yield pd.concat([b.reset_index(drop=True), got], axis=1)

    schema = "file_path string, size_bytes long, relative_path string, file_name string, linked boolean, head binary, sha256 string, detail string"
    seen = rows.repartition(F.col("file_path")).mapInPandas(read, schema).filter("not linked").withColumn("detected_mime", sniffed_mime(F.col("head")))
    seen = seen.withColumn("declared_type", F.lit(None).cast("string")) if declared is None else seen.join(F.broadcast(declared.select("relative_path", "declared_type")), "relative_path", "left")
    sniffed, named = media_type_of_mime(F.col("detected_mime")), media_type_of_name(F.col("file_name"))
    claimed = F.coalesce("declared_type", named)
    typed = seen.withColumn("media_type", F.coalesce(sniffed, claimed)).withColumn("type_mismatch", F.coalesce(sniffed != claimed, F.lit(False)))
    status = F.when(F.col("detail").isNotNull(), "skipped").otherwise("registered")
    kept = typed.filter("media_type is not null or detail is not null").withColumn("status", status)
    return kept.select("file_path", "relative_path", "file_name", "media_type", "size_bytes", "sha256", "declared_type", "detected_mime", "type_mismatch", "status", "detail").orderBy("file_path")


def _inspect(path: str, base: str, size: int, max_bytes: int) -> tuple[bool, bytes | None, str | None, str | None]:
    """Whether a file lies behind a linked folder, its first bytes, its hash, and why it is skipped."""
    try:
        if "://" in path:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            opened = lambda: system.open_input_stream(inner)
        else:
            parent = os.path.dirname(path)
            if os.path.realpath(parent) != os.path.join(os.path.realpath(base), os.path.relpath(parent, base)).removesuffix("/."):
                return True, None, None, None
            if not os.path.realpath(path).startswith(os.path.realpath(base) + os.sep):
                return False, None, None, "path leaves the case folder"
            if not os.path.isfile(path):
                return False, None, None, "not a regular file"
            opened = lambda: open(path, "rb")
        if size > max_bytes:
            return False, None, None, f"{size} bytes, over the limit of {max_bytes}"
        digest, head = hashlib.sha256(), None
        with opened() as f:
            while piece := f.read(PIECE):
                head = piece[:HEAD] if head is None else head
                digest.update(piece)
        return False, head or b"", digest.hexdigest(), None
    except OSError as e:
        return False, None, None, f"cannot read: {e}"[:500]
