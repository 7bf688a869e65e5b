"""The tables of a case: columns, keys, foreign keys, dimensions and words of the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.media import METADATA

#: Dimensions of the vectors.
DIMS = {"text_embedding": 384, "clip_embedding": 512, "audio_embedding": 768, "face": 512, "voice": 256}
NODE_TYPES = ["scene_segment", "frame", "audio_track", "page", "image"]
FILE_TYPES = ["video", "audio", "image", "pdf", "doc"]
ALIGNMENTS = ["ALIGNS_WITH", "SIMILAR_TO", "REFERENCES", "DESCRIBES"]
RELATIONSHIPS = ["CONTRADICTS", "CORROBORATES", "IDENTITY_LINK"]

TABLES = {
    "cases": "id string, case_number string, title string, description string, created_at timestamp",
    "files": "id string, case_id string, file_path string, relative_path string, file_name string, file_type string, sha256 string, size_bytes bigint, duration_sec double, page_count int, author string, declared_type string, detected_mime string, type_mismatch boolean, registered_at timestamp",
    "nodes": f"id string, source_file_id string, node_type string, start_time double, end_time double, page_number int, text_content string, file_path string, metadata {METADATA}, text_embedding array<float>, clip_embedding array<float>, audio_embedding array<float>, case_time double, claim string, claim_extracted_at timestamp, created_at timestamp, enriched_at timestamp, enrichment_error string",
    "offsets": "case_id string, source_a string, source_b string, offset_seconds double, confidence double, method string, anchor_count bigint, residuals_sec array<double>",
    "entities": "id string, case_id string, entity_type string, canonical_name string, normalized_name string, mention_count bigint, node_count bigint",
    "mentions": "entity_id string, node_id string, mention_text string, source string, confidence double",
    "faces": "face_id string, case_id string, source_file_id string, node_id string, start_time double, end_time double, frame_path string, confidence double, embedding array<float>, face_cluster_id string",
    "voices": "voice_id string, case_id string, source_file_id string, start_time double, end_time double, speaker_label string, embedding array<float>, voice_cluster_id string",
    "identities": "identity_id string, case_id string, display_name string, face_cluster_id string, voice_cluster_id string, source_file_id string, overlap_ratio double, shared_windows bigint",
    "identity_links": "case_id string, identity_id string, node_id string, via string, confidence double",
    "edges": "node_a string, node_b string, relationship_type string, confidence double, explanation string, origins array<string>, claim_a string, claim_b string",
    "alignments": "case_id string, a string, b string, kind string, score double",
    "events": "case_id string, event_id string, description string, start_time double, end_time double, members bigint",
    "event_links": "event_id string, node_id string",
    "runs": "case_id string, model_availability map<string,string>, settings map<string,string>, started_at timestamp",
}

#: (child, foreign key, parent, the parent's key): what goes with a case.
LINKS = [("files", "case_id", "cases", "id"), ("nodes", "source_file_id", "files", "id"), ("entities", "case_id", "cases", "id"), ("mentions", "entity_id", "entities", "id"), ("offsets", "case_id", "cases", "id"), ("faces", "case_id", "cases", "id"), ("voices", "case_id", "cases", "id"), ("identities", "case_id", "cases", "id"), ("identity_links", "case_id", "cases", "id"), ("alignments", "case_id", "cases", "id"), ("edges", "node_a", "nodes", "id"), ("events", "case_id", "cases", "id"), ("event_links", "event_id", "events", "event_id"), ("runs", "case_id", "cases", "id")]


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(name))


def bad_vectors(nodes: DataFrame) -> DataFrame:
    """(id, column, size): vectors of another dimension than the model's."""
    columns = ["text_embedding", "clip_embedding", "audio_embedding"]
    found = F.array(*[F.struct(F.lit(c).alias("column"), F.size(c).alias("size"), F.lit(DIMS[c]).alias("due")) for c in columns])
    rows = nodes.select("id", F.explode(found).alias("v")).filter("v.size >= 0 and v.size <> v.due")
    return rows.select("id", "v.column", "v.size")
