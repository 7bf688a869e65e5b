"""Queries over cases: identities, clocks, events, claims, packs, the graph, listings. Each SQL says the same.

The tables hold no detections of faces or turns of voices: mentions found by detectors stand for the former, those
found in texts for the latter, with the entity as the cluster. Alignments stand for edges of claims: SIMILAR_TO for
CORROBORATES and DESCRIBES for CONTRADICTS. Thresholds are those at which these tables give rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import labels as L
from ledgerlens.functions import media as M
from ledgerlens.functions.text import normalize_name
from ledgerlens.operators import claims as C
from ledgerlens.operators import identity as I
from ledgerlens.operators import merge as W
from ledgerlens.operators import sync as S
from ledgerlens.operators.events import event_edges, timeline_events
from ledgerlens.operators.graph import average_linkage, density_clusters
from ledgerlens.operators.vectors import checked, cross_above, pairs_above
from ledgerlens.plans import overview as O
from ledgerlens.plans import pack as P
from ledgerlens.plans import reports as R
from ledgerlens.plans import search as Q
from ledgerlens.plans.enrich import write_back
from ledgerlens.plans.ingest import split_unchanged
from ledgerlens.queries import A_SQL, F_SQL, M_SQL, alignments, files, mentions, query
from ledgerlens.runtime import Scratch
from ledgerlens.sources.models import word_judge
from ledgerlens.sources.processors import sampling_targets
from ledgerlens.sources.tables import table

# --- views of the tables ---------------------------------------------------------------------------------------------


def case_files(spark: SparkSession, folder: str) -> DataFrame:
    return files(spark, folder).withColumnRenamed("id", "source_file_id")


def case_nodes(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    """Nodes with their case, each id once: (case_id, node_id, source_file_id, ...); repeats of an id carry the same content."""
    rows = table(spark, folder, "evidence_node").select("id", "source_file_id", *cols)
    once = rows.groupBy("id").agg(*[F.any_value(c, True).alias(c) for c in ["source_file_id", *cols]])
    return once.join(case_files(spark, folder).select("source_file_id", "case_id"), "source_file_id").withColumnRenamed("id", "node_id")


CN = "cn AS (SELECT v.*, f.case_id, f.file_name FROM (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM evidence_node) WHERE rn = 1) v JOIN f ON f.id = v.source_file_id)"
ENT = "en AS (SELECT id, min(case_id) AS case_id, min(entity_type) AS entity_type, min(canonical_name) AS canonical_name, lower(trim(regexp_replace(min(canonical_name), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS normalized_name, min(mention_count) AS mention_count FROM entity GROUP BY id)"


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities, each id once, their names normalised by the engine."""
    once = table(spark, folder, "entity").groupBy("id").agg(*[F.min(c).alias(c) for c in ("case_id", "entity_type", "canonical_name", "mention_count")])
    return once.withColumn("normalized_name", normalize_name(F.col("canonical_name")))


def _seen(spark: SparkSession, folder: str, source: str, cluster: str) -> DataFrame:
    found = table(spark, folder, "mention").filter(F.col("source") == source).select(F.col("entity_id").alias(cluster), F.col("evidence_node_id").alias("node_id")).dropna().distinct()
    timed = case_nodes(spark, folder, "start_time", "end_time").filter("end_time >= start_time")
    return found.join(timed, "node_id").select("case_id", "source_file_id", "node_id", "start_time", "end_time", cluster)


def faces(spark: SparkSession, folder: str) -> DataFrame:
    return _seen(spark, folder, "object_detection", "face_cluster_id")


def voices(spark: SparkSession, folder: str) -> DataFrame:
    return _seen(spark, folder, "llm_extraction", "voice_cluster_id")


def seen_sql(name: str, source: str, cluster: str) -> str:
    return f"{name} AS (SELECT DISTINCT cn.case_id, cn.source_file_id, cn.id AS node_id, cn.start_time, cn.end_time, m.entity_id AS {cluster} FROM mention m JOIN cn ON cn.id = m.evidence_node_id WHERE m.source = '{source}' AND m.entity_id IS NOT NULL AND cn.end_time >= cn.start_time)"


FACES, VOICES = seen_sql("faces", "object_detection", "face_cluster_id"), seen_sql("voices", "llm_extraction", "voice_cluster_id")


def claim_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(node_a, node_b, relationship_type, confidence, explanation): one edge for each pair and type, of the best score."""
    kind = F.upper(F.trim("alignment_type"))
    rows = table(spark, folder, "source_alignment").filter("node_a_id <> node_b_id").withColumn("relationship_type", F.when(kind == "SIMILAR_TO", "CORROBORATES").when(kind == "DESCRIBES", "CONTRADICTS")).filter("relationship_type is not null")
    best = rows.groupBy(F.least("node_a_id", "node_b_id").alias("node_a"), F.greatest("node_a_id", "node_b_id").alias("node_b"), "relationship_type").agg(F.max("score").alias("confidence"))
    return best.withColumn("explanation", F.concat(F.lit("as "), F.lower("relationship_type")))


CE = "ce AS (SELECT least(node_a_id, node_b_id) AS node_a, greatest(node_a_id, node_b_id) AS node_b, CASE upper(trim(alignment_type)) WHEN 'SIMILAR_TO' THEN 'CORROBORATES' WHEN 'DESCRIBES' THEN 'CONTRADICTS' END AS relationship_type, max(score) AS confidence, 'as ' || lower(CASE upper(trim(alignment_type)) WHEN 'SIMILAR_TO' THEN 'CORROBORATES' WHEN 'DESCRIBES' THEN 'CONTRADICTS' END) AS explanation FROM source_alignment WHERE node_a_id <> node_b_id AND upper(trim(alignment_type)) IN ('SIMILAR_TO', 'DESCRIBES') GROUP BY ALL)"

DIMS, WIDTH = 384, 512


def cos(a: str, b: str) -> str:
    """A cosine in SQL, 0 where a vector is all zeros."""
    c = f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
    return f"(CASE WHEN isnan({c}) THEN 0 ELSE {c} END)"


def tenth(x: str) -> str:
    """A number with one decimal, halves away from zero."""
    return f"round(({x})::DECIMAL(18, 6), 1)::DECIMAL(18, 1)"


# --- events ----------------------------------------------------------------------------------------------------------

EV = f"""ee AS (SELECT DISTINCT x.id AS a, y.id AS b FROM cn x JOIN cn y ON x.case_id = y.case_id AND x.id < y.id AND abs(x.start_time - y.start_time) <= 30
      WHERE EXISTS (SELECT 1 FROM m p JOIN m q ON p.entity_id = q.entity_id WHERE p.node_id = x.id AND q.node_id = y.id) OR (len(x.text_embedding) = {DIMS} AND len(y.text_embedding) = {DIMS} AND {cos('x.text_embedding', 'y.text_embedding')} > 0.75)),
    el AS (SELECT a, b FROM ee UNION SELECT b, a FROM ee), er AS (SELECT DISTINCT a AS node_id, a AS other FROM el UNION SELECT er.node_id, el.b FROM er JOIN el ON el.a = er.other), ev AS (SELECT node_id, min(other) AS event_id FROM er GROUP BY node_id)"""


def event_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = case_nodes(spark, folder, "start_time", "end_time", "text_embedding")
    return rows.withColumn("text_embedding", F.when(F.size("text_embedding") == DIMS, F.col("text_embedding"))), mentions(spark, folder)


@query("event_pairs", f"WITH RECURSIVE {F_SQL}, {CN}, {M_SQL}, {EV} SELECT a AS node_a, b AS node_b FROM ee")
def event_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return event_edges(*event_inputs(spark, folder)).select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))


@query(
    "timeline_events",
    f"""WITH RECURSIVE {F_SQL}, {CN}, {M_SQL}, {EV} SELECT cn.case_id, event_id, count(*) || ' evidence node(s) between ' || {tenth('min(cn.start_time)')} || 's and ' || {tenth('max(cn.end_time)')} || 's' AS description, min(cn.start_time) AS start_time, max(cn.end_time) AS end_time, count(*) AS members
    FROM ev JOIN cn ON cn.id = ev.node_id GROUP BY cn.case_id, event_id""",
)
def timeline_events_query(spark: SparkSession, folder: str) -> DataFrame:
    return timeline_events(*event_inputs(spark, folder))[0]


@query("event_groups", f"WITH RECURSIVE {F_SQL}, {CN}, {M_SQL}, {EV} SELECT event_id, string_agg(node_id, ',' ORDER BY node_id) AS node_ids FROM ev GROUP BY event_id HAVING count(*) >= 2")
def event_groups(spark: SparkSession, folder: str) -> DataFrame:
    links = timeline_events(*event_inputs(spark, folder))[1]
    return R.entity_groups(links, "event_id").select("event_id", F.array_join("node_ids", ",").alias("node_ids"))


# --- claims ----------------------------------------------------------------------------------------------------------

#: A claim stands in the first hundred characters of a text.
CLAIMS = "cl AS (SELECT case_id, id AS node_id, trim(substring(text_content, 1, 100)) AS claim, CASE WHEN len(text_embedding) = 384 THEN text_embedding END AS text_embedding FROM cn WHERE trim(substring(text_content, 1, 100)) <> '')"
PAIRS = """cp AS (SELECT a AS node_a, b AS node_b, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM (
      SELECT x.node_id AS a, y.node_id AS b, 'entity' AS origin FROM c25 x JOIN c25 y ON x.entity_id = y.entity_id AND x.node_id < y.node_id UNION ALL SELECT a, b, kind FROM e WHERE kind IN ('REFERENCES', 'ALIGNS_WITH', 'DESCRIBES')
      UNION ALL SELECT x.node_id, y.node_id, 'SAME_EVENT' FROM ev x JOIN ev y ON x.event_id = y.event_id AND x.node_id < y.node_id) GROUP BY a, b)"""
C25 = "c25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY node_id) AS rn FROM m) WHERE rn <= 25)"
FILTERED = f"""pf AS (SELECT cp.*, a.claim AS claim_a, b.claim AS claim_b, CASE WHEN a.claim IS NULL OR b.claim IS NULL THEN 'no_claim' WHEN a.text_embedding IS NOT NULL AND b.text_embedding IS NOT NULL AND {cos('a.text_embedding', 'b.text_embedding')} < 0.3 THEN 'below_similarity' END AS reason
      FROM cp LEFT JOIN cl a ON a.node_id = cp.node_a LEFT JOIN cl b ON b.node_id = cp.node_b)"""


def claims(spark: SparkSession, folder: str) -> DataFrame:
    rows = case_nodes(spark, folder, "text_content", "text_embedding")
    got = C.extract_claims(rows.withColumn("claim_extracted_at", F.lit(None).cast("timestamp")).select("node_id", "text_content", "claim_extracted_at"), lambda texts: texts.str.slice(0, 100))
    return rows.select("case_id", "node_id", F.when(F.size("text_embedding") == DIMS, F.col("text_embedding")).alias("text_embedding")).join(got, "node_id")


def origin_pairs(spark: SparkSession, folder: str) -> DataFrame:
    links = timeline_events(*event_inputs(spark, folder))[1]
    linked = alignments(spark, folder).filter(F.col("kind").isin("REFERENCES", "ALIGNS_WITH", "DESCRIBES"))
    return C.candidate_pairs(mentions(spark, folder), linked, links)


@query("claim_pairs", f"WITH RECURSIVE {F_SQL}, {CN}, {M_SQL}, {A_SQL}, {EV}, {C25}, {PAIRS} SELECT * FROM cp")
def claim_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return origin_pairs(spark, folder).withColumn("origins", F.array_join("origins", ","))


def spare_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Claims without a model's call: the first hundred characters, by the engine's own functions."""
    rows = case_nodes(spark, folder, "text_content", "text_embedding").withColumn("claim", F.trim(F.substring("text_content", 1, 100))).filter("claim <> ''")
    return rows.select("case_id", "node_id", "claim", F.when(F.size("text_embedding") == DIMS, F.col("text_embedding")).alias("text_embedding"))


@query("pair_prefilter", f"WITH RECURSIVE {F_SQL}, {CN}, {M_SQL}, {A_SQL}, {EV}, {C25}, {PAIRS}, {CLAIMS}, {FILTERED} SELECT node_a, node_b, origins, reason FROM pf")
def pair_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    return C.prefilter(origin_pairs(spark, folder), spare_claims(spark, folder)).select("node_a", "node_b", F.array_join("origins", ",").alias("origins"), "reason")


@query("pair_tally", f"WITH RECURSIVE {F_SQL}, {CN}, {M_SQL}, {A_SQL}, {EV}, {C25}, {PAIRS}, {CLAIMS}, {FILTERED} SELECT count(*) AS proposed, count(*) FILTER (reason IS NULL) AS to_judge, count(*) FILTER (reason = 'no_claim') AS no_claim, count(*) FILTER (reason = 'below_similarity') AS below_similarity FROM pf")
def pair_tally(spark: SparkSession, folder: str) -> DataFrame:
    return C.tally(C.prefilter(origin_pairs(spark, folder), spare_claims(spark, folder)))


@query("claim_verdicts")
def claim_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Judged by rule, as many as there are; the cap of a model's calls is for models."""
    judge = word_judge()
    kept = C.prefilter(origin_pairs(spark, folder), claims(spark, folder))
    return C.judge_pairs(kept, lambda a, b: pd.Series([judge(x, y) for x, y in zip(a, b)]), most=1 << 30).withColumn("origins", F.array_join("origins", ","))


# --- identities ------------------------------------------------------------------------------------------------------

IDN = f"""fw AS (SELECT DISTINCT source_file_id, face_cluster_id, unnest(range(CAST(floor(start_time / 30) AS BIGINT), CAST(floor((end_time - 1e-9) / 30) AS BIGINT) + 1)) AS w FROM faces WHERE end_time > start_time),
    vw AS (SELECT DISTINCT source_file_id, voice_cluster_id, unnest(range(CAST(floor(start_time / 30) AS BIGINT), CAST(floor((end_time - 1e-9) / 30) AS BIGINT) + 1)) AS w FROM voices WHERE end_time > start_time),
    fn AS (SELECT source_file_id, face_cluster_id, count(*) AS n FROM fw GROUP BY 1, 2), vn AS (SELECT source_file_id, voice_cluster_id, count(*) AS n FROM vw GROUP BY 1, 2),
    ov AS (SELECT s.source_file_id, s.face_cluster_id, s.voice_cluster_id, s.shared, s.shared / (fn.n + vn.n - s.shared)::DOUBLE AS overlap FROM (SELECT source_file_id, face_cluster_id, voice_cluster_id, count(*) AS shared FROM fw JOIN vw USING (source_file_id, w) GROUP BY 1, 2, 3) s JOIN fn USING (source_file_id, face_cluster_id) JOIN vn USING (source_file_id, voice_cluster_id))"""


@query("identity_overlap", f"WITH {F_SQL}, {CN}, {FACES}, {VOICES}, {IDN} SELECT source_file_id, face_cluster_id, voice_cluster_id, shared, round(overlap, 6) AS overlap FROM ov")
def identity_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return I.overlap_pairs(faces(spark, folder), voices(spark, folder), 30.0, 1).withColumn("overlap", F.round("overlap", 6))


@query("sources_with_faces_and_voices", f"WITH {F_SQL}, {CN}, {FACES}, {VOICES} SELECT DISTINCT source_file_id FROM faces WHERE source_file_id IN (SELECT source_file_id FROM voices)")
def sources_with_faces_and_voices(spark: SparkSession, folder: str) -> DataFrame:
    return I.sources_with_both(faces(spark, folder), voices(spark, folder))


@query("voice_overlap_nodes", f"WITH {F_SQL}, {CN}, {VOICES} SELECT DISTINCT v.voice_cluster_id, n.id AS node_id FROM cn n JOIN voices v ON v.source_file_id = n.source_file_id AND n.start_time < v.end_time AND n.end_time > v.start_time WHERE n.node_type IN ('scene_segment', 'audio_track') AND n.end_time >= n.start_time")
def voice_overlap_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return I.nodes_of_voices(case_nodes(spark, folder, "node_type", "start_time", "end_time"), voices(spark, folder))


@query(
    "presence_maps",
    f"WITH {F_SQL}, {CN}, {FACES} SELECT source_file_id, face_cluster_id, string_agg(printf('%.3f-%.3f', start_time, end_time), ' ' ORDER BY start_time, end_time) AS intervals FROM (SELECT source_file_id, face_cluster_id, start_time, end_time FROM faces) GROUP BY 1, 2",
)
def presence_maps(spark: SparkSession, folder: str) -> DataFrame:
    got = I.presence_intervals(faces(spark, folder), "face_cluster_id")
    return got.withColumn("intervals", F.array_join(F.transform("intervals", lambda i: F.format_string("%.3f-%.3f", i["start_time"], i["end_time"])), " "))


def identity_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    cases = case_files(spark, folder).select("source_file_id", "case_id")
    nodes = case_nodes(spark, folder, "node_type", "start_time", "end_time")
    return I.build_identities(faces(spark, folder), voices(spark, folder), nodes, cases, window=30.0, least=1, share=0.1)


@query("identities")
def identities(spark: SparkSession, folder: str) -> DataFrame:
    return identity_tables(spark, folder)[0]


@query("identity_links")
def identity_links(spark: SparkSession, folder: str) -> DataFrame:
    return identity_tables(spark, folder)[1]


@query("identity_kinds")
def identity_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return I.kinds_of_link(identity_tables(spark, folder)[1]).withColumn("kinds", F.array_join("kinds", ","))


#: Every entity as an identity that is linked to its nodes, for the bridge to other entities.
@query("identity_entity_bridge", f"WITH {M_SQL} SELECT DISTINCT a.entity_id AS identity_id, b.entity_id FROM m a JOIN m b ON a.node_id = b.node_id WHERE a.entity_id IN (SELECT id FROM entity WHERE entity_type = 'person') AND b.entity_id IN (SELECT id FROM entity WHERE entity_type <> 'person')")
def identity_entity_bridge(spark: SparkSession, folder: str) -> DataFrame:
    m, e = mentions(spark, folder), table(spark, folder, "entity").select("id", "entity_type").distinct()
    links = m.join(e.filter("entity_type = 'person'").select(F.col("id").alias("entity_id")), "entity_id", "left_semi").withColumnRenamed("entity_id", "identity_id")
    return O.bridges(links, m, e.filter("entity_type <> 'person'").select("id").distinct())


# --- clocks ----------------------------------------------------------------------------------------------------------

SP = "tf AS (SELECT * FROM f WHERE file_type IN ('audio', 'video')), sp AS (SELECT tf.case_id, r.source_a, tf.id AS source_b FROM tf JOIN (SELECT case_id, arg_min(id, (registered_at, id)) AS source_a FROM tf GROUP BY case_id) r USING (case_id) WHERE tf.id <> r.source_a)"
VA = f"""va0 AS (SELECT sp.*, x.start_time AS time_a, y.start_time AS time_b, y.start_time - x.start_time AS d, round_even(y.start_time - x.start_time, 0)::INT AS bin, {cos('x.clip_embedding', 'y.clip_embedding')} AS similarity FROM sp JOIN cn x ON x.source_file_id = sp.source_a JOIN cn y ON y.source_file_id = sp.source_b
      WHERE len(x.clip_embedding) = {WIDTH} AND len(y.clip_embedding) = {WIDTH} AND x.start_time IS NOT NULL AND y.start_time IS NOT NULL AND {cos('x.clip_embedding', 'y.clip_embedding')} > 0.5),
    vb AS (SELECT case_id, source_a, source_b, bin, median(d) AS middle, CASE WHEN count(*) = 1 THEN 0.1 ELSE stddev_pop(d) END AS spread FROM va0 GROUP BY ALL),
    va AS (SELECT case_id, source_a, source_b, time_a, time_b, similarity, greatest(0, least(1, 1 - abs(d - middle) / (spread + 1))) AS consistency, 'visual' AS method FROM va0 JOIN vb USING (case_id, source_a, source_b, bin))"""
AA = f"""aa AS (SELECT sp.*, x.start_time AS time_a, y.start_time AS time_b, {cos('x.audio_embedding', 'y.audio_embedding')} AS similarity, trunc(x.start_time / 5)::INT AS cluster, 'audio' AS method FROM sp JOIN cn x ON x.source_file_id = sp.source_a JOIN cn y ON y.source_file_id = sp.source_b
      WHERE len(x.audio_embedding) = 768 AND len(y.audio_embedding) = 768 AND x.start_time IS NOT NULL AND y.start_time IS NOT NULL AND {cos('x.audio_embedding', 'y.audio_embedding')} > 0.3)"""
IA = """nth AS (SELECT *, row_number() OVER (PARTITION BY source_file_id, voice_cluster_id ORDER BY start_time) AS n FROM voices),
    ia AS (SELECT sp.case_id, sp.source_a, sp.source_b, a.voice_cluster_id AS face_cluster_id, a.start_time AS time_a, b.start_time AS time_b, 0.95::DOUBLE AS similarity, 'identity' AS method FROM sp JOIN nth a ON a.source_file_id = sp.source_a JOIN nth b ON b.source_file_id = sp.source_b AND b.voice_cluster_id = a.voice_cluster_id AND b.n = a.n)"""
OFFS = """an AS (SELECT case_id, source_a, source_b, method, time_b - time_a AS d FROM aa UNION ALL SELECT case_id, source_a, source_b, method, time_b - time_a FROM va UNION ALL SELECT case_id, source_a, source_b, method, time_b - time_a FROM ia),
    om AS (SELECT *, median(d) OVER (PARTITION BY case_id, source_a, source_b) AS mid FROM an),
    os AS (SELECT case_id, source_a, source_b, any_value(mid) AS offset_seconds, avg(CASE WHEN abs(d - mid) <= 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS confidence, concat_ws(', ', CASE WHEN count(*) FILTER (method = 'audio') > 0 THEN 'audio(' || count(*) FILTER (method = 'audio') || ')' END, CASE WHEN count(*) FILTER (method = 'visual') > 0 THEN 'visual(' || count(*) FILTER (method = 'visual') || ')' END, CASE WHEN count(*) FILTER (method = 'identity') > 0 THEN 'identity(' || count(*) FILTER (method = 'identity') || ')' END) AS method, count(*) AS anchor_count FROM om GROUP BY 1, 2, 3)"""


def _timed_vectors(spark: SparkSession, folder: str, vector: str, dims: int) -> DataFrame:
    return checked(case_nodes(spark, folder, "start_time", vector).filter("start_time is not null"), vector, dims).withColumnRenamed("node_id", "row_id")


def pairs_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Only sources with times have clocks to bring together."""
    return S.source_pairs(case_files(spark, folder).filter(F.col("file_type").isin("audio", "video")).select("case_id", "source_file_id", "registered_at"))


def anchors(spark: SparkSession, folder: str) -> list[DataFrame]:
    pairs = pairs_of_sources(spark, folder)
    sound = S.audio_anchors(_timed_vectors(spark, folder, "audio_embedding", 768), pairs, least=0.3)
    sight = S.visual_anchors(_timed_vectors(spark, folder, "clip_embedding", WIDTH), pairs, least=0.5)
    return [sound, sight, S.identity_anchors(voices(spark, folder).withColumnRenamed("voice_cluster_id", "face_cluster_id"), pairs)]


SYNC = f"{F_SQL}, {CN}, {VOICES}, {SP}, {AA}, {VA}, {IA}"


@query("audio_anchors", f"WITH {SYNC} SELECT case_id, source_a, source_b, time_a, time_b, round(similarity, 6) AS similarity, cluster FROM aa")
def audio_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return anchors(spark, folder)[0].select("case_id", "source_a", "source_b", "time_a", "time_b", F.round("similarity", 6).alias("similarity"), "cluster")


@query("visual_anchors", f"WITH {SYNC} SELECT case_id, source_a, source_b, time_a, time_b, round(similarity, 6) AS similarity, round(consistency, 6) AS consistency FROM va")
def visual_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return anchors(spark, folder)[1].select("case_id", "source_a", "source_b", "time_a", "time_b", F.round("similarity", 6).alias("similarity"), F.round("consistency", 6).alias("consistency"))


@query("identity_anchors", f"WITH {SYNC} SELECT case_id, source_a, source_b, face_cluster_id, time_a, time_b FROM ia")
def identity_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return anchors(spark, folder)[2].select("case_id", "source_a", "source_b", "face_cluster_id", "time_a", "time_b")


@query("source_offsets", f"WITH {SYNC}, {OFFS} SELECT case_id, source_a, source_b, round(offset_seconds, 6) AS offset_seconds, round(confidence, 6) AS confidence, method, anchor_count FROM os")
def source_offsets(spark: SparkSession, folder: str) -> DataFrame:
    got = S.estimate_offsets(anchors(spark, folder))
    return got.select("case_id", "source_a", "source_b", F.round("offset_seconds", 6).alias("offset_seconds"), F.round("confidence", 6).alias("confidence"), "method", "anchor_count")


@query("sync_status", f"WITH {SYNC}, {OFFS} SELECT os.case_id, a.file_name AS source_a_name, b.file_name AS source_b_name, round(offset_seconds, 6) AS offset_seconds, method FROM os JOIN f a ON a.id = source_a JOIN f b ON b.id = source_b")
def sync_status(spark: SparkSession, folder: str) -> DataFrame:
    got = S.sync_status(S.estimate_offsets(anchors(spark, folder)), case_files(spark, folder).select("source_file_id", "file_name"))
    return got.select("case_id", "source_a_name", "source_b_name", F.round("offset_seconds", 6).alias("offset_seconds"), "method")


#: Of the sources of a case those take part that have an offset, as few cases have one for every source.
@query(
    "case_times",
    f"""WITH {SYNC}, {OFFS}, mv AS (SELECT case_id, source_b AS s, offset_seconds AS shift FROM os UNION ALL SELECT DISTINCT case_id, source_a, 0.0 FROM os)
    SELECT cn.id AS node_id, round(cn.start_time + mv.shift, 6) AS case_time FROM cn JOIN mv ON mv.case_id = cn.case_id AND mv.s = cn.source_file_id WHERE cn.start_time IS NOT NULL""",
)
def case_times(spark: SparkSession, folder: str) -> DataFrame:
    offsets = S.estimate_offsets(anchors(spark, folder))
    offsets = Scratch(spark).cut(offsets, "offsets")
    found = offsets.select("case_id", "source_a", "source_b")
    return S.case_times(case_nodes(spark, folder, "start_time"), found, offsets).withColumn("case_time", F.round("case_time", 6))


@query("complete_cases", f"WITH {SYNC}, {OFFS} SELECT case_id FROM sp LEFT JOIN os USING (case_id, source_a, source_b) GROUP BY case_id HAVING count(*) = count(offset_seconds)")
def complete_cases(spark: SparkSession, folder: str) -> DataFrame:
    return S.complete_cases(pairs_of_sources(spark, folder), S.estimate_offsets(anchors(spark, folder)))


# --- edges of like vectors -------------------------------------------------------------------------------------------

VEC = f"vx AS (SELECT case_id, id, node_type, start_time, clip_embedding AS v FROM cn WHERE len(clip_embedding) = {WIDTH})"


def clip_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return checked(case_nodes(spark, folder, "node_type", "clip_embedding"), "clip_embedding", WIDTH)


@query("clip_edges", f"WITH {F_SQL}, {CN}, {VEC} SELECT a.case_id, a.id AS a, b.id AS b, round({cos('a.v', 'b.v')}, 6) AS score FROM vx a JOIN vx b ON a.case_id = b.case_id AND a.id < b.id WHERE {cos('a.v', 'b.v')} > 0.8")
def clip_edges(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_above(clip_vectors(spark, folder), "case_id", "node_id", "clip_embedding", 0.8).withColumn("score", F.round("score", 6))


@query("page_references", f"WITH {F_SQL}, {CN}, {VEC} SELECT a.case_id, a.id AS a, b.id AS b, round({cos('a.v', 'b.v')}, 6) AS score FROM vx a JOIN vx b ON a.case_id = b.case_id WHERE a.node_type = 'page' AND b.node_type = 'scene_segment' AND {cos('a.v', 'b.v')} > 0.3")
def page_references(spark: SparkSession, folder: str) -> DataFrame:
    v = clip_vectors(spark, folder)
    return cross_above(v.filter("node_type = 'page'"), v.filter("node_type = 'scene_segment'"), "case_id", "node_id", "clip_embedding", 0.3).withColumn("score", F.round("score", 6))


@query(
    "face_clusters",
    f"""WITH RECURSIVE {F_SQL}, {CN}, {VEC}, e AS (SELECT a.id AS a, b.id AS b FROM vx a JOIN vx b ON a.case_id = b.case_id AND a.id <> b.id WHERE {cos('a.v', 'b.v')} > 0.6), r AS (SELECT DISTINCT a AS node_id, a AS other FROM e UNION SELECT r.node_id, e.b FROM r JOIN e ON e.a = r.other) SELECT node_id, min(other) AS cluster FROM r GROUP BY node_id""",
)
def face_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return density_clusters(clip_vectors(spark, folder), "case_id", "node_id", "clip_embedding", 0.4)


@query("voice_clusters")
def voice_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return average_linkage(clip_vectors(spark, folder), "case_id", "node_id", "clip_embedding", 0.4)


# --- packs and edges -------------------------------------------------------------------------------------------------

PACK = ["node_type", "start_time", "end_time", "page_number", "text_content"]


def pack_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return case_nodes(spark, folder, *PACK).drop("case_id").withColumn("claim", F.lit(None).cast("string"))


@query(
    "evidence_pack_relations",
    f"""WITH {F_SQL}, {CN}, {M_SQL}, {CE}, {ENT}, w AS (SELECT * FROM cn WHERE end_time >= 60 AND start_time <= 600 AND id IN (SELECT node_id FROM m WHERE entity_id IN (SELECT id FROM en WHERE normalized_name LIKE '%a%'))),
    ends AS (SELECT node_a AS near, node_b AS far, relationship_type, confidence FROM ce UNION ALL SELECT node_b, node_a, relationship_type, confidence FROM ce),
    rel AS (SELECT near, string_agg(relationship_type || ' ' || far || ' ' || cn.node_type, ';' ORDER BY relationship_type, confidence DESC NULLS LAST, far) AS relations FROM ends JOIN cn ON cn.id = ends.far GROUP BY near)
    SELECT w.id AS node_id, w.node_type, w.start_time, w.end_time, w.file_name, coalesce(relations, '') AS relations FROM w LEFT JOIN rel ON rel.near = w.id""",
)
def evidence_pack_relations(spark: SparkSession, folder: str) -> DataFrame:
    got = P.evidence_pack(pack_nodes(spark, folder), case_files(spark, folder), claim_edges(spark, folder), mentions(spark, folder), entities(spark, folder), entity="A", start=60.0, end=600.0)
    shown = F.array_join(F.transform("relations", lambda r: F.concat_ws(" ", r["relationship_type"], r["other_node_id"], r["other_node_type"])), ";")
    return got.select("node_id", "node_type", "start_time", "end_time", "file_name", shown.alias("relations"))


@query("conflict_pack", f"WITH {F_SQL}, {CN}, {CE} SELECT id AS node_id, (SELECT count(*) FROM ce WHERE node_a = cn.id AND node_b IN (SELECT id FROM cn)) + (SELECT count(*) FROM ce WHERE node_b = cn.id AND node_a IN (SELECT id FROM cn)) AS relations FROM cn WHERE id IN (SELECT node_a FROM ce WHERE node_b IN (SELECT id FROM cn) UNION SELECT node_b FROM ce WHERE node_a IN (SELECT id FROM cn))")
def conflict_pack(spark: SparkSession, folder: str) -> DataFrame:
    got = P.evidence_pack(pack_nodes(spark, folder), case_files(spark, folder), claim_edges(spark, folder), only_conflicts=True)
    return got.select("node_id", F.size("relations").cast("long").alias("relations"))


@query(
    "every_edge",
    f"""WITH {M_SQL}, {CE}, al AS (SELECT least(node_a_id, node_b_id) AS a, greatest(node_a_id, node_b_id) AS b, upper(trim(alignment_type)) AS kind, max(score) AS score FROM source_alignment WHERE node_a_id <> node_b_id GROUP BY 1, 2, 3), mc AS (SELECT entity_id, evidence_node_id AS node_id, max(confidence) AS score FROM mention WHERE entity_id IS NOT NULL AND evidence_node_id IS NOT NULL GROUP BY 1, 2)
    SELECT a AS near, b AS far, kind, round(score, 6) AS score FROM al UNION ALL SELECT b, a, kind, round(score, 6) FROM al UNION ALL SELECT node_a, node_b, relationship_type, round(confidence, 6) FROM ce UNION ALL SELECT node_b, node_a, relationship_type, round(confidence, 6) FROM ce UNION ALL SELECT node_id, entity_id, 'MENTIONS', round(score, 6) FROM mc
    UNION ALL SELECT node_id, entity_id, 'IDENTITY_LINK', round(score, 6) FROM mc WHERE entity_id IN (SELECT id FROM entity WHERE entity_type = 'person')""",
)
def every_edge(spark: SparkSession, folder: str) -> DataFrame:
    drawn = table(spark, folder, "source_alignment").filter("node_a_id <> node_b_id").groupBy(F.least("node_a_id", "node_b_id").alias("a"), F.greatest("node_a_id", "node_b_id").alias("b"), F.upper(F.trim("alignment_type")).alias("kind")).agg(F.max("score").alias("score"))
    named = table(spark, folder, "mention").select("entity_id", F.col("evidence_node_id").alias("node_id"), "confidence").filter("entity_id is not null and node_id is not null").groupBy("entity_id", "node_id").agg(F.max("confidence").alias("confidence"))
    people = table(spark, folder, "entity").filter("entity_type = 'person'").select(F.col("id").alias("entity_id")).distinct()
    links = named.join(people, "entity_id", "left_semi").withColumnRenamed("entity_id", "identity_id")
    return P.node_edges(drawn, claim_edges(spark, folder), named, links).withColumn("score", F.round("score", 6))


@query("relations_about", f"WITH {F_SQL}, {CN}, {CE} SELECT relationship_type, node_a, node_b, x.node_type AS type_a, y.node_type AS type_b, x.file_name AS file_a, y.file_name AS file_b FROM ce JOIN cn x ON x.id = node_a JOIN cn y ON y.id = node_b WHERE x.text_content ILIKE '%phone%' OR y.text_content ILIKE '%phone%' ORDER BY relationship_type, confidence DESC NULLS LAST, node_a, node_b LIMIT 40")
def relations_about(spark: SparkSession, folder: str) -> DataFrame:
    return P.relations_about(claim_edges(spark, folder), pack_nodes(spark, folder), case_files(spark, folder), "phone", limit=40).drop("confidence", "explanation")


@query("comentioned_entities", f"WITH {M_SQL}, {ENT}, s AS (SELECT id FROM en WHERE normalized_name LIKE '%an%') SELECT o.entity_id, en.canonical_name, en.entity_type, count(DISTINCT o.node_id) AS shared_nodes, min(o.node_id) AS sample_node FROM m o JOIN m t ON t.node_id = o.node_id AND t.entity_id <> o.entity_id JOIN en ON en.id = o.entity_id WHERE t.entity_id IN (SELECT id FROM s) GROUP BY 1, 2, 3 ORDER BY shared_nodes DESC, canonical_name, entity_id LIMIT 25")
def comentioned_entities(spark: SparkSession, folder: str) -> DataFrame:
    return P.co_mentioned(mentions(spark, folder), entities(spark, folder), "an", 25)


@query("entities_naming", f"WITH {M_SQL}, {ENT} SELECT m.entity_id, en.canonical_name, string_agg(m.node_id, ',' ORDER BY m.node_id) AS node_ids FROM m JOIN en ON en.id = m.entity_id WHERE en.normalized_name LIKE '%an%' GROUP BY 1, 2")
def entities_naming(spark: SparkSession, folder: str) -> DataFrame:
    return P.entities_with_nodes(mentions(spark, folder), entities(spark, folder), "An").withColumn("node_ids", F.array_join("node_ids", ","))


# --- the graph -------------------------------------------------------------------------------------------------------

TOP = "te AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY mention_count DESC NULLS LAST, id) AS rn FROM en) WHERE rn <= 150)"


@query(
    "graph_overview_nodes",
    f"""WITH RECURSIVE {F_SQL}, {CN}, {M_SQL}, {ENT}, {CE}, {EV}, {TOP}, sh AS (SELECT node_a AS id FROM ce UNION SELECT node_b FROM ce UNION SELECT node_id FROM ev)
    SELECT 'entity:' || id AS id, canonical_name AS label, entity_type AS type, mention_count::DOUBLE AS weight FROM te
    UNION ALL SELECT 'node:' || cn.id, cn.node_type || CASE WHEN page_number IS NOT NULL THEN ' at p' || page_number WHEN start_time IS NOT NULL THEN ' at ' || {tenth('start_time')} || 's' ELSE '' END || ' in ' || file_name, 'evidence', 1 FROM cn WHERE cn.id IN (SELECT id FROM sh)
    UNION ALL SELECT 'event:' || event_id, count(*) || ' evidence node(s) between ' || {tenth('min(cn.start_time)')} || 's and ' || {tenth('max(cn.end_time)')} || 's', 'event', 1 FROM ev JOIN cn ON cn.id = ev.node_id GROUP BY cn.case_id, event_id""",
)
def graph_overview_nodes(spark: SparkSession, folder: str) -> DataFrame:
    events, links = timeline_events(*event_inputs(spark, folder))
    nobody = spark.createDataFrame([], "identity_id string, display_name string")
    shown = O.shown_nodes(claim_edges(spark, folder), links)
    top = O.top_entities(entities(spark, folder))
    got = O.graph_nodes(top, nobody, pack_nodes(spark, folder), case_files(spark, folder), events.filter("description is not null"), shown)
    return got.select("id", "label", "type", "weight")


@query(
    "graph_overview_edges",
    f"""WITH RECURSIVE {F_SQL}, {CN}, {M_SQL}, {ENT}, {CE}, {EV}, {TOP}
    SELECT 'entity:' || a.entity_id AS source, 'entity:' || b.entity_id AS target, 'co_occurs_with' AS type, count(*)::DOUBLE AS weight FROM m a JOIN m b ON a.node_id = b.node_id AND b.entity_id > a.entity_id WHERE a.entity_id IN (SELECT id FROM te) AND b.entity_id IN (SELECT id FROM te) GROUP BY 1, 2
    UNION ALL SELECT 'node:' || node_a, 'node:' || node_b, lower(relationship_type), round(coalesce(nullif(confidence, 0), 1), 6) FROM ce UNION ALL SELECT 'event:' || event_id, 'node:' || node_id, 'belongs_to', 1 FROM ev""",
)
def graph_overview_edges(spark: SparkSession, folder: str) -> DataFrame:
    links = timeline_events(*event_inputs(spark, folder))[1]
    pairs = O.co_occurrences(mentions(spark, folder), O.top_entities(entities(spark, folder)))
    bridged = spark.createDataFrame([], "identity_id string, entity_id string")
    return O.graph_edges(pairs, bridged, claim_edges(spark, folder), links).select("source", "target", "type", F.round("weight", 6).alias("weight"))


@query("graph_of_category", f"WITH {M_SQL}, {ENT}, {TOP}, k AS (SELECT id FROM te WHERE entity_type IN ('person', 'location')) SELECT 'entity:' || a.entity_id AS source, 'entity:' || b.entity_id AS target, count(*)::DOUBLE AS weight FROM m a JOIN m b ON a.node_id = b.node_id AND b.entity_id > a.entity_id WHERE a.entity_id IN (SELECT id FROM k) AND b.entity_id IN (SELECT id FROM k) GROUP BY 1, 2")
def graph_of_category(spark: SparkSession, folder: str) -> DataFrame:
    top = O.top_entities(entities(spark, folder))
    nodes = top.select(F.concat(F.lit("entity:"), "id").alias("id"), F.col("entity_type").alias("type"))
    named = O.co_occurrences(mentions(spark, folder), top).select(F.concat(F.lit("entity:"), "source").alias("source"), F.concat(F.lit("entity:"), "target").alias("target"), F.lit("co_occurs_with").alias("type"), F.col("weight").cast("double").alias("weight"), F.lit(None).cast("string").alias("detail"))
    return O.of_categories(nodes, named, ["person", "location"])[1].select("source", "target", "weight")


# --- reports and listings --------------------------------------------------------------------------------------------


@query("index_coverage", f"WITH {F_SQL}, {CN} SELECT case_id, count(*) AS total, count(clip_embedding) AS visual, count(text_embedding) AS text FROM cn GROUP BY ROLLUP (case_id)")
def index_coverage(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "evidence_node").select("id", "source_file_id", *[F.when(F.col(c).isNotNull(), 1).alias(c) for c in ("clip_embedding", "text_embedding")])
    once = seen.groupBy("id").agg(*[F.max(c).alias(c) for c in ("source_file_id", "clip_embedding", "text_embedding")])
    return R.index_coverage(once, case_files(spark, folder))


@query("audio_coverage", f"WITH {F_SQL}, {CN} SELECT node_type, count(*) AS total, count(audio_embedding) AS with_embedding, count(*) - count(audio_embedding) AS missing FROM cn GROUP BY node_type")
def audio_coverage(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "evidence_node").select("id", "source_file_id", "node_type", F.when(F.col("audio_embedding").isNotNull(), 1).alias("audio_embedding"))
    once = seen.groupBy("id").agg(*[F.max(c).alias(c) for c in ("source_file_id", "node_type", "audio_embedding")])
    return R.audio_coverage(once.join(case_files(spark, folder).select("source_file_id"), "source_file_id", "left_semi"))


@query(
    "graph_summary",
    f"""WITH RECURSIVE {F_SQL}, {CN}, {M_SQL}, {ENT}, {CE}, {EV}, k AS (SELECT case_id, alignment_type, count(*) AS n FROM (SELECT DISTINCT id, case_id, upper(trim(alignment_type)) AS alignment_type FROM source_alignment) GROUP BY 1, 2)
    SELECT c.id AS case_id, (SELECT count(*) FROM en WHERE en.case_id = c.id) AS entities, (SELECT count(*) FROM m JOIN en ON en.id = m.entity_id WHERE en.case_id = c.id) AS mentions, (SELECT count(*) FROM (SELECT DISTINCT event_id FROM ev JOIN cn ON cn.id = ev.node_id WHERE cn.case_id = c.id)) AS timeline_events,
      (SELECT string_agg(alignment_type || '=' || n, ',' ORDER BY alignment_type) FROM k WHERE k.case_id = c.id) AS alignments FROM evidence_case c""",
)
def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "evidence_case").select(F.col("id").alias("case_id"))
    own = entities(spark, folder)
    named = mentions(spark, folder).join(own.select(F.col("id").alias("entity_id"), "case_id"), "entity_id")
    drawn = table(spark, folder, "source_alignment").select("id", "case_id", F.upper(F.trim("alignment_type")).alias("alignment_type")).distinct().filter("alignment_type is not null")
    got = R.graph_summary(cases, {"entities": own, "mentions": named, "timeline_events": timeline_events(*event_inputs(spark, folder))[0]}, {"alignments": (drawn, "alignment_type")})
    return got.withColumn("alignments", F.array_join(F.transform(F.array_sort(F.map_entries("alignments")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("node_listing", f"WITH {F_SQL}, {CN} SELECT id, node_type, page_number, start_time, (enriched_at IS NOT NULL) AS enriched, (clip_embedding IS NOT NULL) AS has_visual_vector, (text_embedding IS NOT NULL) AS has_text_vector, (node_type IN ('image', 'page') AND file_path IS NOT NULL) AS has_thumbnail, row_number() OVER (PARTITION BY source_file_id ORDER BY page_number NULLS LAST, start_time NULLS LAST, created_at NULLS LAST, id) AS place FROM cn")
def node_listing(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "evidence_node").filter("id is not null")
    flags = rows.select("id", "source_file_id", "node_type", "page_number", "start_time", "end_time", "created_at", "enriched_at", "file_path", *[F.when(F.col(c).isNotNull(), 1).alias(c) for c in ("clip_embedding", "text_embedding")])
    once = W.keep_latest(flags, ["id"], [F.col("created_at").asc_nulls_last()]).join(case_files(spark, folder).select("source_file_id"), "source_file_id", "left_semi")
    nothing = F.lit(None).cast(M.METADATA)
    card = M.node_card({**{c: F.col(c) for c in once.columns}, "text_content": F.lit(None).cast("string"), "metadata": nothing})
    place = F.row_number().over(Window.partitionBy("source_file_id").orderBy(*R.file_order(), "id")).alias("place")
    return once.select(*[c for c in card], place).select("id", "node_type", "page_number", "start_time", "enriched", "has_visual_vector", "has_text_vector", "has_thumbnail", "place")


@query("latest_files", f"WITH {F_SQL} SELECT id AS source_file_id, file_name, registered_at FROM f ORDER BY registered_at DESC NULLS LAST, id LIMIT 50")
def latest_files(spark: SparkSession, folder: str) -> DataFrame:
    return R.newest_first(case_files(spark, folder).select("source_file_id", "file_name", "registered_at"), "registered_at", "source_file_id", 50)


@query(
    "findings_in_order",
    f"""WITH {F_SQL}, {CN}, t AS (SELECT case_id, mention_text AS finding, min((coalesce(m.created_at, TIMESTAMPTZ '1970-01-01'), m.id)) AS first_at FROM mention m JOIN cn ON cn.id = m.evidence_node_id WHERE mention_text IS NOT NULL GROUP BY 1, 2)
    SELECT case_id, finding, at_no::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY first_at, finding) AS at_no FROM t) WHERE at_no <= 12""",
)
def findings_in_order(spark: SparkSession, folder: str) -> DataFrame:
    cases = case_nodes(spark, folder).select(F.col("node_id").alias("evidence_node_id"), "case_id")
    rows = table(spark, folder, "mention").join(cases, "evidence_node_id").withColumn("at_time", F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp"))).withColumnRenamed("mention_text", "finding")
    return R.distinct_in_order(rows, "case_id", [F.col("at_time"), F.col("id")], "finding", 12).withColumnRenamed("at", "place")


# --- nested values ---------------------------------------------------------------------------------------------------


@query(
    "detection_summary",
    f"""WITH {F_SQL}, {CN}, d AS (SELECT cn.source_file_id, e.entity_type AS label, m.confidence FROM (SELECT DISTINCT id, entity_id, evidence_node_id, confidence FROM mention) m JOIN (SELECT DISTINCT id, entity_type FROM entity) e ON e.id = m.entity_id JOIN cn ON cn.id = m.evidence_node_id), g AS (SELECT source_file_id, label, count(*) AS n, max(confidence) AS top FROM d GROUP BY 1, 2)
    SELECT source_file_id, string_agg(label || ':' || n || ':' || coalesce(printf('%.4f', top), '-'), ',' ORDER BY label) AS labels, sum(n)::INT AS total FROM g GROUP BY 1""",
)
def detection_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "mention").select("id", "entity_id", "evidence_node_id", "confidence").distinct()
    kinds = table(spark, folder, "entity").select(F.col("id").alias("entity_id"), F.col("entity_type").alias("label")).distinct()
    boxes = found.join(kinds, "entity_id").join(case_nodes(spark, folder).select(F.col("node_id").alias("evidence_node_id"), "source_file_id"), "evidence_node_id").groupBy("source_file_id").agg(F.collect_list(F.struct("label", "confidence")).alias("boxes"))
    got = boxes.select("source_file_id", M.summarise_detections(F.col("boxes")).alias("s"))
    best = lambda e: F.when(e["value"]["max_confidence"].isNull(), "-").otherwise(F.format_string("%.4f", e["value"]["max_confidence"]))
    shown = F.transform(F.array_sort(F.map_entries("s.labels")), lambda e: F.concat_ws(":", e["key"], e["value"]["count"], best(e)))
    return got.select("source_file_id", F.array_join(shown, ",").alias("labels"), F.col("s.total").alias("total"))


@query(
    "frames_of_sources",
    f"""WITH {F_SQL}, {CN}, g AS (SELECT source_file_id, list({{'timestamp': start_time, 'path': id}} ORDER BY start_time, id) AS frames FROM cn WHERE node_type = 'scene_segment' AND start_time IS NOT NULL GROUP BY 1)
    SELECT source_file_id, frames[len(frames) // 2 + 1].path AS representative, frames[len(frames) // 2 + 1].timestamp AS shown_at, array_to_string(CASE WHEN len(frames) <= 8 THEN list_transform(frames, lambda x: x.path) ELSE list_transform(range(0, 8), lambda i: frames[(i * len(frames)) // 8 + 1].path) END, ',') AS sampled FROM g""",
)
def frames_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = case_nodes(spark, folder, "node_type", "start_time").filter("node_type = 'scene_segment' and start_time is not null")
    got = rows.groupBy("source_file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_time").alias("timestamp"), F.col("node_id").alias("path")))).alias("frames"))
    shown = M.middle(F.col("frames"))["path"]
    return got.select("source_file_id", shown.alias("representative"), M.frame_time(F.col("frames"), shown).alias("shown_at"), F.array_join(F.transform(M.subsample(F.col("frames"), 8), lambda f: f["path"]), ",").alias("sampled"))


@query(
    "lines_of_pages",
    f"""WITH {F_SQL}, {CN} SELECT source_file_id, string_agg(substring(text_content, 1, 40), chr(10) ORDER BY page_number, id) AS text, count(*)::INT AS line_count, round(avg(metadata.ocr_mean_confidence)::DECIMAL(18, 9), 4)::DOUBLE AS mean_confidence FROM cn WHERE node_type = 'page' AND text_content IS NOT NULL AND page_number IS NOT NULL GROUP BY 1""",
)
def lines_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = case_nodes(spark, folder, "node_type", "page_number", "text_content", "metadata").filter("node_type = 'page' and text_content is not null and page_number is not null")
    lines = rows.groupBy("source_file_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "node_id", F.substring("text_content", 1, 40).alias("text"), F.col("metadata.ocr_mean_confidence").alias("confidence")))).alias("lines"))
    return lines.select("source_file_id", M.read_lines(F.col("lines")).alias("r")).select("source_file_id", "r.*")


@query(
    "violence_scores",
    """WITH l AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: x::DOUBLE * 10) AS a, list_transform(embedding[6:10], lambda x: x::DOUBLE * 10) AS b FROM embeddings),
    s AS (SELECT vec_id, list_sum(list_transform(a[1:2], lambda x: exp(x))) / list_sum(list_transform(a, lambda x: exp(x))) AS p, list_sum(list_transform(b[1:2], lambda x: exp(x))) / list_sum(list_transform(b, lambda x: exp(x))) AS q FROM l) SELECT vec_id, round((p + q) / 2, 6) AS score FROM s""",
)
def violence_scores(spark: SparkSession, folder: str) -> DataFrame:
    ten = lambda a: F.transform(F.slice("embedding", a, 5), lambda x: x.cast("double") * 10)
    return table(spark, folder, "embeddings").select("vec_id", F.round(M.violence(F.array(ten(1), ten(6)), 2), 6).alias("score"))


@query(
    "sections_of_nodes",
    f"""WITH {F_SQL}, {CN}, t AS (SELECT id, concat_ws(chr(10) || chr(10), CASE WHEN node_type = 'page' THEN 'Document text: ' ELSE 'Transcript: ' END || trim(regexp_replace(substring(text_content, 1, 60), '[\\s:]+', ' ', 'g')), 'Visual description: ' || node_type) AS x FROM cn WHERE trim(regexp_replace(substring(text_content, 1, 60), '[\\s:]+', ' ', 'g')) <> '')
    SELECT id AS node_id, CASE WHEN x LIKE 'Document%' THEN 'Document text' ELSE 'Transcript' END AS first_label, trim(split_part(split_part(x, ': ', 2), chr(10) || chr(10), 1)) AS first_body, 2::INT AS sections FROM t""",
)
def sections_of_nodes(spark: SparkSession, folder: str) -> DataFrame:
    body = F.trim(F.regexp_replace(F.substring("text_content", 1, 60), r"[\s:]+", " "))
    rows = case_nodes(spark, folder, "node_type", "text_content").withColumn("body", body).filter("body <> ''")
    head = F.when(F.col("node_type") == "page", "Document text: ").otherwise("Transcript: ")
    text = F.concat_ws("\n\n", F.concat(head, "body"), F.concat(F.lit("Visual description: "), "node_type"))
    got = rows.select("node_id", L.split_sections(text).alias("s"))
    return got.select("node_id", F.col("s")[0]["label"].alias("first_label"), F.col("s")[0]["body"].alias("first_body"), F.size("s").alias("sections"))


@query(
    "sampling_targets",
    f"""WITH {F_SQL}, {CN}, s AS (SELECT source_file_id, row_number() OVER (PARTITION BY source_file_id ORDER BY start_time, id) AS segment_no, start_time, end_time FROM cn WHERE node_type = 'scene_segment' AND end_time > start_time),
    t AS (SELECT source_file_id, segment_no, start_time, unnest(range(0, CAST(ceil((end_time - start_time) / 2) AS BIGINT))) AS k FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY segment_no, k) AS rn FROM t) SELECT source_file_id, segment_no::INT AS segment_no, round(start_time + k * 2.0::DOUBLE, 6) AS target FROM n WHERE rn <= 3600""",
)
def sampling_targets_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = case_nodes(spark, folder, "node_type", "start_time", "end_time").filter("node_type = 'scene_segment' and end_time > start_time")
    segments = rows.withColumn("segment_no", F.row_number().over(Window.partitionBy("source_file_id").orderBy("start_time", "node_id")))
    return sampling_targets(segments, "source_file_id").withColumn("target", F.round("target", 6))


@query(
    "file_labels",
    f"""WITH {F_SQL} SELECT id AS source_file_id, CASE WHEN coalesce(size_bytes, 0) = 0 THEN '—' WHEN size_bytes / 1048576.0 < 1 THEN printf('%.0f KB', size_bytes / 1024.0::DOUBLE) ELSE printf('%.1f MB', size_bytes / 1048576.0::DOUBLE) END AS size_label, left(sha256, 16) AS artefact_key,
      CASE WHEN type_mismatch THEN CASE WHEN declared_type IS NOT NULL THEN 'config' ELSE 'extension' END || ' claims ''' || coalesce(declared_type, nullif(regexp_extract(file_name, '[.]([^.]+)$', 1), ''), 'unknown') || ''' but content is ' || coalesce(detected_mime, 'unknown') END AS note FROM f""",
)
def file_labels(spark: SparkSession, folder: str) -> DataFrame:
    note = L.integrity_note(F.lit(None).cast("string"), F.col("type_mismatch"), F.col("declared_type"), F.col("file_name"), F.col("detected_mime"))
    return case_files(spark, folder).select("source_file_id", L.size_label(F.col("size_bytes")).alias("size_label"), L.artefact_key(F.col("sha256")).alias("artefact_key"), note.alias("note"))


@query("graph_shapes", f"WITH {ENT} SELECT id, round(least(6 + 2.5 * sqrt(coalesce(nullif(mention_count, 0), 1)), 22), 6) AS radius, round(least(1 + sqrt(coalesce(nullif(mention_count, 0), 1)), 5), 6) AS width FROM en")
def graph_shapes(spark: SparkSession, folder: str) -> DataFrame:
    return entities(spark, folder).select("id", F.round(L.node_radius(F.col("mention_count")), 6).alias("radius"), F.round(L.link_width(F.col("mention_count")), 6).alias("width"))


@query(
    "answers_by_template",
    f"""WITH {M_SQL}, {ENT}, {F_SQL}, {CN}, x AS (SELECT en.case_id, en.entity_type, cn.id, '- ' || en.canonical_name || ': ' || cn.node_type AS line, row_number() OVER (PARTITION BY en.case_id ORDER BY en.canonical_name, cn.id) AS rn FROM m JOIN en ON en.id = m.entity_id JOIN cn ON cn.id = m.node_id WHERE en.canonical_name IS NOT NULL)
    SELECT c.id AS case_id, coalesce('Evidence mentioning this (' || count(x.line) FILTER (rn <= 10) || ' item(s)):' || chr(10) || string_agg(x.line, chr(10) ORDER BY rn) FILTER (rn <= 10), 'No evidence in this case matches that question.') AS answer FROM evidence_case c LEFT JOIN x ON x.case_id = c.id GROUP BY c.id""",
)
def answers_by_template(spark: SparkSession, folder: str) -> DataFrame:
    own = entities(spark, folder).select(F.col("id").alias("entity_id"), F.col("case_id").alias("of_case"), "canonical_name").filter("canonical_name is not null")
    rows = mentions(spark, folder).join(own, "entity_id").join(case_nodes(spark, folder, "node_type").select("node_id", "node_type"), "node_id")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("of_case").orderBy("canonical_name", "node_id"))).filter("n <= 10")
    facts = first.groupBy("of_case").agg(F.array_sort(F.collect_list(F.struct("n", F.col("canonical_name").alias("label"), F.col("node_type").alias("detail")))).alias("facts"))
    cases = table(spark, folder, "evidence_case").select(F.col("id").alias("case_id"))
    got = cases.join(facts, F.col("case_id") == F.col("of_case"), "left")
    none = F.array().cast(facts.schema["facts"].dataType)
    return got.select("case_id", L.template_answer(F.lit("entity"), F.coalesce("facts", none)).alias("answer"))


# --- search ----------------------------------------------------------------------------------------------------------

#: The question's vectors are those of the smallest node that has both.
QV = f"qv AS (SELECT clip_embedding AS qc, text_embedding AS qt FROM cn WHERE len(clip_embedding) = {WIDTH} AND len(text_embedding) = {DIMS} ORDER BY id LIMIT 1)"
HITS = f"""vh AS (SELECT id, {cos('clip_embedding', 'qc')} AS s FROM cn, qv WHERE len(clip_embedding) = {WIDTH} ORDER BY s DESC, id LIMIT 60), vg AS (SELECT * FROM vh WHERE s >= 0.24), vv AS (SELECT * FROM vg WHERE s >= 0.85 * (SELECT max(s) FROM vg)),
    th AS (SELECT id, {cos('text_embedding', 'qt')} AS s FROM cn, qv WHERE len(text_embedding) = {DIMS} ORDER BY s DESC, id LIMIT 60), tg AS (SELECT * FROM th WHERE s >= 0.25), tv AS (SELECT * FROM tg WHERE s >= 0.60 * (SELECT max(s) FROM tg)),
    kh AS (SELECT id, (contains(lower(text_content), 'cracked'))::INT + (contains(lower(text_content), 'phone'))::INT + (contains(lower(text_content), 'turnstile'))::INT AS k, length(text_content) AS l FROM cn), kv AS (SELECT id, k / 3.0::DOUBLE AS s FROM kh WHERE k > 0 ORDER BY k DESC, l, id LIMIT 60),
    tt AS (SELECT coalesce(tv.id, kv.id) AS id, coalesce(tv.s, kv.s) AS s, CASE WHEN tv.id IS NULL THEN ['keyword'] WHEN kv.id IS NULL THEN ['text'] ELSE ['keyword', 'text'] END AS tags FROM tv FULL JOIN kv ON kv.id = tv.id)"""


def search_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float], list[float]]:
    rows = case_nodes(spark, folder, "text_content", "text_embedding", "clip_embedding")
    q = rows.filter((F.size("clip_embedding") == WIDTH) & (F.size("text_embedding") == DIMS)).orderBy("node_id").select("clip_embedding", "text_embedding").first()
    return rows, list(q.clip_embedding), list(q.text_embedding)


@query(
    "search_hybrid",
    f"""WITH {F_SQL}, {CN}, {QV}, {HITS}, u AS (SELECT id, s * 0.45 AS p, ['visual'] AS tags FROM vv UNION ALL SELECT id, s * 0.55, tags FROM tt)
    SELECT id AS node_id, round(sum(p), 6) AS score, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS matched_on FROM u GROUP BY id ORDER BY round(sum(p), 12) DESC, id LIMIT 20""",
)
def search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    rows, clip, text = search_inputs(spark, folder)
    got = Q.search(rows, "who cracked the phone at the turnstile", clip, text, limit=20)
    return got.select("node_id", F.round("score", 6).alias("score"), F.array_join("matched_on", ",").alias("matched_on"))


@query("search_text", f"WITH {F_SQL}, {CN}, {QV}, {HITS} SELECT id AS node_id, round(s, 6) AS score, array_to_string(tags, ',') AS matched_on FROM tt ORDER BY round(s, 12) DESC, id LIMIT 20")
def search_text(spark: SparkSession, folder: str) -> DataFrame:
    rows, _, text = search_inputs(spark, folder)
    got = Q.search(rows, "who cracked the phone at the turnstile", None, text, "text", limit=20)
    return got.select("node_id", F.round("score", 6).alias("score"), F.array_join("matched_on", ",").alias("matched_on"))


# --- writes ----------------------------------------------------------------------------------------------------------


@query(
    "enrichment_write_back",
    f"""WITH {F_SQL}, {CN} SELECT id AS node_id, CASE WHEN node_type = 'image' THEN 'image: ' || text_content ELSE text_content END AS text_content, CASE WHEN node_type = 'image' THEN false ELSE text_embedding IS NOT NULL END AS has_text_vector,
      CASE WHEN node_type = 'audio_track' THEN 'model failed' WHEN node_type = 'image' THEN NULL ELSE enrichment_error END AS enrichment_error, (node_type IN ('image', 'audio_track') OR enriched_at IS NOT NULL) AS enriched, CASE WHEN node_type = 'image' THEN coalesce(7, metadata.segment_index) ELSE metadata.segment_index END AS segment_index, metadata.duration_sec AS duration_sec FROM cn""",
)
def enrichment_write_back(spark: SparkSession, folder: str) -> DataFrame:
    """Results as a run would give them: images get text without a vector, tracks fail, others aren't touched."""
    cols = ["node_type", "text_content", "text_embedding", "clip_embedding", "audio_embedding", "metadata", "enriched_at", "enrichment_error"]
    rows = case_nodes(spark, folder, *cols).withColumnRenamed("node_id", "id")
    meta = rows.schema["metadata"].dataType
    failed = F.col("node_type") == "audio_track"
    new = F.struct(*[(F.lit(7) if f.name == "segment_index" else F.lit(None)).cast(f.dataType).alias(f.name) for f in meta.fields])
    results = rows.filter(F.col("node_type").isin("image", "audio_track")).select(
        F.col("id").alias("node_id"), F.when(~failed, F.concat(F.lit("image: "), "text_content")).alias("text_content"), *[F.lit(None).cast("array<float>").alias(c) for c in ("text_embedding", "clip_embedding", "audio_embedding")],
        F.when(~failed, new).alias("metadata"), F.when(failed, "model failed").alias("error"),
    )
    done = write_back(rows, results)
    return done.select(F.col("id").alias("node_id"), "text_content", F.col("text_embedding").isNotNull().alias("has_text_vector"), "enrichment_error", F.col("enriched_at").isNotNull().alias("enriched"), "metadata.segment_index", "metadata.duration_sec")


@query(
    "entity_counter_upsert",
    """WITH old AS (SELECT case_id, entity_type, lower(trim(canonical_name)) AS normalized_name, min(canonical_name) AS canonical_name, count(*) AS mention_count FROM (SELECT DISTINCT id, case_id, entity_type, canonical_name FROM entity) WHERE entity_type = 'person' GROUP BY 1, 2, 3),
    calls AS (SELECT case_id, entity_type, lower(trim(canonical_name)) AS normalized_name, canonical_name, id FROM (SELECT DISTINCT id, case_id, entity_type, canonical_name FROM entity) WHERE canonical_name IS NOT NULL), new AS (SELECT case_id, entity_type, normalized_name, count(*) AS n, arg_min(canonical_name, id) AS first FROM calls GROUP BY 1, 2, 3)
    SELECT coalesce(o.case_id, n.case_id) AS case_id, coalesce(o.entity_type, n.entity_type) AS entity_type, coalesce(o.normalized_name, n.normalized_name) AS normalized_name, coalesce(o.canonical_name, n.first) AS canonical_name, coalesce(mention_count, 0) + coalesce(n.n, 0) AS mention_count FROM old o FULL JOIN new n ON n.case_id = o.case_id AND n.entity_type = o.entity_type AND n.normalized_name = o.normalized_name""",
)
def entity_counter_upsert(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "entity").select("id", "case_id", "entity_type", "canonical_name").distinct().withColumn("normalized_name", F.lower(F.trim("canonical_name")))
    keys = ["case_id", "entity_type", "normalized_name"]
    old = once.filter("entity_type = 'person'").groupBy(*keys).agg(F.min("canonical_name").alias("canonical_name"), F.count(F.lit(1)).alias("mention_count"))
    return W.counted_upsert(old, once.filter("canonical_name is not null"), keys, ["id"], ["canonical_name"], "mention_count")


@query(
    "alignments_inserted",
    f"WITH {A_SQL}, old AS (SELECT a, b, kind FROM e WHERE kind IN ('SIMILAR_TO', 'ALIGNS_WITH')), new AS (SELECT DISTINCT a, b, 'SIMILAR_TO' AS kind FROM e) SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.a = new.a AND old.b = new.b AND old.kind = new.kind)",
)
def alignments_inserted(spark: SparkSession, folder: str) -> DataFrame:
    e = alignments(spark, folder)
    old = e.filter(F.col("kind").isin("SIMILAR_TO", "ALIGNS_WITH"))
    turned = e.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("SIMILAR_TO").alias("kind"))
    return W.insert_pairs(old, turned, "a", "b", ["a", "b", "kind"])


@query("unchanged_files", f"WITH {F_SQL}, {CN} SELECT f.id AS source_file_id, count(cn.id) AS total, count(cn.enriched_at) AS enriched FROM f JOIN cn ON cn.source_file_id = f.id GROUP BY f.id")
def unchanged_files(spark: SparkSession, folder: str) -> DataFrame:
    registered = case_files(spark, folder).select(F.col("source_file_id").alias("id"), F.lit(None).cast("string").alias("previous_hash"))
    kept = split_unchanged(registered, case_nodes(spark, folder, "enriched_at"))[1]
    return kept.select(F.col("id").alias("source_file_id"), "total", "enriched")
