"""The registry of queries: each takes (spark, folder of tables) and gives a frame; each SQL says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import CLAUSE, CLOCK, MAX_TERMS, MIN_TERM, QUESTION_STOPWORDS, SEARCH_STOPWORDS, SECONDS, fuse, intent, keywords, match_count, normalize_name, seconds_in, snippet, subject
from ledgerlens.functions.vector import centroids, cosine
from ledgerlens.operators.graph import average_linkage, density_clusters, greedy_matching
from ledgerlens.operators.intervals import periods_and_gaps
from ledgerlens.operators.merge import cascade, keep_latest
from ledgerlens.operators.vectors import pairs_above
from ledgerlens.operators.temporal import asof_forward, band_join, fixed_windows, moments, overlap_join, windows_covered
from ledgerlens.plans.search import floor_and_gate, over_fetch, vector_hits
from ledgerlens.runtime import ship
from ledgerlens.sources.media import media_type_of_mime, media_type_of_name
from ledgerlens.sources.tables import table
from ledgerlens.streaming.events import windowed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where there is one."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "p6_found",
    """
    WITH iv AS (
      SELECT source_file_id, CAST(round(start_time * 1000) AS BIGINT) AS s, CAST(round(end_time * 1000) AS BIGINT) AS e
      FROM evidence_node WHERE source_file_id IS NOT NULL AND end_time > start_time
    ), seen AS (
      SELECT *, max(e) OVER (PARTITION BY source_file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM iv WHERE e > s
    ), runs AS (
      SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM seen
    ), periods AS (
      SELECT source_file_id, run, min(s) AS start_ms, max(e) AS end_ms FROM runs GROUP BY source_file_id, run
    )
    SELECT source_file_id, 'covered' AS period_kind, start_ms, end_ms FROM periods
    UNION ALL
    SELECT source_file_id, 'gap', prev_end, start_ms FROM (
      SELECT source_file_id, start_ms, lag(end_ms) OVER (PARTITION BY source_file_id ORDER BY start_ms) AS prev_end FROM periods
    ) WHERE prev_end IS NOT NULL
    """,
)
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return periods_and_gaps(table(spark, folder, "evidence_node"))


# --- reports -------------------------------------------------------------------------------------------------------


def files(spark: SparkSession, folder: str) -> DataFrame:
    """source_file with each id once: the earliest registration."""
    return keep_latest(table(spark, folder, "source_file"), ["id"], [F.col("registered_at")])


def nodes(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    """Columns of evidence_node, each id once: repeats carry the same content."""
    return table(spark, folder, "evidence_node").select("id", *cols).distinct()


F_SQL = "f AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY registered_at) AS rn FROM source_file) WHERE rn = 1)"


def n_sql(*cols: str) -> str:
    return f"n AS (SELECT DISTINCT id, {', '.join(cols)} FROM evidence_node)"


@query(
    "node_coverage_by_type",
    f"""WITH {F_SQL}, n AS (SELECT id, any_value(source_file_id) AS source_file_id, any_value(node_type) AS node_type, count(text_content) > 0 AS has_text, count(text_embedding) > 0 AS t, count(clip_embedding) > 0 AS c, count(audio_embedding) > 0 AS a, count(enriched_at) > 0 AS e, count(enrichment_error) > 0 AS x FROM evidence_node GROUP BY id)
    SELECT f.case_id, n.node_type, count(*) AS nodes, sum(has_text::INT)::BIGINT AS with_text, sum(t::INT)::BIGINT AS with_text_vector, sum(c::INT)::BIGINT AS with_visual_vector, sum(a::INT)::BIGINT AS with_audio_vector, sum(e::INT)::BIGINT AS enriched, sum(x::INT)::BIGINT AS failed, sum((NOT e)::INT)::BIGINT AS pending
    FROM n JOIN f ON f.id = n.source_file_id GROUP BY f.case_id, n.node_type""",
)
def node_coverage_by_type(spark: SparkSession, folder: str) -> DataFrame:
    flags = {"with_text": "text_content", "with_text_vector": "text_embedding", "with_visual_vector": "clip_embedding", "with_audio_vector": "audio_embedding", "enriched": "enriched_at", "failed": "enrichment_error"}
    # Only whether a vector is there leaves the scan, never the vector.
    seen = table(spark, folder, "evidence_node").select("id", "source_file_id", "node_type", *[F.col(c).isNotNull().cast("long").alias(k) for k, c in flags.items()])
    once = seen.groupBy("id").agg(F.min("source_file_id").alias("source_file_id"), F.min("node_type").alias("node_type"), *[F.max(k).alias(k) for k in flags])
    joined = once.join(files(spark, folder).select(F.col("id").alias("source_file_id"), "case_id"), "source_file_id")
    return joined.groupBy("case_id", "node_type").agg(F.count(F.lit(1)).alias("nodes"), *[F.sum(k).alias(k) for k in flags], F.sum(1 - F.col("enriched")).alias("pending"))


@query(
    "collection_counts",
    f"""WITH {F_SQL}, n AS (SELECT id, any_value(source_file_id) AS source_file_id, max(enriched_at) AS enriched_at FROM evidence_node GROUP BY id)
    SELECT c.id AS case_id, c.case_number, count(DISTINCT f.id) AS files, count(n.id) AS nodes, count(n.enriched_at) AS enriched FROM evidence_case c LEFT JOIN f ON f.case_id = c.id LEFT JOIN n ON n.source_file_id = f.id GROUP BY c.id, c.case_number""",
)
def collection_counts(spark: SparkSession, folder: str) -> DataFrame:
    # Nodes are counted by file before the join, so the fan-out never leaves the aggregation.
    once = table(spark, folder, "evidence_node").groupBy("id").agg(F.min("source_file_id").alias("file_id"), F.max("enriched_at").alias("enriched_at"))
    by_file = once.groupBy("file_id").agg(F.count(F.lit(1)).alias("nodes"), F.count("enriched_at").alias("enriched"))
    by_case = files(spark, folder).select(F.col("id").alias("file_id"), "case_id").join(by_file, "file_id", "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("files"), F.sum("nodes").alias("nodes"), F.sum("enriched").alias("enriched"))
    cases = table(spark, folder, "evidence_case").select(F.col("id").alias("case_id"), "case_number")
    return cases.join(by_case, "case_id", "left").select("case_id", "case_number", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "nodes", "enriched")])


@query(
    "file_counts",
    f"""WITH {F_SQL}, n AS (SELECT DISTINCT id, source_file_id, node_type FROM evidence_node)
    SELECT f.id AS source_file_id, f.file_name, f.file_type, count(n.id) AS nodes, count(DISTINCT n.node_type) AS node_types FROM f LEFT JOIN n ON n.source_file_id = f.id GROUP BY ALL""",
)
def file_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = nodes(spark, folder, "source_file_id", "node_type").groupBy("source_file_id").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("node_type").alias("node_types"))
    own = files(spark, folder).select(F.col("id").alias("source_file_id"), "file_name", "file_type")
    return own.join(counts, "source_file_id", "left").na.fill(0, ["nodes", "node_types"])


@query(
    "global_stats",
    """SELECT (SELECT count(*) FROM evidence_case) AS cases, (SELECT count(DISTINCT id) FROM source_file) AS files, (SELECT count(DISTINCT id) FROM evidence_node) AS nodes, (SELECT count(DISTINCT id) FROM entity) AS entities, (SELECT count(DISTINCT id) FROM mention) AS mentions, (SELECT count(DISTINCT id) FROM source_alignment) AS alignments""",
)
def global_stats(spark: SparkSession, folder: str) -> DataFrame:
    names = {"cases": "evidence_case", "files": "source_file", "nodes": "evidence_node", "entities": "entity", "mentions": "mention", "alignments": "source_alignment"}
    rows = [table(spark, folder, t).agg(F.countDistinct("id").alias(k)) for k, t in names.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(F.broadcast(r))  # frames of one row
    return out


@query("alignment_summary", "SELECT case_id, upper(trim(alignment_type)) AS alignment_type, count(DISTINCT id) AS alignments, round(sum(score), 3) AS total_score FROM (SELECT DISTINCT id, case_id, alignment_type, score FROM source_alignment) GROUP BY 1, 2")
def alignment_summary(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "source_alignment").select("id", "case_id", F.upper(F.trim("alignment_type")).alias("alignment_type"), "score").distinct()
    return once.groupBy("case_id", "alignment_type").agg(F.countDistinct("id").alias("alignments"), F.round(F.sum("score"), 3).alias("total_score"))


@query(
    "earliest_node_per_source",
    f"WITH {n_sql('source_file_id', 'node_type', 'start_time')} SELECT source_file_id, id AS node_id, node_type, start_time FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY start_time ASC NULLS LAST, id) AS rn FROM n) WHERE rn = 1",
)
def earliest_node_per_source(spark: SparkSession, folder: str) -> DataFrame:
    first = keep_latest(nodes(spark, folder, "source_file_id", "node_type", "start_time"), ["source_file_id"], [F.col("start_time").asc_nulls_last(), F.col("id")])
    return first.select("source_file_id", F.col("id").alias("node_id"), "node_type", "start_time")


@query(
    "source_upsert_keep_latest",
    "SELECT case_id, sha256, file_name, registered_at FROM (SELECT *, row_number() OVER (PARTITION BY case_id, sha256 ORDER BY registered_at DESC, id) AS rn FROM source_file) WHERE rn = 1",
)
def source_upsert_keep_latest(spark: SparkSession, folder: str) -> DataFrame:
    return keep_latest(table(spark, folder, "source_file"), ["case_id", "sha256"], [F.desc("registered_at"), F.col("id")]).select("case_id", "sha256", "file_name", "registered_at")


@query(
    "tamper_check",
    "SELECT case_id, file_path, sha256, previous_hash, coalesce(previous_hash <> sha256, false) AS changed FROM (SELECT *, lag(sha256) OVER (PARTITION BY case_id, file_path ORDER BY registered_at, id) AS previous_hash FROM source_file)",
)
def tamper_check(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("case_id", "file_path").orderBy("registered_at", "id")
    return table(spark, folder, "source_file").withColumn("previous_hash", F.lag("sha256").over(w)).select("case_id", "file_path", "sha256", "previous_hash", F.coalesce(F.col("previous_hash") != F.col("sha256"), F.lit(False)).alias("changed"))


@query("pending_text_nodes", "SELECT DISTINCT id AS node_id, source_file_id FROM evidence_node n WHERE text_content <> '' AND NOT EXISTS (SELECT 1 FROM mention m WHERE m.evidence_node_id = n.id)")
def pending_text_nodes(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "mention").select(F.col("evidence_node_id").alias("id"))
    return table(spark, folder, "evidence_node").filter("text_content <> ''").select("id", "source_file_id").distinct().join(seen, "id", "left_anti").withColumnRenamed("id", "node_id")


@query(
    "sources_with_both",
    "SELECT DISTINCT id AS source_file_id FROM source_file f WHERE EXISTS (SELECT 1 FROM evidence_node n WHERE n.source_file_id = f.id AND n.text_embedding IS NOT NULL) AND EXISTS (SELECT 1 FROM evidence_node n WHERE n.source_file_id = f.id AND n.clip_embedding IS NOT NULL)",
)
def sources_with_both(spark: SparkSession, folder: str) -> DataFrame:
    out = table(spark, folder, "source_file").select(F.col("id").alias("source_file_id")).distinct()
    for c in ("text_embedding", "clip_embedding"):
        out = out.join(table(spark, folder, "evidence_node").filter(F.col(c).isNotNull()).select("source_file_id"), "source_file_id", "left_semi")
    return out


@query(
    "type_resolution",
    """SELECT DISTINCT id AS source_file_id, coalesce(sniffed, declared_type, ext) AS media_type, coalesce(sniffed <> coalesce(declared_type, ext), false) AS mismatch FROM (
      SELECT *, CASE WHEN detected_mime IN ('application/pdf') THEN 'pdf' WHEN detected_mime = 'application/octet-stream' OR detected_mime LIKE 'video/%' THEN 'video' WHEN detected_mime LIKE 'audio/%' THEN 'audio' WHEN detected_mime LIKE 'image/%' THEN 'image' WHEN detected_mime LIKE 'text/%' THEN 'doc' END AS sniffed,
        CASE WHEN e IN ('mp4','mov','avi','mkv','webm','m4v') THEN 'video' WHEN e IN ('wav','mp3','m4a','flac','aac','ogg') THEN 'audio' WHEN e IN ('jpg','jpeg','png','bmp','tiff','tif','webp','heic') THEN 'image' WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('doc','docx','rtf','odt','txt') THEN 'doc' END AS ext
      FROM (SELECT *, lower(regexp_extract(file_name, '[.]([A-Za-z0-9]+)$', 1)) AS e FROM source_file))""",
)
def type_resolution(spark: SparkSession, folder: str) -> DataFrame:
    sniffed, ext = media_type_of_mime(F.col("detected_mime")), media_type_of_name(F.col("file_name"))
    rows = table(spark, folder, "source_file").withColumn("sniffed", sniffed).withColumn("ext", ext)
    return rows.select(F.col("id").alias("source_file_id"), F.coalesce("sniffed", "declared_type", "ext").alias("media_type"), F.coalesce(F.col("sniffed") != F.coalesce("declared_type", "ext"), F.lit(False)).alias("mismatch")).distinct()


@query(
    "file_status",
    f"""WITH {F_SQL}, n AS (SELECT id, any_value(source_file_id) AS s, max(enriched_at) AS e FROM evidence_node GROUP BY id), k AS (SELECT s, count(*) AS total, count(e) AS done FROM n GROUP BY s)
    SELECT f.id AS source_file_id, CASE WHEN coalesce(total, 0) = 0 THEN 'not extracted' WHEN done = 0 THEN 'not analysed' WHEN done < total THEN CAST(done AS VARCHAR) || '/' || CAST(total AS VARCHAR) ELSE 'searchable' END AS status FROM f LEFT JOIN k ON k.s = f.id""",
)
def file_status(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "evidence_node").groupBy("id").agg(F.min("source_file_id").alias("source_file_id"), F.max("enriched_at").alias("e"))
    counts = once.groupBy("source_file_id").agg(F.count(F.lit(1)).alias("total"), F.count("e").alias("done"))
    both = files(spark, folder).select(F.col("id").alias("source_file_id")).join(counts, "source_file_id", "left")
    status = F.when(F.coalesce("total", F.lit(0)) == 0, "not extracted").when(F.col("done") == 0, "not analysed").when(F.col("done") < F.col("total"), F.concat_ws("/", "done", "total")).otherwise("searchable")
    return both.select("source_file_id", status.alias("status"))


@query(
    "cascade_delete",
    """WITH gone AS (SELECT min(id) AS id FROM evidence_case), gf AS (SELECT DISTINCT id FROM source_file WHERE case_id IN (SELECT id FROM gone)), gn AS (SELECT DISTINCT id FROM evidence_node WHERE source_file_id IN (SELECT id FROM gf)), ge AS (SELECT DISTINCT id FROM entity WHERE case_id IN (SELECT id FROM gone))
    SELECT 'evidence_case' AS table_name, count(*) AS rows_left FROM evidence_case WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'source_file', count(*) FROM source_file WHERE id NOT IN (SELECT id FROM gf) UNION ALL SELECT 'evidence_node', count(*) FROM evidence_node WHERE id NOT IN (SELECT id FROM gn) UNION ALL SELECT 'entity', count(*) FROM entity WHERE id NOT IN (SELECT id FROM ge)
    UNION ALL SELECT 'mention', count(*) FROM mention WHERE id NOT IN (SELECT id FROM mention WHERE entity_id IN (SELECT id FROM ge) OR evidence_node_id IN (SELECT id FROM gn))""",
)
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"evidence_case": ["id"], "source_file": ["id", "case_id"], "evidence_node": ["id", "source_file_id"], "entity": ["id", "case_id"], "mention": ["id", "entity_id", "evidence_node_id"]}
    tables = {t: table(spark, folder, t).select(*c) for t, c in keys.items()}
    links = [("source_file", "case_id", "evidence_case"), ("evidence_node", "source_file_id", "source_file"), ("entity", "case_id", "evidence_case"), ("mention", "entity_id", "entity"), ("mention", "evidence_node_id", "evidence_node")]
    left = cascade(tables, {"evidence_case": tables["evidence_case"].agg(F.min("id").alias("id"))}, links)
    out = None
    for name, df in left.items():
        row = df.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("table_name"), "rows_left")
        out = row if out is None else out.unionByName(row)
    return out


# --- text ----------------------------------------------------------------------------------------------------------

SEARCH_TERMS = ["cracked", "phone", "turnstile"]


@query(
    "keyword_search",
    """WITH n AS (SELECT DISTINCT id, text_content FROM evidence_node), h AS (SELECT id, text_content, (contains(lower(text_content), 'cracked'))::INT + (contains(lower(text_content), 'phone'))::INT + (contains(lower(text_content), 'turnstile'))::INT AS matches FROM n)
    SELECT id AS node_id, matches, matches / 3.0::DOUBLE AS score FROM h WHERE matches > 0 ORDER BY matches DESC, length(text_content), id LIMIT 60""",
)
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    # Texts are scored where they lie; only ids and scores are made distinct.
    n = match_count(F.col("text_content"), SEARCH_TERMS)
    scored = table(spark, folder, "evidence_node").select("id", n.alias("matches"), F.length("text_content").alias("size")).filter("matches > 0").distinct()
    best = scored.orderBy(F.desc("matches"), "size", "id").limit(over_fetch(20))
    return best.select(F.col("id").alias("node_id"), "matches", (F.col("matches") / len(SEARCH_TERMS)).alias("score"))


@query(
    "snippets",
    r"""WITH s AS (SELECT DISTINCT id, trim(regexp_replace(text_content, '[ \t\n\r\f\v]+', ' ', 'g')) AS s FROM evidence_node WHERE text_content IS NOT NULL)
    SELECT id AS node_id, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(substring(s, 1, 239)) || '…' END AS snippet FROM s""",
)
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "evidence_node").filter("text_content is not null")
    return rows.select(F.col("id").alias("node_id"), snippet(F.col("text_content")).alias("snippet")).distinct()


@query(
    "normalize_dedup_entities",
    r"""WITH e AS (SELECT DISTINCT id, case_id, entity_type, canonical_name, min(created_at) OVER (PARTITION BY id) AS made FROM entity), k AS (SELECT *, lower(trim(regexp_replace(canonical_name, '[ \t\n\r\f\v]+', ' ', 'g'))) AS name_key FROM e)
    SELECT case_id, entity_type, name_key, count(*) AS rows_merged, arg_min(canonical_name, (made, id)) AS first_spelling FROM k GROUP BY 1, 2, 3""",
)
def normalize_dedup_entities(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "entity").groupBy("id", "case_id", "entity_type", "canonical_name").agg(F.min("created_at").alias("made"))
    keyed = once.withColumn("name_key", normalize_name(F.col("canonical_name")))
    return keyed.groupBy("case_id", "entity_type", "name_key").agg(F.count(F.lit(1)).alias("rows_merged"), F.min_by("canonical_name", F.struct("made", "id")).alias("first_spelling"))


@query(
    "question_intents",
    r"""SELECT item_id, CASE WHEN regexp_matches(question, '(?i)\b(contradict|disagree|conflict|corroborat|dispute)') THEN 'contradiction' WHEN regexp_matches(question, '(?i)\b(who (was|is|were)?\s*(present|there|with|near)|who else|co-?occur)') THEN 'co_occurrence' WHEN regexp_matches(question, '(?i)\b(who is|who''?s|identity of|which person)\b') THEN 'identity'
      WHEN regexp_matches(question, '(?i)\b(when did|what happened|timeline|before|after|around|during)\b|\b[0-9]{1,2}:[0-9]{2}\b') THEN 'timeline' ELSE 'entity' END AS intent FROM eval_item""",
)
def question_intents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_item").select("item_id", intent(F.col("question")).alias("intent"))


def words_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "question_keywords",
    rf"""WITH k AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9''-]*'), lambda x: lower(x)), lambda x: length(x) >= {MIN_TERM} AND NOT list_contains({words_sql(SEARCH_STOPWORDS)}, x)) AS w, question,
      regexp_extract_all(coalesce(nullif(regexp_extract(question, '(?i){CLAUSE}', 1), ''), question), '[A-Za-z][A-Za-z''-]*') AS s FROM eval_item)
    SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:{MAX_TERMS}], ' ') AS terms, nullif(array_to_string(list_filter(s, lambda x: NOT list_contains({words_sql(QUESTION_STOPWORDS)}, lower(x))), ' '), '') AS subject,
      CASE WHEN regexp_matches(question, '{CLOCK}') THEN regexp_extract(question, '{CLOCK}', 1)::DOUBLE * 60 + regexp_extract(question, '{CLOCK}', 2)::DOUBLE ELSE TRY_CAST(nullif(regexp_extract(question, '(?i){SECONDS}', 1), '') AS DOUBLE) END AS seconds FROM k""",
)
def question_keywords(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("question")
    return table(spark, folder, "eval_item").select("item_id", F.array_join(keywords(q), " ").alias("terms"), subject(q).alias("subject"), seconds_in(q).alias("seconds"))


@query(
    "fused_node_text",
    f"WITH {n_sql('node_type', 'text_content', 'file_path')} SELECT id AS node_id, nullif(concat_ws(chr(10) || chr(10), CASE WHEN trim(text_content) <> '' THEN 'text: ' || trim(text_content) END, CASE WHEN trim(file_path) <> '' THEN 'file: ' || trim(file_path) END), '') AS fused FROM n",
)
def fused_node_text(spark: SparkSession, folder: str) -> DataFrame:
    # Repeats of an id carry the same content, so any of them will do; no text is compared.
    once = table(spark, folder, "evidence_node").groupBy("id").agg(*[F.any_value(c, True).alias(c) for c in ("text_content", "file_path")])
    return once.select(F.col("id").alias("node_id"), fuse(text=F.col("text_content"), file=F.col("file_path")).alias("fused"))


# --- entities and the graph ----------------------------------------------------------------------------------------

M_SQL = "m AS (SELECT DISTINCT entity_id, evidence_node_id AS node_id FROM mention WHERE entity_id IS NOT NULL AND evidence_node_id IS NOT NULL)"


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "mention").select("entity_id", F.col("evidence_node_id").alias("node_id"))
    return rows.filter("entity_id is not null and node_id is not null").distinct()


@query("entity_groups", f"WITH {M_SQL} SELECT entity_id, count(*) AS nodes, string_agg(node_id, ',' ORDER BY node_id) AS node_ids FROM m GROUP BY entity_id HAVING count(*) >= 2")
def entity_groups(spark: SparkSession, folder: str) -> DataFrame:
    return mentions(spark, folder).groupBy("entity_id").agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.sort_array(F.collect_list("node_id")), ",").alias("node_ids")).filter("nodes >= 2")


@query("entity_time_bounds", f"WITH {M_SQL}, {n_sql('start_time', 'end_time')} SELECT entity_id, min(start_time) AS first_seen, max(end_time) AS last_seen FROM m JOIN n ON n.id = m.node_id GROUP BY entity_id")
def entity_time_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return mentions(spark, folder).join(nodes(spark, folder, "start_time", "end_time").withColumnRenamed("id", "node_id"), "node_id").groupBy("entity_id").agg(F.min("start_time").alias("first_seen"), F.max("end_time").alias("last_seen"))


@query("cooccurrence_pairs", f"WITH {M_SQL} SELECT a.entity_id AS entity_a, b.entity_id AS entity_b, count(*) AS weight, min(a.node_id) AS sample_node FROM m a JOIN m b ON a.node_id = b.node_id AND b.entity_id > a.entity_id GROUP BY 1, 2")
def cooccurrence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    m = mentions(spark, folder)
    a, b = m.withColumnRenamed("entity_id", "entity_a"), m.withColumnRenamed("entity_id", "entity_b")
    return a.join(b, "node_id").filter("entity_b > entity_a").groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).alias("weight"), F.min("node_id").alias("sample_node"))


A_SQL = "e AS (SELECT DISTINCT least(node_a_id, node_b_id) AS a, greatest(node_a_id, node_b_id) AS b, upper(trim(alignment_type)) AS kind FROM source_alignment WHERE node_a_id <> node_b_id)"


def alignments(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct alignments (a, b, kind) in canonical order, without loops."""
    rows = table(spark, folder, "source_alignment").filter("node_a_id <> node_b_id")
    return rows.select(F.least("node_a_id", "node_b_id").alias("a"), F.greatest("node_a_id", "node_b_id").alias("b"), F.upper(F.trim("alignment_type")).alias("kind")).distinct()


# --- time ----------------------------------------------------------------------------------------------------------

T_SQL = "n AS (SELECT DISTINCT id, source_file_id, node_type, start_time, end_time FROM evidence_node WHERE end_time >= start_time)"


def timed(spark: SparkSession, folder: str) -> DataFrame:
    return nodes(spark, folder, "source_file_id", "node_type", "start_time", "end_time").filter("end_time >= start_time")


@query(
    "aligns_with",
    f"WITH {T_SQL} SELECT a.id AS node_a, b.id AS node_b, round(least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time), 6) AS overlap_sec FROM n a JOIN n b ON a.source_file_id = b.source_file_id AND a.id < b.id AND a.node_type <> b.node_type WHERE least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time) >= 0",
)
def aligns_with(spark: SparkSession, folder: str) -> DataFrame:
    n = timed(spark, folder)
    pairs = overlap_join(n, n, "source_file_id", "start_time", "end_time", touching=True).filter("id < b_id and node_type <> b_node_type")
    return pairs.select(F.col("id").alias("node_a"), F.col("b_id").alias("node_b"), F.round("overlap_sec", 6).alias("overlap_sec"))


@query(
    "overlapping_nodes",
    f"WITH {T_SQL} SELECT a.id AS node_a, b.id AS node_b, round(least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time), 6) AS overlap_sec FROM n a JOIN n b ON a.source_file_id = b.source_file_id AND a.id < b.id WHERE a.start_time < b.end_time AND a.end_time > b.start_time AND least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time) > 0",
)
def overlapping_nodes(spark: SparkSession, folder: str) -> DataFrame:
    n = timed(spark, folder)
    return overlap_join(n, n, "source_file_id", "start_time", "end_time").filter("id < b_id").select(F.col("id").alias("node_a"), F.col("b_id").alias("node_b"), F.round("overlap_sec", 6).alias("overlap_sec"))


@query("band_join_pairs", f"WITH {T_SQL} SELECT a.id AS node_a, b.id AS node_b, round(abs(a.start_time - b.start_time), 6) AS apart FROM n a JOIN n b ON a.source_file_id = b.source_file_id AND a.id < b.id AND abs(a.start_time - b.start_time) <= 5")
def band_join_pairs(spark: SparkSession, folder: str) -> DataFrame:
    near = band_join(timed(spark, folder).select("source_file_id", "id", "start_time"), "source_file_id", "start_time", 5.0, "id")
    return near.select(F.col("id").alias("node_a"), F.col("b_id").alias("node_b"), F.round(F.abs(F.col("start_time") - F.col("b_start_time")), 6).alias("apart"))


@query(
    "asof_forward",
    f"""WITH {T_SQL}, d AS (SELECT source_file_id, max(end_time) AS until FROM n GROUP BY 1), t AS (SELECT source_file_id, unnest(range(0, CAST(floor(until / 60) AS BIGINT) + 1)) * 60.0::DOUBLE AS start_time FROM d),
    j AS (SELECT t.source_file_id, t.start_time, n.start_time AS found_at, n.id AS found, row_number() OVER (PARTITION BY t.source_file_id, t.start_time ORDER BY n.start_time, n.id) AS rn FROM t JOIN n ON n.source_file_id = t.source_file_id AND n.start_time >= t.start_time)
    SELECT source_file_id, start_time, found_at, found FROM j WHERE rn = 1""",
)
def asof_forward_query(spark: SparkSession, folder: str) -> DataFrame:
    n = timed(spark, folder)
    until = n.groupBy("source_file_id").agg(F.floor(F.max("end_time") / 60).alias("last"))
    targets = until.select("source_file_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("k")).select("source_file_id", (F.col("k") * 60.0).alias("start_time"))
    return asof_forward(targets, n.select("source_file_id", "start_time", "id"), "source_file_id", "start_time", "id")


@query(
    "fixed_windows",
    f"""WITH {F_SQL}, w AS (SELECT id AS source_file_id, duration_sec, unnest(range(0, CASE WHEN duration_sec > 0 THEN CAST(ceil(duration_sec / 30) AS BIGINT) ELSE 1 END)) AS window_no FROM f WHERE duration_sec IS NOT NULL)
    SELECT source_file_id, window_no::INT AS window_no, window_no * 30.0::DOUBLE AS start_time, CASE WHEN duration_sec > 0 THEN least(window_no * 30.0::DOUBLE + 30, duration_sec) ELSE window_no * 30.0::DOUBLE + 30 END AS end_time FROM w""",
)
def fixed_windows_query(spark: SparkSession, folder: str) -> DataFrame:
    own = files(spark, folder).filter("duration_sec is not null").select(F.col("id").alias("source_file_id"), "duration_sec")
    return fixed_windows(own, "source_file_id", "duration_sec", 30.0)


@query(
    "presence_jaccard",
    f"""WITH {T_SQL}, c AS (SELECT DISTINCT source_file_id, node_type, unnest(range(CAST(floor(start_time / 10) AS BIGINT), CAST(floor((end_time - 1e-9) / 10) AS BIGINT) + 1)) AS w FROM n WHERE end_time > start_time), s AS (SELECT source_file_id, node_type, count(*) AS k FROM c GROUP BY 1, 2)
    SELECT a.source_file_id, a.node_type AS type_a, b.node_type AS type_b, count(*) AS shared, round(count(*) / (any_value(x.k) + any_value(y.k) - count(*))::DOUBLE, 6) AS jaccard FROM c a JOIN c b ON a.source_file_id = b.source_file_id AND a.w = b.w AND a.node_type < b.node_type JOIN s x ON x.source_file_id = a.source_file_id AND x.node_type = a.node_type JOIN s y ON y.source_file_id = b.source_file_id AND y.node_type = b.node_type GROUP BY 1, 2, 3""",
)
def presence_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    c = windows_covered(timed(spark, folder), ["source_file_id", "node_type"], "start_time", "end_time", 10.0)
    size = c.groupBy("source_file_id", "node_type").agg(F.count(F.lit(1)).alias("k"))
    a, b = c.withColumnRenamed("node_type", "type_a"), c.withColumnRenamed("node_type", "type_b")
    shared = a.join(b, ["source_file_id", "window_no"]).filter("type_a < type_b").groupBy("source_file_id", "type_a", "type_b").agg(F.count(F.lit(1)).alias("shared"))
    for side in ("a", "b"):
        shared = shared.join(size.select("source_file_id", F.col("node_type").alias(f"type_{side}"), F.col("k").alias(f"k_{side}")), ["source_file_id", f"type_{side}"])
    return shared.select("source_file_id", "type_a", "type_b", "shared", F.round(F.col("shared") / (F.col("k_a") + F.col("k_b") - F.col("shared")), 6).alias("jaccard"))


@query(
    "unified_timeline",
    f"WITH {F_SQL}, {n_sql('source_file_id', 'node_type', 'start_time', 'case_time')} SELECT n.id AS node_id, f.file_name, n.node_type, coalesce(n.case_time, n.start_time) AS display_time FROM n JOIN f ON f.id = n.source_file_id WHERE coalesce(n.case_time, n.start_time) IS NOT NULL ORDER BY display_time, f.file_name, n.id LIMIT 500",
)
def unified_timeline(spark: SparkSession, folder: str) -> DataFrame:
    own = files(spark, folder).select(F.col("id").alias("source_file_id"), "file_name")
    shown = nodes(spark, folder, "source_file_id", "node_type", "start_time", "case_time").join(own, "source_file_id").withColumn("display_time", F.coalesce("case_time", "start_time"))
    return shown.filter("display_time is not null").select(F.col("id").alias("node_id"), "file_name", "node_type", "display_time").orderBy("display_time", "file_name", "node_id").limit(500)


@query(
    "stitched_transcripts",
    """WITH s AS (SELECT DISTINCT id, source_file_id, start_time, trim(text_content) AS t FROM evidence_node WHERE node_type = 'transcript_chunk' AND start_time IS NOT NULL AND trim(text_content) <> ''), k AS (SELECT *, row_number() OVER (PARTITION BY source_file_id, start_time ORDER BY id) AS rn FROM s)
    SELECT source_file_id, count(*) AS segments, string_agg(t, ' ' ORDER BY start_time) AS transcript FROM k WHERE rn = 1 GROUP BY source_file_id""",
)
def stitched_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "evidence_node").filter("node_type = 'transcript_chunk' and start_time is not null and trim(text_content) <> ''")
    once = keep_latest(rows.select("id", "source_file_id", "start_time", F.trim("text_content").alias("t")).distinct(), ["source_file_id", "start_time"], [F.col("id")])
    parts = F.sort_array(F.collect_list(F.struct("start_time", "t")))
    return once.groupBy("source_file_id").agg(F.count(F.lit(1)).alias("segments"), F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("transcript"))


@query(
    "moments",
    f"""WITH RECURSIVE {T_SQL}, d AS (SELECT DISTINCT source_file_id, start_time AS t FROM n), r AS (SELECT source_file_id, min(t) AS at FROM d GROUP BY 1 UNION ALL SELECT r.source_file_id, (SELECT min(d.t) FROM d WHERE d.source_file_id = r.source_file_id AND d.t - r.at > 3) FROM r WHERE r.at IS NOT NULL)
    SELECT r.source_file_id, r.at AS moment_start, (SELECT count(*) FROM n WHERE n.source_file_id = r.source_file_id AND n.start_time >= r.at AND n.start_time - r.at <= 3)::INT AS size FROM r WHERE r.at IS NOT NULL""",
)
def moments_query(spark: SparkSession, folder: str) -> DataFrame:
    return moments(timed(spark, folder), "source_file_id", "start_time")



# --- vectors: on the table of 64-dimensional vectors, whose label stands for the case ---------------------------------

SIMILAR, LINKED = 0.35, 0.40
#: The query vector is that of the smallest id.
Q_SQL = "q AS (SELECT embedding AS qe FROM embeddings ORDER BY vec_id LIMIT 1)"


def cos_sql(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", "embedding")


def first_vector(spark: SparkSession, folder: str) -> list[float]:
    return list(vectors(spark, folder).orderBy("vec_id").first().embedding)


@query("similar_to_edges", f"SELECT a.label, a.vec_id AS a, b.vec_id AS b, round({cos_sql('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {cos_sql('a.embedding', 'b.embedding')} > {SIMILAR}")
def similar_to_edges(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_above(vectors(spark, folder), "label", "vec_id", "embedding", SIMILAR).withColumn("score", F.round("score", 6))


@query("knn_search", f"WITH {Q_SQL} SELECT vec_id, round({cos_sql('embedding', 'qe')}, 6) AS score FROM embeddings, q ORDER BY {cos_sql('embedding', 'qe')} DESC, vec_id LIMIT 20")
def knn_search(spark: SparkSession, folder: str) -> DataFrame:
    return vector_hits(vectors(spark, folder), "vec_id", "embedding", first_vector(spark, folder), 20).withColumn("score", F.round("score", 6))


@query("floor_and_gate", f"WITH {Q_SQL}, h AS (SELECT vec_id, {cos_sql('embedding', 'qe')} AS s FROM embeddings, q WHERE vec_id <> (SELECT min(vec_id) FROM embeddings)), k AS (SELECT * FROM h WHERE s >= 0.25) SELECT vec_id, round(s, 6) AS score FROM k WHERE s >= (SELECT max(s) FROM k) * 0.6")
def floor_and_gate_query(spark: SparkSession, folder: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in first_vector(spark, folder)])
    v = vectors(spark, folder)
    hits = v.join(F.broadcast(v.agg(F.min("vec_id").alias("self"))), F.col("vec_id") != F.col("self")).select("vec_id", cosine(F.col("embedding"), q).alias("score"))
    return floor_and_gate(hits, "text").withColumn("score", F.round("score", 6))


@query(
    "label_centroids",
    """WITH p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) AS r(i) GROUP BY label, i), z AS (SELECT label, sqrt(sum(m * m)) AS size FROM p GROUP BY label)
    SELECT p.label, (i - 1)::INT AS at, round(m / size, 6) AS x FROM p JOIN z ON z.label = p.label""",
)
def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    flat = centroids(vectors(spark, folder), "label", "embedding").select("label", F.posexplode("centroid").alias("at", "x"))
    return flat.select("label", "at", F.round("x", 6).alias("x"))


@query(
    "density_clusters",
    f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {cos_sql('a.embedding', 'b.embedding')} > {LINKED}),
    r AS (SELECT DISTINCT a AS vec_id, a AS other FROM e UNION SELECT r.vec_id, e.b FROM r JOIN e ON e.a = r.other) SELECT vec_id, min(other) AS cluster_id FROM r GROUP BY vec_id""",
)
def density_clusters_query(spark: SparkSession, folder: str) -> DataFrame:
    # Cosines above LINKED are distances below the rest; no two lie exactly there.
    return density_clusters(vectors(spark, folder), "label", "vec_id", "embedding", 1 - LINKED).withColumnRenamed("cluster", "cluster_id")


@query("linkage_clusters")
def linkage_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return average_linkage(vectors(spark, folder), "label", "vec_id", "embedding", 0.75)


@query("greedy_matches")
def greedy_matches(spark: SparkSession, folder: str) -> DataFrame:
    return greedy_matching(presence_jaccard(spark, folder).select("source_file_id", "type_a", "type_b", "jaccard"), "source_file_id", "type_a", "type_b", "jaccard", 0.1)


# --- streams: an extension -----------------------------------------------------------------------------------------


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windowed(table(spark, folder, "events")).select("hour_start", "event_type", "events", F.round("total", 4).alias("total"))
