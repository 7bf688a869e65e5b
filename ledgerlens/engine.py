"""The engine as its users call it: cases, files, enrichment, graph, and every question that is asked of them.

Each method gives a frame (or an answer's text); nothing is collected but what is said to be a single row. Tables lie in a
Store. The same calls are the commands of ``python -m ledgerlens.cli``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.media import node_card, node_detail, spoken, thumbnail
from ledgerlens.operators import identity as I
from ledgerlens.operators import sync as S
from ledgerlens.operators.merge import upsert
from ledgerlens.plans import overview, pack, qa, reports
from ledgerlens.plans.build import Agents, Settings, build_graph
from ledgerlens.plans.enrich import enrich, run_record, to_enrich, write_back
from ledgerlens.plans.ingest import ingest
from ledgerlens.plans.pipeline import Status
from ledgerlens.plans.search import search, shown_hits
from ledgerlens.runtime import Scratch, ship
from ledgerlens.schema import LINKS, empty
from ledgerlens.sources.config import CaseConfig, declared_files
from ledgerlens.sources.media import media_type_of_mime, media_type_of_name, scan_case_folder
from ledgerlens.sources.models import Models, hashing_encoder
from ledgerlens.sources.processors import Registry, default_registry
from ledgerlens.sources.store import Store


def default_models() -> Models:
    return Models().register("text_encoder", hashing_encoder)


@dataclass
class Engine:
    spark: SparkSession
    folder: str
    models: Models = field(default_factory=default_models)
    processors: Registry = field(default_factory=default_registry)
    agents: Agents = field(default_factory=Agents)
    complete: Callable[[str], str | None] | None = None

    def __post_init__(self):
        ship(self.spark)
        self.store = Store(self.spark, self.folder)

    # --- cases and files

    def create_case(self, number: str, title: str | None = None, description: str | None = None, keep: bool = False) -> str:
        """The id of the case with that number; title and description are overwritten, or kept where the new ones are null."""
        row = self.spark.createDataFrame([(number, title, description)], "case_number string, title string, description string").select(I.stable_id("case", F.col("case_number")).alias("id"), "*", F.current_timestamp().alias("created_at"))
        old = self.store.read("cases")
        kept = row.join(old.select("id", F.col("created_at").alias("_old")), "id", "left").withColumn("created_at", F.coalesce("_old", "created_at")).drop("_old")
        self.store.write("cases", upsert(old, kept.select(*old.columns), ["id"], keep_old_on_null=keep))
        return self.case_id(number)

    def case_id(self, number: str) -> str:
        found = self.store.read("cases").filter(F.col("case_number") == number).select("id").first()
        if found is None:
            raise KeyError(f"no case {number}")
        return found.id

    def cases(self) -> DataFrame:
        """Every case with its counts, the newest first."""
        nodes = self.store.read("nodes").groupBy(F.col("source_file_id").alias("fid")).agg(F.count(F.lit(1)).alias("nodes"), F.count("enriched_at").alias("enriched"))
        files = self.store.read("files").select(F.col("id").alias("fid"), "case_id").join(nodes, "fid", "left").groupBy(F.col("case_id").alias("id")).agg(F.count(F.lit(1)).alias("files"), F.sum("nodes").alias("nodes"), F.sum("enriched").alias("enriched"))
        return reports.newest_first(self.store.read("cases").join(files, "id", "left").na.fill(0, ["files", "nodes", "enriched"]), "created_at", "id")

    def delete_case(self, case_id: str) -> None:
        """The case and all that hangs on it, table by table."""
        scratch = Scratch(self.spark)
        gone = {"cases": scratch.cut(self.store.read("cases").filter(F.col("id") == case_id), "gone")}
        kept = {"cases": self.store.read("cases").filter(F.col("id") != case_id)}
        for child, key, parent, parent_key in LINKS:
            rows = self.store.read(child)
            dead = gone[parent].select(F.col(parent_key).alias(key)).distinct()
            gone[child] = scratch.cut(rows.join(dead, key, "left_semi"), "gone")
            kept[child] = rows.join(dead, key, "left_anti")
        # All is read before anything is replaced.
        kept = {name: scratch.cut(df, "kept") for name, df in kept.items()}
        for name, df in kept.items():
            self.store.write(name, df)

    def ingest(self, config: CaseConfig, reprocess: bool = False) -> DataFrame:
        """Scan a case's folder, register and extract; the report of the files."""
        case = self.create_case(config.case_number, config.title, config.description)
        scanned = scan_case_folder(self.spark, config.case_folder, config.max_file_bytes, declared_files(self.spark, config) if config.files else None)
        scratch = Scratch(self.spark)
        got = ingest(scratch.cut(scanned, "scanned"), self.store.read("files"), self.store.read("nodes"), case, self.processors, reprocess)
        report = scratch.cut(got.report, "report")
        nodes, files = scratch.cut(got.nodes, "nodes"), scratch.cut(self._typed(got.files), "files")
        self.store.write("files", files)
        self.store.write("nodes", nodes)
        return report

    @staticmethod
    def _typed(files: DataFrame) -> DataFrame:
        return files.withColumn("file_type", F.coalesce("file_type", media_type_of_mime(F.col("detected_mime")), "declared_type", media_type_of_name(F.col("file_name"))))

    def verify(self, config: CaseConfig) -> DataFrame:
        """(relative_path, state): files as registered, changed, new or missing, by their hashes now."""
        case = self.case_id(config.case_number)
        now = scan_case_folder(self.spark, config.case_folder, config.max_file_bytes).select("relative_path", F.col("sha256").alias("now"))
        then = self.store.read("files").filter(F.col("case_id") == case).groupBy("relative_path").agg(F.max_by("sha256", "registered_at").alias("then"))
        state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("then"), "ok").otherwise("changed")
        return now.join(then, "relative_path", "full_outer").select("relative_path", state.alias("state"))

    def files(self, case_id: str) -> DataFrame:
        counts = self.store.read("nodes").groupBy(F.col("source_file_id").alias("id")).agg(F.count(F.lit(1)).alias("nodes"), F.count("enriched_at").alias("enriched"))
        own = self.store.read("files").filter(F.col("case_id") == case_id).join(counts, "id", "left").na.fill(0, ["nodes", "enriched"])
        return reports.newest_first(own, "registered_at", "id")

    # --- enrichment and graph

    def enrich(self, case_id: str, only_pending: bool = True, kinds: list[str] | None = None) -> DataFrame:
        """Run the models over a case's nodes; the coverage by type afterwards."""
        nodes = self.store.read("nodes")
        own = self.store.read("files").filter(F.col("case_id") == case_id).select(F.col("id").alias("source_file_id"))
        results = Scratch(self.spark).cut(enrich(to_enrich(nodes.join(own, "source_file_id", "left_semi"), only_pending, kinds), self.models), "results")
        self.store.write("nodes", Scratch(self.spark).cut(write_back(nodes, results), "nodes"))
        self.store.append("runs", run_record(nodes, case_id, self.models, {"only_pending": only_pending}))
        return self.coverage(case_id)

    def coverage(self, case_id: str) -> DataFrame:
        own = self._nodes(case_id)
        return own.groupBy("node_type").agg(F.count(F.lit(1)).alias("total"), *[F.count(c).alias(a) for a, c in (("enriched", "enriched_at"), ("with_text", "text_content"), ("with_text_vector", "text_embedding"), ("with_visual_vector", "clip_embedding"), ("with_audio_vector", "audio_embedding"), ("failed", "enrichment_error"))])

    def build(self, case_id: str | None = None, settings: Settings | None = None) -> list[Status]:
        """Build the graph of one case, or of all in one run; its tables replace what they were for those cases."""
        nodes = self._nodes(case_id)
        files = self._files(case_id).select("case_id", "source_file_id", "file_name", "registered_at")
        frames = {"nodes": nodes, "files": files}
        for name in ("faces", "voices"):
            rows = self._of(name, case_id)
            if not rows.isEmpty():
                frames[name] = rows.drop("face_cluster_id", "voice_cluster_id")
        made, report = build_graph(frames, settings, self.agents)
        tables = {"entities": "entities", "mentions": "mentions", "alignments": "alignments", "events": "events", "event_links": "event_links", "claim_edges": "edges", "identities": "identities", "identity_links": "identity_links", "offsets": "offsets", "clustered_faces": "faces", "clustered_voices": "voices"}
        scratch, own = Scratch(self.spark), nodes.select("node_id")
        for step, name in tables.items():
            if step not in made:
                continue
            old = self.store.read(name)
            if case_id is None:
                rest = old.limit(0)
            elif "case_id" in old.columns:
                rest = old.filter(F.col("case_id") != case_id)
            else:
                end = "node_a" if name == "edges" else "node_id"
                rest = old.join(own.withColumnRenamed("node_id", end), end, "left_anti")
            self.store.write(name, scratch.cut(rest.unionByName(made[step].select(*[c for c in old.columns if c in made[step].columns]), allowMissingColumns=True), name))
        if "case_times" in made or "claims" in made:
            stored = self.store.read("nodes")
            for step, column in (("case_times", "case_time"), ("claims", "claim")):
                if step in made:
                    stored = stored.join(made[step].select(F.col("node_id").alias("id"), F.col(column).alias("_new"), F.lit(True).alias("_there")), "id", "left")
                    stored = stored.withColumn(column, F.coalesce("_new", column))
                    if step == "claims":
                        stored = stored.withColumn("claim_extracted_at", F.when(F.col("_there"), F.current_timestamp()).otherwise(F.col("claim_extracted_at")))
                    stored = stored.drop("_new", "_there")
            self.store.write("nodes", scratch.cut(stored, "nodes"))
        return report

    # --- what is asked

    def _of(self, name: str, case_id: str | None) -> DataFrame:
        rows = self.store.read(name)
        return rows if case_id is None else rows.filter(F.col("case_id") == case_id)

    def _files(self, case_id: str | None) -> DataFrame:
        return self._of("files", case_id).withColumnRenamed("id", "source_file_id")

    def _nodes(self, case_id: str | None) -> DataFrame:
        own = self._files(case_id).select("source_file_id", "case_id")
        return self.store.read("nodes").join(own, "source_file_id").withColumnRenamed("id", "node_id")

    def _case(self, case_id: str) -> qa.Case:
        nodes = self._nodes(case_id)
        own = nodes.select("node_id")
        edges = self.store.read("edges").join(own.withColumnRenamed("node_id", "node_a"), "node_a", "left_semi")
        mentions = self.store.read("mentions").join(own, "node_id", "left_semi")
        return qa.Case(nodes, self._files(case_id), self._of("entities", case_id), mentions, edges, self._of("identities", case_id), self._of("identity_links", case_id))

    def _vector(self, feature: str, text: str) -> list[float] | None:
        own, _ = self.models.get(feature)
        return own(text) if own else None

    def search(self, words: str, mode: str = "hybrid", case_id: str | None = None, limit: int = 40) -> DataFrame:
        nodes = self._nodes(case_id)
        hits = search(nodes, words, self._vector("prompt_encoder", words), self._vector("text_encoder", words), mode, case_id, limit)
        return shown_hits(hits, nodes, self._files(case_id)).orderBy(F.desc("score"), "node_id")

    def ask(self, case_id: str, question: str) -> str:
        encoder, _ = self.models.get("text_encoder")
        return qa.ask(self.spark, self._case(case_id), question, encoder, self.complete)[1]

    def query_entity(self, case_id: str, name: str) -> DataFrame:
        c = self._case(case_id)
        return pack.entities_with_nodes(c.mentions, c.entities, name)

    def evidence_pack(self, case_id: str, entity: str | None = None, start: float | None = None, end: float | None = None, only_conflicts: bool = False) -> DataFrame:
        c = self._case(case_id)
        return pack.in_order(pack.evidence_pack(c.nodes, c.files, c.edges, c.mentions, c.entities, case_id, entity, start, end, only_conflicts))

    def node_edges(self, case_id: str, node_id: str) -> DataFrame:
        c = self._case(case_id)
        mentions, links = c.mentions.select("node_id", "entity_id", "confidence"), c.links.select("node_id", "identity_id", "confidence")
        return pack.node_edges(self._of("alignments", case_id), c.edges, mentions, links).filter(F.col("near") == node_id)

    def identities(self, case_id: str) -> DataFrame:
        return self._of("identities", case_id).orderBy(F.col("display_name").asc_nulls_last(), "identity_id")

    def query_identity(self, case_id: str, prefix: str) -> DataFrame:
        c = self._case(case_id)
        own = I.identity_by_prefix(c.identities, prefix).select("identity_id")
        return I.identity_evidence(c.links.join(own, "identity_id", "left_semi"), c.nodes.drop("case_id"), c.files).orderBy(*reports.pack_order(), "node_id")

    def timeline(self, case_id: str, limit: int = 500) -> DataFrame:
        """Nodes by the case's clock, or by their own where it isn't known."""
        rows = self._nodes(case_id).join(self._files(case_id).select("source_file_id", "file_name"), "source_file_id").withColumn("display_time", F.coalesce("case_time", "start_time")).filter("display_time is not null")
        m = F.col("metadata")
        shown = rows.select("node_id", "node_type", "file_name", "display_time", F.left("text_content", F.lit(100)).alias("snippet"), m["transcript"]["text"].alias("transcript"), m["caption"].alias("caption"), m["ocr"]["text"].alias("ocr"), m["audio_events"].alias("audio_events"), thumbnail(m, F.col("node_type"), F.col("file_path")).isNotNull().alias("has_thumbnail"))
        return shown.orderBy("display_time", "file_name", "node_id").limit(limit)

    def nodes(self, file_id: str) -> DataFrame:
        rows = self.store.read("nodes").filter(F.col("source_file_id") == file_id).orderBy(*reports.file_order(), "id")
        return rows.select(*node_card({c: F.col(c) for c in rows.columns}))

    def node(self, node_id: str) -> DataFrame:
        rows = self.store.read("nodes").filter(F.col("id") == node_id)
        return rows.select(*node_detail({c: F.col(c) for c in rows.columns}), "source_file_id").join(self._files(None).select("source_file_id", "file_name", "file_type", "case_id"), "source_file_id")

    def transcript(self, file_id: str) -> DataFrame:
        """(text, language, segments): the segments of a file's nodes, one for each start, in order; the first language that is said."""
        rows = self.store.read("nodes").filter(F.col("source_file_id") == file_id).select("id", "start_time", F.col("metadata.transcript").alias("t")).filter("t is not null")
        flat = rows.select("id", "start_time", F.explode("t.segments").alias("s")).filter("trim(s.text) <> ''")
        first = flat.groupBy("s.start").agg(F.min_by("s", F.struct(F.coalesce("start_time", F.lit(0.0)).alias("o"), "id")).alias("s"))
        made = first.agg(F.array_sort(F.collect_list("s")).alias("segments")).select(spoken(F.col("segments")).alias("text"), "segments")
        said = rows.agg(F.min_by("t.language", F.when(F.col("t.language") != "", F.struct(F.coalesce("start_time", F.lit(0.0)).alias("o"), "id"))).alias("language"))
        return made.crossJoin(F.broadcast(said))  # frames of one row

    def graph(self, case_id: str, most: int = 150) -> tuple[DataFrame, DataFrame]:
        c = self._case(case_id)
        events = self._of("events", case_id)
        links = self.store.read("event_links").join(events.select("event_id"), "event_id", "left_semi")
        top = overview.top_entities(c.entities, most)
        nodes = overview.graph_nodes(top, c.identities, c.nodes, c.files, events, overview.shown_nodes(c.edges, links))
        return nodes, overview.graph_edges(overview.co_occurrences(c.mentions, top), overview.bridges(c.links, c.mentions, top), c.edges, links)

    def sync_status(self, case_id: str) -> DataFrame:
        return S.sync_status(self._of("offsets", case_id), self._files(case_id))

    def summary(self) -> DataFrame:
        """A row for each case: the counts of its graph."""
        cases = self.store.read("cases").select(F.col("id").alias("case_id"))
        mentions = self.store.read("mentions").join(self.store.read("entities").select(F.col("id").alias("entity_id"), "case_id"), "entity_id")
        counted = {"entities": self.store.read("entities"), "mentions": mentions, "faces_detected": self.store.read("faces"), "timeline_events": self.store.read("events"), "voice_segments": self.store.read("voices"), "identities": self.store.read("identities"), "claims": self._nodes(None).filter("claim is not null")}
        clusters = {"face_clusters": ("faces", "face_cluster_id"), "voice_clusters": ("voices", "voice_cluster_id")}
        counted |= {k: self.store.read(t).filter(F.col(c).isNotNull()).select("case_id", c).distinct() for k, (t, c) in clusters.items()}
        drawn = self.store.read("edges").join(self._nodes(None).select(F.col("node_id").alias("node_a"), "case_id"), "node_a")
        return reports.graph_summary(cases, counted, {"alignments": (self.store.read("alignments"), "kind"), "relationships": (drawn, "relationship_type")})

    def stats(self) -> DataFrame:
        nodes = self.store.read("nodes").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.coalesce(F.col("clip_embedding"), F.col("text_embedding"))).alias("searchable"))
        one = lambda t, k: self.store.read(t).agg(F.count(F.lit(1)).alias(k))
        return one("cases", "cases").crossJoin(one("files", "files")).crossJoin(nodes)  # frames of one row

    def findings(self, case_id: str) -> DataFrame:
        return reports.findings_digest(self._nodes(case_id))

    def empty(self, name: str) -> DataFrame:
        return empty(self.spark, name)
