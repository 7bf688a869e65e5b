import json
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import labels as L
from ledgerlens.functions import media as M
from ledgerlens.operators import claims as C
from ledgerlens.operators import identity as I
from ledgerlens.operators import merge as W
from ledgerlens.operators import sync as S
from ledgerlens.operators.graph import average_linkage, density_clusters, linkage
from ledgerlens.operators.ordered import following, next_marked, running_max
from ledgerlens.operators.temporal import asof_forward, moments
from ledgerlens.operators.vectors import checked, cross_above, guarded, pairs_above
from ledgerlens.plans import detect as D
from ledgerlens.plans import reports as R
from ledgerlens.plans.build import Agents, Settings, build_graph
from ledgerlens.plans.enrich import default_analyzers, enrich, run_record, to_enrich, write_back
from ledgerlens.plans.ingest import ingest
from ledgerlens.plans.overview import of_categories
from ledgerlens.plans.search import search, search_terms, shown_hits, space_hits
from ledgerlens.sources.config import ConfigError, declared_files, external_path, jdbc_options, load_config, resolve_within, safe_url
from ledgerlens.sources.media import scan_case_folder
from ledgerlens.sources.models import LazyModel, Models, answers, dictionary_entities, embedding, hashing_encoder, word_judge
from ledgerlens.sources.processors import AudioProcessor, ImageProcessor, PdfProcessor, Registry, VideoProcessor, default_registry, extract, image_size, sampling_targets, segments_of, sniffed_mime, stream_duration, windows
from ledgerlens.sources.tables import with_columns_of

META = f"id string, node_type string, file_path string, metadata {M.METADATA}"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# --- order and vectors


def test_two_level_windows_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randint(0, 50), rng.choice([None, "x", "y"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, v int, m string").withColumn("b", F.floor(F.col("t") / 17))
    got = next_marked(following(running_max(df, ["k"], "b", [F.col("t")], "v", "top"), ["k"], "b", F.col("t"), "v", "nxt"), ["k"], "b", [F.col("t")], "m", "mark")
    for r in got.collect():
        own = [x for x in rows if x[0] == r.k]
        before, after = [x[2] for x in own if x[1] < r.t], [x for x in own if x[1] > r.t]
        assert r.top == (max(before) if before else None) and r.nxt == (after[0][2] if after else None)
        assert r.mark == next((x[3] for x in own if x[1] >= r.t and x[3]), None)


def test_moments_and_asof_over_blocks(spark):
    rng = random.Random(4)
    times = sorted(rng.uniform(0, 200) for _ in range(300))
    groups = []
    for t in times:
        if groups and t - groups[-1][0] <= 3:
            groups[-1][1] += 1
        else:
            groups.append([t, 1])
    df = spark.createDataFrame([("k", t) for t in times], "k string, t double")
    assert rows_of(moments(df, "k", "t", block=7.0)) == [("k", t, n) for t, n in groups]
    targets = spark.createDataFrame([("k", float(x)) for x in range(0, 240, 9)], "k string, t double")
    got = {r.t: r.found_at for r in asof_forward(targets, df.withColumn("v", F.col("t")), "k", "t", "v", block=11.0).collect()}
    assert got == {float(x): min(t for t in times if t >= x) for x in range(0, 240, 9) if x <= times[-1]}


def test_like_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((90, 6))
    keys = [i % 2 for i in range(90)]
    df = spark.createDataFrame([(k, i, v.tolist()) for i, (k, v) in enumerate(zip(keys, x))] + [(0, 91, [0.0] * 6), (1, 92, None), (None, 93, [1.0] * 6)], "k int, id int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((keys[i], i, j) for i in range(90) for j in range(i + 1, 90) if keys[i] == keys[j] and u[i] @ u[j] > 0.4)
    for chunk in (7, 1000):
        assert sorted((r.k, r.a, r.b) for r in pairs_above(df, "k", "id", "v", 0.4, chunk).collect()) == want
        met = cross_above(df.filter("id < 40"), df.filter("id >= 40"), "k", "id", "v", 0.4, chunk)
        assert sorted((r.k, r.a, r.b) for r in met.collect()) == [w for w in want if w[1] < 40 <= w[2]]
    assert checked(df, "v", 5).count() == 0 and pairs_above(df.limit(0), "k", "id", "v", 0.1).count() == 0
    with pytest.raises(ValueError):
        guarded(df, 3, "rows")


def test_linkage_equals_greedy_merging(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = [[i] for i in range(40)]
    while len(groups) > 1:
        best, a, b = min((np.mean([1 - u[i] @ u[j] for i in p for j in q]), i_, j_) for i_, p in enumerate(groups) for j_, q in enumerate(groups) if i_ < j_)
        if best >= 0.4:
            break
        groups[a] += groups.pop(b)
    want = sorted(sorted(g) for g in groups)
    label = linkage(u, 0.4)
    assert sorted(sorted(np.flatnonzero(label == k).tolist()) for k in set(label)) == want
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "s string, id int, v array<double>")
    got = {}
    for r in average_linkage(df, "s", "id", "v", 0.4).collect():
        got.setdefault(r.cluster, []).append(r.id)
    assert sorted(sorted(g) for g in got.values()) == want


def test_density_clusters_with_borders_and_noise(spark):
    turn = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    df = spark.createDataFrame([("s", i, turn(d)) for i, d in enumerate([0, 5, 10, 18, 90, 180, 182])], "s string, id int, v array<double>")
    eps = 1 - float(np.cos(np.radians(8.5)))
    assert {r.id: r.cluster for r in density_clusters(df, "s", "id", "v", eps, 2).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 5: 5, 6: 5}
    assert {r.id: r.cluster for r in density_clusters(df, "s", "id", "v", eps, 3).collect()} == {0: 1, 1: 1, 2: 1, 3: 1}
    assert 5 not in {r.id for r in density_clusters(df, "s", "id", "v", eps, 3).collect()}


# --- metadata and labels


def test_metadata(spark):
    meta = {"frames": [{"timestamp": 1.0, "path": None}, {"timestamp": 2.0, "path": "b.jpg"}, {"timestamp": 3.0, "path": "c.jpg"}], "representative_frame": None, "caption": "a  red\ncar", "detections": {"labels": {"knife": {"count": 2, "max_confidence": 0.9}, "dog": {"count": 1, "max_confidence": 0.5}}}, "ocr": {"text": " "}, "audio_events": [{"label": "bang", "probability": 0.456}], "transcript": {"text": "hello"}}
    df = spark.createDataFrame([("s", "scene_segment", "v.mp4", meta), ("i", "image", "i.png", None), ("t", "audio_track", "t.wav", {"audio_path": None}), ("p", "page", None, None)], META)
    m = F.col("metadata")
    got = {r.id: r for r in df.select("id", M.thumbnail(m, F.col("node_type"), F.col("file_path")).alias("thumb"), M.audio_path(m, F.col("node_type"), F.col("file_path")).alias("audio"), M.detection_labels(m).alias("labels"), M.detected_entities(m).alias("found"), M.findings(m).alias("lines"), M.frame_time(m["frames"], F.lit("c.jpg")).alias("at"), M.middle(m["frames"])["timestamp"].alias("mid")).collect()}
    assert [got[k].thumb for k in "sitp"] == ["b.jpg", "i.png", None, None] and got["t"].audio == "t.wav" and got["s"].at == 3.0 and got["s"].mid == 2.0
    assert got["s"].labels == ["dog", "knife"] and got["i"].labels == [] and [(e.name, e.kind) for e in got["s"].found] == [("knife", "weapon")]
    assert got["s"].lines == ["Described: “a red car”", "Objects detected: dog, knife", "Transcribed: “hello”", "Audio events: bang (0.46)"] and got["i"].lines == []
    full = df.withColumn("x", F.lit(1)).select(*[F.col(c) for c in df.columns], *[F.lit(None).cast(t).alias(c) for c, t in {"start_time": "double", "end_time": "double", "page_number": "int", "text_content": "string", "created_at": "timestamp", "enriched_at": "timestamp", "clip_embedding": "array<float>", "text_embedding": "array<float>"}.items()])
    detail = {r.id: r for r in full.select(*M.node_detail({c: F.col(c) for c in full.columns})).collect()}
    assert detail["s"].frame_count == 3 and detail["i"].frame_count == 0 and detail["s"].has_thumbnail and not detail["p"].has_thumbnail and not detail["s"].enriched
    assert spark.range(1).select(M.subsample(F.sequence(F.lit(0), F.lit(9)), 4).alias("s")).first().s == [0, 2, 5, 7]
    boxes = spark.createDataFrame([([("knife", 0.5), ("knife", 0.9), ("cup", 0.1)],), ([],)], "b array<struct<label:string,confidence:double>>").select(M.summarise_detections(F.col("b")).alias("s")).collect()
    assert boxes[0].s.labels["knife"]["count"] == 2 and boxes[0].s.labels["knife"].max_confidence == 0.9 and boxes[0].s.notable == ["knife"] and boxes[0].s.total == 3 and boxes[1].s.total == 0
    lines = spark.createDataFrame([([("a", 0.5), ("b", None), ("c", 0.8)],), ([("z", None)],)], "x array<struct<text:string,confidence:double>>").select(M.read_lines(F.col("x")).alias("r")).collect()
    assert tuple(lines[0].r) == ("a\nb\nc", 3, 0.65) and lines[1].r.mean_confidence is None
    said = spark.createDataFrame([([(0.0, 2.0, " hi "), (2.0, 4.0, " "), (4.0, 5.0, "you")],)], "s array<struct<start:double,end:double,text:string>>")
    assert said.select(M.spoken(F.col("s")).alias("t"), F.size(M.spoken_between(F.col("s"), F.lit(2.0), F.lit(4.0))).alias("n")).first() == ("hi you", 1)
    score = spark.createDataFrame([([[0.0, 0.0], [float(np.log(3.0)), 0.0]],), ([],)], "l array<array<double>>").select(M.violence(F.col("l"), 1).alias("v")).collect()
    assert score[0].v == pytest.approx((0.5 + 0.75) / 2) and score[1].v is None
    assert spark.range(1).select(M.page_zoom(F.lit(100.0), F.lit(100.0), 2.0, 10_000).alias("z")).first().z == 1.0
    assert spark.range(1).select(M.skipped_features({"a": F.lit("why"), "b": F.lit(None).cast("string")}).alias("s"), M.populated({"a": F.lit(1), "b": F.lit(None).cast("int")}).alias("p")).first() == ({"a": "why"}, ["a"])


def test_labels(spark):
    one = lambda *c: spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first()
    lit, none = F.lit, lambda t: F.lit(None).cast(t)
    assert tuple(one(L.size_label(lit(0)), L.size_label(lit(2048)), L.size_label(lit(3 << 20)), L.place(lit(65.9), none("int")), L.place(none("double"), lit(3)), L.place(none("double"), none("int")))) == ("—", "2 KB", "3.0 MB", "1:05", "p3", None)
    assert tuple(one(L.node_radius(lit(0)), L.node_radius(lit(100)), L.link_width(lit(4)), L.link_width(none("int")))) == (8.5, 22.0, 3.0, 2.0)
    assert tuple(one(L.method_label({"audio": lit(3), "visual": lit(0), "identity": lit(1)}), L.consistency(lit(2.0), lit(1.0), lit(1.0)), L.consistency(lit(9.0), lit(1.0), lit(0.1)), L.unquoted(lit('""a"')))) == ("audio(3), identity(1)", 0.5, 0.0, "a")
    note = L.integrity_note(lit("0123456789abcdef"), lit(True), none("string"), lit("x.JPG"), lit("application/pdf"))
    assert one(note).c0 == "content changed since last ingest (was 0123456789ab); extension claims 'JPG' but content is application/pdf"
    assert one(L.integrity_note(none("string"), lit(False), none("string"), lit("x"), none("string"))).c0 is None
    text = "Transcript: hi\nthere\n\nOn-screen text: \n\nDocument text: Visual description: no\nVisual description: yes"
    assert [tuple(s) for s in one(L.split_sections(lit(text))).c0] == [("Transcript", "hi\nthere"), ("Document text", "Visual description: no"), ("Visual description", "yes")]
    assert [tuple(s) for s in one(L.split_sections(lit(" plain "))).c0] == [("Extracted text", "plain")] and one(L.split_sections(lit(""))).c0 == []
    assert one(L.evidence_label(lit("page"), lit(2), lit(1.0), lit("a.pdf"))).c0 == "page at p2 in a.pdf" and one(L.evidence_label(lit("image"), none("int"), none("double"), lit("i"))).c0 == "image in i"


# --- writes


def test_writes(spark):
    old = spark.createDataFrame([("a", "b", "S", 0.1)], "a string, b string, kind string, score double")
    new = spark.createDataFrame([("b", "a", "S", 0.9), ("d", "c", "S", 0.5), ("c", "d", "S", 0.6), ("e", "e", "S", 1.0)], old.schema)
    got = W.insert_pairs(old, new, "a", "b", ["a", "b", "kind"]).collect()
    assert sorted((r.a, r.b) for r in got) == [("a", "b"), ("c", "d")] and next(r.score for r in got if r.a == "a") == 0.1
    have = spark.createDataFrame([("k", "First", 2)], "key string, name string, n long")
    calls = spark.createDataFrame([("k", 1, "Other"), ("k", 2, None), ("l", 2, "Late"), ("l", 1, None), ("l", 3, "Later")], "key string, at int, name string")
    assert rows_of(W.counted_upsert(have, calls, ["key"], ["at"], ["name"], "n")) == [("k", "First", 4), ("l", "Late", 3)]
    with pytest.raises(ValueError):
        with_columns_of(have, calls.schema)
    assert with_columns_of(spark.createDataFrame([(1,)], "at int"), calls.schema).first().name is None


# --- identities and clocks


def test_identities(spark):
    faces = spark.createDataFrame([("c", "f", f"n{i}", 5.0 * i, 5.0 * i + 5, "F1" if i < 4 else "F2") for i in range(8)] + [("c", "f", "n9", 0.0, 5.0, None)], "case_id string, source_file_id string, node_id string, start_time double, end_time double, face_cluster_id string")
    voices = spark.createDataFrame([("c", "f", 0.0, 20.0, "V1"), ("c", "f", 15.0, 40.0, "V2"), ("c", "g", 0.0, 99.0, "V3")], "case_id string, source_file_id string, start_time double, end_time double, voice_cluster_id string")
    pairs = {(r.face_cluster_id, r.voice_cluster_id): (r.shared, round(r.overlap, 4)) for r in I.overlap_pairs(faces, voices).collect()}
    assert pairs == {("F1", "V1"): (4, 1.0), ("F1", "V2"): (1, 0.125), ("F2", "V2"): (4, 0.8)}
    assert I.overlap_pairs(faces, voices, least=5).count() == 0
    nodes = spark.createDataFrame([("n0", "f", "scene_segment", 0.0, 5.0, "one"), ("n5", "f", "scene_segment", 25.0, 30.0, "two"), ("n6", "f", "page", 25.0, 30.0, "x"), ("m", "g", "audio_track", 0.0, 9.0, "far")], "node_id string, source_file_id string, node_type string, start_time double, end_time double, text_content string")
    cases = spark.createDataFrame([("f", "c"), ("g", "c")], "source_file_id string, case_id string")
    names = spark.createDataFrame([("V1", "Ann")], "voice_cluster_id string, display_name string")
    made, links = I.build_identities(faces, voices, nodes, cases, names)
    by = {r.face_cluster_id: r for r in made.collect()}
    assert {k: (r.voice_cluster_id, r.display_name, r.overlap_ratio) for k, r in by.items()} == {"F1": ("V1", "Ann", 1.0), "F2": ("V2", None, 0.8)}
    got = {(r.identity_id, r.node_id): r.via for r in links.collect()}
    assert got[(by["F1"].identity_id, "n0")] == "face" and got[(by["F2"].identity_id, "n5")] == "face" and len(got) == 8
    assert {r.voice_cluster_id: r.snippets for r in I.spoken_snippets(nodes, voices).collect()} == {"V1": ["one"], "V2": ["two", "x"], "V3": ["far"]}
    assert I.identity_by_prefix(made, by["F1"].identity_id[:6]).first().face_cluster_id == "F1" and I.identities_matching(made, "an").count() == 1
    assert all(r.kinds == ["face"] and not r.both for r in I.kinds_of_link(links).collect())
    cleared = I.clear_identities(faces, voices, spark.createDataFrame([("IDENTITY_LINK",), ("X",)], "relationship_type string"))
    assert cleared[0].filter("identity_id is not null").count() == 0 and [r[0] for r in cleared[2].collect()] == ["X"]


def test_clocks(spark):
    files = spark.createDataFrame([("c", "a", 1), ("c", "b", 2), ("c", "z", 3), ("d", "q", 1), ("d", "r", 2)], "case_id string, source_file_id string, registered_at int")
    pairs = S.source_pairs(files)
    assert rows_of(pairs) == [("c", "a", "b"), ("c", "a", "z"), ("d", "q", "r")]
    rows = spark.createDataFrame([("a", "a1", -7.0, [1.0, 0.0]), ("b", "b1", -4.5, [1.0, 0.01]), ("a", "a2", 10.0, [0.0, 1.0]), ("b", "b2", 12.4, [0.0, 1.0]), ("b", "b3", 13.4, [0.01, 1.0])], "source_file_id string, row_id string, start_time double, v array<double>")
    sound = {(r.time_a, r.time_b): r.cluster for r in S.audio_anchors(rows, pairs, "v").collect()}
    assert sound == {(-7.0, -4.5): -1, (10.0, 12.4): 2, (10.0, 13.4): 2}
    seen = {r.time_b: round(r.consistency, 4) for r in S.visual_anchors(rows, pairs, "v").collect()}
    # 2.5 rounds to the even 2, so it shares a bin with 2.4.
    assert seen == {-4.5: round(1 - 0.05 / 1.05, 4), 12.4: round(1 - 0.05 / 1.05, 4), 13.4: 1.0}
    seen_at = spark.createDataFrame([("q", "P", 1.0), ("q", "P", 9.0), ("q", "P", 20.0), ("r", "P", 3.0), ("r", "P", 11.5), ("r", "X", 0.0)], "source_file_id string, face_cluster_id string, start_time double")
    who = S.identity_anchors(seen_at, pairs)
    assert sorted((r.time_a, r.time_b) for r in who.collect()) == [(1.0, 3.0), (9.0, 11.5)]
    offsets = S.estimate_offsets([S.audio_anchors(rows, pairs, "v"), S.visual_anchors(rows, pairs, "v"), who])
    got = {(r.source_a, r.source_b): r for r in offsets.collect()}
    assert got[("a", "b")].offset_seconds == pytest.approx(2.5) and got[("a", "b")].method == "audio(3), visual(3)" and got[("a", "b")].confidence == 1.0 and len(got[("a", "b")].residuals_sec) == 6
    assert got[("q", "r")].offset_seconds == 2.25 and [r[0] for r in S.complete_cases(pairs, offsets).collect()] == ["d"]
    nodes = spark.createDataFrame([("n1", "c", "a", 1.0), ("n2", "d", "q", 1.0), ("n3", "d", "r", 5.0), ("n4", "d", "r", None)], "node_id string, case_id string, source_file_id string, start_time double")
    assert rows_of(S.case_times(nodes, pairs, offsets)) == [("n2", 1.0), ("n3", 7.25)] and rows_of(S.case_times(nodes, pairs, offsets, -1)) == [("n2", 1.0), ("n3", 2.75)]
    new = S.upsert_offsets(offsets, offsets.withColumn("offset_seconds", F.lit(0.0)))
    assert {r.offset_seconds for r in new.collect()} == {0.0} and new.count() == 2


# --- claims


def test_claims(spark):
    mentions = spark.createDataFrame([("e", f"n{i}") for i in range(4)] + [("g", "n0"), ("g", "n1")], "entity_id string, node_id string")
    linked = spark.createDataFrame([("n9", "n0", "REFERENCES"), ("n1", "n0", "ALIGNS_WITH"), ("n5", "n5", "ALIGNS_WITH")], "a string, b string, kind string")
    events = spark.createDataFrame([("v", "n0"), ("v", "n1"), ("v", "n9")], "event_id string, node_id string")
    pairs = {(r.node_a, r.node_b): r.origins for r in C.candidate_pairs(mentions, linked, events, cap=3).collect()}
    assert pairs == {("n0", "n1"): ["ALIGNS_WITH", "SAME_EVENT", "entity"], ("n0", "n2"): ["entity"], ("n1", "n2"): ["entity"], ("n0", "n9"): ["REFERENCES", "SAME_EVENT"], ("n1", "n9"): ["SAME_EVENT"]}
    claims = spark.createDataFrame([("n0", "the door was open", [1.0, 0.0]), ("n1", "the door was not open", [1.0, 0.1]), ("n2", "a cat sat", [0.0, 1.0]), ("n9", None, None)], "node_id string, claim string, text_embedding array<float>")
    kept = C.prefilter(C.candidate_pairs(mentions, linked, events, cap=3), claims)
    assert {(r.node_a, r.node_b): r.reason for r in kept.collect()} == {("n0", "n1"): None, ("n0", "n2"): "below_similarity", ("n1", "n2"): "below_similarity", ("n0", "n9"): "no_claim", ("n1", "n9"): "no_claim"}
    assert tuple(C.tally(kept).first()) == (5, 1, 2, 2)
    judge = word_judge()
    edges = C.judge_pairs(kept, lambda a, b: a.combine(b, judge))
    assert [(r.node_a, r.node_b, r.relationship_type, r.origins) for r in edges.collect()] == [("n0", "n1", "CONTRADICTS", ["ALIGNS_WITH", "SAME_EVENT", "entity"])]
    with pytest.raises(ValueError):
        C.judge_pairs(kept, lambda a, b: a, most=0)
    before = spark.createDataFrame([("x", "y", "CONTRADICTS"), ("x", "i", "IDENTITY_LINK")], "node_a string, node_b string, relationship_type string")
    assert sorted((r.node_a, r.relationship_type) for r in C.replace_claim_edges(before, edges).collect()) == [("n0", "CONTRADICTS"), ("x", "IDENTITY_LINK")]
    nodes = spark.createDataFrame([("n0", "Door open.", None, None), ("n1", "", None, None), ("n2", "hm", None, None)], "node_id string, text_content string, claim string, claim_extracted_at timestamp")
    got = C.extract_claims(nodes, lambda t: t.map(lambda x: "none" if x == "hm" else f" {x} "))
    stored = {r.node_id: (r.claim, r.claim_extracted_at is not None) for r in C.store_claims(nodes, got).collect()}
    assert stored == {"n0": ("Door open.", True), "n1": (None, False), "n2": (None, True)}


# --- sources, ingestion and enrichment


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\0" * 5


def wav(path, seconds):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(b"\0\0" * int(100 * seconds))


def test_processors(tmp_path):
    assert windows(65.0) == [(0.0, 30.0), (30.0, 60.0), (60.0, 65.0)] and windows(0) == [(0.0, 30.0)]
    assert segments_of(9.0, [(0.0, 4.0), (4.0, 9.0)]) == ([(0.0, 4.0), (4.0, 9.0)], "content") and segments_of(9.0, None)[1] == "fixed"
    assert stream_duration(None, 5) == 5.0 and stream_duration(3, 5) == 3.0 and stream_duration(0, None) == 0.0
    assert image_size(png(3, 4)) == (3, 4, "PNG") and image_size(b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -8)) == (7, 8, "BMP")
    assert image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 6) + b"\0" * 9) == (6, 5, "JPEG")
    (tmp_path / "a.png").write_bytes(png(10, 10))
    wav(tmp_path / "s.wav", 1.5)
    file = lambda n: {"file_path": str(tmp_path / n), "file_name": n, "sha256": "0"}
    assert ImageProcessor()(file("a.png"))[0]["metadata"]["width"] == 10
    with pytest.raises(Exception, match="pixels"):
        ImageProcessor(max_pixels=50)(file("a.png"))
    assert AudioProcessor()(file("s.wav"))[0]["end_time"] == 1.5
    video = VideoProcessor(probe=lambda p: (None, 65.0, 640, 480, "h264"), sample=lambda p, targets: [(i, t + 0.1, f"{i}-{t}.jpg") for i, t in targets], window=40.0)
    drafts = video(file("v.mp4"))
    assert [(d["start_time"], d["end_time"], len(d["metadata"]["frames"])) for d in drafts] == [(0.0, 40.0, 20), (40.0, 65.0, 13)]
    pages = PdfProcessor(open_pages=lambda p: [("x" * 9, 100.0, 100.0), (None, 1e5, 1e5)], max_chars=5)(file("d.pdf"))
    assert [(d["page_number"], d["text_content"], d["metadata"]["text_truncated"]) for d in pages] == [(1, "xxxxx", True), (2, "", False)] and pages[1]["metadata"]["render_zoom"] == 0.1
    with pytest.raises(Exception, match="pages"):
        PdfProcessor(open_pages=lambda p: [("", 1, 1)] * 3, max_pages=2)(file("d.pdf"))


def test_targets_and_types(spark):
    segments = spark.createDataFrame([("f", 0, 0.0, 5.0), ("f", 1, 5.0, 9.0), ("f", 2, 9.0, 9.0), ("g", 0, 1.0, 2.0)], "k string, segment_no int, start_time double, end_time double")
    assert rows_of(sampling_targets(segments, "k", 2.0)) == [("f", 0, 0.0), ("f", 0, 2.0), ("f", 0, 4.0), ("f", 1, 5.0), ("f", 1, 7.0), ("g", 0, 1.0)]
    assert rows_of(sampling_targets(segments, "k", 2.0, most=4)) == [("f", 0, 0.0), ("f", 0, 2.0), ("f", 0, 4.0), ("f", 1, 5.0), ("g", 0, 1.0)]
    heads = spark.createDataFrame([(b"%PDF-1",), (png(1, 1),), (b"RIFF0000WAVEfmt ",), (b"\0\0\0\x18ftypisom",), (b"hello",)], "h binary")
    assert [r[0] for r in heads.select(sniffed_mime(F.col("h"))).collect()] == ["application/pdf", "image/png", "audio/wav", "video/mp4", None]


def test_config(spark, tmp_path, monkeypatch):
    path = tmp_path / "case.json"
    path.write_text(json.dumps({"case_number": "1", "case_folder": str(tmp_path), "files": [{"path": "a/b.mp4", "type": "video", "officer": 7}]}))
    config = load_config(path)
    assert config.files[0].extra == {"officer": "7"} and declared_files(spark, config).first().declared_type == "video"
    for bad in ({"case_number": "1"}, {"case_number": "1", "case_folder": "x", "odd": 1}, {"case_number": "1", "case_folder": "x", "files": [{"path": "../x"}]}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ConfigError):
            load_config(path)
    assert resolve_within(tmp_path, "x") == (tmp_path / "x").resolve()
    for f, arg in ((lambda p: resolve_within(tmp_path, p), "../x"), (external_path, "-i")):
        with pytest.raises(ConfigError):
            f(arg)
    with pytest.raises(ConfigError):
        jdbc_options("jdbc:x", "me", "NO_SUCH_VARIABLE")
    monkeypatch.setenv("LEDGERLENS_DB_PASSWORD", "secret")
    assert "secret" not in safe_url(jdbc_options("jdbc:x", "me"))


def test_models(spark):
    tried = []

    def broken():
        tried.append(1)
        raise RuntimeError("no file")

    m = LazyModel("broken", broken)
    m.forget()
    assert not m.available and not m.available and "no file" in m.unavailable_reason and len(tried) == 1
    models = Models().register("text_encoder", hashing_encoder).register("broken", broken)
    assert models.get("absent") == (None, "no model for absent") and models.availability()["text_encoder"] == "ok"
    df = spark.createDataFrame([("a b",), (" ",), (None,)], "t string")
    got = [r.v for r in df.select(embedding(F.col("t"), LazyModel("enc", hashing_encoder), 384).alias("v")).collect()]
    assert len(got[0]) == 384 and got[1:] == [None, None]
    assert df.select(embedding(F.col("t"), LazyModel("enc", hashing_encoder), 5).alias("v")).first().v is None
    fussy = LazyModel("fussy", lambda: lambda t: 1 / 0)
    assert df.select(answers(F.col("t"), fussy).alias("v")).first().v is None


NODES = f"id string, source_file_id string, node_type string, start_time double, end_time double, page_number int, text_content string, file_path string, metadata {M.METADATA}, text_embedding array<float>, clip_embedding array<float>, audio_embedding array<float>, created_at timestamp, enriched_at timestamp, enrichment_error string"


def test_ingest_and_enrich(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(4, 4))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG")
    wav(tmp_path / "s.wav", 2)
    (tmp_path / "n.txt").write_text("notes")
    files = spark.createDataFrame([], "id string, case_id string, file_path string, file_name string, sha256 string, registered_at timestamp")
    nodes = spark.createDataFrame([], NODES)
    first = ingest(scan_case_folder(spark, str(tmp_path)), files, nodes, "c", default_registry())
    status = {r.file_name: (r.status, r.node_count) for r in first.report.collect()}
    assert status == {"a.png": ("ok", 1), "bad.png": ("failed", 0), "s.wav": ("ok", 1), "n.txt": ("skipped", 0)}
    assert {r.node_type for r in first.nodes.collect()} == {"image", "audio_track"} and first.files.count() == 4
    assert R.roll_up(first.report).first().files_by_status == {"failed": 1, "ok": 2, "skipped": 1}
    models = Models().register("text_encoder", hashing_encoder).register("image_encoder", lambda: lambda p: [1.0] * 512).register("captioner", lambda: lambda p: "a small square").register("asr", lambda: lambda p: 1 / 0)
    pending = to_enrich(first.nodes)
    results = enrich(pending, models)
    done = write_back(first.nodes, results)
    by = {r.node_type: r for r in done.collect()}
    assert by["image"].text_content == "Visual description: a small square" and len(by["image"].text_embedding) == 384 and by["image"].metadata.width == 4 and by["image"].metadata.enrichment_skipped["ocr"] == "no model for ocr"
    assert by["audio_track"].enriched_at is not None and "division" in by["audio_track"].metadata.enrichment_skipped["asr"]
    assert to_enrich(done).count() == 0 and run_record(done, "c", models, {"x": 1}).first().model_availability["asr"] == "ok"
    failing = enrich(pending, models, Registry().register("image", lambda n, m: 1 / 0))
    errors = {r.node_type: r.enrichment_error for r in write_back(first.nodes, failing).collect()}
    assert "division" in errors["image"] and errors["audio_track"] == "no analyzer for audio_track"
    again = ingest(scan_case_folder(spark, str(tmp_path)), first.files, done, "c", default_registry())
    assert {r.file_name: r.status for r in again.report.collect()} == {"a.png": "unchanged", "bad.png": "failed", "s.wav": "unchanged", "n.txt": "skipped"}
    assert again.files.count() == 4 and again.nodes.filter("enriched_at is not null").count() == 2
    (tmp_path / "a.png").write_bytes(png(5, 5))
    changed = ingest(scan_case_folder(spark, str(tmp_path)), again.files, again.nodes, "c", default_registry())
    note = {r.file_name: r for r in changed.report.collect()}["a.png"]
    assert note.status == "ok" and note.detail.startswith("content changed since last ingest (was ") and changed.files.count() == 5
    assert "page" in default_analyzers().items and extract(spark.createDataFrame([], "source_file_id string, file_path string, file_name string, media_type string, sha256 string"), default_registry()).count() == 0


# --- the graph of a case


def test_build_graph(spark):
    turn = lambda d, n: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))] + [0.0] * (n - 2)
    meta = {"transcript": {"text": "the knife"}, "detections": {"labels": {"knife": {"count": 1, "max_confidence": 0.9}, "tree": {"count": 1, "max_confidence": 0.9}}}}
    rows = [
        ("c", "n1", "f1", "scene_segment", 0.0, 20.0, None, "Jordan took the knife", meta, turn(0, 4), turn(0, 4), None),
        ("c", "n2", "f1", "audio_track", 5.0, 30.0, None, "Jordan never took the knife", None, turn(5, 4), None, turn(0, 4)),
        ("c", "n3", "f2", "scene_segment", 1.0, 9.0, None, None, None, None, turn(3, 4), None),
        ("c", "n4", "f3", "page", None, None, 1, "a page on the Knife", None, turn(90, 4), turn(10, 4), None),
    ]
    nodes = spark.createDataFrame(rows, f"case_id string, node_id string, source_file_id string, node_type string, start_time double, end_time double, page_number int, text_content string, metadata {M.METADATA}, text_embedding array<float>, clip_embedding array<float>, audio_embedding array<float>").withColumn("claim_extracted_at", F.lit(None).cast("timestamp"))
    files = spark.createDataFrame([("c", "f1", "a.mp4", 1), ("c", "f2", "b.mp4", 2)], "case_id string, source_file_id string, file_name string, registered_at int")
    faces = spark.createDataFrame([("c", "f1", "n1", f"d{i}", 5.0 * i, 5.0 * i + 5, turn(i, 4)) for i in range(4)], "case_id string, source_file_id string, node_id string, face_id string, start_time double, end_time double, embedding array<float>")
    voices = spark.createDataFrame([("c", "f1", "v1", 0.0, 10.0, turn(0, 4)), ("c", "f1", "v2", 10.0, 20.0, turn(4, 4))], "case_id string, source_file_id string, voice_id string, start_time double, end_time double, embedding array<float>")
    agents = Agents(entities=dictionary_entities({"Jordan": "person", "knife": "weapon"}), claims=lambda t: t, judge=word_judge(), names=lambda t: "Jordan" if "Jordan" in t else "none", prompts=lambda t: turn(1, 4))
    got, report = build_graph({"nodes": nodes, "files": files, "faces": faces, "voices": voices}, Settings(), agents)
    assert len(report) == 15 and {s.step for s in report} >= {"face_detection", "voice_diarization"} and [(s.step, s.detail) for s in report if s.state != "ok"] == []
    assert {(r.canonical_name, r.entity_type, r.mention_count, r.node_count) for r in got["entities"].collect()} == {("Jordan", "person", 2, 2), ("knife", "weapon", 4, 3)}
    assert {(r.a, r.b, r.kind) for r in got["alignments"].collect()} == {("n1", "n2", "ALIGNS_WITH"), ("n1", "n3", "SIMILAR_TO"), ("n1", "n4", "SIMILAR_TO"), ("n3", "n4", "SIMILAR_TO"), ("n4", "n1", "REFERENCES"), ("n4", "n3", "REFERENCES"), ("n1", "n3", "DESCRIBES")}
    assert [(r.event_id, r.members) for r in got["events"].collect()] == [("n1", 2)]
    assert [(r.node_a, r.node_b, r.relationship_type) for r in got["claim_edges"].collect()] == [("n1", "n2", "CONTRADICTS")]
    assert [r.display_name for r in got["identities"].collect()] == ["Jordan"] and {r.node_id for r in got["identity_links"].collect()} == {"n1", "n2"}
    assert [(r.source_a, r.source_b, r.method) for r in got["offsets"].collect()] == [("f1", "f2", "visual(1)")] and {r.node_id: r.case_time for r in got["case_times"].collect()} == {"n1": 0.0, "n2": 5.0, "n3": 2.0}
    bare, report = build_graph({"nodes": nodes, "files": files}, Settings(off=frozenset({"similarity"})))
    state = {s.step: (s.state, s.detail) for s in report}
    assert state["similarity"] == ("skipped", "disabled") and state["face_clustering"] == ("skipped", "needs faces") and state["claim_extraction"][0] == "skipped" and state["contradiction_detection"][0] == "skipped" and state["entities"][0] == "ok"


def test_search_modes(spark):
    nodes = spark.createDataFrame([("a", "c", "the gate was open", [1.0, 0.0], [1.0, 0.0]), ("b", "c", "nothing here", [0.9, 0.4], None), ("d", "e", "gate gate", None, [0.0, 1.0]), ("x", "c", None, [1.0], [0.0, 0.0])], "node_id string, case_id string, text_content string, text_embedding array<float>, clip_embedding array<float>")
    found = lambda *a, **k: {r.node_id: (round(r.score, 4), r.matched_on) for r in search(nodes, *a, **k).collect()}
    assert found("open gate", [1.0, 0.0], [1.0, 0.0]) == {"a": (1.0, ["keyword", "text", "visual"]), "b": (0.5026, ["text"]), "d": (0.275, ["keyword"])}
    assert found("open gate", None, [1.0, 0.0], "text", case_id="c") == {"a": (1.0, ["keyword", "text"]), "b": (0.9138, ["text"])}
    assert found("open gate", [1.0, 0.0], None, "visual") == {"a": (1.0, ["visual"])} and found("  ", [1.0, 0.0], None) == {}
    assert search_terms("Show me the PNR, the pnr of it!") == ["pnr"]
    with pytest.raises(ValueError):
        search(nodes, "x", None, None, "odd")
    with pytest.raises(ValueError):
        space_hits(nodes, "audio", [1.0], 5)
    more = nodes.select("node_id", F.lit("f").alias("source_file_id"), F.lit("page").alias("node_type"), *[F.lit(None).cast("double").alias(c) for c in ("start_time", "end_time")], F.lit(1).alias("page_number"), "text_content")
    files = spark.createDataFrame([("f", "f.pdf", "pdf", "c")], "source_file_id string, file_name string, file_type string, case_id string")
    assert shown_hits(search(nodes, "open gate", None, None), more, files).filter("node_id = 'a'").first().snippet == "the gate was open"


def test_reports(spark):
    nodes = spark.createDataFrame([("c", f"n{i}", i, {"caption": f"cap {i % 2}"}) for i in range(5)] + [("c", "n9", None, {"caption": "never"})], f"case_id string, node_id string, at int, metadata {M.METADATA}").withColumn("enriched_at", F.when(F.col("at").isNotNull(), F.timestamp_seconds("at")))
    assert R.findings_digest(nodes).first().findings == ["Described: “cap 0”", "Described: “cap 1”"]
    shown, edges = of_categories(spark.createDataFrame([("a", "person"), ("b", "person"), ("x", "event")], "id string, type string"), spark.createDataFrame([("a", "b"), ("a", "x")], "source string, target string").select("*", *[F.lit(None).alias(c) for c in ("type", "weight", "detail")]), ["person"])
    assert shown.count() == 2 and [(r.source, r.target) for r in edges.collect()] == [("a", "b")]
    ordered = nodes.withColumn("page_number", F.lit(None).cast("int")).withColumn("start_time", F.col("at").cast("double")).withColumn("created_at", F.col("enriched_at")).orderBy(*R.file_order())
    assert [r.node_id for r in ordered.collect()] == ["n0", "n1", "n2", "n3", "n4", "n9"]
    assert R.candidates(nodes.withColumn("node_type", F.lit("page")).withColumn("text_content", F.lit("")), ["page"], with_text=True).count() == 0


def test_faces_and_turns(spark, tmp_path):
    for n in ("a.jpg", "b.jpg", "s.wav"):
        (tmp_path / n).write_bytes(b"x")
    at = lambda n: str(tmp_path / n)
    rows = [
        ("c", "f", "n1", "scene_segment", 0.0, 5.0, None, {"frames": [{"timestamp": 1.0, "path": at("a.jpg")}, {"timestamp": 2.0, "path": at("gone.jpg")}], "audio_path": at("s.wav")}),
        ("c", "f", "n2", "scene_segment", 5.0, 9.0, None, {"frames": [], "audio_path": at("s.wav")}),
        ("c", "g", "n3", "image", None, None, at("b.jpg"), None),
    ]
    nodes = spark.createDataFrame(rows, f"case_id string, source_file_id string, node_id string, node_type string, start_time double, end_time double, file_path string, metadata {M.METADATA}")
    unit = [1.0] + [0.0] * 511
    detector = LazyModel("faces", lambda: lambda p: [((0, 0, 1, 1), 0.9, unit), ((1, 1, 2, 2), 0.2, unit), ((0, 0, 1, 1), 0.9, unit), ((3, 3, 4, 4), 0.8, [1.0])])
    faces = D.detect_faces(nodes, detector)
    assert sorted((r.node_id, r.frame_path) for r in faces.collect()) == [("n1", at("a.jpg")), ("n3", at("b.jpg"))]
    assert rows_of(faces.select("face_id")) == rows_of(D.detect_faces(nodes, detector).select("face_id"))
    assert [r.node_id for r in D.nodes_without_faces(nodes, faces).collect()] == ["n2"] and D.detect_faces(nodes, detector, D.nodes_without_faces(nodes, faces)).count() == 0
    assert D.detect_faces(nodes, LazyModel("broken faces", lambda: lambda p: 1 / 0)).count() == 0
    turns = D.diarize(nodes, LazyModel("turns", lambda: lambda p: [(0.0, 2.0, "A", [0.5] * 256), (2.0, 2.0, "B", [0.5] * 256)]))
    assert [(r.source_file_id, r.start_time, r.speaker_label) for r in turns.collect()] == [("f", 0.0, "A")]
    clustered = faces.withColumn("face_cluster_id", F.lit("k"))
    own = D.cluster_table(clustered, "face_cluster_id").first()
    assert own.members == 2 and own.representative_embedding[0] == pytest.approx(1.0)
