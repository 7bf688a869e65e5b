import hashlib
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import text as T
from ledgerlens.functions.vector import centroids, cosine
from ledgerlens.operators.graph import average_linkage, components, greedy_matching
from ledgerlens.operators.merge import cascade, insert_absent, keep_latest, replace_by_key, upsert
from ledgerlens.operators.temporal import asof_forward, band_join, fixed_windows, moments, overlap_join, windows_covered
from ledgerlens.plans.search import floor_and_gate, fold_keywords, hybrid, keyword_hits, over_fetch, vector_hits
from ledgerlens.runtime import Scratch, lookup_join
from ledgerlens.sources.media import media_type_of_mime, media_type_of_name, scan_case_folder
from ledgerlens.streaming.events import read_events, windowed


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, "Tell me everything about the red car please", T.subject) == "red car"
    assert one(spark, "what happened at 2:05", T.seconds_in) == 125 and one(spark, "around 90 seconds in", T.seconds_in) == 90.0 and one(spark, "no time", T.seconds_in) is None
    intents = {"Do they contradict each other?": "contradiction", "Who was present when the knife was shown?": "co_occurrence", "Who is this?": "identity", "What happened before the arrest?": "timeline", "red car": "entity", "what is the": "general"}
    assert {q: one(spark, q, T.intent) for q in intents} == intents
    assert one(spark, "what is the PNR number for YRKE2C the pnr", T.keywords) == ["pnr", "number", "yrke2c"]
    assert one(spark, "  Anna \n  HALE ", T.normalize_name) == "anna hale"
    assert one(spark, "a" * 300, T.snippet) == "a" * 239 + "…" and one(spark, " a  b ", T.snippet) == "a b"
    assert one(spark, None, T.snippet) is None and one(spark, " ", lambda c: T.fuse(text=c)) is None and one(spark, " a ", lambda c: T.fuse(text=c, ocr=c)) == "text: a\n\nocr: a"
    assert spark.range(1).select(T.timecode(F.lit(125.9)).alias("t")).first().t == "2:05"


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.0, 0.0])], "id int, k string, v array<float>")
    assert [r.c for r in df.orderBy("id").select(cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()] == [1.0, 0.0, 0.0]
    got = {r.k: r.centroid for r in centroids(df, "k", "v").collect()}
    assert got["a"] == pytest.approx([math.sqrt(0.5)] * 2) and got["b"] == [0.0, 0.0]


def test_overlaps_and_bands(spark):
    rows = [("f", "a", 0.0, 5.0), ("f", "b", 3.0, 200.0), ("f", "c", 5.0, 6.0), ("g", "d", 0.0, 9.0), ("f", "e", 4.0, None)]
    df = spark.createDataFrame(rows, "k string, id string, s double, e double")
    pairs = lambda touching: sorted((r.id, r.b_id) for r in overlap_join(df, df, "k", "s", "e", 2.0, touching).filter("id < b_id").collect())
    assert pairs(False) == [("a", "b"), ("b", "c")] and pairs(True) == [("a", "b"), ("a", "c"), ("b", "c")]
    times = spark.createDataFrame([("k", "a", 0.0), ("k", "b", 30.0), ("k", "c", 60.1), ("l", "d", 0.0)], "k string, id string, t double")
    assert [(r.id, r.b_id) for r in band_join(times, "k", "t", 30.0, "id").collect()] == [("a", "b")]


def test_windows(spark):
    targets = spark.createDataFrame([("f", 0.0), ("f", 2.0), ("f", 9.0)], "k string, t double")
    rows = spark.createDataFrame([("f", 2.0, "x"), ("f", 5.0, "y")], "k string, t double, v string")
    assert sorted(tuple(r) for r in asof_forward(targets, rows, "k", "t", "v").collect()) == [("f", 0.0, 2.0, "x"), ("f", 2.0, 2.0, "x")]
    lengths = spark.createDataFrame([("a", 65.0), ("b", 0.0)], "k string, d double")
    assert sorted((r.k, r.start_time, r.end_time) for r in fixed_windows(lengths, "k", "d", 30.0).collect()) == [("a", 0.0, 30.0), ("a", 30.0, 60.0), ("a", 60.0, 65.0), ("b", 0.0, 30.0)]
    spans = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.5, 3.0), ("a", 4.0, 4.0)], "k string, s double, e double")
    assert sorted(r.window_no for r in windows_covered(spans, ["k"], "s", "e", 1.0).collect()) == [0, 1, 2]
    times = spark.createDataFrame([("f", t) for t in (8.0, 0.0, 2.0, 3.0, 4.0, 6.5)], "k string, t double")
    assert sorted((r.moment_start, r.size) for r in moments(times, "k", "t").collect()) == [(0.0, 3), (4.0, 2), (8.0, 1)]


def test_merges(spark):
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, p string, q string"), spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id int, p string, q string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(upsert(old, new, ["id"])) == [(1, "a", "x"), (2, None, "z"), (3, "c", None)]
    assert rows(upsert(old, new, ["id"], keep_old_on_null=True)) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    assert rows(insert_absent(old, new, ["id"])) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    assert rows(replace_by_key(old, new, "id")) == [(1, "a", "x"), (2, None, "z"), (3, "c", None)]
    assert rows(keep_latest(old.union(new), ["id"], [F.desc_nulls_last("p")])) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
    tables = {"case": old.select("id"), "file": spark.createDataFrame([(10, 1), (11, 2)], "id int, case_id int"), "node": spark.createDataFrame([(20, 10), (21, 11)], "id int, file_id int")}
    left = cascade(tables, {"case": tables["case"].filter("id = 1")}, [("file", "case_id", "case"), ("node", "file_id", "file")])
    assert {k: [r.id for r in v.collect()] for k, v in left.items()} == {"case": [2], "file": [11], "node": [21]}


def test_graphs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(90, 91)], "a int, b int")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {r.node: r.component for r in components(edges, "a", "b", one_task=0).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 91: 90}
    v = spark.createDataFrame([("c", 1, [1.0, 0.0]), ("c", 2, [0.99, 0.01]), ("c", 3, [-1.0, 0.0])], "k string, id int, v array<double>")
    assert {r.id: r.cluster for r in average_linkage(v, "k", "id", "v", 0.2).collect()} == {1: 1, 2: 1, 3: 3}
    pairs = spark.createDataFrame([("s", "f1", "v1", 0.95), ("s", "f1", "v2", 0.70), ("s", "f2", "v2", 0.6)], "s string, f string, v string, w double")
    assert [(r.f, r.v) for r in greedy_matching(pairs, "s", "f", "v", "w", 0.6).collect()] == [("f1", "v1")]


def test_search(spark):
    nodes = spark.createDataFrame([("a", "PNR# YRKE2C", [0.0, 1.0]), ("b", "nothing here", [1.0, 0.0]), ("c", None, [0.9, 0.1])], "id string, t string, v array<double>")
    assert [tuple(r) for r in keyword_hits(nodes, "id", "t", ["pnr", "number"], 5).collect()] == [("a", 1, 0.5)]
    hits = vector_hits(nodes, "id", "v", [1.0, 0.0], 3)
    assert [r.id for r in floor_and_gate(hits, "text").orderBy("id").collect()] == ["b", "c"] and [r.id for r in floor_and_gate(hits, "visual", gate=0.999).collect()] == ["b"]
    both = {r.id: (round(r.score, 2), r.matched_on) for r in hybrid(hits.filter("id = 'b'"), hits.filter("id <> 'a'"), "id", 9).collect()}
    assert both["b"] == (1.0, ["text", "visual"]) and both["c"][1] == ["text"]
    assert {r.id for r in fold_keywords(hits.filter("id = 'b'"), keyword_hits(nodes, "id", "t", ["pnr"], 5), "id").collect()} == {"a", "b"}
    assert over_fetch(20) == 60 and over_fetch(500) == 200


def test_media(spark, tmp_path):
    kinds = spark.createDataFrame([("x.MP4", "video/mp4"), ("y.pdf", "application/octet-stream"), ("z.zip", "font/ttf"), ("n", None)], "n string, m string")
    got = [tuple(r) for r in kinds.select(media_type_of_name(F.col("n")), media_type_of_mime(F.col("m"))).collect()]
    assert got == [("video", "video"), ("pdf", "video"), (None, None), (None, None)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.xyz").write_bytes(b"?")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.mp4").write_bytes(b"x" * 100)
    (tmp_path / "d.txt").write_bytes(b"%PDF-1.7 text")
    outside = tmp_path.parent / f"{tmp_path.name}-outside"
    outside.mkdir()
    (outside / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "linked").symlink_to(outside)
    (tmp_path / "f.pdf").symlink_to(outside / "e.pdf")
    rows = scan_case_folder(spark, str(tmp_path), max_bytes=50).collect()
    got = {r.relative_path: (r.media_type, r.status, r.type_mismatch) for r in rows}
    # Files of no known type are left out, and so is what lies behind a linked folder.
    assert got == {"sub/a.pdf": ("pdf", "registered", False), "c.mp4": ("video", "skipped", False), "d.txt": ("pdf", "registered", True), "f.pdf": ("pdf", "skipped", False)}
    assert [r.relative_path for r in rows] == sorted(got) and all((r.sha256 is None) == (r.status == "skipped") for r in rows)
    assert rows[-1].sha256 == hashlib.sha256(b"%PDF").hexdigest()


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_lookup_join_with_a_hot_key(spark, hot_rows):
    left = Scratch(spark).cut(spark.createDataFrame([("hot", i) for i in range(90)] + [(f"k{i}", i) for i in range(9)], "k string, n int"))
    right = spark.createDataFrame([("hot", "H"), ("k1", "one")], "k string, v string")
    got = lookup_join(left, right, "k", "left", hot_rows=hot_rows).groupBy("v").count().collect()
    assert {r.v: r["count"] for r in got} == {"H": 90, "one": 1, None: 8}


def test_stream_equals_batch(spark, tmp_path, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    q = windowed(read_events(spark, folder, events.schema)).writeStream.outputMode("update").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        final = spark.sql("select hour_start, event_type, max(events) n from w group by 1, 2").agg(F.sum("n")).first()[0]
    finally:
        q.stop()
    assert final == events.select("event_id").distinct().count()
