import json

import pytest

from ledgerlens import cli, schema
from ledgerlens.engine import Engine
from ledgerlens.plans.build import Agents
from ledgerlens.sources.config import CaseConfig, Declared
from ledgerlens.sources.models import Models, dictionary_entities, hashing_encoder, word_judge
from ledgerlens.sources.processors import Registry


@pytest.fixture
def engine(spark, tmp_path):
    # Inside, so that they travel to the workers by value.
    def segments(file):
        """A stand-in for a video: its file holds lines of start, end and text."""
        with open(file["file_path"]) as f:
            rows = [line.strip().split("|") for line in f if "|" in line]
        return [{"node_type": "scene_segment", "start_time": float(a), "end_time": float(b), "file_path": file["file_path"], "metadata": {"segment_index": i, "audio_path": file["file_path"], "frames": []}} for i, (a, b, _) in enumerate(rows)]

    def speech(path):
        with open(path) as f:
            return [{"start": float(a), "end": float(b), "text": t, "language": "en"} for a, b, t in (line.strip().split("|") for line in f if "|" in line)]

    case = tmp_path / "case"
    case.mkdir()
    (case / "one.mp4").write_text("0|20|Jordan took the knife\n20|40|the gate was open\n")
    (case / "two.mp4").write_text("5|25|Jordan never took the knife\n")
    (case / "note.txt").write_text("a note")
    models = Models().register("text_encoder", hashing_encoder).register("asr", lambda: speech)
    agents = Agents(entities=dictionary_entities({"Jordan": "person", "knife": "weapon"}), claims=lambda t: t.partition(": ")[2], judge=word_judge())
    e = Engine(spark, str(tmp_path / "tables"), models, Registry().register("video", segments), agents)
    e.config = CaseConfig("42", str(case), "Title", None, files=(Declared("note.txt", "doc"),))
    return e


def test_a_case_from_its_folder_to_an_answer(engine, tmp_path, capsys):
    report = {r.file_name: (r.status, r.node_count) for r in engine.ingest(engine.config).collect()}
    assert report == {"one.mp4": ("ok", 2), "two.mp4": ("ok", 1), "note.txt": ("skipped", 0)}
    case = engine.case_id("42")
    cover = {r.node_type: (r.total, r.enriched, r.with_text_vector, r.failed) for r in engine.enrich(case).collect()}
    assert cover == {"scene_segment": (3, 3, 3, 0)}
    states = {s.step: s.state for s in engine.build(case)}
    assert states["entities"] == states["timeline_events"] == states["contradiction_detection"] == "ok" and states["identity_fusion"] == "skipped"
    assert {r.canonical_name: r.node_count for r in engine.store.read("entities").collect()} == {"Jordan": 2, "knife": 2}
    said = engine.ask(case, "Do they contradict each other about the knife?")
    assert said.startswith("Disagreements found (1 item(s)):") and "CONTRADICTS between scene_segment in" in said
    assert engine.ask(case, "what happened at 0:30").count("\n- ") == 3
    hits = engine.search("open gate", "text").collect()
    assert hits[0].file_name == "one.mp4" and hits[0].snippet == "Transcript: the gate was open" and "keyword" in hits[0].matched_on
    pack = engine.evidence_pack(case, "jordan", only_conflicts=True).collect()
    assert [len(r.relations) for r in pack] == [1, 1] and pack[0].relations[0].other_node_id == pack[1].node_id
    assert {r.kind for r in engine.node_edges(case, pack[0].node_id).collect()} == {"CONTRADICTS", "MENTIONS"}
    nodes, edges = engine.graph(case)
    assert {r.type for r in nodes.collect()} == {"person", "weapon", "evidence", "event"} and {r.type for r in edges.collect()} == {"co_occurs_with", "contradicts", "belongs_to"}
    assert [r.display_time for r in engine.timeline(case).collect()] == [0.0, 5.0, 20.0]
    one = next(r.id for r in engine.files(case).collect() if r.file_name == "one.mp4")
    assert engine.transcript(one).first().text == "Jordan took the knife the gate was open" and [r.start_time for r in engine.nodes(one).collect()] == [0.0, 20.0]
    assert engine.node(pack[0].node_id).first().transcript.text == "Jordan took the knife"
    row = next(r for r in engine.summary().collect())
    assert (row.entities, row.mentions, row.timeline_events, row.claims, row.relationships) == (2, 4, 1, 3, {"CONTRADICTS": 1})
    assert tuple(engine.stats().first()) == (1, 3, 3, 3) and schema.bad_vectors(engine.store.read("nodes")).count() == 0
    # Again: nothing changes, and what was enriched stays.
    assert {r.file_name: r.status for r in engine.ingest(engine.config).collect()}["one.mp4"] == "unchanged" and engine.store.read("nodes").filter("enriched_at is null").count() == 0
    (tmp_path / "case" / "two.mp4").write_text("5|25|something else\n")
    assert {r.relative_path: r.state for r in engine.verify(engine.config).collect()} == {"one.mp4": "ok", "two.mp4": "changed", "note.txt": "ok"}
    # The commands.
    assert cli.main(["--tables", engine.folder, "--json", "query-entity", "42", "knife"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["canonical_name"] == "knife"
    assert cli.main(["--tables", engine.folder, "timeline", "no-such-case"]) == 1
    engine.delete_case(case)
    assert all(engine.store.read(t).isEmpty() for t in schema.TABLES)


def test_cases_are_upserted(engine):
    a = engine.create_case("7", "first", "text")
    assert engine.create_case("7", "second", None) == a
    assert [(r.title, r.description) for r in engine.cases().collect()] == [("second", None)]
    engine.create_case("7", None, "kept", keep=True)
    assert [(r.title, r.description) for r in engine.cases().collect()] == [("second", "kept")]
    with pytest.raises(KeyError):
        engine.case_id("8")
