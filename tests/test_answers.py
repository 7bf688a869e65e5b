import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import answers as A
from ledgerlens.plans.pipeline import Pipeline
from ledgerlens.plans.qa import Case, answer, ask, facts, general_facts, read_question
from ledgerlens.runtime import Scratch


def read(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_answers_of_models(spark):
    assert [tuple(e) for e in read(spark, 'Sure: {"entities": [{"name": " Knife ", "type": "Weapon"}, {"name": "", "type": "x"}, {"name": "Z", "type": "alien"}]} ok', A.entities)] == [("Knife", "weapon"), ("Z", "other")]
    assert read(spark, "no json", A.entities) is None and read(spark, None, A.entities) is None
    assert tuple(read(spark, '{"relation": "Contradicts", "confidence": 0.93}', A.verdict)) == ("contradicts", 0.93)
    assert tuple(read(spark, '{"relation": "corroborates", "confidence": "high"}', A.verdict)) == ("corroborates", 0.5)
    assert read(spark, '{"relation": "maybe"}', A.verdict) is None and read(spark, "{broken", A.verdict) is None
    assert read(spark, " The  door\nwas open ", A.claim) == "The door was open" and read(spark, "NONE.", A.claim) is None and read(spark, "null", A.claim) == "null" and read(spark, " ", A.claim) is None
    assert read(spark, '"Jordan Hale"', A.display_name) == "Jordan Hale" and read(spark, "one two three four five six", A.display_name) is None


@pytest.fixture
def case(spark):
    nodes = spark.createDataFrame(
        [("n1", "f1", "scene_segment", 10.0, 20.0, None, "a red car at the gate", None, [1.0, 0.0]), ("n2", "f1", "scene_segment", 100.0, 110.0, None, "the knife lay there", "a knife", [0.0, 1.0]), ("n3", "f2", "page", None, None, 4, None, None, None)],
        "node_id string, source_file_id string, node_type string, start_time double, end_time double, page_number int, text_content string, claim string, text_embedding array<float>",
    )
    files = spark.createDataFrame([("f1", "c", "a.mp4"), ("f2", "c", "b.pdf")], "source_file_id string, case_id string, file_name string")
    entities = spark.createDataFrame([("e1", "vehicle", "Red Car", "red car"), ("e2", "weapon", "Knife", "knife"), ("e3", "person", "Jordan", "jordan")], "id string, entity_type string, canonical_name string, normalized_name string")
    mentions = spark.createDataFrame([("e1", "n1"), ("e2", "n2"), ("e3", "n2")], "entity_id string, node_id string")
    edges = spark.createDataFrame([("n1", "n2", "CONTRADICTS", 0.9, "one says car, one knife"), ("n1", "n3", "CORROBORATES", None, "both name the gate")], "node_a string, node_b string, relationship_type string, confidence double, explanation string")
    identities = spark.createDataFrame([("i1", "Jordan Hale")], "identity_id string, display_name string")
    links = spark.createDataFrame([("i1", "n2", "face"), ("i1", "n3", "voice")], "identity_id string, node_id string, via string")
    return Case(nodes, files, entities, mentions, edges, identities, links)


@pytest.mark.parametrize(
    "question, kind, found",
    [
        ("Tell me everything about the red car please", "entity", [("scene_segment at 10.0-20.0s in a.mp4", "a red car at the gate", "n1")]),
        ("what happened at 1:30", "timeline", [("scene_segment at 100.0s in a.mp4", "the knife lay there", "n2")]),
        ("what happened before 0:50", "timeline", [("scene_segment at 10.0s in a.mp4", "a red car at the gate", "n1")]),
        ("Who was present with the knife?", "co_occurrence", [("Jordan (person)", "co-mentioned in 1 shared node(s)", "n2"), ("Jordan Hale", "linked to this evidence via face", None)]),
        ("Who is Jordan?", "identity", [("Jordan Hale: scene_segment at 100.0s in a.mp4 (via face)", "the knife lay there", "n2"), ("Jordan Hale: page in b.pdf (via voice)", "", "n3")]),
        ("Do they contradict each other about the car?", "contradiction", [("CONTRADICTS between scene_segment in a.mp4 and scene_segment in a.mp4", "one says car, one knife", "n1"), ("CORROBORATES between scene_segment in a.mp4 and page in b.pdf", "both name the gate", "n1")]),
        ("gate", "entity", [("scene_segment at 10.0-20.0s in a.mp4", "a red car at the gate", "n1")]),
        ("submarine", "entity", []),
    ],
)
def test_questions(spark, case, question, kind, found):
    q = read_question(spark, question)
    got = facts(case, q)
    assert q.kind == kind and [(r.label, r.detail, r.node_id) for r in got.orderBy("rank").collect()] == found
    said = answer(q.kind, got)
    assert said.startswith("No evidence") == (not found) and said.count("\n- ") == len(found)


def test_general_answers(spark, case):
    q = read_question(spark, "the gate")
    got = general_facts(case, q, [0.0, 1.0])
    assert [r.node_id for r in got.orderBy("rank").collect()] == ["n1", "n2"]
    assert ask(spark, case, "  ") == ("general", "Ask a question about the case.")
    assert ask(spark, case, "gate", complete=lambda p: " A gate. ")[1] == "A gate." and "gate" in ask(spark, case, "gate", complete=lambda p: "")[1]


def test_a_failing_step_stands_alone(spark):
    scratch = Scratch(spark)
    broken = lambda f: f["a"].select(F.raise_error(F.lit("bad row")).alias("x"))
    p = Pipeline().step("a", [], lambda f: spark.range(3)).step("b", ["a"], broken).step("c", ["b"], lambda f: f["b"]).step("d", ["a"], lambda f: f["a"].filter("id > 0"))
    frames, report = p.run({}, scratch.cut)
    assert [(s.step, s.state) for s in report] == [("a", "ok"), ("b", "failed"), ("c", "skipped"), ("d", "ok")]
    assert frames["d"].count() == 2 and "bad row" in report[1].detail
