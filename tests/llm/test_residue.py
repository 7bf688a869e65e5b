import random

import numpy as np
import pytest

from ledgerlens.llm.linear import Rows, fit_logistic, sigmoid
from ledgerlens.llm.residue import exclude_residue, find_residue, fit_residue, score_residue, segments, weak_label

RESIDUE = [
    "Dear {{ first_name }}, thank you for the visit.", "Statement of [INSERT WITNESS] taken at noon.", "Signed by <<OFFICER>> in town.", "Due on ${date} at the desk.", "Lorem dolor velit irpus amedit.",
    "HTTP/1.1 502 Bad Gateway", "Error 404: Page not found", "Please enable JavaScript to view the file.", "Bitte aktivieren Sie JavaScript.", "Service unavailable, try again later.", "Sample text goes here", "Veuillez activer JavaScript pour continuer.",
]
CONTENT = [
    "The officer noted that the portal answered with \"access denied\" on Monday morning.", "The browser on the laptop displayed a 404 page when it was opened.", "[inaudible] She left the hall at noon.", "The name was [redacted] in the second copy.", "The night guard closed the north gate at six.",
    "A red van waited near the river for an hour.", "Two boxes were weighed and sealed by the clerk.", "The witness could not remember the colour of the coat.", "Der Zeuge sah am Abend einen blauen Wagen.", "On 4 May 404 units were delivered to the depot.",
]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [rng.choice(CONTENT).replace("noon", f"{rng.randint(1, 12)} o'clock") for _ in range(rng.randint(1, 6))]
        bad = rng.random() < 0.2
        if bad:
            lines.insert(rng.randint(0, len(lines)), rng.choice(RESIDUE))
        rows.append((i, "\n".join(lines), f"host{rng.randint(0, 30)}", bad))
    return rows


def test_weak_labels_and_segments():
    assert all(weak_label(s) == 1 for s in RESIDUE) and all(weak_label(s) != 1 for s in CONTENT)
    assert segments("One. Two!\nThree") == ["One.", "Two!", "Three"] and segments(" \n ") == []
    words = [f"w{i}" for i in range(205)]
    assert set(" ".join(segments(" ".join(words))).split()) == set(words)


def test_logistic_separates():
    rng = np.random.default_rng(1)
    index = np.concatenate([np.array([i % 2, 2 + rng.integers(0, 6)]) for i in range(200)])
    x = Rows(index, np.arange(0, 400, 2), np.zeros((200, 1)))
    y = np.arange(200) % 2
    assert ((sigmoid(x.dot(*fit_logistic(x, y.astype(float), np.ones(200), 8))) > 0.5) == y).all()


def test_unseen_documents(spark):
    schema = "doc_id long, text string, source string, bad boolean"
    model = fit_residue(spark.createDataFrame(corpus(600, 1), schema))
    assert model.validation["f1"] > 0.9
    fresh = corpus(300, 2)
    got = {r.doc_id: r.is_residue for r in score_residue(spark.createDataFrame(fresh, schema), model).collect()}
    wrong = [i for i, _, _, bad in fresh if got[i] != bad]
    assert len(wrong) <= 6


def test_dirty_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "  ", "b"), (None, RESIDUE[0], "a"), (4, RESIDUE[5], "a"), (4, CONTENT[4], "a")] + [(10 + i, t, s) for i, t, s, _ in corpus(200, 3)]
    df = spark.createDataFrame([(*r, 0.1, "x") for r in rows], "doc_id long, text string, source string, score double, evidence string")
    out = find_residue(df)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 204 and got[1].residue_score == 0 and got[3].evidence is None and got[4].is_residue
    kept = {r.doc_id for r in exclude_residue(df, out).collect()}
    assert {1, 2, 3, None} <= kept and 4 not in kept
    assert find_residue(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["x" * 200_000, "word " * 50_000, "{{" * 20_000, "«a " * 20_000])
def test_long_texts_end(text):
    assert all(weak_label(s) in (-1, 0, 1, 2) for s in segments(text)[:20])
