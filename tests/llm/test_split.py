import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm.split import spans, split_oversized


def check(text, limit, overlap):
    parts = spans(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= limit for a, b in parts)
    last, back = 0, ""
    for a, b in parts:
        back += text[last:b]
        last = b
    assert back == text
    return parts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,é́👍\U0001f3fd", min_size=1, max_size=700), st.integers(20, 90), st.integers(0, 9))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_least_count_and_natural_cuts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(6000)]
    text = " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))
    parts = check(text, 4000, 200)
    assert len(parts) <= 2 + -(-(len(text) - 4000) // 3800)
    assert all(text[b - 1] == " " and text[b - 2] == "." for _, b in parts[:-1])
    sizes = [b - a for a, b in parts]
    assert max(sizes) - min(sizes) < 900


def test_unbroken_run_and_exact_sizes():
    sizes = [b - a for a, b in check("x" * 8001, 4000, 200)]
    assert len(sizes) == 3 and max(sizes) - min(sizes) <= 2
    assert spans("x" * 4000) == [(0, 4000)] and len(spans("x" * 4001)) == 2 and spans("") == []
    assert len(check("x" * 7800, 4000, 200)) == 2
    check("é" * 5000, 4000, 200)
    with pytest.raises(ValueError):
        spans("x" * 100, 10, 5)


def test_operator(spark):
    rows = [("a", "w " * 3000), ("a", "w " * 3000), ("b", "𝛼" * 4001), ("c", "𝛼" * 4000), ("d", None), ("e", ""), (None, "z" * 9000)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "id string, text_content string, text string, piece_no int")
    out = split_oversized(df).collect()
    assert sorted((r.id, r.piece_no, r.n_pieces) for r in out) == [("a", 1, 2), ("a", 2, 2), ("b", 1, 2), ("b", 2, 2)]
    for key, text in (("a", "w " * 3000), ("b", "𝛼" * 4001)):
        assert "".join(r.piece[r.overlap_chars :] for r in sorted((r for r in out if r.id == key), key=lambda r: r.piece_no)) == text
    assert split_oversized(df.limit(0)).collect() == []
