import random

import pytest

from ledgerlens.llm.packing import pack, shortest_pack_first, slots
from ledgerlens.llm.tokens import encoding, read_vocabulary


def check_plan(histogram, capacity):
    patterns = shortest_pack_first(histogram, capacity)
    placed = {}
    for count, pattern in patterns:
        assert count > 0 and sum(n * k for n, k in pattern.items()) <= capacity
        for n, k in pattern.items():
            placed[n] = placed.get(n, 0) + count * k
    assert placed == histogram
    return sum(c for c, _ in patterns)


def test_plans():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([5, 30, 200])
        histogram = {n: rng.randint(1, 9**rng.randint(0, 6)) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        used = check_plan(histogram, capacity)
        assert used >= -(-sum(n * c for n, c in histogram.items()) // capacity)
    assert check_plan({1: 10**12}, 2048) == -(-(10**12) // 2048)
    assert shortest_pack_first({}, 10) == []
    with pytest.raises(ValueError):
        shortest_pack_first({11: 1}, 10)


def test_slots_cover_each_rank_once():
    histogram = {7: 40, 3: 100, 2: 31, 1: 500}
    seen = {}
    for length, _, lo, hi, first, each in set((r[0], 0, *r[2:]) for r in slots(shortest_pack_first(histogram, 10), histogram)):
        for rank in range(lo, hi):
            assert (length, rank) not in seen
            seen[length, rank] = first + (rank - lo) // each
    assert len(seen) == sum(histogram.values())


def test_every_document_whole(spark):
    rng = random.Random(5)
    texts = ["word " * rng.randint(1, 90) for _ in range(400)] + ["same text"] * 300 + ["long " * 1000, None, "", "  ", "𝛼" * 500, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "no id", 1, 2), (3, "again", 1, 2)], "doc_id long, text string, length int, rank int")
    out = pack(df, capacity=128).collect()
    enc = encoding(*read_vocabulary())
    fill, docs = {}, {}
    for r in out:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        docs.setdefault(r.doc_id, []).append(r)
    assert max(fill.values()) <= 128 and sorted(fill) == list(range(len(fill)))
    for i, t in enumerate(texts):
        own = sorted(docs[i], key=lambda r: r.piece_no) if i != 3 else []
        size = len(enc.encode_ordinary(t or ""))
        if i != 3:
            assert sum(r.n_tokens for r in own) == size and [r.piece_no for r in own] == list(range(1, max(1, -(-size // 128)) + 1))
            assert [r.token_start for r in own] == [128 * k for k in range(len(own))]
    assert len(docs[None]) == 1 and len(docs[3]) == 2
    total = sum(fill.values())
    assert len(fill) <= -(-total // 128) + 2
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, pack(df.repartition(7), capacity=128).collect()), key=str)
    assert pack(df.limit(0)).collect() == []
    assert [r.container_id for r in pack(df.filter("text is null")).collect()] == [0]
