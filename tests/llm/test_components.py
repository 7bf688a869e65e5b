import random

import pytest

from ledgerlens.llm.components import connected_groups

SCHEMA = "alignment_type string, node_a_id string, node_b_id string"


def brute(rows):
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for t, a, b in rows:
        if not (a or "").strip() or not (b or "").strip():
            continue
        t = (t or "").strip().upper()
        for x in ((t, a), (t, b)):
            parent.setdefault(x, x)
        x, y = find((t, a)), find((t, b))
        parent[max(x, y)] = min(x, y)
    return sorted((t, find((t, n))[1], n) for t, n in parent)


def result(spark, rows, **kw):
    return sorted(tuple(r) for r in connected_groups(spark.createDataFrame(rows, SCHEMA), **kw).collect())


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_chains_stars_and_noise(spark, hot_rows):
    rng = random.Random(4)
    rows = [("CHAIN", f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    rows += [(" hub", "z", f"h{i:03}") for i in range(90)] + [("HUB", "a", f"k{i:03}") for i in range(60)]
    rows += [(rng.choice(["R", " r ", "r"]), f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(110)]
    rng.shuffle(rows)
    assert result(spark, rows, hot_rows=hot_rows) == brute(rows)


def test_dirty_rows(spark):
    rows = [(None, "a", "b"), ("x", None, "b"), ("x", "a", None), ("x", "", "b"), ("x", "q", "q"), ("X ", "b", "a"), ("x", "a", "b"), ("x", "a", "b")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    extra = spark.createDataFrame([("x", "a", "b", 1, 2, 3)], SCHEMA + ", kind int, hi int, group_id int")
    assert sorted(tuple(r) for r in connected_groups(extra).collect()) == [("X", "a", "a"), ("X", "a", "b")]
