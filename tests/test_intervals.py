import random

import pytest

from ledgerlens.operators.intervals import periods_and_gaps, run_bitmaps, stitch, to_units, union_bitmaps

SCHEMA = "source_file_id string, start_time double, end_time double"


def brute(rows):
    groups = {}
    for f, a, b in rows:
        if None in (f, a, b) or not b > a or abs(a) == float("inf") or abs(b) == float("inf"):
            continue
        x, y = round(a * 1000), round(b * 1000)
        if y > x:
            groups.setdefault(f, []).append((x, y))
    out = []
    for f, spans in groups.items():
        cur = None
        for x, y in sorted(spans):
            if cur and x <= cur[1]:
                cur[1] = max(cur[1], y)
            else:
                if cur:
                    out += [(f, "covered", *cur), (f, "gap", cur[1], x)]
                cur = [x, y]
        out.append((f, "covered", *cur))
    return sorted(out)


@pytest.mark.parametrize("shard", [4, 16, 1 << 20])
def test_against_brute_force(spark, shard):
    rng = random.Random(shard)
    rows = []
    for _ in range(900):
        a = rng.randint(-40, 400) / 1000
        rows.append((rng.choice("abcdefgh") + str(rng.randint(0, 9)), a, a + rng.choice([0, 1, 2, 3, 5, 8, 40, 100]) / 1000))
    got = sorted(tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA), shard_units=shard).collect())
    assert got == brute(rows)


def test_hot_entity_and_long_intervals(spark):
    rows = [("hot", i * 0.002, i * 0.002 + 0.001) for i in range(3000)] + [("long", 0.0, 1e7), ("long", 1e7 + 1, 1e7 + 2), ("long", 5.0, 1e7)]
    got = sorted(tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA), shard_units=64).collect())
    assert got == brute(rows)


def test_dirty_rows(spark):
    rows = [("a", None, 1.0), ("a", 1.0, None), (None, 0.0, 1.0), ("a", 2.0, 1.0), ("a", 1.0, 1.0), ("a", float("nan"), 2.0), ("a", 0.0, float("inf"))]
    rows += [("b", 0.1 + 0.2, 0.6), ("b", 0.6000000001, 0.9), ("b", 0.1 + 0.2, 0.6), ("c", 0.0001, 0.0002)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", s string, entity int")
    assert [tuple(r) for r in periods_and_gaps(df).collect()] == [("b", "covered", 300, 900)]
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA)).collect() == []


def test_union_of_bitmaps(spark):
    a, b = ([("f", 0.0, 0.01), ("f", 0.02, 0.03)], [("f", 0.01, 0.015), ("f", 0.1, 0.2)])
    maps = [run_bitmaps(to_units(spark.createDataFrame(x, SCHEMA), "source_file_id", "start_time", "end_time"))[0] for x in (a, b)]
    both, _ = union_bitmaps(*maps)
    assert [[tuple(r) for r in x.runs] for x in both.collect()] == [[(0, 15), (20, 30), (100, 200)]]


def test_stitched_runs_know_their_neighbours(spark):
    units = to_units(spark.createDataFrame([("f", 0.0, 0.003), ("f", 0.005, 0.02)], SCHEMA), "source_file_id", "start_time", "end_time")
    rows = sorted(tuple(r) for r in stitch(*run_bitmaps(units, 8)).collect())
    assert rows[0] == ("f", 0, 3, None, 5) and rows[-1][4] is None


def test_blocks_of_shards(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a = rng.randint(-100, 900) / 1000
        rows.append((rng.choice("ab"), a, a + rng.choice([1, 2, 3, 5, 30, 90]) / 1000))
    rows += [("full", 0.001, 0.7), ("full", 0.1, 0.9), ("full", 1.5, 1.6)]
    for shard, block in ((4, 1), (4, 3), (16, 2)):
        got = sorted(tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA), shard_units=shard, block_shards=block).collect())
        assert got == brute(rows)
