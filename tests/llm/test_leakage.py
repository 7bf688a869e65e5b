import random

import numpy as np

from ledgerlens.llm.leakage import Index, find_leaks, words

VOCABULARY = [a + b for a in ("tim", "rov", "sel", "kan", "dor", "wix", "pel", "gra") for b in ("ber", "tle", "mon", "ask", "ury", "ock")]


def passage(rng, n):
    return " ".join(rng.choice(VOCABULARY) if i % 4 else "the" for i in range(n))


def noisy(rng, text):
    """Other case, quote signs, line breaks, and a changed or missing word now and then."""
    out = []
    for i, w in enumerate(text.split()):
        if i % 9 == 8:
            out += [[], ["other"]][rng.random() < 0.5]
        else:
            out.append(rng.choice([w, w.upper(), f"“{w}”", w + ",\n>", w]))
    return " ".join(out)


def fixture(seed=1, n_items=40):
    rng = random.Random(seed)
    items = [(i, passage(rng, rng.randint(40, 90)), f"who saw {i}", f"answer {VOCABULARY[i]}") for i in range(n_items)]
    docs, truth = [], set()
    for d in range(1000, 1240):
        i, filler = rng.randrange(n_items), [passage(rng, rng.randint(30, 400)) for _ in range(3)]
        w, kind = items[i][1].split(), rng.randrange(5)
        n = len(w)
        if kind == 0:
            mid = noisy(rng, " ".join(w[: int(n * 0.6)]))
        elif kind == 1:
            mid = noisy(rng, items[i][1])
        elif kind == 2:
            mid = " ".join(w[: int(n * 0.3)]) + " " + passage(rng, 300) + " " + " ".join(w[int(n * 0.6) : int(n * 0.9)])
        elif kind == 3:
            mid = " ".join(w[: int(n * 0.2)])
        else:
            mid = ""
        if kind < 3:
            truth.add((i, d))
        docs.append((d, " ".join([filler[0], mid, filler[1], filler[2]])))
    return items, docs, truth


def test_wand_equals_full_scan():
    items, docs, _ = fixture(3)
    index = Index(items)
    for _, text in docs[:60]:
        pairs = index.pairs_of(words(text))
        terms = np.unique(pairs[pairs >= 0]).tolist()
        full = {}
        for t in terms:
            for i, s in zip(index.docs[t], index.impacts[t]):
                full[i] = full.get(i, 0.0) + s
        for threshold in (0.02, 0.1, 0.4):
            got = dict(index.search(terms, threshold))
            assert got.keys() == {i for i, s in full.items() if s >= threshold}
            assert all(abs(got[i] - full[i]) < 1e-9 for i in got)


def test_planted_leaks(spark):
    items, docs, truth = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, passage string, question string, answer string")
    got = {(r.item_id, r.doc_id) for r in find_leaks(d, i).collect()}
    assert got == truth
    assert {(r.item_id, r.doc_id) for r in find_leaks(d, i, block_items=7).collect()} == truth


def test_dirty_rows(spark):
    items, docs, truth = fixture()
    rows = [*docs[:30], docs[0], (None, docs[1][1]), (1, None), (2, ""), (3, " \n"), (4, "x" * 100_000), (5, items[0][1] * 50)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item int, passage int")
    i = spark.createDataFrame([*items, items[0], (None, "a b c", "", ""), (99, None, None, None), (98, "one", None, None)], "item_id long, passage string, question string, answer string")
    got = sorted((r.item_id, r.doc_id) for r in find_leaks(d, i).collect())
    assert got == sorted({t for t in truth if t[1] in {x[0] for x in docs[:30]}} | {(0, 5)})
    assert find_leaks(d.limit(0), i).collect() == [] and find_leaks(d, i.limit(0)).collect() == []
    row = next(r for r in find_leaks(spark.createDataFrame([(1, items[3][1] + " " + items[3][3])], "doc_id long, text string"), i).collect())
    assert row.has_answer and row.coverage == 1.0 and row.stretches == 1


def test_items_longer_than_passages_are_retrieved():
    long = " ".join(f"w{k}" for k in range(6000))
    index = Index([("i", long, "", ""), ("j", "some other short item", "", "")])
    ws = words(f"before {long} after")
    size = len(index.vocabulary)
    numbers = [index.vocabulary.get(w, -1) for w in ws]
    at = {int(k): n for n, k in enumerate(index.keys)}
    pairs = np.array([at.get(a * size + b, -1) if a >= 0 and b >= 0 else -1 for a, b in zip(numbers, numbers[1:])])
    assert 0 in index.candidates(pairs, 0.08)


def test_reachable_keeps_all_that_verify_finds():
    items, docs, _ = fixture(5)
    index = Index(items)
    for _, text in docs[:80]:
        pairs = index.pairs_of(words(text))
        found = list(index.candidates(pairs, 0.02))
        kept = set(index.reachable(found, pairs, 0.4))
        assert {i for i in found if index.verify(i, pairs)[0] >= 0.4} <= kept


def test_long_items_whole_and_in_part(spark):
    rng = random.Random(9)
    unlike = lambda n, k: " ".join(f"{rng.choice(VOCABULARY)}{(k * 7919 + j) % 977}" for j in range(n))
    items = [(k, unlike(n, k), "", "") for k, n in enumerate((100, 900, 3300, 8000, 20_000))]
    docs, truth = [], set()
    for i, passage, _, _ in items:
        w = passage.split()
        n = len(w)
        forms = [w, w[: int(n * 0.45)], w[: int(n * 0.25)] + unlike(400, 50).split() + w[int(n * 0.6) : int(n * 0.85)], w[: int(n * 0.2)]]
        for j, form in enumerate(forms):
            d = 1000 + 10 * i + j
            docs.append((d, f"{unlike(60, 60)} {' '.join(form)} {unlike(60, 61)}"))
            if j < 3:
                truth.add((i, d))
    got = {(r.item_id, r.doc_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string, question string, answer string")).collect()}
    assert got == truth
