import random

import numpy as np
import pytest

from ledgerlens.llm import names
from ledgerlens.llm.names import Name, average_linkage, describe, edits, fold, parse_firm, parse_person, similarity, variant_groups, variant_pairs

SCHEMA = "id string, case_id string, entity_type string, canonical_name string, normalized_name string"


def name(kind, text, frequency=None):
    key, grams = describe(kind, text)
    return Name(kind, key, {g: 1 for g in grams} | (frequency or {}), 4)


@pytest.mark.parametrize(
    "a, b",
    [("Charles Wexley", "Chuck Wexley"), ("Wexley, Charles", "Charles Wexley"), ("C. Wexley", "Charles Wexley"), ("Björn Hale", "Bjoern Hale"), ("Dr. José K. Marn", "jose marn"), ("anna.wexley", "Anna Wexley"), ("Chalres Wexley", "Charles Wexely"), ("Anna van Hale", "van Hale, Anna"), ("Tom Hale Jr", "Thomas Hale Junior")],
)
def test_same_person(a, b):
    assert similarity(name("person", a), name("person", b)) >= 0.6


@pytest.mark.parametrize("a, b", [("Tom Hale Sr", "Tom Hale Jr"), ("Anna Wexley", "Tom Wexley"), ("Anna K. Wexley", "Anna P. Wexley"), ("Anna Wexley", "Anna Marstone"), ("T. Hale", "Anna Hale"), ("Anna", "Anna Hale")])
def test_other_person(a, b):
    assert similarity(name("person", a), name("person", b)) < 0.5


def test_firms():
    same = [("Calder Marine Engineering Ltd", "Calder Marine Eng. Limited"), ("The Calder Storage", "Calder Storage GmbH"), ("Calder Storage G.m.b.H.", "Storage Calder GmbH"), ("C.M.E.L.", "Calder Marine Engineering Ltd"), ("Caldre Storage AG", "Calder Storage AG"), ("Calder-Storage", "Calder Storage")]
    other = [("Calder Storage AG", "Calder Motors AG"), ("Calder Storage AG", "Wexium Storage AG"), ("KWML", "Calder Storage"), ("Calder Storage AG", "Calder Storage Ltd")]
    assert all(similarity(name("organization", a), name("organization", b)) >= 0.6 for a, b in same)
    assert all(similarity(name("organization", a), name("organization", b)) < 0.5 for a, b in other)


def test_words_that_are_common_differ():
    common = {g: 50 for w in ("tarilman", "tarolman") for g in describe("person", w + " x")[1]} | {"#tarilman": 3, "#tarolman": 3}
    assert similarity(name("person", "Anna Tarilman", common), name("person", "Anna Tarolman", common)) == 0
    assert similarity(name("person", "Anna Tarilman"), name("person", "Anna Tarolman")) > 0.6


def test_parsing():
    assert parse_person("Prof. Müller-Hale, Ed K. Jr.") == (["edward", "mullerhale"], ["k"], "jr", "")
    assert parse_firm("The Hale & Marn Bros. S.A.") == (["hale", "marn", "brothers"], "sa", "") and parse_firm("H.M.B.")[2] == "hmb"
    assert fold("Jürgen") == fold("Juergen") and describe("person", "...") == ("", [])
    assert edits("abcd", "abdc") == 1 and edits("a", "abcdef") == 9 and edits("kitten", "sitting") == 3


def test_average_linkage():
    s = np.array([[0, 0.9, 0.8, 0], [0.9, 0, 0.2, 0], [0.8, 0.2, 0, 0.1], [0, 0, 0.1, 0]])
    assert average_linkage(s, np.zeros(4, bool), 0.5).tolist() == [0, 0, 0, 3]
    assert average_linkage(s, np.zeros(4, bool), 0.6).tolist() == [0, 0, 2, 3]
    near = np.array([[0, 0, 0.9], [0, 0, 0.9], [0.9, 0.9, 0]])
    assert average_linkage(near, np.array([False, False, True]), 0.5).tolist() == [0, 1, 2]


def groups(spark, rows, **kw):
    got = variant_groups(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    assert len({r.id for r in got}) == len(got)
    return {r.id: r.group_id for r in got}


@pytest.mark.parametrize("chunk", [2000, 3])
def test_groups_within_scopes(spark, chunk):
    rng = random.Random(3)
    firsts, lasts = ["Charles", "Josephine", "Margaret", "Nathaniel"], ["Brackwoden", "Stilmarsh", "Quorlington", "Fenwhistle", "Dromgavel"]
    rows, truth = [], {}
    for case in "ab":
        for f in firsts:
            for last in rng.sample(lasts, 3):
                k = rng.randrange(1, len(last))
                forms = [f"{f} {last}", f"{last}, {f}", f"{f[0]}. {last}" if rng.random() < 0.3 else f"{f} {last}".upper(), f"{f} {last[:k]}{rng.choice('bxkz')}{last[k:]}"]
                for form in forms:
                    rows.append((f"e{len(rows):04}", case, " Person", form, None))
                    truth.setdefault((case, f, last), []).append(rows[-1][0])
    got = groups(spark, rows, chunk=chunk)
    wrong = sum(got[i] != min(ids) for ids in truth.values() for i in ids)
    assert wrong <= 2


def test_dirty_rows(spark):
    rows = [("1", "a", "person", None, "anna hale"), ("2", "a", "person", " ", "Anna Hale"), ("2", "a", "person", " ", "Anna Hale"), ("3", None, "person", "Anna Hale", None), ("4", "a", "location", "Anna Hale", None), (None, "a", "person", "Anna Hale", None), ("5", "a", "person", "?!", None), ("6", "a", None, "Anna Hale", None), ("7", "a", "person", "x" * 5000, None), ("8", "b", "person", "Anna Hale", None), ("9", "a", "person", None, None)]
    assert groups(spark, rows) == {"1": "1", "2": "1", "7": "7", "8": "8"}
    assert groups(spark, []) == {}
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", n int, scope int")
    assert [tuple(r) for r in variant_pairs(variant_groups(df)).collect()] == [("1", "2")]


def test_groups_dont_depend_on_size(spark, monkeypatch):
    rng = random.Random(5)
    firsts, lasts = ["Charles", "Josephine", "Margaret", "Christopher"], ["Brackwoden", "Stilmarsh", "Quorlington"]
    rows = []
    for f in firsts:
        for last in lasts:
            k = rng.randrange(2, len(last))
            forms = [f"{f} {last}", f"{f[0]}. {last}", f"{f} {last[:k]}x{last[k:]}", f"{f} {f[0]}. {last}", f"{f} {last} Jr", f"{f[:4]}{f[5:]} {last}", f"{f} {last[:k]}{last[k + 1:]}"]
            rows += [(f"e{len(rows) + i:04}", "a", "person", form, None) for i, form in enumerate(forms)]
    rows += [(f"f{i}", "a", "organization", form, None) for i, form in enumerate(["Brackwoden Supplies Ltd", "Brackwodn Supplies Ltd", "Brackwoden Supplis", "B.S.", "Brackwoden Supplies Limited"])]
    small = groups(spark, rows)
    monkeypatch.setattr(names, "ALL_PAIRS", 2)
    monkeypatch.setattr(names, "BLOCK", 3)
    assert groups(spark, rows) == small and len(set(small.values())) < len(rows) / 2


def test_assignment_is_the_best_of_all():
    from itertools import permutations

    from ledgerlens.llm.names import _assign

    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        cost = rng.integers(-9, 9, (n, int(rng.integers(n, 7)))).astype(float)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(cost.shape[1]), n))
        assert sum(cost[i, j] for i, j in enumerate(_assign(cost.tolist()))) == best


def test_names_foreign_to_the_tables(spark):
    """Made-up syllables and trades that no table of the module holds: typing errors, order, initials, titles, legal forms."""
    rng = random.Random(11)
    syllables = "ab chi du eko fa gu hla ije kwa lum mbo ndu oru pil qua rish sang thu uzo vu wem xol yan zhi bhat krish nair wong tsu hoa".split()
    trades = "Glassworks Orchard Foundry Fisheries Bakery Tannery Quarry Brewery Nursery Aviation Textiles Ceramics".split()
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n)).capitalize()

    def typo(w):
        i = rng.randrange(1, max(2, len(w) - 1))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeiourstn") + w[i:], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :], w[:i] + rng.choice("aeiourstn") + w[i + 1 :]])

    rows, owner = [], {}
    for e in range(400):
        if rng.random() < 0.4:
            a, b, t, kind = word(3), word(2), rng.choice(trades), "organization"
            forms = [f"{a} {b} {t}", f"{a} {b} {t} Ltd", f"{typo(a)} {b} {t}", f"{a} {b} {t}".upper(), f"{a} {typo(b)} {t} Limited", f"{t} {a} {b}"]
        else:
            a, b, kind = word(2), word(3), "person"
            forms = [f"{a} {b}", f"{b}, {a}", f"{typo(a)} {b}", f"{a} {typo(b)}", f"{a[0]}. {b}", f"Dr {a} {b}", f"{a} {b}".lower()]
        for k in range(rng.randint(1, 5)):
            rows.append((f"e{e}-{k}", f"c{e % 4}", kind, rng.choice(forms), None))
            owner[f"e{e}-{k}"] = e
    found = {(r.entity_a_id, r.entity_b_id) for r in variant_pairs(variant_groups(spark.createDataFrame(rows, SCHEMA))).collect()}
    true = {(x, y) for x in owner for y in owner if x < y and owner[x] == owner[y]}
    assert len(found & true) >= 0.95 * len(true) and len(found & true) >= 0.98 * len(found)


def test_pairs_of_a_large_group_in_blocks(spark):
    rows = [(f"n{i:03}", "g") for i in range(60)] + [("x", "h"), ("y", "h"), ("z", "k")]
    groups = spark.createDataFrame(rows, "id string, group_id string")
    got = sorted(tuple(r) for r in variant_pairs(groups, chunk=7).collect())
    assert got == sorted([(f"n{i:03}", f"n{j:03}") for i in range(60) for j in range(i + 1, 60)] + [("x", "y")])
