import random

import pytest

from ledgerlens.llm.ocr import Lexicon, build_lexicon, decode, find_noise, inspect, page_value, paragraphs, read_token, repair_pages, title_key

WORDS = "the witness handed over a metal container without comment and left through northern corridor after seven minutes several neighbours heard vehicle turning around behind storage building while paramedic described lighting as uneven officer noticed cracked bottle beside entrance".split()
LEX = Lexicon({w: 5000 for w in WORDS} | {"short-lived": 50, "crackcd": 4})
SCHEMA = "id string, source_file_id string, page_number int, text_content string"


@pytest.mark.parametrize("bad, good", [("w1tness", "witness"), ("crackcd", "cracked"), ("c°mment", "comment"), ("rnetal", "metal"), ("neiqhbours", "neighbours"), ("@fter", "after"), ("cornrnerif.", "comment"), ("Witncss,", "witness"), ("t!irning", "turning")])
def test_confusions(bad, good):
    got = read_token(LEX, bad)
    assert (got is None and bad == "t!irning") or got[0] == good


@pytest.mark.parametrize("bad, good", [("fotodokumentaticn", "fotodokumentation"), ("telecommunicatlons", "telecommunications"), ("durchsuchungsbeschlusscs", "durchsuchungsbeschlusses")])
def test_long_words_are_searched_whole(bad, good):
    assert read_token(Lexicon({good: 5000}), bad) == (good, [x == y for x, y in zip(bad, good)].index(False))


@pytest.mark.parametrize("word", ["witness", "EX-1234", "someone@mail.example", "Quorvald", "12:30", "@handle7", "il", "2023", "", "x" * 5000])
def test_left_alone(word):
    assert read_token(LEX, word) is None


def test_page_numbers_and_titles():
    assert [page_value(s) for s in ("12", "- 7 -", "Page 3 of 9", "[45]", "xiv", "3/17", "p. 8", "Seite 4", "Pagc 5 of 9", "— 6 —", "1O")] == [12, 7, 3, 45, 14, 3, 8, 4, 5, 6, 10]
    assert [page_value(s) for s in ("13:48.", "Room 12", "the end", "", "2 May 2020", "Annex B")] == [None] * 6
    assert title_key("12   Reglster 0f Exhibits") == title_key("REGISTER  OF EXHIBITS") == title_key("Register of Exhibits   xii")


def test_decode_splits_and_merges():
    assert [w for w, _ in decode(LEX, ["the", "wit", "ness", "heardvehicle", "crackcd"])] == ["the", "witness", "heard", "vehicle", "cracked"]


def test_lines_of_a_page():
    text = "the wit-\nness left the ve¬\nhicle\n\na short-\nlived w1tness\nQuorvald left -\nafter"
    found = inspect(LEX, text, {})
    assert sorted(found.rows) == [("hyphen", 1), ("hyphen", 2), ("hyphen", 5), ("misread", 6)]
    assert inspect(LEX, "the w1t-\nness", {}).rows == [("hyphen", 1), ("misread", 1)]


def test_path_of_a_page():
    often = Lexicon({w: 50_000 for w in WORDS})
    assert inspect(LEX, "the w1t ness left\nthe wit ness and heardvehicle", {}).rows == [("misread", 1)]
    assert inspect(often, "he heardvehiclc turning\nthe wit ness and heardvehicle", {}).rows == [("misread", 1)]
    assert inspect(often, "several neigh-\nb0urs heardve-\nhiclc turning", {}).rows == [("hyphen", 1), ("hyphen", 2), ("misread", 2), ("misread", 3)]
    assert [w for w, _ in decode(often, ["the", "w1t", "ness", "heardvehiclc"])] == ["the", "witness", "heard", "vehicle"]


def test_paragraphs():
    text = "Title\nThe witness handed over a metal con-\ntainer without comment after minutes.\nThe officer noticed a crackcd bottle be¬\nside the entrance.\n\nSeveral neighbours heard a vehicle.\n7"
    assert paragraphs(LEX, text, {1, 8}) == ["The witness handed over a metal container without comment after minutes. The officer noticed a cracked bottle beside the entrance.", "Several neighbours heard a vehicle."]
    assert paragraphs(LEX, "", set()) == []


def book(seed=1, pages=12):
    rng, rows, truth = random.Random(seed), [], set()
    for f in ("f1", "f2"):
        for n in range(1, pages + 1):
            lines, node = [], f"{f}-{n:02}"
            if f == "f1" and n > 1:
                lines.append(rng.choice(["Register of Bottles", "REGISTER OF BOTTLES", "  Register  of Bottles", "Reglster 0f Bottles"]))
                truth.add((node, "running_header", 1))
            for _ in range(8):
                words = [rng.choice(WORDS) for _ in range(9)]
                if rng.random() < 0.2:
                    words[4] = "w1tness"
                    truth.add((node, "misread", len(lines) + 1))
                if rng.random() < 0.2:
                    lines.append(" ".join([*words[:8], "neigh-"]))
                    truth.add((node, "hyphen", len(lines)))
                    lines.append(f"bours {' '.join(rng.choice(WORDS) for _ in range(4))}.")
                else:
                    lines.append(" ".join(words) + ".")
            if f == "f1":
                lines += ["", f"- {n + 4} -"]
                truth.add((node, "page_number", len(lines)))
            elif n == 3:
                lines.append("Annex B")
            rows.append((node, f, n, "\n".join(lines)))
    return rows, truth


def test_found_in_a_book(spark):
    rows, truth = book()
    got = {tuple(r) for r in find_noise(spark.createDataFrame(rows + rows[:3], SCHEMA)).collect()}
    assert got == truth


def test_repaired_book(spark):
    rows, _ = book()
    out = repair_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    text = " ".join(r.paragraph for r in out)
    assert "w1tness" not in text and "neighbours" in text and "neigh-" not in text and "neigh bours" not in text and "ottles" not in text.replace("bottle", "") and "- 7 -" not in text
    assert {r.id for r in out} == {r[0] for r in rows}


def test_dirty_rows(spark):
    rows = [("a", "f", 1, None), ("b", "f", None, ""), (None, "f", 1, "the wit-\nness"), ("c", None, None, "the wit-\nness"), ("d", "f", 3, "   \n \n"), ("e", "f", 4, "x" * 300_000), ("c", None, None, "the wit-\nness")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", kind int, key string")
    assert [tuple(r) for r in find_noise(df).collect()] == [("c", "hyphen", 1)]
    assert find_noise(df.limit(0)).collect() == [] and repair_pages(df.limit(0)).collect() == []
    assert build_lexicon(df.limit(0)).counts == {}


def test_words_torn_into_several_tokens():
    torn = [w for w, _ in decode(LEX, ["the", "w", "it", "ness", "heardvehicle"])]
    assert torn == ["the", "witness", "heard", "vehicle"]
    assert [w for w, _ in decode(LEX, ["the", "witness", "heard", "the", "vehicle"])] == ["the", "witness", "heard", "the", "vehicle"]
