"""Noise in text from scanned pages: broken and misread words, running headers, page numbers.

A lexicon with counts is built from all texts. A page's lines are read as one stream of words: words broken at line
ends are joined, and every stretch with an unknown word is decoded over a lattice of words that are kept, corrected
by character confusions, joined with the next or split in two; the cheapest path wins. Running titles are lines that
recur at the head or foot of a file's pages, page numbers those that keep step with the pages. Paragraph
boundaries come from dynamic programming over the remaining lines.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.runtime import Scratch, lookup_join

#: Words in the lexicon at most (the most frequent), and times that a word must occur to be in it, and to be a correction.
LEXICON, SEEN, TRUSTED = 300_000, 3, 8
#: Times that a correction must be as frequent as the word, where symbols stand inside the word and where only letters do.
RATIO_SYMBOL, RATIO_LETTER = 3, 25
#: The same for words of three letters; those of two are left, as each is a word in some language.
RATIO_SHORT = 300
#: Confusions in a word, and tokens that one word may have been torn into, at most.
CONFUSIONS, JOINED = 5, 4
#: Lines at the head and foot that may be titles or numbers, and the length of these at most.
EDGE, EDGE_LENGTH = 3, 90
#: Share of a file's pages, and pages, that a title stands on at least.
TITLE_SHARE, TITLE_PAGES = 0.34, 3
#: The share that is enough where some of the lines have a page number at their side.
NUMBERED_SHARE = 0.12

# What scanning reads for what was printed, hyphens, dresses of page numbers.
MISREAD = {
    "@": ["a"], "°": ["o"], "º": ["o"], "0": ["o"], "1": ["l", "i"], "!": ["i", "l"], "|": ["l", "i"], "5": ["s"], "6": ["b"], "8": ["b", "s"], "9": ["g"], "3": ["e"], "€": ["e"], "$": ["s"], "ﬁ": ["fi"], "ﬂ": ["fl"], "ﬀ": ["ff"], "ii": ["u", "n"], "rn": ["m"], "ri": ["n"], "nr": ["m"], "in": ["m"], "m": ["rn"], "n": ["ri"], "cl": ["d"], "d": ["cl"], "vv": ["w"], "li": ["h"], "c": ["e", "o"], "e": ["c"], "o": ["c", "e"], "b": ["h"], "h": ["b"], "q": ["g"], "g": ["q"], "f": ["t"], "t": ["f"], "l": ["i", "t"], "i": ["l"], "j": ["i"], "u": ["n"],
}
HYPHENS = "-‐‑¬­"
LABELS = ["page", "pg", "p", "pp", "sheet", "folio", "fol", "leaf", "seite", "blatt", "s", "bl", "feuille", "feuillet", "página", "pagina", "pág", "hoja"]
OF = r"(?:/|of|von|de|sur|out of)"

_SYMBOLS = set("@°º01!|5689€$3ﬁﬂﬀ")
_EDGES = ".,;:?\"'“”„‘’«»()[]{}…–—-‐‑¬­*<>/"
_NUMBER = re.compile(rf"^\W*(?:([^\W\d_]{{1,9}}@?[^\W\d_]{{0,4}})\W{{0,3}}\s*)??([\dOolI|]{{1,5}}|[ivxlcIVXLC]{{1,8}})\s*(?:{OF}\s*[\dOolI|]{{1,5}})?\W*$")
_LETTERS = re.compile(r"[^\W\d_]+")
_BROKEN = re.compile(rf"[^\W\d_][{HYPHENS}]\s*$")
_SIDE_NUMBER = re.compile(r"^\W*(?:\d{1,4}|[ivxl]{1,7})\s{2,}|\s{2,}(?:\d{1,4}|[ivxl]{1,7})\W*$", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


@dataclass
class Lexicon:
    """Counts of words in lower case."""

    counts: dict[str, int]
    memo: dict[str, tuple[str, int] | None] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)

    def __getstate__(self):
        return {"counts": self.counts, "memo": {}, "order": []}

    def trusted(self) -> list[str]:
        """The words that may be corrections, in order: those with one beginning stand together."""
        if not self.order:
            self.order = sorted(w for w, n in self.counts.items() if n >= TRUSTED)
        return self.order

    def correct(self, word: str) -> tuple[str, int] | None:
        """The printed word and the place of the first confusion, if ``word`` (lower case) is a misreading."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 400_000:
            self.memo.clear()
        got = self.memo[word] = self._correct(word)
        return got

    def _correct(self, word: str) -> tuple[str, int] | None:
        if len(word) > 30 or sum(c.isdigit() for c in word) > len(word) // 2 or len(word) < 2:
            return None
        own = self.counts.get(word, 1)
        must = [c in _SYMBOLS for c in word]
        if len(word) < 3 and not any(must):
            return None
        ratio = RATIO_SYMBOL if any(must) else RATIO_LETTER if len(word) > 3 else RATIO_SHORT
        best: tuple[float, str, int] | None = None
        get = self.counts.get
        # Depth first over places: a place is kept, or one or two characters are read otherwise. What no correction begins with is left.
        words = self.trusted()
        stack = [(0, "", 0, 0.0, -1)]
        while stack:
            at, built, used, cost, first = stack.pop()
            k = bisect_left(words, built)
            if k == len(words) or not words[k].startswith(built):
                continue
            if at >= len(word):
                if used and (n := get(built, 0)) >= TRUSTED and n >= ratio * own:
                    score = math.log(n) - cost
                    if best is None or score > best[0]:
                        best = (score, built, first)
                continue
            if not must[at]:
                stack.append((at + 1, built + word[at], used, cost, first))
            if used < CONFUSIONS:
                for size in (1, 2):
                    for printed in MISREAD.get(word[at : at + size], ()) if at + size <= len(word) else ():
                        stack.append((at + size, built + printed, used + 1, cost + (0.5 if must[at] else 3.0), at if first < 0 else first))
        return None if best is None else (best[1], best[2])

    def known(self, word: str) -> bool:
        return self.counts.get(word, 0) >= SEEN


def core_of(token: str) -> tuple[int, str]:
    """A token in lower case without punctuation round it, and where it begins."""
    left = token.lstrip(_EDGES)
    core = left.rstrip(_EDGES + "!")
    return len(token) - len(left), core.lower()


def read_token(lexicon: Lexicon, token: str) -> tuple[str, int] | None:
    """The printed form (lower case, without punctuation) and the place of the first confusion, if misread."""
    at, core = core_of(token)
    if len(core) < 2 or lexicon.counts.get(core, 0) >= 1_000_000:
        return None
    if core.isalpha() or not re.search(r"[-'’/]", core):
        got = lexicon.correct(core)
        return None if got is None else (got[0], at + got[1])
    place, out, first = at, [], -1
    for part in re.split(r"([-'’/])", core):
        got = lexicon.correct(part) if len(part) > 1 and _LETTERS.search(part) and not re.fullmatch(r"[a-z]{0,3}\d+[a-z]?", part) else None
        if got is not None and first < 0:
            first = place + got[1]
        out.append(part if got is None else got[0])
        place += len(part)
    return None if first < 0 else ("".join(out), first)


@dataclass
class Reading:
    """A step of a path: printed words, the tokens that they stand for, and where characters were read otherwise (token, place)."""

    words: list[str]
    tokens: list[int]
    misread: list[tuple[int, int]] = field(default_factory=list)


def price(lexicon: Lexicon, word: str) -> float | None:
    n = lexicon.counts.get(word, 0)
    return 14.0 - math.log(n) if n >= TRUSTED else None


def _wordlike(core: str) -> bool:
    return all(c.isalpha() or c in _SYMBOLS for c in core) and any(c.isalpha() for c in core)


def _alone(lexicon: Lexicon, token: str) -> list[tuple[float, list[str], int | None]]:
    """The readings of one token: cost, words, place of a confusion. It is kept, corrected, or split, with a confusion in a part."""
    at, core = core_of(token)
    own, got = price(lexicon, core), read_token(lexicon, token)
    out: list[tuple[float, list[str], int | None]] = [(18.0 if own is None else own + (25.0 if got else 0.0), [token], None)]
    if got is not None:
        out.append(((price(lexicon, got[0]) or 14.0) + 3.0, [_dress(token, got[0])], got[1]))
    if own is not None or not 4 <= len(core) <= 60 or not _wordlike(core):
        return out
    for k in range(2, len(core) - 1):
        left, right = core[:k], core[k:]
        a, b = price(lexicon, left), price(lexicon, right)
        if a is not None and b is not None and a + b < 14:
            out.append((a + b + 6.0, [token[: at + k], token[at + k :]], None))
        elif a is not None and a < 11 and (fix := lexicon.correct(right)) is not None and a + (b := price(lexicon, fix[0]) or 14.0) + 3.0 < 14:
            out.append((a + b + 9.0, [token[: at + k], _dress(token[at + k :], fix[0])], at + k + fix[1]))
        elif b is not None and b < 11 and (fix := lexicon.correct(left)) is not None and b + (a := price(lexicon, fix[0]) or 14.0) + 3.0 < 14:
            out.append((a + b + 9.0, [_dress(token[: at + k], fix[0]), token[at + k :]], at + fix[1]))
    return out


def _joined(lexicon: Lexicon, tokens: list[str]) -> tuple[float, str, tuple[int, int] | None] | None:
    """The cost of neighbouring tokens as one word, the word, and the token and place of a confusion. A capital opens a word of its own.

    Of two tokens a misread whole may be corrected; more than two are joined only to a known word.
    """
    cores = [core_of(t) for t in tokens]
    last = len(tokens) - 1
    for k, (t, (at, core)) in enumerate(zip(tokens, cores)):
        if not core or not _wordlike(core) or (k and at) or (k < last and at + len(core) < len(t)):
            return None
        if k and any(c.isupper() for c in t) and not (tokens[0].isupper() and t.isupper() and len(core) > 1):
            return None
    if all(price(lexicon, core) is not None for _, core in cores):
        return None
    raw, whole = "".join(tokens), "".join(core for _, core in cores)
    if (p := price(lexicon, whole)) is not None:
        return p + 4.0 * last, _dress(raw, whole), None
    if last > 1 or (fix := lexicon.correct(whole)) is None:
        return None
    place = cores[0][0] + fix[1]
    return (price(lexicon, fix[0]) or 14.0) + 7.0, _dress(raw, fix[0]), (0, place) if place < len(tokens[0]) else (1, place - len(tokens[0]))


def read_stretch(lexicon: Lexicon, tokens: list[str]) -> list[Reading]:
    """The cheapest path over the lattice of a stretch."""
    best: list[tuple[float, int, Reading]] = [(0.0, -1, Reading([], []))] + [(math.inf, -1, Reading([], []))] * len(tokens)
    for i, token in enumerate(tokens):
        here = best[i][0]
        for cost, words, place in _alone(lexicon, token):
            if here + cost < best[i + 1][0]:
                best[i + 1] = (here + cost, i, Reading(words, [i], [] if place is None else [(i, place)]))
        for n in range(2, min(JOINED, len(tokens) - i) + 1):
            got = _joined(lexicon, tokens[i : i + n])
            if got is not None and here + got[0] < best[i + n][0]:
                misread = [] if got[2] is None else [(i + got[2][0], got[2][1])]
                best[i + n] = (here + got[0], i, Reading([got[1]], list(range(i, i + n)), misread))
    out, i = [], len(tokens)
    while i > 0:
        _, prev, step = best[i]
        out.append(step)
        i = prev
    return out[::-1]


def decode(lexicon: Lexicon, tokens: list[str]) -> list[tuple[str, list[int]]]:
    """The cheapest path over the lattice of a stretch: printed words with the tokens that they stand for."""
    return [(w, step.tokens) for step in read_stretch(lexicon, tokens) for w in step.words]


def is_open(lexicon: Lexicon, token: str) -> bool:
    """Whether a token has another reading than itself: words that are known and have no correction part the stretches."""
    core = core_of(token)[1]
    return read_token(lexicon, token) is not None or (price(lexicon, core) is None and _wordlike(core))


def _dress(token: str, word: str) -> str:
    """The word with the token's punctuation and capitals."""
    at, core = core_of(token)
    shown = token[at : at + len(core)]
    if shown.isupper() and len(shown) > 1:
        word = word.upper()
    elif shown[:1].isupper():
        word = word[:1].upper() + word[1:]
    return token[:at] + word + token[at + len(core) :]


def title_key(line: str) -> str:
    """A line without page number, case, spacing and what scanning confuses."""
    s = _SIDE_NUMBER.sub("", line.strip()).lower()
    for a, b in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        s = s.replace(a, b)
    s = s.translate(str.maketrans("0°1l!|5@6ehqtg9", "ooiiiisabcbgigg"))
    return "".join(c for c in s if c.isalpha())


def page_value(line: str) -> int | None:
    """The number of a line that is nothing but a page's number, in any dress."""
    m = _NUMBER.match(line.strip())
    if not m:
        return None
    label, number = m[1], m[2]
    if label and not any(_near(label.lower(), k) for k in LABELS):
        return None
    if re.fullmatch(r"[ivxlc]+", number, re.I) and not re.fullmatch(r"[lI|]+\d|\d[lI|]+", number):
        total, values = 0, [_ROMAN[c] for c in number.lower()]
        for a, b in zip(values, [*values[1:], 0]):
            total += -a if a < b else a
        return total
    digits = number.translate(str.maketrans("OolI|", "00111"))
    return int(digits)


def _near(a: str, b: str) -> bool:
    if a == b:
        return True
    plain = a.replace("@", "a").replace("c", "e")
    return len(b) > 2 and (plain == b.replace("c", "e") or (len(plain) == len(b) and sum(x != y for x, y in zip(plain, b)) == 1))


@dataclass
class PageNoise:
    """What was found on a page: rows (kind, line_no), and edge lines (line_no, key, number, number beside it)."""

    rows: list[tuple[str, int]]
    edges: list[tuple[int, str, int | None, bool]]


def inspect(lexicon: Lexicon, text: str, verdicts: dict[str, bool]) -> PageNoise:
    """Broken words of each line, those that the cheapest path reads otherwise, and the lines at head and foot. ``verdicts`` remembers tokens."""
    lines = text.split("\n")
    filled = [i for i, s in enumerate(lines) if s and not s.isspace()]
    rows: list[tuple[str, int]] = []
    near = dict.fromkeys(filled[:EDGE] + filled[-EDGE:])
    edges = [(i + 1, title_key(lines[i]), page_value(lines[i]), _SIDE_NUMBER.search(lines[i].strip()) is not None) for i in near if len(lines[i]) <= EDGE_LENGTH]
    # The page as one stream: a word that a line's end breaks is one token, of which ``cut`` characters are of the first line.
    stream: list[str] = []
    where: list[tuple[int, int, int, str, str]] = []  # line, line after the cut, cut, and the two parts
    for i, following in zip(filled, [*filled[1:], None]):
        tokens = lines[i].split()
        if stream and where[-1][1] == i:
            del tokens[0]
        broken = None
        if following is not None and lines[i].rstrip()[-1] in HYPHENS and _BROKEN.search(lines[i]):
            nxt = lines[following].split()[0]
            if nxt[:1].isalpha() or nxt[:1] in _SYMBOLS:
                rows.append(("hyphen", i + 1))
                if tokens:
                    left = tokens.pop().rstrip(HYPHENS)
                    broken = (_unbroken(lexicon, left, nxt), (i, following, len(left), left, nxt))
        stream += tokens
        where += [(i, i, 0, "", "")] * len(tokens)
        if broken is not None:
            stream.append(broken[0])
            where.append(broken[1])
    bad: set[int] = set()
    for step in _readings(lexicon, stream, verdicts):
        for k, place in step.misread:
            line, second, cut, left, right = where[k]
            if second == line or place < cut:
                bad.add(line)
                if second != line and _second(right, step.words[-1]):
                    bad.add(second)
            else:
                bad.add(second)
    rows += [("misread", i + 1) for i in sorted(bad)]
    return PageNoise(rows, edges)


def _unbroken(lexicon: Lexicon, left: str, right: str) -> str:
    """A word broken at a line's end as one token: with its hyphen where only this makes it a word, or lets it be read."""
    whole, dashed = left + right, f"{left}-{right}"
    if lexicon.known(core_of(whole)[1]):
        return whole
    if lexicon.known(core_of(dashed)[1]) or (read_token(lexicon, whole) is None and read_token(lexicon, dashed) is not None):
        return dashed
    return whole


def _readings(lexicon: Lexicon, stream: list[str], verdicts: dict[str, bool]) -> Iterator[Reading]:
    """The steps of the cheapest path over a stream that are in stretches with an open token. ``verdicts`` remembers those.

    Of two known words without another reading none joins the other, so the path is the same as over the whole.
    """
    if len(verdicts) > 400_000:
        verdicts.clear()
    free = []
    for k, t in enumerate(stream):
        v = verdicts.get(t)
        if v is None:
            v = verdicts[t] = is_open(lexicon, t)
        if v:
            free.append(k)
    at = 0
    while at < len(free):
        a = b = free[at]
        while at < len(free) and free[at] <= b + 2:
            b = free[at]
            at += 1
        a, b = max(a - 1, 0), min(b + 2, len(stream))
        for step in read_stretch(lexicon, stream[a:b]):
            yield Reading(step.words, [a + k for k in step.tokens], [(a + k, place) for k, place in step.misread])


def _second(right: str, printed: str) -> bool:
    """Whether the right part of a broken word was misread too: its letters don't end the printed word."""
    return not core_of(printed)[1].endswith(core_of(right)[1])


def paragraphs(lexicon: Lexicon, text: str, dropped: set[int]) -> list[str]:
    """The page's text without the dropped lines: words joined and corrected, in continuous paragraphs.

    Boundaries minimise the sum of costs over all lines: a blank line, a short line, the end of a sentence and a
    capital after it speak for one, a broken word and a small letter against it, and each costs something itself.
    """
    lines, blank, gap = [], [], False
    for i, s in enumerate(text.split("\n"), 1):
        if i in dropped:
            continue
        if not s.strip():
            gap = True
            continue
        lines.append(s.strip())
        blank.append(gap)
        gap = False
    if not lines:
        return []
    width = sorted(len(s) for s in lines)[int(0.9 * (len(lines) - 1))]
    cost = [0.0] * len(lines)  # of beginning a paragraph at a line; joining it costs the opposite
    for i in range(1, len(lines)):
        a, b = lines[i - 1], lines[i]
        c = 1.0 - 4.0 * blank[i]
        c += 6.0 if _BROKEN.search(a) else 0.0
        c += -1.0 if re.search(r"[.!?…:][\"'”»)\]]*$", a) else 2.5
        c += 2.5 if b[:1].islower() else -0.5
        c += -1.5 if len(a) + 1 + len(b.split()[0]) <= width * 0.8 else 0.5
        cost[i] = c
    # Two states: a line begins a paragraph or joins the one before; a paragraph of one line costs extra.
    begin, join = (0.0, (0,)), (math.inf, ())
    for i in range(1, len(lines)):
        single = 0.5
        new_begin = min((begin[0] + cost[i] + single, begin[1] + (i,)), (join[0] + cost[i], join[1] + (i,)))
        new_join = min((begin[0] - cost[i], begin[1]), (join[0] - cost[i], join[1]))
        begin, join = new_begin, new_join
    starts = min(begin, join)[1]
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        stream: list[str] = []
        for k in range(a, b):
            words = lines[k].split()
            if stream and k > a and _BROKEN.search(lines[k - 1]) and words:
                left = stream.pop()
                bare = left.rstrip(HYPHENS)
                whole, dashed = bare + words[0], f"{bare}-{words[0]}"
                compound = lexicon.counts.get(core_of(dashed)[1], 0) > lexicon.counts.get(core_of(whole)[1], 0)
                words = [dashed if compound else whole, *words[1:]]
            stream += words
        out.append(" ".join(w for w, _ in decode(lexicon, stream)))
    return out


def build_lexicon(df: DataFrame, text_col: str = "text_content") -> Lexicon:
    """Counts of the words of all texts; the LEXICON most frequent are kept, which bounds what is broadcast."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw: Counter = Counter()

        def flush() -> pd.DataFrame:
            words: Counter = Counter()
            for t, n in raw.items():
                core = core_of(t)[1]
                for w in {core, *re.split(r"[-'’/]", core)} if not core.isalpha() else (core,):
                    if 1 < len(w) <= 30 and all(c.isalpha() or c in "-'’" for c in w):
                        words[w] += n
            raw.clear()
            return pd.DataFrame(list(words.items()), columns=["word", "n"])

        for batch in batches:
            for t in batch["text"]:
                raw.update(t.split())
            if len(raw) > 500_000:
                yield flush()
        yield flush()

    rows = df.select(F.col(text_col).alias("text")).filter(F.length("text") > 0).mapInPandas(count, "word string, n long")
    top = rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN).orderBy(F.desc("n"), "word").limit(LEXICON)
    got = top.toPandas()
    return Lexicon(dict(zip(got["word"], got["n"].tolist())))


def _lines(pages: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, verdicts = shared.value, {}
        for b in batches:
            rows = []
            for page, file, number, text in zip(b["page"], b["file"], b["number"], b["text"]):
                found = inspect(own, text, verdicts)
                rows += [(page, file, number, kind, line, None, None, False) for kind, line in found.rows]
                rows += [(page, file, number, "edge", *edge) for edge in found.edges]
            out = pd.DataFrame(rows, columns=["page", "file", "number", "kind", "line_no", "key", "value", "beside"])
            yield out.astype({"number": "Int64", "value": "Int64"})

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.mapInPandas(run, f"page {kinds['page']}, file {kinds['file']}, number long, kind string, line_no long, key string, value long, beside boolean")


def _titles(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, title): keys on enough of a file's pages."""
    sizes = pages.groupBy("file").agg(F.countDistinct("page").alias("pages"))
    seen = edges.filter((F.length("key") >= 5) & F.col("value").isNull()).groupBy("file", "key", "page").agg(F.max("beside").alias("beside"))
    seen = seen.groupBy("file", "key").agg(F.count(F.lit(1)).alias("on"), F.max("beside").alias("beside"))
    enough = F.least(F.lit(TITLE_PAGES), F.greatest(F.lit(2), F.col("pages") - 1))
    return seen.join(sizes, "file").filter((F.col("on") >= enough) & (F.col("on") >= F.col("pages") * F.when(F.col("beside"), NUMBERED_SHARE).otherwise(TITLE_SHARE))).select("file", F.col("key").alias("title"))


def _steps(edges: DataFrame) -> DataFrame:
    """(file, step): by how much the numbers of a file's edge lines most often differ from its pages'."""
    step = edges.filter(F.col("value").isNotNull() & F.col("number").isNotNull()).select("file", "page", (F.col("value") - F.col("number")).alias("step")).distinct()
    counted = step.groupBy("file", "step").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("file").agg(F.max(F.struct("n", -F.abs("step"), "step")).alias("b"))
    return best.filter((F.col("b.n") >= 2) | (F.col("b.step") == 0)).select("file", F.col("b.step").alias("step"))


def find_noise(df: DataFrame, id_col: str = "id", file_col: str = "source_file_id", page_col: str = "page_number", text_col: str = "text_content", lexicon: Lexicon | None = None) -> DataFrame:
    """(<id_col>, noise_kind, line_no): `hyphen`, `misread`, `running_header` and `page_number` lines of each page.

    The lexicon is that of ``df`` where none is given. Null ids, null and empty texts have no rows; a null file
    has no titles and no numbering; a repeated id counts once for titles and its equal rows are merged. An empty
    input gives an empty result. Other columns are ignored. The text is read whole, in one task for each page.
    """
    scratch = Scratch(df.sparkSession)
    lexicon = build_lexicon(df, text_col) if lexicon is None else lexicon
    pages = df.select(F.col(id_col).alias("page"), F.col(file_col).alias("file"), F.col(page_col).cast("long").alias("number"), F.col(text_col).alias("text")).filter("page is not null and length(text) > 0")
    lines = scratch.cut(_lines(pages, lexicon).distinct(), "lines")
    edges = lines.filter("kind = 'edge'")
    # Only lines of one file meet: a handful of its titles with a handful of edge lines of each page.
    titles = _titles(edges, pages.select("page", "file"))
    like = (F.col("key") == F.col("title")) | ((F.length("title") >= 8) & (F.levenshtein(F.col("key"), F.col("title"), 2) >= 0))
    headers = lookup_join(edges.filter("value is null"), titles, "file", "inner").filter(like).select("page", F.lit("running_header").alias("kind"), "line_no").distinct()
    numbers = lookup_join(edges.filter("value is not null"), _steps(edges), "file", "inner").filter("value - number = step").select("page", F.lit("page_number").alias("kind"), "line_no").distinct()
    apart = headers.unionByName(numbers)
    body = lines.filter("kind <> 'edge'").select("page", "kind", "line_no").join(apart.select("page", "line_no"), ["page", "line_no"], "left_anti")
    return body.select("page", "kind", "line_no").unionByName(apart).select(F.col("page").alias(id_col), F.col("kind").alias("noise_kind"), "line_no").distinct()


def repair_pages(df: DataFrame, id_col: str = "id", file_col: str = "source_file_id", page_col: str = "page_number", text_col: str = "text_content", lexicon: Lexicon | None = None) -> DataFrame:
    """(<id_col>, paragraph_no from 1, paragraph): the continuous text of each page without headers and numbers.

    See find_noise() for the rows that don't count; of a repeated id the smallest text is taken.
    """
    lexicon = build_lexicon(df, text_col) if lexicon is None else lexicon
    noise = find_noise(df, id_col, file_col, page_col, text_col, lexicon)
    drop = noise.filter(F.col("noise_kind").isin("running_header", "page_number")).groupBy(F.col(id_col).alias("page")).agg(F.collect_set("line_no").alias("dropped"))
    pages = df.select(F.col(id_col).alias("page"), F.col(text_col).alias("text")).filter("page is not null and length(text) > 0").groupBy("page").agg(F.min("text").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, text, dropped in zip(b["page"], b["text"], b["dropped"]):
                parts = paragraphs(shared.value, text, set(dropped) if dropped is not None else set())
                rows += [(page, k, p) for k, p in enumerate(parts, 1)]
            yield pd.DataFrame(rows, columns=["page", "paragraph_no", "paragraph"])

    kind = pages.schema["page"].dataType.simpleString()
    return pages.join(drop, "page", "left").mapInPandas(run, f"page {kind}, paragraph_no int, paragraph string").withColumnRenamed("page", id_col)
