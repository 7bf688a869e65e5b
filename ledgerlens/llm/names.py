"""Variant spellings of person and organisation names: weighted n-gram vectors, a sparse cosine join, average linkage.

Within one scope (case and entity type) equal cleaned names form classes. A class has a vector of character 3-grams of
its words, of their sorted letters and consonants and, for organisations, of its initials, weighted by inverse document frequency over all
names of its type. Pairs of classes whose cosine can reach the threshold are found by a prefix filter: the rarest grams
of each vector, up to where the rest's norm falls below the threshold, must share one. Long lists of a gram are joined
in chunks. All pairs that reach the threshold are links, however many a name has (a top-n without an n that loses
some), weighted by their cosine; a check of the words, one by one, takes away those that say that the names differ
(a suffix, an initial, another trade). Links form components, which average linkage over the cosines cuts into groups.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.components import star_forest
from ledgerlens.runtime import Scratch, lookup_join

#: Cosine from which two names are linked, alikeness of their words that a link must have, average cosine from which groups merge.
COSINE, ALIKE, GROUP = 0.25, 0.5, 0.2
#: Weight of a firm's initials beside all its grams.
SHORT = 0.6
#: Names, or share of all, that hold what parts a word from a like one if the word was typed on purpose.
COMMON, COMMON_SHARE = 4, 1e-3
#: Times that the one word's grams may be rarer than the other's if both were.
RARER_GRAMS = 5
#: Times that one of two words must be as frequent as the other for this to be a typing error of that.
FAR_RARER = 20
#: Share of all names below which rarity adds no weight: what typing errors make is rare, and says nothing.
FLOOR_SHARE, FLOOR = 1e-3, 3
#: Names in a list of one gram and scope that are joined without chunks.
CHUNK = 2_000
#: Classes of a component that are grouped in one task, and in a block of a larger one.
ALL_PAIRS, BLOCK = 300, 250
#: How much nearer than the next a group must be for a weak name to join it.
APART = 0.04
KINDS = ("person", "organization")

# Titles, particles and suffixes of names, legal forms, abbreviations in firms' names, and nicknames.
TITLES = set("mr mrs ms miss mx dr prof professor sir lady lord rev fr hon judge sgt sergeant det detective insp inspector lt lieutenant capt captain col maj officer ofc agent const pc dc ds di supt herr frau hr fr mme mlle monsieur madame don dona senor senora sra srta".split())
PARTICLES = set("van von der den de la le du di da dos das del della al el bin ibn ben zu zur ten ter".split())
SUFFIXES = {"jr": "jr", "junior": "jr", "jnr": "jr", "sr": "sr", "senior": "sr", "snr": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "co": "co", "company": "co", "corp": "corp", "corporation": "corp", "llc": "llc", "llp": "llp", "lp": "lp", "plc": "plc", "gmbh": "gmbh", "ag": "ag", "kg": "kg", "ohg": "ohg", "ug": "ug", "ev": "ev", "sa": "sa", "sarl": "sarl", "sas": "sas", "sl": "sl", "srl": "srl", "spa": "spa", "nv": "nv", "bv": "bv", "ab": "ab", "oy": "oy", "as": "as", "pty": "pty",
}
ABBREVIATIONS = {
    "intl": "international", "int": "international", "natl": "national", "mfg": "manufacturing", "manuf": "manufacturing", "mgmt": "management", "mgt": "management", "svc": "service", "svcs": "services", "serv": "services", "grp": "group", "bros": "brothers", "assoc": "associates", "assocs": "associates", "assn": "association", "dept": "department", "univ": "university", "tech": "technologies", "techs": "technologies", "sys": "systems", "eng": "engineering", "engr": "engineering", "dev": "development", "dist": "distribution", "ind": "industries", "inds": "industries", "prod": "products", "prods": "products", "ctr": "center", "med": "medical", "sec": "security", "prop": "property", "props": "properties", "transp": "transport", "trans": "transport", "logist": "logistics", "log": "logistics", "supp": "supplies", "sup": "supplies", "pharm": "pharmacy", "equip": "equipment", "constr": "construction", "fin": "financial", "ins": "insurance", "inv": "investments", "hldgs": "holdings", "bldg": "building", "elec": "electric", "comm": "communications", "res": "research", "labs": "laboratories", "lab": "laboratory",
}
NICKNAMES = {
    "alexander": "alex sasha xander sandy alec", "alexandra": "lexi", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "catherine": "cathy", "charles": "charlie chuck chas", "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "dominic": "dom", "dorothy": "dot dottie", "edward": "ed eddie ned", "elizabeth": "liz beth betty eliza lizzie", "eugenia": "genie",
    "florence": "flo", "francisco": "paco pancho fran", "franziska": "franzi", "frederick": "fred freddie freddy", "friedrich": "fritz", "gabrielle": "gabby gaby gabi", "gregory": "greg", "guadalupe": "lupe", "hannelore": "hanne lore", "henry": "harry hank", "ignacio": "nacho", "isabella": "bella izzy", "jacqueline": "jackie", "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hannes", "john": "jack johnny", "jose": "pepe", "joseph": "joe joey", "josephine": "jo josie",
    "katherine": "kate kathy katie kay", "kenneth": "ken kenny", "leonard": "len lenny leo", "margaret": "maggie meg peggy", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nate nat", "nicholas": "nick nicky", "pamela": "pam", "patricia": "pat trish patty tricia", "penelope": "penny", "peter": "pete", "philip": "phil", "quentin": "quen", "rebecca": "becky", "richard": "dick rick ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "rosalind": "ros roz rosie", "samuel": "sam sammy", "sebastian": "seb basti", "stephen": "steve", "susannah": "sue susie suzy", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "tobias": "toby tobi", "ulrich": "uli ulli", "victoria": "vicky tori vic", "wilhelmina": "wilma mina minnie", "william": "will bill billy willie", "yevgenia": "zhenya", "zachary": "zach zack zak",
}

_LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "’": "'", "‘": "'", "`": "'", "´": "'"})


def fold(text: str) -> str:
    """Lower case without accents; ae, oe and ue as the plain vowel, so that both ways to write an umlaut agree."""
    plain = unicodedata.normalize("NFKD", text.translate(_LETTERS))
    plain = "".join(c for c in plain if not unicodedata.combining(c)).casefold()
    return re.sub(r"(?<=[aou])e(?=[^aeiou\s]|$)", "", plain) if re.search("[aou]e", plain) else plain


_NICK = {fold(n): fold(k) for k, v in NICKNAMES.items() for n in v.split()}


def parse_person(name: str) -> tuple[list[str], list[str], str, str]:
    """Full words, initials in order, suffix, particles."""
    s = unicodedata.normalize("NFKC", name).strip()
    if not re.search(r"\s", s) and re.search(r"[._]", s):
        s = re.sub(r"[._\d@]+", " ", s)
    if "," in s:
        last, _, first = s.partition(",")
        s = f"{first} {last}" if not all(w.strip(".").lower() in SUFFIXES for w in first.split()) else f"{last} {first}"
    raw = [w for w in re.split(r"[\s.]+", fold(s)) if w]
    suffix, full, initials, particles = "", [], [], []
    for i, w in enumerate(raw):
        w = w.strip("\"'()[]-,;")
        if i and w in SUFFIXES:
            suffix = SUFFIXES[w]
            continue
        if w in TITLES or w in SUFFIXES:
            continue
        if "-" in w and w.split("-")[0] in PARTICLES:
            particles.append(w.split("-")[0])
            w = w.split("-", 1)[1]
        w = re.sub(r"[^\w]", "", w)
        if not w:
            continue
        if w in PARTICLES:
            particles.append(w)
        elif len(w) == 1:
            initials.append(w)
        else:
            full.append(_NICK.get(w, w))
    return full, initials, suffix, " ".join(particles)


def parse_firm(name: str) -> tuple[list[str], str, str]:
    """Words without legal form, the legal form, and the initials if the name is nothing but initials."""
    s = unicodedata.normalize("NFKC", name).strip()
    letters = re.sub(r"[.\s&-]", "", s)
    dotted = re.fullmatch(r"(?:\w\.\s?){2,}\w?", s) is not None
    if 2 <= len(letters) <= 8 and letters.isalpha() and (dotted or (letters.isupper() and letters == s)) and fold(letters) not in LEGAL:
        return [], "", fold(letters)
    s = re.sub(r"\b((?:\w\.\s?){2,})", lambda m: re.sub(r"[.\s]", "", m[1]) + " ", s)
    raw = [w for w in re.split(r"[^\w']+", fold(s)) if w]
    raw = [re.sub(r"\W", "", w) for w in raw if w not in ("the", "and", "und", "et", "y")]
    legal = ""
    for w in raw[:]:
        if w in LEGAL and len(raw) > 1:
            legal = LEGAL[w]
            raw.remove(w)
    return [ABBREVIATIONS.get(w, w) for w in raw if w], legal, ""


def describe(kind: str, name: str) -> tuple[str, list[str]]:
    """The class key of a name and its features: n-grams of its words, the initials of a firm, the words."""
    if kind == "person":
        full, initials, suffix, particles = parse_person(name)
        words = full + initials
        key = "|".join([" ".join(full), " ".join(initials), suffix, particles])
        extra = []
        if not full:
            return "", []
    else:
        words, legal, short = parse_firm(name)
        key = "|".join([" ".join(words), legal, short])
        if not words and not short:
            return "", []
        first = "".join(w[0] for w in words)
        extra = [f"={short}"] if short else [f"={first}", f"={first}{legal[0]}"] if legal and words else [f"={first}"]
    grams = {f"_{w}_"[i : i + 3] for w in words for i in range(len(w))}
    # What swapped letters and lost or added vowels leave as it is.
    grams |= {"~" + "".join(sorted(w)) for w in words if len(w) > 2} | {"^" + w[0] + re.sub("[aeiouy]", "", w[1:]) for w in words if len(w) > 2}
    # Whole words are counted beside the grams, but are no part of the vectors.
    return key, sorted(grams) + [e for e in extra if len(e) > 2] + sorted({f"#{w}" for w in words if len(w) > 1})


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Insertions, deletions, changes and swaps of neighbours between two words; 9 where there are more than 3."""
    if abs(len(a) - len(b)) > 3:
        return 9
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > 3:
            return 9
        before, last = last, row
    return last[-1] if last[-1] <= 3 else 9


class Name:
    """A parsed class with its vector and the frequencies of its grams among ``names`` names."""

    def __init__(self, kind: str, key: str, frequency: dict[str, int], names: int):
        self.kind = kind
        self.frequency = frequency
        self.common = max(COMMON, COMMON_SHARE * names)
        self.vector = weights(list(frequency), list(frequency.values()), names)
        parts = key.split("|")
        if kind == "person":
            self.words, self.initials, self.suffix, self.particles = parts[0].split(), parts[1].split(), parts[2], parts[3]
            self.weak = len(self.words) < 2
        else:
            self.words, self.legal, self.short = parts[0].split(), parts[1], parts[2]
            self.weak = bool(self.short)

    def rarest(self, word: str, beside: str) -> int:
        """Names with the rarest gram of ``word`` that ``beside`` hasn't."""
        return min((self.frequency.get(g, 1) for i in range(len(word)) if (g := f"_{word}_"[i : i + 3]) not in f"_{beside}_"), default=0)

    def seen(self, word: str) -> int:
        return self.frequency.get(f"#{word}", 1)


def word_similarity(a: str, b: str, x: Name, y: Name) -> float:
    """1 for equal words; less for words that a typing error parts; 0 where both look as meant."""
    if a == b:
        return 1.0
    size = max(len(a), len(b))
    d = edits(a, b)
    if d > (3 if size >= 10 else 2 if size >= 5 else 1 if size == 4 else 0):
        return 0.0
    few, many = sorted((x.seen(a), y.seen(b)))
    if few * FAR_RARER > many:
        low, high = sorted((x.rarest(a, b), y.rarest(b, a)))
        if low >= x.common and low * RARER_GRAMS > high:
            return 0.0
    return 1.0 - d / size


def _align(a: list[str], b: list[str], x: Name, y: Name) -> tuple[list[tuple[int, int, float]], float]:
    """The one-to-one matches of words with the highest sum of similarities."""
    if len(a) > len(b):
        got, total = _align(b, a, y, x)
        return [(j, i, s) for i, j, s in got], total
    table = [[word_similarity(p, q, x, y) for q in b] for p in a]
    best, at = -1.0, ()
    if len(b) <= 6:
        for order in permutations(range(len(b)), len(a)):
            total = sum(table[i][j] for i, j in enumerate(order))
            if total > best:
                best, at = total, order
        return [(i, j, table[i][j]) for i, j in enumerate(at) if table[i][j] > 0], best
    at = _assign([[-v for v in row] for row in table])
    return [(i, j, table[i][j]) for i, j in enumerate(at) if table[i][j] > 0], sum(table[i][j] for i, j in enumerate(at))


def _assign(cost: list[list[float]]) -> list[int]:
    """The column of each row, each used once, with the least sum of costs (shortest augmenting paths); rows aren't more than columns."""
    n, m = len(cost), len(cost[0])
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], col = i, 0
        least, before, used = [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[col]:
            used[col], row, step, to = True, owner[col], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    d = cost[row - 1][j - 1] - u[row] - v[j]
                    if d < least[j]:
                        least[j], before[j] = d, col
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            col = to
        while col:
            owner[col] = owner[before[col]]
            col = before[col]
    at = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            at[owner[j] - 1] = j - 1
    return at


def cosine(x: Name, y: Name) -> float:
    a, b = (x.vector, y.vector) if len(x.vector) <= len(y.vector) else (y.vector, x.vector)
    return sum(w * b[g] for g, w in a.items() if g in b)


def link(x: Name, y: Name) -> float:
    """The cosine of two names where it reaches COSINE and nothing in their words says that they differ; else 0."""
    c = cosine(x, y)
    return c if c >= COSINE and similarity(x, y) >= ALIKE else 0.0


def similarity(x: Name, y: Name) -> float:
    """How alike the words of two names are, one by one; 0 where something in them says that they differ."""
    if x.kind == "person":
        if x.suffix != y.suffix and x.suffix and y.suffix:
            return 0.0
        matched, _ = _align(x.words, y.words, x, y)
        if not matched or max(min(len(x.words[i]), len(y.words[j])) for i, j, _ in matched) < 3:
            return 0.0
        # Of two names with first and last name both must agree: an initial can't stand for the one while the other differs.
        if len(matched) < min(2, len(x.words), len(y.words)):
            return 0.0
        left_x = [w for i, w in enumerate(x.words) if i not in {m[0] for m in matched}]
        left_y = [w for j, w in enumerate(y.words) if j not in {m[1] for m in matched}]
        initials_x, initials_y = list(x.initials), list(y.initials)
        scores = [s for _, _, s in matched]
        for words, initials in ((left_x, initials_y), (left_y, initials_x)):
            for w in words[:]:
                if w[0] in initials:
                    words.remove(w)
                    initials.remove(w[0])
                    scores.append(0.85)
        for i in initials_x[:]:
            if i in initials_y:
                initials_x.remove(i)
                initials_y.remove(i)
                scores.append(1.0)
        if (left_x and left_y) or (initials_x and initials_y) or (left_x and initials_y) or (left_y and initials_x):
            return 0.0
        if len(scores) < 2:
            return 0.0
        missing = len(left_x) + len(left_y) + 0.5 * (len(initials_x) + len(initials_y))
        suffix = 0.1 if x.suffix != y.suffix else 0.0
        particles = 0.1 if x.particles != y.particles else 0.0
        return max(0.0, sum(scores) / len(scores) - 0.1 * missing - suffix - particles)
    if x.short or y.short:
        if x.short and y.short:
            return 1.0 if x.short == y.short else 0.0
        short, other = (x.short, y) if x.short else (y.short, x)
        first = "".join(w[0] for w in other.words)
        return 0.8 if len(short) > 1 and short in (first, first + other.legal[:1]) else 0.0
    if x.legal != y.legal and x.legal and y.legal:
        return 0.0
    if "".join(sorted(x.words)) == "".join(sorted(y.words)):
        return 1.0 if x.legal == y.legal else 0.95
    if len(x.words) != len(y.words):
        a, b = "".join(x.words), "".join(y.words)
        return 0.9 if a == b else 0.0
    matched, total = _align(x.words, y.words, x, y)
    if len(matched) < len(x.words):
        return 0.0
    return total / len(x.words) - (0.05 if x.legal != y.legal else 0.0)


def average_linkage(s: np.ndarray, weak: np.ndarray, cut: float) -> np.ndarray:
    """Group numbers: the two groups that are most alike on average merge until none reach the cut.

    Weak names (initials only) wait until the others are grouped, and join a group only where no other group
    is as near, as they may stand for either. A group is as near as the nearest of its names.
    """
    n = len(s)
    group = np.arange(n)
    total, size = s.astype(float).copy(), np.ones(n)
    np.fill_diagonal(total, -np.inf)

    def merge_all(alive: np.ndarray) -> None:
        while alive.sum() > 1:
            at = np.flatnonzero(alive)
            mean = total[np.ix_(at, at)] / np.outer(size[at], size[at])
            k = int(mean.argmax())
            i, j = at[k // len(at)], at[k % len(at)]
            if mean.flat[k] < cut:
                return
            i, j = min(i, j), max(i, j)
            total[i] += total[j]
            total[:, i] += total[:, j]
            total[i, i] = -np.inf
            size[i] += size[j]
            alive[j] = False
            group[group == group[j]] = group[i]

    strong = ~weak
    merge_all(strong)
    loose = weak.copy()
    merge_all(loose)
    first = group.copy()
    for j in np.flatnonzero(loose):
        at = np.flatnonzero(strong)
        if not len(at):
            continue
        own = first == first[j]
        near = np.array([s[np.ix_(own, first == k)].max(axis=1).mean() for k in at])
        order = np.argsort(-near, kind="stable")
        if near[order[0]] >= cut and (len(order) == 1 or near[order[1]] < near[order[0]] - APART):
            group[group == group[j]] = group[at[order[0]]]
    return group


def _describe_all(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("struct<key string, grams array<string>>")
    def run(kind: pd.Series, name: pd.Series) -> pd.DataFrame:
        got = [describe(k, n) for k, n in zip(kind, name)]
        return pd.DataFrame({"key": [g[0] for g in got], "grams": [g[1] for g in got]})

    return rows.withColumn("d", run("kind", "name")).select("id", "scope", "kind", "d.key", "d.grams").filter("key <> ''")


def weights(grams: list[str], freq: list[int], names: int) -> dict[str, float]:
    """The unit vector of a name: inverse document frequencies of its grams; initials that may stand for a firm's whole name weigh as much as all its grams."""
    floor = max(FLOOR, FLOOR_SHARE * names)
    plain = {g: math.log(1 + names / max(f, floor)) for g, f in zip(grams, freq) if g[0] not in "#="}
    size = math.sqrt(sum(w * w for w in plain.values())) or 1.0
    short = [g for g in grams if g[0] == "="]
    both = {g: w / size for g, w in plain.items()} | dict.fromkeys(short, SHORT)
    norm = math.sqrt(sum(w * w for w in both.values())) or 1.0
    return {g: w / norm for g, w in both.items()}


def _prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each class with the grams that another must share one of to reach the cosine."""
    for b in batches:
        prefixes = []
        for grams, freq, n in zip(b["grams"], b["freq"], b["names"]):
            w, count = weights(grams, freq, n), dict(zip(grams, freq))
            norm = rest = sum(x * x for x in w.values())
            keep = []
            for g in sorted(w, key=lambda g: (count[g], g)):
                if rest < COSINE * COSINE * norm * (1 - 1e-9):
                    break
                keep.append(g)
                rest -= w[g] * w[g]
            # Initials are few and stand for whole names: they are always looked up.
            prefixes.append(keep + [g for g in w if g[0] == "=" and g not in keep])
        yield b[["n", "scope"]].assign(prefix=prefixes)


def _pairs(prefixes: DataFrame, scratch: Scratch, chunk: int) -> DataFrame:
    """Distinct pairs (hi, lo) of classes that share a prefix gram in a scope; lists above ``chunk`` in blocks."""
    rows = scratch.cut(prefixes.select("n", "scope", F.explode("prefix").alias("gram")), "prefix")
    lists = rows.groupBy("scope", "gram").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    sized = lookup_join(rows, lists, ["scope", "gram"], "inner").withColumn("chunks", F.ceil(F.col("m") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("n"), F.col("chunks")).cast("int")
    # A pair of chunks is a key; a row goes to every pair that its chunk is in.
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("own")).alias("i"), F.greatest(c, F.col("own")).alias("j")))
    keyed = sized.withColumn("own", own).select("n", "scope", "gram", "own", F.explode(others).alias("c")).select("n", "scope", "gram", "own", "c.i", "c.j")
    a, b = keyed.alias("a"), keyed.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("scope", "gram", "i", "j")]
    # Within a pair of unlike chunks only rows of unlike chunks meet: the others meet in their own.
    meet = (F.col("a.n") > F.col("b.n")) & ((F.col("a.i") == F.col("a.j")) | (F.col("a.own") != F.col("b.own")))
    return a.join(b, [*same, meet]).select(F.col("a.n").alias("hi"), F.col("b.n").alias("lo")).distinct()


def _score(a: pd.DataFrame, b: pd.DataFrame) -> list[float]:
    cache: dict[tuple[str, str], Name] = {}

    def name(r) -> Name:
        k = (r.kind, r.key)
        if k not in cache:
            cache[k] = Name(r.kind, r.key, dict(zip(r.grams, r.freq)), r.names)
        return cache[k]

    return [link(name(x), name(y)) for x, y in zip(a.itertuples(index=False), b.itertuples(index=False))]


def variant_groups(
    df: DataFrame, id_col: str = "id", scope_col: str = "case_id", kind_col: str = "entity_type", name_col: str = "canonical_name", other_name_col: str | None = "normalized_name", chunk: int = CHUNK
) -> DataFrame:
    """(<id_col>, group_id) for each person and organisation: those of one scope that bear one name in some spelling share group_id, the smallest id.

    Left out: null ids, null scopes, other kinds (compared trimmed and in lower case), names without a letter.
    A null or blank name gives way to ``other_name_col``. A repeated id counts once (smallest values). Names that
    are equal once cleaned are always one group; all similarities of a component enter the linkage, whatever its
    size. An empty input gives an empty result. Other columns are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    blank = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    name = F.col(name_col) if other_name_col is None else F.when(blank(F.col(name_col)), F.col(other_name_col)).otherwise(F.col(name_col))
    rows = df.select(F.col(id_col).alias("id"), F.col(scope_col).cast("string").alias("case"), F.lower(F.trim(F.col(kind_col))).alias("kind"), name.alias("name"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("case").isNotNull() & F.col("kind").isin(*KINDS) & ~blank(F.col("name")))
    once = rows.groupBy("id").agg(F.min(F.struct("case", "kind", "name")).alias("r")).select("id", "r.*").withColumn("scope", F.concat_ws("|", "kind", "case"))
    named = scratch.cut(_describe_all(once), "named")
    classes = scratch.cut(named.groupBy("scope", "key").agg(F.min("kind").alias("kind"), F.min("grams").alias("grams"), F.min("id").alias("least")).withColumn("n", F.monotonically_increasing_id()), "classes")
    grams = scratch.cut(classes.select("n", "kind", F.explode("grams").alias("gram")), "grams")
    freq = grams.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("f"))
    totals = F.broadcast(classes.groupBy("kind").agg(F.count(F.lit(1)).alias("names")))  # a row for each of two kinds
    known = lookup_join(grams, freq, ["kind", "gram"], "inner").groupBy("n").agg(F.sort_array(F.collect_list(F.struct("gram", "f"))).alias("v"))
    vectors = classes.drop("grams").join(known, "n").join(totals, "kind")
    vectors = scratch.cut(vectors.select("n", "scope", "kind", "key", "least", "names", F.col("v.gram").alias("grams"), F.col("v.f").alias("freq")), "vectors")
    prefixes = vectors.mapInPandas(_prefix, "n long, scope string, prefix array<string>")
    pairs = scratch.cut(_pairs(prefixes, scratch, chunk), "pairs")
    side = F.struct("kind", "key", "grams", "freq", "names")
    score = F.pandas_udf(lambda a, b: pd.Series(_score(a, b), dtype="float64"), "double")
    first = scratch.cut(lookup_join(pairs, vectors.select(F.col("n").alias("hi"), side.alias("x")), "hi", "inner"), "half")
    scored = lookup_join(first, vectors.select(F.col("n").alias("lo"), side.alias("y")), "lo", "inner").select("hi", "lo", score("x", "y").alias("s")).filter(F.col("s") >= COSINE)
    links = scratch.cut(scored, "links")
    for t in (first, pairs, grams):
        scratch.drop(t)
    roots = _components(scratch, links)
    grouped = _group(scratch, vectors, roots)
    # Classes without a link are groups of their own.
    of_class = scratch.cut(vectors.join(grouped, "n", "left").select("scope", "key", "least", F.coalesce("g", "n").alias("g")), "of_class")
    least = of_class.groupBy("g").agg(F.min("least").alias("group_id"))
    final = scratch.cut(lookup_join(of_class, least, "g", "inner").select("scope", "key", "group_id"), "final")
    return lookup_join(named, final, ["scope", "key"], "inner").select(F.col("id").alias(id_col), "group_id", F.col("scope").alias("_scope"), "kind").drop("_scope", "kind")


def _components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(n, root) of linked classes."""
    stars = star_forest(scratch, scratch.cut(links.select("hi", "lo"), "kept")) if not links.isEmpty() else links
    return scratch.cut(stars.select(F.col("hi").alias("n"), F.col("lo").alias("root")).union(stars.select("lo", "lo").distinct()), "roots")


def _names_of(rows: pd.DataFrame) -> list[Name]:
    return [Name(r.kind, r.key, dict(zip(r.grams, r.freq)), r.names) for r in rows.itertuples()]


def _group(scratch: Scratch, vectors: DataFrame, roots: DataFrame, all_pairs: int | None = None) -> DataFrame:
    """(n, g): average linkage within each component, in one task up to ``all_pairs`` classes and in rounds above."""
    limit = ALL_PAIRS if all_pairs is None else all_pairs
    sized = scratch.cut(roots.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "sized")
    members = roots.join(vectors.drop("scope", "least"), "n")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("n", ignore_index=True)
        names = _names_of(own)
        s = np.zeros((len(own), len(own)))
        for i in range(len(own)):
            for j in range(i):
                s[i, j] = s[j, i] = link(names[i], names[j])
        group = average_linkage(s, np.array([x.weak for x in names]), GROUP)
        return pd.DataFrame({"n": own["n"], "g": own["n"].to_numpy()[group]})

    small = members.join(sized.filter(F.col("m") <= limit).select("root"), "root", "left_semi").groupBy("root").applyInPandas(run, "n long, g long")
    large = sized.filter(F.col("m") > limit)
    return small if large.isEmpty() else small.unionByName(_group_large(scratch, members.join(large, "root")))


def _group_large(scratch: Scratch, members: DataFrame) -> DataFrame:
    """(n, g) as average_linkage() groups: all pairs of a component block by block, then rounds over the sums of groups."""
    chunks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("n"), chunks).cast("int")
    others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(F.least(c, F.col("own")).alias("i"), F.greatest(c, F.col("own")).alias("j")))
    keyed = members.withColumn("own", own).withColumn("c", F.explode(others)).select("root", "n", "kind", "key", "grams", "freq", "names", "own", "c.i", "c.j")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        i, j = block["i"].iat[0], block["j"].iat[0]
        block = block.sort_values("n", ignore_index=True)
        names, n, of = _names_of(block), block["n"].tolist(), block["own"].tolist()
        # Of two unlike blocks only names of both meet: the others meet in their own.
        rows = [(n[y], n[x], s, names[y].weak, names[x].weak) for x in range(len(n)) for y in range(x) if (i == j or of[x] != of[y]) and (s := link(names[x], names[y])) > 0]
        return pd.DataFrame(rows, columns=["a", "b", "s", "weak_a", "weak_b"]).astype({"a": "int64", "b": "int64", "s": "float64", "weak_a": bool, "weak_b": bool})

    pairs = scratch.cut(keyed.groupBy("root", "i", "j").applyInPandas(compare, "a long, b long, s double, weak_a boolean, weak_b boolean"), "alike")
    # Each name is linked to another, so it stands in a pair.
    ends = F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("weak_a").alias("weak")), F.struct(F.col("b").alias("n"), F.col("weak_b").alias("weak"))))
    names = scratch.cut(pairs.select(ends.alias("x")).select("x.n", "x.weak").distinct(), "ends")
    strong = _rounds(scratch, pairs.filter("not weak_a and not weak_b").select("a", "b", F.col("s").alias("total")), names.filter("not weak").select("n"))
    loose = _rounds(scratch, pairs.filter("weak_a and weak_b").select("a", "b", F.col("s").alias("total")), names.filter("weak").select("n"))
    # A weak group is as near to another as the nearest names there are to its own, on average.
    mixed = pairs.filter("weak_a <> weak_b").select(F.when(F.col("weak_a"), F.col("a")).otherwise(F.col("b")).alias("w"), F.when(F.col("weak_a"), F.col("b")).otherwise(F.col("a")).alias("n"), "s")
    best = mixed.join(strong.withColumnRenamed("g", "k"), "n").groupBy("w", "k").agg(F.max("s").alias("s"))
    held = loose.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    near = best.join(loose.withColumnRenamed("n", "w"), "w").groupBy("g", "k").agg(F.sum("s").alias("total")).join(held, "g").select("g", "k", (F.col("total") / F.col("size")).alias("near"))
    order = Window.partitionBy("g").orderBy(F.desc("near"), "k")
    first = near.withColumn("next", F.lead("near").over(order)).withColumn("rank", F.row_number().over(order)).filter("rank = 1")
    joins = first.filter((F.col("near") >= GROUP) & (F.col("next").isNull() | (F.col("next") < F.col("near") - APART))).select("g", "k")
    return strong.unionByName(loose.join(joins, "g", "left").select("n", F.coalesce("k", "g").alias("g")))


def _rounds(scratch: Scratch, sums: DataFrame, names: DataFrame) -> DataFrame:
    """(n, g): groups merge that are each other's nearest on average, until no two reach GROUP.

    A merger is never nearer to a third group than the nearer of its parts, so these mergers are those that
    taking the nearest two one by one makes, but for ties. Pairs without a row count as 0. A group's number is its least name.
    """
    of = scratch.cut(names.select("n", F.col("n").alias("g")), "of")
    sums = scratch.cut(sums, "sums")
    while True:
        sizes = scratch.cut(of.groupBy("g").agg(F.count(F.lit(1)).alias("size")), "sizes")
        mean = F.round(F.col("total") / (F.col("size_a") * F.col("size_b")), 12)
        means = sums.join(sizes.select(F.col("g").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("g").alias("b"), F.col("size").alias("size_b")), "b").withColumn("mean", mean).filter(F.col("mean") >= GROUP)
        pair = F.struct("mean", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
        nearest = means.select(F.explode(F.array("a", "b")).alias("n"), pair.alias("p")).groupBy("n").agg(F.max("p").alias("p"))
        both = nearest.groupBy("p").agg(F.count(F.lit(1)).alias("k")).filter("k = 2")
        lead = scratch.cut(both.select((-F.col("p.b")).alias("g"), (-F.col("p.a")).alias("to")), "lead")
        if lead.isEmpty():
            return of
        old = of, sums, sizes
        of = scratch.cut(of.join(lead, "g", "left").select("n", F.coalesce("to", "g").alias("g")), "of")
        moved = sums
        for side in ("a", "b"):
            moved = moved.join(lead.select(F.col("g").alias(side), F.col("to").alias(f"to_{side}")), side, "left").withColumn(side, F.coalesce(f"to_{side}", side)).drop(f"to_{side}")
        moved = moved.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total"))
        sums = scratch.cut(moved, "sums")
        for t in (*old, lead):
            scratch.drop(t)


def variant_pairs(groups: DataFrame, id_col: str = "id", chunk: int = CHUNK) -> DataFrame:
    """(entity_a_id, entity_b_id) for all pairs of each group, the smaller id first; a group above ``chunk`` names is paired in blocks."""
    sizes = groups.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")).filter("chunks > 1")
    # Groups that need blocks are few, and have more than ``chunk`` rows each.
    sized = groups.select(F.col(id_col).alias("id"), "group_id").join(sizes, "group_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = sized.withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("own")).alias("i"), F.greatest(c, F.col("own")).alias("j")))
    keyed = own.withColumn("c", F.explode(others)).select("group_id", "id", "own", "c.i", "c.j")
    a, b = keyed.withColumnRenamed("id", "entity_a_id").withColumnRenamed("own", "own_a"), keyed.withColumnRenamed("id", "entity_b_id").withColumnRenamed("own", "own_b")
    met = a.join(b, ["group_id", "i", "j"]).filter("entity_a_id < entity_b_id and (i = j or own_a <> own_b)")
    return met.select("entity_a_id", "entity_b_id")
