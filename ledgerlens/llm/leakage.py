"""Held-out test passages inside corpus documents: BM25 retrieval by block-max WAND, then alignment.

The test items are the indexed side: an inverted index whose terms are pairs of neighbouring words, with
BM25 impacts divided by the item's own score, so that one threshold serves items of all lengths. Document
frequencies are those of all items. Tasks build the index in shards of a bounded number of items and words; the
driver holds one at a time and passes it on, and the documents are scanned once, whatever the number of shards.
Every document is cut into overlapping passages, each passage queries the index, and every item above the threshold
is retrieved: the weak AND is tested for all blocks of items at once on their maxima, and only blocks that pass are
opened. Retrieved items are aligned with the whole document: chains of shared word pairs, in order and close
together, form stretches, and the best one or two must cover the required share of the item's words. Overlap with
question and answer is reported.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.runtime import Scratch, lookup_join

#: Share of the item's words that one or two stretches must cover.
COVERAGE = 0.4
#: Share of an item's own BM25 score from which it is retrieved: a fraction of what the shorter of two stretches holds.
RETRIEVE = 0.08
#: Words of a passage and between the starts of two; any stretch of half a passage lies whole in one.
PASSAGE, STEP = 256, 128
#: Items, and words of them, in a shard of the index, about: more make more shards.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
#: Neighbouring items whose postings of a term form a block, with a maximum of its own.
ITEMS = 8
#: Words that may lie between two neighbouring matches of a stretch.
GAP = 4
#: Words and share of the item that a second stretch has at least.
SECOND_WORDS, SECOND_SHARE = 6, 0.1
K1, B = 1.2, 0.75

_WORD = re.compile(r"[^\W_]+")
_SOFT = re.compile("[­​‌‍﻿]")


def words(text: str) -> list[str]:
    """Words without case, punctuation and spacing."""
    if not text.isascii():
        text = _SOFT.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.casefold())


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each start up to its end, one range after the other."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Index:
    """Inverted lists of word pairs over items, in blocks of neighbouring items with their maxima.

    ``frequency`` (items with a pair, by the pair's two words), ``count`` and ``mean`` (pairs of an item) are those
    of all items where this index is a shard of them.
    """

    def __init__(self, items: list[tuple[object, str | None, str | None, str | None]], frequency: dict[str, int] | None = None, count: int | None = None, mean: float | None = None):
        self.ids = [i for i, _, _, _ in items]
        texts = [words(p or "") for _, p, _, _ in items]
        self.length = [len(t) for t in texts]
        self.question = [set(words(q or "")) for _, _, q, _ in items]
        self.answer = [" ".join(words(a or "")) for _, _, _, a in items]
        self.vocabulary: dict[str, int] = {}
        for t in texts:
            for w in t:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        size = len(self.vocabulary)
        numbers = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]
        own = [n[:-1] * size + n[1:] for n in numbers]
        sizes = np.array([len(o) for o in own], np.int64)
        self.keys, term = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_inverse=True)
        #: The terms of each item by place, and its places by term.
        self.terms = np.split(term.astype(np.int32), np.cumsum(sizes)[:-1]) if own else []
        self.places = [np.argsort(t, kind="stable") for t in self.terms]
        total = max(len(self.keys), 1)
        posting, n = np.unique(np.repeat(np.arange(len(items)), sizes) * total + term, return_counts=True)
        item, term = posting // total, posting % total
        if frequency is None:
            df = np.bincount(term, minlength=len(self.keys)).astype(float)
        else:
            spelled = list(self.vocabulary)
            df = np.array([frequency.get(f"{spelled[k // size]} {spelled[k % size]}", 1) for k in self.keys.tolist()], float)
        count = len(items) if count is None else count
        mean = (sizes.mean() if len(sizes) else 0.0) if mean is None else mean
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        score = idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * sizes[item] / (mean or 1.0)))
        # Of an item longer than a passage, the score of a passage's share of it counts as whole.
        whole = np.bincount(item, score, minlength=len(items)) * np.minimum(1.0, PASSAGE / np.maximum(sizes, 1))
        order = np.lexsort((item, term))
        self.item, self.impact, term = item[order], (score / whole[item])[order], term[order]
        self.from_ = np.searchsorted(term, np.arange(len(self.keys) + 1))
        opens = np.flatnonzero(np.diff(term * len(items) + self.item // ITEMS, prepend=-1)) if len(term) else np.zeros(0, np.int64)
        self.block_from = np.append(opens, len(term))
        self.block = self.item[opens] // ITEMS
        self.most = np.maximum.reduceat(self.impact, opens) if len(opens) else np.zeros(0)
        self.blocks_from = np.searchsorted(term[opens], np.arange(len(self.keys) + 1))

    @property
    def docs(self) -> list[np.ndarray]:
        """The items of each term."""
        return np.split(self.item, self.from_[1:-1])

    @property
    def impacts(self) -> list[np.ndarray]:
        return np.split(self.impact, self.from_[1:-1])

    def pairs_of(self, tokens: list[str]) -> np.ndarray:
        """The number of each pair of neighbouring words, -1 where no item has it."""
        get, size = self.vocabulary.get, len(self.vocabulary)
        n = np.array([get(w, -1) for w in tokens], np.int64)
        if len(n) < 2 or not len(self.keys):
            return np.full(max(len(n) - 1, 0), -1, np.int64)
        key = np.where((n[:-1] >= 0) & (n[1:] >= 0), n[:-1] * size + n[1:], -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def search(self, terms: list[int] | np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items whose score reaches the threshold. Blocks whose maxima don't reach it together are never opened."""
        t = np.asarray(terms, np.int64)
        blocks = _ranges(self.blocks_from[t], self.blocks_from[t + 1])
        own = self.block[blocks]
        bound = np.bincount(own, self.most[blocks])
        blocks = blocks[bound[own] >= threshold - 1e-9]
        if not len(blocks):
            return []
        at = _ranges(self.block_from[blocks], self.block_from[blocks + 1])
        score = np.bincount(self.item[at], self.impact[at])
        found = np.flatnonzero(score >= threshold)
        return list(zip(found.tolist(), score[found].tolist()))

    def candidates(self, pairs: np.ndarray, threshold: float, passage: int = PASSAGE, step: int = STEP) -> dict[int, float]:
        """Items retrieved by any passage of the document, with the best score."""
        best: dict[int, float] = {}
        hits = np.flatnonzero(pairs >= 0)
        if not len(hits):
            return best
        # What the whole document doesn't retrieve, none of its passages does.
        if len(pairs) > passage and not self.search(np.unique(pairs[hits]), threshold):
            return best
        for start in range(0, max(len(pairs) - (passage - step), 1), step):
            a, b = np.searchsorted(hits, (start, start + passage))
            if a < b:
                for i, s in self.search(np.unique(pairs[hits[a:b]]), threshold):
                    best[i] = max(best.get(i, 0.0), s)
        return best

    def reachable(self, items: list[int], pairs: np.ndarray, coverage: float) -> list[int]:
        """The items of which two stretches can cover enough: no chain gains more than one through all pairs that the document holds."""
        if not items:
            return []
        held = np.zeros(len(self.keys), bool)
        held[pairs[pairs >= 0]] = True
        out = []
        for i in items:
            apart = np.diff(np.flatnonzero(held[self.terms[i]]))
            if 3 + np.where(apart <= 3, apart, 2).sum() >= coverage * self.length[i]:
                out.append(i)
        return out

    def stretches(self, item: int, pairs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Chains of shared pairs as (words covered, item from, item to, document from, document to), best first.

        Neighbouring matches lie at most GAP words apart on either side. All words between matches that
        differ by one changed or missing word count as covered.
        """
        places = self.places[item]
        terms = self.terms[item][places]
        at = np.flatnonzero(pairs >= 0)
        left, right = np.searchsorted(terms, pairs[at]), np.searchsorted(terms, pairs[at], "right")
        anchors = list(zip(np.repeat(at, right - left).tolist(), places[_ranges(left, right)].tolist()))
        best: list[tuple[int, int, int, int]] = []
        low = 0
        for k, (p, q) in enumerate(anchors):
            while anchors[low][0] < p - GAP - 1:
                low += 1
            own = (2, q, p, -1)
            for j in range(low, k):
                pp, pq = anchors[j]
                if pp < p and pq < q <= pq + GAP + 1:
                    gain = q - pq if q - pq <= 3 else 2
                    if best[j][0] + gain > own[0]:
                        own = (best[j][0] + gain, best[j][1], best[j][2], j)
            best.append(own)
        used, out = set(), []
        for k in sorted(range(len(best)), key=lambda k: (-best[k][0], k)):
            if k in used:
                continue
            j, clash = k, False
            chain = []
            while j >= 0:
                clash |= j in used
                chain.append(j)
                j = best[j][3]
            used.update(chain)
            if not clash:
                out.append((best[k][0], best[k][1], anchors[k][1] + 1, best[k][2], anchors[k][0] + 1))
        return out

    def verify(self, item: int, pairs: np.ndarray) -> tuple[float, int]:
        """The share of the item's words in the best one or two stretches, and their number."""
        n = max(self.length[item], 1)
        found = self.stretches(item, pairs)
        if not found:
            return 0.0, 0
        first, best = found[0], (found[0][0] / n, 1)
        for s in found[1:]:
            if s[0] < max(SECOND_WORDS, SECOND_SHARE * n):
                break
            apart = (s[1] > first[2] or s[2] < first[1]) and (s[3] > first[4] or s[4] < first[3])
            if apart:
                return min(1.0, (first[0] + s[0]) / n), 2
        return best

    def overlaps(self, item: int, tokens: list[str]) -> tuple[float, bool]:
        """The share of the question's words that the document holds, and whether it holds the answer."""
        question, answer = self.question[item], self.answer[item]
        share = len(question & set(tokens)) / len(question) if question else 0.0
        return share, bool(answer) and f" {answer} " in f" {' '.join(tokens)} "


def _tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [words(p) for p in b["passage"]]
        yield b.assign(size=[len(t) for t in texts], pairs=[sorted({f"{x} {y}" for x, y in zip(t, t[1:])}) for t in texts])


def shards(items: DataFrame, block_items: int) -> DataFrame:
    """(shard, index) of the items (item, passage, question, answer): pickled parts of one index over all of them."""
    scratch = Scratch(items.sparkSession)
    kind = items.schema["item"].dataType.simpleString()
    rows = items.withColumn("row", F.monotonically_increasing_id())
    rows = scratch.cut(rows.mapInPandas(_tokenized, f"item {kind}, passage string, question string, answer string, row long, size long, pairs array<string>"), "items")
    said = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.avg(F.greatest(F.col("size") - 1, F.lit(0))).alias("mean")).first()
    count, mean = said.n, said.mean or 1.0
    parts = max(1, -(-count // block_items), -(-(said.words or 0) // BLOCK_WORDS))
    flat = scratch.cut(rows.select("row", F.explode("pairs").alias("pair")), "flat")
    seen = lookup_join(flat, flat.groupBy("pair").agg(F.count(F.lit(1)).alias("f")), "pair", "inner").groupBy("row").agg(F.collect_list("pair").alias("pair"), F.collect_list("f").alias("f"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        frequency: dict[str, int] = {}
        for pairs, f in zip(group["pair"], group["f"]):
            if pairs is not None:
                frequency.update(zip(pairs, f))
        index = Index(list(group[["item", "passage", "question", "answer"]].itertuples(index=False, name=None)), frequency, count, mean)
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "index": [pickle.dumps(index)]})

    keyed = rows.drop("pairs", "size").join(seen, "row", "left").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    return scratch.cut(keyed.groupBy("shard").applyInPandas(build, "shard int, index binary"), "index")


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", passage_col: str = "passage", question_col: str = "question", answer_col: str = "answer",
    coverage: float = COVERAGE, retrieve: float = RETRIEVE, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(<item_id>, <doc_id>, bm25, coverage, stretches, question_overlap, has_answer): each leaked item of each document once.

    Documents are only mapped, each whole, in one scan; every task goes through the shards of the index one by
    one, each of about ``block_items`` items at most. Rows with a null id, text or passage, and passages of less
    than two words, give nothing. Repeated document ids are merged (the largest values are kept); repeated item ids
    count as they come and are merged likewise. An empty side gives an empty result. Other columns are ignored.
    """
    chosen = docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("text")).filter("doc is not null and length(text) > 0")
    named = items.select(F.col(item_id).alias("item"), *[F.col(c).alias(a) for c, a in ((passage_col, "passage"), (question_col, "question"), (answer_col, "answer"))])
    named = named.filter("item is not null and passage is not null")
    # One shard at a time passes through the driver; a broadcast's bytes lie on disk.
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(bytes(r["index"])) for r in shards(named, block_items).select("index").toLocalIterator()]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, Index] = {}
        for batch in batches:
            rows = []
            for k, part in enumerate(shared):
                own = kept.get(k) or pickle.loads(part.value)
                if len(shared) == 1:
                    kept[k] = own
                else:
                    part.__dict__.pop("_value", None)  # a task holds one shard at a time
                for doc, text in zip(batch["doc"], batch["text"]):
                    tokens = words(text)
                    pairs = own.pairs_of(tokens)
                    found = own.candidates(pairs, retrieve)
                    for item in own.reachable(list(found), pairs, coverage):
                        share, stretches = own.verify(item, pairs)
                        if share >= coverage:
                            rows.append((own.ids[item], doc, found[item], share, stretches, *own.overlaps(item, tokens)))
            yield pd.DataFrame(rows, columns=["item", "doc", "bm25", "coverage", "stretches", "question_overlap", "has_answer"])

    item, doc = named.schema["item"].dataType.simpleString(), chosen.schema["doc"].dataType.simpleString()
    found = chosen.mapInPandas(match, f"item {item}, doc {doc}, bm25 double, coverage double, stretches int, question_overlap double, has_answer boolean")
    best = found.groupBy("item", "doc").agg(*[F.max(c).alias(c) for c in ("bm25", "coverage", "stretches", "question_overlap", "has_answer")])
    return best.withColumnRenamed("item", item_id).withColumnRenamed("doc", doc_id)
