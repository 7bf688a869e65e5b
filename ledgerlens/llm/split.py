"""Pieces of oversized texts: balanced targets, snapped to natural boundaries, with overlap."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 4000, 200
#: How far a cut may move from its target, as a share of the limit.
TOLERANCE = 0.1
#: Pieces that may be added to the minimum for the sake of natural cuts.
EXTRA = 3

#: Boundaries by strength: the cut lies at the end of the match.
BOUNDARIES = [
    (5, re.compile(r"\n[^\S\n]*\n\s*")),
    (4, re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+")),
    (3, re.compile(r"\n")),
    (2, re.compile(r"[,;:–—]\s+|[、，；：]")),
    (1, re.compile(r"\s+|(?<=\w)[-/](?=\w)")),
]


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Positions of natural cuts in order, and the strength of each."""
    best: dict[int, int] = {}
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            best.setdefault(m.end(), strength)
    at = sorted(best)
    return at, [best[p] for p in at]


def splits_character(text: str, p: int) -> bool:
    """Whether a cut at p would part what is read as one character."""
    a, b = text[p - 1], text[p]
    if unicodedata.combining(b) or b in "‍︎️" or "\U0001f3fb" <= b <= "\U0001f3ff" or a == "‍":
        return True
    return (a == "\r" and b == "\n") or ("\U0001f1e6" <= a <= "\U0001f1ff" and "\U0001f1e6" <= b <= "\U0001f1ff")


def _hard(text: str, p: int, low: int) -> int:
    """The last position in [low, p] that parts no character; p where there is none."""
    q = p
    while q > low and splits_character(text, q):
        q -= 1
    return q if q > low or not splits_character(text, q) else p


def _snap(text: str, at: list[int], strength: list[int], target: int, low: int, high: int, near: int) -> tuple[int, bool]:
    """The strongest boundary in [low, high] within ``near`` of the target, the nearest of equals; whether it is natural."""
    i, j = bisect_left(at, max(low, target - near)), bisect_right(at, min(high, target + near))
    if i < j:
        return at[max(range(i, j), key=lambda k: (strength[k], -abs(at[k] - target), -at[k]))], True
    i, j = bisect_left(at, target - near), bisect_right(at, target + near)
    return _hard(text, min(max(target, low), high), low), i >= j


def _overlap_start(text: str, at: list[int], strength: list[int], cut: int, overlap: int, floor: int) -> int:
    """Where the next piece begins: at the strongest boundary in the farther half of the overlap."""
    low = max(cut - overlap, floor)
    if low >= cut:
        return cut
    i, j = bisect_left(at, low), bisect_right(at, cut - overlap // 2 - 1)
    if i < j:
        return at[max(range(i, j), key=lambda k: (strength[k], -at[k]))]
    while low < cut and splits_character(text, low):
        low += 1
    return low


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The pieces of one text as [start, end): each at most ``limit`` long, each but the first starting up to ``overlap`` before the end of the last.

    The minimum count of pieces is taken, equal-length targets are placed, and each cut moves to the
    strongest boundary near its target from which the rest still fits. Where that leaves a cut inside a word
    although a boundary is near, a piece is added. A text without boundaries is cut at equal lengths.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    at, strength = boundaries(text)
    step = limit - overlap
    least = 1 + -(-(n - limit) // step)
    near = max(1, int(limit * tolerance))
    for pieces in range(least, least + EXTRA + 1):
        size = (n + (pieces - 1) * overlap) / pieces
        out, start, last, natural = [], 0, 0, True
        for k in range(1, pieces):
            # The rest after this cut must fit the pieces left, each of which repeats at most ``overlap``.
            low, high = max(last + 1, n - (pieces - k) * step), min(start + limit, n - 1)
            target = round(k * size - (k - 1) * overlap)
            if low > high:
                natural = False
                break
            cut, good = _snap(text, at, strength, target, low, high, near)
            natural &= good
            out.append((start, cut))
            start, last = _overlap_start(text, at, strength, cut, overlap, last + 1 if k > 1 else 1), cut
        fits = len(out) == pieces - 1 and n - start <= limit
        if fits and (natural or pieces == least + EXTRA):
            return [*out, (start, n)]
        if fits:
            fallback = [*out, (start, n)]
    return fallback


def split_oversized(df: DataFrame, id_col: str = "id", text_col: str = "text_content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every text longer than ``limit`` characters (Unicode code points).

    Output: (<id_col>, piece_no from 1, n_pieces, start_char, end_char, overlap_chars, piece) with offsets
    into the text; the pieces without their overlaps, joined, give the text back. Shorter, null and empty
    texts and null ids have no row; a repeated id counts once (of unlike texts the smallest). Other columns
    are ignored. One text is held by one task, in time that is linear in its length.
    """
    big = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") > limit))
    once = big.groupBy("id").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                parts, last = spans(text, limit, overlap), 0
                for k, (a, b) in enumerate(parts, 1):
                    rows.append((key, k, len(parts), a, b, last - a if k > 1 else 0, text[a:b]))
                    last = b
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_pieces", "start_char", "end_char", "overlap_chars", "piece"])

    kind = once.schema["id"].dataType.simpleString()
    out = once.mapInPandas(cut, f"id {kind}, piece_no int, n_pieces int, start_char int, end_char int, overlap_chars int, piece string")
    return out.withColumnRenamed("id", id_col)
