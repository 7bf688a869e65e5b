"""Pairs of like vectors by blocked matrix products.

The rows of a key are divided into chunks of bounded size; each pair of chunks is one group, in which a matrix product
gives all cosines and only those above the threshold leave. A hot key is spread over its pairs of chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk at most, about.
CHUNK = 2_048


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """A matrix of unit rows in double; a vector of zeros stays one."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def checked(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """The rows whose vector has the dimension and no null inside; others are left out, as a model's own check would refuse them."""
    return df.filter((F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull()))


def _chunked(df: DataFrame, key: str, id_col: str, chunk: int) -> DataFrame:
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_chunks"))
    return df.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_chunks")).cast("int"))


def pairs_above(df: DataFrame, key: str, id_col: str, vector: str, least: float, chunk: int = CHUNK) -> DataFrame:
    """(<key>, a, b, score): pairs of one key, a's id smaller, whose cosine is above ``least``.

    Vectors must have one dimension, see checked(); null keys, ids and vectors take no part. Repeated ids count once
    for each distinct vector. An empty input gives an empty result.
    """
    rows = df.select(key, F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna().distinct()
    own = _chunked(rows, key, "id", chunk)
    others = F.transform(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda c: F.struct(F.least(c, F.col("_own")).alias("i"), F.greatest(c, F.col("_own")).alias("j")))
    keyed = own.select(key, "id", "v", "_own", F.explode(others).alias("c")).select(key, "id", "v", "_own", "c.i", "c.j")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left = group[group["_own"] == group["i"]]
        right = left if group["i"].iat[0] == group["j"].iat[0] else group[group["_own"] == group["j"]]
        if not len(left) or not len(right):
            return pd.DataFrame({key: [], "a": [], "b": [], "score": []})
        s = unit_rows(left["v"]) @ unit_rows(right["v"]).T
        r, c = np.nonzero(s > least)
        x, y = left["id"].to_numpy()[r], right["id"].to_numpy()[c]
        keep = x < y if left is right else x != y
        a, b = np.where(x < y, x, y)[keep], np.where(x < y, y, x)[keep]
        return pd.DataFrame({key: group[key].iat[0], "a": a, "b": b, "score": s[r, c][keep]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return keyed.groupBy(key, "i", "j").applyInPandas(run, f"{key} {kinds[key]}, a {kinds['id']}, b {kinds['id']}, score double")


def cross_above(a: DataFrame, b: DataFrame, key: str, id_col: str, vector: str, least: float, chunk: int = CHUNK) -> DataFrame:
    """(<key>, a, b, score): pairs of a row of ``a`` and one of ``b`` of the same key whose cosine is above ``least``."""
    sides = [_chunked(df.select(key, F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna().distinct(), key, "id", chunk) for df in (a, b)]
    counts = [s.select(key, "_chunks").distinct().withColumnRenamed("_chunks", "_other") for s in sides]
    parts = []
    for side, own, other in ((0, sides[0], counts[1]), (1, sides[1], counts[0])):
        spread = own.join(other, key).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
        i, j = ("_own", "_c") if side == 0 else ("_c", "_own")
        parts.append(spread.select(key, "id", "v", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["side"] == 0], group[group["side"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({key: [], "a": [], "b": [], "score": []})
        s = unit_rows(left["v"]) @ unit_rows(right["v"]).T
        r, c = np.nonzero(s > least)
        return pd.DataFrame({key: group[key].iat[0], "a": left["id"].to_numpy()[r], "b": right["id"].to_numpy()[c], "score": s[r, c]})

    kinds = {f.name: f.dataType.simpleString() for f in parts[0].schema}
    return parts[0].unionByName(parts[1]).groupBy(key, "i", "j").applyInPandas(run, f"{key} {kinds[key]}, a {kinds['id']}, b {kinds['id']}, score double")


def guarded(df: DataFrame, cap: int, what: str) -> DataFrame:
    """The frame, unless it has more than ``cap`` rows: then an error, as the caller asked to be told. Counting stops at the cap."""
    if df.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} {what}")
    return df
