"""Components, clusters and matchings of small to middling graphs of evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.vectors import pairs_above, unit_rows
from ledgerlens.runtime import Scratch, lookup_join

#: Ends of edges that one task links.
ONE_TASK = 200_000


def _smallest_linked(us: list, vs: list) -> pd.DataFrame:
    """Each node's smallest linked node, by joining trees."""
    up = {n: n for n in {*us, *vs}}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for u, v in zip(us, vs):
        a, b = root(u), root(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    return pd.DataFrame({"node": list(up), "component": [root(n) for n in up]})


def components(edges: DataFrame, a: str, b: str, rounds: int = 100, one_task: int | None = None) -> DataFrame:
    """(node, component): each node's smallest linked node, by minima of neighbours and pointer jumps until unchanged.

    A hub's edges are spread over tasks. At most ``one_task`` edges (each counted from both ends) are linked in a single task,
    which gives the same result without rounds.
    """
    scratch = Scratch(edges.sparkSession)
    both = scratch.cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).distinct(), "both")
    size = both.count()
    if size <= (ONE_TASK if one_task is None else one_task):
        kind = both.schema["u"].dataType.simpleString()
        return both.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda g: _smallest_linked(g["u"].tolist(), g["v"].tolist()), f"node {kind}, component {kind}")
    label = scratch.cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("component")), "label")
    for _ in range(rounds):
        near = lookup_join(both, label.select(F.col("node").alias("v"), "component"), "v", "inner", size).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = scratch.cut(label.join(near, "node").select("node", F.least("component", "near").alias("component")), "step")
        jump = lookup_join(step, label.select(F.col("node").alias("component"), F.col("component").alias("up")), "component")
        new = scratch.cut(jump.select("node", F.least("component", F.coalesce("up", "component")).alias("component")), "label")
        same = new.join(label.withColumnRenamed("component", "old"), "node").filter("component <> old").isEmpty()
        scratch.drop(label)
        scratch.drop(step)
        label = new
        if same:
            return label
    raise RuntimeError("no fixed point")


def linkage(x: np.ndarray, cut: float) -> np.ndarray:
    """Group numbers of unit vectors: average linkage of cosine distances below ``cut``, by chains of nearest neighbours (quadratic)."""
    n = len(x)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, alive, group = np.ones(n), np.ones(n, bool), np.arange(n)
    chain: list[int] = []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        i = chain[-1]
        j = int(np.where(alive, d[i], np.inf).argmin())
        if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
            j = chain[-2]
        if d[i, j] >= cut:
            # Nothing is nearer to i: it stays as it is, and so does what led to it.
            alive[i] = False
            chain.pop()
            continue
        if len(chain) > 1 and j == chain[-2]:
            del chain[-2:]
            keep, gone = min(i, j), max(i, j)
            mean = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[keep], d[:, keep] = mean, mean
            d[keep, keep] = np.inf
            size[keep] += size[gone]
            alive[gone] = False
            d[gone], d[:, gone] = np.inf, np.inf
            group[group == gone] = keep
        else:
            chain.append(j)
    return group


def average_linkage(df: DataFrame, scope: str, id_col: str, vector: str, cut: float = 0.4) -> DataFrame:
    """(<scope>, <id_col>, cluster): agglomerative clusters of cosine distance, merged while their average distance is below the cut.

    Two clusters merge only where some pair of theirs is nearer than the cut, so the components of such pairs are grouped one
    by one: a task holds a component, not a scope. A vector without a near one is a cluster of its own.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(F.concat_ws("\u0001", F.col(scope).cast("string"), F.col(id_col).cast("string")).alias("_row"), scope, id_col, vector).dropna()
    near = pairs_above(rows, scope, "_row", vector, 1 - cut)
    grouped = components(near, "a", "b").withColumnRenamed("node", "_row")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(id_col, ignore_index=True)
        label = linkage(unit_rows(group[vector]), cut)
        return pd.DataFrame({scope: group[scope], id_col: group[id_col], "cluster": group[id_col].to_numpy()[label]})

    clustered = rows.join(grouped, "_row").groupBy("component").applyInPandas(run, f"{scope} {kinds[scope]}, {id_col} {kinds[id_col]}, cluster {kinds[id_col]}")
    alone = rows.join(grouped, "_row", "left_anti").select(scope, id_col, F.col(id_col).alias("cluster"))
    return clustered.unionByName(alone)


def density_clusters(df: DataFrame, scope: str, id_col: str, vector: str, eps: float = 0.4, min_samples: int = 2) -> DataFrame:
    """(<id_col>, cluster): dense clusters of cosine distance within ``eps`` (the bound is in), the smallest core's id; noise isn't in the result.

    A core has ``min_samples`` vectors within reach, itself among them; cores in reach of one another are a cluster, and what is
    in reach of a core belongs to the nearest one's, the smallest id first.
    """
    near = Scratch(df.sparkSession).cut(pairs_above(df, scope, id_col, vector, float(np.nextafter(1 - eps, 0))), "near")
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    both = near.select(ends.alias("e"), "score").select("e.x", "e.y", "score")
    cores = both.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") + 1 >= min_samples).select("x")
    inside = both.join(cores, "x", "left_semi").join(cores.withColumnRenamed("x", "y"), "y", "left_semi")
    linked = components(inside.filter("x < y"), "x", "y").select(F.col("node").alias("x"), F.col("component").alias("cluster"))
    labels = cores.join(linked, "x", "left").select("x", F.coalesce("cluster", "x").alias("cluster"))
    border = both.join(cores, "x", "left_anti").join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min_by("cluster", F.struct((-F.col("score")).alias("far"), "y")).alias("cluster"))
    return labels.unionByName(border).withColumnRenamed("x", id_col)


def greedy_matching(pairs: DataFrame, scope: str, a: str, b: str, weight: str, least: float) -> DataFrame:
    """The pairs of each scope taken one to one by falling weight above ``least``; ties go by the names."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, keep = set(), set(), []
        for r in group.sort_values([weight, a, b], ascending=[False, True, True]).itertuples(index=False):
            x, y = getattr(r, a), getattr(r, b)
            if getattr(r, weight) > least and x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                keep.append(r)
        return pd.DataFrame(keep, columns=group.columns)

    return pairs.groupBy(scope).applyInPandas(run, pairs.schema)
