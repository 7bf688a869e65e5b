"""Groups of records that pairwise matches link, by alternating large-star and small-star rewrites.

Each node (a kind and an id) gets a 64-bit number in the order of (kind, id), so that the smallest number of
a component is that of its smallest id and the rounds shuffle 16 bytes an edge. An edge is kept as
(hi, lo) with hi > lo. A large-star links each node's larger neighbours to its smallest neighbour, a
small-star links a node's smaller neighbours to the smallest of them; both keep the components. The rounds end
when the edges form stars: every node that isn't a root has one edge, to a root. That takes a number of rounds
in the order of the logarithm of the largest diameter.

A hub that holds a large part of all edges never meets in one task: minima combine on the map side and reach
the hub's edges by lookup_join().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.runtime import Scratch, lookup_join

MAX_ROUNDS = 200


def clean_pairs(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """Distinct rows (kind, a, b) with a <= b; kinds are trimmed and upper-cased, a null kind becomes ''.

    Rows with a null or blank end are dropped, a pair of a node with itself stays.
    """
    ends = [F.col(c).cast("string") for c in (a, b)]
    filled = [F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0 for c in ends]
    kinds = F.upper(F.regexp_replace(F.coalesce(F.col(kind).cast("string"), F.lit("")), r"(?U)^\s+|\s+$", ""))
    rows = df.filter(filled[0] & filled[1]).select(kinds.alias("kind"), F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    return rows.distinct()


def number_nodes(pairs: DataFrame) -> DataFrame:
    """Rows (kind, node, n): numbers that rise with (kind, node)."""
    nodes = pairs.select("kind", F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.repartitionByRange("kind", "node").sortWithinPartitions("kind", "node").withColumn("n", F.monotonically_increasing_id())


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("hi").agg(F.min("lo").alias("least"))


def large_star(edges: DataFrame, rows: int, hot_rows: int | None = None) -> DataFrame:
    """Each edge's larger end to the smallest neighbour of its smaller end."""
    least = _minima(edges).withColumnRenamed("hi", "lo")
    return lookup_join(edges, least, "lo", "left", rows, hot_rows).select("hi", F.coalesce("least", "lo").alias("lo"))


def small_star(edges: DataFrame, rows: int, hot_rows: int | None = None) -> DataFrame:
    """Each node and its smaller neighbours to the smallest of these."""
    both = lookup_join(edges, _minima(edges), "hi", "left", rows, hot_rows)
    links = F.array(F.struct(F.col("hi"), F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))
    return both.select(F.explode(links).alias("e")).select("e.*").filter("hi <> lo").distinct()


def _are_stars(edges: DataFrame) -> bool:
    role = F.explode(F.array(F.struct(F.col("hi").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")), F.struct(F.col("lo").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root"))))
    seen = edges.select(role.alias("r")).select("r.*").groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return seen.filter((F.col("child") > 1) | ((F.col("child") == 1) & (F.col("root") == 1))).isEmpty()


def star_forest(scratch: Scratch, edges: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Rewrite edges (hi, lo) until they are stars round the smallest node of each component."""
    for _ in range(MAX_ROUNDS):
        large = scratch.cut(large_star(edges, edges.count(), hot_rows), "large")
        small = scratch.cut(small_star(large, large.count(), hot_rows), "small")
        scratch.drop(large)
        scratch.drop(edges)
        edges = small
        if _are_stars(edges):
            return edges
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")


def connected_groups(df: DataFrame, a: str = "node_a_id", b: str = "node_b_id", kind: str = "alignment_type", hot_rows: int | None = None) -> DataFrame:
    """One row (<kind>, group_id, node_id) for each kind and each node in a pair of that kind.

    group_id is the smallest node id of all that the kind's pairs link to the node, itself included.
    Kinds are grouped separately and are given trimmed and upper-cased (null as ''). Pairs with a null or
    blank end don't count; repeated and mirrored pairs change nothing; a node paired only with itself is a
    group of one. An empty input gives an empty result. Other columns of ``df`` are ignored. A scan of
    lineage-cut tables is returned.
    """
    scratch = Scratch(df.sparkSession)
    pairs = scratch.cut(clean_pairs(df, a, b, kind), "pairs")
    nodes = scratch.cut(number_nodes(pairs), "nodes")
    links = pairs.filter("a <> b")
    first = scratch.cut(lookup_join(links, nodes.select("kind", F.col("node").alias("a"), F.col("n").alias("lo")), ["kind", "a"], "inner", hot_rows=hot_rows).select("kind", "b", "lo"), "half")
    edges = lookup_join(first, nodes.select("kind", F.col("node").alias("b"), F.col("n").alias("hi")), ["kind", "b"], "inner", hot_rows=hot_rows).select("hi", "lo")
    edges = scratch.cut(edges, "edges")
    scratch.drop(first)
    scratch.drop(pairs)
    stars = star_forest(scratch, edges, hot_rows).select(F.col("hi").alias("n"), F.col("lo").alias("root"))
    labelled = scratch.cut(nodes.join(stars, "n", "left").select("kind", "node", F.coalesce("root", "n").alias("root")), "labelled")
    roots = nodes.select(F.col("n").alias("root"), F.col("node").alias("group_id"))
    return lookup_join(labelled, roots, "root", "inner", hot_rows=hot_rows).select(F.col("kind").alias(kind), "group_id", F.col("node").alias("node_id"))
