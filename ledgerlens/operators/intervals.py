"""Continuous periods and gaps of overlapping intervals, through run bitmaps of time shards.

Time is discretised to whole units (milliseconds). The units of one entity are divided into shards of
``shard_units``. Each interval sets a run of units in its first and last shard; the shards that it covers
wholly are kept as one run of shards, so that a long interval costs no more rows than a short one. The union
of an entity's runs in a shard is its compressed run bitmap: an array of disjoint runs in order. Set runs
and clear runs are read from the bitmaps, and stitched at the shards' borders through one row a shard.

No task ever holds an entity's rows: runs are combined by (entity, shard, first unit) before the shuffle, so
a group holds at most ``shard_units`` rows. The stitching sees one row (first and last unit) for each shard, in two
levels: within blocks of shards, and over one row for each block. The bitmaps themselves stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import following, running_max
from ledgerlens.runtime import Scratch

#: 2^20 ms are about 17 minutes; a block of shards is about eight days.
SHARD_UNITS, BLOCK_SHARDS = 1 << 20, 700


def to_units(df: DataFrame, entity: str, start: str, end: str, per_unit: float = 1000.0) -> DataFrame:
    """Rows (entity, s, e) in whole units, rounded half away from zero.

    Dropped: a null entity, a null, NaN or infinite time, an end not after its start, and an interval that
    is empty after rounding.
    """
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    limit = F.lit(9e15 / per_unit)
    good = F.col(entity).isNotNull() & (e > s) & ~F.isnan(s) & ~F.isnan(e) & (F.abs(s) < limit) & (F.abs(e) < limit)
    rows = df.filter(good).select(
        F.col(entity).alias("entity"), F.round(s * per_unit).cast("long").alias("s"), F.round(e * per_unit).cast("long").alias("e")
    )
    return rows.filter(F.col("e") > F.col("s"))


def run_bitmaps(units: DataFrame, shard_units: int = SHARD_UNITS) -> tuple[DataFrame, DataFrame]:
    """The bitmaps (entity, shard, runs) of partly covered shards, and the runs of full shards (entity, lo, hi).

    ``runs`` is an array of (s, e): disjoint, not touching, in order, in absolute units.
    """
    size = F.lit(shard_units)
    first, last = F.floor(F.col("s") / size).cast("long"), F.floor((F.col("e") - 1) / size).cast("long")
    rows = units.withColumn("a", first).withColumn("b", last)
    border_b, border_a = F.col("b") * size, (F.col("a") + 1) * size
    same = F.col("a") == F.col("b")
    # A part that fills its shard stays with the parts; only the shards between first and last are full runs.
    parts = F.when(same, F.array(F.struct(F.col("a").alias("shard"), F.col("s"), F.col("e")))).otherwise(
        F.array(F.struct(F.col("a").alias("shard"), F.col("s"), border_a.alias("e")), F.struct(F.col("b").alias("shard"), border_b.alias("s"), F.col("e")))
    )
    pieces = rows.select("entity", F.explode(parts).alias("p")).select("entity", "p.shard", "p.s", "p.e")
    full = (
        rows.filter(F.col("b") - F.col("a") > 1)
        .select("entity", border_a.alias("lo"), border_b.alias("hi"))
        .groupBy("entity", "lo")
        .agg(F.max("hi").alias("hi"))
    )
    return union_runs(pieces.select("entity", "shard", F.array(F.struct("s", "e")).alias("runs"))), full


def union_bitmaps(a: DataFrame, b: DataFrame) -> tuple[DataFrame, None]:
    """The union of two frames of bitmaps over the same shards, for incremental loads; it has no full runs of its own."""
    return union_runs(a.unionByName(b)), None


def union_runs(parts: DataFrame) -> DataFrame:
    """(entity, shard, runs): the union of all bitmaps of a shard, be they of single intervals or unions themselves."""
    rows = parts.select("entity", "shard", F.explode("runs").alias("r")).select("entity", "shard", "r.s", "r.e")
    longest = rows.groupBy("entity", "shard", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy("entity", "shard").orderBy("s")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = longest.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("entity", "shard", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy("entity", "shard").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))


def stitch(maps: DataFrame, full: DataFrame, shard_units: int = SHARD_UNITS, block_shards: int = BLOCK_SHARDS) -> DataFrame:
    """Rows (entity, s, e, prev_end, next_start) of set runs, cut only at shards' borders.

    ``prev_end`` and ``next_start`` are those of the entity's neighbouring runs; runs inside a full run are gone.
    """
    ends = maps.select("entity", "shard", F.col("runs")[0]["s"].alias("lo"), F.element_at("runs", -1)["e"].alias("hi"))
    rows = ends.unionByName(full.select("entity", F.lit(None).cast("long").alias("shard"), "lo", "hi"))
    rows = rows.withColumn("block", F.floor(F.col("lo") / (shard_units * block_shards)).cast("long"))
    # At equal starts the longer comes first, and a full run before a shard with the same ends, so what it holds is seen to lie inside it.
    kept = running_max(rows, ["entity"], "block", [F.col("lo"), F.col("hi").desc(), F.col("shard").asc_nulls_first()], "hi", "reach").filter(F.col("reach").isNull() | (F.col("hi") > F.col("reach")))
    # Full runs may overlap one another: each keeps only what lies beyond the ones before.
    kept = kept.withColumn("lo", F.when(F.col("shard").isNull(), F.greatest("lo", F.coalesce("reach", "lo"))).otherwise(F.col("lo")))
    kept = following(kept.withColumn("block", F.floor(F.col("lo") / (shard_units * block_shards)).cast("long")), ["entity"], "block", F.col("lo"), "lo", "after")
    whole = kept.filter("shard is null").select("entity", F.col("lo").alias("s"), F.col("hi").alias("e"), F.col("reach").alias("prev_end"), F.col("after").alias("next_start"))
    inside = maps.join(kept.filter("shard is not null").select("entity", "shard", "reach", "after"), ["entity", "shard"])
    flat = inside.select("entity", "reach", "after", "runs", F.posexplode("runs").alias("i", "r"))
    prev_end = F.when(F.col("i") == 0, F.col("reach")).otherwise(F.try_element_at("runs", F.col("i"))["e"])
    next_start = F.when(F.col("i") == F.size("runs") - 1, F.col("after")).otherwise(F.try_element_at("runs", F.col("i") + 2)["s"])
    return whole.unionByName(flat.select("entity", F.col("r.s").alias("s"), F.col("r.e").alias("e"), prev_end.alias("prev_end"), next_start.alias("next_start")))


def periods_and_gaps(
    df: DataFrame, entity: str = "source_file_id", start: str = "start_time", end: str = "end_time", per_unit: float = 1000.0, shard_units: int = SHARD_UNITS, block_shards: int = BLOCK_SHARDS
) -> DataFrame:
    """The maximal covered periods of each entity and the gaps between them.

    Input: any frame with the three columns; other columns are ignored, whatever their names. Output:
    (<entity>, period_kind, start_ms, end_ms) with ``covered`` and ``gap`` rows; touching intervals join, an
    entity without a usable interval has no row, and an empty input gives an empty result. Repeated rows and
    ties change nothing, as a union doesn't count. See to_units() for the rows that don't count.
    """
    maps, full = run_bitmaps(to_units(df, entity, start, end, per_unit), shard_units)
    runs = stitch(Scratch(df.sparkSession).cut(maps, "bitmaps"), full, shard_units, block_shards)
    begins = F.col("prev_end").isNull() | (F.col("s") > F.col("prev_end"))
    ends = F.col("next_start").isNull() | (F.col("next_start") > F.col("e"))
    edges = runs.withColumn("begins", begins).withColumn("ends", ends).filter(F.col("begins") | F.col("ends"))
    # A period cut at borders has one run that begins it and one that ends it: the next in order.
    open_ = edges.filter(F.col("begins") != F.col("ends")).withColumn("block", F.floor(F.col("s") / (shard_units * block_shards)).cast("long"))
    halves = following(open_, ["entity"], "block", F.col("s"), "e", "close").filter("begins").drop("block")
    whole = edges.filter(F.col("begins") & F.col("ends")).withColumn("close", F.col("e"))
    periods = whole.unionByName(halves)
    gap = F.struct(F.lit("gap").alias("period_kind"), F.col("prev_end").alias("start_ms"), F.col("s").alias("end_ms"))
    covered = F.struct(F.lit("covered").alias("period_kind"), F.col("s").alias("start_ms"), F.col("close").alias("end_ms"))
    both = F.when(F.col("prev_end").isNull(), F.array(covered)).otherwise(F.array(covered, gap))
    return periods.select(F.col("entity").alias(entity), F.explode(both).alias("p")).select(entity, "p.*")
