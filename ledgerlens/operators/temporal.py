"""Joins and windows over time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import next_marked, running_max


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def overlap_join(a: DataFrame, b: DataFrame, key: str, start: str, end: str, bucket: float = 60.0, touching: bool = False) -> DataFrame:
    """Pairs of one key whose intervals overlap, by buckets of time, each pair once: columns of b get the prefix ``b_``.

    A pair meets in the bucket in which the later of the two begins, so a hot key is spread over its buckets.
    """

    def cut(df: DataFrame) -> DataFrame:
        first, last = F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)
        return df.filter(F.col(end) >= F.col(start)).withColumn("_slot", F.explode(F.sequence(first, last)))

    left = cut(a)
    right = cut(b).select([F.col(c).alias(f"b_{c}") for c in [*b.columns, "_slot"]])
    meet = (F.col(key) == F.col(f"b_{key}")) & (F.col("_slot") == F.col("b__slot"))
    later = F.floor(F.greatest(F.col(start), F.col(f"b_{start}")) / bucket) == F.col("_slot")
    shared = overlap(F.col(start), F.col(end), F.col(f"b_{start}"), F.col(f"b_{end}"))
    return left.join(right, meet & later).filter(shared >= 0 if touching else shared > 0).withColumn("overlap_sec", shared).drop("_slot", "b__slot")


def band_join(df: DataFrame, key: str, at: str, band: float, id_col: str) -> DataFrame:
    """Pairs (a, b) of one key, a's id smaller, whose times differ by at most ``band``; the bound is in."""
    slots = df.withColumn("_slot", F.floor(F.col(at) / band))
    near = slots.withColumn("_slot", F.explode(F.array(F.col("_slot") - 1, F.col("_slot"), F.col("_slot") + 1)))
    b = near.select([F.col(c).alias(f"b_{c}") for c in near.columns])
    same = (F.col(key) == F.col(f"b_{key}")) & (F.col("_slot") == F.col("b__slot")) & (F.col(id_col) < F.col(f"b_{id_col}"))
    return slots.join(b, same).filter(F.abs(F.col(at) - F.col(f"b_{at}")) <= band).drop("_slot", "b__slot")


def asof_forward(targets: DataFrame, rows: DataFrame, key: str, at: str, value: str, block: float = 3600.0) -> DataFrame:
    """Each target (key, at) with the first row at or after it; targets without one are dropped. Windows span ``block`` of time, not a key."""
    both = targets.select(key, at, F.lit(None).cast(rows.schema[value].dataType).alias(value), F.lit(0).alias("_kind")).unionByName(rows.select(key, at, value, F.lit(1).alias("_kind")))
    row = F.when(F.col("_kind") == 1, F.struct(F.col(at).alias("found_at"), F.col(value).alias("found")))
    cut = both.withColumn("_block", F.floor(F.col(at) / block)).withColumn("_mark", row)
    found = next_marked(cut, [key], "_block", [F.col(at), F.col("_kind"), F.col(value)], "_mark", "_row")
    return found.filter((F.col("_kind") == 0) & F.col("_row").isNotNull()).select(key, at, "_row.*")


def fixed_windows(df: DataFrame, key: str, duration: str, width: float) -> DataFrame:
    """Windows of ``width`` over each duration, the last one short; one full window where the duration isn't positive."""
    count = F.when(F.col(duration) > 0, F.ceil(F.col(duration) / width)).otherwise(1).cast("int")
    rows = df.select(key, duration, F.explode(F.sequence(F.lit(0), count - 1)).alias("window_no"))
    start = F.col("window_no") * F.lit(float(width))
    end = F.when(F.col(duration) > 0, F.least(start + width, F.col(duration))).otherwise(start + width)
    return rows.select(key, "window_no", start.alias("start_time"), end.alias("end_time"))


def windows_covered(df: DataFrame, keys: list[str], start: str, end: str, width: float) -> DataFrame:
    """The numbers of the windows that each key's intervals touch, each once."""
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1e-9) / width)
    return df.filter(F.col(end) > F.col(start)).select(*keys, F.explode(F.sequence(first, last)).alias("window_no")).distinct()


def moments(df: DataFrame, key: str, at: str, reach: float = 3.0, block: float = 3600.0) -> DataFrame:
    """(<key>, moment_start, size): times grouped with the first of their group while within ``reach`` of it.

    A time that is further than ``reach`` from the one before begins a group whatever came before, so the stretches between such
    times are grouped one by one; of each only the distinct times and their counts are gathered.
    """
    times = df.filter(F.col(at).isNotNull()).groupBy(key, at).agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col(at) / block))
    seen = running_max(times, [key], "_block", [F.col(at)], at, "_last")
    opens = seen.withColumn("_open", F.when(F.col("_last").isNull() | (F.col(at) - F.col("_last") > reach), F.col(at)))
    begun = running_max(opens, [key], "_block", [F.col(at)], "_open", "_before").withColumn("_stretch", F.coalesce("_open", "_before"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(at)
        starts, sizes = [], []
        for t, n in zip(group[at].tolist(), group["_n"].tolist()):
            if starts and t - starts[-1] <= reach:
                sizes[-1] += n
            else:
                starts.append(t)
                sizes.append(n)
        return pd.DataFrame({key: group[key].iat[0], "moment_start": starts, "size": sizes})

    kind = df.schema[key].dataType.simpleString()
    return begun.select(key, at, "_n", "_stretch").groupBy(key, "_stretch").applyInPandas(run, f"{key} {kind}, moment_start double, size int")
