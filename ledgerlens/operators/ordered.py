"""Neighbours and running maxima in order of a key's rows, in two levels, so that no task sees all rows of a hot key.

Rows of a key are divided into blocks of neighbours (``block`` rises with the order). Windows run within a block, and
over one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max(rows: DataFrame, keys: list[str], block: str, order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the largest ``value`` of the key's rows before each; null where there is none."""
    before = F.max(value).over(Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    earlier = F.max("__m").over(Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(*keys, block).agg(F.max(value).alias("__m")).select(*keys, block, earlier.alias("__before"))
    return rows.withColumn("__in", before).join(blocks, [*keys, block]).withColumn(name, F.greatest("__in", "__before")).drop("__in", "__before")


def following(rows: DataFrame, keys: list[str], block: str, order: Column, value: str, name: str) -> DataFrame:
    """``name``: ``value`` of the key's next row; null after the last."""
    after = F.lead(value).over(Window.partitionBy(*keys, block).orderBy(order))
    later = F.lead("__f").over(Window.partitionBy(*keys).orderBy(block))
    blocks = rows.groupBy(*keys, block).agg(F.min_by(value, order).alias("__f")).select(*keys, block, later.alias("__later"))
    return rows.withColumn("__in", after).join(blocks, [*keys, block]).withColumn(name, F.coalesce("__in", "__later")).drop("__in", "__later")


def next_marked(rows: DataFrame, keys: list[str], block: str, order: list[Column], marked: str, name: str) -> DataFrame:
    """``name``: the first non-null ``marked`` at or after each row."""
    near = F.first(marked, ignorenulls=True).over(Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    later = F.first("__f", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(block).rowsBetween(1, Window.unboundedFollowing))
    first = F.min_by(marked, F.when(F.col(marked).isNotNull(), F.struct(*order)))
    blocks = rows.groupBy(*keys, block).agg(first.alias("__f")).select(*keys, block, later.alias("__later"))
    return rows.withColumn("__in", near).join(blocks, [*keys, block]).withColumn(name, F.coalesce("__in", "__later")).drop("__in", "__later")
