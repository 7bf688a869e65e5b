"""Writes as new frames: upserts, inserts of what is absent, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order. Each task drops what it can before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_on_null: bool = False) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; nulls keep the old value where asked for."""
    both = old.alias("o").join(new.withColumn("_there", F.lit(1)).alias("n"), keys, "full_outer")
    there = F.col("n._there").isNotNull()
    rest = [c for c in old.columns if c not in keys]
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if keep_old_on_null else F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in rest])


def insert_pairs(old: DataFrame, new: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Pairs put in the order of their ids and added where the table has none with the same ``keys`` (a and b among them); the first of equal new ones stays."""
    ordered = new.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b)).drop(a, b).withColumnRenamed("_a", a).withColumnRenamed("_b", b)
    return insert_absent(old, ordered.filter(F.col(a) != F.col(b)).select(*old.columns), keys)


def counted_upsert(old: DataFrame, calls: DataFrame, keys: list[str], order: list[str], first: list[str], counter: str) -> DataFrame:
    """Rows by key with ``counter`` raised by one for each call; of ``first`` the oldest values stay: the table's, else those of the first call with one."""
    new = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_{c}") for c in first])
    both = old.join(new, keys, "full_outer")
    kept = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in first}
    kept[counter] = F.coalesce(counter, F.lit(0)) + F.coalesce("_n", F.lit(0))
    return both.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in old.columns])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a key that ``new`` has give way to those of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade(tables: dict[str, DataFrame], gone: dict[str, DataFrame], links: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """The tables without the rows that are ``gone`` and all that hang on them; links are (child, foreign key, parent), parents first."""
    lost = dict(gone)
    out = {name: df.join(lost[name], "id", "left_anti") if name in lost else df for name, df in tables.items()}
    for child, key, parent in links:
        if parent in lost:
            dead = tables[child].join(lost[parent].select(F.col("id").alias(key)), key, "left_semi").select("id").distinct()
            lost[child] = dead if child not in lost else lost[child].union(dead).distinct()
            out[child] = tables[child].join(lost[child], "id", "left_anti")
    return out
