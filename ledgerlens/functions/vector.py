"""Vectors as arrays, computed in double by Spark's array functions, element by element: for one query against many rows. Pairs go through operators.vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zeros."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def cosine_to(a: Column, query: list[float]) -> Column:
    """The cosine to one known vector: it is normalised once, on the driver."""
    size = sum(float(x) ** 2 for x in query) ** 0.5
    unit_query = F.array(*[F.lit(float(x) / size if size else 0.0) for x in query])
    own = norm(a)
    return F.when(own > 0, dot(a, unit_query) / own).otherwise(0.0)


def unit(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(<key>, centroid): the mean by element of each group, of length one. Elements are averaged before any vector is gathered."""
    means = df.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda s: s["m"]).alias("centroid")).withColumn("centroid", unit(F.col("centroid")))
