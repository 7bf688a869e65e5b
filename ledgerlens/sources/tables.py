"""Scans of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NullType, StructType

#: Casts that lose nothing.
WIDER = {("int", "bigint"), ("float", "double"), ("int", "double"), ("smallint", "int"), ("timestamp_ntz", "timestamp")}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder: one parquet file or a directory of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def distinct_by_id(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """One row for each non-null ``id_col``; repeated ids keep the smallest values of ``cols`` column by column.

    Repeats of an id carry the same content, so which of them is kept matters only for dirty input, where
    the choice is at least the same on every run. Aggregation combines on the map side.
    """
    return df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*[F.min(c).alias(c) for c in cols])


def jdbc_table(spark: SparkSession, options: dict[str, str], name: str, split_by: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1) -> DataFrame:
    """A table of a database, read in parts by ranges of a column where one is named; options are those of config.jdbc_options()."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", name)
    if split_by:
        reader = reader.option("partitionColumn", split_by).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return reader.load()


def with_columns_of(df: DataFrame, schema: StructType) -> DataFrame:
    """The frame with the schema's columns in its order and types: missing ones null, others an error unless their type can be cast without loss."""
    unknown = [c for c in df.columns if c not in schema.fieldNames()]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            if not f.nullable:
                raise ValueError(f"column {f.name} is missing")
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        own = df.schema[f.name].dataType
        wider = (own.simpleString(), f.dataType.simpleString()) in WIDER
        if own != f.dataType and not wider and not isinstance(own, (ArrayType, StructType, NullType)):
            raise ValueError(f"column {f.name} is {own.simpleString()}, not {f.dataType.simpleString()}")
        out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)
