"""Tables of a case in a folder: each read as a frame, each replaced whole by a new one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.schema import TABLES, empty, schema_of
from ledgerlens.sources.tables import with_columns_of


class Store:
    """Parquet tables in a folder that all executors share. A table that isn't there yet is empty.

    A table is written beside the old one and takes its place by renames, so that a write that fails leaves the old one.
    Tables written by an earlier schema get new columns as nulls.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        path = self._path(name)
        if not self._files(path).exists(path):
            return empty(self.spark, name)
        return with_columns_of(self.spark.read.parquet(f"{self.folder}/{name}"), schema_of(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replace a table; the new one is read back. The frame may have been made from the old table."""
        known = [c for c in schema_of(name).fieldNames() if c in df.columns]
        new, old, path = self._path(f".{name}-{uuid.uuid4().hex[:8]}"), self._path(f".{name}-old-{uuid.uuid4().hex[:8]}"), self._path(name)
        with_columns_of(df.select(*known), schema_of(name)).write.parquet(new.toString())
        files = self._files(path)
        if files.exists(path):
            files.rename(path, old)
        files.rename(new, path)
        files.delete(old, True)
        self.spark.catalog.clearCache()
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        return self.write(name, self.read(name).unionByName(with_columns_of(df, schema_of(name))))
