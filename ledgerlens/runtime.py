"""Lineage cuts in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which the key is treated as hot.
HOT_ROWS = 200_000
#: Most hot keys that are ever broadcast; HOT_ROWS rises with the table so that this holds.
MAX_HOT_KEYS = 10_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-"), "ledgerlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where a local master has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ledgerlens-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_cleaned: set[str] = set()


def _clean_at_exit(spark: SparkSession) -> None:
    app = _app_dir(spark)
    if app not in _cleaned:
        _cleaned.add(app)

        def run() -> None:
            try:
                _delete(spark, app)
            except Exception:  # the session is gone; the folder stays for its owner to clear
                pass

        atexit.register(run)


class Scratch:
    """Tables written once and read back: a cut in the lineage that outlives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` under the shared folder and return a scan of it."""
        _clean_at_exit(self.spark)
        path = f"{_app_dir(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._scratch_path = path  # keeps the id from being reused while the frame lives
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by cut() that no later plan reads."""
        path = self.paths.pop(id(df), None)
        if path:
            _delete(self.spark, path)


def hot_rows_for(rows: int, hot_rows: int | None = None) -> int:
    """Rows from which a key of a table of that many rows is hot; at most MAX_HOT_KEYS keys can reach it."""
    return max(HOT_ROWS if hot_rows is None else hot_rows, -(-rows // MAX_HOT_KEYS), 1)


def lookup_join(
    left: DataFrame, right: DataFrame, key: str | list[str], how: str = "left", rows: int | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Join ``left`` (a cut table) to ``right``, unique on ``key``, without sending a hot key to one task.

    Keys with more than ``hot_rows`` rows of ``left`` are joined through a broadcast of their rows of
    ``right`` alone; there are at most MAX_HOT_KEYS of them, as the limit rises with the table. All other
    rows are joined by shuffle. ``rows`` is the count of ``left`` where it is known already.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = left.count() if rows is None else rows
    limit = hot_rows_for(rows, hot_rows)
    if rows <= limit:
        return left.join(right, keys, how)
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)
    found = hot.limit(MAX_HOT_KEYS + 1).collect()
    if not found:
        return left.join(right, keys, how)
    names = left.sparkSession.createDataFrame([tuple(r) for r in found], hot.schema)
    hot_right = right.join(F.broadcast(names), keys, "left_semi")
    few, many = left.join(F.broadcast(names), keys, "left_anti"), left.join(F.broadcast(names), keys, "left_semi")
    return few.join(right, keys, how).unionByName(many.join(F.broadcast(hot_right), keys, how))
