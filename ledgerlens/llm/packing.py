"""Items packed into containers of fixed capacity: shortest-pack-first over the histogram of lengths.

The packing is planned on the driver from the histogram alone, which has at most ``capacity`` rows however
many items there are. The plan is a list of patterns, each with a count of containers. Items meet the plan
again by their rank among those of equal length, through a table whose size depends on the plan only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tokens import FILE, FOLDER, token_count
from ledgerlens.runtime import Scratch

CAPACITY = 2048


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (containers, {length: items in each}).

    Lengths are placed longest first, each into the packs that are filled least, provided that it fits; a
    container is opened only where none has the space, and is filled before the next. Packs of one filling and content are held as one
    pattern with a count, so the work depends on the capacity and not on the items.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    free: dict[int, list[list]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s in free if s >= length), default=None)
            if space is None:
                each = min(capacity // length, left)
                count, pattern = left // each, {length: each}
                free.setdefault(capacity - length * each, []).append((count, pattern))
                left -= count * each
                continue
            count, pattern = free[space].pop()
            if not free[space]:
                del free[space]
            used = min(count, left)
            if used < count:
                free.setdefault(space, []).append((count - used, pattern))
            free.setdefault(space - length, []).append((used, pattern | {length: pattern.get(length, 0) + 1}))
            left -= used
    return [p for space in sorted(free) for p in free[space]]


def slots(patterns: list[tuple[int, dict[int, int]]], histogram: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, bucket, rank_from, rank_to, container, each): items of a length with rank in the range fill containers in order, ``each`` in one.

    Ranks of a length are also divided into as many buckets as it has ranges, so that an item meets about
    two ranges and not all of its length's.
    """
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    done, first = {}, 0
    for count, pattern in patterns:
        for length, each in pattern.items():
            start = done.get(length, 0)
            done[length] = start + count * each
            ranges.setdefault(length, []).append((start, start + count * each, first, each))
        first += count
    rows = []
    for length, own in ranges.items():
        width = bucket_width(histogram[length], len(own))
        rows += [(length, b, lo, hi, c, each) for lo, hi, c, each in own for b in range(lo // width, (hi - 1) // width + 1)]
    return rows


def bucket_width(items: int, ranges: int) -> int:
    """Ranks in a bucket."""
    return max(1, items // ranges)


def ranked(items: DataFrame, scratch: Scratch, *order: str) -> DataFrame:
    """``items`` with ``rank`` from 0 among those of equal ``length``, in the given order.

    No task gathers a length: rows are sorted by range, and each range's rows of a length begin where those
    of the ranges before it end.
    """
    laid = scratch.cut(
        items.repartitionByRange("length", *order).sortWithinPartitions("length", *order).withColumn("at", F.monotonically_increasing_id()), "laid"
    )
    part = F.shiftright("at", 33).alias("part")
    counts = laid.groupBy("length", part).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    # At most one row for each length and one more for each partition.
    return laid.withColumn("part", part).join(F.broadcast(starts), ["length", "part"]).select(*items.columns, (F.col("at") - F.col("first") + F.col("before")).alias("rank"))


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_folder: str = FOLDER, tokenizer_file: str = FILE
) -> DataFrame:
    """The container of each document, or of each piece of a document that is longer than a container.

    Output: (<id_col>, piece_no from 1, token_start, n_tokens, container_id from 0). A document of more than
    ``capacity`` tokens fills containers of its own with its first pieces and its rest is packed as an item.
    Every row is an item, repeated and null ids too. Documents without tokens (null, empty) need no space:
    they are spread over the containers in turn, or lie in container 0 where there are no others. Other
    columns are ignored. Equal lengths are told apart by id, so a rerun gives the same containers.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    counted = scratch.cut(df.select(F.col(id_col).alias("id"), token_count(spark, text_col, tokenizer_folder, tokenizer_file).alias("tokens")), "tokens")
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0)).cast("int")
    start = F.col("k").cast("long") * capacity
    items = counted.select("id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("k")).select(
        "id", "k", start.alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - start).alias("length")
    )
    placed = ranked(items, scratch, "id", "k")
    histogram = {r.length: r.n for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    filled = {k: v for k, v in histogram.items() if k}
    patterns = shortest_pack_first(filled, capacity)
    total = sum(count for count, _ in patterns)
    rows = slots(patterns, filled)
    per_length: dict[int, int] = {}
    for _, pattern in patterns:
        for length in pattern:
            per_length[length] = per_length.get(length, 0) + 1
    widths = [(n, bucket_width(filled[n], per_length[n])) for n in per_length]
    plan = F.broadcast(spark.createDataFrame(rows, "length long, bucket long, rank_from long, rank_to long, first long, each long"))
    wide = F.broadcast(spark.createDataFrame(widths, "length long, width long"))
    found = (
        placed.join(wide, "length")
        .withColumn("bucket", F.floor(F.col("rank") / F.col("width")).cast("long"))
        .join(plan, ["length", "bucket"])
        .filter((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .withColumn("container_id", F.col("first") + F.expr("(rank - rank_from) div each"))
    )
    blank = placed.filter("length = 0").withColumn("container_id", F.col("rank") % max(total, 1))
    cols = [F.col("id").alias(id_col), (F.col("k") + 1).alias("piece_no"), "token_start", F.col("length").alias("n_tokens"), "container_id"]
    return found.select(*cols).unionByName(blank.select(*cols))
