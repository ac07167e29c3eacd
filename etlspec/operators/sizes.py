"""Which key values are too frequent to leave to one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from etlspec.functions.canonical import quoted

SPLIT_ROWS = 4_000_000
MAX_LARGE = 65_536
# Key hashes a sketch follows. Its counts are off by at most 3.5 / 2**19 of all rows then, less than half of 1 / MAX_LARGE.
TRACKED = 3 << 17
# Sketches of tasks are combined in so many groups first.
COMBINED = 64


def large_groups(df: DataFrame, keys: Sequence[str], split_rows: int) -> tuple[pa.Table, int]:
    """The large groups, as (__key0, .., __rows), and the number of rows above which groups are large.

    A group is large above ``split_rows`` rows or above 1/MAX_LARGE of all rows,
    whichever is more, so there are fewer than MAX_LARGE. One job over the key
    columns fills a mergeable sketch of frequent key hashes, of fixed size, in
    each task; nothing is shuffled by key. Only the keys of hashes that may be
    frequent are then counted, in a second job.
    """
    likely, limit = _likely([(df, keys)], split_rows)[0]
    names = [f"__key{i}" for i in range(len(keys))]
    rows = df.select(*[quoted(k).alias(n) for k, n in zip(keys, names)])
    if not likely:
        return pa.table({"__rows": pa.array([], pa.int64())}), limit
    if keys:
        hashes = df.sparkSession.createDataFrame(pa.table({"__hash": likely}))
        rows = rows.join(F.broadcast(hashes), F.xxhash64(*names) == F.col("__hash"), "left_semi")
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__rows"))
    return sizes.filter(F.col("__rows") > limit).toArrow(), limit


def any_large(sides: Sequence[tuple[DataFrame, Sequence[str]]], split_rows: int) -> bool:
    """Whether a key of one of the frames may have a large group. One job for all of them."""
    return any(likely for likely, _ in _likely(sides, split_rows))


def _likely(sides: Sequence[tuple[DataFrame, Sequence[str]]], split_rows: int) -> list[tuple[list[int], int]]:
    """For each frame, the key hashes that may have a large group, and the limit."""
    hashed = [
        df.select(
            F.lit(i).alias("__side"),
            (F.xxhash64(*map(quoted, keys)) if keys else F.lit(0).cast("long")).alias("__hash"),
            F.pmod(F.spark_partition_id(), F.lit(COMBINED)).alias("__part"),
        )
        for i, (df, keys) in enumerate(sides)
    ]
    tasks = (
        reduce(DataFrame.unionAll, hashed)
        .groupBy("__side", "__part")
        .agg(F.expr(f"approx_top_k_accumulate(__hash, {TRACKED})").alias("__seen"), F.count(F.lit(1)).alias("__rows"))
    )
    # estimates are upper bounds, and fewer than 2 * MAX_LARGE can reach a limit
    found = (
        tasks.groupBy("__side")
        .agg(F.expr(f"approx_top_k_combine(__seen, {TRACKED})").alias("__seen"), F.sum("__rows").alias("__rows"))
        .withColumn("__limit", F.greatest(F.lit(split_rows), F.ceil(F.col("__rows") / MAX_LARGE)))
        .withColumn("__top", F.expr(f"approx_top_k_estimate(__seen, {2 * MAX_LARGE})"))
        .select("__side", "__limit", F.filter("__top", lambda x: x["count"] > F.col("__limit"))["item"].alias("__likely"))
    )
    result = [([], split_rows)] * len(sides)
    for row in found.collect():
        result[row["__side"]] = (row["__likely"], row["__limit"])
    return result
