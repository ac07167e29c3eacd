"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from etlspec.llm.common import column, fresh, settled, without

#: Rows that are ranked together in one task, about.
BUCKET_ROWS = 100_000
#: Sources whose totals may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def shard(
    docs: DataFrame,
    n_shards: int = 40,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: int = 0,
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """``docs`` with ``shard_col`` (int) and ``slot_col`` (long, gapless from 0 in each shard).

    The rows of each source are shuffled by a seeded hash of their id and
    ranked; row r of n has the fractional rank (r - 1/2) / n. All rows are
    ordered by it and cut into ``n_shards`` runs whose lengths differ by one at
    most, so that every shard has each source in proportion.

    Ranks come from counts of hash buckets of about ``BUCKET_ROWS`` rows, their
    running sums, and a row number within the bucket; so no task sorts a source
    or the whole table. ``docs`` is shuffled twice; its id and source are read
    twice more.

    A null source is a source of its own, null ids and equal ids share a hash
    and are ordered by their remaining columns' hash. Repeated rows are rows. An
    empty table gives no rows. Other columns pass through; ``shard_col`` and
    ``slot_col`` already present are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards is 1 or more")
    docs = without(docs, [shard_col, slot_col])
    src, mix, n, at, rank, frac, cell, place, tie = fresh(docs, "src", "mix", "n", "at", "rank", "frac", "cell", "place", "tie")
    keys = {src: column(docs, source_col), mix: F.xxhash64(column(docs, id_col), F.lit(seed))}
    plain = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    full = docs.withColumns(keys | {tie: F.xxhash64(*[column(docs, c) for c in plain])})
    slim = docs.select(*[v.alias(k) for k, v in keys.items()], F.lit(0).alias(tie))
    totals = settled(slim.groupBy(src).agg(F.count("*").alias(n)))
    known = totals.agg(F.count("*").alias("sources"), F.coalesce(F.sum(n), F.lit(0)).alias("rows")).first()
    rows = max(1, known["rows"])
    size = totals.select(F.col(src).alias(place), n)
    size = F.broadcast(size) if known["sources"] <= BROADCAST_SOURCES else size
    cells = -(-rows // BUCKET_ROWS)

    def bucketed(df: DataFrame) -> DataFrame:
        joined = df.join(size, F.col(src).eqNullSafe(F.col(place))).drop(place)
        unit = F.shiftrightunsigned(mix, 11) / F.lit(float(1 << 53))
        return joined.withColumn(at, F.floor(unit * F.ceil(F.col(n) / BUCKET_ROWS)))

    before = Window.partitionBy(src).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed(slim).groupBy(src, at).agg(F.count("*").alias("c"))
    offsets = settled(counts.select(src, at, F.coalesce(F.sum("c").over(before), F.lit(0)).alias(place)))

    def ranked(df: DataFrame) -> DataFrame:
        inside = Window.partitionBy(src, at).orderBy(F.shiftrightunsigned(mix, 1), mix, tie)
        o = offsets.select(F.col(src).alias(f"{src}_o"), F.col(at).alias(f"{at}_o"), place)
        joined = bucketed(df).withColumn(rank, F.row_number().over(inside)).join(o, F.col(src).eqNullSafe(F.col(f"{src}_o")) & (F.col(at) == F.col(f"{at}_o")))
        joined = joined.withColumn(rank, F.col(place) + F.col(rank)).drop(f"{src}_o", f"{at}_o", place)
        fraction: Column = (2 * F.col(rank) - 1) / (2.0 * F.col(n))
        return joined.withColumn(frac, fraction).withColumn(cell, F.least(F.floor(F.col(frac) * cells), F.lit(cells - 1)))

    over = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)  # one row for BUCKET_ROWS documents
    firsts = settled(ranked(slim).groupBy(cell).agg(F.count("*").alias("c")))
    firsts = firsts.select(F.col(cell).alias(f"{cell}_o"), F.coalesce(F.sum("c").over(over), F.lit(0)).alias(place))
    inside = Window.partitionBy(cell).orderBy(frac, F.xxhash64(src, F.lit(seed)), src, rank)
    placed = ranked(full).withColumn(rank, F.row_number().over(inside)).join(firsts, F.col(cell) == F.col(f"{cell}_o"))
    placed = placed.withColumn(shard_col, F.expr(f"(`{place}` + `{rank}` - 1) * {n_shards} div {rows}"))
    slot = F.expr(f"`{place}` + `{rank}` - 1 - (`{shard_col}` * {rows} + {n_shards - 1}) div {n_shards}")
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(shard_col).cast("int").alias(shard_col), slot.cast("long").alias(slot_col))


def write_shards(sharded: DataFrame, path: str, *, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """Write one folder of Parquet files for each shard, rows in the order of their slots."""
    spread = sharded.repartition(shard_col).sortWithinPartitions(shard_col, slot_col)
    spread.write.partitionBy(shard_col).parquet(path)
