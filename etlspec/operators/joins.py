"""Equi-joins by column name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from etlspec.functions.canonical import quoted
from etlspec.operators.sizes import SPLIT_ROWS, any_large


def join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    suffix: str | None = None,
    split_rows: int | None = SPLIT_ROWS,
) -> DataFrame:
    """Join on equally named columns, which appear once in the result.

    Null keys match nothing. Other columns present on both sides are an error,
    unless ``suffix`` is given for the right-hand ones. Which side is
    broadcast, if any, is left to the size statistics of the optimizer.

    Adaptive execution splits a frequent key of either side of an inner join,
    but only of the preserved side of a left or right join, and none in a full
    outer join. Where that leaves a side with a key of more than ``split_rows``
    rows to one task, the join is planned as an inner join and the rows without
    a match, which can both be split, as semi and anti joins can. Finding out
    takes one job that sketches the keys of the sides in question;
    ``split_rows=None`` leaves it out.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how in ("left_semi", "left_anti"):
        return left.join(distinct_keys(right, keys), keys, how)
    right = _without_clashes(left, right, keys, suffix)
    asked = {"left": [right], "right": [left], "outer": [left, right]}.get(how, [])
    # null keys match nothing, so they only crowd a task where their rows are kept
    asked = [(side if how == "outer" else side.dropna(subset=keys), keys) for side in asked]
    if asked and split_rows is not None and any_large(asked, split_rows):
        return _outer(left, right, keys, left_rows=how != "right", right_rows=how != "left")
    return left.join(right, keys, how)


def _outer(
    left: DataFrame, right: DataFrame, keys: list[str], left_rows: bool = False, right_rows: bool = False
) -> DataFrame:
    """The matches, and the rows of the chosen sides that have none."""
    result = left.join(right, keys, "inner")
    for wanted, side, other in ((left_rows, left, right), (right_rows, right, left)):
        if wanted:
            alone = side.join(distinct_keys(other, keys), keys, "left_anti")
            result = result.unionByName(alone, allowMissingColumns=True)
    return result


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key once, for the right side of a semi or anti join.

    Repeated keys are dropped before they are shuffled, and what is left is dealt
    out round-robin. That leaves the frame without a partitioning by key, so the
    join adds a shuffle of its own on both sides; only then does adaptive
    execution split a key that is frequent on the left. A partitioning by key
    would be taken over from the aggregate, and nothing would be split.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*map(quoted, keys)).distinct().repartition(width)


def _without_clashes(left: DataFrame, right: DataFrame, keys: list[str], suffix: str | None) -> DataFrame:
    taken, own = {c.lower() for c in left.columns}, {k.lower() for k in keys}
    shared = [c for c in right.columns if c.lower() in taken and c.lower() not in own]
    if not shared:
        return right
    if suffix is None:
        raise ValueError(
            f"both sides of the join have the columns {', '.join(shared)}; rename or drop them, or give a suffix"
        )
    return right.select(*[quoted(c).alias(c + suffix) if c in shared else quoted(c) for c in right.columns])
