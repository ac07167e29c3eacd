"""The aggregate transform."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, group_by: Sequence[str], aggs: Mapping[str, str]) -> DataFrame:
    """Group by the columns and compute ``{alias: SQL aggregate}``, in order.

    Catalyst aggregates before and after the shuffle, so a frequent group
    sends one row per task; distinct counts are spread over their values first.
    """
    return df.groupBy(*group_by).agg(*[F.expr(text).alias(alias) for alias, text in aggs.items()])
