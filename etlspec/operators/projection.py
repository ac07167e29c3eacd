"""Row-local transforms: filter, select, drop_columns, rename, add_column, and sql."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from etlspec.functions.columns import compile_column

# Spark's kinds of plans that are no query.
NOT_QUERIES = ("plans.logical.Command", "plans.logical.ParsedStatement", "plans.logical.InsertIntoDir", "analysis.UnresolvedExecuteImmediate")

def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    return df.filter(compile_column(condition))


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the named columns; names the frame lacks are ignored."""
    return df.drop(*columns)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename all columns of ``mapping`` at once, so names can be swapped.

    Old names match in any case, as Spark resolves names; those the frame lacks
    are ignored. Two columns may not end up with the
    same name.
    """
    folded = {old.lower(): new for old, new in mapping.items()}
    renamed = [mapping.get(c, folded.get(c.lower(), c)) for c in df.columns]
    clashes = [n for n, count in Counter(c.lower() for c in renamed).items() if count > 1]
    if clashes and Counter(df.columns) != Counter(renamed):
        raise ValueError(f"rename gives several columns the name {', '.join(clashes)}")
    return df.toDF(*renamed)


def add_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    return df.withColumn(name, compile_column(expression))


def run_sql(spark: SparkSession, frames: Mapping[str, DataFrame], query: str) -> DataFrame:
    """Run a query that sees every frame under its name.

    The plan is analysed here and now, so a later rebinding of a name does not
    change it, and the frames' names are gone afterwards: views that they hid
    are back. A text that is no query, or holds anything that writes or changes
    the session, is refused before it is analysed.
    """
    _refuse_commands(spark, query)
    shadowed = {n: spark.table(n) for n in frames if _is_temporary(spark, n)}
    try:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
        return spark.sql(query)
    finally:
        for name in frames:
            if name in shadowed:
                shadowed[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _refuse_commands(spark: SparkSession, query: str) -> None:
    """Raise unless every node of the parsed plan only reads.

    The text is parsed by Spark, not analysed, and not run. Commands, writes at
    any depth (below WITH, or several of one multi-insert), scripts and texts that
    are run as SQL in turn are plans of their own kinds, whatever their wording.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except PySparkException as error:
        raise ValueError(f"this is not a query: {error}") from error
    named = spark._jvm.java.lang.Class.forName
    refused = [named(f"org.apache.spark.sql.catalyst.{kind}") for kind in NOT_QUERIES]
    left = [plan]
    while left:
        node = left.pop()
        if any(kind.isInstance(node) for kind in refused):
            raise ValueError(f"a query may only read; this one holds {node.nodeName()}")
        for below in (node.children(), node.innerChildren(), node.subqueries()):
            left += [below.apply(i) for i in range(below.size())]


def _is_temporary(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary


