"""Table operators over keyed snapshots: diff, overlay, scope, existence."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etlspec.functions.canonical import quoted, value_text
from etlspec.operators.joins import distinct_keys


def snapshot_diff(
    desired: DataFrame,
    current: DataFrame,
    keys: Sequence[str],
    compare: Sequence[str] | None = None,
    set_cols: Iterable[str] = (),
    detail: bool = True,
) -> DataFrame:
    """Rows to create, delete or modify to turn ``current`` into ``desired``.

    Returns the keys, ``change_type`` (Create, Delete, Modify), ``changes``
    (for Modify: field -> {old, new} as text, null for null, in name order),
    ``old_hash`` and ``new_hash``. None of them depends on the session's time zone. Equal rows are left out. A column one side lacks counts as
    null there, null keys are equal to each other, and a key that appears twice
    on one side is an error raised while the job runs.

    Both sides are tagged, united and grouped, which takes one shuffle and no
    join. With ``detail=False`` only a 32-byte digest per row is shuffled and
    ``changes`` is left out: use it on wide tables.
    """
    names = sorted(
        compare if compare is not None else {*desired.columns, *current.columns} - set(keys)
    )
    both = _side(desired, keys, names, set_cols, True, detail).unionByName(
        _side(current, keys, names, set_cols, False, detail)
    )
    # Each side holds a key at most once, so nothing is gained by combining
    # before the shuffle; sorting once after it is cheaper.
    grouped = (
        both.repartition(*map(quoted, keys))
        .groupBy(*map(quoted, keys))
        .agg(
            F.first(F.when(F.col("__new"), F.col("__row")), ignorenulls=True).alias("__after"),
            F.first(F.when(~F.col("__new"), F.col("__row")), ignorenulls=True).alias("__before"),
            F.count_if("__new").alias("__n_new"),
            F.count_if(~F.col("__new")).alias("__n_old"),
        )
    )
    repeated = F.greatest("__n_new", "__n_old") > 1
    message = F.concat(F.lit("duplicate key in a snapshot: "), F.to_json(F.struct(*map(quoted, keys))))
    change = (
        F.when(repeated, F.raise_error(message))
        .when(F.col("__n_old") == 0, F.lit("Create"))
        .when(F.col("__n_new") == 0, F.lit("Delete"))
        .when(~F.col("__after").eqNullSafe(F.col("__before")), F.lit("Modify"))
    )
    changed = grouped.withColumn("change_type", change).filter(F.col("change_type").isNotNull())
    digests = [
        _digest(F.col(side), detail, len(names)).alias(name)
        for side, name in (("__before", "old_hash"), ("__after", "new_hash"))
    ]
    details = [_changes(names).alias("changes")] if detail else []
    return changed.select(*map(quoted, keys), "change_type", *details, *digests)


def _side(df, keys, names, set_cols, is_new: bool, detail: bool) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = [_text(df, types.get(n), n, n in set(set_cols)) for n in names]
    row = F.array(*texts).cast("array<string>") if detail else F.unhex(_sha(texts))
    return df.select(*map(quoted, keys), F.lit(is_new).alias("__new"), row.alias("__row"))


def _text(df: DataFrame, dtype: T.DataType | None, name: str, as_set: bool) -> Column:
    if dtype is None:
        return F.lit(None).cast("string")
    column = quoted(name)
    if as_set:
        elements = F.transform(column, lambda x: value_text(x, dtype.elementType))
        text = F.to_json(F.struct(F.array_sort(elements).alias("set")))
    else:
        text = value_text(column, dtype)
    return F.when(column.isNotNull(), text)


def _sha(texts: Sequence[Column]) -> Column:
    """SHA-256 of texts, each with its length in front so that none can pose as two."""
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(F.lit(""), *parts), 256)


def _digest(row: Column, detail: bool, width: int) -> Column:
    if not detail:
        return F.lower(F.hex(row))
    return F.when(row.isNotNull(), _sha([row.getItem(i) for i in range(width)]))


def _changes(names: Sequence[str]) -> Column:
    pairs = F.zip_with(
        F.col("__before"),
        F.col("__after"),
        lambda old, new: F.when(
            ~old.eqNullSafe(new),
            F.struct(old.alias("old"), new.alias("new")),
        ),
    )
    every = F.map_from_arrays(F.array(*map(F.lit, names)), pairs)
    changed = F.map_filter(every, lambda _, pair: pair.isNotNull())
    return F.when(F.col("change_type") == "Modify", changed)


def overlay(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Merge layers by key: the last layer with a set value wins, field by field.

    Nulls fall through to the layer below. Maps and structs merge entry by
    entry, at every depth; arrays are replaced whole. A key twice in one layer
    is an error raised while the job runs. One shuffle for any number of layers.
    """
    tagged = [df.withColumn("__layer", F.lit(i)) for i, df in enumerate(layers)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    fields = [f for f in stacked.schema.fields if f.name not in keys and f.name != "__layer"]
    deep = [f for f in fields if isinstance(f.dataType, (T.MapType, T.StructType))]
    aggs = [F.count_if(F.col("__layer") == i).alias(f"__n{i}") for i in range(len(layers))]
    for f in fields:
        column = quoted(f.name)
        if f in deep:
            aggs += [
                F.first(F.when(F.col("__layer") == i, column), ignorenulls=True).alias(_at(f.name, i))
                for i in range(len(layers))
            ]
        else:
            aggs.append(F.max_by(column, F.when(column.isNotNull(), F.col("__layer"))).alias(f.name))
    # A layer holds a key at most once, so nothing is combined before the shuffle.
    merged = stacked.repartition(*map(quoted, keys)).groupBy(*map(quoted, keys)).agg(*aggs)
    counts = F.greatest(*[F.col(f"__n{i}") for i in range(len(layers))], F.lit(0))
    message = F.concat(F.lit("duplicate key in a layer: "), F.to_json(F.struct(*map(quoted, keys))))
    unique = F.when(counts > 1, F.raise_error(message)).otherwise(F.lit(True))

    def value(f: T.StructField) -> Column:
        if f not in deep:
            return quoted(f.name)
        per_layer = [quoted(_at(f.name, i)) for i in range(len(layers))]
        return reduce(lambda below, above: _merge(below, above, f.dataType), per_layer).alias(f.name)

    return merged.filter(unique).select(*map(quoted, keys), *map(value, fields))


def _at(name: str, layer: int) -> str:
    return f"__{layer}_{name}"


def _merge(below: Column, above: Column, dtype: T.DataType) -> Column:
    match dtype:
        case T.MapType():
            both = F.map_zip_with(below, above, lambda _, x, y: _merge(x, y, dtype.valueType))
        case T.StructType():
            both = F.struct(
                *[_merge(below.getField(f.name), above.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
            )
        case _:
            return F.coalesce(above, below)
    return F.when(below.isNull(), above).when(above.isNull(), below).otherwise(both)


def scope_subtree(df: DataFrame, path_col: str, prefix: str) -> DataFrame:
    """Rows whose path is ``prefix`` or lies below it, by whole path components.

    ``a/b`` holds ``a/b`` and ``a/b/c`` but not ``a/bc``. Both tests reach the
    file scan as pushed filters.
    """
    root = prefix.rstrip("/")
    if not root:
        return df.filter(quoted(path_col).isNotNull())
    return df.filter((quoted(path_col) == root) | quoted(path_col).startswith(root + "/"))


def scope_to(other: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``other`` whose keys appear in ``df``; a key that is frequent in ``other`` can be split."""
    return other.join(distinct_keys(df, keys), list(keys), "left_semi")


def existence(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each distinct expected key with ``exists``: whether ``actual`` has it.

    One shuffle; repeated keys are combined before it.
    """
    tagged = expected.select(*map(quoted, keys), F.lit(True).alias("__expected")).unionByName(
        actual.select(*map(quoted, keys), F.lit(False).alias("__expected"))
    )
    return (
        tagged.groupBy(*map(quoted, keys))
        .agg(F.bool_or("__expected").alias("__expected"), F.bool_or(~F.col("__expected")).alias("exists"))
        .filter("__expected")
        .drop("__expected")
    )
