"""A canonical text form of columns, and fingerprints made from it.

Each value is written by its type, at every depth and in map keys too. Instants
are counted in microseconds, or written in UTC where a person reads them, so the
text loses no digit and does not depend on the session's time zone.

Equal values give equal text whatever the order in which map entries or
columns are written, and whichever zero a float holds; array order counts, except
for columns declared as sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Types whose values are rewritten before they become text.
_REWRITTEN = (T.TimestampType, T.TimestampNTZType, T.DoubleType, T.FloatType)
_KEEP_NULLS = {"ignoreNullFields": "false"}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def has_map(dtype: T.DataType) -> bool:
    match dtype:
        case T.MapType() | T.VariantType():
            return True
        case T.ArrayType():
            return has_map(dtype.elementType)
        case T.StructType():
            return any(has_map(f.dataType) for f in dtype.fields)
    return False


def normal_form(column: Column, dtype: T.DataType) -> Column:
    """The value with struct fields sorted by name and maps as sorted entries."""
    match dtype:
        case T.MapType():
            if has_map(dtype.keyType):
                raise ValueError("a map key cannot hold a map")
            entries = F.transform(
                F.map_entries(column),
                lambda e: F.struct(
                    normal_form(e.getField("key"), dtype.keyType).alias("key"),
                    normal_form(e.getField("value"), dtype.valueType).alias("value"),
                ),
            )
            return F.array_sort(entries, _by_key)
        case T.ArrayType() if _nested(dtype.elementType) or isinstance(dtype.elementType, _REWRITTEN):
            return F.transform(column, lambda x: normal_form(x, dtype.elementType))
        case T.StructType():
            parts = [
                normal_form(column.getField(f.name), f.dataType).alias(f.name)
                for f in sorted(dtype.fields, key=lambda f: f.name)
            ]
            return F.when(column.isNotNull(), F.struct(*parts))
        case T.VariantType():
            return F.to_json(column)
        case T.TimestampType():
            return F.unix_micros(column)
        case T.TimestampNTZType():
            return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
        case T.DoubleType() | T.FloatType():
            return _one_zero(column, dtype)
    return column


def _one_zero(column: Column, dtype: T.DataType) -> Column:
    return column + F.lit(0).cast(dtype)


def _by_key(a: Column, b: Column) -> Column:
    left, right = a.getField("key"), b.getField("key")
    return F.when(left < right, F.lit(-1)).when(left > right, F.lit(1)).otherwise(F.lit(0))


def _nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def canonical_json(df: DataFrame, cols: Iterable[str], set_cols: Iterable[str] = ()) -> Column:
    """Canonical JSON of the named columns, in name order, nulls kept."""
    sets, types = set(set_cols), {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in sorted(cols):
        dtype = types[name]
        value = normal_form(quoted(name), dtype)
        if name in sets:
            if not isinstance(dtype, T.ArrayType):
                raise ValueError(f"'{name}' is not an array, so it cannot be read as a set")
            # An element is ordered by its own text, which exists for every type.
            value = F.array_sort(F.transform(value, _element_text))
        parts.append(value.alias(name))
    return F.to_json(F.struct(*parts), _KEEP_NULLS)


def _element_text(x: Column) -> Column:
    return F.to_json(F.struct(x.alias("v")), _KEEP_NULLS)


def value_text(column: Column, dtype: T.DataType) -> Column:
    """One value as text; null stays null."""
    if _nested(dtype):
        return F.to_json(normal_form(column, dtype), _KEEP_NULLS)
    match dtype:
        case T.BinaryType():
            return F.base64(column)
        case T.TimestampType():
            utc = F.timestamp_add("MICROSECOND", F.unix_micros(column), F.lit("1970-01-01").cast("timestamp_ntz"))
            return F.concat(utc.cast("string"), F.lit("Z"))
        case T.DoubleType() | T.FloatType():
            return _one_zero(column, dtype).cast("string")
    return column.cast("string")


def fingerprint(
    df: DataFrame, cols: Sequence[str] | None = None, name: str = "fingerprint", set_cols: Iterable[str] = ()
) -> DataFrame:
    """Add a SHA-256 of the canonical form of ``cols`` (default: all columns)."""
    return df.withColumn(name, F.sha2(canonical_json(df, cols or df.columns, set_cols), 256))
