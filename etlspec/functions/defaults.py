"""Column helpers used just before a write: null defaults, time partitions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth}


def with_defaults(df: DataFrame) -> DataFrame:
    """Replace nulls by a default of the column's type; void becomes string.

    Struct fields are filled one by one, and a null struct becomes a struct of
    defaults. Nulls inside arrays and map values are filled too.
    """
    return df.select(*[_filled(_top(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def void_to_string(df: DataFrame) -> DataFrame:
    """Only give void columns a type, so that any file format can hold them."""
    return df.select(
        *[
            _top(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else _top(f.name)
            for f in df.schema.fields
        ]
    )


def add_time_partitions(
    df: DataFrame, units: tuple[str, ...], timestamp_column: str | None = None, create: bool = False
) -> DataFrame:
    """Add integer ``year``/``month``/``day`` columns taken from a timestamp.

    With ``create`` the timestamp is a new ``ingestion_timestamp`` holding the
    start of the query, the same value in every row.
    """
    present = sorted(c for c in df.columns if c.lower() in units)
    if present:
        raise ValueError(f"the frame already has {', '.join(present)}; rename or drop it before adding time partitions")
    if create:
        timestamp_column = "ingestion_timestamp"
        df = df.withColumn(timestamp_column, F.current_timestamp())
    return df.withColumns({unit: _PARTS[unit](_top(timestamp_column)) for unit in units})


def _top(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _default(dtype: T.DataType) -> Column | None:
    match dtype:
        case T.NullType() | T.StringType() | T.CharType() | T.VarcharType():
            return F.lit("")
        case T.BooleanType():
            return F.lit(False)
        case T.DateType():
            return F.lit(datetime.date(1970, 1, 1))
        case T.TimestampType() | T.TimestampNTZType():
            return F.lit("1970-01-01 00:00:00").cast(dtype)
        case T.BinaryType():
            return F.lit(bytearray())
        case T.NumericType():
            return F.lit(0).cast(dtype)
        case T.ArrayType():
            return F.array().cast(_typed(dtype))
        case T.MapType():
            keys, values = (T.ArrayType(_typed(t)) for t in (dtype.keyType, dtype.valueType))
            return F.map_from_arrays(F.array().cast(keys), F.array().cast(values))
    return None


def _typed(dtype: T.DataType) -> T.DataType:
    """The same type with every void replaced by string."""
    match dtype:
        case T.NullType():
            return T.StringType()
        case T.ArrayType():
            return T.ArrayType(_typed(dtype.elementType), dtype.containsNull)
        case T.MapType():
            return T.MapType(_typed(dtype.keyType), _typed(dtype.valueType), dtype.valueContainsNull)
        case T.StructType():
            return T.StructType([T.StructField(f.name, _typed(f.dataType), f.nullable) for f in dtype.fields])
    return dtype


def _filled(column: Column, dtype: T.DataType) -> Column:
    match dtype:
        case T.StructType():
            return F.struct(*[_filled(column.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields])
        case T.ArrayType():
            inner = F.transform(column, lambda x: _filled(x, dtype.elementType))
            return F.coalesce(inner, _default(dtype))
        case T.MapType():
            inner = F.transform_values(column, lambda _, v: _filled(v, dtype.valueType))
            return F.coalesce(inner, _default(dtype))
        case T.NullType():
            return F.coalesce(column.cast("string"), F.lit(""))
    default = _default(dtype)
    return column if default is None else F.coalesce(column, default)
