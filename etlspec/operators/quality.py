"""Row rules, duplicate keys and orphan references."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etlspec.functions.canonical import canonical_json, quoted
from etlspec.functions.columns import compile_column
from etlspec.operators.joins import distinct_keys

Types = Mapping[str, T.DataType]


@dataclass(frozen=True)
class Rule:
    """``message(types)`` gives the text of a violation, or null when the row is fine."""

    field: str
    message: Callable[[Types], Column]
    severity: str = "error"


def _is_set(name: str, types: Types) -> Column:
    column, dtype = quoted(name), types[name]
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return column.isNotNull() & (F.size(column) > 0)
    if isinstance(dtype, T.StringType):
        return column.isNotNull() & (column != "")
    return column.isNotNull()


def _when(violated: Column, message: str | Column) -> Column:
    return F.when(violated, F.lit(message) if isinstance(message, str) else message)


def required(col: str, severity: str = "error") -> Rule:
    """Null or empty fails."""
    return Rule(col, lambda types: _when(~_is_set(col, types), "is required"), severity)


def one_of(col: str, values: Sequence, severity: str = "error") -> Rule:
    """A value outside the list fails; null is fine."""
    accepted = ", ".join(map(str, values))
    value = quoted(col)
    text = F.concat(F.lit('"'), value.cast("string"), F.lit(f'" is not accepted (use one of: {accepted})'))
    return Rule(col, lambda _: _when(~value.isin(*values), text), severity)


def pattern(col: str, regex: str, severity: str = "error") -> Rule:
    """The whole value must match; an empty value has its own message; null is fine."""
    value = quoted(col)
    text = F.concat(F.lit('"'), value, F.lit(f'" does not match {regex}'))
    checked = _when(value == "", "is empty")
    return Rule(col, lambda _: F.coalesce(checked, _when(~value.rlike(rf"\A(?:{regex})\z"), text)), severity)


def _counted(cols: Sequence[str], bad: Callable[[Column], Column], message: str, severity: str) -> Rule:
    def text(types: Types) -> Column:
        number = F.lit(0)
        for c in cols:
            number = number + _is_set(c, types).cast("int")
        return _when(bad(number), message)

    return Rule(", ".join(cols), text, severity)


def exclusive(cols: Sequence[str], severity: str = "error") -> Rule:
    return _counted(cols, lambda n: n > 1, "at most one may be set", severity)


def exactly_one(cols: Sequence[str], severity: str = "error") -> Rule:
    return _counted(cols, lambda n: n != 1, "exactly one must be set", severity)


def at_least_one(cols: Sequence[str], severity: str = "error") -> Rule:
    return _counted(cols, lambda n: n == 0, "at least one must be set", severity)


def required_when(col: str, condition: str | Column, severity: str = "error") -> Rule:
    """Null or empty fails where ``condition`` (column text or a Column) holds."""
    holds = compile_column(condition) if isinstance(condition, str) else condition
    return Rule(col, lambda types: _when(holds & ~_is_set(col, types), "is required here"), severity)


def holds(col: str, condition: str | Column, message: str, severity: str = "error") -> Rule:
    """Any other condition on the row; an unknown (null) outcome is fine."""
    good = compile_column(condition) if isinstance(condition, str) else condition
    return Rule(col, lambda _: _when(~good, message), severity)


def check_rows(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str]) -> DataFrame:
    """Every violation of every rule: the keys, ``field``, ``message``, ``severity``.

    No rule hides another. One narrow pass: a filter inside generated code finds
    the rows that break a rule, and only those get their messages.
    """
    _refuse(keys, ["field", "message", "severity"])
    types = {f.name: f.dataType for f in df.schema.fields}
    if not rules:
        none = [F.lit("").alias(n) for n in ("field", "message", "severity")]
        return df.select(*map(quoted, keys), *none).limit(0)
    messages = [rule.message(types) for rule in rules]
    found = [
        F.when(text.isNotNull(), F.struct(F.lit(rule.field).alias("field"), text.alias("message"), F.lit(rule.severity).alias("severity")))
        for rule, text in zip(rules, messages)
    ]
    broken = df.filter(reduce(lambda a, b: a | b, [text.isNotNull() for text in messages]))
    # empty places are dropped after the explosion, which keeps all of it inside generated code
    return broken.select(*map(quoted, keys), F.explode(F.array(*found)).alias("__found")).filter("__found IS NOT NULL").select(
        *map(quoted, keys), "__found.field", "__found.message", "__found.severity"
    )


def _refuse(present: Sequence[str], added: Sequence[str]) -> None:
    """Names are compared as Spark resolves them, in any case."""
    clashes = sorted({c for c in present if c.lower() in {a.lower() for a in added}})
    if clashes:
        raise ValueError(f"the result adds columns of its own named {', '.join(clashes)}; rename them first")


def find_duplicates(df: DataFrame, keys: Sequence[str], origin: str | None = None) -> DataFrame:
    """Keys that appear more than once, with every origin they come from.

    One row per key and origin: the keys, ``origin``, ``n_origin`` (rows from
    it) and ``n_rows`` (rows in all); without ``origin`` one row per key. Null
    is a value like any other. The result is long rather than a list per key,
    so a key with any number of origins never has to fit into one row; counts
    are combined before each shuffle.

    Keys of variable width (texts) are counted by their SHA-256 digest, and only
    the repeated ones are looked up afterwards, so whole texts are not shuffled
    to find out that most of them occur once.
    """
    _refuse(keys, ["n_rows"] if origin is None else ["origin", "n_origin", "n_rows"])
    types = {f.name: f.dataType for f in df.schema.fields}
    origins = [] if origin is None else ["origin"]
    named = [quoted(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    rows = df.select(*named, *([] if origin is None else [quoted(origin).alias("origin")]))
    names = [f"__key{i}" for i in range(len(keys))]
    wide = any(not _fixed_width(types[k]) for k in keys)
    if wide:
        one_text = len(keys) == 1 and isinstance(types[keys[0]], (T.StringType, T.BinaryType))
        content = F.col(names[0]) if one_text else canonical_json(rows, names)
        rows = rows.withColumn("__digest", F.coalesce(F.unhex(F.sha2(content, 256)), F.lit(b"")))
    found = _repeated(rows, ["__digest"] if wide else names, origins)
    if wide:
        repeated = found.select("__digest").distinct()
        texts = (
            rows.select("__digest", *names)
            .join(repeated, "__digest", "left_semi")
            .groupBy("__digest")
            .agg(F.first(F.struct(*names)).alias("__keys"))
            .select("__digest", "__keys.*")
        )
        found = found.join(texts, "__digest")
    counts = ["n_origin", "n_rows"] if origins else ["n_rows"]
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *origins, *counts)


def _fixed_width(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.DatetimeType, T.BooleanType))


def _repeated(rows: DataFrame, by: Sequence[str], origins: Sequence[str]) -> DataFrame:
    """Counts per ``by`` and origin, for the values of ``by`` with several rows."""
    if not origins:
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    # A total over the counts, not a join with them: the frame is scanned once for both.
    per_origin = rows.groupBy(*by, *origins).agg(F.count(F.lit(1)).alias("n_origin"))
    total = F.sum("n_origin").over(Window.partitionBy(*by))
    return per_origin.withColumn("n_rows", total).filter("n_rows > 1")


def find_orphans(
    df: DataFrame, ref_col: str, known: DataFrame, key_col: str, field_name: str = "field", value_name: str = "value"
) -> DataFrame:
    """Rows whose reference is not a known key, with its column and text under ``field_name`` and ``value_name``.

    A null reference is fine. Known keys are made distinct before they are
    shuffled, so repeated ones cost nothing, and a frequent reference can be split.
    """
    _refuse(df.columns, [field_name, value_name])
    keys = distinct_keys(known.select(quoted(key_col).alias("__known")), ["__known"])
    rows = df.filter(quoted(ref_col).isNotNull())
    return rows.join(keys, quoted(ref_col) == F.col("__known"), "left_anti").select(
        "*", F.lit(ref_col).alias(field_name), quoted(ref_col).cast("string").alias(value_name)
    )
