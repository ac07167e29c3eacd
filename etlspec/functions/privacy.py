"""PII masking and counting with built-in regular expression functions.

Everything stays inside one projection: no Python worker, no shuffle. Nested
strings are reached through ``transform``, ``transform_values`` and rebuilt
structs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entity -> pattern, in the order they are applied. Patterns
# overlap (a card number holds digits a phone pattern would take), so the order
# does not follow the order of the list in a spec. Only syntax that means the
# same in Java and RE2 regular expressions is used.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "USA_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "CREDIT_CARD": r"\b(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,4}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})\b",
    # version 4; version 6 in full; version 6 with a run of zeros left out in its middle
    "IP_ADDRESS": r"\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b"
    r"|\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}\b",
    # three, three and four digits; a country's code and 8 to 15 digits in all; ten digits, of which the first is no 0 or 1
    "PHONE_NUMBER": r"(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
    r"|\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}\b|\b[2-9][0-9]{9}\b",
}
ENTITIES = tuple(PATTERNS)

# The same matches, found without trying every start inside a long word. \\G
# stands for the end of the previous match, where a new one may begin.
_MAIL = "[A-Za-z0-9._%+-]"
_FORMS = {
    **PATTERNS,
    "EMAIL": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}",
    "IP_ADDRESS": rf"\b(?=[0-9A-Fa-f]{{1,4}}[.:])(?:{PATTERNS['IP_ADDRESS']})",
    "PHONE_NUMBER": f"(?=[+(0-9])(?:{PATTERNS['PHONE_NUMBER']})",
}
# What a version-6 address without a digit holds.
_LETTERS_ONLY = ":[A-Fa-f]{0,4}:"


def ordered(entities: Iterable[str]) -> list[str]:
    """The given entities in the order they are applied."""
    wanted = list(entities)
    unknown = [e for e in wanted if e not in PATTERNS]
    if unknown:
        raise ValueError(f"unknown entities {unknown} (known: {', '.join(ENTITIES)})")
    return [e for e in ENTITIES if e in wanted]


def redact(text: Column, entities: Iterable[str]) -> Column:
    """One string column with every entity replaced by ``[ENTITY]``.

    Text without ``@`` holds no e-mail address and text without digits, or
    colons as in an IP address, holds none of the others, so most text is only
    scanned for those.
    """
    wanted = ordered(entities)
    masked = text
    if "EMAIL" in wanted:
        masked = F.when(_may_hold(text, "EMAIL"), _replaced(text, "EMAIL")).otherwise(text)
    numbers = [e for e in wanted if e != "EMAIL"]
    if not numbers:
        return masked
    # Masking an address adds no digit, so the test on the given text holds.
    plain = masked
    for entity in numbers:
        masked = _replaced(masked, entity)
    return F.when(_may_hold(text, "IP_ADDRESS" if "IP_ADDRESS" in numbers else numbers[0]), masked).otherwise(plain)


def _replaced(text: Column, entity: str) -> Column:
    return F.regexp_replace(text, F.lit(_FORMS[entity]), F.lit(f"[{entity}]"))


def _may_hold(text: Column, entity: str) -> Column:
    if entity == "EMAIL":
        return text.contains("@")
    digit = text.rlike("[0-9]")
    return digit | (text.contains(":") & text.rlike(_LETTERS_ONLY)) if entity == "IP_ADDRESS" else digit


def mask_pii(df: DataFrame, entities: Iterable[str]) -> DataFrame:
    """Redact the entities in every string of the frame, nested ones and keys of maps included.

    Keys of one map that become equal are numbered in their order: ``[EMAIL]``,
    ``[EMAIL] 2`` and so on. Keys that are no strings stay as they are.
    """
    wanted = ordered(entities)

    def mask(column: Column, dtype: T.DataType) -> Column:
        return _rebuild(column, dtype, lambda c: redact(c, wanted))

    return df.select(
        *[
            mask(F.col(_quoted(f.name)), f.dataType).alias(f.name, metadata=f.metadata)
            if _holds_text(f.dataType)
            else F.col(_quoted(f.name))
            for f in df.schema.fields
        ]
    )


def pii_report(df: DataFrame, entities: Iterable[str] = ENTITIES) -> DataFrame:
    """Matches per top-level column and entity: ``column, entity, matches, rows``.

    Counting follows masking: an entity is looked for in text in which the
    earlier ones are already redacted, so each match is counted once. One pass
    with a map-side aggregate; only one row per task is shuffled.
    """
    wanted = ordered(entities)
    fields = [f for f in df.schema.fields if _holds_text(f.dataType)]
    counted = [(f.name, entity) for f in fields for entity in wanted]
    if not counted:
        raise ValueError("the frame has no text column")
    rows = df.select(*[F.col(_quoted(f.name)).alias(f"c{j}") for j, f in enumerate(fields)])
    for i, entity in enumerate(wanted):
        # a text with the earlier entities redacted is a column of its own, so each is replaced once
        found, texts = [], []
        for j, f in enumerate(fields):
            text = F.col(f"c{j}")
            if isinstance(f.dataType, T.StringType):
                hit = _may_hold(text, entity)
                found.append(F.when(hit, F.regexp_count(text, F.lit(_FORMS[entity]))).otherwise(0))
                text = F.when(hit, _replaced(text, entity)).otherwise(text) if i + 1 < len(wanted) else text
            else:
                found.append(_count(text, f.dataType, wanted[:i], entity))
            texts.append(text.alias(f"c{j}"))
        done = [c for c in rows.columns if c.startswith("m")]
        rows = rows.select(*texts, *done, *[F.coalesce(n, F.lit(0)).cast("long").alias(f"m{j * len(wanted) + i}") for j, n in enumerate(found)])
    per_row = rows.select(*[f"m{i}" for i in range(len(counted))])
    totals = per_row.agg(
        *[F.coalesce(F.sum(f"m{i}"), F.lit(0)).alias(f"m{i}") for i in range(len(counted))],
        *[F.count_if(F.col(f"m{i}") > 0).alias(f"r{i}") for i in range(len(counted))],
    )
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(entity).alias("entity"),
            F.col(f"m{i}").alias("matches"),
            F.col(f"r{i}").alias("rows"),
        )
        for i, (name, entity) in enumerate(counted)
    ]
    return totals.select(F.inline(F.array(*entries)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _holds_text(dtype: T.DataType) -> bool:
    match dtype:
        case T.StringType():
            return True
        case T.ArrayType():
            return _holds_text(dtype.elementType)
        case T.MapType():
            return isinstance(dtype.keyType, T.StringType) or _holds_text(dtype.valueType)
        case T.StructType():
            return any(_holds_text(f.dataType) for f in dtype.fields)
    return False


def _rebuild(column: Column, dtype: T.DataType, change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to every string inside a value of type ``dtype``, keys of maps included."""
    if not _holds_text(dtype):
        return column
    match dtype:
        case T.StringType():
            return change(column)
        case T.ArrayType():
            return F.transform(column, lambda x: _rebuild(x, dtype.elementType, change))
        case T.MapType():
            values = F.transform_values(column, lambda _, v: _rebuild(v, dtype.valueType, change))
            return _rekeyed(values, change) if isinstance(dtype.keyType, T.StringType) else values
    parts = [_rebuild(column.getField(f.name), f.dataType, change).alias(f.name) for f in dtype.fields]
    return F.when(column.isNotNull(), F.struct(*parts))


def _rekeyed(column: Column, change: Callable[[Column], Column]) -> Column:
    """A map with changed keys; of keys that become equal, all but the first get a number."""
    keys = F.transform(F.map_keys(column), change)
    earlier = lambda i, key: F.size(F.filter(F.slice(keys, F.lit(1), i), lambda k: k == key))
    apart = F.transform(keys, lambda key, i: F.when(earlier(i, key) > 0, F.concat(key, F.lit(" "), (earlier(i, key) + 1).cast("string"))).otherwise(key))
    same = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(column.isNotNull(), F.map_from_arrays(F.when(same, keys).otherwise(apart), F.map_values(column)))


def _count(column: Column, dtype: T.DataType, earlier: list[str], entity: str) -> Column:
    zero = F.lit(0)
    if not _holds_text(dtype):
        return zero
    match dtype:
        case T.StringType():
            found = F.regexp_count(redact(column, earlier), F.lit(_FORMS[entity]))
            return F.when(_may_hold(column, entity), found).otherwise(zero)
        case T.ArrayType():
            return F.coalesce(
                F.aggregate(column, zero, lambda n, x: n + _count(x, dtype.elementType, earlier, entity)), zero
            )
        case T.MapType():
            keys = _count(F.map_keys(column), T.ArrayType(dtype.keyType), earlier, entity) if isinstance(dtype.keyType, T.StringType) else zero
            return keys + _count(F.map_values(column), T.ArrayType(dtype.valueType), earlier, entity)
    total = zero
    for f in dtype.fields:
        total = total + _count(column.getField(f.name), f.dataType, earlier, entity)
    return total
