"""The window transform.

``F.expr(expression).over(window)`` is what the transform means, and what runs
for groups of ordinary size. Spark gives each window group to one task, though,
so three cases are planned differently:

* a partition total (no ordering) is a map-side aggregate joined back;
* in an ordered window, the rows of groups that are too large for one task (a
  frequent key, or the one group of a window without ``partition_by``) are cut
  into slices along their sort order. The function runs inside each slice, and
  totals of the earlier slices complete it. All other rows run the plain way;
* a function that totals cannot complete runs the plain way, with a warning
  when a group is that large.

Which groups are large, and where they are cut, is read when the transform is
planned and constant in the plan, so a repeated task sees the same slices. A
group counts as large above ``split_rows`` rows or above 1/MAX_LARGE of all rows,
whichever is more: fewer than MAX_LARGE groups can be large, and there are at most
2 * MAX_LARGE cuts, which bounds what reaches the driver and what is broadcast.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etlspec.functions.canonical import has_map, quoted
from etlspec.operators.sizes import SPLIT_ROWS, large_groups
from etlspec.plans.spec import Order

_log = logging.getLogger(__name__)

# 6 comparisons find a row's place among up to 63 cuts, each leaf of which may hold 63 more.
STEPS = (32, 16, 8, 4, 2, 1)
FANOUT = 2 * STEPS[0]
# Rows sampled for each slice, and the bytes of all cuts together; longer ones are thinned out.
SAMPLED = 32
CUT_BYTES = 64 << 20

# Functions Spark refuses to run without an ordering.
NEED_ORDER = (
    "row_number",
    "rank",
    "dense_rank",
    "percent_rank",
    "cume_dist",
    "ntile",
    "lag",
    "lead",
)
# Functions of one argument that totals of earlier slices complete, and what each of them stands for.
RUNNING = {
    "count": "count", "count_if": "count", "sum": "sum", "avg": "avg", "mean": "avg",
    "min": "min", "bool_and": "min", "every": "min", "max": "max", "bool_or": "max", "any": "max", "some": "max",
}
SPREAD = {
    "stddev": "samp", "stddev_samp": "samp", "std": "samp", "variance": "samp", "var_samp": "samp",
    "stddev_pop": "pop", "var_pop": "pop",
}

_CALL = re.compile(r"\s*([A-Za-z_]\w*)\s*\((.*)\)\s*", re.DOTALL)


def add_window(
    df: DataFrame,
    name: str,
    expression: str,
    partition_by: Sequence[str] = (),
    order_by: Sequence[Order] = (),
    split_rows: int | None = SPLIT_ROWS,
) -> DataFrame:
    """Add ``name`` = ``expression`` over the window, replacing a column of that name.

    With an ordering, a sketch of frequent keys is taken first (one pass over the
    key columns). ``split_rows=None`` leaves that out and always runs plainly.
    """
    call = parse_call(expression)
    if not order_by:
        if call and call.function in NEED_ORDER:
            raise ValueError(f'"{call.function}" needs "order_by"')
        return _partition_total(df, name, expression, partition_by)

    window = Window.partitionBy(*map(quoted, partition_by)).orderBy(*_ordering(order_by))
    plain = df.withColumn(name, F.expr(expression).over(window))
    groups, limit = large_groups(df, partition_by, split_rows) if split_rows is not None else (None, 0)
    if not groups:
        return plain
    result_type = plain.schema[name].dataType
    if not _can_complete(call):
        _log.warning('window "%s": %d groups are large, and %s takes one task for each', name, len(groups), expression)
        return plain

    large = _keyed(df, partition_by, groups)
    same = _all([quoted(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(partition_by)] or [F.lit(True)])
    hot = df.join(F.broadcast(large), same) if partition_by else df.withColumn("__group", F.lit(0))
    done = _Slices(df, hot, order_by, limit, f'window "{name}"').compute(name, call, result_type)
    if not partition_by:
        return done
    rest = df.join(F.broadcast(large), same, "left_anti")
    return rest.withColumn(name, F.expr(expression).over(window)).unionByName(done)


# --------------------------------------------------------------------------
# Reading the expression


@dataclass(frozen=True)
class Call:
    function: str
    args: tuple[str, ...]


def parse_call(expression: str) -> Call | None:
    """``name(arg, ..)`` as a record, or None when the text is not one call."""
    found = _CALL.fullmatch(expression)
    args = _top_level_args(found.group(2)) if found else None
    return None if args is None else Call(found.group(1).lower(), args)


def _top_level_args(text: str) -> tuple[str, ...] | None:
    parts, depth, quote, start = [], 0, None, 0
    for i, ch in enumerate(text):
        if quote:
            quote = None if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
            if depth < 0:
                return None
        elif ch == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    if depth or quote:
        return None
    last = text[start:].strip()
    return tuple(parts + [last]) if last else tuple(parts)


def _can_complete(call: Call | None) -> bool:
    if call is None:
        return False
    if call.function in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
        return not call.args
    if call.function == "ntile":
        return len(call.args) == 1 and call.args[0].isdigit()
    if call.function in ("lag", "lead"):
        return 1 <= len(call.args) <= 3 and (len(call.args) == 1 or call.args[1].isdigit())
    one = len(call.args) == 1 and not call.args[0].lower().startswith("distinct ")
    return one and (call.function in RUNNING or call.function in SPREAD)


def _ordering(order_by: Sequence[Order], reverse: bool = False) -> list[Column]:
    return [quoted(o.column).desc() if o.desc != reverse else quoted(o.column).asc() for o in order_by]


# --------------------------------------------------------------------------
# No ordering


def _partition_total(df: DataFrame, name: str, expression: str, keys: Sequence[str]) -> DataFrame:
    """Aggregate before the shuffle, then join the one row per group back."""
    key_names = [f"__key{i}" for i in range(len(keys))]
    totals = df.groupBy(*[quoted(k).alias(n) for k, n in zip(keys, key_names)]).agg(
        F.expr(expression).alias("__total")
    )
    same = _all([quoted(k).eqNullSafe(F.col(n)) for k, n in zip(keys, key_names)])
    return df.join(totals, same, "left").withColumn(name, F.col("__total")).drop("__total", *key_names)


def _all(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


# --------------------------------------------------------------------------
# Large groups


def _keyed(df: DataFrame, keys: Sequence[str], groups: pa.Table) -> DataFrame:
    """The large groups as a frame: their keys and a number for each."""
    types = df.select(*map(quoted, keys)).schema.fields
    schema = T.StructType(
        [*[T.StructField(f"__key{i}", f.dataType) for i, f in enumerate(types)], T.StructField("__group", T.IntegerType())]
    )
    numbered = groups.select([f"__key{i}" for i in range(len(keys))]).append_column("__group", pa.array(range(len(groups)), pa.int32()))
    return df.sparkSession.createDataFrame(numbered, schema)


class _Slices:
    """The rows of large groups, each group cut into slices along the sort order.

    A sample of the rows is sorted by all order columns as Spark sorts them, and
    every n-th sampled row is a cut; slice 2 k holds the rows after k cuts and
    before the next one. Values that several cuts share are frequent: the rows
    equal to such a cut are a slice of their own, 2 k + 1. So rows that agree in
    all order columns are in one slice, and a function with peers (rank, running
    totals) finds all peers there. A slice of nothing but peers may be large; its
    rows are spread by a salt, which row-wise functions treat as a further part
    of the place (the order of peers is free) and functions with peers do not
    need, as totals alone give their result there. What cannot be cut further,
    rows equal in all columns, is told in a warning.

    The cuts are a broadcast search tree with 63 of them to a node, so a row
    meets one node for each level and never a long list.
    """

    def __init__(self, df: DataFrame, hot: DataFrame, order_by: Sequence[Order], limit: int, label: str = "window"):
        self.columns = df.columns
        self.order_by = list(order_by)
        self.limit = limit
        self.label = label
        self.frame = hot.select(*map(quoted, df.columns), "__group")
        self._slice()
        self._salt()

    place = ["__group", "__slice"]

    # -- cutting

    def _cuts(self) -> pa.Table:
        """(__group, __at, __c0, .., __frequent): the distinct cuts of each group, numbered from 0 in the sort order."""
        names = [f"__c{i}" for i in range(len(self.order_by))]
        fraction = min(1.0, 2 * SAMPLED / self.limit)
        step = max(1, round(self.limit / 2 * fraction))
        sample = self.frame.sample(fraction, seed=1) if fraction < 1 else self.frame
        sample = sample.select("__group", *[quoted(o.column).alias(n) for o, n in zip(self.order_by, names)])
        sort = [F.col(n).desc() if o.desc else F.col(n).asc() for o, n in zip(self.order_by, names)]
        group = Window.partitionBy("__group")
        picked = sample.withColumn("__row", F.row_number().over(group.orderBy(*sort))).filter(F.col("__row") % step == 0)
        value = F.struct(*names)
        new = ~value.eqNullSafe(F.lag(value).over(group.orderBy("__row")))
        cuts = picked.select("__group", "__row", *names, new.alias("__new"))
        cuts = cuts.withColumn("__at", F.sum(F.col("__new").cast("long")).over(group.orderBy("__row")) - 1)
        cuts = cuts.groupBy("__group", "__at").agg(*[F.first(n).alias(n) for n in names], (F.count(F.lit(1)) > 1).alias("__frequent"))
        found = cuts.toArrow()
        found = found.take(pc.sort_indices(found, [("__group", "ascending"), ("__at", "ascending")])).combine_chunks()
        while found.nbytes > CUT_BYTES and len(found) > 1:
            _log.warning("%s: the sort keys are long, so slices are twice as large", self.label)
            found = found.filter(pc.equal(pc.bit_wise_and(found["__at"], 1), 0))
            halved = pc.shift_right(found["__at"], 1)
            found = found.set_column(found.schema.get_field_index("__at"), "__at", halved).combine_chunks()
        return found

    def _slice(self) -> None:
        cuts, spark = self._cuts(), self.frame.sparkSession
        kinds = [self.frame.select(quoted(o.column)).schema[0].dataType for o in self.order_by]
        cut_type = T.StructType([T.StructField(f"__c{i}", kind) for i, kind in enumerate(kinds)])
        values = pa.StructArray.from_arrays(
            [cuts[f.name].combine_chunks() if isinstance(cuts[f.name], pa.ChunkedArray) else cuts[f.name] for f in cut_type], names=cut_type.names
        )
        group, at = cuts["__group"].to_numpy(), cuts["__at"].to_numpy()
        kept = self.frame.columns
        most = int(at.max()) + 1 if len(at) else 0
        unit = 1
        while unit * FANOUT <= most:
            unit *= FANOUT
        rows, number = self.frame, F.lit(0).cast("long")
        node_type = T.StructType(
            [T.StructField("__g", T.IntegerType()), T.StructField("__node", T.LongType()), T.StructField("__cuts", T.ArrayType(cut_type))]
        )
        while most and unit:
            mine = np.flatnonzero(((at + 1) % unit == 0) & ((at + 1) % (unit * FANOUT) != 0))
            node = (at[mine] + 1) // (unit * FANOUT)
            first = np.flatnonzero(np.diff(node, prepend=-1).astype(bool) | np.diff(group[mine], prepend=-1).astype(bool))
            lists = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(mine)], pa.int32()), values.take(pa.array(mine)))
            table = pa.table({"__g": pa.array(group[mine][first], pa.int32()), "__node": pa.array(node[first], pa.int64()), "__cuts": lists})
            nodes = F.broadcast(spark.createDataFrame(table, node_type))
            rows = rows.withColumn("__before", number).join(nodes, (F.col("__group") == F.col("__g")) & (F.col("__before") == F.col("__node")), "left")
            digit = F.aggregate(  # a binary search for the number of cuts before the row
                F.array(*map(F.lit, STEPS)),
                F.lit(0),
                lambda n, step: n + F.when(self._comes_before(F.get("__cuts", n + step - 1)), step).otherwise(0),
            )
            rows = rows.select(*map(quoted, kept), (F.col("__before") * FANOUT + digit).alias("__found"))
            number = F.col("__found")
            unit //= FANOUT
        frequent = cuts.filter(cuts["__frequent"])
        own = F.lit(0)
        if len(frequent):
            schema = T.StructType([T.StructField("__g", T.IntegerType()), T.StructField("__node", T.LongType()), *cut_type.fields])
            renamed = frequent.select(["__group", "__at", *cut_type.names]).rename_columns(["__g", "__node", *cut_type.names])
            table = F.broadcast(spark.createDataFrame(renamed, schema))
            rows = rows.join(table, (F.col("__group") == F.col("__g")) & (F.col("__found") == F.col("__node")), "left")
            equal = _all([quoted(o.column).eqNullSafe(F.col(f"__c{i}")) for i, o in enumerate(self.order_by)])
            own = F.when(F.col("__node").isNotNull() & equal, 1).otherwise(0)
        # never null, so a join need not test it again
        self.frame = rows.select(*map(quoted, kept), F.coalesce(number * 2 + own, F.lit(0)).alias("__slice"))

    def _comes_before(self, cut: Column) -> Column:
        """Whether ``cut`` sorts before the row; null cuts never do."""
        result = F.lit(False)
        for i, o in reversed(list(enumerate(self.order_by))):
            its, own = cut.getField(f"__c{i}"), quoted(o.column)
            # nulls come first going up and last going down
            less = F.coalesce(own < its, own.isNull()) if o.desc else F.coalesce(its < own, its.isNull())
            result = F.when(its.eqNullSafe(own), result).otherwise(less)
        return cut.isNotNull() & result

    def _salt(self) -> None:
        """Spread the rows of slices that hold only peers, and tell what stays large."""
        sizes = self.frame.groupBy(*self.place).agg(F.count(F.lit(1)).alias("__rows")).filter(F.col("__rows") > self.limit).toArrow()
        flat = sizes.filter(pc.equal(pc.bit_wise_and(sizes["__slice"], 1), 1))
        left = len(sizes) - len(flat)
        salt, is_flat = F.lit(0), (F.col("__slice") % 2) == 1
        if len(flat):
            salts = pa.array([-(-2 * n // self.limit) for n in flat["__rows"].to_pylist()], pa.int32())
            schema = "__group INT, __slice LONG, __salts INT"
            pinned = self.frame.sparkSession.createDataFrame(flat.select(self.place).append_column("__salts", salts), schema)
            hashed = [quoted(f.name) for f in self.frame.schema.fields if not has_map(f.dataType)]
            kept = self.frame.columns
            salt = F.coalesce(F.pmod(F.xxhash64(*hashed), F.col("__salts")).cast("int"), F.lit(0))
            salted = self.frame.join(F.broadcast(pinned), self.place, "left").select(*map(quoted, kept), salt.alias("__salt"), is_flat.alias("__flat"))
            self.frame = salted
            left += salted.filter("__flat").groupBy(*self.place, "__salt").count().filter(F.col("count") > self.limit).count()
        else:
            self.frame = self.frame.withColumns({"__salt": salt, "__flat": is_flat})
        if left:
            _log.warning("%s: %d slices of more than %d rows cannot be cut further and take one task each", self.label, left, self.limit)

    # -- pieces shared by the functions

    def _window(self, reverse: bool = False):
        return Window.partitionBy(*self.place, "__salt").orderBy(*_ordering(self.order_by, reverse))

    def _subtotals(self, place: list[str], aggs: dict[str, Column], earlier: dict[str, Column], reverse: bool = False):
        """Per slice: ``aggs`` of its own rows, and ``earlier`` over the slices before it."""
        per_slice = self.frame.groupBy(*place).agg(
            F.count(F.lit(1)).alias("__rows"), *[column.alias(alias) for alias, column in aggs.items()]
        )
        order = [F.col("__slice").desc() if reverse else F.col("__slice").asc(), *([F.col("__salt")] if "__salt" in place else [])]
        group = Window.partitionBy("__group")
        before = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return per_slice.select(
            *place,
            *aggs,
            *[column.over(before).alias(alias) for alias, column in earlier.items()],
            F.sum("__rows").over(group).alias("__group_rows"),
        )

    def _finish(self, rows: DataFrame, name: str, value: Column, dtype: T.DataType) -> DataFrame:
        if isinstance(dtype, T.IntegerType):
            text = f"{self.label}: a number is beyond 2147483647, and {dtype.simpleString()} is the type of this function"
            wide = value.cast("long")
            value = F.when((wide > 2**31 - 1) | (wide < -(2**31)), F.raise_error(text).cast("int")).otherwise(value)
        done = value.cast(dtype).alias(name)
        kept = [done if c == name else quoted(c) for c in self.columns]
        return rows.select(*kept, *([] if name in self.columns else [done]))

    # -- functions

    def compute(self, name: str, call: Call, dtype: T.DataType) -> DataFrame:
        if call.function in ("lag", "lead"):
            return self._shift(name, call, dtype)
        if call.function in ("row_number", "ntile"):
            return self._numbering(name, call, dtype)
        if call.function in SPREAD:
            return self._spread(name, call, dtype)
        if call.function in RUNNING or call.function == "cume_dist":
            return self._running(name, call, dtype)
        return self._ranking(name, call, dtype)

    def _numbered(self, reverse: bool = False) -> DataFrame:
        """Rows with ``__number``, their place in the whole group."""
        place = [*self.place, "__salt"]
        before = self._subtotals(place, {}, {"__before": F.sum("__rows")}, reverse)
        local = self.frame.withColumn("__local", F.row_number().over(self._window(reverse)))
        return local.join(before, place).withColumn(
            "__number", F.col("__local") + F.coalesce(F.col("__before"), F.lit(0))
        )

    def _numbering(self, name: str, call: Call, dtype: T.DataType) -> DataFrame:
        rows = self._numbered()
        if call.function == "row_number":
            return self._finish(rows, name, F.col("__number"), dtype)
        return self._finish(rows, name, _tile(F.col("__number"), F.col("__group_rows"), int(call.args[0])), dtype)

    def _ranking(self, name: str, call: Call, dtype: T.DataType) -> DataFrame:
        """rank and relatives; in a slice of peers the local rank is 1 for all."""
        dense = call.function == "dense_rank"
        values = F.count_distinct(F.struct(*[quoted(o.column) for o in self.order_by]))
        aggs = {"__steps": values if dense else F.count(F.lit(1))}
        before = self._subtotals(self.place, aggs, {"__before": F.sum("__steps")})
        local = (F.dense_rank() if dense else F.rank()).over(self._window())
        rows = self.frame.withColumn("__local", local).join(before, self.place)
        rank = F.col("__local") + F.coalesce(F.col("__before"), F.lit(0))
        if call.function == "percent_rank":
            others = F.col("__group_rows") - 1
            return self._finish(rows, name, F.when(others > 0, (rank - 1) / others).otherwise(0.0), dtype)
        return self._finish(rows, name, rank, dtype)

    def _running(self, name: str, call: Call, dtype: T.DataType) -> DataFrame:
        """count, sum, avg, min, max and cume_dist up to the current row and its peers."""
        kind = RUNNING.get(call.function, call.function)
        value = F.lit(1) if kind == "cume_dist" or call.args[0] == "*" else F.expr(call.args[0])
        if call.function == "count_if":
            value = F.when(value, 1)
        exact = isinstance(dtype, T.DecimalType)
        value = value.cast("double") if kind == "avg" and not exact else value
        self.frame = self.frame.withColumn("__value", value)
        function, merge = {"min": (F.min, F.min), "max": (F.max, F.max)}.get(kind, (F.sum, F.sum))
        parts = {"__n": F.count("__value")}
        if kind in ("sum", "avg", "min", "max"):
            parts["__part"] = function("__value")
        earlier = {f"{alias}_before": (F.sum if alias == "__n" else merge)(alias) for alias in parts}
        before = self._subtotals(self.place, parts, earlier)
        local = {f"{alias}_local": column.over(self._window()) for alias, column in parts.items()}
        rows = self.frame.withColumns(local).join(before, self.place)

        def here(alias: str) -> Column:
            return F.when(F.col("__flat"), F.col(alias)).otherwise(F.col(f"{alias}_local"))

        count = here("__n") + F.coalesce(F.col("__n_before"), F.lit(0))
        if kind == "count":
            return self._finish(rows, name, count, dtype)
        if kind == "cume_dist":
            return self._finish(rows, name, count / F.col("__group_rows"), dtype)
        part, earlier_part = here("__part"), F.col("__part_before")
        if kind in ("min", "max"):
            pick = F.least if kind == "min" else F.greatest
            return self._finish(rows, name, pick(part, earlier_part), dtype)
        total = F.coalesce(part + earlier_part, part, earlier_part)
        share = total / (count.cast("decimal(20,0)") if exact else count)
        return self._finish(rows, name, total if kind == "sum" else F.when(count > 0, share), dtype)

    def _spread(self, name: str, call: Call, dtype: T.DataType) -> DataFrame:
        """Variances and deviations: each slice hands on its count, mean and squared differences.

        They are merged pair by pair in the order of the slices, so no large sums
        of squares meet and cancel.
        """
        self.frame = self.frame.withColumn("__value", F.expr(call.args[0]).cast("double"))
        square = F.var_pop("__value") * F.count("__value")
        slices = self.frame.groupBy(*self.place).agg(F.count("__value").alias("__n"), F.avg("__value").alias("__mean"), square.alias("__sq"))
        carried = slices.groupBy("__group").applyInPandas(_carry_moments, f"{slices.schema.simpleString()[7:-1]}, __n_before long, __mean_before double, __sq_before double")
        window = self._window()
        local = {"__n_local": F.count("__value").over(window), "__mean_local": F.avg("__value").over(window), "__var_local": F.var_pop("__value").over(window)}
        rows = self.frame.withColumns(local).withColumn("__sq_local", F.col("__var_local") * F.col("__n_local"))
        rows = rows.join(carried, self.place)

        def here(alias: str) -> Column:
            return F.when(F.col("__flat"), F.col(alias)).otherwise(F.col(f"{alias}_local"))

        def told(column: Column) -> Column:  # what is not a number comes back from pandas as null
            return F.coalesce(column, F.lit(float("nan")))

        n, before = here("__n"), F.col("__n_before")
        own, earlier = told(here("__sq")), told(F.col("__sq_before"))
        count, apart = before + n, told(here("__mean")) - told(F.col("__mean_before"))
        total = F.when(before == 0, own).when(n == 0, earlier).otherwise(earlier + own + apart * apart * before * n / count)
        sample = SPREAD[call.function] == "samp"
        variance = F.when(count > (1 if sample else 0), total / (count - 1 if sample else count))
        return self._finish(rows, name, F.sqrt(variance) if call.function.startswith("std") else variance, dtype)

    def _shift(self, name: str, call: Call, dtype: T.DataType) -> DataFrame:
        """lag and lead: rows near the start of a slice look into earlier slices.

        Row ``p`` of a group needs row ``p - n``. If that one is in an earlier
        slice it is among that slice's last ``n`` rows, so only those are kept
        for the lookup.
        """
        back = int(call.args[1]) if len(call.args) > 1 else 1
        reverse = call.function == "lead"
        self.frame = self.frame.withColumn("__value", F.expr(call.args[0]))
        window, whole = self._window(reverse), Window.partitionBy(*self.place, "__salt")
        rows = self._numbered(reverse).withColumns(
            {"__near": F.lag("__value", back).over(window), "__size": F.count(F.lit(1)).over(whole)}
        )
        ends = rows.filter(F.col("__local") > F.col("__size") - back).select(
            "__group",
            (F.col("__number") + back).alias("__number"),
            F.col("__value").alias("__far"),
            F.lit(True).alias("__found"),
        )
        near = rows.filter(F.col("__local") > back)
        first = rows.filter(F.col("__local") <= back).join(ends, ["__group", "__number"], "left")
        default = F.expr(call.args[2]) if len(call.args) == 3 else F.lit(None)
        return self._finish(near, name, F.col("__near"), dtype).unionByName(
            self._finish(first, name, F.when(F.col("__found"), F.col("__far")).otherwise(default), dtype)
        )


def _carry_moments(slices: pd.DataFrame) -> pd.DataFrame:
    """Count, mean and squared differences of all slices of a group before each one."""
    slices = slices.sort_values("__slice")
    count, mean, square, carried = 0, 0.0, 0.0, []
    for n, own_mean, own_square in zip(slices["__n"].tolist(), slices["__mean"].tolist(), slices["__sq"].tolist()):
        carried.append((count, mean, square))
        if n:
            apart = own_mean - mean
            square = square + own_square + apart * apart * count * n / (count + n) if count else own_square
            mean = mean + apart * n / (count + n) if count else own_mean
            count += n
    before = pd.DataFrame(carried, columns=["__n_before", "__mean_before", "__sq_before"], index=slices.index)
    return pd.concat([slices, before], axis=1)


def _tile(position: Column, total: Column, tiles: int) -> Column:
    """ntile from a row's position: the first ``total % tiles`` tiles get one row more."""
    small = F.floor(total / F.lit(tiles))
    longer = total % F.lit(tiles)
    in_longer = longer * (small + 1)
    return F.when(position <= in_longer, F.ceil(position / (small + 1))).otherwise(
        longer + F.ceil((position - in_longer) / F.greatest(small, F.lit(1)))
    )
