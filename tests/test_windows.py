import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from etlspec.operators import windows
from etlspec.operators.sizes import SPLIT_ROWS, any_large, large_groups
from etlspec.operators.windows import add_window, parse_call
from etlspec.plans.spec import Order


@pytest.fixture(scope="module")
def events(spark):
    """One key holds most rows; the order columns have nulls, ties and ends far out."""
    rng = random.Random(7)
    data = []
    for i in range(400):
        key = "hot" if i % 5 else rng.choice(["a", "b", None])
        score = rng.choice([None, 1.5, 2.0, -7.0, 1e12, float(rng.randrange(50)), float(rng.randrange(50))])
        tied = rng.choice([0, 0, 0, 0, 0, 1, 2])
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(40))
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(10_000))
        text = rng.choice([None, "", "user/long/prefix/" + rng.choice("abcdeé") * rng.randrange(4) + str(i % 9)])
        data.append((i, key, score, tied, day, at, text, rng.choice([None, 1, 2, 3])))
    schema = "id INT, k STRING, score DOUBLE, tied INT, day DATE, at TIMESTAMP, text STRING, x INT"
    return spark.createDataFrame(data, schema).repartition(4).cache()


def plain(df, expression, keys, order_by):
    order = [F.col(o.column).desc() if o.desc else F.col(o.column).asc() for o in order_by]
    return df.withColumn("w", F.expr(expression).over(Window.partitionBy(*keys).orderBy(*order)))


def values(df):
    return {r.id: round(r.w, 9) if isinstance(r.w, float) else r.w for r in df.select("id", "w").collect()}


# Every function once, every kind of ordering at least once.
WITH_PEERS = [
    ("rank()", ["k"], [Order("score", True)]),
    ("dense_rank()", [], [Order("tied"), Order("day", True)]),
    ("percent_rank()", ["k"], [Order("text"), Order("tied")]),
    ("cume_dist()", [], [Order("tied", True)]),
    ("count(*)", ["k"], [Order("at"), Order("tied", True)]),
    ("sum(x)", ["k"], [Order("tied", True)]),
    ("min(x)", [], [Order("score")]),
    ("max(x)", ["k"], [Order("text", True)]),
    ("avg(x)", ["k"], [Order("day")]),
]
ROW_WISE = [
    ("row_number()", ["k"], [Order("score"), Order("id")]),
    ("ntile(7)", [], [Order("text", True), Order("id", True)]),
    ("lag(x, 3)", ["k"], [Order("score", True), Order("id")]),
    ("lead(x, 30, -1)", [], [Order("tied"), Order("id", True)]),
]


@pytest.mark.parametrize("expression, keys, order_by", WITH_PEERS + ROW_WISE, ids=str)
def test_large_groups_give_the_same_result(events, expression, keys, order_by):
    got = add_window(events, "w", expression, keys, order_by, split_rows=60)
    assert values(got) == values(plain(events, expression, keys, order_by))
    assert got.columns == [*events.columns, "w"]


def test_row_number_among_equal_rows_is_a_permutation(events):
    got = add_window(events, "w", "row_number()", [], [Order("tied")], split_rows=60)
    numbers = sorted((r.w, r.tied) for r in got.select("w", "tied").collect())
    assert [n for n, _ in numbers] == list(range(1, 401))
    assert [t for _, t in numbers] == sorted(t for _, t in numbers)


def sizes(df, order_by, limit):
    slices = windows._Slices(df, df.withColumn("__group", F.lit(0)), order_by, limit)
    return [r[-1] for r in slices.frame.groupBy(*slices.place, "__salt").agg(F.count("*")).collect()]


@pytest.mark.parametrize(
    "order_by",
    [[Order("tied"), Order("day")], [Order("tied")], [Order("score", True), Order("text")], [Order("text", True)], [Order("at")]],
    ids=str,
)
def test_slices_stay_below_the_limit(events, order_by):
    found = sizes(events, order_by, 60)
    assert max(found) <= 60 and sum(found) == 400


@pytest.mark.parametrize(
    "value",
    ["0", "concat(repeat('same prefix ', 30), id)", "cast(concat(repeat('b', 40), id) AS binary)", "named_struct('a', id div 9, 'b', -id)",
     "timestamp_micros(1700000000000000 + id)", "cast(timestamp_micros(1700000000000000 + id) AS timestamp_ntz)",
     "cast(id AS decimal(38, 10)) / 7", "if(id % 3 = 0, double('NaN'), id)", "9007199254740992 + id", "array(id div 50, id)"],
)
def test_any_sort_key_is_cut(spark, value, caplog):
    df = spark.range(1000).selectExpr("id", f"{value} AS o", "id % 7 AS x").repartition(3)
    assert max(sizes(df, [Order("o")], 100)) <= 100
    assert "cannot be cut" not in caplog.text
    for expression, order_by in (("rank()", [Order("o", True)]), ("sum(x)", [Order("o")])):
        got = add_window(df, "w", expression, [], order_by, split_rows=100)
        assert values(got) == values(plain(df, expression, [], order_by))


def test_rows_that_are_all_equal_are_told(spark, caplog):
    df = spark.range(1000).selectExpr("0 AS id", "1 AS o").repartition(3)
    assert sum(sizes(df, [Order("o")], 100)) == 1000
    assert "cannot be cut further" in caplog.text


def test_cuts_in_several_levels(spark, monkeypatch):
    monkeypatch.setattr(windows, "STEPS", (2, 1))
    monkeypatch.setattr(windows, "FANOUT", 4)
    df = spark.range(1000).selectExpr("id", "id % 2 AS k", "(id * 7919) % 1000 div 3 AS o", "id % 5 AS x").repartition(3)
    for expression in ("dense_rank()", "row_number()", "max(x)"):
        order_by = [Order("o", True), Order("id")]
        got = add_window(df, "w", expression, ["k"], order_by, split_rows=20)
        assert values(got) == values(plain(df, expression, ["k"], order_by))


def test_long_sort_keys_make_larger_slices(spark, monkeypatch, caplog):
    monkeypatch.setattr(windows, "CUT_BYTES", 4000)
    df = spark.range(1000).selectExpr("id", "concat(repeat('long', 50), id) AS o")
    got = add_window(df, "w", "row_number()", [], [Order("o")], split_rows=50)
    assert "sort keys are long" in caplog.text
    assert values(got) == values(plain(df, "row_number()", [], [Order("o")]))


@pytest.mark.parametrize(
    "expression",
    ["stddev(score)", "stddev_pop(x)", "variance(x)", "var_pop(x + 1e9)", "avg(cast(x AS decimal(12, 3)))", "sum(cast(x AS decimal(12, 3)))",
     "count_if(x > 1)", "bool_and(x < 3)", "some(x > 2)", "mean(x)", "var_samp(if(id = 100, double('NaN'), x))"],
)
def test_functions_completed_by_carried_states(events, expression):
    for keys, order_by in ((["k"], [Order("score"), Order("day", True)]), ([], [Order("tied", True)])):
        got = add_window(events, "w", expression, keys, order_by, split_rows=60)
        assert "__slice" in got._jdf.queryExecution().toString()
        want, found = values(plain(events, expression, keys, order_by)), values(got)
        assert found.keys() == want.keys()
        for i, w in want.items():
            assert str(found[i]) == str(w) or float(found[i]) == pytest.approx(float(w), rel=1e-7, abs=1e-6)


def test_numbers_beyond_the_type_are_an_error(spark):
    slices = windows._Slices(spark.range(10), spark.range(10).withColumn("__group", F.lit(0)), [Order("id")], 5)
    out = slices._finish(slices.frame, "w", F.col("id") + F.lit(2**31 - 5), T.IntegerType())
    with pytest.raises(Exception, match="beyond 2147483647"):
        out.collect()


def test_frequent_keys_come_from_a_sketch(events):
    found, limit = large_groups(events, ["k"], 60)
    assert limit == 60 and found.to_pylist() == [{"__key0": "hot", "__rows": 320}]
    assert any_large([(events, ["id"]), (events, ["k"])], 60) and not any_large([(events, ["id"]), (events, ["x"])], 390)
    everything, _ = large_groups(events, [], 60)
    assert everything.to_pylist() == [{"__rows": 400}]
    assert len(large_groups(events.limit(0), ["k"], 60)[0]) == 0


def test_nothing_is_cut_when_groups_are_small_or_splitting_is_off(events):
    for limit in (SPLIT_ROWS, None):
        got = add_window(events, "w", "rank()", ["k"], [Order("score")], split_rows=limit)
        assert "__group" not in got._jdf.queryExecution().toString()


def test_functions_that_cannot_be_completed_run_plainly(events, caplog):
    order_by = [Order("id")]
    got = add_window(events, "w", "collect_list(x)", ["k"], order_by, split_rows=60)
    assert "one task" in caplog.text
    assert values(got) == values(plain(events, "collect_list(x)", ["k"], order_by))


def test_replaces_a_column_in_place(events):
    got = add_window(events, "tied", "row_number()", [], [Order("id")], split_rows=60)
    assert got.columns == events.columns
    assert [r.tied for r in got.orderBy("id").collect()] == list(range(1, 401))
    small = add_window(events, "x", "sum(x)", ["k"])
    assert small.columns == events.columns


@pytest.mark.parametrize("expression", ["row_number()", "rank()", "lag(x, 1)", "ntile(2)"])
def test_ranking_without_order_is_refused(events, expression):
    with pytest.raises(ValueError, match="order_by"):
        add_window(events, "w", expression, ["k"])


def test_partition_total_includes_null_keys_and_any_aggregate(events):
    for expression in ("sum(x)", "count(*)", "count(distinct x)", "max(x) - min(x)"):
        got = add_window(events, "w", expression, ["k"])
        want = {r.k: r[1] for r in events.groupBy("k").agg(F.expr(expression)).collect()}
        assert {r.id: r.w for r in got.collect()} == {r.id: want[r.k] for r in events.collect()}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("row_number()", ("row_number", ())),
        (" LAG(a, 1) ", ("lag", ("a", "1"))),
        ("sum(coalesce(a, 0))", ("sum", ("coalesce(a, 0)",))),
        ("lag(concat(a, ','), 2, 'x)')", ("lag", ("concat(a, ',')", "2", "'x)'"))),
        ("sum(a) / count(b)", None),
        ("a + 1", None),
        ("sum(a) filter (where b)", None),
    ],
)
def test_parse_call(text, expected):
    call = parse_call(text)
    assert (call and (call.function, call.args)) == expected
