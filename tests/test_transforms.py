import pytest

from etlspec import TransformError, run_pipeline
from etlspec.operators.joins import join
from etlspec.operators.quality import find_orphans
from etlspec.operators.snapshots import scope_to
from etlspec.operators.projection import rename, run_sql
from tests.conftest import collected


def run(spark, frames, *steps, **rest):
    return run_pipeline(spark, {"transforms": list(steps), **rest}, frames=frames)


@pytest.fixture
def orders(rows):
    data = [(1, 1, 50.0, "paid"), (2, 1, 150.0, "paid"), (3, 2, 10.0, "cancelled"), (4, None, 99.0, None)]
    return rows(data, "order_id INT, customer_id INT, amount DOUBLE, status STRING")


@pytest.fixture
def empty(rows):
    return rows([], "k INT, v STRING")


def test_filter_drops_unknown_outcomes(spark, orders):
    out = run(spark, {"orders": orders}, {"type": "filter", "condition": 'F.col("status") != "cancelled"'}).output
    assert [r.order_id for r in out.orderBy("order_id").collect()] == [1, 2]


def test_select_keeps_order_and_missing_names_fail(spark, orders):
    assert run(spark, {"o": orders}, {"type": "select", "columns": ["amount", "order_id"]}).output.columns == [
        "amount",
        "order_id",
    ]
    with pytest.raises(TransformError, match=r"transforms\[0\].*nope"):
        run(spark, {"o": orders}, {"type": "select", "columns": ["nope"]})


def test_drop_ignores_unknown_names(spark, orders):
    out = run(spark, {"o": orders}, {"type": "drop_columns", "columns": ["status", "nope"]}).output
    assert out.columns == ["order_id", "customer_id", "amount"]


def test_rename_swaps_chains_and_refuses_clashes(rows):
    swap = rows([(1, 10)], "a INT, b INT")
    assert rename(swap, {"a": "b", "b": "a"}).first().asDict() == {"b": 1, "a": 10}
    assert rename(swap, {"a": "b", "b": "c"}).first().asDict() == {"b": 1, "c": 10}
    assert rename(swap, {"zz": "a"}).columns == ["a", "b"]
    with pytest.raises(ValueError, match="b"):
        rename(swap, {"a": "b"})


def test_add_column_replaces_in_place(spark, orders):
    out = run(spark, {"o": orders}, {"type": "add_column", "name": "amount", "expression": 'F.col("amount") * 1.08'}).output
    assert out.columns == orders.columns
    assert out.orderBy("order_id").first().amount == pytest.approx(54.0)


def test_sql_sees_all_frames_and_rebinding_keeps_earlier_results(spark, orders):
    result = run(
        spark,
        {"orders": orders},
        {"type": "sql", "output": "early", "query": "SELECT count(*) AS n FROM orders"},
        {"type": "filter", "source": "orders", "condition": "order_id = 1"},
        {"type": "sql", "output": "late", "query": "SELECT e.n, count(*) AS m FROM orders, early e GROUP BY e.n"},
    )
    assert tuple(result.output.first()) == (4, 1)


@pytest.mark.parametrize(
    "text",
    [
        "DROP TABLE x", "INSERT INTO x VALUES (1)", "", "CREATE VIEW v AS SELECT 1", "SET a=b", "not a query",
        "WITH q AS (SELECT 1 AS a) INSERT INTO x SELECT a FROM q",
        "FROM y INSERT INTO x SELECT a INSERT INTO z SELECT b",
        "/* SELECT */ DELETE FROM x WHERE a = 1",
        "WITH q AS (SELECT 1 AS a) DELETE FROM x WHERE a IN (SELECT a FROM q)",
        "WITH q AS (SELECT 1 AS a) UPDATE x SET a = 2 WHERE a IN (SELECT a FROM q)",
        "MERGE INTO x USING y ON x.a = y.a WHEN MATCHED THEN DELETE",
        "WITH q AS (SELECT 1 AS a) MERGE INTO x USING q ON x.a = q.a WHEN NOT MATCHED THEN INSERT *",
        "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1",
        "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'DROP TABLE x'", "CACHE TABLE x", "SHOW TABLES", "TRUNCATE TABLE x",
    ],
)
def test_sql_takes_queries_only(spark, text):
    with pytest.raises(ValueError, match="may only read|not a query"):
        run_sql(spark, {}, text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT 'INSERT INTO x' AS a, `delete from` FROM VALUES (1) AS t(`delete from`)",
        "-- DROP TABLE x\nFROM VALUES (1) AS t(a) SELECT a",
        "WITH a AS (WITH b AS (SELECT 1 AS x) SELECT * FROM b) SELECT * FROM a WHERE x IN (SELECT 1) AND EXISTS (SELECT 2)",
        "TABLE given", "VALUES (1) |> SELECT col1 + 1 AS y",
    ],
)
def test_sql_that_only_reads_is_run(spark, text):
    assert run_sql(spark, {"given": spark.range(1)}, text).count() == 1


@pytest.mark.parametrize("text", ["(SELECT 1 AS a)", "with t as (select 1 a) select a from t", "VALUES (1)", "\n select 1"])
def test_sql_query_forms(spark, text):
    assert run_sql(spark, {}, text).count() == 1


class TestJoin:
    @pytest.fixture
    def sides(self, rows):
        left = rows([(1, "l1"), (2, "l2"), (2, "l2b"), (None, "ln")], "k INT, a STRING")
        right = rows([(2, "r2"), (3, "r3"), (None, "rn")], "k INT, b STRING")
        return left, right

    @pytest.mark.parametrize(
        "how, expected",
        [
            ("inner", [(2, "l2", "r2"), (2, "l2b", "r2")]),
            ("left", [(None, "ln", None), (1, "l1", None), (2, "l2", "r2"), (2, "l2b", "r2")]),
            ("right", [(None, None, "rn"), (2, "l2", "r2"), (2, "l2b", "r2"), (3, None, "r3")]),
            (
                "outer",
                [
                    (None, None, "rn"),
                    (None, "ln", None),
                    (1, "l1", None),
                    (2, "l2", "r2"),
                    (2, "l2b", "r2"),
                    (3, None, "r3"),
                ],
            ),
        ],
    )
    def test_kinds(self, sides, how, expected):
        out = join(*sides, "k", how)
        assert out.columns == ["k", "a", "b"]
        assert collected(out) == expected

    @pytest.mark.parametrize("how", ["left", "right", "outer"])
    def test_frequent_keys_give_the_same_rows(self, rows, how):
        left = rows([(i % 7 if i % 5 else None, i % 2, i) for i in range(60)], "k INT, j INT, a INT")
        right = rows([(i % 11 if i % 4 else None, i % 2, i) for i in range(50)], "k INT, j INT, b INT")
        split = join(left, right, ["k", "j"], how, split_rows=2)
        assert "Union" in split._jdf.queryExecution().optimizedPlan().toString()
        assert split.columns == ["k", "j", "a", "b"]
        assert collected(split) == collected(left.join(right, ["k", "j"], how))
        plain = join(left, right, ["k", "j"], how, split_rows=None)
        assert "Union" not in plain._jdf.queryExecution().optimizedPlan().toString()
        assert collected(plain) == collected(split)

    def test_semi_and_anti(self, sides):
        assert collected(join(*sides, "k", "left_semi")) == [(2, "l2"), (2, "l2b")]
        assert collected(join(*sides, "k", "left_anti")) == [(None, "ln"), (1, "l1")]

    def test_shared_columns_are_named_or_suffixed(self, rows):
        left, right = rows([(1, 2)], "k INT, v INT"), rows([(1, 3)], "k INT, v INT")
        with pytest.raises(ValueError, match=r"columns v"):
            join(left, right, "k")
        assert join(left, right, "k", suffix="_r").first().asDict() == {"k": 1, "v": 2, "v_r": 3}

    def test_default_output_is_the_left_frame(self, spark, sides):
        left, right = sides
        result = run(spark, {"l": left, "r": right}, {"type": "join", "left": "l", "right": "r", "on": "k"})
        assert result.frames["l"].columns == ["k", "a", "b"]
        with pytest.raises(Exception, match="how"):
            run(spark, {"l": left, "r": right}, {"type": "join", "left": "l", "right": "r", "on": "k", "how": "cross"})


def test_aggregate_keeps_alias_order_and_null_group(spark, orders):
    aggs = {"total": "sum(amount)", "order_count": "count(*)", "mean": "sum(amount) / count(*)"}
    out = run(spark, {"o": orders}, {"type": "aggregate", "group_by": ["customer_id"], "aggs": aggs}).output
    assert out.columns == ["customer_id", "total", "order_count", "mean"]
    assert collected(out) == [(None, 99.0, 1, 99.0), (1, 200.0, 2, 100.0), (2, 10.0, 1, 10.0)]
    with pytest.raises(TransformError, match=r"transforms\[0\]"):
        run(spark, {"o": orders}, {"type": "aggregate", "group_by": ["customer_id"], "aggs": {"x": "amount"}})


def test_empty_input_through_every_transform(spark, empty):
    out = run(
        spark,
        {"e": empty, "f": empty.withColumnRenamed("v", "w")},
        {"type": "filter", "condition": "k > 0"},
        {"type": "add_column", "name": "n", "expression": "1"},
        {"type": "rename", "mapping": {"v": "u"}},
        {"type": "join", "left": "e", "right": "f", "on": "k", "how": "outer"},
        {"type": "window", "name": "t", "expression": "sum(n)", "partition_by": ["k"]},
        {"type": "window", "name": "r", "expression": "rank()", "partition_by": ["k"], "order_by": [{"column": "u"}]},
        {"type": "aggregate", "group_by": ["k"], "aggs": {"c": "count(*)"}},
    ).output
    assert out.collect() == []


def test_steps_default_to_the_previous_output(spark, orders):
    result = run(
        spark,
        {"orders": orders},
        {"type": "filter", "condition": "amount > 20", "output": "big"},
        {"type": "select", "columns": ["order_id"]},
    )
    assert result.frames["big"].columns == ["order_id"]
    assert result.frames["orders"].columns == orders.columns
    assert result.output.count() == 3


def test_duplicate_output_columns_are_named(spark, orders):
    with pytest.raises(ValueError, match="amount"):
        run(spark, {"orders": orders}, {"type": "sql", "query": "SELECT amount, amount FROM orders"})


@pytest.fixture
def skewed(spark):
    """80 % of the rows on one key, and settings by which that is skew."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark.range(0, 200_000, 1, 8).selectExpr("IF(id % 5 < 4, 7, id) AS k", "id AS x", "repeat(string(id), 3) AS t")
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def split_joins(df):
    """How many joins the finished plan has, and how many of them adaptive execution split."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    return len(joins), sum("skew=true" in line for line in joins)


def test_a_frequent_key_is_split_in_every_join(spark, skewed):
    known = spark.range(0, 200_000, 3, 4).selectExpr("id AS k", "id AS y")
    for how in ("left_semi", "left_anti", "inner", "left"):
        got = join(skewed, known, "k", how)
        assert split_joins(got) == (1, 1), how
        assert got.count() == skewed.join(known, "k", how).count()
    for how, left, right in (("right", skewed, known), ("left", known, skewed), ("outer", skewed, known), ("outer", known, skewed)):
        got = join(left, right, "k", how, split_rows=50_000)
        joins, split = split_joins(got)
        assert joins == {"left": 2, "right": 2, "outer": 3}[how] and split >= 1, how
        assert got.count() == left.join(right, "k", how).count()
    both = join(skewed, known, "k", "outer", split_rows=50_000)
    assert split_joins(both) == (3, 2)  # the rows of the other side alone have no frequent key
    assert split_joins(scope_to(skewed, known, ["k"])) == (1, 1)
    assert split_joins(find_orphans(skewed, "k", known, "k")) == (1, 1)
