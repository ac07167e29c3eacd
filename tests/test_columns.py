import pytest
from pyspark.errors import PySparkException

from etlspec.functions.columns import ColumnTextError, compile_column


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [(1, "a", 10.0, [1, 2]), (2, "b", 200.0, [3]), (3, None, None, [0])], "id INT, s STRING, amount DOUBLE, l ARRAY<INT>"
    )


@pytest.mark.parametrize(
    "text, expected",
    [
        ('F.col("amount") > 100', [2]),
        ("col('s') != 'a'", [2]),
        ("amount > 100", [2]),
        ("amount > 100 OR id = 1", [1, 2]),
        ('(F.col("id") == 1) | (F.col("id") == 3)', [1, 3]),
        ('~F.col("s").isNull() & (F.col("id") < 2)', [1]),
        ('F.col("id").isin([1, 3])', [1, 3]),
        ('F.col("s").isin("a", "b")', [1, 2]),
        ('functions.length(F.col("s")) == lit(1)', [1, 2]),
        ('-F.col("id") < -2', [3]),
        ('F.col("l")[0] == 3', [2]),
        ('F.exists(F.col("l"), lambda x: x > 1)', [1, 2]),
        ('F.aggregate("l", F.lit(0), lambda acc, x: acc + x) == 3', [1, 2]),
        ('F.expr("id = 2")', [2]),
        ('F.when(F.col("id") == 1, True).otherwise(False)', [1]),
        ('F.col("id") % 2 == 1', [1, 3]),
        ("True", [1, 2, 3]),
        ("False", []),
        ("s IS NULL", [3]),
        ("id == 2", [2]),
    ],
)
def test_conditions(df, text, expected):
    assert [r.id for r in df.filter(compile_column(text)).orderBy("id").collect()] == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("None", None),
        ("5", 5),
        ("'x'", "x"),
        ('F.lit(2) ** 3', 8.0),
        ('F.concat_ws("-", F.col("s"), F.lit("z"))', "a-z"),
        ('F.col("amount").cast("int")', 10),
        ("upper(s)", "A"),
        ('F.round(F.col("amount") / 3, scale=1)', 3.3),
    ],
)
def test_values(df, text, expected):
    assert df.filter("id = 1").select(compile_column(text)).first()[0] == expected


@pytest.mark.parametrize(
    "text",
    [
        "F.__class__",
        'F.col("a").__class__',
        'F.col("a")._jc',
        "F.udf(lambda x: x)",
        "F.pandas_udf",
        "F.os",
        "F.sys.exit()",
        "[F.col(x) for x in ['a']]",
        'F.col(*["a"])',
        'F.col("a") if True else F.col("b")',
        '"abc".upper() == F.col("s")',
        "F.col('a')('b')",
        "F.not_there(1)",
    ],
)
def test_python_outside_the_allowed_part_is_refused(df, text):
    with pytest.raises((ColumnTextError, PySparkException)):
        df.select(compile_column(text)).collect()


@pytest.mark.parametrize("text", ["__import__('os').system('true')", "open('/etc/passwd')", "exec('1')"])
def test_other_names_are_sql_and_fail_there(df, text):
    with pytest.raises(PySparkException):
        df.select(compile_column(text)).collect()
