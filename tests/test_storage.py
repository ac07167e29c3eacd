"""Sources, sinks, incremental runs and code hooks."""

import json
import logging
import os
import textwrap

import pytest
from pyspark.errors import PySparkException

from etlspec import register_sink, register_source, run_incremental, run_pipeline
from etlspec.operators.hooks import CodeNotAllowed
from etlspec.plans.check import sink_source
from etlspec.plans.spec import Auth, SinkSpec, SourceSpec, load_spec
from etlspec.sinks.write import _table_format
from etlspec.sources.files import reader_options
from etlspec.sources.http import json_items
from etlspec.sources.jdbc import jdbc_options
from etlspec.sources.kafka import kafka_options
from etlspec.streaming.incremental import BATCH_COLUMN, RUN_COLUMN, _write_batch
from tests.conftest import collected


@pytest.fixture
def people(rows):
    return rows([(1, "a", "x"), (2, "b", "x"), (3, None, "y")], "id INT, name STRING, team STRING")


def write(spark, frame, sink, provider="iceberg", **rest):
    run_pipeline(spark, {"sink": sink, **rest}, frames={"t": frame}).write(provider=provider)


def read(spark, **fields):
    return run_pipeline(spark, {"source": fields}).output


# --- files


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_file_round_trip(spark, people, tmp_path, fmt):
    path = str(tmp_path / fmt)
    write(spark, people, {"type": "s3", "format": fmt, "path": path})
    options = {"schema": "id INT, name STRING, team STRING"}
    assert collected(read(spark, type="s3", format=fmt, path=path, options=options)) == collected(people)


def test_csv_options_pass_through(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n1;x\n2;NA\n", encoding="utf-8")
    options = {"header": True, "sep": ";", "nullValue": "NA", "inferSchema": True}
    out = read(spark, type="s3", format="csv", path=str(tmp_path), options=options)
    assert collected(out) == [(1, "x"), (2, None)]
    assert reader_options({"a": False, "b": 3, "c": 1.5, "d": None, "e": "x"}) == {
        "a": "false",
        "b": "3",
        "c": "1.5",
        "e": "x",
    }


def test_write_modes(spark, people, tmp_path):
    sink = {"type": "s3", "path": str(tmp_path / "out")}
    write(spark, people, sink)
    with pytest.raises(PySparkException, match="ALREADY_EXISTS"):
        write(spark, people, sink)
    write(spark, people, {**sink, "mode": "append"})
    assert spark.read.parquet(sink["path"]).count() == 6
    write(spark, people.limit(1), {**sink, "mode": "overwrite"})
    assert spark.read.parquet(sink["path"]).count() == 1


def test_partitioned_write_makes_one_file_per_value_and_overwrites_all(spark, people, tmp_path):
    path = str(tmp_path / "out")
    sink = {"type": "s3", "path": path, "partition_by": ["team"], "mode": "overwrite"}
    write(spark, people.repartition(3), sink)
    files = [f for d in ("team=x", "team=y") for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")]
    assert len(files) == 2
    write(spark, people.filter("team = 'y'"), sink)
    assert collected(spark.read.parquet(path).select("id")) == [(3,)]


def test_void_columns_reach_every_format_when_filled(spark, people, tmp_path):
    for fmt in ("orc", "csv"):
        frame, path = people.selectExpr("id", "NULL AS n"), str(tmp_path / fmt)
        with pytest.raises(PySparkException):
            write(spark, frame, {"type": "s3", "format": fmt, "path": path})
        write(spark, frame, {"type": "s3", "format": fmt, "path": path, "fill_nulls": True, "mode": "overwrite"})
        assert spark.read.format(fmt).load(path).count() == 3


# --- tables


def test_catalog_sink_and_source(spark, people):
    spark.sql("DROP TABLE IF EXISTS default.people")
    sink = {"type": "catalog", "database": "default", "table": "people", "partition_by": ["team"]}
    write(spark, people, sink)
    write(spark, people.limit(1), {**sink, "mode": "append"})
    assert read(spark, type="catalog", database="default", table="people").count() == 4
    spark.sql("DROP TABLE default.people")


def test_table_format_fills_nulls_unless_told_not_to(spark, people):
    for fill, expected in ((None, ""), (False, None)):
        spark.sql("DROP TABLE IF EXISTS default.filled")
        sink = {"type": "iceberg", "database": "default", "table": "filled", "mode": "append"}
        if fill is not None:
            sink["fill_nulls"] = fill
        write(spark, people, sink, provider="parquet")
        assert spark.table("default.filled").filter("id = 3").first().name == expected
    spark.sql("DROP TABLE default.filled")


def test_time_partitions_lead_the_layout(spark, rows, tmp_path):
    frame = rows([(1, "2024-03-05", "p"), (2, None, "q")], "id INT, d STRING, g STRING").selectExpr(
        "id", "cast(d AS timestamp) ts", "g"
    )
    spark.sql("DROP TABLE IF EXISTS default.stamped")
    sink = {"type": "iceberg", "database": "default", "table": "stamped", "path": str(tmp_path), "partition_by": ["g"]}
    write(spark, frame, sink, "parquet", partition_by=["year", "month", "day"], partition_timestamp_column="ts")
    assert (tmp_path / "year=2024" / "month=3" / "day=5" / "g=p").is_dir()
    assert (tmp_path / "year=1970" / "month=1" / "day=1" / "g=q").is_dir()
    spark.sql("DROP TABLE default.stamped")


# --- connections that are built, not opened: no database or broker runs in tests

AUTH = Auth(kind="rds_iam", host="h", port=5432, region="r")


def test_jdbc_options():
    plain = SourceSpec("s", kind="jdbc", connection_url="jdbc:x:y", table="t", options={"fetchsize": 500})
    assert jdbc_options(plain) == {"url": "jdbc:x:y", "dbtable": "t", "fetchsize": "500"}
    derived = SourceSpec("s", kind="jdbc", connection_type="postgresql", database="d", table="t", secret_id="k", auth=AUTH)
    assert jdbc_options(derived, lambda secret, auth: (f"user of {secret}", auth.region)) == {
        "url": "jdbc:postgresql://h:5432/d",
        "dbtable": "t",
        "user": "user of k",
        "password": "r",
    }
    named = SinkSpec(kind="jdbc", connection_url="u", table="t", auth=Auth("rds_iam", "app", "h", 1, "r"))
    assert jdbc_options(named, lambda secret, auth: (None, "pw"))["user"] == "app"
    with pytest.raises(ValueError, match="credentials"):
        jdbc_options(derived)


def test_kafka_options():
    source = SourceSpec("k", kind="kafka", connection_url="b1:9092,b2:9092", topic="t", options={"startingOffsets": "earliest"})
    assert kafka_options(source) == {
        "kafka.bootstrap.servers": "b1:9092,b2:9092",
        "subscribe": "t",
        "startingOffsets": "earliest",
    }


def test_kafka_rows_are_decoded_by_transforms(spark, rows):
    frame = rows([(bytearray(b"k1"), bytearray(b'{"a": 1}'), "t", 0)], "key BINARY, value BINARY, topic STRING, partition INT")
    steps = [
        {"type": "add_column", "name": "value", "expression": 'F.from_json(F.col("value").cast("string"), "a INT")'},
        {"type": "sql", "query": "SELECT CAST(key AS STRING) AS key, value.a FROM messages"},
    ]
    out = run_pipeline(spark, {"transforms": steps}, frames={"messages": frame}).output
    assert tuple(out.first()) == ("k1", 1)


# --- HTTP


@pytest.mark.parametrize(
    "text",
    [
        '[{"a": 1}, {"a": "x]y"},\n {"a": [1, 2]}]',
        '{"a": 1}\n{"a": "x]y"}\n{"a": [1, 2]}\n',
        '{"a": 1}{"a": "x]y"} {"a": [1, 2]}',
    ],
)
@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_json_items_from_any_chunks(text, size):
    chunks = [text[i : i + size] for i in range(0, len(text), size)]
    assert [json.loads(i) for i in json_items(chunks)] == [{"a": 1}, {"a": "x]y"}, {"a": [1, 2]}]


def test_json_items_edge_cases():
    assert list(json_items([])) == [] and list(json_items(["[]"])) == []
    assert list(json_items(["[1", "2, 3]"])) == ["12", "3"]
    with pytest.raises(json.JSONDecodeError):
        list(json_items(['[{"a": ']))


def test_http_source(spark, tmp_path):
    one, two = tmp_path / "one.json", tmp_path / "two.json"
    one.write_text('[{"id": 1, "v": 1.5, "n": {"x": "é"}}, {"id": 2, "v": 2, "n": null}]', encoding="utf-8")
    two.write_text('{"id": 3, "v": 0.25, "n": {"x": "z"}}\n', encoding="utf-8")
    first = read(spark, type="api", url=one.as_uri(), headers={"Accept": "application/json"})
    assert {f.name: f.dataType.simpleString() for f in first.schema} == {"id": "bigint", "v": "double", "n": "struct<x:string>"}
    assert collected(first.selectExpr("id", "v", "n.x")) == [(1, 1.5, "é"), (2, 2.0, None)]
    options = {"urls": [one.as_uri(), two.as_uri()], "schema": "id INT, v DOUBLE"}
    both = read(spark, type="api", url=one.as_uri(), options=options)
    assert both.rdd.getNumPartitions() == 2
    assert collected(both) == [(1, 1.5), (2, 2.0), (3, 0.25)]


def test_http_names_like_types(spark, tmp_path):
    page = tmp_path / "page.json"
    page.write_text('[{"VOID_REASON": "x", "VOID": null, "OBJECT": {"DECIMAL": 1.5}, "a VOID<b": [null]}]')
    found = read(spark, type="api", url=page.as_uri())
    types = {f.name: f.dataType.simpleString() for f in found.schema}
    assert types == {"VOID_REASON": "string", "VOID": "string", "OBJECT": "struct<DECIMAL:double>", "a VOID<b": "array<string>"}
    assert found.select("VOID_REASON", "OBJECT.DECIMAL").first() == ("x", 1.5)


def test_http_item_outside_the_schema(spark, tmp_path):
    page = tmp_path / "page.json"
    page.write_text('[{"id": 1}, {"id": "no number"}]')
    options = {"schema": "id INT, bad STRING"}
    with pytest.raises(Exception, match="(?i)malformed"):
        read(spark, type="api", url=page.as_uri(), options=options).collect()
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
    kept = read(spark, type="api", url=page.as_uri(), options=options).collect()
    assert [(r.id, r.bad and json.loads(r.bad)) for r in kept] == [(1, None), (None, {"id": "no number"})]


# --- added kinds


def test_added_kinds(spark, people, tmp_path):
    register_source("numbers", lambda session, source: session.range(int(source.options["n"])))
    seen = []
    register_sink("notes", lambda df, sink: seen.append((sink.path, df.count())))
    assert read(spark, type="numbers", options={"n": 4}).count() == 4
    write(spark, people, {"type": "notes", "path": "here"})
    assert seen == [("here", 3)]


# --- which frame is written


def test_sink_source_defaults_to_the_first_source(spark, people):
    spec = {
        "transforms": [
            {"type": "filter", "condition": "id > 1"},
            {"type": "filter", "condition": "id > 2", "output": "rest"},
        ],
        "sink": {"type": "s3", "path": "unused", "source": "t"},
    }
    assert run_pipeline(spark, spec, frames={"t": people}).output.count() == 2
    assert sink_source(load_spec({"sources": [{"type": "s3", "path": "a"}]})) == "source_0"


# --- incremental


def test_second_run_reads_only_new_files(spark, people, tmp_path):
    spec = {
        "sources": [
            {"name": "drop", "type": "s3", "path": str(tmp_path / "drops")},
            {"name": "teams", "type": "s3", "path": str(tmp_path / "teams")},
        ],
        "transforms": [
            {"type": "join", "left": "drop", "right": "teams", "on": "team"},
            {"type": "add_column", "name": "kind", "expression": 'F.concat("lead", F.lit("!"))'},
        ],
        "sink": {"type": "s3", "path": str(tmp_path / "out"), "partition_by": ["team"]},
    }
    spark.createDataFrame([("x", "ann"), ("y", "bo")], "team STRING, lead STRING").write.parquet(str(tmp_path / "teams"))
    for ids in ("id < 3", "id = 3"):
        people.filter(ids).write.mode("append").parquet(str(tmp_path / "drops"))
        run_incremental(spark, spec, str(tmp_path / "checkpoint"))
    run_incremental(spark, spec, str(tmp_path / "checkpoint"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert collected(out.select("id", "kind", "team")) == [(1, "ann!", "x"), (2, "ann!", "x"), (3, "bo!", "y")]
    assert sorted(r[0] for r in out.select(BATCH_COLUMN).distinct().collect()) == [0, 1]
    assert out.select(RUN_COLUMN).distinct().count() == 1


@pytest.mark.parametrize("sink", [{"type": "catalog", "format": "parquet"}, {"type": "iceberg"}], ids=lambda s: s["type"])
def test_a_repeated_batch_leaves_a_table_unchanged(spark, people, tmp_path, sink):
    name = f"repeated_{sink['type']}"
    spec = {"sources": [{"name": "drop", "type": "s3", "path": str(tmp_path / "drops")}], "sink": {**sink, "database": "default", "table": name}}
    for ids in ("id < 3", "id = 3"):
        people.filter(ids).write.mode("append").parquet(str(tmp_path / "drops"))
        run_incremental(spark, spec, str(tmp_path / "checkpoint"), provider="parquet")
    table = spark.table(name)
    once = collected(table)
    assert len(once) == people.filter("id <= 3").count() and table.columns == [*people.columns, RUN_COLUMN, BATCH_COLUMN]
    run = table.select(RUN_COLUMN).first()[0]
    for batch in (0, 1):  # as after a failure between the append and the checkpoint
        _write_batch(people.filter("id < 3"), load_spec(spec), run, batch, None, "parquet")
    assert collected(spark.table(name)) == once
    _write_batch(people.filter("id < 3"), load_spec(spec), run, 2, None, "parquet")
    _write_batch(people.filter("id < 3"), load_spec(spec), "another run", 0, None, "parquet")
    assert spark.table(name).count() == len(once) + 4
    spark.sql(f"DROP TABLE {name}")


def test_a_table_without_batch_columns_is_appended_to_with_a_warning(spark, people, caplog):
    people.write.saveAsTable("unmarked")
    spec = load_spec({"sources": [{"name": "drop", "type": "s3", "path": "p"}], "sink": {"type": "catalog", "database": "default", "table": "unmarked"}})
    _write_batch(people, spec, "r", 0, None, "parquet")
    assert "appended again" in caplog.text and spark.table("unmarked").count() == 2 * people.count()
    spark.sql("DROP TABLE unmarked")


def test_a_missing_table_of_a_table_format_is_created(spark, people):
    sink = load_spec({"sources": [{"name": "a", "type": "s3", "path": "p"}], "sink": {"type": "iceberg", "database": "default", "table": "fresh_table", "partition_by": ["team"], "mode": "append"}}).sink
    _table_format(people, sink, "parquet")
    assert collected(spark.table("fresh_table").select("id")) == collected(people.select("id"))
    described = [tuple(r)[:2] for r in spark.sql("DESCRIBE TABLE fresh_table").collect()]
    assert ("team", "string") in described[described.index(("# Partition Information", "")) :]
    spark.sql("DROP TABLE fresh_table")


def test_incremental_limits(spark, tmp_path):
    source = {"name": "a", "type": "s3", "path": str(tmp_path)}
    with pytest.raises(ValueError, match="sink"):
        run_incremental(spark, {"sources": [source]}, "c")
    with pytest.raises(ValueError, match="overwrite"):
        run_incremental(spark, {"sources": [source], "sink": {"type": "s3", "path": "p", "mode": "overwrite"}}, "c")
    with pytest.raises(ValueError, match="named b"):
        run_incremental(spark, {"sources": [source], "sink": {"type": "s3", "path": "p"}}, "c", stream="b")


# --- code


def test_code_needs_permission(spark, people):
    with pytest.raises(CodeNotAllowed):
        run_pipeline(spark, {"body": "df_result = df_t"}, frames={"t": people})


def test_body_sees_frames_imports_and_spark(spark, people):
    body = """
    ids = F.col("id") * math.floor(2.5)
    df_result = df_t.select(ids.alias("v"), F.lit(OrderedDict(a=1)["a"]).alias("a")).filter("v > 2")
    """
    spec = {
        "body": textwrap.dedent(body),
        "imports": [{"name": "math"}, {"name": "OrderedDict", "from": "collections"}, {"from": "skipped"}],
    }
    out = run_pipeline(spark, spec, frames={"t": people}, allow_code=True).output
    assert collected(out) == [(4, 1), (6, 1)]
    with pytest.raises(TypeError, match="df_result"):
        run_pipeline(spark, {"body": "x = 1"}, frames={"t": people}, allow_code=True)


def test_job_file_paths(spark, people, tmp_path):
    (tmp_path / "jobs").mkdir()
    code = "def run(spark, frames):\n    return frames['t'].filter('id = {}')\n"
    (tmp_path / "jobs" / "near.py").write_text(code.format(1), encoding="utf-8")
    (tmp_path / "top.py").write_text(code.format(2), encoding="utf-8")
    kwargs = {"frames": {"t": people}, "allow_code": True, "base_dir": str(tmp_path / "jobs"), "project_dir": str(tmp_path)}
    assert run_pipeline(spark, {"job_file": "near.py"}, **kwargs).output.first().id == 1
    assert run_pipeline(spark, {"job_file": "~/top.py"}, **kwargs).output.first().id == 2
    with pytest.raises(FileNotFoundError):
        run_pipeline(spark, {"job_file": "far.py"}, **kwargs)


def test_spec_from_a_yaml_file(spark, people, tmp_path):
    people.write.parquet(str(tmp_path / "in"))
    job = tmp_path / "job.yaml"
    job.write_text(
        f"""
type: glue
role: some-role
sources:
  - name: people
    type: s3
    path: {tmp_path / "in"}
transforms:
  - transform_type: filter
    condition: F.col("team") == "x"
sink:
  type: s3
  path: {tmp_path / "out"}
  mode: overwrite
""",
        encoding="utf-8",
    )
    run_pipeline(spark, str(job)).write()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_serial_jdbc_reads_are_reported(spark, caplog):
    from etlspec.sources.jdbc import read_jdbc

    source = SourceSpec("s", kind="jdbc", connection_url="jdbc:nothing:", table="t")
    with caplog.at_level(logging.WARNING), pytest.raises(Exception):
        read_jdbc(spark, source)
    assert "one task" in caplog.text


def test_session_functions_in_expressions(spark, people):
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    @F.udtf(returnType="n: int")
    class UpTo:
        def eval(self, top: int):
            for n in range(top):
                yield (n,)

    spark.udf.register("etlspec_spread", spread)
    spark.udtf.register("etlspec_up_to", UpTo)
    steps = [
        {"type": "sql", "query": "SELECT t.team, u.n FROM t, LATERAL etlspec_up_to(t.id) u"},
        {"type": "aggregate", "group_by": ["team"], "aggs": {"s": "etlspec_spread(n)"}},
    ]
    out = run_pipeline(spark, {"transforms": steps}, frames={"t": people}).output
    assert collected(out) == [("x", 1.0), ("y", 2.0)]
