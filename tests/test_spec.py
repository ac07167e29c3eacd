import pytest

from etlspec.plans import registry
from etlspec.plans.spec import Order, SpecError, check_spec, load_spec

EVENTS = {"name": "events", "type": "s3", "format": "parquet", "path": "s3://bucket/in/"}
OUT = {"type": "s3", "format": "parquet", "path": "s3://bucket/out/", "mode": "overwrite"}
AUTH = {"kind": "rds_iam", "host": "db.ledger.test", "port": 6432, "region": "eu-north-1"}
JDBC = {"name": "entries", "type": "jdbc", "connection_url": "jdbc:postgresql://db.ledger.test:6432/books", "table": "books.entries"}


def problems(**spec):
    return {(p.field, p.message) for p in check_spec(spec)}


def fields(**spec):
    return {field for field, _ in problems(**spec)}


def says(found, field, *words):
    return any(f == field and all(w in m for w in words) for f, m in found)


def with_step(step, **rest):
    return problems(sources=[EVENTS], transforms=[step], **rest)


def test_valid_spec_has_no_problems():
    spec = {"sources": [EVENTS], "transforms": [{"type": "filter", "condition": "col('active')"}], "sink": OUT}
    assert check_spec(spec) == []


def test_unknown_source_kind_lists_the_accepted_ones():
    found = problems(sources=[{"name": "src", "type": "punchcard"}])
    assert says(found, "sources[0].type", '"punchcard"', "s3, jdbc, catalog, kafka, api")


@pytest.mark.parametrize(
    "block, missing",
    [
        ({"type": "s3"}, ["path"]),
        ({"type": "jdbc"}, ["connection_url", "table"]),
        ({"type": "catalog"}, ["database", "table"]),
        ({"type": "kafka"}, ["connection_url", "topic"]),
        ({"type": "api"}, ["url"]),
    ],
)
def test_source_requirements(block, missing):
    found = problems(sources=[{"name": "src", **block}])
    for key in missing:
        assert says(found, "sources[0]", f'"{key}"')


@pytest.mark.parametrize(
    "block, missing",
    [
        ({"type": "s3"}, ["path"]),
        ({"type": "jdbc"}, ["connection_url", "table"]),
        ({"type": "catalog"}, ["database", "table"]),
        ({"type": "iceberg"}, ["database", "table"]),
    ],
)
def test_sink_requirements(block, missing):
    found = problems(sources=[EVENTS], sink=block)
    for key in missing:
        assert says(found, "sink", f'"{key}"')


@pytest.mark.parametrize(
    "step, missing",
    [
        ({"type": "filter"}, ["condition"]),
        ({"type": "sql"}, ["query"]),
        ({"type": "join"}, ["left", "right", "on"]),
        ({"type": "drop_columns"}, ["columns"]),
        ({"type": "select", "columns": []}, ["columns"]),
        ({"type": "rename"}, ["mapping"]),
        ({"type": "add_column"}, ["name", "expression"]),
        ({"type": "aggregate"}, ["group_by", "aggs"]),
        ({"type": "window"}, ["name", "expression", "partition_by"]),
    ],
)
def test_transform_requirements(step, missing):
    found = with_step(step)
    for key in missing:
        assert says(found, "transforms[0]", f'"{key}"')


def test_unknown_transform_and_sink_kinds():
    assert says(with_step({"type": "pivot"}), "transforms[0].type", "pivot", "filter, sql, join")
    assert says(problems(sources=[EVENTS], sink={"type": "redis"}), "sink.type", "redis")


def test_references_must_be_known_and_may_not_look_ahead():
    assert says(with_step({"type": "filter", "source": "nope", "condition": "True"}), "transforms[0].source", "nope")
    steps = [
        {"type": "filter", "source": "later", "condition": "True"},
        {"type": "filter", "source": "events", "output": "later", "condition": "True"},
    ]
    assert "transforms[0].source" in fields(sources=[EVENTS], transforms=steps)
    join = {"type": "join", "left": "events", "right": "ghost", "on": "id"}
    assert says(with_step(join), "transforms[0].right", "ghost")
    assert says(problems(sources=[EVENTS], sink={**OUT, "source": "ghost"}), "sink.source", "ghost")


def test_chain_of_outputs_is_known():
    a, b = ({**EVENTS, "name": n} for n in "ab")
    steps = [
        {"type": "join", "left": "a", "right": "b", "on": "id", "output": "joined"},
        {"type": "filter", "source": "joined", "condition": "True"},
    ]
    assert check_spec({"sources": [a, b], "transforms": steps, "sink": {**OUT, "source": "joined"}}) == []


def test_jdbc_auth():
    missing_user = problems(sources=[{**JDBC, "auth": AUTH}])
    assert says(missing_user, "sources[0].auth.username", "no user")
    both = problems(sources=[{**JDBC, "secret_id": "s", "auth": {**AUTH, "username": "u"}}])
    assert says(both, "sources[0].auth.username", "leave", "secret_id")
    assert problems(sources=[{**JDBC, "secret_id": "s", "auth": AUTH}]) == set()
    assert problems(sources=[{**JDBC, "auth": {**AUTH, "username": "u"}}]) == set()


def test_jdbc_url_can_be_derived_only_with_kind_and_database():
    block = {"name": "src", "type": "jdbc", "table": "t", "auth": {**AUTH, "username": "u"}}
    found = problems(sources=[block])
    assert says(found, "sources[0]", '"connection_type"') and says(found, "sources[0]", '"database"')
    assert problems(sources=[{**block, "connection_type": "postgresql", "database": "d"}]) == set()


def test_auth_needs_a_known_kind_and_jdbc():
    assert "sources[0].auth" in fields(sources=[{**EVENTS, "auth": {**AUTH, "username": "u"}}])
    assert "sink.auth" in fields(sources=[EVENTS], sink={**OUT, "auth": {**AUTH, "username": "u"}})
    assert "sources[0].auth.kind" in fields(sources=[{**JDBC, "auth": {**AUTH, "kind": "magic"}}])
    assert says(problems(sources=[{**JDBC, "auth": {**AUTH, "user_name": "x"}}]), "sources[0].auth", "user_name")


def test_engine():
    assert "sources[0].engine" in fields(sources=[{**EVENTS, "engine": "flink"}])
    assert says(problems(sources=[{**JDBC, "engine": "glue"}]), "sources[0]", "connection_type")


@pytest.mark.parametrize(
    "spec, field, key",
    [
        ({"sources": [EVENTS], "steps": []}, "spec", "steps"),
        ({"sources": [EVENTS], "sink": {**OUT, "split_by": []}}, "sink", "split_by"),
        (
            {
                "sources": [EVENTS],
                "transforms": [{"type": "filter", "condition": "amount < 9"}, {"type": "select", "cols": ["a"]}],
            },
            "transforms[1]",
            "cols",
        ),
        ({"sources": [{**EVENTS, "codec": "zstd"}]}, "sources[0]", "codec"),
    ],
)
def test_typos_are_unknown_fields(spec, field, key):
    assert says(problems(**spec), field, f"unknown field '{key}'")


def test_entry_without_type_is_reported():
    assert "sources[0].type" in fields(sources=[{"name": "a", "path": "p"}])
    assert "transforms[0].type" in fields(sources=[EVENTS], transforms=[{"condition": "True"}])


def test_values_of_the_wrong_shape_are_reported():
    assert "transforms[0].columns" in fields(sources=[EVENTS], transforms=[{"type": "select", "columns": "a"}])
    assert "transforms[0].aggs" in fields(
        sources=[EVENTS], transforms=[{"type": "aggregate", "group_by": ["a"], "aggs": {"n": 1}}]
    )
    window = {"type": "window", "name": "n", "expression": "rank()", "order_by": [{"col": "a"}]}
    assert "transforms[0].order_by" in fields(sources=[EVENTS], transforms=[window])


def test_mask_pii_checks_are_independent():
    found = problems(sources=[EVENTS], mask_pii=["", "ssn", "EMAIL", "EMAIL", "PASSPORT"])
    assert says(found, "mask_pii[0]", "empty")
    assert says(found, "mask_pii[1]", "no entity name", "capitals")
    assert says(found, "mask_pii", "EMAIL", "listed 2 times")
    assert says(found, "mask_pii[4]", "PASSPORT", "USA_SSN")


@pytest.mark.parametrize("name", ["_EMAIL", "EMAIL_", "E__MAIL", "1EMAIL", "Email"])
def test_entity_names_in_other_shapes_are_refused(name):
    assert says(problems(sources=[EVENTS], mask_pii=[name]), "mask_pii[0]", "no entity name", "capitals")


def test_body_and_job_file_exclude_each_other():
    assert "job_file" in fields(sources=[EVENTS], body="df_result = df_events", job_file="x.py")


def test_modes():
    assert "sink.mode" in fields(sources=[EVENTS], sink={**OUT, "mode": "upsert"})
    table = {"type": "iceberg", "database": "d", "table": "t"}
    assert says(problems(sources=[EVENTS], sink={**table, "mode": "error"}), "sink.mode", "append, overwrite")
    for mode in ("append", "overwrite"):
        assert problems(sources=[EVENTS], sink={**table, "mode": mode}) == set()


def test_time_partitions():
    table = {"type": "iceberg", "database": "d", "table": "t"}
    good = {"sources": [EVENTS], "sink": table, "partition_by": ["year", "day"]}
    assert problems(**good, create_timestamp=True) == set()
    assert problems(**good, partition_timestamp_column="ts") == set()
    assert says(problems(**good), "partition_by", "no time to split")
    assert "create_timestamp" in fields(**good, create_timestamp=True, partition_timestamp_column="ts")
    assert says(problems(**{**good, "partition_by": ["hour"]}, create_timestamp=True), "partition_by", "hour")
    assert says(problems(**{**good, "sink": OUT}, create_timestamp=True), "partition_by", "iceberg")
    assert says(problems(sources=[EVENTS], create_timestamp=True), "partition_by", "required")


def test_all_problems_are_collected():
    spec = {
        "sources": [{"name": "a", "type": "s3"}, {"name": "b", "type": "nope"}],
        "transforms": [{"type": "filter"}, {"type": "select", "source": "zzz"}],
        "sink": {"type": "jdbc"},
    }
    with pytest.raises(SpecError) as caught:
        load_spec(spec)
    where = [p.field for p in caught.value.problems]
    for field in ("sources[0]", "sources[1].type", "transforms[0]", "transforms[1]", "transforms[1].source", "sink"):
        assert field in where
    assert str(caught.value.problems[0]) in str(caught.value)


def test_names_and_defaults():
    spec = load_spec({"sources": [{"type": "s3", "path": "a"}, {"type": "s3", "path": "b"}]})
    assert [s.name for s in spec.sources] == ["source_0", "source_1"]
    assert load_spec({"source": {"type": "s3", "path": "a"}}).sources[0].name == "source"
    assert says(problems(sources=[EVENTS, EVENTS]), "sources[1].name", "more than one")
    assert says(problems(sources=[{**EVENTS, "name": "my-events"}]), "sources[0].name", "my-events")


def test_sink_source_must_be_named_when_the_last_output_is_another_frame():
    steps = [{"type": "filter", "condition": "True", "output": "clean"}]
    assert says(problems(sources=[EVENTS], transforms=steps, sink=OUT), "sink.source", "clean")
    assert problems(sources=[EVENTS], transforms=steps, sink={**OUT, "source": "clean"}) == set()


def test_transform_type_is_accepted_as_an_alias():
    spec = load_spec({"sources": [EVENTS], "transforms": [{"transform_type": "filter", "condition": True}]})
    assert (spec.transforms[0].kind, spec.transforms[0].condition) == ("filter", "True")


def test_deployment_settings_are_ignored():
    extra = {"type": "glue", "role": "r", "glue": {"worker_type": "G.1X"}, "airflow": {}, "plugin_version": "1"}
    assert check_spec({"sources": [EVENTS], **extra}) == []


def test_yaml_keeps_on_as_a_key(tmp_path):
    path = tmp_path / "job.yaml"
    path.write_text(
        """
type: glue
sources:
  - {name: a, type: s3, path: x}
  - {name: b, type: s3, path: y}
transforms:
  - type: join
    left: a
    right: b
    on: id
    output: joined
  - type: window
    name: n
    expression: row_number()
    partition_by: [id]
    order_by:
      - column: ts
        desc: true
      - column: id
  - {type: filter, condition: true}
""",
        encoding="utf-8",
    )
    spec = load_spec(str(path))
    assert spec.transforms[0].on == ("id",)
    assert spec.transforms[1].order_by == (Order("ts", True), Order("id"))
    assert spec.transforms[2].condition == "True"
    assert spec.base_dir == str(tmp_path)


def test_registered_kinds_are_accepted():
    registry.register_source("lake", lambda spark, source: None)
    registry.register_sink("queue", lambda df, sink: None)
    assert problems(sources=[{"name": "a", "type": "lake"}], sink={"type": "queue"}) == set()
    assert says(problems(sources=[{"name": "a", "type": "telex"}]), "sources[0].type", "lake")
    with pytest.raises(ValueError):
        registry.register_source("s3")
    with pytest.raises(ValueError):
        registry.register_sink("jdbc", lambda df, sink: None)
