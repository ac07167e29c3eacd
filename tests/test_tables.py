"""Snapshot diff, fingerprint, overlay, scope, existence, rules, duplicates, orphans."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from etlspec import (
    check_rows,
    existence,
    find_duplicates,
    find_orphans,
    fingerprint,
    overlay,
    scope_subtree,
    scope_to,
    snapshot_diff,
)
from etlspec.operators import quality as q
from tests.conftest import collected

SNAP = "id INT, a STRING, b DOUBLE, m MAP<STRING,STRING>, l ARRAY<STRING>"


@pytest.fixture
def old(rows):
    return rows(
        [
            (1, "same", 1.0, {"x": "1", "y": "2"}, ["p", "q"]),
            (2, "was", 2.0, {}, ["p"]),
            (3, "gone", 3.0, None, None),
            (None, "null key", 0.0, None, None),
            (5, None, None, None, ["q", "p"]),
        ],
        SNAP,
    )


@pytest.fixture
def new(rows):
    return rows(
        [
            (1, "same", 1.0, {"y": "2", "x": "1"}, ["p", "q"]),
            (2, "is", 2.5, {}, ["p"]),
            (4, "fresh", 4.0, None, None),
            (None, "null key", 0.0, None, None),
            (5, "null", None, {"k": "v"}, ["p", "q"]),
        ],
        SNAP,
    )


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_diff_kinds_and_changes(old, new):
    diff = by_id(snapshot_diff(new, old, ["id"]))
    assert {k: r.change_type for k, r in diff.items()} == {2: "Modify", 3: "Delete", 4: "Create", 5: "Modify"}
    assert {f: tuple(c) for f, c in diff[2].changes.items()} == {"a": ("was", "is"), "b": ("2.0", "2.5")}
    assert tuple(diff[5].changes["a"]) == (None, "null")  # null became the text
    assert tuple(diff[5].changes["m"]) == (None, '[{"key":"k","value":"v"}]')
    names = snapshot_diff(new, old, ["id"]).filter("id = 5").select(F.map_keys("changes")).first()[0]
    assert names == ["a", "l", "m"]
    assert diff[3].changes is None and diff[4].changes is None
    assert diff[3].new_hash is None and diff[4].old_hash is None
    assert diff[2].old_hash != diff[2].new_hash and len(diff[2].new_hash) == 64


def test_diff_without_detail_agrees(old, new):
    full = {k: (r.change_type, r.old_hash, r.new_hash) for k, r in by_id(snapshot_diff(new, old, ["id"])).items()}
    brief = snapshot_diff(new, old, ["id"], detail=False)
    assert "changes" not in brief.columns
    assert {k: (r.change_type, r.old_hash, r.new_hash) for k, r in by_id(brief).items()} == full


def test_diff_reads_lists_as_sets_and_compares_chosen_columns(old, new):
    assert 5 not in by_id(snapshot_diff(new, old, ["id"], compare=["l"], set_cols=["l"]))
    assert 5 in by_id(snapshot_diff(new, old, ["id"], compare=["l"]))


def test_diff_with_itself_is_empty_and_applying_it_gives_the_new_snapshot(old, new):
    assert snapshot_diff(old, old, ["id"]).collect() == []
    diff = snapshot_diff(new, old, ["id"], detail=False)
    touched = diff.select(F.col("id").alias("k"))
    kept = old.join(touched, F.col("id").eqNullSafe(F.col("k")), "left_anti")
    put = diff.filter("change_type <> 'Delete'").select(F.col("id").alias("k"))
    built = kept.unionByName(new.join(put, F.col("id").eqNullSafe(F.col("k")), "left_semi"))
    assert snapshot_diff(built, new, ["id"]).collect() == []


def test_diff_counts_a_missing_column_as_null(rows):
    new, old = rows([(1, "x", 5), (2, "y", None)], "id INT, a STRING, extra INT"), rows([(1, "x"), (2, "y")], "id INT, a STRING")
    diff = by_id(snapshot_diff(new, old, ["id"]))
    assert {k: {f: tuple(c) for f, c in r.changes.items()} for k, r in diff.items()} == {1: {"extra": (None, "5")}}


@pytest.mark.parametrize("detail", [True, False])
def test_diff_refuses_repeated_keys(rows, detail):
    twice, once = rows([(1, "a"), (1, "a")], "id INT, a STRING"), rows([(1, "a")], "id INT, a STRING")
    for pair in ((twice, once), (once, twice)):
        with pytest.raises(PySparkException, match="duplicate key"):
            snapshot_diff(*pair, ["id"], detail=detail).collect()


def test_fingerprint_ignores_map_and_column_order_only(rows):
    df = rows(
        [
            (1, {"a": "1", "b": "2"}, ["x", "y"], ("p", {"c": 1, "d": 2})),
            (2, {"b": "2", "a": "1"}, ["x", "y"], ("p", {"d": 2, "c": 1})),
            (3, {"a": "1", "b": "3"}, ["x", "y"], ("p", {"c": 1, "d": 2})),
            (4, {"a": "1", "b": "2"}, ["y", "x"], ("p", {"c": 1, "d": 2})),
            (5, {"a": "1", "b": "2"}, ["x", "y"], None),
        ],
        "id INT, m MAP<STRING,STRING>, l ARRAY<STRING>, s STRUCT<n: STRING, deep: MAP<STRING,INT>>",
    )
    prints = {r.id: r.fingerprint for r in fingerprint(df, ["m", "l", "s"]).collect()}
    assert prints[1] == prints[2]
    assert len({prints[i] for i in (1, 3, 4, 5)}) == 4
    assert prints == {r.id: r.fingerprint for r in fingerprint(df, ["s", "l", "m"]).collect()}
    as_set = {r.id: r.fingerprint for r in fingerprint(df, ["m", "l", "s"], set_cols=["l"]).collect()}
    assert as_set[1] == as_set[4] != as_set[3]
    nulls = fingerprint(rows([(None, "b"), ("b", None)], "a STRING, b STRING"))
    assert nulls.select("fingerprint").distinct().count() == 2


@pytest.fixture
def layers(rows):
    schema = "k STRING, f1 STRING, f2 STRING, m MAP<STRING,STRING>, l ARRAY<INT>, s STRUCT<x: INT, d: MAP<STRING,INT>>"
    return [
        rows([("j", "base", "base", {"a": "0", "b": "0"}, [1, 2], (1, {"p": 1})), ("only0", "z", None, None, None, None)], schema),
        rows([("j", "one", None, {"b": "1", "c": None}, None, (None, {"q": 2}))], schema),
        rows([("j", None, None, {"a": None}, [3], None), ("only2", None, "t", {"k": "v"}, None, None)], schema),
    ]


def test_overlay_merges_field_by_field(layers):
    merged = {r.k: r for r in overlay(layers, ["k"]).collect()}
    j = merged["j"]
    assert (j.f1, j.f2, j.l) == ("one", "base", [3])
    assert j.m == {"a": "0", "b": "1", "c": None}
    assert (j.s.x, j.s.d) == (1, {"p": 1, "q": 2})
    assert merged["only0"].f1 == "z" and merged["only2"].m == {"k": "v"}


def test_overlay_of_empty_layers_is_the_identity_and_repeats_are_refused(layers):
    base = layers[0]
    assert collected(overlay([base, base.limit(0), base.limit(0)], ["k"]).drop("m", "s"), "k") == collected(
        base.drop("m", "s"), "k"
    )
    with pytest.raises(PySparkException, match="duplicate key"):
        overlay([base, base.unionByName(base)], ["k"]).collect()


def test_overlay_fills_columns_a_layer_lacks(rows):
    merged = overlay([rows([(1, "a")], "k INT, x STRING"), rows([(1, 5)], "k INT, y INT")], ["k"])
    assert merged.first().asDict() == {"k": 1, "x": "a", "y": 5}


def test_scope_is_by_path_component(rows):
    paths = rows([("a/b",), ("a/b/c",), ("a/bc",), ("a",), (None,)], "path STRING")
    for prefix in ("a/b", "a/b/"):
        assert collected(scope_subtree(paths, "path", prefix)) == [("a/b",), ("a/b/c",)]
    assert scope_subtree(paths, "path", "").count() == 4
    other = rows([("a/b", 1), ("zzz", 2)], "path STRING, n INT")
    assert collected(scope_to(other, scope_subtree(paths, "path", "a"), ["path"])) == [("a/b", 1)]


def test_existence_flags_every_expected_key_once(rows):
    expected, actual = rows([(1,), (1,), (2,), (None,)], "k INT"), rows([(1,), (3,), (1,)], "k INT")
    assert collected(existence(expected, actual, ["k"])) == [(None, False), (1, True), (2, False)]


def test_rules_are_all_reported(rows):
    df = rows(
        [
            (1, "s3", "AB_1", "x", None, ["t"]),
            (2, None, "", None, None, []),
            (3, "gcs", "ab", "x", "y", None),
        ],
        "id INT, kind STRING, code STRING, x STRING, y STRING, tags ARRAY<STRING>",
    )
    rules = [
        q.required("kind"),
        q.one_of("kind", ["s3", "jdbc"]),
        q.pattern("code", "[A-Z][A-Z0-9]*(_[A-Z0-9]+)*", severity="warning"),
        q.exclusive(["x", "y"]),
        q.exactly_one(["x", "y"]),
        q.at_least_one(["x", "y"]),
        q.required("tags"),
        q.required_when("y", 'F.col("kind") == "s3"'),
    ]
    out = check_rows(df, rules, ["id"])
    assert out.columns == ["id", "field", "message", "severity"]
    found = collected(out.select("id", "field", "message"))
    assert [(i, f) for i, f, _ in found] == [
        (1, "y"),
        (2, "code"),
        (2, "kind"),
        (2, "tags"),
        (2, "x, y"),
        (2, "x, y"),
        (3, "code"),
        (3, "kind"),
        (3, "tags"),
        (3, "x, y"),
        (3, "x, y"),
    ]
    messages = {(i, f): m for i, f, m in found}
    assert messages[2, "code"] == "is empty"
    assert "s3, jdbc" in messages[3, "kind"] and '"gcs"' in messages[3, "kind"]
    assert {r.severity for r in out.filter("field = 'code'").collect()} == {"warning"}


def test_duplicates_name_every_origin(rows):
    df = rows(
        [("a", "f1"), ("a", "f2"), ("a", "f2"), ("b", "f1"), (None, "f1"), (None, "f3"), ("A", "f1")],
        "name STRING, path STRING",
    )
    assert collected(find_duplicates(df, ["name"], "path"), "name", "origin") == [
        (None, "f1", 1, 2),
        (None, "f3", 1, 2),
        ("a", "f1", 1, 3),
        ("a", "f2", 2, 3),
    ]
    assert collected(find_duplicates(df, ["name"])) == [(None, 2), ("a", 3)]
    two = rows([(1, "x", "f"), (1, "x", "g"), (1, None, "f"), (2, None, "f"), (1, None, "g")], "i INT, s STRING, o STRING")
    assert collected(find_duplicates(two, ["i", "s"])) == [(1, None, 2), (1, "x", 2)]
    assert find_duplicates(two, ["i"], "o").columns == ["i", "origin", "n_origin", "n_rows"]


def test_orphans_skip_null_references(rows):
    refs, known = rows([(1, 10), (2, 99), (3, None)], "id INT, ref INT"), rows([(10,), (10,), (None,)], "key INT")
    assert [tuple(r) for r in find_orphans(refs, "ref", known, "key").collect()] == [(2, 99, "ref", "99")]


def test_canonical_text_does_not_depend_on_the_session_zone(spark):
    df = spark.sql(
        "SELECT id, timestamp_micros(1730611800000000 + 3600000000 * id) AS at FROM VALUES (0L), (1L) AS t(id)"
    )  # 05:30 and 06:30 UTC, both 01:30 in New York on that night
    old, new = df.filter("id = 0").selectExpr("1 AS k", "at"), df.filter("id = 1").selectExpr("1 AS k", "at")
    prints, hashes, zone = [], [], spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("America/New_York", "UTC", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            row = snapshot_diff(new, old, ["k"]).first()
            assert tuple(row.changes["at"]) == ("2024-11-03 05:30:00Z", "2024-11-03 06:30:00Z")
            hashes.append((row.old_hash, row.new_hash))
            nested = df.selectExpr("id", "map(at, array(at)) AS m", "named_struct('at', at, 'x', map(named_struct('t', at), 1)) AS s")
            prints.append([r.fingerprint for r in fingerprint(nested, ["m", "s"]).orderBy("id").collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert len(set(hashes)) == 1 and prints[0] == prints[1] == prints[2] and prints[0][0] != prints[0][1]


def test_fingerprints_tell_map_keys_apart_to_the_microsecond(spark):
    df = spark.sql("SELECT map(timestamp_micros(1000000 + id), 'v') AS m, map(timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,0,0,id / 1e6), 1) AS n FROM range(1, 4)")
    for name in ("m", "n"):
        assert len({r.fingerprint for r in fingerprint(df, [name]).collect()}) == 3
    zeros = spark.sql("SELECT double('-0.0') AS d, array(float('-0.0')) AS a UNION ALL SELECT double('0.0'), array(float('0.0'))")
    assert len({r.fingerprint for r in fingerprint(zeros).collect()}) == 1
    assert snapshot_diff(zeros.limit(1).selectExpr("1 AS k", "d"), zeros.selectExpr("1 AS k", "d").limit(1), ["k"]).count() == 0


def test_null_and_the_text_null_are_told_apart(spark):
    old = spark.sql("SELECT 1 AS k, 'null' AS a, CAST(NULL AS STRING) AS b")
    new = spark.sql("SELECT 1 AS k, CAST(NULL AS STRING) AS a, 'null' AS b")
    changes = snapshot_diff(new, old, ["k"]).first().changes
    assert tuple(changes["a"]) == ("null", None) and tuple(changes["b"]) == (None, "null")
