"""Masking, counting, null defaults and time partitions."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from etlspec import add_time_partitions, mask_pii, pii_report, run_pipeline, with_defaults
from etlspec.functions.privacy import ENTITIES, PATTERNS, redact
from tests.conftest import SMALL

NEAR_MISSES = [
    "12-34-5678", "1.2.3", "a@b", "@x.com", "12345", "555-12-123", "2024-01-31", "", "1700000000", "12:30:45", "00:1A:2B:3C:4D:5E", "std::vector",
    "x::1", "+12 345", "1 + 1234567", "22345678901", "a:b::", "1234567:1::2x",
]


@pytest.mark.parametrize(
    "text, masked",
    [
        ("mail a.b+c@ex-ample.co.uk now", "mail [EMAIL] now"),
        ("ssn 123-45-6789.", "ssn [USA_SSN]."),
        ("card 4111 1111 1111 1111 or 4111-1111-1111-1111", "card [CREDIT_CARD] or [CREDIT_CARD]"),
        ("4111111111111111", "[CREDIT_CARD]"),
        ("3782 822463 10005 or 3782-822463-10005", "[CREDIT_CARD] or [CREDIT_CARD]"),
        ("from 10.0.0.255 to", "from [IP_ADDRESS] to"),
        ("call (555) 123-4567 or +1 555-123-4567", "call [PHONE_NUMBER] or [PHONE_NUMBER]"),
        ("a@b.com_x@y.org,z@w.net", "[EMAIL][EMAIL],[EMAIL]"),
        ("5551234567, +44 20 7946 0958; +33 1 23 45 67 89", "[PHONE_NUMBER], [PHONE_NUMBER]; [PHONE_NUMBER]"),
        ("+49 (30) 123456 or +15551234567", "[PHONE_NUMBER] or [PHONE_NUMBER]"),
        ("at 2001:db8:0:0:8a2e:370:7334:1, fe80::1 and abcd::beef", "at [IP_ADDRESS], [IP_ADDRESS] and [IP_ADDRESS]"),
        ("abcd:abcd:abcd:abcd:abcd:abcd:abcd:beef", "[IP_ADDRESS]"),
        *[(t, t) for t in NEAR_MISSES],
    ],
)
def test_redaction(spark, text, masked):
    df = spark.createDataFrame([(text,)], "t STRING")
    once = df.select(redact(df.t, ENTITIES).alias("t"))
    assert once.first().t == masked
    assert once.select(redact(once.t, ENTITIES)).first()[0] == masked
    assert not any(once.filter(once.t.rlike(p)).count() for p in PATTERNS.values()) if text != masked else True


def test_the_order_of_the_list_does_not_matter(spark):
    df = spark.createDataFrame([("123-45-6789 4111 1111 1111 1111 a@b.co 555-123-4567",)], "t STRING")
    results = {df.select(redact(df.t, order)).first()[0] for order in (ENTITIES, ENTITIES[::-1])}
    assert results == {"[USA_SSN] [CREDIT_CARD] [EMAIL] [PHONE_NUMBER]"}
    assert df.select(redact(df.t, ["EMAIL"])).first()[0].startswith("123-45-6789")
    with pytest.raises(ValueError, match="PASSPORT"):
        redact(df.t, ["PASSPORT"])


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1.@-+_ (é)", max_size=40), min_size=300, max_size=300))
def test_fast_forms_find_what_the_plain_patterns_find(spark, texts):
    from pyspark.sql import functions as F

    from etlspec.functions.privacy import _FORMS

    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for entity, pattern in PATTERNS.items():
        fast = F.regexp_replace("t", F.lit(_FORMS[entity]), F.lit("#"))
        slow = F.regexp_replace("t", F.lit(pattern), F.lit("#"))
        assert df.filter(fast != slow).take(1) == [], entity


def test_long_words_do_not_blow_up(spark):
    df = spark.createDataFrame([("x" * 2_000_000 + " a@b.com",)], "t STRING")
    assert df.select(redact(df.t, ["EMAIL"])).first()[0].endswith(" [EMAIL]")


def test_nested_strings_are_masked_and_the_schema_stays(spark):
    row = (1, ["a@b.com", None], {"k@k.com": "a@b.com"}, ("x a@b.com", 7, [("a@b.com",)]), None)
    schema = "id INT, a ARRAY<STRING>, m MAP<STRING,STRING>, s STRUCT<x: STRING, n: INT, l: ARRAY<STRUCT<y: STRING>>>, z STRING"
    df = spark.createDataFrame([row, (2, None, None, None, None)], schema)
    out = mask_pii(df, ["EMAIL"])
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [(f.name, f.dataType.simpleString()) for f in df.schema]
    first, second = out.orderBy("id").collect()
    assert first.a == ["[EMAIL]", None] and first.m == {"[EMAIL]": "[EMAIL]"}
    assert (first.s.x, first.s.n, first.s.l[0].y) == ("x [EMAIL]", 7, "[EMAIL]")
    assert second.s is None and second.a is None


def test_keys_that_become_equal_are_numbered(spark):
    df = spark.sql("SELECT map('a@b.co', 'x', 'plain', 'c@d.co', 'e@f.co', 'y', 'g@h.co and more', 'z', 'i@j.co', NULL) AS m, map(1, 'a@b.co') AS n, CAST(NULL AS MAP<STRING, INT>) AS o")
    out = mask_pii(df, ["EMAIL"]).first()
    assert out.m == {"[EMAIL]": "x", "plain": "[EMAIL]", "[EMAIL] 2": "y", "[EMAIL] and more": "z", "[EMAIL] 3": None}
    assert out.n == {1: "[EMAIL]"} and out.o is None
    counts = {r["column"]: r.matches for r in pii_report(df, ["EMAIL"]).collect()}
    assert counts == {"m": 5, "n": 1, "o": 0}


def test_report_counts_what_masking_replaces(spark):
    df = spark.createDataFrame(
        [("a@b.co c@d.co", ["1.2.3.4"]), (None, None), ("4111 1111 1111 1111", ["e@f.co", "x"])], "t STRING, l ARRAY<STRING>"
    )
    counts = {(r["column"], r.entity): (r.matches, r.rows) for r in pii_report(df).collect()}
    assert counts["t", "EMAIL"] == (2, 1) and counts["t", "CREDIT_CARD"] == (1, 1)
    assert counts["t", "PHONE_NUMBER"] == (0, 0)
    assert counts["l", "IP_ADDRESS"] == (1, 1) and counts["l", "EMAIL"] == (1, 1)
    assert len(counts) == 2 * len(ENTITIES)


def test_mask_runs_after_transforms_and_not_for_code(spark, caplog):
    frames = {"t": spark.createDataFrame([("a@b.co",)], "m STRING")}
    steps = [{"type": "filter", "condition": "m LIKE '%@%'"}]
    assert run_pipeline(spark, {"transforms": steps, "mask_pii": ["EMAIL"]}, frames=frames).output.first().m == "[EMAIL]"
    body = {"body": "df_result = df_t", "mask_pii": ["EMAIL"]}
    assert run_pipeline(spark, body, frames=frames, allow_code=True).output.first().m == "a@b.co"
    assert "no effect" in caplog.text


def test_defaults_by_type(spark):
    schema = """k INT, s STRUCT<a: INT, b: STRING, c: STRUCT<d: DATE>>, l ARRAY<INT>, m MAP<STRING, INT>, d DATE,
        t TIMESTAMP, n TIMESTAMP_NTZ, dec DECIMAL(10,2), bin BINARY, f BOOLEAN, x DOUBLE, txt STRING, ls ARRAY<STRUCT<q: INT>>"""
    df = spark.createDataFrame([(1, *[None] * 12), (2, (None, "b", None), [1, None], {"a": None}, *[None] * 8, [(None,)])], schema)
    df = df.selectExpr("*", "NULL AS nothing")
    out = with_defaults(df)
    empty, part = out.orderBy("k").collect()
    epoch = datetime.datetime(1970, 1, 1)
    assert (empty.s.a, empty.s.b, empty.s.c.d) == (0, "", epoch.date())
    assert (empty.l, empty.m, empty.d, empty.n) == ([], {}, epoch.date(), epoch)
    assert out.filter("k = 1 AND t = TIMESTAMP'1970-01-01 00:00:00'").count() == 1
    assert (float(empty.dec), bytes(empty.bin), empty.f, empty.x, empty.txt) == (0.0, b"", False, 0.0, "")
    assert empty.nothing == "" and out.schema["nothing"].dataType.simpleString() == "string"
    assert (part.s.b, part.l, part.m, part.ls[0].q) == ("b", [1, 0], {"a": 0}, 0)
    same = [f.dataType.simpleString() for f in df.drop("nothing").schema]
    assert [f.dataType.simpleString() for f in out.drop("nothing").schema] == same


def test_time_partitions_follow_the_fill(spark):
    df = spark.createDataFrame([(1, datetime.datetime(2024, 3, 5, 1)), (2, None)], "id INT, ts TIMESTAMP")
    out = add_time_partitions(with_defaults(df), ("year", "month", "day"), "ts").orderBy("id").collect()
    assert [(r.year, r.month, r.day) for r in out] == [(2024, 3, 5), (1970, 1, 1)]
    stamped = add_time_partitions(df, ("year",), create=True)
    assert stamped.columns == ["id", "ts", "ingestion_timestamp", "year"]
    assert stamped.select("ingestion_timestamp").distinct().count() == 1


def test_patterns_agree_with_re2_on_all_text(spark):
    import duckdb

    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    ours = {r.doc_id: r.t for r in df.select("doc_id", redact(df.text, ENTITIES).alias("t")).collect()}
    from etlspec.catalogue import CATALOGUE

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    assert ours == dict(con.execute(CATALOGUE["pii_all"].sql).fetchall())
