"""Canonical text against Python's own."""

import datetime as dt
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from attesta.functions import canonical as C

SCHEMA = "b boolean, i int, l bigint, d double, s string, day date, t timestamp, a array<double>, m map<string,bigint>, n map<int,string>, o struct<`z é`:string,a:array<struct<k:string,v:boolean>>>, `q\"\\\\` string"
UTC = dt.timezone.utc
ROWS = [
    (True, -1, 2**62, 0.1, 'a"\\/\u007f é🎉\x00\x1f\n\r\t\b\f', dt.date(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 5, UTC), [1.0, None, 1e16, -0.0], {"b": 1, "a": None, "é": 3, "🎉": 4, "": 5}, {10: "x", 9: None}, ("x", [("k", None), None]), "w"),
    (None,) * 12,
    (False, 0, 0, float("nan"), "", dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 12, 0, tzinfo=UTC), [], {}, {}, (None, []), ""),
]


def plain(v):
    if isinstance(v, tuple) and hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, dt.datetime):
        return (v if v.tzinfo else v.astimezone(UTC)).isoformat()
    return v.isoformat() if isinstance(v, dt.date) else v


def dumps(v):
    return json.dumps(plain(v), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def test_nested_rows_match_python(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    names = df.columns
    found = df.select("*", C.canonical_text(df, {c: F.col(f"`{c}`") for c in names}).alias("text")).collect()
    for r in found:
        assert r.text == dumps({c: r[c] for c in names})
    short = df.select(C.canonical_text(df, {"s": F.col("s"), "i": F.col("i")}, drop_null={"i"}).alias("text")).collect()
    assert [r.text for r in short][1] == '{"s":null}' and json.loads(short[0].text)["i"] == -1


def test_doubles_match_python(spark):
    rng = random.Random(4)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(20_000)]
    values += [rng.choice([-1, 1]) * round(rng.uniform(0, 10 ** rng.randint(-8, 20)), rng.randint(0, 12)) for _ in range(20_000)]
    values += [5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1e22, 1e23, 8.41e21, 2e-3, 1e-5, 9999999999999998.0, 1e16, 0.0001, 123456789.0, 2.0**-44, 0.0, -0.0, float("inf"), float("-inf")]
    values = [v for v in values if v == v] + [2.0**k for k in range(-1074, 1024)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wrong = [(r.v, r.t) for r in df.select("v", C.double_text(F.col("v")).alias("t")).collect() if r.t != json.dumps(r.v)]
    assert not wrong, (len(wrong), wrong[:10])


def test_session_zone_does_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("select timestamp_micros(1234567) t, timestamp_ntz '2020-03-08 02:30:00.5' n")
        row = df.select(C.canonical_text(df, {"t": F.col("t"), "n": F.col("n")}).alias("x")).first()
        assert row.x == '{"n":"2020-03-08T02:30:00.500000+00:00","t":"1970-01-01T00:00:01.234567+00:00"}'
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_types_without_json_are_refused(spark):
    df = spark.sql("select binary('a') b, 1.5BD d")
    for c in df.columns:
        with pytest.raises(TypeError):
            C.canonical_text(df, {"x": F.col(c)})
