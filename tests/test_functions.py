import random

import pytest
from pyspark.sql import functions as F

from stratalog.functions import masking, text

CASES = {
    "10.9.8.7:4711:refused it": ("{ip}:refused it", ["10.9.8.7:4711"]),
    "shelf s_-160 is empty": ("shelf s_{num} is empty", ["-160"]),
    'msg={"n": 42}': ('msg={{"n": {num}}}', ["42"]),
    "parcel_4418999687919862906": ("parcel_{num}", ["4418999687919862906"]),
    "no digits / but Feed/path and deadbeefdeadbeefaa {x}": ("no digits / but Feed{path} and {hash} {{x}}", ["/path", "deadbeefdeadbeefaa"]),
    "naïve12:00:00": ("naïve12:{num}:{num}", ["00", "00"]),
    "12:00:00é": ("{time}é", ["12:00:00"]),
    r"5 $1 \d": (r"{num} ${num} \d", ["5", "1"]),
    "": ("", []),
    "no entity here": ("no entity here", []),
    "070203 114455 12 NOTE q: parcel p_-77 from: /10.20.30.40:5060": ("{num} {num} {num} NOTE q: parcel p_{num} from: /{ip}", ["070203", "114455", "12", "-77", "10.20.30.40:5060"]),
    "PUT /depot/shelf/{slot} code=204 31ms": ("PUT {path}/{{slot}} code={num} {size}", ["/depot/shelf", "204", "31ms"]),
}


def test_masking(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "line string")
    for r in masking.masked(df, "line").collect():
        assert (r.pattern, list(r.params)) == CASES[r.line]


def test_lines_come_back(spark):
    rng = random.Random(5)
    parts = ["{", "}", "{{", " ", "\t", "12", "-3.5", "a", "é", "漢", "=", "10.0.0.1", "/x/y.z", "2024-01-02T03:04:05Z", "$1", "\\", "5ms", "deadbeefdeadbeef", "{num}"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    df = masking.masked(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    assert df.where(~masking.unmask(F.col("pattern"), F.col("params")).eqNullSafe(F.col("line"))).count() == 0


def test_null_lines_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "x")], "line string, params string")
    r = masking.masked(df, "line").first()
    assert (r.pattern, r.params) == ("", [])
    assert masking.masked(df.limit(0), "line").count() == 0


def test_slots_and_named_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    names = lambda p: one(masking.slot_names(masking.slots(F.lit(p))))
    assert names("moved {num} of {num} parcels") == ["num", "num_1"]
    assert names("PUT /shelf/{{slot}} {state}") == ["state"]
    assert names("{{{num}}}") == ["num"]
    assert one(masking.slot_count(F.lit('{{"n":{num}}}'))) == 1
    assert [one(masking.slot_base_name(F.lit(x))) for x in ("num_1", "user", "pool_wait")] == ["num", "user", "pool_wait"]
    assert one(masking.strip_key_prefix(F.lit("user=usr_1"), F.lit("user"))) == "usr_1"
    assert one(masking.unmask(F.lit("a {num} b"), F.array().cast("array<string>"))) is None
    assert one(masking.unmask(F.lit("a {num}"), F.array(F.lit("1"), F.lit("2")))) == "a 1"
    assert one(masking.unmask_named(F.lit("{num}-{num}"), F.create_map(F.lit("num"), F.lit("1"), F.lit("num_1"), F.lit("2")))) == "1-2"
    assert one(masking.unmask_named(F.lit("{num}"), F.create_map(F.lit("x"), F.lit("1")))) is None
    assert one(masking.pattern_query("a {id} {x_1} {count}")) == "a {num} {num_1} {num}"


def test_event_times(spark):
    cases = {
        "2024-01-01T00:00:01Z x": 1704067201000,
        "2024-01-01 00:00:01,250 x": 1704067201250,
        "x (2024-01-01T00:00:01.5Z)": 1704067201500,
        "2024-01-01T01:00:01+0100 x": 1704067201000,
        "2024-01-01T01:00:01.123456789+01:00 x": 1704067201123,
        "2024-01-01T00:00:01.123456 x": None,
        "2024-01-01 nothing": None,
        "[2024-01-01T00:00:01Z] x": None,
        "bad 2024-99-01T00:00:01Z then 2024-01-01T00:00:01Z": None,
        "no time": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "line string").withColumn("ms", text.event_time(F.col("line")))
    assert {r.line: r.ms for r in df.collect()} == cases


def test_numbers_and_units(spark):
    df = spark.createDataFrame([("12.5ms",), ("k=3KB",), ("x",), ("a=b=4",)], "v string").select("v", text.number(F.col("v")).alias("n"), text.unit(F.col("v")).alias("u"))
    assert {r.v: (r.n, r.u) for r in df.collect()} == {"12.5ms": (12.5, "ms"), "k=3KB": (3.0, "KB"), "x": (None, "x"), "a=b=4": (4.0, "")}


def test_durations_and_instants():
    assert text.duration("90s").total_seconds() == 90 and text.duration("7d").days == 7
    for bad in ("", "5", "5w", "-1h"):
        with pytest.raises(ValueError):
            text.duration(bad)
    assert text.instant("2024-01-01T00:00:01Z") == text.instant("2024-01-01 00:00:01") == 1704067201000
    with pytest.raises(ValueError):
        text.instant("yesterday")
