"""Semantics that differ from Spark's defaults, on literals."""

import base64
import datetime
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from zephyrine.functions import casts, jsons, logic, misc, numbers, strings, temporal, vectors


@pytest.fixture
def one(spark):
    def run(*columns):
        row = spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(columns)]).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return run


def fails(one, column):
    with pytest.raises(Exception):
        one(column)


def test_and_or(one):
    T, N, NULL = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(logic.strict_and(N, NULL), logic.strict_and(T, T), logic.strict_and(T, N)) == (None, True, False)
    assert one(logic.strict_or(N, NULL), logic.strict_or(NULL, NULL), logic.strict_or(T, NULL)) == (False, None, True)


def test_truthy(one):
    assert one(logic.truthy(F.lit(-1), "int"), logic.truthy(F.lit(0.5), "double"), logic.truthy(F.lit(""), "string")) == (False, True, False)
    assert one(logic.truthy(temporal.make(0, 0, 0), "interval"), logic.truthy(temporal.make(0, 1, 0), "interval")) == (False, True)
    assert one(logic.truthy(F.lit("x"), "json"), logic.truthy(F.array(F.lit(1.0)), "vector")) == (True, True)
    assert one(logic.truthy(F.lit("00000000-0000-0000-0000-000000000000"), "uuid")) is False
    with pytest.raises(ValueError):
        logic.truthy(F.lit(1), "thing")


def test_quantified(one):
    holes = F.array(F.lit(1), F.lit(None).cast("int"))
    x = F.lit(1)
    assert one(logic.any_of(x, "=", holes), logic.any_of(F.lit(2), "=", holes), logic.any_of(F.lit(2), "=", F.array(F.lit(1)))) == (True, None, False)
    assert one(logic.all_of(x, "=", holes), logic.all_of(F.lit(2), "=", holes), logic.all_of(x, "=", F.array(F.lit(1)))) == (None, False, True)
    assert one(logic.any_of(F.lit(None).cast("int"), "=", holes)) is None
    assert one(logic.in_list(x), logic.in_list(x, 1, 2), logic.in_list(x, 2, None)) == (False, True, None)


def test_integers(one):
    assert one(numbers.idiv(F.lit(-7), F.lit(2)), numbers.imod(F.lit(-7), F.lit(2)), numbers.idiv(F.lit(7), F.lit(-2))) == (-3, -1, -3)
    fails(one, numbers.idiv(F.lit(1), F.lit(0)))
    fails(one, numbers.imod(F.lit(1), F.lit(0)))
    fails(one, F.lit(1 << 62) * F.lit(4).cast("long"))
    assert one(numbers.bit_xor(F.lit(6), F.lit(3)), numbers.bit_and(F.lit(6), F.lit(3)), numbers.bit_or(F.lit(6), F.lit(3))) == (5, 2, 7)


def test_averages(spark):
    df = spark.createDataFrame([(-7,), (0,), (None,), (-4,)], "x int")
    assert df.agg(numbers.avg_int(F.col("x"))).first()[0] == -3
    assert df.where("x > 5").agg(numbers.avg_int(F.col("x"))).first()[0] is None
    d = spark.createDataFrame([(1,), (2,), (2,)], "x int").select(F.col("x").cast("decimal(9,2)").alias("x"))
    assert str(d.agg(numbers.avg_decimal(F.col("x"), 2)).first()[0]) == "1.67"


def test_decimals(one):
    dec = lambda v, s: F.lit(v).cast(f"decimal(9,{s})")
    assert str(one(numbers.dec_div(dec("3.5", 1), dec("1.5", 1), 1))) == "2.3"
    assert str(one(numbers.dec_mul(dec("1.25", 2), dec("2.5", 1), 2, 1))) == "3.125"


def test_rounding(one):
    assert one(numbers.round_int(F.lit(2.5)), numbers.round_int(F.lit(-2.5)), numbers.sign_int(F.lit(-3))) == (3, -3, -1)
    assert one(numbers.trunc_double(F.lit(-2.7)), numbers.ceil_double(F.lit(2.1)), numbers.floor_double(F.lit(-2.1))) == (-2.0, 3.0, -3.0)
    assert one(numbers.pow_int(F.lit(2), F.lit(10)), numbers.log(F.lit(1000.0))) == (1024, pytest.approx(3))
    fails(one, numbers.sqrt_strict(F.lit(-1.0)))
    assert one(numbers.random_int()) >= 0


def test_strings(one):
    s, null = F.lit("abc"), F.lit(None).cast("string")
    assert one(strings.concat(s, null, s), strings.joined(s, null)) == ("abcabc", None)
    assert one(strings.lower(F.lit("ÀB")), strings.upper(F.lit("àb"))) == ("Àb", "àB")
    assert one(strings.substr(s, 2), strings.substr(s, 2, 2), strings.substr(null, 2)) == ("bc", "bc", None)
    for bad in (strings.substr(s, 0), strings.substr(s, 4), strings.substr(s, 2, 3)):
        fails(one, bad)
    assert one(strings.substr(s, 9, strict=False)) == ""
    assert one(strings.strpos(s, "c"), strings.strpos(s, "x"), strings.strpos(s, ""), strings.strpos(null, "")) == (3, 0, 0, None)
    assert one(strings.trim(F.lit("\t\n a \v\f")), strings.ltrim(F.lit("xxa"), "x"), strings.rtrim(F.lit("axx"), "x")) == ("a", "a", "a")
    with pytest.raises(ValueError):
        strings.replace(s, "", "x")
    assert one(strings.size(F.lit("né")), strings.octet_length(F.lit("né")), strings.size(F.lit("[1,2]"), "json"), strings.size(F.lit('{"a":1}'), "json")) == (2, 3, 2, 1)


def test_regexp(one):
    s = F.lit("ab12cd34")
    assert one(strings.regexp_like(s, r"\d"), strings.regexp_substr(s, r"\d+"), strings.regexp_substr(s, "x")) == (True, "12", None)
    assert one(strings.regexp_match(s, r"([a-z]+)(\d+)", 2), strings.regexp_match(s, "(x)", 1)) == (["ab12", "ab", "12"], None)
    assert one(strings.regexp_replace(s, r"(\d)(\d)", "$2$1")) == "ab21cd43"


def test_codings(one):
    s = F.lit("a?>~é")
    raw = "a?>~é".encode()
    assert one(misc.encode(s), misc.encode(s, "base64url")) == (base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().rstrip("="))
    assert one(misc.decode(misc.encode(s, "base64url"), "base64url"), misc.decode(misc.encode(s))) == ("a?>~é", "a?>~é")
    with pytest.raises(ValueError):
        misc.encode(s, "hex")
    assert one(misc.md5(s), misc.sha1(s)) == (hashlib.md5(raw).hexdigest(), hashlib.sha1(raw).hexdigest())
    fails(one, misc.error("no"))
    assert len(one(misc.random_uuid())) == 36


def test_jwt(one):
    token = one(misc.jwt(F.lit('{"alg":"HS256"}'), F.lit('{"a":1}'), F.lit("key")))
    head, body, sign = token.split(".")
    want = hmac.new(b"key", f"{head}.{body}".encode(), hashlib.sha256).digest()
    assert base64.urlsafe_b64decode(sign + "==") == want
    assert json.loads(base64.urlsafe_b64decode(body + "==")) == {"a": 1}
    assert one(misc.jwt(F.lit("{}"), F.lit(None).cast("string"), F.lit("k"))) is None


@pytest.mark.parametrize(
    "text,want",
    [("1 day", (0, 1, 0)), ("2 weeks -3 hours", (0, 14, -10_800_000_000)), ("1 year 2 mon 5 us", (14, 0, 5)), ("- 4 minutes", (0, 0, -240_000_000)), ("7 ms", (0, 0, 7000))],
)
def test_interval_text(one, text, want):
    assert temporal.parse_interval(text) == want
    assert tuple(one(temporal.interval(F.lit(text)))) == want


def test_interval_errors():
    for bad in ("", "x", "1 parsec", "1 day and"):
        with pytest.raises(ValueError):
            temporal.parse_interval(bad)


def at(s):
    return F.lit(s).cast("timestamp")


def test_month_arithmetic_runs_on(one):
    plus = lambda s, iv: one(temporal.add_interval(at(s), temporal.interval(iv)).cast("string"))
    assert plus("2023-01-31 10:00:00", "1 month") == "2023-03-03 10:00:00"
    assert plus("2024-01-31 10:00:00", "1 month") == "2024-03-02 10:00:00"
    assert plus("2024-02-29 23:30:00", "1 year 1 hour") == "2025-03-02 00:30:00"
    assert plus("2024-03-15 01:00:00", "-2 hours -15 days") == "2024-02-28 23:00:00"


def test_intervals_compare_by_parts(one):
    assert one(temporal.interval("1 month") > temporal.interval("400 days"), temporal.interval("1 day") > temporal.interval("25 hours")) == (True, True)
    assert tuple(one(temporal.interval_add(temporal.interval("1 day"), temporal.interval_neg(temporal.interval("1 month"))))) == (-1, 1, 0)


def test_date_bin(one):
    day = lambda iv, s, **k: one(temporal.date_bin(iv, at(s), **k).cast("string"))
    assert day("15 minutes", "2024-01-01 10:31:02") == "2024-01-01 10:30:00"
    assert day("1 day", "2024-01-01 10:31:02", origin=3_600_000_000) == "2024-01-01 01:00:00"
    for bad in ("1 month", "0 days", "-1 hours"):
        with pytest.raises(ValueError):
            temporal.date_bin(bad, at("2024-01-01"))
    fails(one, temporal.date_bin("1 day", at("2000-01-01 00:00:00")))


def test_truncation_and_fields(one):
    t = at("2024-05-06 07:08:09.123456")
    assert one(temporal.date_trunc("hour", t).cast("string"), temporal.date_trunc("day", t, "Asia/Tokyo").cast("string")) == ("2024-05-06 07:00:00", "2024-05-05 15:00:00")
    assert one(*[temporal.extract(f, t) for f in ("year", "second", "millisecond", "microsecond")]) == (2024, 9, 123, 123456)
    assert one(temporal.extract("hour", t, "Asia/Tokyo")) == 16
    iv = temporal.interval("14 months 3 days 90061 seconds")
    assert one(*[temporal.extract_interval(f, iv) for f in ("year", "month", "day", "hour", "minute", "second")]) == (1, 2, 3, 25, 1, 1)
    assert [tuple(one(temporal.interval_trunc(f, iv))) for f in ("year", "month", "day", "hour")] == [(12, 0, 0), (14, 0, 0), (14, 3, 0), (14, 3, 90_000_000_000)]
    with pytest.raises(ValueError):
        temporal.date_trunc("week", t)
    with pytest.raises(ValueError):
        temporal.extract("week", t)


def test_differences_and_zones(one):
    assert tuple(one(temporal.ts_diff(at("2024-01-02 00:00:00"), at("2024-01-01 23:00:00")))) == (0, 0, 3_600_000_000)
    assert one(temporal.date_diff(F.lit("2024-03-01").cast("date"), F.lit("2024-02-28").cast("date"))) == 2
    assert one(temporal.at_timezone(at("2024-01-01 00:00:00"), "Asia/Famagusta")) == "2024-01-01 02:00:00.000000"
    assert one(temporal.from_julian(F.lit(2_440_589)), temporal.to_julian(F.lit("1970-01-02").cast("date"))) == (datetime.date(1970, 1, 2), 2_440_589)


def test_json_arrays(one):
    a, v = F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<long>"), F.lit(9).cast("long")
    assert one(jsons.append(a, v), jsons.push(a, v, v + 1), jsons.pop(a), jsons.pop_back(a)) == ([1, 2, 3, 9], [9, 10, 1, 2, 3], [2, 3], [1, 2])
    assert one(jsons.put(a, 1, v), jsons.remove(a, 0)) == ([1, 9, 3], [2, 3])
    empty = F.array().cast("array<long>")
    assert one(jsons.pop(empty), jsons.pop_back(empty)) == ([], [])
    fails(one, jsons.put(a, 3, v))
    fails(one, jsons.remove(a, -1))


def test_json_paths(one):
    doc = F.lit('{"b":{"y":1,"x":null},"a":[1]}')
    assert one(jsons.set_(doc, "b.z", F.lit("2")), jsons.unset(doc, "b.y"), jsons.unset(doc, "q.r")) == ('{"b":{"y":1,"x":null,"z":2},"a":[1]}', '{"b":{"x":null},"a":[1]}', '{"b":{"y":1,"x":null},"a":[1]}')
    assert one(jsons.has(doc, "b.x"), jsons.has(doc, "b.q"), jsons.has(F.lit(None).cast("string"), "b")) == (True, False, None)
    fails(one, jsons.set_(doc, "q.z", F.lit("2")))
    v = jsons.parse(doc)
    assert one(jsons.get(v, "$.b.y", "long"), jsons.get(v, "$.a[0]", "long"), jsons.get(v, "$.a[5]", "long"), jsons.get(v, "$.n")) == (1, 1, None, None)
    assert one(jsons.object_of(z=F.lit(1), a=F.lit(None).cast("int")), jsons.array_of(F.lit(1), F.lit(2))) == ('{"z":1,"a":null}', "[1,2]")


def test_casts(one):
    assert one(casts.to_bool(F.lit("true"), "string"), casts.to_bool(F.lit(-1), "int"), casts.to_int(F.lit(-2.7), "double")) == (True, False, -2)
    fails(one, casts.to_bool(F.lit("yes"), "string"))
    assert one(casts.to_vector(F.lit("[1, 2.5]"))) == [1.0, 2.5]
    assert one(casts.to_uuid(F.lit("00000000-0000-0000-0000-00000000000A"))) == "00000000-0000-0000-0000-00000000000a"
    fails(one, casts.to_uuid(F.lit("nope")))
    assert one(casts.to_string(casts.to_json(F.lit("a\"b")), "json"), casts.to_int(casts.json_decode(F.lit("7")), "json")) == ('a"b', 7)
    assert one(casts.to_timestamp(F.lit("2024-01-01 09:00:00"), "string", "Asia/Tokyo").cast("string")) == "2024-01-01 00:00:00"
    assert one(casts.type_of(temporal.make(0, 0, 0)), casts.type_of(F.array(F.lit(1.0).cast("float"))), casts.type_of(F.lit(None).cast("int"))) == ("interval", "vector", "null")


def test_vectors(one):
    a, b, z = (vectors.literal(v) for v in ([1, 0], [0, 2], [0, 0]))
    assert one(vectors.cos_distance(a, b), vectors.cos_distance(a, a), vectors.cos_distance(a, z)) == (1.0, 0.0, 1.0)
    assert one(vectors.add(a, b), vectors.sub(a, b), vectors.mul(a, b), vectors.item(b, 1)) == ([1.0, 2.0], [1.0, -2.0], [0.0, 0.0], 2.0)
    fails(one, vectors.cos_distance(a, vectors.literal([1])))
    fails(one, vectors.item(a, 2))
    assert one(vectors.less(a, vectors.literal([0, 0, 0])), vectors.less(b, a)) == (True, True)
