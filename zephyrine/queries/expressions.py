"""Scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyrine.functions import casts, misc, numbers, strings, temporal
from zephyrine.queries.registry import Registry

Q = Registry()
c = F.col


def r6(x, name):
    """Rounded, as libraries differ in a last digit; a zero has no sign."""
    return (F.round(x, 6) + 0.0).alias(name)


X500 = "(o_orderkey - 500)"


@Q.add("arith_int_div_mod", f"SELECT o_orderkey, CAST(sign({X500}) * (abs({X500}) // 7) AS BIGINT) AS q, CAST(sign({X500}) * (abs({X500}) % 7) AS BIGINT) AS r, (o_orderkey + 3) * 2 - 1 AS s FROM orders")
def arith_int_div_mod(t):
    x = c("o_orderkey") - 500
    return t.orders.select("o_orderkey", numbers.idiv(x, F.lit(7)).alias("q"), numbers.imod(x, F.lit(7)).alias("r"), ((c("o_orderkey") + 3) * 2 - 1).alias("s"))


@Q.add("arith_negative_div", "SELECT n_nationkey, CAST(trunc((n_nationkey - 12) / 5) AS BIGINT) AS q, CAST((n_nationkey - 12) - 5 * trunc((n_nationkey - 12) / 5) AS BIGINT) AS r FROM nation")
def arith_negative_div(t):
    x = c("n_nationkey").cast("long") - 12
    return t.nation.select("n_nationkey", numbers.idiv(x, F.lit(5)).alias("q"), numbers.imod(x, F.lit(5)).alias("r"))


@Q.add("bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS o, xor(o_orderkey, 9) AS x, o_orderkey << 2 AS l, o_orderkey >> 1 AS r, ~o_orderkey AS n FROM orders")
def bitwise(t):
    k = c("o_orderkey")
    lit = lambda v: F.lit(v).cast("long")
    return t.orders.select(k, numbers.bit_and(k, lit(12)).alias("a"), numbers.bit_or(k, lit(5)).alias("o"), numbers.bit_xor(k, lit(9)).alias("x"), F.shiftleft(k, 2).alias("l"), F.shiftright(k, 1).alias("r"), F.bitwise_not(k).alias("n"))


@Q.add(
    "decimal_ops",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS DECIMAL(9,2)) + CAST(l_tax AS DECIMAL(9,3)) AS DOUBLE) AS s,
              CAST(CAST(l_quantity AS DECIMAL(9,2)) * CAST(l_tax AS DECIMAL(9,2)) AS DOUBLE) AS p FROM lineitem""",
)
def decimal_ops(t):
    q, x = c("l_quantity").cast("decimal(9,2)"), c("l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", (q + x.cast("decimal(9,3)")).cast("double").alias("s"), numbers.dec_mul(q, x.cast("decimal(9,2)"), 2, 2).cast("double").alias("p"))


@Q.add("decimal_div", "SELECT p_partkey, round(CAST(p_size AS DOUBLE) / 8, 2) AS q FROM part")
def decimal_div(t):
    return t.part.select("p_partkey", numbers.dec_div(c("p_size").cast("decimal(9,2)"), F.lit(8).cast("decimal(9,2)"), 2).cast("double").alias("q"))


@Q.add("str_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def str_length(t):
    return t.documents.select("doc_id", strings.size(c("text")).alias("chars"), strings.octet_length(c("text")).alias("bytes"))


@Q.add("str_concat", "SELECT c_custkey, concat(c_name, nullif(c_mktsegment, 'BUILDING'), '!') AS skipped, c_name || nullif(c_mktsegment, 'BUILDING') AS joined FROM customer")
def str_concat(t):
    s = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return t.customer.select("c_custkey", strings.concat(c("c_name"), s, F.lit("!")).alias("skipped"), strings.joined(c("c_name"), s).alias("joined"))


@Q.add("str_case", "SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up FROM part")
def str_case(t):
    return t.part.select("p_partkey", strings.lower(c("p_name")).alias("lo"), strings.upper(c("p_name")).alias("up"))


@Q.add("str_case_ascii", "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lo FROM documents")
def str_case_ascii(t):
    return t.documents.select("doc_id", strings.lower(c("text")).alias("lo"))


@Q.add("str_substr", "SELECT p_partkey, substr(p_name, 2, 3) AS mid, substr(p_name, 4) AS tail FROM part WHERE length(p_name) >= 4")
def str_substr(t):
    return t.part.where("length(p_name) >= 4").select("p_partkey", strings.substr(c("p_name"), 2, 3).alias("mid"), strings.substr(c("p_name"), 4).alias("tail"))


@Q.add("str_strpos", "SELECT p_partkey, CAST(strpos(p_name, 'a') AS BIGINT) AS at, CAST(0 AS BIGINT) AS none FROM part")
def str_strpos(t):
    return t.part.select("p_partkey", strings.strpos(c("p_name"), "a").alias("at"), strings.strpos(c("p_name"), "").alias("none"))


@Q.add("str_replace", "SELECT p_partkey, replace(p_type, 'E', 'e3') AS x FROM part")
def str_replace(t):
    return t.part.select("p_partkey", strings.replace(c("p_type"), "E", "e3").alias("x"))


@Q.add("str_trim", "SELECT s_suppkey, trim(x, ' ' || chr(9) || chr(10)) AS b, ltrim(x, ' ' || chr(9)) AS l, rtrim(x, ' ' || chr(10)) AS r, trim(s_name, 'S#0') AS own FROM (SELECT *, chr(9) || ' ' || s_name || ' ' || chr(10) AS x FROM supplier)")
def str_trim(t):
    x = F.concat(F.lit("\t "), c("s_name"), F.lit(" \n"))
    return t.supplier.select("s_suppkey", strings.trim(x).alias("b"), strings.ltrim(x).alias("l"), strings.rtrim(x).alias("r"), strings.trim(c("s_name"), "S#0").alias("own"))


@Q.add("regexp_like", "SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS hit FROM documents")
def regexp_like(t):
    return t.documents.select("doc_id", strings.regexp_like(c("text"), "[0-9]{3}").alias("hit"))


@Q.add("regexp_substr", "SELECT doc_id, nullif(regexp_extract(text, '[a-z]+ing'), '') AS word FROM documents")
def regexp_substr(t):
    return t.documents.select("doc_id", strings.regexp_substr(c("text"), "[a-z]+ing").alias("word"))


@Q.add("regexp_match", "SELECT page_id, regexp_extract(url, '^(https?)://([a-z.]+)/', 1) AS scheme, regexp_extract(url, '^(https?)://([a-z.]+)/', 2) AS host FROM pages WHERE regexp_matches(url, '^(https?)://([a-z.]+)/')")
def regexp_match(t):
    m = strings.regexp_match(c("url"), "^(https?)://([a-z.]+)/", 2)
    return t.pages.select("page_id", m.alias("m")).where("m IS NOT NULL").select("page_id", c("m")[1].alias("scheme"), c("m")[2].alias("host"))


@Q.add("regexp_replace", r"SELECT page_id, regexp_replace(url, '([a-z]+)\.example', '\1.test', 'g') AS x FROM pages")
def regexp_replace(t):
    return t.pages.select("page_id", strings.regexp_replace(c("url"), r"([a-z]+)\.example", "$1.test").alias("x"))


@Q.add(
    "math_basic",
    """SELECT event_id, abs(user_id - 70) AS a, abs(value - 50) AS f, CAST(round(value) AS BIGINT) AS r, CAST(sign(value - 50) AS BIGINT) AS s, ceil(value) AS c, floor(value) AS fl,
              trunc(value - 50) + 0.0 AS t, user_id % 7 AS m, round(fmod(value, 3.5), 6) + 0.0 AS fm, CAST(pow(user_id % 10, 3) AS BIGINT) AS p, round(pow(value, 0.5), 6) AS fp, round(sqrt(value), 6) AS sq FROM events""",
)
def math_basic(t):
    v, u = c("value"), c("user_id")
    return t.events.select(
        "event_id", F.abs(u - 70).alias("a"), F.abs(v - 50).alias("f"), numbers.round_int(v).alias("r"), numbers.sign_int(v - 50).alias("s"), numbers.ceil_double(v).alias("c"),
        numbers.floor_double(v).alias("fl"), (numbers.trunc_double(v - 50) + 0.0).alias("t"), numbers.imod(u, F.lit(7)).alias("m"), r6(v % 3.5, "fm"),
        numbers.pow_int(u % 10, F.lit(3)).alias("p"), F.round(F.pow(v, 0.5), 6).alias("fp"), F.round(numbers.sqrt_strict(v), 6).alias("sq"),
    )


TRIG = ["acos", "asin", "atan", "cos", "sin", "tan", "sinh", "cosh", "tanh", "asinh", "atanh"]


@Q.add("math_trig", "SELECT event_id, " + ", ".join(f"round({f}(x), 6) + 0.0 AS {f}" for f in TRIG) + ", round(acosh(1 + x), 6) + 0.0 AS acosh, round(atan2(x, 0.5), 6) AS atan2, round(pi(), 6) AS pi FROM (SELECT event_id, (event_id % 99) / 100.0::DOUBLE AS x FROM events)")
def math_trig(t):
    x = (c("event_id") % 99) / 100.0
    return t.events.select("event_id", *[r6(getattr(F, f)(x), f) for f in TRIG], r6(F.acosh(x + 1), "acosh"), F.round(F.atan2(x, F.lit(0.5)), 6).alias("atan2"), F.round(F.pi(), 6).alias("pi"))


@Q.add("math_log", "SELECT event_id, round(ln(value + 1), 6) AS n, round(log10(value + 1), 6) AS l, round(log2(value + 1), 6) AS b, round(exp(value / 1000), 6) AS e FROM events")
def math_log(t):
    v = c("value") + 1
    return t.events.select("event_id", F.round(F.ln(v), 6).alias("n"), F.round(numbers.log(v), 6).alias("l"), F.round(F.log2(v), 6).alias("b"), F.round(F.exp(c("value") / 1000), 6).alias("e"))


@Q.add("greatest_least", "SELECT n_nationkey, greatest(n_nationkey, n_regionkey, nullif(7, n_nationkey)) AS g, least(n_nationkey, nullif(n_regionkey, 1), 3) AS l FROM nation")
def greatest_least(t):
    return t.nation.select("n_nationkey", F.greatest("n_nationkey", "n_regionkey", F.nullif(F.lit(7), c("n_nationkey"))).alias("g"), F.least(c("n_nationkey"), F.nullif("n_regionkey", F.lit(1)), F.lit(3)).alias("l"))


@Q.add("coalesce_nullif", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), nullif(n_nationkey, 5), -1) AS x FROM nation")
def coalesce_nullif(t):
    return t.nation.select("n_nationkey", misc.coalesce(misc.nullif(c("n_regionkey"), F.lit(1)), misc.nullif(c("n_nationkey"), F.lit(5)), F.lit(-1)).alias("x"))


@Q.add("hash_md5_sha1", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s FROM customer")
def hash_md5_sha1(t):
    return t.customer.select("c_custkey", misc.md5(c("c_name")).alias("m"), misc.sha1(c("c_name")).alias("s"))


@Q.add("base64_roundtrip", "SELECT c_custkey, to_base64(encode(c_name)) AS e, rtrim(translate(to_base64(encode(c_name || '?>~')), '+/', '-_'), '=') AS u, c_name AS d, c_name || '?>~' AS du FROM customer")
def base64_roundtrip(t):
    s = c("c_name")
    x = F.concat(s, F.lit("?>~"))
    return t.customer.select("c_custkey", misc.encode(s).alias("e"), misc.encode(x, "base64url").alias("u"), misc.decode(misc.encode(s)).alias("d"), misc.decode(misc.encode(x, "base64url"), "base64url").alias("du"))


@Q.add("jwt")
def jwt(t):
    """Signed tokens; SQL has no HMAC, so a test compares with the standard library."""
    return t.customer.select("c_custkey", misc.jwt(F.lit('{"alg":"HS256","typ":"JWT"}'), F.to_json(F.struct("c_custkey")), F.lit("secret")).alias("token"))


@Q.add(
    "cast_matrix",
    """SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS ts_int, value > 0 AS b, CAST(trunc(value) AS BIGINT) AS i, CAST(CAST(value AS DECIMAL(15,2)) AS DOUBLE) AS dc,
              CAST(user_id AS VARCHAR) AS s, make_timestamp(epoch_us(ts)) AS back, CAST(CAST(ts AS DATE) - DATE '1970-01-01' + 2440588 AS BIGINT) AS julian FROM events""",
)
def cast_matrix(t):
    return t.events.select(
        "event_id", casts.to_int(c("ts"), "timestamp").alias("ts_int"), casts.to_bool(c("value"), "double").alias("b"), casts.to_int(c("value"), "double").alias("i"),
        casts.to_decimal(c("value")).cast("double").alias("dc"), casts.to_string(c("user_id")).alias("s"),
        casts.to_timestamp(casts.to_int(c("ts"), "timestamp"), "int").cast("timestamp_ntz").alias("back"), casts.to_int(c("ts").cast("date"), "date").alias("julian"),
    )


@Q.add("type_names", "SELECT 'int' AS a, 'double' AS b, 'string' AS c, 'timestamp' AS d, 'null' AS e, 'decimal' AS f, 'date' AS g, 'json' AS h")
def type_names(t):
    made = [c("user_id"), c("value"), c("event_type"), c("ts"), F.lit(None).cast("int"), F.lit(1.5).cast("decimal(5,2)"), c("ts").cast("date"), F.parse_json("props")]
    return t.events.select(*[casts.type_of(x).alias(k) for x, k in zip(made, "abcdefgh")]).distinct()


@Q.add("date_bin", "SELECT event_id, time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '2001-01-01') AS q, time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '2001-01-01') AS w FROM events")
def date_bin(t):
    return t.events.select("event_id", temporal.date_bin("15 minutes", c("ts")).cast("timestamp_ntz").alias("q"), temporal.date_bin("1 week", c("ts")).cast("timestamp_ntz").alias("w"))


FIELDS = ["year", "month", "day", "hour", "minute", "second"]


@Q.add("date_trunc", "SELECT event_id, " + ", ".join(f"CAST(date_trunc('{f}', ts) AS TIMESTAMP) AS t_{f}" for f in FIELDS) + " FROM events")
def date_trunc(t):
    return t.events.select("event_id", *[temporal.date_trunc(f, c("ts")).cast("timestamp_ntz").alias(f"t_{f}") for f in FIELDS])


@Q.add("extract_fields", "SELECT event_id, " + ", ".join(f"CAST(extract({f} FROM ts) AS BIGINT) AS e_{f}" for f in FIELDS) + ", CAST((epoch_us(ts) % 1000000) // 1000 AS BIGINT) AS e_ms, CAST(epoch_us(ts) % 1000000 AS BIGINT) AS e_us FROM events")
def extract_fields(t):
    return t.events.select("event_id", *[temporal.extract(f, c("ts")).alias(f"e_{f}") for f in FIELDS], temporal.extract("millisecond", c("ts")).alias("e_ms"), temporal.extract("microsecond", c("ts")).alias("e_us"))


@Q.add("date_arith", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS days FROM orders")
def date_arith(t):
    d = c("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.date_add(d, 10).alias("later"), temporal.date_diff(d, F.lit("1995-01-01").cast("date")).alias("days"))


@Q.add(
    "interval_add_mktime",
    """SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS TIMESTAMP) + to_days(CAST(day(o_orderdate) AS INTEGER) - 1 + 2)
              + (o_orderdate - date_trunc('day', o_orderdate)) + INTERVAL 3 HOUR AS x FROM orders""",
)
def interval_add_mktime(t):
    return t.orders.select("o_orderkey", temporal.add_interval(c("o_orderdate"), temporal.interval("1 month 2 days 3 hours")).cast("timestamp_ntz").alias("x"))


@Q.add("interval_diff", "SELECT l_orderkey, l_linenumber, CAST(epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1996-02-29 12:00:00') AS BIGINT) AS us FROM lineitem")
def interval_diff(t):
    d = temporal.ts_diff(c("l_shipdate"), F.lit("1996-02-29 12:00:00").cast("timestamp"))
    return t.lineitem.select("l_orderkey", "l_linenumber", d["us"].alias("us"))


@Q.add(
    "interval_fields",
    """SELECT event_id, CAST(user_id // 12 AS BIGINT) AS y, CAST(user_id % 12 AS BIGINT) AS m, CAST(event_id % 40 AS BIGINT) AS d, CAST(event_id % 100 AS BIGINT) AS h, CAST(user_id // 12 * 12 AS INTEGER) AS ym,
              CAST(event_id % 100 * 3600000000 AS BIGINT) AS hus FROM events""",
)
def interval_fields(t):
    """Intervals read from a column of texts."""
    said = F.concat(c("user_id"), F.lit(" months "), c("event_id") % 40, F.lit(" days "), c("event_id") % 100, F.lit(" hours 5 minutes"))
    iv = temporal.interval(said)
    e, cut = temporal.extract_interval, temporal.interval_trunc
    rows = t.events.select("event_id", iv.alias("iv"))
    iv = c("iv")
    return rows.select("event_id", e("year", iv).alias("y"), e("month", iv).alias("m"), e("day", iv).alias("d"), e("hour", iv).alias("h"), cut("year", iv)["m"].alias("ym"), cut("hour", iv)["us"].alias("hus"))


@Q.add(
    "cast_more",
    """SELECT event_id, json_extract_string(props, '$.k') AS js, CAST(user_id AS VARCHAR) AS num, event_type AS word, CAST(ts AS DATE) AS day, CAST(event_id + 2440588 - 2440588 AS BIGINT) AS julian,
              lower('0000AAAA-0000-0000-0000-' || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS id, CAST(CAST(user_id AS FLOAT) AS DOUBLE) AS v0 FROM events""",
)
def cast_more(t):
    """JSON, dates, vectors and identifiers from values of other types, and back."""
    number, text = casts.to_json(c("user_id")), casts.to_json(c("event_type"))
    made = F.concat(F.lit("0000AAAA-0000-0000-0000-"), F.lpad(c("event_id").cast("string"), 12, "0"))
    vector = casts.to_vector(F.concat(F.lit("["), c("user_id"), F.lit(", 0.5]")))
    return t.events.select(
        "event_id", casts.to_string(F.variant_get(casts.json_decode(c("props")), "$.k", "variant"), "json").alias("js"), casts.to_string(number, "json").alias("num"), casts.to_string(text, "json").alias("word"),
        casts.to_date(c("ts")).alias("day"), casts.to_int(casts.to_date(c("event_id") + 2440588, "int"), "date").alias("j"), casts.to_uuid(made).alias("id"), vector[0].cast("double").alias("v0"),
    ).withColumn("julian", c("j") - 2440588).drop("j")


@Q.add("error_guard", "SELECT o_orderkey, o_totalprice AS kept FROM orders")
def error_guard(t):
    """A branch that raises is not taken where its condition does not hold."""
    bad = F.when(c("o_totalprice") < 0, misc.error("negative price").cast("double"))
    return t.orders.select("o_orderkey", F.when(c("o_totalprice") < 0, bad).otherwise(c("o_totalprice")).alias("kept"))


@Q.add("random_values", "SELECT count(*) AS n, true AS in_range, true AS wellformed, true AS spread FROM orders")
def random_values(t):
    """Random integers are zero or more, random identifiers are of version 4, and hardly any repeat."""
    made = t.orders.select(numbers.random_int().alias("x"), misc.random_uuid().alias("u"))
    good = c("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return made.agg(F.count("*").alias("n"), F.bool_and(c("x") >= 0).alias("in_range"), F.bool_and(good).alias("wellformed"), (F.approx_count_distinct("u") > F.count("*") / 2).alias("spread"))


@Q.add("at_timezone", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS tokyo FROM events")
def at_timezone(t):
    return t.events.select("event_id", temporal.at_timezone(c("ts"), "Asia/Tokyo").alias("tokyo"))
