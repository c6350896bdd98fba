import random

import pytest
from pyspark.sql import functions as F

from zephyrine.functions.logic import _COMPARE
from zephyrine.operators import folds, relational
from zephyrine.operators.matching import matching
from zephyrine.sources import ingest, sinks


def test_using_join_keeps_both(spark):
    a = spark.createDataFrame([(1, "a")], "k int, x string")
    assert relational.using_join(a, a.select("k", F.col("x").alias("y")), "k").columns == ["k", "x", "k_right", "y"]


def quantified(x, op, values, every):
    test = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    if not values:
        return every
    if x is None:
        return None
    told = [test(x, v) for v in values if v is not None]
    if (not every) in told:
        return not every
    return None if None in values else every


@pytest.mark.parametrize("values", [[], [None], [3], [3, 3], [1, 3, 5], [3, None], [1, 5, None]])
@pytest.mark.parametrize("op", list(_COMPARE))
def test_quantified_subqueries(spark, op, values):
    left = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 3), (4, 4), (5, 9)], "id int, x int")
    right = spark.createDataFrame([(v,) for v in values], "v int")
    for every, f in ((False, relational.any_subquery), (True, relational.all_subquery)):
        got = {r.x: r.t for r in f(left, "x", op, right, "v", "t").collect()}
        assert got == {x: quantified(x, op, values, every) for x in (None, 0, 1, 3, 4, 9)}


@pytest.mark.parametrize("op", ["=", "<>", ">"])
def test_quantified_correlated(spark, op):
    left = spark.createDataFrame([(k, x) for k in (1, 2, 3) for x in (None, 1, 2)], "k int, x int")
    held = {1: [1, None], 2: [1, 2]}
    right = spark.createDataFrame([(k, v) for k, own in held.items() for v in own], "k int, v int")
    for every, f in ((False, relational.any_subquery), (True, relational.all_subquery)):
        got = {(r.k, r.x): r.t for r in f(left, "x", op, right, "v", "t", ["k"]).collect()}
        assert got == {(k, x): quantified(x, op, held.get(k, []), every) for k in (1, 2, 3) for x in (None, 1, 2)}


def test_range_join(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(-20, 20)) for i in range(200)]
    spans = [(j, b, b + rng.choice([0, 0.5, 7, 30])) for j, b in enumerate(rng.uniform(-25, 20) for _ in range(40))]
    got = relational.range_join(spark.createDataFrame(points, "i int, p double"), spark.createDataFrame(spans, "j int, b double, e double"), "p", "b", "e", 3.0)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, p in points for j, b, e in spans if b <= p < e)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_distinct_on(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (None, 2, "c"), (None, 1, None), (2, None, "d")], "k int, o int, v string")
    got = {r.k: (r.o, r.v) for r in relational.distinct_on(df, ["k"], ["o"]).collect()}
    assert got == {1: (3, "b"), None: (1, None), 2: (None, "d")}


def test_fold_in_order(spark):
    rows = [(i % 3, i, chr(97 + i % 26)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, at long, s string").repartition(5)
    want = {k: "".join(s for kk, _, s in rows if kk == k) for k in range(3)}
    join = lambda a, x: F.concat(a, x)
    for combine, width in ((None, 1), (join, 7), (join, 1000)):
        got = folds.lambda_fold(df, ["k"], F.col("s"), F.lit(""), join, "at", combine=combine, width=width)
        assert {r.k: r.fold for r in got.collect()} == want


def test_fold_null_state_is_seed(spark):
    df = spark.createDataFrame([(1, None), (2, 4), (3, 5)], "at long, x long")
    got = folds.lambda_fold(df, [], F.col("x"), F.lit(10).cast("long"), lambda a, x: a + x, "at").first()
    assert got.fold == 19


def test_matching(spark):
    df = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.9, 0.2]), (3, [0.2, 0.9]), (4, [0.5, 0.5]), (5, None)], "id int, v array<float>")
    got = matching(df, "v", [1.1, 0.05], 2, "id")
    assert [r.id for r in got.collect()] == [1, 2] and got.columns == ["id", "v"]
    assert matching(df, "v", [1.0, 0.0], 10, "id").count() == 4
    with pytest.raises(ValueError):
        matching(df, "v", [1.0, 0.0], 0, "id")


def test_top_k_each(spark):
    df = spark.createDataFrame([(k, v) for k in "ab" for v in range(5)], "k string, v int")
    got = relational.top_k_each(df, ["k"], [F.desc("v")], 2)
    assert sorted(map(tuple, got.collect())) == [("a", 3), ("a", 4), ("b", 3), ("b", 4)]


def test_json_ingest(spark):
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("id long, data string, n long")
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    got = ingest.rows(lines('{"id": 1, "data": "x"}', '{"n": null, "id": 2}'), "line", schema, {"n": F.lit(5)})
    assert sorted(map(tuple, got.collect())) == [(1, "x", 5), (2, None, None)]
    for bad in ('{"id": 1, "other": 2}', "[1]", '{"id": 1, "id": 2}'):
        with pytest.raises(Exception):
            ingest.rows(lines(bad), "line", schema).collect()
    assert ingest.parse_rows('[{"a": 1}, {}]') == [{"a": 1}, {}] and ingest.parse_rows('{"a": 1}') == [{"a": 1}]
    for bad in ('{"a": 1, "a": 2}', "[1]"):
        with pytest.raises(ValueError):
            ingest.parse_rows(bad)


def test_sinks(spark):
    df = spark.createDataFrame([(1, 'a"b', None)], "x int, s string, n int")
    assert "".join(sinks.json_text(df)) == '[[1, "a\\"b", null]]'
    assert sinks.text_table(df).split("\n") == ["x | s   | n", "--+-----+-----", '1 | a"b | null']
    assert sinks.envelope(3, "[1]") == '{"jsonrpc": "2.0", "id": 3, "result": [1]}'
    assert '"message": "no"' in sinks.envelope(3, error="no")
