import decimal

import pytest

from zephyrine.plans import procedures
from zephyrine.plans.dialect import Engine
from zephyrine.plans.lexer import tokens


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("test", spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 1), (4, 3)], "id int, data int"))
    e.register("products", spark.createDataFrame([(1, [3.0, -4.0]), (2, [2.5, 0.5]), (3, [-1.0, 6.0])], "id int, v array<float>"))
    return e


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("select 7 / 2 as x", [(3,)]),
        ("select -7 / 2 as x", [(-3,)]),
        ("select 7 / 2.0e0 as x", [(3.5,)]),
        ("select 'abc'::upper() as x", [("ABC",)]),
        ("select 'abc'::substr(2)::length as x", [(2,)]),
        ("select '12'::int + 1 as x", [(13,)]),
        ("select concat('a', null, 'b') as x", [("ab",)]),
        ("select 2k as x", [(2048,)]),
        ("select log(1000) as x", [(3.0,)]),
        ("select strpos('abc', '') as x", [(0,)]),
        ("select [1, 2]::append(3) as x", [([1, 2, 3],)]),
        ('select {"a": 1, "b": "x"} as x', [('{"a":1,"b":"x"}',)]),
        ("select timestamp '2024-01-01 00:00:00' at timezone 'Asia/Tokyo' as x", [("2024-01-01 09:00:00.000000",)]),
        ("select count(*) as x from test where id / 2 = 1", [(2,)]),
        ("select id from test where data in (2, 3) order by id", [(2,), (4,)]),
        ("select t.id + 1 as x from test as t where t.id = 4", [(5,)]),
        ("with a as (select data, count(*) as n from test group by data) select max(n) as x from a", [(2,)]),
        ("select count(*) as x from test where data = any (select id from test where id > 1)", [(2,)]),
        ("select count(*) as x from test where id <> all (select data from test)", [(1,)]),
        ("select 3 > any (select id from test) as a, 0 > any (select id from test) as b, 9 > all (select id from test) as c, 1 = all (select id from test) as d", [(True, False, True, False)]),
        ("select 3 < all (select nullif(id, 2) from test where id > 1) as a, 5 > all (select nullif(id, 2) from test) as b, 1 < any (select id from test where id > 9) as c", [(False, None, False)]),
        ("select 2 = any ([1, 2]) as a, 5 <> all ([1, 2]) as b, 0 > any ([1, 2]) as c", [(True, True, False)]),
        ("select sum(it) as x from ([4, 9, 4, 25]) it where it > 4", [(34,)]),
        ("select distinct it from ([8, 3, 8]) as it order by it", [(3,), (8,)]),
        ("select exists (select 1 from test where id = 3) as x", [(True,)]),
        ("select (select max(id) from test t where t.data = o.data) as x from test as o where o.id = 1", [(3,)]),
        ("select a.id, b.id as other from test a join test b on a.data = b.id where a.id <> b.id", [(3, 1), (4, 3)]),
    ],
)
def test_statements(engine, text, want):
    assert values(engine.sql(text)) == want


def test_lambda(engine):
    assert values(engine.sql("select 0 -> self + id as x, 1 -> self * 2 as y from test", order="id")) == [(10, 32)]
    assert values(engine.sql("select '' -> self || id::string as x from test", order="id")) == [("01234",)]
    got = engine.sql("select data, 0 -> self + 1 as n from test group by data", order="id")
    assert sorted(values(got)) == [(0, 1), (1, 2), (2, 1), (3, 1)]
    with pytest.raises(ValueError):
        engine.sql("select 0 -> self + 1 from test")


def test_matching(engine):
    assert values(engine.sql("select id from products matching v to vector [2.0, -1.5] top 2")) == [(1,), (2,)]
    for bad in ("select id from products matching v to 123", "select id from products matching v to vector [1.0, 1.0]"):
        with pytest.raises((ValueError, IndexError)):
            engine.sql(bad)


def test_distinct_on(engine):
    assert sorted(values(engine.sql("select distinct on (data) data, id from test"))) == [(0, 0), (1, 1), (2, 2), (3, 4)]


def test_explain(engine):
    assert "Physical Plan" in "\n".join(r.plan for r in engine.sql("explain select id from test").collect())


def test_tokens():
    assert tokens("a::b('x\\'y') -- end\n<> 1.5e3 10kb") == [("w", "a"), ("o", "::"), ("w", "b"), ("o", "("), ("s", "'x\\'y'"), ("o", ")"), ("o", "<>"), ("n", "1.5e3"), ("n", "10kb")]
    with pytest.raises(ValueError):
        Engine(None).sql("  ")


def test_profile(engine):
    said = [r.plan for r in engine.sql("explain (profile) select id from test where id > 1").collect()]
    assert said[0] == "rows: 3" and said[1].startswith("seconds: ")


@pytest.mark.parametrize("text", ["select 1 +", "select (1", "select 1 is 2", "select case 1 when 1 then 2", "select 1 2", "select id from", "select 1 between 0", "select x at 1", "foo"])
def test_refused(engine, text):
    with pytest.raises(Exception):
        engine.sql(text).collect()


def test_kinds(engine):
    one = lambda text: engine.sql(f"select {text} as x").first().x
    assert one("7 * 3 / 2") == 10 and one("(3 + 4) / 2") == 3 and one("10 - 4 - 3") == 3 and one("2 + 3 * 4 % 5") == 4
    assert one("7 / 2.0") == decimal.Decimal("3.5") and one("1.25 * 1.5") == decimal.Decimal("1.875") and one("10.00 / 3") == decimal.Decimal("3.33")
    assert one("not 0") is True and one("not 'a'") is False and one("false and null") is None and one("false or null") is False
    assert one("1 + 1 = any ([2])") is True and one("1 = all ([1, null])") is None
    assert one("""{"a": [1, {"b": "x"}]}.a[1].b::string""") == "x"
    assert one("json_decode('[1, [2, 3]]')[1][0]::int") == 2
    assert one("vector [1, 2] + vector [3, 4]") == [4.0, 6.0]
    assert one("case when 0 then 1 when 2 then 5 end") == 5
    assert one("date '2024-03-01' - date '2024-02-28'") == 2


def test_procedures(spark):
    assert [procedures.literal(v) for v in (None, True, "a'b", 1.5)] == ["NULL", "TRUE", "'a\\'b'", "1.5"]
    procedures.scalar_function(spark, "zephyrine_twice", "x int", "int", "x * 2")
    assert spark.sql("SELECT zephyrine_twice(4) AS x").first().x == 8
