"""Queries in the dialect's own syntax, each with the SQL that it must agree with."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zephyrine.functions import jsons
from zephyrine.plans.dialect import Engine
from zephyrine.plans.statements import Database
from zephyrine.queries.registry import Registry, Tables
from zephyrine.session import shared_folder
from zephyrine.sources import files, layout, sinks

Q = Registry()
c = F.col


def query(name: str, tables: str, text: str, sql: str, order: str | None = None) -> None:
    """Register a query over some tables."""

    def run(t: Tables):
        e = Engine(t.spark)
        for n in tables.split():
            e.register(n, getattr(t, n))
        return e.sql(text, order=order)

    Q.add(name, sql)(run)


query(
    "dialect_precedence", "orders", "select o_orderkey, o_custkey * 3 / 2 as a, 7 + o_custkey * 2 - 1 as b, (3 + 4) / 2 as c, 7 * 3 / 2 as d, -o_orderkey % 7 as e, 100 - 10 - 5 as f, 2 + 3 < 3 * 2 as g from orders",
    "SELECT o_orderkey, o_custkey * 3 // 2 AS a, 7 + o_custkey * 2 - 1 AS b, CAST(3 AS BIGINT) AS c, CAST(10 AS BIGINT) AS d, -o_orderkey % 7 AS e, CAST(85 AS BIGINT) AS f, true AS g FROM orders",
)
query(
    "dialect_bits", "orders", "select o_orderkey, o_orderkey & 12 | 1 as a, o_orderkey ^ 5 & 3 as b, o_orderkey << 1 + 1 as l, o_orderkey >> 1 as r, ~o_orderkey as n from orders",
    "SELECT o_orderkey, (o_orderkey & 12) | 1 AS a, xor(o_orderkey, 5 & 3) AS b, o_orderkey << 2 AS l, o_orderkey >> 1 AS r, ~o_orderkey AS n FROM orders",
)
query(
    "dialect_and_or_null", "nation", "select n_nationkey, n_nationkey > 10 and nullif(n_regionkey, 1) > 1 as a, n_nationkey > 10 or nullif(n_regionkey, 1) > 1 as o, false and null as f, false or null as g from nation",
    """SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_nationkey > 10 AND n_regionkey > 1 END AS a,
              n_nationkey > 10 OR coalesce(nullif(n_regionkey, 1) > 1, false) AS o, CAST(NULL AS BOOLEAN) AS f, false AS g FROM nation""",
)
query("dialect_truth_where", "orders", "select o_orderkey from orders where o_custkey - 500", "SELECT o_orderkey FROM orders WHERE o_custkey > 500")
query(
    "dialect_truth_values", "nation", "select n_nationkey, not n_regionkey as z, n_regionkey and n_name as b, case when n_name::substr(90) then 1 else 0 end::int as e from nation",
    "SELECT n_nationkey, NOT (n_regionkey > 0) AS z, n_regionkey > 0 AND length(n_name) > 0 AS b, CAST(0 AS BIGINT) AS e FROM nation",
)
query(
    "dialect_avg_kinds", "orders", "select o_orderstatus, avg(o_custkey) as a, sum(o_custkey) / 4 as s, avg(distinct o_custkey % 7) as m, round(avg(o_totalprice::double) * 100) as d from orders group by o_orderstatus",
    """SELECT o_orderstatus, CAST(sum(o_custkey) // count(*) AS BIGINT) AS a, CAST(sum(o_custkey) // 4 AS BIGINT) AS s,
              CAST(sum(DISTINCT o_custkey % 7) // count(DISTINCT o_custkey % 7) AS BIGINT) AS m, CAST(round(avg(o_totalprice) * 100) AS BIGINT) AS d FROM orders GROUP BY 1""",
)
query(
    "dialect_having", "orders", "select o_custkey, count(*) as n, max(o_orderkey) / 2 as m from orders group by o_custkey having count(*) > 3 and max(o_orderkey) - 10 order by n desc, o_custkey limit 20",
    "SELECT o_custkey, count(*) AS n, max(o_orderkey) // 2 AS m FROM orders GROUP BY 1 HAVING count(*) > 3 AND max(o_orderkey) > 10 ORDER BY n DESC, 1 LIMIT 20",
)
query(
    "dialect_lambda_having", "orders", "select o_orderstatus, 0 -> self + o_custkey as total, count(*) as n, avg(o_custkey) as a from orders group by o_orderstatus having count(*) > 10 order by o_orderstatus limit 2",
    "SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS total, count(*) AS n, CAST(sum(o_custkey) // count(*) AS BIGINT) AS a FROM orders GROUP BY 1 HAVING count(*) > 10 ORDER BY 1 LIMIT 2",
    order="o_orderkey",
)
query(
    "dialect_lambda_any_step", "nation", "select n_regionkey, 1 -> self * 2 + n_nationkey % 2 as x from nation group by n_regionkey",
    """SELECT n_regionkey, CAST(pow(2, count(*)) + sum((n_nationkey % 2) * pow(2, later)) AS BIGINT) AS x
       FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) - 1 AS later FROM nation) GROUP BY 1""",
    order="n_nationkey",
)
query(
    "dialect_lambda_null", "nation", "select n_regionkey, 5 -> self + nullif(n_nationkey, 7) as x from nation group by n_regionkey",
    """SELECT n_regionkey, CAST(CASE WHEN max(reset) = max(n_nationkey) THEN NULL ELSE 5 + coalesce(sum(CASE WHEN reset IS NULL OR n_nationkey > reset THEN n_nationkey END), 0) END AS BIGINT) AS x
       FROM (SELECT *, max(CASE WHEN n_nationkey = 7 THEN 7 END) OVER (PARTITION BY n_regionkey) AS reset FROM nation) GROUP BY 1""",
    order="n_nationkey",
)
query(
    "dialect_distinct_on_order", "customer", "select distinct on (c_nationkey) c_nationkey, c_custkey from customer order by c_nationkey desc limit 5",
    "SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1 ORDER BY 1 DESC LIMIT 5",
)
query(
    "dialect_any_of_sum", "orders customer", "select o_orderkey from orders where o_custkey + 1 = any (select c_custkey from customer where c_acctbal < 0) and 1 + 1 = any ([2, 3])",
    "SELECT o_orderkey FROM orders WHERE o_custkey + 1 IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
query(
    "dialect_all_of_sum", "orders", "select o_orderkey from orders where o_totalprice * 2 >= all (select o_totalprice + 100000 from orders) and 3 * 2 > all ([1, 5])",
    "SELECT o_orderkey FROM orders WHERE o_totalprice * 2 >= (SELECT max(o_totalprice) + 100000 FROM orders)",
)
query(
    "dialect_json_path", "events", """select event_id, props.k::int as k, props['k']::int + 1 as n, {"a": {"b": event_id}}.a.b as b, props.none is null as z from events where props.k > 50""",
    "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(props->>'$.k' AS BIGINT) + 1 AS n, event_id AS b, true AS z FROM events WHERE CAST(props->>'$.k' AS BIGINT) > 50",
)
query(
    "dialect_json_object", "nation", """select n_nationkey, {"id": n_nationkey, "in": {"name": n_name, "r": [n_regionkey, 1]}, "none": null} as j from nation""",
    """SELECT n_nationkey, '{"id":' || n_nationkey || ',"in":{"name":"' || n_name || '","r":[' || n_regionkey || ',1]},"none":null}' AS j FROM nation""",
)
query(
    "dialect_case_mapping", "part", "select p_partkey, lower('ÀB' || p_name) as lo, p_name::substr(1, 2)::upper() || 'é' as up from part",
    "SELECT p_partkey, 'Àb' || translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lo, upper(substr(p_name, 1, 2)) || 'é' AS up FROM part",
)
query(
    "dialect_in", "nation", "select n_nationkey, n_regionkey in (1, 3) as a, n_regionkey in () as b, n_regionkey not in () as e, nullif(n_regionkey, 1) in (2, 3) as d, n_regionkey not in (0, 4) as f from nation",
    "SELECT n_nationkey, n_regionkey IN (1, 3) AS a, false AS b, true AS e, nullif(n_regionkey, 1) IN (2, 3) AS d, n_regionkey NOT IN (0, 4) AS f FROM nation",
)
query(
    "dialect_between_like", "part", "select p_partkey from part where p_size between 5 and 5 * 4 and p_type like '%E%' and p_size not between 9 and 10 and not p_brand like '%5'",
    "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_type LIKE '%E%' AND p_size NOT BETWEEN 9 AND 10 AND NOT p_brand LIKE '%5'",
)
query(
    "dialect_cte_columns", "orders", "with a (k, n) as (select o_custkey, count(*) from orders group by o_custkey), b as (select max(n) as top from a) select a.k, a.n / 2 as h from a, b where a.n = b.top",
    "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT k, n // 2 AS h FROM a WHERE n = (SELECT max(n) FROM a)",
)
query(
    "dialect_derived_join", "region nation", "select r.r_name, x.n / 2 as h from region r join (select n_regionkey as k, count(*) as n from nation group by n_regionkey) x on r.r_regionkey = x.k and x.n where x.n / 2 > 1",
    "SELECT r_name, count(*) // 2 AS h FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name HAVING count(*) // 2 > 1",
)
query(
    "dialect_nested_levels", "customer orders lineitem", "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > (select sum(l.l_extendedprice) * 2 from lineitem l where l.l_orderkey = o.o_orderkey))",
    "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > (SELECT sum(l.l_extendedprice) * 2 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey))",
)
query(
    "dialect_scalar_subquery", "nation customer", "select n_name, (select count(*) from customer where c_nationkey = n_nationkey) / 2 as h from nation",
    "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) // 2 AS h FROM nation",
)
query(
    "dialect_union", "nation region", "select n_regionkey as k from nation where n_nationkey < 3 union all select r_regionkey from region",
    "SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 3 UNION ALL SELECT r_regionkey FROM region",
)
query(
    "dialect_method_chain", "customer", "select c_custkey, c_name::substr(10)::int / 2 + 1 as x, c_mktsegment::length()::string || '-' || c_mktsegment::lower() as s from customer",
    "SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) // 2 + 1 AS x, length(c_mktsegment) || '-' || lower(c_mktsegment) AS s FROM customer",
)
query(
    "dialect_dates", "orders", "select o_orderkey, o_orderdate::date + 30 as later, o_orderdate::date - date '1995-01-01' as days, (o_orderdate::date - date '1995-01-01') / 7 as weeks from orders",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS days,
              CAST(trunc((CAST(o_orderdate AS DATE) - DATE '1995-01-01') / 7) AS BIGINT) AS weeks FROM orders""",
)
query(
    "dialect_decimal", "part", "select p_partkey, (p_retailprice::decimal(15, 2) / 3)::double as q, (p_size / 8.00)::double as k, (p_size::decimal(9, 2) * 1.5)::double as m from part",
    "SELECT p_partkey, round(CAST(p_retailprice AS DECIMAL(15,2)) / 3, 2) AS q, round(p_size / 8, 2) AS k, p_size * 1.5::DOUBLE AS m FROM part",
)
query(
    "dialect_order_expression", "orders", "select o_orderkey, o_custkey / 10 as g from orders order by o_custkey / 10 desc, o_orderkey limit 7 offset 3",
    "SELECT o_orderkey, o_custkey // 10 AS g FROM orders ORDER BY 2 DESC, 1 LIMIT 7 OFFSET 3",
)
query(
    "dialect_group_expression", "orders", "select o_custkey / 100 as g, count(*) as n from orders group by o_custkey / 100",
    "SELECT o_custkey // 100 AS g, count(*) AS n FROM orders GROUP BY 1",
)
query("dialect_array_source", "region", "select it * 2 / 3 as x from ([4, 9, 25]) it where it - 4", "SELECT CAST(unnest([6, 16]) AS BIGINT) AS x")
query(
    "dialect_timestamps", "events", "select event_id, ts + interval '2 hours' as later, ts at timezone 'Asia/Tokyo' as tokyo from events",
    "SELECT event_id, ts + INTERVAL 2 HOUR AS later, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS tokyo FROM events",
)
query("dialect_units", "region", "select r_regionkey, 2k as a, 3m + r_regionkey as b from region", "SELECT r_regionkey, 2048 AS a, 3145728 + CAST(r_regionkey AS BIGINT) AS b FROM region")
query(
    "dialect_statement_time", "region", "select r_regionkey, now() = current_timestamp() as same, current_date() <= now()::date as today, current_user() is not null as someone from region",
    "SELECT r_regionkey, true AS same, true AS today, true AS someone FROM region",
)
query(
    "dialect_window_of_kinds", "lineitem", "select l_returnflag, sum(l_quantity::int) / count(*) as q, max(l_linenumber) * 2 / 3 as m from lineitem where l_discount::double > 0.0e0 and l_quantity group by l_returnflag",
    "SELECT l_returnflag, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) // count(*) AS BIGINT) AS q, CAST(max(l_linenumber) * 2 // 3 AS BIGINT) AS m FROM lineitem WHERE l_discount > 0 AND l_quantity > 0 GROUP BY 1",
)


def database(t: Tables, *names: str) -> Database:
    """A new database with some of the tables, by their first columns as keys."""
    db = Database(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")
    for n in names:
        df = getattr(t, n)
        db.store.create_table(n, df.schema, [df.columns[0]])
        from zephyrine.operators.dml import insert

        db.store.commit(n, insert(db.store.table(n), df, [df.columns[0]]))
    return db


@Q.add("statement_forced_index", "SELECT n_name FROM nation WHERE n_nationkey BETWEEN 5 AND 9")
def statement_forced_index(t):
    db = database(t, "nation")
    return db.execute("create index by_key on nation (n_nationkey); select n_name from nation index by_key where n_nationkey between 5 and 9")


@Q.add("statement_with_changes", "SELECT CAST(sum(n_regionkey + 1) AS BIGINT) AS s, count(*) AS n FROM nation WHERE n_nationkey > 12")
def statement_with_changes(t):
    """A change as a part of WITH: what it returns is read."""
    return database(t, "nation").execute("with w as (update nation set n_regionkey = n_regionkey + 1 where n_nationkey > 12 returning n_regionkey) select sum(n_regionkey) as s, count(*) as n from w")


@Q.add("statement_block_into", "SELECT CAST(sum(CASE WHEN n_regionkey % 2 = 0 THEN n_nationkey ELSE 100 END) AS BIGINT) AS total, max(n_nationkey) AS top FROM nation")
def statement_block_into(t):
    """A block with variables, a loop over rows, a branch and SELECT INTO."""
    return database(t, "nation").execute(
        """begin
             declare total int := 0; declare top int;
             for r in (select n_nationkey, n_regionkey from nation order by n_nationkey) do
               if r.n_regionkey % 2 = 0 then total := total + r.n_nationkey; else total := total + 100; end if;
             end for;
             select max(n_nationkey) into top from nation;
             select total as total, top::int32 as top;
           end"""
    )


@Q.add("statement_unique_index", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'NEW' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 4")
def statement_unique_index(t):
    """A unique index: a change that repeats a value is refused, one that does not goes through."""
    db = database(t, "nation")
    db.execute("create unique index names on nation (n_name); delete from nation where n_nationkey = 4; update nation set n_name = 'NEW' where n_nationkey = 3")
    try:
        db.execute("update nation set n_name = 'NEW' where n_nationkey = 5")
    except ValueError:
        return db.execute("select n_nationkey, n_name from nation")
    raise AssertionError("a repeated value was not refused")


@Q.add("statement_table_function", "SELECT p_partkey, CAST(p_size * 2 + 1 AS BIGINT) AS x FROM part")
def statement_table_function(t):
    db = Database(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")
    db.execute("create or replace function plus_one_twice (x int) return int begin return x * 2 + 1; end")
    e = Engine(t.spark)
    e.register("part", t.part)
    return e.sql("select p_partkey, plus_one_twice(p_size) as x from part")


@Q.add("join_outer", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey UNION ALL SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey > 50) RIGHT JOIN orders ON c_custkey = o_custkey")
def join_outer(t):
    on = c("c_custkey") == c("o_custkey")
    left = t.customer.join(t.orders, on, "left").select("c_custkey", "o_orderkey")
    return left.unionAll(t.customer.where("c_custkey > 50").join(t.orders, on, "right").select("c_custkey", "o_orderkey"))


@Q.add("file_round_trip", "SELECT c_custkey, c_name, c_acctbal, 'csv' AS form FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal, 'json' FROM customer")
def file_round_trip(t):
    """Rows written as CSV and JSON files and read again by a schema."""
    top = f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal")
    rows.write.option("header", True).csv(f"{top}/csv")
    rows.write.json(f"{top}/json")
    csv = files.csv_rows(t.spark, f"{top}/csv", rows.schema).withColumn("form", F.lit("csv"))
    return csv.unionAll(files.json_rows(t.spark, f"{top}/json", rows.schema).withColumn("form", F.lit("json")))


@Q.add("bucketed_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def bucketed_lookup(t):
    """A hash index: a table in buckets of a column, of which a lookup reads one."""
    name = f"zephyrine_orders_{uuid.uuid4().hex}"
    return layout.bucketed(t.orders, name, ["o_custkey"], 8).where("o_custkey = 7").select("o_orderkey", "o_totalprice")


@Q.add("clustered_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
def clustered_range(t):
    """An ordered index: files that follow one another by a column, of which a range reads few."""
    path = f"{shared_folder(t.spark)}/clustered-{uuid.uuid4().hex}"
    return layout.clustered(t.orders, path, ["o_totalprice"], 8).where("o_totalprice BETWEEN 100000 AND 120000").select("o_orderkey", "o_totalprice")


@Q.add("hash_slots", "SELECT count(*) AS n, true AS together FROM customer")
def hash_slots(t):
    """Rows of one key are dealt to one slot."""
    slots = layout.hash_slots(t.customer.unionAll(t.customer), ["c_custkey"]).groupBy("c_custkey").agg(F.countDistinct("slot").alias("k"))
    return slots.agg(F.count("*").alias("n"), F.bool_and(c("k") == 1).alias("together"))


@Q.add(
    "text_table_lines",
    """SELECT line FROM (SELECT unnest([rtrim(rpad('r_regionkey', 11, ' ') || ' | ' || rpad('r_name', w, ' ')), repeat('-', 11) || '-+-' || repeat('-', w)]) AS line FROM (SELECT CAST(greatest(6, max(length(r_name))) AS INTEGER) AS w FROM region))
       UNION ALL SELECT rtrim(rpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || ' | ' || r_name) FROM region""",
)
def text_table_lines(t):
    return t.spark.createDataFrame([(x,) for x in sinks.text_table(t.region.orderBy("r_regionkey")).split("\n")], "line string")


@Q.add("envelopes", """SELECT '{"jsonrpc": "2.0", "id": ' || r_regionkey || ', "result": [' || r_regionkey || ', "' || r_name || '"]}' AS answer FROM region""")
def envelopes(t):
    rows = sinks.json_rows(t.region).collect()
    return t.spark.createDataFrame([(sinks.envelope(int(r.row[1 : r.row.index(",")]), r.row),) for r in rows], "answer string")


@Q.add(
    "json_array_mixed",
    """SELECT event_id, '[1,"a",' || props || ',' || user_id || ']' AS appended, '[' || user_id || ',1,"a",' || props || ']' AS pushed, '["a",' || props || ']' AS popped,
              '[1,"a"]' AS popped_back, '[1,' || user_id || ',' || props || ']' AS put, '[1,' || props || ']' AS removed FROM (SELECT event_id, user_id, replace(props, ' ', '') AS props FROM events)""",
)
def json_array_mixed(t):
    """Arrays of JSON values of several kinds."""
    array = jsons.values(F.concat(F.lit('[1, "a", '), c("props"), F.lit("]")))
    v = jsons.value(c("user_id"))
    kind = "array<variant>"
    made = {
        "appended": jsons.append(array, v), "pushed": jsons.push(array, v), "popped": jsons.pop(array), "popped_back": jsons.pop_back(array),
        "put": jsons.put(array, 1, v, kind), "removed": jsons.remove(array, 1, kind),
    }
    return t.events.select("event_id", *[F.to_json(x).alias(k) for k, x in made.items()])
