"""Scans, predicates, joins, aggregates, order, subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrine.functions import logic, numbers
from zephyrine.operators import folds, relational
from zephyrine.queries.registry import Registry, Tables

Q = Registry()
c = F.col
MONEY = "decimal(18,2)"


def money(x: str) -> F.Column:
    """Doubles summed as decimals, so that the order of rows does not matter."""
    return F.sum(c(x).cast(MONEY)).cast("double")


def n() -> F.Column:
    return F.count("*").alias("n")


@Q.add(
    "flagship",
    """SELECT o_orderpriority, c_mktsegment, CAST(count(*) AS BIGINT) AS n,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_discount > 0.02
       GROUP BY 1, 2""",
)
def flagship(t: Tables) -> DataFrame:
    lines = t.lineitem.where((c("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & (c("l_discount") > 0.02))
    out = lines.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey"))
    return out.groupBy("o_orderpriority", "c_mktsegment").agg(n(), money("l_extendedprice").alias("revenue")).orderBy("o_orderpriority", "c_mktsegment")


@Q.add(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
              CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price, CAST(count(*) AS BIGINT) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(t):
    lines = t.lineitem.where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_price"), n())


# scans and projection


@Q.add("scan_project", "SELECT n_nationkey, n_name FROM nation")
def scan_project(t):
    return t.nation.select("n_nationkey", "n_name")


@Q.add("star_alias", "SELECT n.*, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def star_alias(t):
    a, r = t.nation.alias("n"), t.region.alias("r")
    return a.join(r, c("n.n_regionkey") == c("r.r_regionkey")).select("n.*", c("r.r_name").alias("region"))


@Q.add("select_without_from", "SELECT CAST(1 AS BIGINT) AS one, 'x' AS s")
def select_without_from(t):
    return t.spark.range(1).select(F.lit(1).cast("long").alias("one"), F.lit("x").alias("s"))


@Q.add("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
def point_lookup(t):
    return t.orders.where(c("o_orderkey") == 77)


@Q.add("range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def range_scan(t):
    return t.orders.where((c("o_orderkey") >= 100) & (c("o_orderkey") < 900)).select("o_orderkey", "o_totalprice")


@Q.add("forced_index_scan", "SELECT p_partkey, p_size FROM part WHERE p_partkey > 20 AND p_partkey <= 60")
def forced_index_scan(t):
    # an index is named only as a hint: what prunes is the files' statistics
    return t.part.where((c("p_partkey") > 20) & (c("p_partkey") <= 60)).select("p_partkey", "p_size")


@Q.add("generate_rows", "SELECT CAST(range AS BIGINT) AS id, CAST(123 AS BIGINT) AS data FROM range(50)")
def generate_rows(t):
    return t.spark.range(50).select("id", F.lit(123).cast("long").alias("data"))


@Q.add("function_source", "SELECT CAST(5 AS BIGINT) AS x")
def function_source(t):
    """FROM (expression): one row, and none for NULL."""
    one = t.spark.range(1).select(F.lit(5).cast("long").alias("x"))
    none = t.spark.range(1).select(F.lit(None).cast("long").alias("x"))
    return one.unionByName(none).where(c("x").isNotNull())


# predicates


@Q.add("filter_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_returnflag <> 'N' AND l_discount < 0.05")
def filter_compare(t):
    return t.lineitem.where((c("l_quantity") >= 45) & (c("l_returnflag") != "N") & (c("l_discount") < 0.05)).select("l_orderkey", "l_linenumber")


@Q.add("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND NOT (l_discount BETWEEN 0.03 AND 0.06)")
def filter_between(t):
    return t.lineitem.where(c("l_quantity").between(10, 12) & ~c("l_discount").between(0.03, 0.06)).select("l_orderkey", "l_linenumber")


@Q.add("filter_in_list", "SELECT p_partkey FROM part WHERE p_size IN (3, 14, 15, 92) ")
def filter_in_list(t):
    return t.part.where(logic.in_list(c("p_size"), 3, 14, 15, 92)).select("p_partkey")


@Q.add("filter_in_empty", "SELECT p_partkey FROM part WHERE false")
def filter_in_empty(t):
    return t.part.where(logic.in_list(c("p_size"))).select("p_partkey")


@Q.add("filter_not_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def filter_not_in(t):
    return t.orders.where(~c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@Q.add("filter_in_null", "SELECT n_nationkey, (nullif(n_regionkey, 1) IN (2, 3)) AS hit, (n_regionkey IN (2, NULL)) AS open FROM nation")
def filter_in_null(t):
    return t.nation.select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).isin(2, 3).alias("hit"), c("n_regionkey").isin(2, None).alias("open"))


@Q.add("filter_like", "SELECT p_partkey, p_name LIKE '%a_e%' AS mid FROM part WHERE p_type LIKE '%S%' AND p_name NOT LIKE 'zz%'")
def filter_like(t):
    return t.part.where(c("p_type").like("%S%") & ~c("p_name").like("zz%")).select("p_partkey", c("p_name").like("%a_e%").alias("mid"))


@Q.add("filter_null", "SELECT n_nationkey FROM nation WHERE nullif(n_regionkey, 2) IS NULL OR nullif(n_nationkey, 3) IS NULL")
def filter_null(t):
    return t.nation.where(F.nullif("n_regionkey", F.lit(2)).isNull() | F.nullif("n_nationkey", F.lit(3)).isNull()).select("n_nationkey")


@Q.add("case_expr", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def case_expr(t):
    band = F.when(c("o_totalprice") > 300000, "high").when(c("o_totalprice") > 100000, "mid").otherwise("low")
    return t.orders.select("o_orderkey", band.alias("band"))


@Q.add("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def case_simple(t):
    return t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 2).alias("code"))


FLAGS = "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE n_regionkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM nation"


@Q.add(
    "logic_strict",
    f"""SELECT n_nationkey, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE a AND b END AS both,
               CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, false) OR coalesce(b, false) END AS either
        FROM ({FLAGS})""",
)
def logic_strict(t):
    flag = lambda x: F.when(x % 3 == 0, True).when(x % 3 == 1, False)
    a, b = flag(c("n_nationkey")), flag(c("n_regionkey"))
    return t.nation.select("n_nationkey", logic.strict_and(a, b).alias("both"), logic.strict_or(a, b).alias("either"))


@Q.add("truthiness", "SELECT event_id, value - 20 > 0 AS num, length(event_type) > 0 AS str FROM events")
def truthiness(t):
    return t.events.select("event_id", logic.truthy(c("value") - 20, "double").alias("num"), logic.truthy(c("event_type"), "string").alias("str"))


@Q.add("any_array", "SELECT p_partkey, p_size = ANY([1, 7, 30]) AS eq, p_size > ANY([10, 40]) AS gt FROM part")
def any_array(t):
    few = lambda *v: F.array(*[F.lit(x) for x in v])
    return t.part.select("p_partkey", logic.any_of(c("p_size"), "=", few(1, 7, 30)).alias("eq"), logic.any_of(c("p_size"), ">", few(10, 40)).alias("gt"))


@Q.add("all_array", "SELECT p_partkey, (p_size <> 1 AND p_size <> 7) AS ne, (p_size > 10 AND p_size > 20) AS gt FROM part")
def all_array(t):
    few = lambda *v: F.array(*[F.lit(x) for x in v])
    return t.part.select("p_partkey", logic.all_of(c("p_size"), "<>", few(1, 7)).alias("ne"), logic.all_of(c("p_size"), ">", few(10, 20)).alias("gt"))


# joins


@Q.add("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def join_inner(t):
    return t.orders.join(t.customer.where("c_acctbal > 0"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@Q.add(
    "join_using",
    "SELECT a.k, b.k AS k_right, a.name, b.region FROM (SELECT n_regionkey AS k, n_name AS name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS region FROM region) b USING (k)",
)
def join_using(t):
    a = t.nation.select(c("n_regionkey").alias("k"), c("n_name").alias("name"))
    b = t.region.select(c("r_regionkey").alias("k"), c("r_name").alias("region"))
    return relational.using_join(a, b, "k").select("k", "k_right", "name", "region")


@Q.add("join_cross", "SELECT r_name, n_name FROM region, nation")
def join_cross(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@Q.add("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def join_theta(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (c("a.n_nationkey") < c("b.n_nationkey")) & (c("a.n_regionkey") != c("b.n_regionkey"))
    return a.join(b, on).select(c("a.n_nationkey").alias("x"), c("b.n_nationkey").alias("y"))


@Q.add(
    "join_range",
    """SELECT e.event_id, o.band FROM events e JOIN (SELECT s_suppkey AS band, s_suppkey * 7.5 AS lo, s_suppkey * 7.5 + 11 AS hi FROM supplier) o
       ON e.value >= o.lo AND e.value < o.hi""",
)
def join_range(t):
    bands = t.supplier.select(c("s_suppkey").alias("band"), (c("s_suppkey") * 7.5).alias("lo"), (c("s_suppkey") * 7.5 + 11).alias("hi"))
    return relational.range_join(t.events.select("event_id", "value"), bands, "value", "lo", "hi", 11.0).select("event_id", "band")


@Q.add("join_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(t):
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    on = (c("a.s_nationkey") == c("b.s_nationkey")) & (c("a.s_suppkey") < c("b.s_suppkey"))
    return a.join(b, on).select(c("a.s_suppkey").alias("x"), c("b.s_suppkey").alias("y"))


@Q.add(
    "join_multiway",
    """SELECT n_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey WHERE c_nationkey = s_nationkey GROUP BY n_name""",
)
def join_multiway(t):
    out = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey"))
    out = out.join(t.supplier, (c("l_suppkey") == c("s_suppkey")) & (c("c_nationkey") == c("s_nationkey")))
    out = out.join(t.nation, c("s_nationkey") == c("n_nationkey"))
    return out.groupBy("n_name").agg(n(), money("l_extendedprice").alias("revenue"))


@Q.add("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_exists(t):
    return t.customer.join(t.orders.where("o_totalprice > 200000"), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey")


@Q.add("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_not_exists(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@Q.add("semi_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def semi_in(t):
    return t.part.join(t.lineitem.where("l_quantity = 50"), c("p_partkey") == c("l_partkey"), "left_semi").select("p_partkey")


@Q.add("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_not_in(t):
    return t.spark.sql("SELECT c_custkey FROM {c} WHERE c_custkey NOT IN (SELECT o_custkey FROM {o})", c=t.customer, o=t.orders)


@Q.add("join_derived_cte", "WITH big AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) SELECT c_name, big.n FROM customer JOIN big ON c_custkey = o_custkey WHERE big.n > 12")
def join_derived_cte(t):
    big = t.orders.groupBy("o_custkey").agg(n()).where("n > 12")
    return t.customer.join(big, c("c_custkey") == c("o_custkey")).select("c_name", "n")


# aggregates


@Q.add("group_by", "SELECT l_shipmode, n FROM (SELECT l_returnflag AS l_shipmode, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1)")
def group_by(t):
    return t.lineitem.groupBy(c("l_returnflag").alias("l_shipmode")).agg(n())


@Q.add("group_expr", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderkey % 7 AS m, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def group_expr(t):
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("y"), (c("o_orderkey") % 7).alias("m")).agg(n())


@Q.add("group_ordinal", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def group_ordinal(t):
    return t.spark.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {o} GROUP BY 1, 2", o=t.orders)


@Q.add("group_null_key", "SELECT nullif(n_regionkey, 2) AS k, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def group_null_key(t):
    return t.nation.groupBy(F.nullif("n_regionkey", F.lit(2)).alias("k")).agg(n())


@Q.add("having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 14")
def having(t):
    return t.orders.groupBy("o_custkey").agg(n()).where("n > 14")


@Q.add(
    "agg_global",
    """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(nullif(l_returnflag, 'N')) AS BIGINT) AS filled, min(l_quantity) AS lo, max(l_quantity) AS hi,
              CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem""",
)
def agg_global(t):
    return t.lineitem.agg(n(), F.count(F.nullif("l_returnflag", F.lit("N"))).alias("filled"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), money("l_tax").alias("tax"), F.sum("l_linenumber").alias("lines"))


@Q.add("agg_empty", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_quantity) AS lo FROM lineitem WHERE l_quantity < 0")
def agg_empty(t):
    return t.lineitem.where("l_quantity < 0").agg(n(), F.sum("l_linenumber").alias("s"), F.min("l_quantity").alias("lo"))


@Q.add("agg_avg_int", "SELECT event_type, CAST(trunc(sum(user_id - 70) / count(*)) AS BIGINT) AS mean FROM events GROUP BY 1")
def agg_avg_int(t):
    return t.events.groupBy("event_type").agg(numbers.avg_int(c("user_id") - 70).alias("mean"))


@Q.add("agg_avg_decimal", "SELECT l_returnflag, CAST(round(CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*), 2) AS DOUBLE) AS mean FROM lineitem GROUP BY 1")
def agg_avg_decimal(t):
    return t.lineitem.groupBy("l_returnflag").agg(numbers.avg_decimal(c("l_quantity").cast(MONEY), 2).cast("double").alias("mean"))


@Q.add(
    "agg_distinct_count_sum_avg",
    """SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS total,
              CAST(avg(DISTINCT o_custkey % 50) AS DOUBLE) AS mean, min(o_custkey) AS lo FROM orders GROUP BY 1""",
)
def agg_distinct(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.sum_distinct("o_custkey").alias("total"), F.expr("avg(DISTINCT o_custkey % 50)").alias("mean"), F.min("o_custkey").alias("lo"))


@Q.add("agg_order_limit", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def agg_order_limit(t):
    return relational.top_k(t.orders.groupBy("o_custkey").agg(n()), [F.desc("n"), "o_custkey"], 10)


@Q.add("lambda_sum", "SELECT CAST(sum(o_orderkey % 100) AS BIGINT) AS fold FROM orders")
def lambda_sum(t):
    return folds.lambda_fold(t.orders, [], c("o_orderkey") % 100, F.lit(0).cast("long"), lambda s, x: s + x, "o_orderkey", combine=lambda a, b: a + b, width=5000)


@Q.add("lambda_concat", "SELECT string_agg(left(n_name, 2), '' ORDER BY n_nationkey) AS fold FROM nation")
def lambda_concat(t):
    return folds.lambda_fold(t.nation, [], F.substring("n_name", 1, 2), F.lit(""), lambda s, x: F.concat(s, x), "n_nationkey")


@Q.add("lambda_by_group", "SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS fold FROM orders GROUP BY 1")
def lambda_by_group(t):
    return folds.lambda_fold(t.orders, ["o_custkey"], c("o_orderstatus"), F.lit(""), lambda s, x: F.concat(s, x), "o_orderkey", combine=lambda a, b: F.concat(a, b), width=100_000)


# order, limits, distinct


@Q.add("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@Q.add("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t):
    return relational.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [-c("o_totalprice"), "o_orderkey"])


@Q.add("order_multi", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def order_multi(t):
    return relational.top_k(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"], 100)


@Q.add("order_nulls", "SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation ORDER BY k ASC NULLS FIRST, n_nationkey LIMIT 8")
def order_nulls(t):
    return t.nation.select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).alias("k")).orderBy(F.asc_nulls_first("k"), "n_nationkey").limit(8)


@Q.add("order_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
def order_limit_offset(t):
    return relational.top_k(t.orders, [F.desc("o_totalprice"), "o_orderkey"], 20, 30).select("o_orderkey")


@Q.add("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def topk(t):
    return relational.top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 25)


@Q.add("union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_all(t):
    return t.nation.select(c("n_name").alias("name")).unionByName(t.region.select(c("r_name").alias("name")))


@Q.add("intersect_except", "(SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def intersect_except(t):
    both = t.supplier.select(c("s_nationkey").alias("k")).intersect(t.customer.select(c("c_nationkey").alias("k")))
    return both.subtract(t.nation.where("n_regionkey = 1").select(c("n_nationkey").alias("k")))


# subqueries


@Q.add("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 0.99 * max(o_totalprice) FROM orders)")
def scalar_subquery(t):
    top = t.orders.agg((0.99 * F.max("o_totalprice")).alias("top"))
    return t.orders.join(F.broadcast(top), c("o_totalprice") > c("top")).select("o_orderkey")


@Q.add("scalar_first_row", "SELECT r_name, (SELECT n_name FROM nation ORDER BY n_name LIMIT 1) AS first FROM region")
def scalar_first_row(t):
    one = relational.scalar_first(t.nation.select(c("n_name").alias("first")), ["first"])
    return t.region.select("r_name").join(F.broadcast(one), how="left")


@Q.add("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
def correlated_scalar(t):
    top = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return t.customer.join(top, c("o_custkey") == c("c_custkey"), "left").select("c_custkey", "top")


@Q.add("derived_table", "SELECT k, v FROM (SELECT o_orderstatus AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) d WHERE v > 1000")
def derived_table(t):
    return t.orders.groupBy(c("o_orderstatus").alias("k")).agg(F.max("o_totalprice").alias("v")).where("v > 1000")


@Q.add(
    "cte_chain",
    """WITH a AS (SELECT o_custkey AS k, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1), b AS (SELECT n, CAST(count(*) AS BIGINT) AS customers FROM a GROUP BY 1)
       SELECT * FROM b WHERE customers > 2""",
)
def cte_chain(t):
    a = t.orders.groupBy("o_custkey").agg(n())
    return a.groupBy("n").agg(F.count("*").alias("customers")).where("customers > 2")


@Q.add(
    "any_subquery",
    """SELECT p_partkey, p_size > ANY (SELECT s_nationkey FROM supplier) AS gt, p_size = ANY (SELECT s_nationkey FROM supplier) AS eq,
              p_size = ANY (SELECT nullif(s_nationkey, 3) FROM supplier) AS open FROM part""",
)
def any_subquery(t):
    few = t.supplier.select("s_nationkey", F.nullif("s_nationkey", F.lit(3)).alias("holes"))
    out = relational.any_subquery(t.part.select("p_partkey", "p_size"), "p_size", ">", few, "s_nationkey", "gt")
    out = relational.any_subquery(out, "p_size", "=", few, "s_nationkey", "eq")
    return relational.any_subquery(out, "p_size", "=", few, "holes", "open").drop("p_size")


@Q.add(
    "all_subquery",
    """SELECT p_partkey, p_size >= ALL (SELECT s_nationkey FROM supplier) AS ge, p_size <> ALL (SELECT s_nationkey FROM supplier) AS ne,
              p_size <> ALL (SELECT nullif(s_nationkey, 3) FROM supplier) AS open, p_size < ALL (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0) AS none FROM part""",
)
def all_subquery(t):
    few = t.supplier.select("s_nationkey", F.nullif("s_nationkey", F.lit(3)).alias("holes"))
    out = relational.all_subquery(t.part.select("p_partkey", "p_size"), "p_size", ">=", few, "s_nationkey", "ge")
    out = relational.all_subquery(out, "p_size", "<>", few, "s_nationkey", "ne")
    out = relational.all_subquery(out, "p_size", "<>", few, "holes", "open")
    return relational.all_subquery(out, "p_size", "<", t.supplier.where("s_suppkey < 0"), "s_nationkey", "none").drop("p_size")


@Q.add("any_correlated", "SELECT c_custkey, c_acctbal > ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = c_nationkey) AS gt FROM customer")
def any_correlated(t):
    few = t.supplier.select(c("s_nationkey").alias("c_nationkey"), "s_acctbal")
    return relational.any_subquery(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", ">", few, "s_acctbal", "gt", ["c_nationkey"]).select("c_custkey", "gt")
