"""DML, clones, change logs, topics and procedures, over throw-away stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from zephyrine.operators import dml
from zephyrine.plans import procedures
from zephyrine.plans.dialect import Engine
from zephyrine.plans.statements import Database
from zephyrine.queries.registry import Registry, Tables
from zephyrine.session import shared_folder
from zephyrine.sources.store import Store
from zephyrine.streaming import streams

Q = Registry()
c = F.col
ORDER = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


def store(t: Tables) -> Store:
    """A new store where the cluster shares files."""
    return Store(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")


def orders(t: Tables):
    return t.orders.select(*ORDER)


@Q.add("dml_insert_select", f"{ORDERS} UNION ALL SELECT o_orderkey + 10000000, o_custkey, 0.0 FROM orders WHERE o_totalprice > 300000")
def dml_insert_select(t):
    new = t.orders.where("o_totalprice > 300000").select((c("o_orderkey") + 10000000).alias("o_orderkey"), "o_custkey", F.lit(0.0).alias("o_totalprice"))
    return dml.insert(orders(t), new, ["o_orderkey"]).apply(orders(t))


@Q.add("dml_insert_defaults", "SELECT n_nationkey AS id, CAST(123 AS INTEGER) AS data FROM nation")
def dml_insert_defaults(t):
    empty = t.spark.createDataFrame([], "id int, data int")
    return dml.insert(empty, t.nation.select(c("n_nationkey").alias("id")), ["id"], {"data": F.lit(123)}).returning


@Q.add("dml_upsert_nothing", f"{ORDERS} UNION ALL SELECT o_orderkey + 10000000, o_custkey, 1.0 FROM orders WHERE o_orderkey % 10 = 1")
def dml_upsert_nothing(t):
    hit = t.orders.where("o_orderkey % 10 = 0").select("o_orderkey", "o_custkey", F.lit(1.0).alias("o_totalprice"))
    new = t.orders.where("o_orderkey % 10 = 1").select((c("o_orderkey") + 10000000).alias("o_orderkey"), "o_custkey", F.lit(1.0).alias("o_totalprice"))
    return dml.upsert(orders(t), hit.unionByName(new), ["o_orderkey"]).apply(orders(t))


@Q.add(
    "dml_upsert_update",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND o_custkey < 1000 THEN o_custkey + 5 ELSE o_custkey END AS o_custkey, o_totalprice FROM orders
       UNION ALL SELECT o_orderkey + 10000000, CAST(5 AS BIGINT), 2.0 FROM orders WHERE o_orderkey % 10 = 1""",
)
def dml_upsert_update(t):
    hit = t.orders.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit(5).cast("long").alias("o_custkey"), F.lit(2.0).alias("o_totalprice"))
    new = t.orders.where("o_orderkey % 10 = 1").select((c("o_orderkey") + 10000000).alias("o_orderkey"), F.lit(5).cast("long").alias("o_custkey"), F.lit(2.0).alias("o_totalprice"))
    change = dml.upsert(orders(t), hit.unionByName(new), ["o_orderkey"], update={"o_custkey": lambda now, ex: now("o_custkey") + ex("o_custkey")}, where=lambda now, ex: now("o_custkey") < 1000)
    return change.apply(orders(t))


@Q.add("dml_upsert_batch", "SELECT n_regionkey AS id, CAST(count(*) - 1 + (n_regionkey % 2) AS INTEGER) AS data FROM nation GROUP BY 1")
def dml_upsert_batch(t):
    """Repeated keys in one statement: each sees what those before it left."""
    table = t.region.where("r_regionkey % 2 = 1").select(c("r_regionkey").alias("id"), F.lit(0).alias("data"))
    rows = t.nation.select(c("n_regionkey").alias("id"), F.lit(0).alias("data"), c("n_nationkey").alias("at"))
    return dml.upsert(table, rows, ["id"], order="at", update={"data": lambda now, ex: now("data") + 1}).apply(table)


@Q.add("dml_update", "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def dml_update(t):
    return dml.update(orders(t), ["o_orderkey"], {"o_totalprice": c("o_totalprice") * 2}, c("o_custkey") % 3 == 0).apply(orders(t))


@Q.add("dml_delete_returning", f"SELECT o_orderkey, o_totalprice - 1 AS x FROM ({ORDERS}) WHERE o_custkey % 5 = 0")
def dml_delete_returning(t):
    return dml.delete(orders(t), ["o_orderkey"], c("o_custkey") % 5 == 0).returning.select("o_orderkey", (c("o_totalprice") - 1).alias("x"))


@Q.add("dml_truncate", f"{ORDERS} WHERE false")
def dml_truncate(t):
    return dml.truncate(orders(t), ["o_orderkey"]).apply(orders(t))


@Q.add(
    "dml_block",
    """SELECT n_nationkey, n_regionkey + 10 AS n_regionkey FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT 100, 1""",
)
def dml_block(t):
    """Several statements that take effect together."""
    s = store(t)
    s.create_table("n", "n_nationkey int, n_regionkey int", ["n_nationkey"])
    s.commit("n", dml.insert(s.table("n"), t.nation.select("n_nationkey", "n_regionkey"), ["n_nationkey"]))
    s.begin()
    s.commit("n", dml.delete(s.table("n"), ["n_nationkey"], c("n_nationkey") < 5))
    s.commit("n", dml.update(s.table("n"), ["n_nationkey"], {"n_regionkey": c("n_regionkey") + 10}))
    s.commit("n", dml.insert(s.table("n"), t.spark.createDataFrame([(100, 1)], "n_nationkey int, n_regionkey int"), ["n_nationkey"]))
    s.end()
    return s.table("n")


@Q.add("clone_overlay", "SELECT 'main' AS side, n_nationkey, n_regionkey FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'clone', n_nationkey, CASE WHEN n_nationkey = 4 THEN 77 ELSE n_regionkey END FROM nation WHERE n_nationkey <> 7")
def clone_overlay(t):
    s = store(t)
    s.create_table("n", "n_nationkey int, n_regionkey int", ["n_nationkey"])
    s.commit("n", dml.insert(s.table("n"), t.nation.select("n_nationkey", "n_regionkey"), ["n_nationkey"]))
    s.create_clone("m", "n")
    s.commit("n", dml.delete(s.table("n"), ["n_nationkey"], c("n_nationkey") == 3))
    s.commit("m", dml.update(s.table("m"), ["n_nationkey"], {"n_regionkey": F.lit(77)}, c("n_nationkey") == 4))
    s.commit("m", dml.delete(s.table("m"), ["n_nationkey"], c("n_nationkey") == 7))
    side = lambda n, of: s.table(n).select(F.lit(of).alias("side"), "*")
    return side("n", "main").unionByName(side("m", "clone"))


def history(t: Tables) -> Store:
    """Three commits to a subscribed table: all nations, those of region 1 changed, those of region 2 gone."""
    s = store(t)
    s.create_table("n", "n_nationkey int, n_regionkey int", ["n_nationkey"])
    s.create_subscription("sub", "n")
    s.commit("n", dml.insert(s.table("n"), t.nation.select("n_nationkey", "n_regionkey"), ["n_nationkey"]))
    s.commit("n", dml.update(s.table("n"), ["n_nationkey"], {"n_regionkey": c("n_regionkey") + 10}, c("n_regionkey") == 1))
    s.commit("n", dml.delete(s.table("n"), ["n_nationkey"], c("n_regionkey") == 2))
    return s


def event(k: str, v: str) -> str:
    return f"""'{{"n_nationkey":' || {k} || ',"n_regionkey":' || {v} || '}}'"""


LOG = f"""SELECT CAST(3 AS BIGINT) AS lsn, 'write' AS cmd, {event("n_nationkey", "n_regionkey")} AS data FROM nation
          UNION ALL SELECT 4, 'write', {event("n_nationkey", "(n_regionkey + 10)")} FROM nation WHERE n_regionkey = 1
          UNION ALL SELECT 5, 'delete', {event("n_nationkey", "n_regionkey")} FROM nation WHERE n_regionkey = 2"""


@Q.add("cdc_log", LOG)
def cdc_log(t):
    return history(t).subscription("sub")


@Q.add("subscription_after_ack", f"SELECT * FROM ({LOG}) WHERE lsn > 3")
def subscription_after_ack(t):
    s = history(t)
    s.acknowledge("sub", 3)
    return s.subscription("sub")


@Q.add("cdc_replay", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_regionkey <> 2")
def cdc_replay(t):
    return streams.replay(history(t).log("sub"), "n_nationkey", "n_nationkey int, n_regionkey int")


@Q.add("topic_publish", "SELECT CAST(3 AS BIGINT) AS lsn, 'publish' AS cmd, props AS data FROM events")
def topic_publish(t):
    s = store(t)
    s.create_topic("top")
    s.create_subscription("sub", "top")
    s.publish("top", t.events.select("props"))
    return s.subscription("sub")


@Q.add("windowed_events", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS begin, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def windowed_events(t):
    out = streams.windowed(t.events.withColumn("ts", c("ts").cast("timestamp")), "ts", ["event_type"], "1 day")
    return out.select(c("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n")


@Q.add("show_tables", "SELECT 'n' AS name, 'n_nationkey' AS key, CAST(3 AS INTEGER) AS deltas")
def show_tables(t):
    return history(t).show("tables")


# functions and procedures


@Q.add("udf_scalar", "SELECT o_orderkey, o_totalprice * 0.1 + 1 AS fee FROM orders")
def udf_scalar(t):
    procedures.scalar_function(t.spark, "fee_of", "x double", "double", "x * 0.1 + 1")
    return t.orders.select("o_orderkey", F.call_function("fee_of", c("o_totalprice")).alias("fee"))


@Q.add("udf_table", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def udf_table(t):
    t.nation.createOrReplaceTempView("zephyrine_nation")
    procedures.table_function(t.spark, "nations_of", "r int", "n_nationkey int, n_name string", "SELECT n_nationkey, n_name FROM zephyrine_nation WHERE n_regionkey = nations_of.r")
    return t.spark.sql("SELECT * FROM nations_of(2)")


@Q.add("udf_native", "SELECT p_partkey, CAST(p_size * p_size AS BIGINT) AS x FROM part")
def udf_native(t):
    """A function in Python over Arrow arrays, called from the dialect."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def squared(x: pa.Array) -> pa.Array:
        return pc.multiply(x, x)

    procedures.native_function(t.spark, "zephyrine_squared", squared, "bigint")
    return engine(t, "part").sql("select p_partkey, zephyrine_squared(p_size::int) as x from part")


@Q.add("group_check", "SELECT true AS refused")
def group_check(t):
    """A column that is neither grouped nor aggregated is refused."""
    from pyspark.errors import AnalysisException

    try:
        engine(t, "nation").sql("select n_name, count(*) as n from nation group by n_regionkey")
    except AnalysisException:
        return t.spark.range(1).select(F.lit(True).alias("refused"))
    raise AssertionError("not refused")


@Q.add("proc_while", "SELECT CAST(5050 AS BIGINT) AS total")
def proc_while(t):
    return procedures.run(t.spark, "DECLARE i BIGINT DEFAULT 0; DECLARE total BIGINT DEFAULT 0; WHILE i < 100 DO SET i = i + 1; SET total = total + i; END WHILE; SELECT total AS total;")


@Q.add("proc_for", "SELECT string_agg(r_name, ',' ORDER BY r_regionkey) AS names FROM region")
def proc_for(t):
    t.region.createOrReplaceTempView("zephyrine_region")
    return procedures.run(
        t.spark,
        """DECLARE names STRING DEFAULT '';
           FOR r AS (SELECT r_name FROM zephyrine_region ORDER BY r_regionkey) DO
             IF names = '' THEN SET names = r.r_name; ELSE SET names = names || ',' || r.r_name; END IF;
           END FOR;
           SELECT names AS names;""",
    )


@Q.add(
    "show_sections",
    """SELECT * FROM (VALUES ('constraints', 'primary key', 'n_nationkey'), ('constraints', 'not null', 'n_regionkey'), ('constraints', 'unique', 'n_nationkey'), ('partitions', 'base', '0'), ('partitions', 'delta', '1'),
       ('metrics', 'tables', '1'), ('metrics', 'topics', '1'), ('metrics', 'subscriptions', '1'), ('metrics', 'deltas', '1'), ('metrics', 'log_folders', '1'), ('log', 'n', '5'), ('lsn', 'lsn', '5')) v(section, item, said)""",
)
def show_sections(t):
    s = store(t)
    s.create_table("n", "n_nationkey int, n_regionkey int", ["n_nationkey"], filled=["n_regionkey"])
    s.create_topic("top")
    s.create_subscription("sub", "n")
    s.create_index("n", "i", ["n_nationkey"], unique=True)
    s.commit("n", dml.insert(s.table("n"), t.nation.select("n_nationkey", "n_regionkey"), ["n_nationkey"], filled=["n_regionkey"]))
    parts = [
        s.show("constraints").select(F.lit("constraints").alias("section"), c("kind").alias("item"), c("columns").alias("said")),
        s.show("partitions").select(F.lit("partitions"), "kind", c("folders").cast("string")),
        s.show("metrics").select(F.lit("metrics"), "name", c("value").cast("string")),
        s.show("log").select(F.lit("log"), "rel", c("lsn").cast("string")),
        s.show("lsn").select(F.lit("lsn"), F.lit("lsn"), c("lsn").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@Q.add("cdc_rollback", f"SELECT CAST(3 AS BIGINT) AS lsn, 'write' AS cmd, {event('n_nationkey', 'n_regionkey')} AS data FROM nation")
def cdc_rollback(t):
    """What a block did that was rolled back reaches no subscriber."""
    s = store(t)
    s.create_table("n", "n_nationkey int, n_regionkey int", ["n_nationkey"])
    s.create_subscription("sub", "n")
    s.begin()
    s.commit("n", dml.insert(s.table("n"), t.region.select(c("r_regionkey").alias("n_nationkey"), F.lit(-1).alias("n_regionkey")), ["n_nationkey"]))
    s.end(commit=False)
    s.commit("n", dml.insert(s.table("n"), t.nation.select("n_nationkey", "n_regionkey"), ["n_nationkey"]))
    return s.subscription("sub")


@Q.add("cdc_block_replay", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 1 THEN o_custkey + 7 ELSE o_custkey END AS o_custkey FROM orders WHERE o_custkey % 3 <> 0")
def cdc_block_replay(t):
    """Rows written, changed and deleted within one block: the log replays to the table."""
    s = store(t)
    s.create_table("o", "o_orderkey long, o_custkey long", ["o_orderkey"])
    s.create_subscription("sub", "o")
    s.begin()
    s.commit("o", dml.insert(s.table("o"), t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], checked=False))
    s.commit("o", dml.update(s.table("o"), ["o_orderkey"], {"o_custkey": c("o_custkey") + 7}, c("o_custkey") % 3 == 1))
    s.commit("o", dml.delete(s.table("o"), ["o_orderkey"], c("o_custkey") % 3 == 0))
    s.end()
    return streams.replay(s.log("sub"), "o_orderkey", "o_orderkey long, o_custkey long")


@Q.add("stream_delivery", "SELECT CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT props) AS BIGINT) AS texts FROM events")
def stream_delivery(t):
    """A topic's events, delivered in batches by a stream, each at least once."""
    s = store(t)
    s.create_topic("top")
    s.create_subscription("sub", "top")
    s.publish("top", t.events.select("props"))
    out = f"{s.root}/delivered"

    def handle(rows, batch):
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    streams.deliver(s, "top", handle, f"{s.root}/progress").awaitTermination()
    return t.spark.read.parquet(out).agg(F.count("*").alias("events"), F.countDistinct("data").alias("texts"))


@Q.add("watch_then_read", "SELECT count(*) AS n FROM region")
def watch_then_read(t):
    t.region.createOrReplaceTempView("zephyrine_watched")
    streams.watch_sql(t.spark, "(SELECT count(*) FROM zephyrine_watched) > 0", most=30.0)
    return t.region.agg(F.count("*").alias("n"))


@Q.add("function_execute", "SELECT CAST(max(o_custkey) * 2 AS BIGINT) AS x FROM orders")
def function_execute(t):
    """A function with a block as body, called by EXECUTE."""
    db = Database(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")
    db.execute("create function twice (x int) return int begin declare y int := x; y := y * 2; return y; end")
    top = t.orders.agg(F.max("o_custkey")).first()[0]
    return db.execute(f"execute twice({top})")


# the dialect


def engine(t: Tables, *names: str) -> Engine:
    e = Engine(t.spark)
    for n in names:
        e.register(n, getattr(t, n))
    return e


@Q.add("dialect_method_call", "SELECT p_partkey, upper(substr(p_name, 1, 3)) AS up, CAST(p_size AS VARCHAR) || '!' AS s, CAST(p_size // 4 AS BIGINT) AS q FROM part")
def dialect_method_call(t):
    return engine(t, "part").sql("select p_partkey, p_name::substr(1, 3)::upper() as up, p_size::string || '!' as s, p_size / 4 as q from part")


@Q.add("dialect_lambda", "SELECT o_orderstatus, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def dialect_lambda(t):
    return engine(t, "orders").sql("select o_orderstatus, 0 -> self + o_orderkey as total from orders group by o_orderstatus", order="o_orderkey")


@Q.add("dialect_matching", "SELECT vec_id, label FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], [" + ", ".join(["0.5"] * 32 + ["-0.25"] * 32) + "]::DOUBLE[]), vec_id LIMIT 5")
def dialect_matching(t):
    vec = ", ".join(["0.5"] * 32 + ["-0.25"] * 32)
    return engine(t, "embeddings").sql(f"select vec_id, label from embeddings matching embedding to vector [{vec}] top 5", key="vec_id")


@Q.add("dialect_distinct_on", "SELECT DISTINCT ON (n_regionkey) n_regionkey, n_name FROM nation ORDER BY n_regionkey, n_name")
def dialect_distinct_on(t):
    return engine(t, "nation").sql("select distinct on (n_regionkey) n_regionkey, n_name from nation")
