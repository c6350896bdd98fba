"""Versioned tables against a dictionary, change logs, clones, topics, streams."""

import random

import pytest
from pyspark.sql import functions as F

from zephyrine.operators import dml
from zephyrine.sources.store import Store
from zephyrine.streaming import streams

c = F.col
KV = "id int, data int"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(df):
    return {r[0]: r[1] for r in df.collect()}


def make(spark, *values, schema=KV):
    return spark.createDataFrame(list(values), schema)


def test_insert_rules(spark):
    table = make(spark, (1, 0))
    assert rows(dml.insert(table, make(spark, (2, 5)), ["id"]).apply(table)) == {1: 0, 2: 5}
    assert rows(dml.insert(table, make(spark, (2,), schema="id int"), ["id"], {"data": F.lit(9)}).returning) == {2: 9}
    for bad in [(1, 1)], [(3, 1), (3, 2)], [(None, 1)]:
        with pytest.raises(ValueError):
            dml.insert(table, make(spark, *bad), ["id"])
    with pytest.raises(ValueError):
        dml.insert(table, make(spark, (1, 1), schema="id int, other int"), ["id"])


def test_upsert_sequence(spark):
    table = make(spark, (1, 10), (2, 20))
    new = spark.createDataFrame([(1, 0, 0), (3, 0, 1), (3, 0, 2), (1, 0, 3), (2, 7, 4)], "id int, data int, at int")
    add = {"data": lambda now, ex: now("data") + 1}
    change = dml.upsert(table, new, ["id"], "at", add)
    assert rows(change.apply(table)) == {1: 12, 2: 21, 3: 1}
    change = dml.upsert(table, new, ["id"], "at", add, where=lambda now, ex: ex("data") > 5)
    assert rows(change.returning) == {2: 21, 3: 0}
    change = dml.upsert(table, new, ["id"], "at")
    assert rows(change.returning) == {3: 0}
    assert rows(change.apply(table)) == {1: 10, 2: 20, 3: 0}


def test_update_delete_truncate(spark):
    table = make(spark, (1, 10), (2, None), (3, 30))
    assert rows(dml.update(table, ["id"], {"data": c("data") * 2}, c("data") > 10).apply(table)) == {1: 10, 2: None, 3: 60}
    gone = dml.delete(table, ["id"], c("data") > 10)
    assert rows(gone.returning) == {3: 30} and rows(gone.apply(table)) == {1: 10, 2: None}
    assert dml.truncate(table, ["id"]).apply(table).count() == 0


def test_random_commits_like_a_dictionary(spark, store):
    rng = random.Random(11)
    store.create_table("t", KV, ["id"])
    store.create_subscription("s", "t")
    model = {}
    for step in range(14):
        table = store.table("t")
        kind = rng.choice(["insert", "upsert", "update", "delete"])
        ids = rng.sample(range(40), 6)
        if kind == "insert":
            new = [(i, step) for i in ids if i not in model]
            if not new:
                continue
            change = dml.insert(table, make(spark, *new), ["id"])
            model.update(new)
        elif kind == "upsert":
            change = dml.upsert(table, make(spark, *[(i, step) for i in ids]), ["id"], update={"data": lambda now, ex: now("data") + ex("data")})
            model.update({i: model[i] + step if i in model else step for i in ids})
        elif kind == "update":
            change = dml.update(table, ["id"], {"data": c("data") + 100}, c("id") % 5 == step % 5)
            model.update({i: v + 100 for i, v in model.items() if i % 5 == step % 5})
        else:
            change = dml.delete(table, ["id"], c("id").isin(ids))
            model = {i: v for i, v in model.items() if i not in ids}
        store.commit("t", change)
        assert rows(store.table("t")) == model
    assert rows(Store(spark, store.root).table("t")) == model
    assert rows(streams.replay(store.log("s"), "id", KV)) == model


def test_subscription(spark, store):
    store.create_table("t", KV, ["id"])
    store.commit("t", dml.insert(store.table("t"), make(spark, (0, 0)), ["id"]))
    store.create_subscription("s", "t")
    assert store.subscription("s").count() == 0
    store.commit("t", dml.insert(store.table("t"), make(spark, (1, 1), (2, 2), (3, None)), ["id"]))
    events = store.subscription("s").collect()
    lsn = events[0].lsn
    assert {e.lsn for e in events} == {lsn} and {e.data for e in events} == {'{"id":1,"data":1}', '{"id":2,"data":2}', '{"id":3,"data":null}'}
    assert store.subscription("s").count() == 3
    store.commit("t", dml.delete(store.table("t"), ["id"], c("id") == 1))
    store.acknowledge("s", lsn)
    assert [(e.cmd, e.data) for e in store.subscription("s").collect()] == [("delete", '{"id":1,"data":1}')]
    store.acknowledge("s", lsn)
    for bad in (lsn - 1, 10_000):
        with pytest.raises(ValueError):
            store.acknowledge("s", bad)


def test_block_is_one_lsn_and_can_be_left(spark, store):
    store.create_table("t", KV, ["id"])
    store.create_subscription("s", "t")
    store.begin()
    store.commit("t", dml.insert(store.table("t"), make(spark, (1, 1)), ["id"]))
    store.commit("t", dml.update(store.table("t"), ["id"], {"data": c("data") + 1}))
    assert rows(store.table("t")) == {1: 2}
    with pytest.raises(RuntimeError):
        store.begin()
    store.end()
    assert rows(store.table("t")) == {1: 2} and store.subscription("s").select("lsn").distinct().count() == 1
    store.begin()
    store.commit("t", dml.truncate(store.table("t"), ["id"]))
    store.end(commit=False)
    assert rows(store.table("t")) == {1: 2}


def test_clone(spark, store):
    store.create_table("t", KV, ["id"])
    store.commit("t", dml.insert(store.table("t"), make(spark, (1, 1), (2, 2)), ["id"]))
    store.create_clone("u", "t")
    store.commit("t", dml.insert(store.table("t"), make(spark, (3, 3)), ["id"]))
    store.commit("u", dml.delete(store.table("u"), ["id"], c("id") == 1))
    with pytest.raises(ValueError):
        dml.insert(store.table("u"), make(spark, (2, 9)), ["id"])
    store.commit("u", dml.insert(store.table("u"), make(spark, (1, 9)), ["id"]))
    assert rows(store.table("t")) == {1: 1, 2: 2, 3: 3} and rows(store.table("u")) == {1: 9, 2: 2}
    assert [tuple(r) for r in store.show("clones").collect()] == [("u", "t")]


def test_definitions(spark, store):
    store.create_table("t", KV, ["id"], defaults={"data": 7})
    with pytest.raises(ValueError):
        store.create_table("t", KV, ["id"])
    with pytest.raises(ValueError):
        store.create_table("v", KV, [])
    store.commit("t", dml.insert(store.table("t"), make(spark, (1,), schema="id int"), ["id"], store.defaults("t")))
    store.add_column("t", "more", "string")
    assert [tuple(r) for r in store.table("t").collect()] == [(1, 7, None)]
    store.drop_column("t", "data")
    assert store.table("t").columns == ["id", "more"]
    with pytest.raises(ValueError):
        store.drop_column("t", "id")
    store.create_index("t", "i", ["more"], unique=True)
    store.rename_table("t", "u")
    assert store.show("indexes").first()["index"] == "i"
    assert {r.name for r in store.show("tables").collect()} == {"u"}
    store.compact("u")
    assert store.table("u").count() == 1
    store.drop_table("u")
    assert store.show("tables").count() == 0
    with pytest.raises(ValueError):
        store.show("nothing")


def test_identity(spark, store):
    store.create_table("t", "id long, x int", ["id"], identity="id")
    for _ in range(2):
        new = store.identities("t", spark.createDataFrame([(5,), (6,)], "x int").coalesce(1))
        store.commit("t", dml.insert(store.table("t"), new.select("id", "x"), ["id"]))
    assert store.table("t").select("id").distinct().count() == 4


def test_another_driver_commits_first(spark, store):
    store.create_table("t", KV, ["id"])
    other = Store(spark, store.root)
    other.create_topic("a")
    with pytest.raises(RuntimeError):
        store.create_topic("b")


def test_topic_stream(spark, store, tmp_path):
    store.create_topic("top")
    store.publish("top", spark.createDataFrame([("0",)], "data string"))
    store.create_subscription("s", "top")
    assert store.subscription("s").count() == 0
    store.publish("top", spark.createDataFrame([("1",), ('{"a": 2}',)], "data string"))
    seen = []
    deliver = lambda: streams.deliver(store, "top", lambda df, _: seen.extend(r.data for r in df.collect()), f"file://{tmp_path}/at").awaitTermination()
    deliver()
    assert sorted(seen) == ["1", '{"a": 2}']
    store.publish("top", spark.createDataFrame([("3",)], "data string"))
    deliver()
    assert sorted(seen) == ["1", "3", '{"a": 2}']
    with pytest.raises(ValueError):
        store.publish("none", spark.range(1))


def test_windows_over_a_stream(spark, sf, tmp_path):
    static = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", c("ts").cast("timestamp"))
    static.write.parquet(f"{tmp_path}/events")
    live = spark.readStream.schema(static.schema).parquet(f"{tmp_path}/events")
    counts = streams.windowed(live, "ts", ["event_type"], "1 day")
    q = counts.writeStream.format("memory").queryName("zephyrine_windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = streams.windowed(static, "ts", ["event_type"], "1 day")
    assert sorted(map(tuple, spark.table("zephyrine_windows").collect())) == sorted(map(tuple, want.collect()))


def test_watch(spark):
    said = iter([False, False, True])
    streams.watch(lambda: next(said), every=0.01)
    with pytest.raises(TimeoutError):
        streams.watch(lambda: False, every=0.01, most=0.05)
    streams.watch_sql(spark, "1 + 1 = 2")


def test_vacuum(spark, store):
    """Only what the kept heads name stays; the table reads as before."""
    store.create_table("t", KV, ["id"])
    for i in range(12):
        store.commit("t", dml.insert(store.table("t"), make(spark, (i, i)), ["id"]))
    before = rows(store.table("t"))
    assert store.vacuum(1) > 0 and store.vacuum(1) == 0
    assert rows(store.table("t")) == before == {i: i for i in range(12)}
    assert rows(Store(spark, store.root).table("t")) == before


def test_rolled_back_events(spark, store):
    """Neither a subscription, nor a stream, nor a replay sees what was rolled back; in a block, the last event of a key holds."""
    store.create_table("t", KV, ["id"])
    store.create_subscription("s", "t")
    store.begin()
    store.commit("t", dml.insert(store.table("t"), make(spark, (1, 1)), ["id"]))
    store.end(commit=False)
    store.begin()
    store.commit("t", dml.insert(store.table("t"), make(spark, (2, 2), (3, 3)), ["id"]))
    store.commit("t", dml.update(store.table("t"), ["id"], {"data": c("data") + 5}))
    store.commit("t", dml.delete(store.table("t"), ["id"], c("id") == 3))
    store.end()
    assert [(r.cmd, r.data) for r in store.subscription("s").collect() if '"id":2' in r.data] == [("write", '{"id":2,"data":2}'), ("write", '{"id":2,"data":7}')]
    assert rows(streams.replay(store.log("s"), "id", KV)) == {2: 7} == rows(store.table("t"))
    seen = []
    streams.deliver(store, "t", lambda df, _: seen.extend(r.data for r in df.collect()), f"{store.root}/progress").awaitTermination()
    assert len(seen) == 5 and not any('"id":1' in x for x in seen)


def test_interrupted_commit_shows_its_log(spark, store):
    """A store that ended between its head and the log's final names puts them right when it is opened."""
    store.create_table("t", KV, ["id"])
    store.create_subscription("s", "t")
    store._show_log = lambda: None
    store.commit("t", dml.insert(store.table("t"), make(spark, (1, 1)), ["id"]))
    assert store.subscription("s").count() == 1
    again = Store(spark, store.root)
    assert again.subscription("s").count() == 1
    assert not any(x.getPath().getName().startswith(".lsn") for x in again._fs.listStatus(again._path(again.log_path("t"))))


def test_identities_have_no_gaps(spark, store):
    store.create_table("t", "id long, data int", ["id"], identity="id")
    for n in (5, 7, 0):
        new = store.identities("t", spark.range(n).select(c("id").cast("int").alias("data")).repartition(3))
        store.commit("t", dml.insert(store.table("t"), new, ["id"]))
    assert sorted(r.id for r in store.table("t").collect()) == list(range(12))
