"""JSON and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from zephyrine.functions import jsons, vectors
from zephyrine.operators.matching import matching
from zephyrine.queries.registry import Registry
from zephyrine.sources import ingest, sinks

Q = Registry()
c = F.col


@Q.add("json_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_access(t):
    v = jsons.parse(c("props"))
    return t.events.select("event_id", jsons.get(v, "$.k", "long").alias("k"), jsons.get(v, "$.none").alias("none"))


@Q.add("json_array_scan", "SELECT CAST(unnest([4, 9, 4, 25]) AS BIGINT) AS it")
def json_array_scan(t):
    return ingest.json_source(t.spark.range(1).select(), F.lit("[4,9,4,25]"), "it", "long")


@Q.add("json_correlated_scan", "SELECT n_nationkey, CAST(x AS BIGINT) AS x FROM nation, unnest([n_nationkey, n_regionkey, 7]) AS u(x)")
def json_correlated_scan(t):
    text = jsons.array_of(c("n_nationkey"), c("n_regionkey"), F.lit(7))
    return ingest.json_source(t.nation.select("n_nationkey", "n_regionkey"), text, "x", "long").drop("n_regionkey")


@Q.add(
    "json_array_ops",
    """SELECT n_nationkey, CAST(to_json(a || [99]) AS VARCHAR) AS app, CAST(to_json([98, 99] || a) AS VARCHAR) AS psh, CAST(to_json(a[2:]) AS VARCHAR) AS pp, CAST(to_json(a[:-2]) AS VARCHAR) AS pb, CAST(to_json([a[1], 50, a[3]]) AS VARCHAR) AS pt, CAST(to_json([a[1], a[3]]) AS VARCHAR) AS rm
       FROM (SELECT n_nationkey, [n_nationkey, n_regionkey, 5] AS a FROM nation)""",
)
def json_array_ops(t):
    a = F.array(*[x.cast("long") for x in (c("n_nationkey"), c("n_regionkey"), F.lit(5))])
    lit = lambda v: F.lit(v).cast("long")
    made = {
        "app": jsons.append(a, lit(99)),
        "psh": jsons.push(a, lit(98), lit(99)),
        "pp": jsons.pop(a),
        "pb": jsons.pop_back(a),
        "pt": jsons.put(a, 1, lit(50)),
        "rm": jsons.remove(a, 1),
    }
    return t.nation.select("n_nationkey", *[F.to_json(v).alias(k) for k, v in made.items()])


@Q.add("json_set_unset_has", """SELECT event_id, '{"k":' || json_extract(props, '$.k') || ',"new":' || user_id || '}' AS st, '{}' AS un, true AS hs, false AS hn FROM events""")
def json_set_unset_has(t):
    p = c("props")
    return t.events.select("event_id", jsons.set_(p, "new", c("user_id").cast("string")).alias("st"), jsons.unset(p, "k").alias("un"), jsons.has(p, "k").alias("hs"), jsons.has(p, "k.x").alias("hn"))


@Q.add("json_construct", """SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' AS o, '[' || n_nationkey || ',' || n_regionkey || ']' AS a FROM nation""")
def json_construct(t):
    return t.nation.select("n_nationkey", jsons.object_of(id=c("n_nationkey"), name=c("n_name")).alias("o"), jsons.array_of(c("n_nationkey"), c("n_regionkey")).alias("a"))


@Q.add("json_rows_sink", """SELECT '[' || n_nationkey || ', "' || n_name || '", ' || coalesce(CAST(nullif(n_regionkey, 1) AS VARCHAR), 'null') || ']' AS row FROM nation""")
def json_rows_sink(t):
    return sinks.json_rows(t.nation.select("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(1)).alias("k")))


@Q.add("json_ingest", "SELECT CAST(event_id AS BIGINT) AS id, user_id AS data, CAST(7 AS BIGINT) AS extra FROM events")
def json_ingest(t):
    from pyspark.sql.types import _parse_datatype_string

    lines = t.events.select(F.to_json(F.struct(c("event_id").alias("id"), c("user_id").alias("data"))).alias("line"))
    return ingest.rows(lines, "line", _parse_datatype_string("id long, data long, extra long"), {"extra": F.lit(7)})


def query_vector() -> list[float]:
    return [((i * 37) % 64) / 64 - 0.5 for i in range(64)]


LIST = "[" + ", ".join(str(x) for x in query_vector()) + "]::DOUBLE[]"


@Q.add("vector_cos_distance", f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {LIST}), 6) AS d FROM embeddings")
def vector_cos_distance(t):
    return t.embeddings.select("vec_id", F.round(vectors.cos_distance(c("embedding"), vectors.literal(query_vector())), 6).alias("d"))


@Q.add("vector_topk", f"SELECT vec_id, label FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {LIST}), vec_id LIMIT 10")
def vector_topk(t):
    return matching(t.embeddings, "embedding", query_vector(), 10, "vec_id").select("vec_id", "label")


@Q.add("vector_arith", "SELECT vec_id, round(embedding[1]::DOUBLE + embedding[1]::DOUBLE, 5) AS s, round(embedding[2]::DOUBLE * embedding[2]::DOUBLE, 5) AS p, 0.0::DOUBLE AS z, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def vector_arith(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    first = lambda x, i: F.round(vectors.item(x, i), 5)
    return t.embeddings.select("vec_id", first(vectors.add(e, e), 0).alias("s"), first(vectors.mul(e, e), 1).alias("p"), first(vectors.sub(e, e), 2).alias("z"), F.size("embedding").cast("long").alias("n"))
