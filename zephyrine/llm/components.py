"""Connected components of a graph kept in a DataFrame, with nothing gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zephyrine.llm.common import cut

#: Rounds after which components() gives up; the number that is needed grows with the logarithm
#: of the longest path, so this is out of reach.
MOST_ROUNDS = 64
#: Edges that a task handles; a graph of fewer needs one task a step, however many partitions shuffles have.
EDGES = 100_000


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
    ).first()
    return (row["n"], row["h"])


def _least(edges: DataFrame, at, tasks: int) -> DataFrame:
    """``u, m``: ``at`` for each node ``u``, written out, so that the join that follows has two plain
    exchanges and adaptive execution can split the one of a node with very many edges."""
    return cut(edges.groupBy("u").agg(at.alias("m")).coalesce(tasks))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every larger neighbour of a node is joined to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, F.least(F.min("v"), F.col("u")), tasks)
    moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(moved.coalesce(tasks).distinct().coalesce(tasks))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """With edges from larger to smaller: a node and its smaller neighbours all join the smallest."""
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, F.min("v"), tasks)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (long columns ``u, v``): root is the smallest node
    of the component.

    Alternates the two star operations (Kiveris et al., "Connected components in MapReduce and
    beyond", 2014) until nothing changes. Each round groups and joins on a node and is written to the
    checkpoint folder. Self-loops and repeated edges are allowed; null ends are left out; no edges give
    no rows.
    """
    now = cut(edges.select("u", "v").where("u <> v").distinct())
    seen = _checksum(now)
    tasks = max(1, -(-seen[0] // EDGES))
    now = now.coalesce(tasks)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        now = _small_star(_large_star(now, tasks), tasks)
        said = _checksum(now)
        if said == seen:
            break
        seen = said
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
