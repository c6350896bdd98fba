"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, are cut into blocks. Block ``j`` (from zero) of
a source with weight ``w`` may be placed from slot ``floor(j / w)`` on and is due by ``ceil((j + 1) / w)``;
one block is placed per slot, the one due first among those released. As the weights sum to one, all
deadlines are met, so no source is ever a block or more away from its share (Baruah et al., 1996).

Weights are taken as they are, as whole numbers with a common denominator, and the driver works the slots
out block by block. When a source ends, the others' weights are scaled up and a new phase begins. Every row
is placed exactly once. So that the driver's work is bounded, there are MOST blocks at most: where blocks of
BLOCK rows would be more, blocks are larger.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents in a block, at least, and blocks, at most (besides one more a source).
BLOCK, MOST = 32, 1_000_000
#: Blocks whose slots are broadcast, at most; beyond it they are joined by a shuffle.
BROADCAST = 200_000
#: Exponent by which the sizes of sources become weights where no weights are given.
ALPHA = 0.5
#: Rows that ranking puts together at once, on average.
TOGETHER = 20_000
SEED = 5


def exact_slots(rows: dict[str, int], weights: dict[str, float], block: int = BLOCK) -> dict[str, np.ndarray]:
    """Of each source's blocks: slot, release, deadline and the position of the first row, a row of an array each.

    Earliest deadline first with the exact weights, phase by phase. ``weights`` must be positive.
    """
    left = {s: -(-n // block) for s, n in rows.items() if n > 0}
    exact = {s: Fraction(weights[s]) for s in left}
    whole = math.lcm(*(w.denominator for w in exact.values()))
    share = {s: int(w * whole) for s, w in exact.items()}
    out = {s: np.zeros((4, n), np.int64) for s, n in left.items()}
    done = dict.fromkeys(left, 0)
    begin = at = 0
    while left:
        total = sum(share[s] for s in left)
        ready: list[tuple[int, str, int]] = []
        later = [(0, -(-total // share[s]), s) for s in left]
        heapq.heapify(later)
        placed = dict.fromkeys(left, 0)
        slot = 0
        while True:
            while later and later[0][0] <= slot:
                release, due, s = heapq.heappop(later)
                heapq.heappush(ready, (due, s, release))
            due, s, release = heapq.heappop(ready)
            k = done[s] + placed[s]
            out[s][:, k] = begin + slot, begin + release, begin + due, at
            at += min(block, rows[s] - k * block)
            placed[s] += 1
            slot += 1
            j = placed[s]
            if j == left[s]:
                break
            heapq.heappush(later, (j * total // share[s], -(-(j + 1) * total // share[s]), s))
        begin += slot
        done = {s: done[s] + n for s, n in placed.items()}
        left = {s: n - placed[s] for s, n in left.items() if n > placed[s]}
    return out


def _key(source: str):
    """A source's name as a key that is never null."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def schedule(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    block: int | None = None,
    alpha: float = ALPHA,
    seed: int = SEED,
    doc_id: str = "doc_id",
    source: str = "source",
    ties: tuple[str, ...] = (),
    prefix: str = "",
) -> DataFrame:
    """``docs`` with columns ``block, place, slot, position, release, deadline`` (long, after ``prefix``).

    ``position`` counts all rows from zero in the order of the mixture; ``release`` and ``deadline`` are
    slots too. ``weights`` are by source (None: the source is null); a source that they lack, or all if
    they are not given, weighs its number of rows to the power ``alpha``, scaled to the given ones' mean.
    Weights that are zero or less are an error, since rows are neither dropped nor repeated. ``block`` is the
    number of rows of a block, by default BLOCK or as many as keep blocks to MOST. A null source is a source of
    its own. A source's rows are in the order of a hash of the id and the columns ``ties``; rows that are equal
    there are in any order. An empty table gives no rows.
    """
    p = lambda name: f"{prefix}{name}"
    key, fine, rank = p("__key"), p("__fine"), p("__rank")
    tied = [F.col(f"`{t}`") for t in ties]
    hashed = F.xxhash64(F.col(f"`{doc_id}`"), *tied, F.lit(seed))
    sized = docs.select(_key(f"`{source}`").alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    rows = {r[key]: r["n"] for r in sized.collect()}
    block = block or max(BLOCK, -(-sum(rows.values()) // MOST))
    wanted = {("n" if s is None else f"s{s}"): w for s, w in (weights or {}).items()}
    if any(w <= 0 for w in wanted.values()):
        raise ValueError("weights must be positive")
    own = {s: n**alpha for s, n in rows.items()}
    given = [s for s in rows if s in wanted]
    scale = sum(wanted[s] for s in given) / sum(own[s] for s in given) if given else 1.0
    shares = {s: wanted.get(s, own[s] * scale) for s in rows}

    # ranks within a source: rows before its hash range, plus the rank in the range
    ranges = 256
    while ranges < (1 << 20) and max(rows.values(), default=0) > ranges * TOGETHER:
        ranges *= 2
    keyed = docs.withColumn(key, _key(f"`{source}`")).withColumn(
        fine, F.shiftrightunsigned(hashed, 64 - (ranges.bit_length() - 1)).cast("int")
    )
    counted = keyed.groupBy(key, fine).agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(key, fine, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(p("__start")))
    order = Window.partitionBy(key, fine).orderBy(hashed, F.col(f"`{doc_id}`"), *tied)
    ranked = keyed.join(F.broadcast(starts) if len(rows) * ranges <= 100_000 else starts, [key, fine])
    ranked = ranked.withColumn(rank, F.row_number().over(order) - 1 + F.col(p("__start")))
    ranked = ranked.withColumn(p("block"), F.floor(F.col(rank) / block)).withColumn(p("place"), F.col(rank) % block)

    spark = docs.sparkSession
    results = ("slot", "position", "release", "deadline")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {p(x) for x in ("block", "place", *results)}]
    found = exact_slots(rows, shares, block)
    names = [key, p("block"), p("slot"), p("release"), p("deadline"), p("__at")]
    sizes = [x.shape[1] for x in found.values()]
    parts = [np.arange(n) for n in sizes], *([x[i] for x in found.values()] for i in range(4))
    flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in parts]
    of = pa.array(list(found), pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()))
    table = spark.createDataFrame(pa.table([of, *(pa.array(x) for x in flat)], names=names))
    ranked = ranked.select(*kept, key, p("block"), p("place"))
    out = ranked.join(F.broadcast(table) if sum(sizes) <= BROADCAST else table, [key, p("block")])
    made = {x: F.col(p(x)) for x in results} | {"position": F.col(p("__at")) + F.col(p("place"))}
    return out.select(*kept, p("block"), p("place"), *[made[x].cast("long").alias(p(x)) for x in results])


def mix(docs: DataFrame, partitions: int | None = None, **how) -> DataFrame:
    """The rows of ``docs``, all of them and with their columns alone, in the order of the mixture: each
    partition holds a run of it, sorted, and partitions follow one another."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = schedule(docs, prefix="__mix_", **how)
    last = docs.count()
    shard = F.floor(F.col("__mix_position") * n / max(last, 1)).cast("int")
    return placed.repartitionById(n, shard).sortWithinPartitions("__mix_position").select(*[F.col(f"`{c}`") for c in docs.columns])


def ordered(written: DataFrame, to: str = "position") -> DataFrame:
    """The rows of files that a mixture was written to, with their place in it as column ``to`` (from zero).

    However readers deal the files, a file holds a run of the mixture, files are named in its order, and a row's
    number in its file is known. ``written`` is what reading the files gave. Only counts of rows are gathered,
    one a file; there are as many as partitions that were written.
    """
    at, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    sizes = written.select(at.alias("file")).groupBy("file").agg(F.count("*").alias("n")).collect()
    starts, start = [], 0
    for r in sorted(sizes, key=lambda r: r["file"].rpartition("/")[2]):
        starts.append((r["file"], start))
        start += r["n"]
    known = written.sparkSession.createDataFrame(starts, "__file string, __start long").coalesce(1)
    placed = written.select("*", at.alias("__file"), row.alias("__row")).join(F.broadcast(known), "__file")
    columns = [F.col(f"`{c}`") for c in written.columns if c != to]
    return placed.select(*columns, (F.col("__start") + F.col("__row")).alias(to))
