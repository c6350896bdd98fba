"""Document fingerprints by content-defined chunking.

A rolling gear hash over the last 32 bytes decides where chunks end: until a chunk reaches its normal
size a strict mask must match, beyond it a loose one, which keeps sizes near the normal one (Xia et al.,
"FastCDC", 2016). Boundaries depend on nearby bytes only, so an edit changes the chunks around it and the
rest stay. A text's fingerprint is the set of its chunks' digests with their lengths; the share of one
set's length that another set holds measures containment.

The gear hash is a sum over a window, so all positions of a batch are hashed at once, by doubling.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.llm import common

#: Least, normal and greatest bytes of a chunk; the greatest fits seven bits.
LEAST, NORMAL, GREATEST = 16, 48, 127
#: Top bits of the hash that must be zero before and beyond the normal size.
STRICT, LOOSE = 7, 4
WINDOW = 32

#: A pseudo-random number for each byte, by which the hash of a window mixes.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 17) for b in range(256)], np.uint32)


def hashes(parts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """The gear hash at every byte of each part, and where each part begins. Gaps keep parts apart."""
    gap = b"\x00" * WINDOW
    joined = np.frombuffer(gap.join(parts) + gap, np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.concatenate([[0], np.cumsum(sizes + WINDOW)[:-1]])
    h = GEAR[joined]
    for end in (begins + sizes).tolist():
        h[end : end + WINDOW] = 0
    reach = 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h, begins.tolist()


def chunk_ends(h: np.ndarray, begins: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """The ends of each part's chunks, from its beginning."""
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE)))
    strict = (h[loose] < np.uint32(1 << (32 - STRICT))).tolist()
    loose = loose.tolist()
    n = len(loose)
    k = 0
    for begin, size in zip(begins, sizes):
        ends: list[int] = []
        at, stop = begin, begin + size
        while stop - at > LEAST:
            k = bisect_left(loose, at + LEAST - 1, k)
            normal, top = at + NORMAL, min(at + GREATEST, stop)
            end = top
            i = k
            while i < n:
                x = loose[i] + 1
                if x >= top:
                    break
                if x >= normal or strict[i]:
                    end = x
                    break
                i += 1
            ends.append(end - begin)
            at = end
        if at < stop:
            ends.append(size)
        yield ends


def chunk_sets(texts: list[str]) -> list[dict[int, int]]:
    """For each text its chunks: digest (57 bits) and, in the low 7 bits, length -> length."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    h, begins = hashes(parts)
    digest = xxhash.xxh3_64_intdigest
    out = []
    for part, ends in zip(parts, chunk_ends(h, begins, [len(p) for p in parts])):
        view = memoryview(part)
        own, lo = {}, 0
        for hi in ends:
            own[digest(view[lo:hi]) >> 7 << 7 | hi - lo] = hi - lo
            lo = hi
        out.append(own)
    return out


def fingerprint(own: dict[int, int]) -> str:
    """The set as text: 16 hex digits a chunk, in ascending order; empty for an empty text."""
    return np.sort(np.fromiter(own, np.uint64, len(own))).astype(">u8").tobytes().hex()


def parse(said: str) -> dict[int, int]:
    """The set that a fingerprint stands for."""
    return {int(x): int(x) & 127 for x in np.frombuffer(bytes.fromhex(said), ">u8")}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of ``a``'s length in chunks that ``b`` has too. Nothing is contained in an empty
    set but another empty one, which is contained wholly in anything empty."""
    total = sum(a.values())
    if not total:
        return float(not b)
    return sum(a[x] for x in a.keys() & b.keys()) / total


PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fingerprint", T.StringType())])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every whole text (null: as empty). Equal texts have equal ones."""

    def make():
        return lambda cols: [cols[0], [fingerprint(x) for x in chunk_sets(cols[1])]]

    return common.map_texts(docs, common.id_text(docs, doc_id, text), 1, make, PRINTS)


EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def edited(text: str, other: str) -> str:
    """``text`` with its last third (rounded down) replaced by as much of the beginning of ``other``."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def _compare(ids: list, texts: list[str], last_sets: dict | None) -> tuple[list, dict]:
    """Rows for all of ``texts`` but the last, which is only the next of the one before it."""
    more = [edited(a, b) for a, b in zip(texts, texts[1:])]
    if last_sets is None:
        sets = chunk_sets(texts + more)
        own, changed = sets[: len(texts)], sets[len(texts) :]
    else:
        sets = chunk_sets(texts[1:] + more)
        own, changed = [last_sets, *sets[: len(texts) - 1]], sets[len(texts) - 1 :]
    prints = [fingerprint(x) for x in own[:-1]]
    return [
        ids[:-1],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in more],
        prints,
        [fingerprint(x) for x in changed],
        [containment(a, b) for a, b in zip(own, changed)],
        [containment(a, b) for a, b in zip(own, own[1:])],
    ], own[-1]


def against_next(docs: DataFrame, partitions: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """EDITED for every row: its text's fingerprint against that of its edited text and that of the next
    document, in descending order of doc_id; the first comes after the last.

    Rows with one id follow one another by text; rows without an id come last, by a hash of the text. Null texts
    count as empty.
    A single row is its own next one. An empty table gives no rows.

    Rows are dealt by ranges of ids, so only each range's first row has to be known to another: it is
    sent there too.
    """
    spark = docs.sparkSession
    common.ship(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*common.id_text(docs, doc_id, text))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []), reverse=True)
    # range 0 has the largest ids; rows without an id are dealt to ranges of their own
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit(""))))
    seen = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    bits = min(16, max(1, math.ceil(math.log2(max(1.0, (seen["n"] - seen["named"]) * n / max(seen["n"], 1))))))
    last = F.shiftright(mark, 64 - bits).cast("int") + (1 << (bits - 1)) + len(cuts) + 1
    part = F.when(F.col("doc_id").isNull(), last).otherwise(F.aggregate(bounds, F.lit(0), lambda acc, c: acc + (F.col("doc_id") < c).cast("int")))
    ranges = len(cuts) + 1 + (1 << bits)
    marked = rows.withColumn("mark", mark)
    firsts = marked.select(part.alias("part"), "doc_id", "mark").groupBy("part").agg(F.max("doc_id").alias("doc_id"), F.min("mark").alias("mark")).orderBy("part").collect()
    heads = [(r["part"], r["doc_id"], r["mark"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    if not heads:
        heads = [(-1, None, None, -1)]
    head = F.broadcast(spark.createDataFrame(heads, "part int, head long, head_mark long, before int").coalesce(1))
    dealt = marked.withColumn("part", part).join(head, "part")
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("extra"))
    there = F.struct(F.col("before").alias("part"), F.lit(1).alias("extra"))
    first = F.col("doc_id").eqNullSafe(F.col("head")) & F.col("mark").eqNullSafe(F.col("head_mark"))
    dealt = dealt.select("doc_id", "mark", "text", F.inline(F.when(first, F.array(here, there)).otherwise(F.array(here))))
    ordered = dealt.repartitionById(ranges, F.col("part")).sortWithinPartitions(
        "extra", F.desc_nulls_last("doc_id"), "mark", F.asc_nulls_first("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(EDITED)
        held: tuple | None = None  # the row whose next one is not known yet
        sets = None
        closed = False
        for ids, texts, extra in common.chunks(batches, 1):
            if closed:
                continue
            if 1 in extra:
                stop = extra.index(1) + 1
                ids, texts, closed = ids[:stop], texts[:stop], True
            if held is not None:
                ids, texts = [held[0], *ids], [held[1], *texts]
            out, sets = _compare(ids, texts, sets if held is not None else None)
            held = (ids[-1], texts[-1])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return ordered.select("doc_id", "text", "extra").mapInArrow(run, EDITED)
