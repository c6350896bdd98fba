"""Equality joins of very many narrow entries: a key and a signed number each.

Entries are dealt to parts by their key. A task writes those of one part as one packed value, so that a
shuffle carries 14 bytes an entry and no rows; a part is unpacked, sorted and grouped as arrays. A key is
kept to 48 bits, and keys that only differ beyond are taken for one: whoever uses the groups verifies what
met in them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from zephyrine.llm import common

ENTRY = np.dtype([("low", "<u4"), ("high", "<u2"), ("value", "<i8")])
#: Entries of a part, on average.
ENTRIES = 500_000
#: The pairs ``u, v`` that groups give, or a whole group ``own``.
MET = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("own", T.ArrayType(T.LongType()))])

Entries = tuple[np.ndarray, np.ndarray]  # keys (64 bits, unsigned), numbers


def parts_for(df: DataFrame, entries: int) -> int:
    """Into how many parts so many entries go."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-entries // ENTRIES), min(least, -(-entries // 50_000)))


def deal(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Entries]], parts: int) -> DataFrame:
    """The entries that ``make()`` gives for each batch of ``df``, packed and dealt to ``parts`` partitions."""
    common.ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            keys, values = step(batch)
            if not len(keys):
                continue
            part = (keys % np.uint64(parts)).astype(np.int32)
            keys = keys // np.uint64(parts)
            order = np.argsort(part, kind="stable")
            out = np.empty(len(keys), ENTRY)
            out["low"], out["high"] = (keys & np.uint64(0xFFFFFFFF))[order], (keys >> np.uint64(32) & np.uint64(0xFFFF))[order]
            out["value"] = values[order]
            part = part[order]
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            data = [x.tobytes() for x in np.split(out, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(data, pa.binary())], names=["part", "data"])

    return df.mapInArrow(common.released(run), "part int, data binary").repartitionById(parts, "part")


def meet(dealt: DataFrame, handle: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """MET rows that ``handle`` makes of a part's groups of two distinct numbers or more: the numbers, group
    after group and in ascending order, where each group begins, and how many it has."""
    common.ship(dealt.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_buffer(), ENTRY) for batch in batches for x in batch.column(1)]
        if not held:
            return
        every = np.concatenate(held)
        held.clear()
        key = every["high"].astype(np.uint64) << np.uint64(32) | every["low"]
        value = every["value"].copy()
        del every
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        first = np.append(True, key[1:] != key[:-1])
        new = first | np.append(True, value[1:] != value[:-1])
        first, value = first[new], value[new]
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(value)))
        many = np.repeat(counts > 1, counts)
        value, counts = value[many], counts[counts > 1]
        if len(counts):
            yield from handle(value, np.cumsum(counts) - counts, counts)

    return dealt.mapInArrow(common.released(run), MET)


def pairs(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    """MET rows of distinct pairs, the lesser number first."""
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
    for lo in range(0, len(both), 1 << 17):
        part = both[lo : lo + (1 << 17)]
        none = pa.nulls(len(part), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1]), none], names=MET.fieldNames())


def lists(value: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """MET rows of whole groups."""
    at = 0
    while at < len(starts):
        to = at + 1
        while to < len(starts) and starts[to] + counts[to] - starts[at] <= 1 << 18:
            to += 1
        own = [value[s : s + n] for s, n in zip(starts[at:to].tolist(), counts[at:to].tolist())]
        ends = np.concatenate([[0], np.cumsum(counts[at:to])]).astype(np.int32)
        column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
        none = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, column], names=MET.fieldNames())
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose every bit depends on every bit of ``x``; no two are alike (Steele et al., 2014)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
