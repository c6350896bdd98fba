"""SimHash near duplicates by deletion-variant signatures.

Fingerprints that differ in at most ``bits`` bits are cut into so few segments that in one of them
(or in one choice of ``take`` of them together) they differ in one bit at most. Every choice is
indexed with each of its bits wiped in turn, a one-wildcard variant; two fingerprints with at most one
differing bit there share a variant. An equality join on variants (:mod:`packed`) gives candidates, whose
full distance is verified where they meet.

Of a variant that many fingerprints share, only a spanning forest of links is made; one that very many
share is dealt in blocks, where each pair of blocks is one task's work. So a crowd of near copies yields no
list of all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.llm import common, packed
from zephyrine.llm.components import components

BITS, SHINGLE, SEGMENTS, TAKE = 4, 4, 3, 1
#: Fingerprints that may share a variant and still all be paired.
CROWD = 24
#: Fingerprints in a block of a crowded variant, and of those that one task links at once.
BLOCK = 2048
#: Parts into which a large component's rows are dealt.
SALTS = 16

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; fewer words are one shingle, none give none."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    joined = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begins = (ends - size)[: len(words) - shingle + 1].tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; signed. Zero for none."""
    n = len(hashes)
    if not n:
        return 0
    rows = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    count = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        count += np.unpackbits(rows[lo : lo + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    out = int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")
    return out - (1 << 64) if out >> 63 else out


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """The 64 majority bits of the hashes of all word shingles, repeats included; signed."""
    return majority(shingle_hashes(tokens(text), shingle))


PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` of every whole text (a signed long; null and wordless texts: zero)."""

    def make():
        return lambda cols: [cols[0], [simhash(t, shingle) for t in cols[1]]]

    return common.map_texts(docs, common.id_text(docs, doc_id, text), 1, make, PRINTS)


def signatures(bits: int = BITS, segments: int = SEGMENTS, take: int = TAKE) -> list[tuple[int, int]]:
    """(mask of the kept bits, number of the wiped bit's variant) for every choice of segments.

    Any two values at most ``bits`` apart differ at most once in some choice, since the choice of the
    ``take`` segments with the fewest differences has at most ``bits * take // segments`` of them.
    """
    if bits * take // segments > 1:
        raise ValueError(f"{take} of {segments} segments can hold {bits * take // segments} of {bits} bits")
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    out = []
    for chosen in combinations(range(segments), take):
        own = [b for s in chosen for b in range(edges[s], edges[s + 1])]
        mask = sum(1 << b for b in own)
        out += [mask & ~(1 << b) for b in own]
    return [(m, i) for i, m in enumerate(out)]


def _forest(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links that connect what is at most ``bits`` apart between two blocks (or within one).

    Nodes are visited outward from a start, so each node is reached by one link; the blocks'
    distances are computed a row at a time and never kept.
    """
    both = np.concatenate([left, right]) if left is not right else left
    split = len(left)
    same = left is right
    free = np.ones(len(both), bool)
    u: list[int] = []
    v: list[int] = []
    for start in range(len(both)):
        if not free[start]:
            continue
        free[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            lo, hi = (0, len(both)) if same else (split, len(both)) if at < split else (0, split)
            rest = np.flatnonzero(free[lo:hi]) + lo
            if not len(rest):
                continue
            near = rest[np.bitwise_count(both[rest] ^ both[at]) <= bits]
            free[near] = False
            found = near.tolist()
            # all links of a tree go to its start, so that trees are stars
            u += [int(both[start])] * len(found)
            v += both[near].tolist()
            todo += found
    return u, v


EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _crowded(groups: DataFrame, bits: int, block: int) -> DataFrame:
    """Spanning links of very large groups (column ``own``), each pair of blocks of a group by itself."""
    blocks = F.ceil(F.size("own") / block).cast("int")
    rows = groups.select(F.xxhash64("own").alias("key"), blocks.alias("blocks"), F.explode("own").alias("fp"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    dealt = dealt.select("key", "fp", "mine", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))

    def link(key, part):
        fp = part.column("fp").to_numpy().view(np.uint64)
        mine = part.column("mine").to_numpy()
        a, b = key[1].as_py(), key[2].as_py()
        left = fp[mine == a]
        u, v = _forest(left, left if a == b else fp[mine == b], bits)
        return pa.table({"u": np.array(u, np.uint64).view(np.int64), "v": np.array(v, np.uint64).view(np.int64)})

    return dealt.groupBy("key", "a", "b").applyInArrow(link, EDGES)


def links(
    prints: DataFrame, bits: int = BITS, segments: int = SEGMENTS, take: int = TAKE, crowd: int = CROWD, block: int = BLOCK
) -> DataFrame:
    """``u, v``: links between distinct fingerprints (column ``fp``) at most ``bits`` apart.

    All links are found where few share a variant; where more than ``crowd`` do, links that connect
    the same fingerprints (all of them truly within ``bits`` steps of one another) stand for them.
    """
    masks = np.array([m for m, _ in signatures(bits, segments, take)], np.uint64)
    # what tells the variants of one mask from another's
    tags = packed.mixed(np.arange(1, len(masks) + 1))
    parts = packed.parts_for(prints, prints.count() * len(masks))

    def make():
        def step(batch):
            fp = batch.column(0).to_numpy().view(np.uint64)
            keys = packed.mixed((fp[:, None] & masks) ^ tags).ravel()
            return keys, np.repeat(fp.view(np.int64), len(masks))

        return step

    def handle(value, starts, counts):
        fp = value.view(np.uint64)
        u, v = [], []
        for n in np.unique(counts[counts <= crowd]).tolist():
            own = fp[starts[counts == n][:, None] + np.arange(n)]
            for i, j in combinations(range(n), 2):
                near = np.bitwise_count(own[:, i] ^ own[:, j]) <= bits
                u.append(own[near, i])
                v.append(own[near, j])
        large = (counts > crowd) & (counts <= block)
        for at, n in zip(starts[large].tolist(), counts[large].tolist()):
            own = fp[at : at + n]
            a, b = _forest(own, own, bits)
            u.append(np.array(a, np.uint64))
            v.append(np.array(b, np.uint64))
        if u:
            yield from packed.pairs(np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64))
        yield from packed.lists(value, starts[counts > max(crowd, block)], counts[counts > max(crowd, block)])

    # fingerprints are few bytes each, but have many variants
    spread = prints.select("fp").repartition(parts, "fp")
    met = common.cut(packed.meet(packed.deal(spread, make, parts), handle))
    return met.where("u is not null").select("u", "v").unionByName(_crowded(met.where("own is not null"), bits, block))


def near_duplicates(
    docs: DataFrame,
    bits: int = BITS,
    shingle: int = SHINGLE,
    segments: int = SEGMENTS,
    take: int = TAKE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, fp, component_id``, a row per row of ``docs``.

    ``component_id`` is the smallest doc_id that can be reached over links of at most ``bits`` differing
    fingerprint bits, itself included. Texts with no words, null and empty ones too, have fingerprint
    zero and are linked like any other. Rows without a doc_id take part; their component is its smallest
    other id, or null if there is none. Equal rows get equal results; an empty table gives none.
    """
    prints = common.cut(fingerprints(docs, shingle, doc_id, text))
    distinct = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), bits, segments, take))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "root")
    single = named.where("root is null").select("fp", F.col("least").alias("component_id"))
    # a component may hold a large share of all, so its rows are dealt to several parts
    linked = named.where("root is not null").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    classes = single.unionByName(linked.join(least, ["root", "salt"]).select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
