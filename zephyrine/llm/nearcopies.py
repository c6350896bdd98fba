"""Near copies by SimHash, completed to an exact bound: Jaccard similarity of word shingles, none missed.

Links are verified on the whole sets of distinct shingles. Candidates come from two sources.

* SimHash (:mod:`simhash`): fingerprints over the same shingles, linked by deletion variants.
* What fingerprints cannot reach: at a similarity of 0.8 two fingerprints differ in about 10 of 64 bits, for
  which no cut into segments leaves one difference in a segment long enough to select. In any fixed order of
  all shingles, two sets that similar share one of their first ``n - ceil(bound * n) + 1`` (prefix filter;
  Chaudhuri, Ganti and Kaushik, 2006). Shingles of many texts come last in the order; which they are is
  estimated from a sample, which changes the work that is done, never the pairs that are found.

Sets that share a first shingle are grouped under the least of them, their hub. Shingles of one crowd of near
copies mostly have the same few hubs, so a set is in few groups, and any two sets that share a first shingle
are in one. Within a group, sets of different components are compared by bitmaps: a bit in which two differ
stands for a shingle that only one has, so pairs with too many such bits are not similar, for certain (Sandes,
Teodoro and Melo, 2020). Of the others, first only a forest of the closest is verified. Sets that may then still
be similar to one of another component are brought together whole, group by group, and linked where they are.
Large groups are dealt in blocks, and no group yields all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.llm import common, packed, simhash
from zephyrine.llm.components import components

WORDS = 5
#: Least similarity, as a fraction.
SIMILAR = (4, 5)
#: One text in so many is read to tell common shingles, those in so many of its texts or more; at most so many are told.
SAMPLE, OFTEN, TOLD = 8, 3, 500_000
#: Rows of keys that are broadcast, at most; beyond it they are joined by shuffles.
BROADCAST = 1_000_000
#: Sets that are compared at once, and bytes of their bitmaps.
BLOCK, BLOCK_BYTES = 1024, 4 << 20


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles, in ascending order; a shorter text is one shingle."""
    return np.unique(simhash.shingle_hashes(simhash.tokens(text), words).view(np.int64))


def bitmap(own: np.ndarray) -> bytes:
    """Four bits or more a shingle, each shingle sets one; a whole power of two of them, and whole words."""
    width = 1 << max(6, (4 * len(own) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[own & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def near_pairs(
    n: np.ndarray, bits: list[bytes], similar: tuple[int, int], side: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of sets (by their sizes and bitmaps) that may be similar, and how far below what is allowed
    their differing bits are; all others are not similar. A wider bitmap is folded to the narrower one's width.
    With ``side`` (true or false for each set), only pairs of one and the other side."""
    p, q = similar
    order = np.argsort(n, kind="stable")
    n = n[order]
    side = None if side is None else side[order]
    maps: dict[int, np.ndarray] = {}
    widths = np.array([len(bits[i]) for i in order]) // 8
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))]
    # by size, widths ascend
    edges = np.append(np.flatnonzero(np.append(True, widths[1:] != widths[:-1])), len(n))
    for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
        width = int(widths[lo])
        # what is wider is folded, as far as sizes allow a pair at all
        top = int(np.searchsorted(n, n[hi - 1] * q // p, side="right"))
        rows = np.empty((top - lo, width), np.uint64)
        for k in range(lo, top):
            x = np.frombuffer(bits[order[k]], np.uint64)
            while len(x) > width:
                x = x[: len(x) // 2] | x[len(x) // 2 :]
            rows[k - lo] = x
        # what each row is compared with, in ascending order
        use = [np.arange(lo, top)] if side is None else [np.flatnonzero(side[lo:top] != x) + lo for x in (False, True)]
        maps = [rows] if side is None else [rows[x - lo] for x in use]
        for k in range(lo, hi):
            which = 0 if side is None else int(side[k])
            end = int(np.searchsorted(n, n[k] * q // p, side="right"))
            first, last = np.searchsorted(use[which], (k + 1, end)).tolist()
            if first >= last:
                continue
            later = use[which][first:last]
            both = n[k] + n[later]
            allowed = both - 2 * -(-p * both // (p + q))
            differ = np.bitwise_count(maps[which][first:last] ^ rows[k - lo]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(differ <= allowed)
            out.append((np.full(len(near), k), later[near], (allowed - differ)[near]))
    i, j, room = (np.concatenate(x) for x in zip(*out))
    return order[i], order[j], room


def _name(own: np.ndarray) -> int:
    """A hash of a whole set, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).astype(np.int64))


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    i, t = common.id_text(docs, doc_id, text)
    return docs.select(i, F.xxhash64(t).alias("mark"), t)


WHOLE = T.StructType([T.StructField("set", T.LongType()), T.StructField("own", T.BinaryType())])
SETS = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "mark", "set", "n", "fp")] + [T.StructField(c, T.BinaryType()) for c in ("first", "bits")])


def wholes(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``set, own``: the name and the shingles (64-bit numbers in ascending order) of every text."""

    def make():
        def step(cols):
            own = [shingles(t, words) for t in cols[0]]
            return [[_name(s) for s in own], [s.tobytes() for s in own]]

        return step

    return common.map_texts(texts, ["text"], 0, make, WHOLE)


def often(marked: DataFrame, words: int) -> np.ndarray:
    """Shingles that many texts have, by a sample of the texts."""

    def make():
        def step(cols):
            return [np.concatenate([shingles(t, words) for t in cols[0]])]

        return step

    sample = marked.where(F.pmod("mark", F.lit(SAMPLE)) == 0).dropDuplicates(["mark"])
    each = common.map_texts(sample, ["text"], 0, make, T.StructType([T.StructField("word", T.LongType())]))
    many = each.groupBy("word").agg(F.count("*").alias("times")).where(F.col("times") >= OFTEN)
    return np.sort(many.orderBy(F.desc("times"), "word").limit(TOLD).select("word").toArrow().column("word").to_numpy())


def sets(marked: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``doc_id, mark, set, n, fp, first, bits`` of every row: a hash of its text; the name and size of its set;
    the SimHash fingerprint; the shingles of which the set must share one with every similar set; the bitmap.
    The last two are left out (null) where the same task has given them for the same set before."""
    p, q = similar
    shared = marked.sparkSession.sparkContext.broadcast(often(marked, words))

    def make():
        told = shared.value
        given: set[int] = set()

        def front(own: np.ndarray) -> bytes:
            n = len(own)
            if len(told) and n:
                late = told[np.minimum(np.searchsorted(told, own), len(told) - 1)] == own
                own = np.concatenate([own[~late], own[late]])
            return own[: n - (p * n + q - 1) // q + 1 if n else 0].tobytes()

        def step(cols):
            out = [cols[0], cols[1], [], [], [], [], []]
            for text in cols[2]:
                every = simhash.shingle_hashes(simhash.tokens(text), words)
                own = np.unique(every.view(np.int64))
                name = _name(own)
                new = name not in given
                if new and len(given) < 1 << 18:
                    given.add(name)
                row = (name, len(own), simhash.majority(every), front(own) if new else None, bitmap(own) if new else None)
                for c, x in zip(out[2:], row):
                    c.append(x)
            return out

        return step

    return common.map_texts(marked, ["doc_id", "mark", "text"], 2, make, SETS)


def _narrow(keys: DataFrame) -> DataFrame:
    """Keys, written out; to be broadcast if they are few."""
    keys = common.cut(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def hubs(found: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """``hub, set``: of each group of sets that share a first shingle, the least set and every other."""
    entries = (found.agg(F.sum(F.length("first"))).first()[0] or 0) // 8
    rows = found.where("first is not null").select("set", "first")

    def make():
        def step(batch):
            first = batch.column(1)
            times = np.array([len(x.as_buffer()) // 8 for x in first], np.int64)
            keys = np.frombuffer(b"".join([x.as_py() for x in first]), np.uint64)
            return keys, np.repeat(batch.column(0).to_numpy(), times)

        return step

    def handle(value, starts, counts):
        hub = np.repeat(value[starts], counts)
        other = value != hub
        yield from packed.pairs(hub[other], value[other])

    met = packed.meet(packed.deal(rows, make, packed.parts_for(found, entries)), handle)
    return common.cut(met.select(F.col("u").alias("hub"), F.col("v").alias("set")).distinct())


def _wholes_of(need: DataFrame, found: DataFrame, marked: DataFrame, words: int) -> DataFrame:
    """:func:`wholes` of the distinct sets ``need``, written out."""
    marks = found.select("set", "mark").join(_narrow(need), "set").groupBy("set").agg(F.min("mark").alias("mark")).select("mark")
    texts = marked.join(_narrow(marks.distinct()), "mark").select("mark", "text")
    return common.cut(wholes(texts, words).dropDuplicates(["set"]))


def _alike(a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> bool:
    p, q = similar
    return len(np.intersect1d(a, b, assume_unique=True)) * (p + q) >= p * (len(a) + len(b))


def _similar(pairs: DataFrame, found: DataFrame, marked: DataFrame, words: int, similar: tuple[int, int]) -> DataFrame:
    """Those of the distinct pairs ``u, v`` whose whole sets are similar."""
    pairs = common.cut(pairs)
    whole = _wholes_of(pairs.select(F.col("u").alias("set")).union(pairs.select("v")).distinct(), found, marked, words)
    both = pairs.join(whole.select(F.col("set").alias("u"), F.col("own").alias("a")), "u")
    both = both.join(whole.select(F.col("set").alias("v"), F.col("own").alias("b")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [_alike(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64), similar) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(mask, pa.bool_()))

    return common.cut(both.select("u", "v", "a", "b").mapInArrow(common.released(run), "u long, v long"))


class Forest:
    """Trees of roots, joined by links."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def joins(self, x: int, y: int) -> bool:
        """Whether two roots were apart; they are not afterwards."""
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[x] = y
        return x != y


def _blocks(sets, size):
    return F.greatest(F.ceil(sets / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _dealt(rows: DataFrame, has: DataFrame, size: str) -> DataFrame:
    """``a, b, own, hub``: the rows of each group (``hub, set, root, n, bytes``), in blocks of so many rows or bytes of
    column ``size`` of ``has`` (by ``set``): two blocks, or one and the same, and the structs ``set, root, n, <size>, mine``
    of their rows.

    Rows of one component need not meet. So the blocks of a group's largest component (by bytes) meet those of
    all others, not one another, and a group that is nearly one component is not multiplied."""
    each = rows.groupBy("hub", "root").agg(F.count("*").alias("sets"), F.sum("bytes").alias("bytes"))
    sums = each.groupBy("hub").agg(F.sum("sets").alias("sets"), F.sum("bytes").alias("bytes"), F.max(F.struct("bytes", "root", "sets")).alias("main"))
    few, many = _blocks(F.col("sets") - F.col("main.sets"), F.col("bytes") - F.col("main.bytes")), _blocks(F.col("main.sets"), F.col("main.bytes"))
    large = sums.where(_blocks(F.col("sets"), F.col("bytes")) > 1).select("hub", F.col("main.root").alias("main"), few.alias("few"), many.alias("many"))
    rows = rows.join(_narrow(large), "hub", "left").withColumn("most", F.coalesce(F.col("root") == F.col("main"), F.lit(False)))
    few, many = F.coalesce("few", F.lit(1)), F.coalesce("many", F.lit(0))
    number = F.xxhash64("set")
    rows = rows.withColumn("mine", F.when(F.col("most"), few + F.pmod(number, F.greatest(many, F.lit(1)))).otherwise(F.pmod(number, few)).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("most"), few).otherwise(few + many) - 1).alias("other")
    one = F.struct("set", "root", "n", size, "mine")
    rows = rows.select("hub", "set", "root", "n", "mine", others).join(has.select("set", size), "set")
    rows = rows.withColumn("other", F.explode("other"))
    out = rows.groupBy("hub", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")).agg(F.collect_list(one).alias("own"))
    return out.select("a", "b", "own", "hub")


def _scattered(rows: DataFrame, has: DataFrame) -> DataFrame:
    """``a, b, own`` as of :func:`_dealt`, but not all pairs of a group meet: a set is in one large group only, and there
    in two blocks, by two hashes."""
    sizes = rows.groupBy("hub").agg(_blocks(F.count("*"), F.sum("bytes")).alias("blocks"))
    large = _narrow(sizes.where("blocks > 1"))
    first = rows.join(large, "hub").groupBy("set").agg(F.min("hub").alias("one"))
    rows = rows.join(large, "hub", "left").join(first, "set", "left").where("blocks IS NULL OR hub = one")
    times = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))).alias("times")
    rows = rows.select("hub", "set", "root", "n", F.coalesce("blocks", F.lit(1)).alias("blocks"), times)
    rows = rows.join(has.select("set", "bits"), "set").withColumn("time", F.explode("times"))
    rows = rows.withColumn("mine", (F.col("time") * F.col("blocks") + F.pmod(F.xxhash64("set", "time"), F.col("blocks"))).cast("int"))
    out = rows.groupBy("hub", F.col("mine").alias("a")).agg(F.collect_list(F.struct("set", "root", "n", "bits", "mine")).alias("own"))
    return out.select("a", F.col("a").alias("b"), "own")


def _between(own: pa.StructArray, a: int, b: int, bits: list[bytes], similar: tuple[int, int]):
    """Names and roots of a block's sets, and the places of those pairs of different roots (and of both blocks) that
    may be similar, the closest first, with how close they are."""
    name, root, mine, n = (own.field(k).to_numpy(zero_copy_only=False) for k in ("set", "root", "mine", "n"))
    i, j, room = near_pairs(n, bits, similar, mine == a if a != b else None)
    use = root[i] != root[j]
    i, j, room = i[use], j[use], room[use]
    order = np.argsort(-room, kind="stable")
    return name, root, i[order], j[order], room[order]


def _closest(rows: DataFrame, info: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Pairs ``u, v`` of sets in a group (``hub, set, root, n, bytes``; ``info``: their ``bits``) that may be similar: of a forest of the closest
    in each block of :func:`_scattered`, those of which one is the other's closest in all."""
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                name, root, i, j, room = _between(own.values, a, b, own.values.field("bits").to_pylist(), similar)
                trees = Forest()
                kept = [k for k, (x, y) in enumerate(zip(root[i].tolist(), root[j].tolist())) if trees.joins(x, y)]
                # a link for either end
                u, v = name[i[kept]], name[j[kept]]
                ends = [pa.array(np.concatenate(x)) for x in ((u, v), (v, u), (room[kept], room[kept]))]
                yield pa.RecordBatch.from_arrays(ends, names=["u", "v", "room"])

    found = _scattered(rows, info).mapInArrow(common.released(run), "u long, v long, room long")
    each = found.groupBy("u").agg(F.max_by("v", F.struct("room", "v")).alias("v"))
    return each.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _undecided(rows: DataFrame, info: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """``hub, set`` of the sets in a group that may be similar to one of another component."""
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own, hub in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                name, _, i, j, _ = _between(own.values, a, b, own.values.field("bits").to_pylist(), similar)
                left = name[np.unique(np.concatenate([i, j]))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(left), hub, np.int64)), pa.array(left)], names=["hub", "set"])

    return _dealt(rows, info, "bits").mapInArrow(common.released(run), "hub long, set long").distinct()


def _linked(rows: DataFrame, whole: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """``u, v``: links of similar sets in a group (``hub, set, root, n``; ``whole``: ``own`` of each) that connect what all
    such links would."""
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                whole = [np.frombuffer(x, np.int64) for x in own.values.field("own").to_pylist()]
                name, root, i, j, _ = _between(own.values, a, b, [bitmap(x) for x in whole], similar)
                trees, u, v = Forest(), [], []
                for x, y in zip(i.tolist(), j.tolist()):
                    r, s = int(root[x]), int(root[y])
                    if trees.top(r) != trees.top(s) and _alike(whole[x], whole[y], similar):
                        trees.joins(r, s)
                        u.append(name[x])
                        v.append(name[y])
                yield from packed.pairs(np.array(u, np.int64), np.array(v, np.int64))

    return common.cut(_dealt(rows.withColumn("bytes", F.col("n") * 8), whole, "own").select("a", "b", "own").mapInArrow(common.released(run), packed.MET).select("u", "v").distinct())


def _rooted(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``members`` of groups with more than one component, with the component of each."""
    roots = components(edges).withColumnRenamed("node", "set")
    rows = members.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    mixed = rows.groupBy("hub").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("hub")
    return rows.join(_narrow(mixed), "hub")


def groups(found: DataFrame, marked: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``set, root`` of every set that has a similar one; root is the least of its component."""
    # by fingerprints: equal ones, and those that deletion variants link
    prints = common.cut(found.groupBy("fp").agg(F.min("set").alias("least")))
    same = found.select("fp", "set").distinct().join(prints, "fp").where("set <> least").select(F.col("least").alias("u"), F.col("set").alias("v"))
    linked = simhash.links(prints.select("fp"))
    linked = linked.join(prints.select(F.col("fp").alias("u"), F.col("least").alias("x")), "u")
    linked = linked.join(prints.select(F.col("fp").alias("v"), F.col("least").alias("y")), "v").select("x", "y")
    # one link of each is enough here: what they leave out is found below
    linked = linked.where("x <> y").groupBy(F.greatest("x", "y").alias("v")).agg(F.min(F.least("x", "y")).alias("u"))
    edges = _similar(same.unionByName(linked).distinct(), found, marked, words, similar)
    # by first shingles
    # bitmaps, which are long beside all else, join what is left when it is dealt
    info = common.cut(found.where("bits is not null").select("set", "n", "bits").dropDuplicates(["set"]))
    met = hubs(found, similar)
    every = met.unionByName(met.select("hub", F.col("hub").alias("set")).distinct())
    members = common.cut(every.join(info.select("set", "n", F.length("bits").cast("long").alias("bytes")), "set"))
    edges = edges.unionByName(_similar(_closest(_rooted(members, edges), info, similar), found, marked, words, similar))
    common.tidy(marked.sparkSession)
    rows = _rooted(members, edges)
    left = common.cut(_undecided(rows, info, similar))
    common.tidy(marked.sparkSession)
    whole = _wholes_of(left.select("set").distinct(), found, marked, words)
    rows = rows.select("hub", "set", "root", "n").join(left, ["hub", "set"])
    return components(edges.unionByName(_linked(rows, whole, similar))).withColumnRenamed("node", "set")


def one_of_each(
    docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component of near copies.

    Two texts are linked if the Jaccard similarity of their distinct word shingles is ``similar`` or more;
    texts without words, null and empty ones too, are copies of one another. The row with the least id stays
    (no id comes last), of these one by a hash of the text, and of equal ones the first by a hash of all columns.
    Ids need not be unique; columns may have any names. An empty table gives no rows.
    """
    marked = _marked(docs, doc_id, text)
    found = common.cut(sets(marked, words, similar))
    rows = found.select("doc_id", "mark", "set").join(groups(found, marked, words, similar), "set", "left")
    rows = common.cut(rows.select(F.coalesce("root", "set").alias("root"), "doc_id", "mark"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    stay = rows.groupBy("root").agg(first.alias("x")).select("x.doc_id", "x.mark")
    # how often each id and text occurs, and whether it stays
    times = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("times")).alias("t")
    same = lambda a, b, c, d: a.eqNullSafe(b) & c.eqNullSafe(d)
    kept = times.join(stay.alias("s"), same(F.col("t.doc_id"), F.col("s.doc_id"), F.col("t.mark"), F.col("s.mark")), "left")
    said = common.cut(kept.select("t.doc_id", "t.mark", "times", F.col("s.mark").isNotNull().alias("stays")))
    # what goes, and what stays but occurs repeatedly, is little beside all texts, which so need no shuffle
    other = _narrow(said.where("NOT stays OR times > 1").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__own"), F.col("stays").alias("__stays")))
    keyed = docs.withColumn("__mark", F.xxhash64(F.col(f"`{text}`").cast("string")))
    this = same(F.col(f"`{doc_id}`").cast("long"), F.col("__id"), F.col("__mark"), F.col("__own"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(other, this, "left_anti").select(*columns)
    if said.where("stays AND times > 1").isEmpty():
        return once
    order = Window.partitionBy("__id", "__own").orderBy(F.xxhash64(*columns))
    again = keyed.join(other.where("__stays"), this).withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
    return once.unionByName(again.select(*columns))
