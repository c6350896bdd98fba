"""Language-model scores by a class-based bigram model.

A word's probability is that of its class after the previous word's class, times its own within its class
(Brown et al., 1992). Classes come from the exchange algorithm over the bigrams of all training text: a
unit is moved to the class that raises the likelihood most.

Every word that makes up a set share of the training tokens or more is a unit of its own, so their number
is bounded by arithmetic. Rarer words, seen or not, belong to the unit of their last three bytes where these
make up that share, else of their last two. The most frequent units are exchanged one by one over their own
bigrams until nothing moves. Then all units are: in each round the cluster counts what classes stand before
and after each unit, and the driver moves one unit after another by these counts (as in Uszkoreit and Brants,
"Distributed word clustering", 2008). A round counts only if the likelihood over all bigrams, counted anew,
has risen, so it never falls.

Units are bounded so that the driver can move them one by one. The other words that occur LEAST times or more,
whatever their number, are then exchanged in the cluster: each one's class bigrams meet in one part, which moves
it from its ending's class to where the likelihood is highest. This too counts only if the likelihood has risen.

Counts are kept for every word. Frequent ones are broadcast up to a fixed number; the rest of a document's
words meet their counts in a join, where each contributes a term that only depends on its count.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.llm import common
from zephyrine.llm.bpe import Shared

#: Words whose counts are broadcast, at most (or as many as are units).
HEAD = 200_000
#: A word or ending of one in so many training tokens, and of LEAST tokens, is a unit; so there are at most so many of each.
SHARE, LEAST = 40_000, 5
#: Units that are exchanged over their own bigrams first.
CORE = 1024
CLASSES, ROUNDS = 40, 10
#: Rounds over all units, and over all words that are none.
ALL_ROUNDS, WORD_ROUNDS = 3, 1
#: Tokens in a stored sequence, about.
SEQUENCE = 1 << 20
#: Distinct words that a task counts before it passes them on, and that a worker remembers.
HELD = 300_000
#: Added to each count, of a word or of unknown words together.
DELTA = 0.5
#: Weight, in observations a class, of how frequent a class is at all, for transitions.
PRIOR = 1.0

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def tokens(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case. The end is not among them."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


COUNTED = T.StructType([T.StructField("word", T.StringType()), T.StructField("c", T.LongType())])


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over all rows of ``texts`` (a column ``text``), without ends."""
    common.ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

        held: Counter = Counter()
        for (own,) in common.chunks(batches, 0):
            for text in own:
                held.update(tokens(text))
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return texts.select("text").mapInArrow(run, COUNTED).groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int, sure: int) -> tuple[list[tuple[bytes, int]], int]:
    """All words from some count on, at most ``most`` of them or those of count ``sure``, and that count.

    The count is chosen by a histogram over fine logarithmic steps, so nothing is sorted or gathered
    but the words that are returned.
    """
    step = F.floor(F.log2("c") * 32).cast("int")
    sizes = sorted(((r["s"], r["n"], r["m"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("c").alias("m")).collect()), reverse=True)
    total, least = 0, sure
    for _, n, m in sizes:
        if total + n > most:
            break
        total, least = total + n, min(m, sure)
    rows = counts.where(F.col("c") >= least).toArrow()
    found = [(w.encode("utf-8", "surrogatepass"), c) for w, c in zip(rows.column("word").to_pylist(), rows.column("c").to_pylist())]
    found.sort(key=lambda x: (-x[1], x[0]))
    return found, least


def bound(tokens_: int) -> int:
    """The count from which on a word is a unit; rarer ones of LEAST or more are exchanged by :func:`placed`."""
    return max(LEAST, -(-tokens_ // SHARE))


def units(counts: DataFrame, tokens_: int) -> dict[bytes, int]:
    """Word or ending -> unit. An ending's key is its bytes after a space (three bytes) or two; unit 0 is the
    end of a text, the last one is that of words with unknown endings. More frequent units come first."""
    least = bound(tokens_)

    def found(rows: DataFrame, prefix: bytes) -> list[tuple[int, bytes]]:
        got = rows.select(F.col("word").cast("binary"), "c").toArrow()
        return [(c, prefix + w) for w, c in zip(got.column(0).to_pylist(), got.column(1).to_pylist())]

    def ending(n: int) -> DataFrame:
        raw = F.col("word").cast("binary")
        rare = counts.where(F.col("c") < least)
        return rare.groupBy(F.substring(raw, -n, n).alias("word")).agg(F.sum("c").alias("c"))

    every = found(counts.where(F.col("c") >= least), b"") + found(ending(3).where(F.col("c") >= least), b" ") + found(ending(2), b"  ")
    every.sort(key=lambda x: (-x[0], x[1]))
    return {w: i + 1 for i, (_, w) in enumerate(every)}


class Units:
    """Word -> unit, with a bounded memory."""

    def __init__(self, own: dict[bytes, int]):
        self.own = own
        self.seen = dict(own)

    def of(self, words: list[bytes]) -> list[int]:
        get, learn = self.seen.get, self.learn
        return [get(w) or learn(w) for w in words]

    def learn(self, word: bytes) -> int:
        if len(self.seen) > HELD + len(self.own):
            self.seen = dict(self.own)
        get = self.own.get
        u = self.seen[word] = get(b" " + word[-3:]) or get(b"  " + word[-2:]) or len(self.own) + 1
        return u


#: Bits of the hash by which a word that is no unit is known; words that agree in it share a class.
KEY = (1 << 48) - 1


def key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & KEY


@dataclass
class Placed:
    """Classes of words that are no units: their keys, in ascending order, and the class of each."""

    keys: np.ndarray
    classes: np.ndarray

    @staticmethod
    def none() -> Placed:
        return Placed(np.zeros(0, np.int64), np.zeros(0, np.uint8))

    def put(self, keys: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """``classes``, with that of each key that is placed in its stead."""
        if not len(self.keys):
            return classes
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.classes[at], classes)


class Classes:
    """Word -> class."""

    def __init__(self, own: dict[bytes, int], of: np.ndarray, placed: Placed):
        self.units, self.unit_class, self.placed = Units(own), of, placed

    def of(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, int)
        out = self.unit_class[self.units.of(words)]
        own = self.units.own
        rest = [i for i, w in enumerate(words) if w not in own] if len(self.placed.keys) else []
        out[rest] = self.placed.put(np.array([key(words[i]) for i in rest], np.int64), out[rest])
        return out


_MADE: dict[str, object] = {}


def made(shared: Shared, kind):
    """This worker's object over a broadcast value."""
    if shared.id not in _MADE:
        if len(_MADE) > 4:
            _MADE.clear()
        _MADE[shared.id] = kind(shared.value)
    return _MADE[shared.id]


def sequences(texts: DataFrame, own: dict[bytes, int]) -> DataFrame:
    """``ids``: the units of all of ``texts`` as 32-bit numbers, the end after each text, many texts a row; and
    ``rest``: the keys of those words that are no units, in 64 bits."""
    shared = Shared(texts.sparkSession, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = made(shared, Units)
        base = len(known.own) + 2
        # a word's number: its unit, or from ``base`` on the place of its ending's unit and its key
        number, units_of, keys = dict(known.own), [], []
        line: list[int] = []
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def learn(word: bytes) -> int:
            units_of.append(known.of([word])[0])
            keys.append(key(word))
            n = number[word] = base + len(keys) - 1
            return n

        def end() -> None:
            x = np.array(line, np.int64)
            at = np.flatnonzero(x >= base)
            own = x[at] - base
            x[at] = np.array(units_of, np.int64)[own]
            done.append((x.astype(np.int32), np.array(keys, np.int64)[own]))
            line.clear()

        def row() -> pa.RecordBatch:
            end()
            both = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays(both, names=["ids", "rest"])

        for (own_texts,) in common.chunks(batches, 0):
            get = number.get
            for text in own_texts:
                line += [get(w) or learn(w) for w in tokens(text)]
                line.append(0)
            if len(keys) > HELD:
                end()
                number, units_of, keys = dict(known.own), [], []
            if len(line) + sum(len(x) for x, _ in done) >= SEQUENCE:
                yield row()
        yield row()

    return texts.select("text").mapInArrow(run, "ids binary, rest binary")


def whole_words(own: dict[bytes, int]) -> np.ndarray:
    """Of each unit, whether it is the end or a word of its own."""
    out = np.zeros(len(own) + 2, bool)
    out[0] = True
    out[[u for w, u in own.items() if w[:1] != b" "]] = True
    return out


def _classed(ids: np.ndarray, rest: np.ndarray, of: np.ndarray, whole: np.ndarray, placed: Placed) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word of a sequence, and the places of the words that are no units."""
    at = np.flatnonzero(~whole[ids])
    classes = of[ids]
    classes[at] = placed.put(rest, classes[at])
    return classes, at


#: A word (its key, less what its part says) and what of it: the classes before and after, its own, whether it follows itself.
BESIDE = np.dtype([("low", "<u4"), ("high", "<u2"), ("code", "<u4")])
#: Occurrences of words that a task moves, about.
OCCURRENCES = 1_000_000
#: How often the words that move in a round may be halved.
HALVED = 5


def placed(rows: DataFrame, own: dict[bytes, int], of: np.ndarray, grid: np.ndarray, rounds: int = WORD_ROUNDS) -> tuple[Placed, np.ndarray]:
    """Classes of all words that are no units and occur LEAST times or more in ``rows`` of sequences, and how often
    each class follows each by them.

    A part holds a share of all such words by their hash and moves one after another, the most frequent first. On its own
    copy of the grid a move counts once for every part, as the others' words move alike meanwhile. Where all moves
    together do not raise the likelihood, half of them are taken, and so on; else the round is left out.
    """
    spark = rows.sparkSession
    common.ship(spark)
    whole = whole_words(own)
    many = rows.agg(F.sum(F.length("rest"))).first()[0] or 0
    parts = max(1, -(-many // 8 // OCCURRENCES))
    now = Placed.none()
    for _ in range(rounds if many else 0):
        shared = Shared(spark, (of, whole, now, grid.astype(float)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, whole, now, _ = shared.value
            for batch in batches:
                for x, y in zip(batch.column(0), batch.column(1)):
                    ids, rest = np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(y.as_buffer(), np.int64)
                    if not len(rest):
                        continue
                    k, at = _classed(ids, rest, of, whole, now)
                    # a sequence ends with a text's end, so every word has one after it
                    before = np.where(at > 0, k[at - 1], 0)
                    itself = np.append(False, (rest[1:] == rest[:-1]) & (at[1:] == at[:-1] + 1))
                    out = np.empty(len(rest), BESIDE)
                    part, rest = rest % parts, rest // parts
                    out["low"], out["high"] = rest & 0xFFFFFFFF, rest >> 32
                    out["code"] = before | k[at + 1] << 8 | k[at] << 16 | itself.astype(int) << 24
                    order = np.argsort(part, kind="stable")
                    out, part = out[order], part[order]
                    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                    data = [x.tobytes() for x in np.split(out, starts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(data, pa.binary())], names=["part", "data"])

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grid = shared.value[3].copy()
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                for part, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    own = np.frombuffer(x.as_buffer(), BESIDE)
                    held.append(((own["high"].astype(np.int64) << 32 | own["low"]) * parts + part, own["code"].astype(np.int64)))
            if not held:
                return
            keys, code = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(keys, kind="stable")
            keys, code = keys[order], code[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            ends = np.append(starts[1:], len(keys))
            use = np.flatnonzero(ends - starts >= LEAST)
            use = use[np.argsort(starts[use] - ends[use], kind="stable")]
            n, said = len(grid), []
            for a, b in zip(starts[use].tolist(), ends[use].tolist()):
                c = code[a:b]
                l, r = (np.bincount(c >> s & 255, minlength=n) for s in (0, 8))
                then, k = grid.copy(), int(c[0] >> 16 & 255)
                said.append(move(then, k, r, l, float((c >> 24).sum())))
                if said[-1] != k:
                    grid = np.maximum(grid + parts * (then - grid), 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts[use]]), pa.array(said, pa.int32())], names=["key", "k"])

        dealt = rows.select("ids", "rest").mapInArrow(common.released(deal), "part int, data binary").repartitionById(parts, "part")
        got = dealt.mapInArrow(common.released(moved), "key long, k int").toArrow()
        order = np.argsort(got.column("key").to_numpy(), kind="stable")
        keys, said = got.column("key").to_numpy()[order], got.column("k").to_numpy()[order].astype(np.uint8)

        def count(left, right):
            return np.bincount(left * CLASSES + right, minlength=CLASSES * CLASSES)

        for halved in range(HALVED):
            # words that do not move now stay where a round before has put them
            use = keys % (1 << halved) == 0
            old = ~np.isin(now.keys, keys[use])
            both = np.concatenate([keys[use], now.keys[old]]), np.concatenate([said[use], now.classes[old]])
            order = np.argsort(both[0], kind="stable")
            then = Placed(both[0][order], both[1][order])
            by = Shared(spark, (of, whole, then))
            counted = _summed(rows.select("ids", "rest"), count, CLASSES * CLASSES, lambda ids, rest: _classed(ids, rest, *by.value)[0])
            counted = counted.reshape(CLASSES, CLASSES)
            if likelihood(counted) > likelihood(grid):
                now, grid = then, counted
                break
        else:
            break
    return now, grid


def _summed(rows: DataFrame, count, size: int, of=None) -> np.ndarray:
    """The sum of ``count(left, right)``, an array of ``size`` numbers, over the bigrams of all sequences, or of
    what ``of`` makes of a row's columns. What is not zero is added up in the cluster."""
    common.ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for i, x in enumerate(batch.column(0)):
                own = np.frombuffer(x.as_buffer(), np.int32)
                if of is not None:
                    own = of(own, np.frombuffer(batch.column(1)[i].as_buffer(), np.int64))
                row = np.concatenate([np.zeros(1, own.dtype), own])
                held += count(row[:-1], row[1:])
        at = np.flatnonzero(held)
        for lo in range(0, len(at), 1 << 18):
            part = at[lo : lo + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part])], names=["at", "n"])

    got = rows.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def core_bigrams(rows: DataFrame, core: int) -> np.ndarray:
    """How often each of the first ``core`` units follows each."""

    def count(left, right):
        both = (left < core) & (right < core)
        return np.bincount(left[both].astype(np.int64) * core + right[both], minlength=core * core)

    return _summed(rows, count, core * core).reshape(core, core)


def class_bigrams(rows: DataFrame, of: np.ndarray, classes: int, each: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How often each class follows each, and with ``each`` for every unit: how often each class comes after
    it and before it, and how often it follows itself."""
    n, square = len(of), classes * classes
    shared = Shared(rows.sparkSession, of.astype(np.int64))

    def count(left, right):
        of = shared.value
        a, b = of[left], of[right]
        parts = [np.bincount(a * classes + b, minlength=square)]
        if each:
            parts += [np.bincount(left * np.int64(classes) + b, minlength=n * classes), np.bincount(right * np.int64(classes) + a, minlength=n * classes)]
            parts.append(np.bincount(left[left == right], minlength=n))
        return np.concatenate(parts)

    got = _summed(rows, count, square + (2 * n * classes + n if each else 0))
    grid, rest = got[:square].reshape(classes, classes), got[square:]
    if not each:
        return grid, rest, rest, rest
    half = n * classes
    return grid, rest[:half].reshape(n, classes), rest[half : 2 * half].reshape(n, classes), rest[2 * half :]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(grid: np.ndarray) -> float:
    """What of the log likelihood depends on the classes, from how often each follows each."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(axis=0)).sum() - _xlogx(grid.sum(axis=1)).sum())


def move(grid: np.ndarray, k: int, r: np.ndarray, l: np.ndarray, itself: float) -> int:
    """Move a unit of class ``k`` to where the likelihood is highest, and say where. ``grid`` is changed.
    ``r``, ``l``: how often each class comes after the unit and before it; ``itself``: how often it follows itself."""
    r, l = r.astype(float), l.astype(float)
    grid[k] -= r
    grid[:, k] -= l
    grid[k, k] += itself
    r[k] -= itself
    l[k] -= itself
    # sums of the grid as they are wherever the unit goes, but for its own class
    rows, cols = grid.sum(axis=1) + l, grid.sum(axis=0) + r
    # a rare word has few classes beside it, and others add nothing
    a, b = np.flatnonzero(r), np.flatnonzero(l)
    after, before = grid[:, a], grid.T[:, b]
    gain = (_xlogx(after + r[a]) - _xlogx(after)).sum(axis=1) + (_xlogx(before + l[b]) - _xlogx(before)).sum(axis=1)
    d = np.diagonal(grid)
    gain += _xlogx(d + r + l + itself) + _xlogx(d) - _xlogx(d + r) - _xlogx(d + l)
    gain -= _xlogx(rows + r.sum() + itself) - _xlogx(rows)
    gain -= _xlogx(cols + l.sum() + itself) - _xlogx(cols)
    gain[0] = -np.inf
    best = int(np.argmax(gain))
    if gain[best] <= gain[k] + 1e-9:
        best = k
    grid[best] += r
    grid[:, best] += l
    grid[best, best] += itself
    return best


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Unit -> class. Class 0 is the end's alone; the others start out dealt by frequency and then take
    turns, the most frequent unit first, to move where the class bigrams' likelihood is highest."""
    size = len(pairs)
    n = pairs.astype(float)
    order = np.argsort(-(n.sum(axis=0) + n.sum(axis=1))[1:], kind="stable") + 1
    of = np.zeros(size, int)
    of[order] = 1 + np.arange(size - 1) % (classes - 1)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    out, into = n @ member, n.T @ member
    grid = member.T @ out
    used = [u for u in order.tolist() if n[u].any() or n[:, u].any()]
    for _ in range(rounds):
        moved = 0
        for u in used:
            k = of[u]
            best = move(grid, k, out[u], into[u], n[u, u])
            if best != k:
                moved += 1
                of[u] = best
                out[:, k] -= n[:, u]
                out[:, best] += n[:, u]
                into[:, k] -= n[u]
                into[:, best] += n[u]
        if not moved:
            break
    return of


def clustered(rows: DataFrame, size: int, classes: int = CLASSES, rounds: int = ALL_ROUNDS, core: int = CORE) -> tuple[np.ndarray, np.ndarray]:
    """Class of each of ``size`` units, and how often each class follows each, over all ``rows`` of sequences."""
    core = min(core, size)
    of = np.zeros(size, int)
    of[1:] = 1 + np.arange(size - 1) % (classes - 1)
    of[:core] = exchange(core_bigrams(rows, core), classes)
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for turn in range(rounds + 1):
        last = turn == rounds
        grid, out, into, itself = class_bigrams(rows, of, classes, not last)
        said = likelihood(grid)
        if best is not None and said <= best[0]:
            break
        best = (said, of.copy(), grid)
        if last:
            break
        now = grid.astype(float)
        for u in range(1, size):
            if out[u].any() or into[u].any():
                of[u] = move(now, of[u], out[u], into[u], itself[u])
        if (of == best[1]).all():
            break
    return best[1], best[2]


@dataclass
class Model:
    """Scores are in log10. ``head``: word -> its place in ``head_class`` and ``head_log`` (of its count)."""

    units: dict[bytes, int]
    head: dict[bytes, int]
    head_class: np.ndarray
    head_log: np.ndarray
    unit_class: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    base: float
    train_tokens: int
    end_log: float
    placed: Placed


class Scorer:
    def __init__(self, model: Model):
        self.m, self.classes = model, Classes(model.units, model.unit_class, model.placed)

    def one(self, text: str) -> tuple[int, int, float, float, Counter]:
        """Tokens, known ones and the two scores, as far as the broadcast counts go; and other words."""
        m = self.m
        words = tokens(text)
        get = m.head.get
        at = np.array([get(w, -1) for w in words], np.int64)
        classes = np.zeros(len(words) + 2, np.int64)
        inner = classes[1:-1]
        rest = np.flatnonzero(at < 0).tolist()
        known = len(words) - len(rest)
        inner[:] = m.head_class[at] if len(m.head_class) else 0
        other: Counter = Counter()
        if rest:
            few = [words[i] for i in rest]
            inner[rest] = self.classes.of(few)
            other.update(few)
        logs = float(m.head_log[at[at >= 0]].sum()) + m.end_log
        n = len(words) + 1
        score = logs + float(m.transition[classes[:-1], classes[1:]].sum()) - float(m.emission[classes[1:]].sum())
        return n, known, logs - n * m.base, score, other


def fit(train: DataFrame, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model over all rows of ``train`` (a column ``text``, null as empty), and the counts of the words
    that it does not hold (``word, c``)."""
    counts = common.cut(word_counts(train))
    said = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = train.count()
    n, v = (said["n"] or 0) + ends, said["v"] + (ends > 0)
    own = units(counts, int(n))
    rows = common.cut(sequences(train, own))
    of, grid = clustered(rows.select("ids"), len(own) + 2)
    words_of, grid = placed(rows, own, of, grid)
    # words with an ending that was never seen are like those with the most frequent short one
    of[-1] = of[min((u for w, u in own.items() if w[:2] == b"  "), default=1)] if own else 1
    top, least = frequent(counts, head, bound(int(n)))
    class_of = Shared(train.sparkSession, (own, of, words_of))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classes(*class_of.value)
        total, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            words = batch.column(0).cast(pa.binary()).to_pylist()
            k = known.of(words)
            total += np.bincount(k, batch.column(1).to_numpy(), CLASSES).astype(np.int64)
            types += np.bincount(k, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(total), pa.array(types)], names=["k", "n", "v"])

    got = counts.select("word", "c").mapInArrow(sizes, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    total, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in got:
        total[r["k"]], types[r["k"]] = r["n"], r["v"]
    total[0], types[0] = ends, ends > 0
    share = (total + DELTA) / (total + DELTA).sum()
    transition = np.log10((grid + PRIOR * CLASSES * share) / (grid.sum(axis=1, keepdims=True) + PRIOR * CLASSES))
    emission = np.log10(total + DELTA * (types + 1))
    c = np.array([x for _, x in top], float)
    words = {w: i for i, (w, _) in enumerate(top)}
    model = Model(
        own, words, Classes(own, of, words_of).of(list(words)), np.log10(c + DELTA), of, transition, emission,
        float(np.log10(n + DELTA * (v + 1))), int(n), float(np.log10(ends + DELTA)), words_of,
    )
    return model, counts.where(F.col("c") < least)


PARTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("digest", T.LongType()),
        T.StructField("word", T.StringType()),
        T.StructField("times", T.IntegerType()),
        T.StructField(
            "whole",
            T.StructType(
                [
                    T.StructField("n_tokens", T.LongType()),
                    T.StructField("n_known", T.LongType()),
                    T.StructField("base", T.DoubleType()),
                    T.StructField("score", T.DoubleType()),
                ]
            ),
        ),
    ]
)


def lm_scores(docs: DataFrame, held_out=None, head: int = HEAD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Rows for which ``held_out`` (by default: crc32 of the id as text is 1 modulo 5) is false are learnt
    from. ``score`` is the class model's log10 probability of the whole text and its end, ``base_score``
    that of the counts alone with DELTA added; in both, unknown words share one count of DELTA (in the
    class model, one in each class). Null and empty texts are an end alone. Equal rows score the same;
    rows without an id are scored like others. With nothing to learn from, ``base_score`` is zero.
    """
    spark = docs.sparkSession
    out = F.coalesce(held_out if held_out is not None else common.crc_mod(doc_id, 5) == 1, F.lit(False))
    model, rare = fit(docs.where(~out).select(F.col(f"`{text}`").cast("string").alias("text")), head)
    train_tokens = model.train_tokens
    ends_known = int(model.end_log > np.log10(DELTA))
    shared = Shared(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = made(shared, Scorer)
        whole = [f.dataType for f in PARTS.fields][-1].fieldNames()
        for ids, texts in common.chunks(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for i, t in zip(ids, texts):
                n, known, base, score, other = scorer.one(t)
                k = len(other)
                digest = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
                out[0] += [i] * (k + 1)
                out[1] += [digest] * (k + 1)
                # no word has a space, so the row for the whole text meets no count
                out[2] += [f" {i} {digest}".encode(), *other]
                out[3] += [0, *other.values()]
                out[4].append(dict(zip(whole, (n, known + ends_known, base, score))))
                out[4] += [None] * k
            types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, types)], names=PARTS.fieldNames())

    parts = docs.select(*common.id_text(docs, doc_id, text)).mapInArrow(run, PARTS)
    met = parts.join(rare, "word", "left")
    term = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + DELTA)
    summed = met.groupBy("doc_id", "digest").agg(
        F.count("whole").alias("copies"),
        *[F.max(f"whole.{c}").alias(c) for c in ("n_tokens", "n_known", "base", "score")],
        F.sum(term).alias("term"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"),
    )
    # equal rows were added up: each gets its share, and there are as many again
    each = summed.withColumn("copy", F.explode(F.expr("sequence(1, int(copies))")))
    return each.select(
        "doc_id",
        F.coalesce(held_out if held_out is not None else common.crc_mod("doc_id", 5) == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + (F.col("seen") / F.col("copies")).cast("long")).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("term") / F.col("copies")).alias("base_score"),
        (F.col("score") + F.col("term") / F.col("copies")).alias("score"),
    )
