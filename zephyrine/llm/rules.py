"""Quality rules: per-document rule statistics, fixed rules, and an isolation forest over the statistics.

The forest (Liu, Ting and Zhou, 2008) is grown on a bounded sample of labelled rows, good and bad. A document
whose mean path over the random splits is short is unusual, and only the paths' lengths count. A split's
feature is drawn by how far it alone parts the sample's labels, so that ratios in which good texts differ
among themselves are seldom split. How short a path is too short is calibrated on all labelled rows, so that
no more than a set share of good ones is lost. Texts are read once; what follows works on their statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.llm import common

SPACES = " \t\n\v\f\r"
#: Characters that the rules count as symbols.
SYMBOLS = "#*$%&|<>"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols", "word_length", "dup_lines", "repeats", "upper", "marks", "fresh", "runs", "line_words", "digits"]


def counts(text: str) -> tuple[int, int, int, int, int]:
    """COUNTS of a text. Words are what stands between ASCII white space. Lines with a word count as
    repeated where an earlier line is equal. A word is repeated where a window of three words that
    holds it occurs more than once in the text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    dup = len(lines) - len(set(lines))
    return len(words), chars, symbols, dup, repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words within three-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    # windows as numbers, exactly: pairs first, then pairs with the third word
    size = len(number)
    pairs = np.unique(ids[:-2] * size + ids[1:-1], return_inverse=True)[1]
    window = pairs * size + ids[2:]
    _, where, times = np.unique(window, return_inverse=True, return_counts=True)
    twice = times[where] > 1
    if not twice.any():
        return 0
    mark = np.zeros(n + 2, bool)
    for k in range(3):
        mark[k : k + n] |= twice
    return int(mark.sum())


def features(text: str, said: tuple[int, int, int, int, int]) -> list[float]:
    """FEATURES: ratios of the counts, plus the shares of capitals, digits, exclamation marks, distinct
    words, words equal to the one before, and words per line. All zero for a text without words."""
    n, chars, symbols, dup, rep = said
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = raw.count(b"\n") + 1
    letters = histogram[65:91].sum() + histogram[97:123].sum()
    # a long text has fewer new words; the first thousand words are compared with one another, then the next
    fresh = sum(len(set(words[i : i + 1000])) for i in range(0, n, 1000)) / n
    runs = n - sum(1 for _ in groupby(words))
    return [
        symbols / n,
        chars / n,
        dup / lines,
        rep / n,
        float(histogram[65:91].sum() / max(letters, 1)),
        float((histogram[33] + histogram[63]) / n),
        fresh,
        runs / n,
        math.log1p(n / lines),
        float(histogram[48:58].sum() / max(chars, 1)),
    ]


def failed(n_words: int, n_repeat: int, least: int = 50, most: int = 50) -> bool:
    """The fixed rules: too few words, or over ``most`` percent of them repeated."""
    return n_words < least or 100 * n_repeat > most * n_words


@dataclass
class Forest:
    """Random split trees, as arrays: feature (-1: leaf), cut, left child, right child, path length."""

    sample: int
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    threshold: float = -1.0

    @staticmethod
    def unsplit(n: int) -> float:
        """Mean path that a search among n points would still have."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    @classmethod
    def grow(cls, x: np.ndarray, trees: int, sample: int, seed: int, chances: np.ndarray | None = None) -> Forest:
        """``chances``: how likely a split is on each feature, where it varies; by default all the same."""
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        chances = np.ones(x.shape[1]) if chances is None else chances
        out = cls(sample)
        top = math.ceil(math.log2(max(sample, 2)))
        for _ in range(trees if sample else 0):
            rows: list[list[float]] = []
            todo = [(x[rng.choice(len(x), sample, replace=False)], 0, None)]
            while todo:
                part, depth, parent = todo.pop()
                me = len(rows)
                if parent is not None:
                    rows[parent[0]][parent[1]] = me
                low, high = part.min(axis=0), part.max(axis=0)
                split = np.flatnonzero((high > low) & (chances > 0))
                if depth >= top or len(part) < 2 or not len(split):
                    rows.append([-1, 0.0, 0, 0, depth + cls.unsplit(len(part))])
                    continue
                f = int(rng.choice(split, p=chances[split] / chances[split].sum()))
                at = float(rng.uniform(low[f], high[f]))
                rows.append([f, at, 0, 0, 0.0])
                right = part[:, f] > at
                todo += [(part[right], depth + 1, (me, 3)), (part[~right], depth + 1, (me, 2))]
            a = np.array(rows)
            out.trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score of each row: 2 to the power of minus its mean path over the expected one."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), int)
            while True:
                f = feature[at]
                live = np.flatnonzero(f >= 0)
                if not len(live):
                    break
                now = at[live]
                at[live] = np.where(x[live, f[live]] > cut[now], right[now], left[now])
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.unsplit(self.sample), 1e-9))


def parting(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How far each feature alone parts good rows from others: the greatest difference of their shares
    below a bound (from 0 to 1), squared. All the same if there is one kind of rows only."""
    if good.all() or not good.any():
        return np.ones(x.shape[1])
    out = []
    for v in x.T:
        order = np.argsort(v, kind="stable")
        ends = np.append(np.diff(v[order]) > 0, True)
        below = np.cumsum(good[order]) / good.sum() - np.cumsum(~good[order]) / (~good).sum()
        out.append(float(np.abs(below[ends]).max()) ** 2)
    return np.array(out) if any(out) else np.ones(x.shape[1])


def calibrate(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, lose: float) -> float:
    """The threshold from histograms of the scores of good and of bad rows (``bins`` in ascending order).

    Of the thresholds that lose at most ``lose`` of the good rows, those with the most bad rows above
    them, and of these the highest: the middle between two bins. Infinite if there are no good rows.
    """
    if not good.sum():
        return math.inf
    # rows above a threshold just below each bin, and above all of them
    lost = np.append(np.cumsum(good[::-1])[::-1], 0)
    caught = np.append(np.cumsum(bad[::-1])[::-1], 0)
    allowed = np.flatnonzero(lost <= math.floor(good.sum() * lose))
    at = int(allowed[np.flatnonzero(caught[allowed] == caught[allowed].max())[-1]])
    if at == len(bins):
        return float(bins[-1]) + 1e-9
    return float((bins[at - 1] + bins[at]) / 2) if at else float(bins[0]) - 1e-9


#: Labelled rows at most that the forest is grown on; the threshold is calibrated on all.
LABELLED = 6000
TREES, SAMPLE, LOSE, SEED = 120, 64, 0.002, 8
#: Steps of the score in the histograms that the threshold is taken from.
BINS = 1 << 14


def chosen_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` of each labelled id; of an id's several labels the least counts."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def labelled(docs: DataFrame, labels: DataFrame, most: int, where=None) -> DataFrame:
    """``doc_id, quality, text`` of the rows of at most ``most`` labelled ids, the first by a hash of doc_id.

    The chosen ids are few and join the documents as a bounded broadcast; the texts are not shuffled.
    """
    good = chosen_labels(labels if where is None else labels.where(where))
    rows = [(r["doc_id"], r["quality"]) for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    spark = docs.sparkSession
    few = spark.createDataFrame(rows, "doc_id long, quality int").coalesce(1)
    return docs.select(*common.id_text(docs)).join(F.broadcast(few), "doc_id").select("doc_id", "quality", "text")


MEASURED = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("x", T.ArrayType(T.DoubleType()))]
)


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, COUNTS, ``base_failed`` and FEATURES as an array ``x`` of every row of ``docs``."""

    def make():
        def step(cols):
            said = [counts(t) for t in cols[1]]
            x = [features(t, c) for t, c in zip(cols[1], said)]
            return [cols[0], *map(list, zip(*said)), [failed(c[0], c[4]) for c in said], x]

        return step

    return common.map_texts(docs, common.id_text(docs, doc_id, text), 1, make, MEASURED)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), len(FEATURES))


def fit_measured(
    measured: DataFrame, labels: DataFrame, most: int = LABELLED, trees: int = TREES, sample: int = SAMPLE, lose: float = LOSE, seed: int = SEED
) -> Forest:
    """:func:`fit` on what :func:`measure` gave. Statistics are joined, not texts."""
    rows = measured.where("NOT base_failed").join(chosen_labels(labels), "doc_id").select("doc_id", "quality", "x")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(most).toArrow()
    x = _matrix(got.column("x"))
    good = got.column("quality").to_numpy() == 1
    if not good.any():
        return Forest(0, [], math.inf)
    forest = Forest.grow(x, trees, sample, seed, parting(x, good))
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.floor(shared.value.score(_matrix(batch.column(1))) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], names=["quality", "bin"])

    seen = rows.select("quality", "x").mapInArrow(binned, "quality int, bin int")
    both = seen.groupBy("bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")).orderBy("bin").toArrow()
    at = [both.column(c).to_numpy() for c in ("bin", "good", "bad")]
    # a row is above a threshold if its whole bin is
    forest.threshold = calibrate((at[0] + 0.5) / BINS, at[1], at[2], lose)
    return forest


def fit(docs: DataFrame, labels: DataFrame, **how) -> Forest:
    """A forest grown on at most ``most`` labelled rows (the first by a hash of the id), with its threshold
    set on all of them. Rows that the fixed rules reject are left out. With no labelled good rows it finds
    nothing odd. ``how`` as for :func:`fit_measured`."""
    return fit_measured(common.cut(measure(docs)), labels, **how)


JUDGED = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def judge_measured(measured: DataFrame, forest: Forest) -> DataFrame:
    """:func:`judge` on what :func:`measure` gave."""
    common.ship(measured.sparkSession)
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_matrix(batch.column(len(COUNTS) + 2)))
            base = np.array(batch.column(len(COUNTS) + 1).to_pylist(), bool)
            kept = ~base & (score <= shared.value.threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(COUNTS) + 2], pa.array(score), pa.array(kept)], names=JUDGED.fieldNames())

    return measured.mapInArrow(run, JUDGED)


def judge(docs: DataFrame, forest: Forest, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, COUNTS, ``base_failed, anomaly, kept`` for every row of ``docs``.

    Null and empty texts have no words, so the fixed rules reject them. Repeated rows get the same
    verdict; null ids stay null; other columns are not read.
    """
    return judge_measured(measure(docs, doc_id, text), forest)


def verdicts(texts: list[str], forest: Forest) -> list[bool]:
    said = [counts(t) for t in texts]
    use = [i for i, c in enumerate(said) if not failed(c[0], c[4])]
    out = [False] * len(texts)
    score = forest.score(np.array([features(texts[i], said[i]) for i in use]).reshape(len(use), len(FEATURES)))
    for i, s in zip(use, score.tolist()):
        out[i] = s <= forest.threshold
    return out


def keep(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    return common.keep_rows(docs, text, lambda: lambda texts: verdicts(texts, shared.value))
