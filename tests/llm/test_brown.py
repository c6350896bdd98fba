import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from zephyrine.llm import brown


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def base(rows):
    c = Counter(w for i, t in rows if not held_out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, held_out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for i, t in rows]


def key(r):
    return tuple(str(x) for x in r[:5])


@pytest.mark.parametrize("head", [0, 5, 200_000])
def test_base_scores(docs, head):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(([*r] for r in brown.lm_scores(docs, head=head).collect()), key=key)
    want = sorted(base(rows), key=key)
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])


def test_head_size_changes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r.doc_id: r.score for r in brown.lm_scores(docs, head=2000).collect()}
    b = {r.doc_id: r.score for r in brown.lm_scores(docs, head=3000).collect()}
    assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a])


def test_better_than_base(spark, sf):
    rows = brown.lm_scores(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def unit(m, w):
    """A word's unit: its own, else that of its last three bytes, else of two, else the unknown one."""
    found = [m.units.get(k) for k in (w, b" " + w[-3:], b"  " + w[-2:])]
    return next((u for u in found if u is not None), len(m.units) + 1)


def test_probabilities_sum_to_one(spark, sf):
    train = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    m, rare = brown.fit(train, head=500)
    assert np.allclose((10**m.transition).sum(axis=1), 1)
    mass = np.zeros(brown.CLASSES)
    np.add.at(mass, m.head_class, 10**m.head_log)
    for r in rare.collect():
        mass[m.unit_class[unit(m, r.word.encode())]] += r.c + 0.5
    mass[0] += 10**m.end_log
    assert np.allclose((mass + brown.DELTA) / 10**m.emission, 1)


def test_units(spark, sf):
    """Every word of the share is a unit of its own, whatever their number, and every ending that is frequent."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c = Counter(w.encode() for r in docs.collect() for w in words(r.text) if w)
    counts = brown.word_counts(docs)
    n = sum(c.values())
    got = brown.units(counts, n)
    least = max(brown.LEAST, -(-n // brown.SHARE))
    three, two = Counter(), Counter()
    for w, x in c.items():
        if x < least:
            three[b" " + w[-3:]] += x
            two[b"  " + w[-2:]] += x
    assert set(got) == {w for w, x in c.items() if x >= least} | {w for w, x in three.items() if x >= least} | set(two)
    assert sorted(got.values()) == list(range(1, len(got) + 1))


def test_score_by_hand(docs, spark, sf, monkeypatch):
    """The score against a class bigram model written out, given which class each unit has."""
    monkeypatch.setattr(brown, "SEQUENCE", 700)
    rows = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60))
    rows = spark.createDataFrame(rows.collect(), rows.schema).repartition(3)
    held = [(r.doc_id, r.text) for r in rows.collect()]
    kept = []
    fit = brown.fit

    def keep(*args, **how):
        kept.append(fit(*args, **how))
        return kept[-1]

    monkeypatch.setattr(brown, "fit", keep)
    got = sorted((tuple(r[:5]), r.score) for r in brown.lm_scores(rows, head=20).collect() if r.doc_id is not None)
    m = kept[0][0]
    of = lambda w: 0 if w is None else int(m.unit_class[unit(m, w.encode())])
    pairs, total, types, seen = Counter(), Counter(), Counter(), Counter()
    for i, t in held:
        if not held_out(i):
            line = [None, *words(t)]
            pairs.update((of(a), of(b)) for a, b in zip(line, line[1:]))
            seen.update(words(t))
    for w, x in seen.items():
        total[of(w)] += x
        types[of(w)] += 1
    k = brown.CLASSES
    share = {c: (total[c] + 0.5) / (sum(total.values()) + 0.5 * k) for c in range(k)}
    out = Counter()
    for (a, _), x in pairs.items():
        out[a] += x
    want = []
    for (i, t), b in zip(held, base(held)):
        line = [None, *words(t)]
        s = sum(
            math.log10((pairs[of(a), of(b)] + k * share[of(b)]) / (out[of(a)] + k))
            + math.log10((seen[b] + 0.5) / (total[of(b)] + 0.5 * (types[of(b)] + 1)))
            for a, b in zip(line, line[1:])
        )
        if i is not None:
            want.append((tuple(b[:5]), s))
    want.sort()
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want])


def likelihood(pairs, of, classes):
    member = np.eye(classes)[of]
    g = member.T @ pairs @ member
    x = lambda a: (a * np.log(np.maximum(a, 1))).sum()
    return x(g) - x(g.sum(axis=0)) - x(g.sum(axis=1))


def closed(rng, size, length):
    """Bigrams of a sequence that ends where it begins."""
    line = np.concatenate([[0], rng.zipf(1.5, length) % size, [0]])
    pairs = np.zeros((size, size), int)
    np.add.at(pairs, (line[:-1], line[1:]), 1)
    return pairs


@pytest.mark.parametrize("seed", range(50))
def test_exchange_climbs(seed):
    """The likelihood rises in every round, and at the end no single move is better."""
    rng = np.random.default_rng(seed)
    size, classes = int(rng.integers(6, 24)), int(rng.integers(3, 6))
    pairs = closed(rng, size, int(rng.integers(20, 400)))
    last = -np.inf
    for rounds in range(300):
        of = brown.exchange(pairs, classes, rounds)
        assert of[0] == 0 and (of[1:] > 0).all()
        now = likelihood(pairs, of, classes)
        assert now >= last - 1e-6
        if now <= last + 1e-9:
            break
        last = now
    of = brown.exchange(pairs, classes, 300)
    best = likelihood(pairs, of, classes)
    assert np.isclose(best, brown.likelihood(np.eye(classes)[of].T @ pairs @ np.eye(classes)[of]))
    for u in range(1, size):
        for k in range(1, classes):
            other = of.copy()
            other[u] = k
            assert likelihood(pairs, other, classes) <= best + 1e-6


def test_clusters_of_all_units(spark):
    """Counts in the cluster against plain ones; rounds over all units beyond the core raise the likelihood."""
    rng = np.random.default_rng(3)
    size, classes = 30, 5
    kinds = np.arange(size) % 3
    lines = []
    for _ in range(60):
        line, at = [], 0
        for _ in range(50):
            at = rng.choice(np.flatnonzero((kinds == (kinds[at] + 1) % 3) & (np.arange(size) > 0)))
            line.append(int(at))
        lines.append([*line, 0])
    pairs = np.zeros((size, size), int)
    for line in lines:
        np.add.at(pairs, ([0, *line[:-1]], line), 1)
    rows = spark.createDataFrame([(np.array(x, np.int32).tobytes(),) for x in lines], "ids binary").repartition(3)
    assert (brown.core_bigrams(rows, 7) == pairs[:7, :7]).all()
    of = rng.integers(1, classes, size)
    of[0] = 0
    grid, out, into, itself = brown.class_bigrams(rows, of, classes)
    member = np.eye(classes, dtype=int)[of]
    assert (grid == member.T @ pairs @ member).all() and (out == pairs @ member).all() and (into == pairs.T @ member).all()
    assert (itself == np.diagonal(pairs)).all()
    said = []
    for rounds in range(4):
        of, grid = brown.clustered(rows, size, classes, rounds, core=8)
        member = np.eye(classes, dtype=int)[of]
        assert (grid == member.T @ pairs @ member).all() and of[0] == 0
        said.append(likelihood(pairs, of, classes))
    assert said == sorted(said) and said[-1] > said[0]


def test_words_below_the_share(spark, sf, monkeypatch):
    """Words that the share leaves out are classed by their own bigrams, all that occur LEAST times or more; the
    likelihood rises by it, and the score is that of a class bigram model written out over these classes."""
    monkeypatch.setattr(brown, "SHARE", 500)
    monkeypatch.setattr(brown, "OCCURRENCES", 10_000)
    monkeypatch.setattr(brown, "SEQUENCE", 5000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(3)
    held = [(r.doc_id, r.text) for r in docs.collect()]
    lines = [[None, *words(t)] for i, t in held if not held_out(i)]
    seen = Counter(w for line in lines for w in line[1:])
    m = brown.fit(spark.createDataFrame([(t,) for i, t in held if not held_out(i)], "text string").repartition(3), head=50)[0]
    below = {w for w, c in seen.items() if w and c >= brown.LEAST and w.encode() not in m.units}
    assert len(below) > 500 and m.placed.keys.tolist() == sorted(brown.key(w.encode()) for w in below)
    by_unit = lambda w: 0 if w is None else int(m.unit_class[unit(m, w.encode())])
    own = dict(zip(m.placed.keys.tolist(), m.placed.classes.tolist()))
    by_word = lambda w: own[brown.key(w.encode())] if w in below else by_unit(w)
    assert any(by_word(w) != by_unit(w) for w in below) and min(own.values()) > 0

    def pairs(of):
        grid = np.zeros((brown.CLASSES, brown.CLASSES))
        for line in lines:
            np.add.at(grid, ([of(w) for w in line[:-1]], [of(w) for w in line[1:]]), 1)
        return grid

    grid = pairs(by_word)
    assert brown.likelihood(grid) > brown.likelihood(pairs(by_unit))
    k, total, types = brown.CLASSES, np.zeros(brown.CLASSES), np.zeros(brown.CLASSES)
    for w, c in seen.items():
        total[by_word(w)] += c
        types[by_word(w)] += 1
    share = (total + 0.5) / (total + 0.5).sum()
    move = np.log10((grid + k * share) / (grid.sum(axis=1, keepdims=True) + k))
    for r in brown.lm_scores(docs, head=50).collect():
        line = [None, *words(dict(held)[r.doc_id])]
        said = sum(move[by_word(a), by_word(b)] + math.log10((seen[b] + 0.5) / (total[by_word(b)] + 0.5 * (types[by_word(b)] + 1))) for a, b in zip(line, line[1:]))
        assert np.isclose(r.score, said)


def test_empty(empty, docs):
    assert brown.lm_scores(empty).count() == 0
    one = docs.where("doc_id = 7")
    from pyspark.sql import functions as F

    got = brown.lm_scores(one, held_out=F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got] == [(3, 0, 0, 0)]
