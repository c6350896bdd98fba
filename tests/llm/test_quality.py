"""Rules, isolation forest and classifier."""

import random
import re
import zlib

import numpy as np

from zephyrine.llm import quality, rules


def plain(text):
    """The five counts, straight from their definitions."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_counts():
    rng = random.Random(7)
    alphabet = ["a", "b", "c", "é", "#", "|", "\n", " ", "\t", "A!", "\x1c", "\u00a0"]
    texts = ["".join(rng.choice(alphabet) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    for text in [*texts, "", "a", "a b c a b c", "x\nx\n\n \n \nx"]:
        assert rules.counts(text) == plain(text), text


def test_judge(docs, empty, labels):
    forest = rules.fit(docs, labels)
    got = rules.judge(docs, forest).collect()
    assert len(got) == docs.count()
    want = sorted((str(r.doc_id), *plain(r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), *[r[c] for c in rules.COUNTS]) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rules.judge(empty, forest).count() == 0
    kept = rules.keep(docs, forest)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_nothing_labelled(docs, empty, labels):
    forest = rules.fit(docs, labels.limit(0))
    assert all(r.kept != r.base_failed for r in rules.judge(docs, forest).collect())
    assert rules.fit(empty, labels).threshold == np.inf


def plain_forest(x, trees, sample, seed, chances):
    """Trees of an isolation forest as functions of a row, written out recursively with the same draws."""
    rng = np.random.default_rng(seed)

    def mean_path(n):
        return 0 if n < 2 else 1 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def grow(part, depth):
        varied = [f for f in range(x.shape[1]) if len({r[f] for r in part}) > 1 and chances[f] > 0]
        if depth == int(np.ceil(np.log2(sample))) or len(part) == 1 or not varied:
            return lambda row: depth + mean_path(len(part))
        f = rng.choice(varied, p=chances[varied] / chances[varied].sum())
        cut = rng.uniform(min(r[f] for r in part), max(r[f] for r in part))
        left, right = (grow([r for r in part if (r[f] > cut) == side], depth + 1) for side in (False, True))
        return lambda row: (right if row[f] > cut else left)(row)

    grown = [grow(list(x[rng.choice(len(x), sample, replace=False)]), 0) for _ in range(trees)]
    return lambda row: 2 ** (-np.mean([t(row) for t in grown]) / mean_path(sample))


def test_forest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    chances = np.array([1.0, 0.5, 2.0, 0.0])
    forest = rules.Forest.grow(x, 40, 64, 1, chances)
    odd = np.vstack([x[:20], rng.normal(size=(5, 4)) * 8 + 10])
    by_hand = plain_forest(x, 40, 64, 1, chances)
    assert np.allclose(forest.score(odd), [by_hand(r) for r in odd])
    every = rules.Forest.grow(np.vstack([x, odd[-5:]]), 100, 64, 1).score(odd)
    assert every[-5:].min() > every[:20].mean()


def test_parting():
    good = np.array([True] * 4 + [False] * 4)
    x = np.array([[i, i % 2, 1, i // 4] for i in range(8)], float)
    assert rules.parting(x, good).tolist() == [1, 0, 0, 1]
    assert rules.parting(x, ~good).tolist() == [1, 0, 0, 1]
    assert rules.parting(x[:4], good[:4]).tolist() == [1] * 4


def test_calibrate():
    """Against all thresholds between scores, tried one by one."""
    rng = np.random.default_rng(2)
    for n in range(1, 60):
        bins = np.arange(12) / 12
        good, bad = rng.integers(0, 3, 12), rng.integers(0, 3, 12) * (bins > 0.3)
        lose = float(rng.choice([0, 0.1, 0.3]))
        at = rules.calibrate(bins, good, bad, lose)
        if not good.sum():
            continue
        tried = [(bad[bins > t].sum(), t) for t in [-1, *bins] if good[bins > t].sum() <= lose * good.sum()]
        assert good[bins > at].sum() <= lose * good.sum()
        assert bad[bins > at].sum() == max(tried)[0]
    assert rules.calibrate(np.zeros(0), np.zeros(0), np.zeros(0), 0.1) == np.inf


def test_threshold_covers_all_labelled_rows(spark, sf):
    """However few rows the forest is grown on, no more than the share of all good rows is lost."""
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    measured = rules.measure(docs).cache()
    forest = rules.fit_measured(measured, marks, most=40, lose=0.02)
    good = {r.doc_id for r in marks.where("quality = 1").collect()}
    own = [r for r in rules.judge_measured(measured, forest).collect() if r.doc_id in good and not r.base_failed]
    assert sum(not r.kept for r in own) <= 0.02 * len(own)


def test_sample_is_bounded(docs, labels):
    assert rules.labelled(docs, labels, 2).select("doc_id").distinct().count() <= 2


def test_held_out_accuracy(spark, sf):
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.quality for r in marks.collect()}
    model = quality.fit(docs, marks)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    judged = {r.doc_id: r for r in rules.judge(docs, rules.fit(docs, marks)).collect()}
    good = [i for i, q in truth.items() if q == 1 and i in judged and not judged[i].base_failed]
    bad = [i for i, q in truth.items() if q == 0 and i in judged]
    assert sum(judged[i].kept for i in good) >= 0.97 * len(good)
    assert sum(judged[i].kept for i in bad) <= 0.1 * len(bad)


def test_score_edges(docs, empty, labels):
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)
    assert quality.fit(docs, labels.limit(0)).score([""])[0] == 0.5
    assert quality.fit(docs, labels.where("quality = 1")).score(["any"])[0] > 0.9


def test_gradient():
    """The written-out gradient against differences."""
    rng = np.random.default_rng(3)
    model = quality.Model(np.zeros(5), np.ones(5), quality.Model.initial(rng, 5))
    x, begins = rng.normal(size=(7, 5)), np.array([0, 2, 3])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        z = model.forward(x, begins)["logit"]
        return (weight * (np.log1p(np.exp(z)) - y * z)).mean()

    g = model.gradient(x, begins, y, weight)
    for k, v in model.weights.items():
        for at in list(np.ndindex(v.shape))[:6]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6


def test_passages_cover_all_words():
    text = " ".join(f"w{i}" for i in range(200)) + "\nlast"
    p = quality.passages(text)
    assert len(p) == 4 and len(quality.passages("")) == 1
    assert round(p[:, len(quality.GROUPS)].sum() * quality.PASSAGE) == 202  # the line break counts as one
