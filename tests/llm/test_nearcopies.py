import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
from zephyrine.llm import nearcopies

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """How many components all pairs of rows give, and the component of each row."""
    up = list(range(len(rows)))
    own = [shingles(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if not own[i] | own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    return up


def copies(seed):
    rng = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(9))
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words) + f" {line}" * rng.randint(0, 1), "a"))
    return rows


def test_stage_finds_all_near_copies(spark):
    """At 0.8, near copies that SimHash puts more than four bits apart go too."""
    rows = copies(1) + copies(2)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    of = plain(rows)
    least = {}
    for (i, _, _), c in zip(rows, of):
        least.setdefault(c, i)
    assert sorted(kept) == sorted(least.values())


def test_common_shingles_last(spark, monkeypatch):
    """Whatever counts as common, the result is the same."""
    rows = copies(3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(r.doc_id for r in nearcopies.one_of_each(df).collect())
    monkeypatch.setattr(nearcopies, "SAMPLE", 1)
    monkeypatch.setattr(nearcopies, "OFTEN", 2)
    assert sorted(r.doc_id for r in nearcopies.one_of_each(df).collect()) == want


def test_ids_missing_or_repeated(spark):
    """Unlike texts stay, with no id or an id that others have; near copies of each still go."""
    text = {c: " ".join(f"{c}{i}" for i in range(80)) for c in "abcd"}
    rows = [(None, text["a"], "s"), (None, text["b"], "s"), (None, text["b"] + " more", "t"), (7, text["c"], "s"), (7, text["d"], "s")]
    rows += [(3, text["d"], "s"), (None, None, "s"), (None, "", "s"), (9, " ", "s"), (7, text["c"], "s")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert len(got) == 5
    assert sum(r.doc_id is None for r in got) == 2
    assert {(r.doc_id, r.text) for r in got} >= {(None, text["a"]), (3, text["d"]), (7, text["c"]), (9, " ")}


def test_empty(empty):
    assert nearcopies.one_of_each(empty).count() == 0


def test_bitmaps():
    """The test by bitmaps turns no similar pair away, and most others."""
    rng = np.random.default_rng(5)
    any_ = lambda n: rng.integers(-(1 << 63), 1 << 63, n)
    turned = others = 0
    for _ in range(30):
        base = any_(int(rng.integers(1, 200)))
        own = [np.unique(np.concatenate([base[: int(rng.integers(0, len(base) + 1))], any_(int(rng.integers(0, 30)))])) for _ in range(25)]
        n = np.array([len(x) for x in own])
        i, j, _ = nearcopies.near_pairs(n, [nearcopies.bitmap(x) for x in own], (4, 5))
        said = {(min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist())}
        for x in range(25):
            for y in range(x + 1, 25):
                both = len(np.intersect1d(own[x], own[y]))
                if 5 * both >= 4 * (n[x] + n[y] - both):
                    assert (x, y) in said
                else:
                    others += 1
                    turned += (x, y) not in said
    assert turned > 0.9 * others > 1000


def test_blocks(spark, monkeypatch):
    """Groups dealt over many blocks give the same, as do all without fingerprints' help."""
    rows = copies(4)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(r.doc_id for r in nearcopies.one_of_each(df).collect())
    monkeypatch.setattr(nearcopies, "BLOCK", 2)
    monkeypatch.setattr(nearcopies.simhash, "links", lambda prints: prints.select(prints.fp.alias("u"), prints.fp.alias("v")).limit(0))
    assert sorted(r.doc_id for r in nearcopies.one_of_each(df).collect()) == want


def test_large_component_is_not_multiplied(spark, monkeypatch):
    """In a group that is nearly one component all pairs of different components meet once, and rows are hardly multiplied."""
    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    root = {s: 0 if s < 60 else s for s in range(64)}
    rows = spark.createDataFrame([(0, s, r, 9, 8) for s, r in root.items()], "hub long, set long, root long, n long, bytes long")
    has = spark.createDataFrame([(s, b"12345678") for s in root], "set long, bits binary")
    got = nearcopies._dealt(rows, has, "bits").collect()
    met = Counter()
    for r in got:
        for x, y in combinations(r.own, 2):
            if x.root != y.root and (r.a == r.b or x.mine != y.mine):
                met[min(x.set, y.set), max(x.set, y.set)] += 1
    assert met == Counter((x, y) for x, y in combinations(range(64), 2) if root[x] != root[y])
    assert sum(len(r.own) for r in got) < 200


def test_scattered_is_linear(spark, monkeypatch):
    """The first links of a large group take each set twice, whatever the group's size."""
    monkeypatch.setattr(nearcopies, "BLOCK", 4)
    rows = spark.createDataFrame([(h, s, s, 9, 8) for h in (0, 1) for s in range(64)] + [(2, s, s, 9, 8) for s in (1, 2)], "hub long, set long, root long, n long, bytes long")
    has = spark.createDataFrame([(s, b"12345678") for s in range(64)], "set long, bits binary")
    met = Counter(x.set for r in nearcopies._scattered(rows, has).collect() for x in r.own)
    assert met == Counter({s: 3 if s in (1, 2) else 2 for s in range(64)})


def test_pairs_of_two_sides():
    """With sides, the pairs are those of all that have an end on either side."""
    rng = np.random.default_rng(6)
    base = rng.integers(-(1 << 63), 1 << 63, 300)
    own = [np.unique(rng.choice(base, int(rng.integers(20, 300)))) for _ in range(40)]
    n, bits = np.array([len(x) for x in own]), [nearcopies.bitmap(x) for x in own]
    side = rng.random(40) < 0.3
    both = lambda i, j, room: {(min(x, y), max(x, y), z) for x, y, z in zip(i.tolist(), j.tolist(), room.tolist())}
    every = both(*nearcopies.near_pairs(n, bits, (1, 5)))
    want = {(x, y, z) for x, y, z in every if side[x] != side[y]}
    assert both(*nearcopies.near_pairs(n, bits, (1, 5), side)) == want and 0 < len(want) < len(every)
