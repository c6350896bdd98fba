import random
import re

import numpy as np
import pytest
import xxhash

from zephyrine.llm import components, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, prints, bits=4):
    """Single linkage by comparing all: row -> smallest id reachable."""
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return [least.get(top(i)) for i in range(len(ids))]


def test_near_duplicates(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain(r.text) for r in rows]
    want = sorted((str(r.doc_id), p, c) for r, p, c in zip(rows, prints, groups([r.doc_id for r in rows], prints)))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("segments,take", [(3, 1), (5, 2), (7, 3)])
def test_signatures_reach_four_bits(segments, take):
    masks = [m for m, _ in simhash.signatures(4, segments, take)]
    rng = random.Random(4)
    for _ in range(500):
        x = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(x & m == 0 for m in masks)


def test_too_few_segments():
    with pytest.raises(ValueError):
        simhash.signatures(4, 2, 1)


@pytest.mark.parametrize("crowd,block", [(2, 16), (4, 64), (4, 2048), (1000, 64)])
def test_links_connect_like_all_pairs(spark, crowd, block):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)}
    seed = rng.getrandbits(64)
    for _ in range(250):  # a crowd of near copies, and a chain that leaves it
        prints.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    x = seed
    for _ in range(12):
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(x)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), crowd=crowd, block=block)
    for r in edges.limit(500).collect():
        assert r.u != r.v
    root = {r.node % (1 << 64): r.root for r in components.components(edges).collect()}
    want = groups(list(range(len(prints))), prints)
    of = {}
    for p, c in zip(prints, want):
        of.setdefault(c, set()).add(root.get(p, p))
    assert all(len(s) == 1 for s in of.values())
    assert len({next(iter(s)) for s in of.values()}) == len(of)


def test_forest_between_blocks():
    rng = np.random.default_rng(6)
    left = rng.integers(0, 1 << 62, 20).astype(np.uint64)
    right = left ^ np.uint64(7)
    u, v = simhash._forest(left, right, 4)
    assert len(u) >= 20 and all(a != b for a, b in zip(u, v))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5), (101, 100)] + [(200, 300 + i) for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100} | {200: 200} | {300 + i: 200 for i in range(50)}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
