import math
import random
from fractions import Fraction

import pytest

from zephyrine.llm import mixing


def test_deviation_and_deadlines():
    """Within the first phase, each source is less than a block from its share at every slot."""
    rng = random.Random(3)
    for _ in range(100):
        weights = {str(i): rng.random() ** 3 + 1e-4 for i in range(rng.randint(1, 12))}
        rows = {s: rng.randint(1, 200) for s in weights}
        found = mixing.exact_slots(rows, weights, 1)
        assert sorted(x for own in found.values() for x in own[0].tolist()) == list(range(sum(rows.values())))
        end = min(int(own[0][-1]) for own in found.values())
        total = sum(map(Fraction, weights.values()))
        for s, own in found.items():
            share = Fraction(weights[s]) / total
            for t in range(end + 2):
                assert abs(sum(x < t for x in own[0].tolist()) - t * share) < 1
            assert (own[1] <= own[0]).all() and (own[0] < own[2]).all()


def by_hand(rows, weights, block):
    """Order of (source, rank), a slot at a time, by exact fractions."""
    left = {s: -(-n // block) for s, n in rows.items() if n}
    taken = dict.fromkeys(left, 0)
    out = []
    while left:
        total = sum(Fraction(weights[s]) for s in left)
        share = {s: Fraction(weights[s]) / total for s in left}
        placed = dict.fromkeys(left, 0)
        t, over = 0, None
        while over is None:
            ready = [(math.ceil((placed[s] + 1) / share[s]), s) for s in left if math.floor(placed[s] / share[s]) <= t]
            s = min(ready)[1]
            first = taken[s] * block
            out += [(s, r) for r in range(first, min(first + block, rows[s]))]
            taken[s] += 1
            placed[s] += 1
            left[s] -= 1
            t += 1
            if not left[s]:
                over = s
        del left[over]
    return out


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST", 10)
    monkeypatch.setattr(mixing, "BROADCAST", 5)
    got = mixing.schedule(spark.range(1000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source")).collect()
    assert sorted(r.position for r in got) == list(range(1000))
    assert max(r.place for r in got) == 99 and max(r.slot for r in got) == 10


@pytest.mark.parametrize("seed", range(4))
def test_schedule(spark, seed):
    rng = random.Random(seed)
    rows = {s: rng.randint(0, 120) for s in "abcd"} | {None: 17}
    data = [(i, s) for i, s in enumerate(s for s, n in rows.items() for _ in range(n))]
    weights = {"a": 5.0, "b": 1.0, "c": 0.5, "d": 2.5, None: 1.0}
    got = mixing.schedule(spark.createDataFrame(data, "doc_id long, source string"), weights, block=4).collect()
    named = {("n" if s is None else f"s{s}"): n for s, n in rows.items()}
    want = by_hand(named, {("n" if s is None else f"s{s}"): w for s, w in weights.items()}, 4)
    order = sorted(got, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(data)))
    assert [(("n" if r.source is None else f"s{r.source}"), r.block * 4 + r.place) for r in order] == want
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert sorted(r.doc_id for r in got) == [i for i, _ in data]


def test_edges(docs, empty):
    assert mixing.schedule(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mix(docs, ties=("text",))
    assert mixed.columns == docs.columns
    key = lambda r: tuple(map(str, r))
    assert sorted(mixed.collect(), key=key) == sorted(docs.collect(), key=key)
    with pytest.raises(ValueError):
        mixing.schedule(docs, {"a": 0})


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 9, 9, "x"), (2, "b", 9, 9, "y")], "doc_id long, source string, slot int, block int, position string")
    assert mixing.mix(df).columns == df.columns
    assert {r.position for r in mixing.schedule(df).collect()} == {0, 1}


def test_given_weights_over_many_slots():
    """Less than a block from the exact share at every slot, however many there are."""
    rows = {"big": 60_000} | {f"s{i}": 6_000 for i in range(20)}
    weights = {s: n**0.5 for s, n in rows.items()} | {"s3": 1e-3}
    found = mixing.exact_slots(rows, weights, 1)
    order = sorted((x, s) for s, own in found.items() for x in own[0].tolist())
    assert [x for x, _ in order] == list(range(sum(rows.values())))
    total, placed = sum(weights.values()), dict.fromkeys(rows, 0)
    for t, s in order:
        placed[s] += 1
        if t % 97 == 0:
            assert all(abs(n - (t + 1) * weights[x] / total) < 1 + 1e-6 for x, n in placed.items())
        if placed[s] == rows[s]:
            break
    assert t > 50_000
    assert all((own[1] <= own[0]).all() and (own[0] < own[2]).all() for own in found.values())


def test_small_weights(spark):
    """A source that weighs under 1 / 4000 is not placed more often than its weight says."""
    data = [(i, "rare" if i < 20 else "often") for i in range(20_000)]
    got = mixing.schedule(spark.createDataFrame(data, "doc_id long, source string"), {"rare": 1e-4, "often": 1.0}, block=1).collect()
    assert sorted(r.position for r in got) == list(range(len(data)))
    assert all(r.release <= r.slot < r.deadline for r in got)
    assert sum(r.source == "rare" and r.slot < 19_900 for r in got) <= 2
    few = mixing.schedule(spark.createDataFrame(data[:50], "doc_id long, source string"), block=4).collect()
    assert sorted(r.position for r in few) == list(range(50))
    assert len({(r.slot, r.place) for r in few}) == 50
