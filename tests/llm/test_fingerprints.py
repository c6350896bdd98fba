import hashlib

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from zephyrine.llm import fingerprints as fp


def ends(data):
    """Chunk ends, a byte at a time."""
    gear = [int(x) for x in fp.GEAR]
    h, hashes = 0, []
    for b in data:
        h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        hashes.append(h)
    out, at = [], 0
    while at < len(data):
        end = min(at + fp.GREATEST, len(data))
        if len(data) - at > fp.LEAST:
            for e in range(at + fp.LEAST, end):
                bits = fp.STRICT if e - at < fp.NORMAL else fp.LOOSE
                if hashes[e - 1] < 1 << (32 - bits):
                    end = e
                    break
        else:
            end = len(data)
        out.append(end)
        at = end
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=600), max_size=4))
def test_boundaries(parts):
    h, begins = fp.hashes(parts)
    assert list(fp.chunk_ends(h, begins, [len(p) for p in parts])) == [ends(p) for p in parts]


def test_shift_resistance(spark, sf):
    text = max((r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), key=len)
    a, b = fp.chunk_sets([text, "inserted at the front " + text[:5000] + " and here " + text[5000:]])
    assert fp.containment(a, b) > 0.9
    assert fp.parse(fp.fingerprint(a)) == a


def test_containment():
    assert fp.containment({}, {}) == 1 and fp.containment({}, {1: 1}) == 0 and fp.containment({1: 1}, {}) == 0
    assert fp.containment({1: 3, 2: 1}, {1: 3}) == 0.75


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def by_hand(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    mark = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), mark(r[1]) if r[0] is None else 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (k, text) in enumerate(rows):
        text, other = text or "", rows[(i + 1) % len(rows)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + other[:third]
        a, b, c = fp.chunk_sets([text, changed, other])
        out.append((k, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.fingerprint(a), fp.fingerprint(b), fp.containment(a, b), fp.containment(a, c)))
    return sorted(out, key=key)


def test_against_next(docs, empty, spark):
    for n in (1, 3, 40):
        assert sorted((tuple(r) for r in fp.against_next(docs, n).collect()), key=key) == by_hand(docs)
    one = spark.createDataFrame([(1, "alone in the table, with some words to spare")], "doc_id long, text string")
    assert [tuple(r) for r in fp.against_next(one).collect()] == by_hand(one)
    assert fp.against_next(empty).count() == 0
    nulls = spark.createDataFrame([(None, f"text number {i % 50}") for i in range(120)] + [(None, None), (5, "x")], "doc_id long, text string")
    for n in (1, 7, 40):
        assert sorted((tuple(r) for r in fp.against_next(nulls, n).collect()), key=key) == by_hand(nulls)
    nulls = spark.createDataFrame([(None, "a text"), (None, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in fp.against_next(nulls).collect()), key=key) == by_hand(nulls)


def test_fingerprints_alone(docs, empty):
    got = {(r.doc_id, r.fingerprint) for r in fp.fingerprints(docs).collect()}
    assert got == {(r[0], r[3]) for r in by_hand(docs)}
    assert fp.fingerprints(empty).count() == 0
