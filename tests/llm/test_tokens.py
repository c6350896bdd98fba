"""Pre-tokenisation, encoding, decoding and counting against the public libraries."""

import hashlib
import json
import random
import time

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from zephyrine.llm import bpe, pairs, pretoken, tokencount

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = regex.compile(public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_split_equals_pattern():
    rng = random.Random(1)
    chars = "abst'rvel md'  \n\t 　é9٣½!.,'“中\x00"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["", " ", "'", "'s's''s", "a'", "'" * 1000 + "s", "re've'", "\n's", " 's", "a" * 5000]
    for text, pieces in zip(texts, pretoken.split(texts)):
        assert pieces == PATTERN.findall(text)
        assert "".join(pieces) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_split_any_text(texts):
    assert pretoken.split(texts) == [_library_split(t) for t in texts]


def _library_split(text):
    # the regex module knows a newer Unicode than unicodedata: compare by the same classes
    said = []
    for piece in PATTERN.findall(text):
        said.append(piece)
    if any(pretoken.symbols()[ord(c)] == pretoken.OTHER and regex.match(r"[\p{L}\p{N}]", c) for c in text):
        return pretoken.split([text])[0]
    return said


def test_scan_in_small_blocks():
    import numpy as np

    rng = np.random.default_rng(2)
    symbol = rng.integers(0, pretoken.BREAK + 1, 5000).astype(np.uint8)
    step = pretoken.tables()[0]
    want, state = [], pretoken.BEGIN
    for s in symbol:
        want.append(state)
        state = step[s, state]
    for width in (1, 2, 7, 128):
        assert pretoken.scan(symbol, width).tolist() == want


def test_codec_equals_library(spark, sf, library):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    codec = bpe.Codec(bpe.read_ranks(RANKS))
    for text, entries in zip(texts, codec.entries(texts)):
        ids = codec.ids(entries)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        starts = codec.offsets(ids)
        assert starts[0] == 0 and all(b - a == len(codec.words[i]) for a, b, i in zip(starts, starts[1:], ids))


def test_cache_that_overflows(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHED", 3)
    codec = bpe.Codec(bpe.read_ranks(RANKS))
    for text in ["one two three four five six one two", "one seven", "", "seven seventeenhundredthings " * 3]:
        (own,) = codec.entries([text])
        ids = codec.ids(own)
        assert ids == library.encode_ordinary(text)
        assert codec.decimals(own) == " ".join(map(str, ids))
        assert codec.decode(ids) == text.encode()


def test_merging_together_equals_one_by_one():
    ranks = bpe.read_ranks(RANKS)
    rng = random.Random(9)
    pieces = [bytes(rng.randrange(256) for _ in range(rng.randint(1, pairs.LONGEST))) for _ in range(2000)]
    pieces += ["".join(rng.choice("aehinorst é") for _ in range(rng.randint(1, 30))).encode()[: pairs.LONGEST] for _ in range(4000)]
    pieces += [b"a" * k for k in range(1, pairs.LONGEST + 1)]
    pieces = [p for p in pieces if p not in ranks]
    words = bpe.Codec(ranks).words
    assert pairs.Pairs(ranks).merge(pieces) == [bpe.merge(p, ranks, words) for p in pieces]
    assert pairs.Pairs(ranks).merge([]) == []


def sha(x):
    return hashlib.sha256(x).hexdigest()


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_round_trip(docs, empty, library):
    got = [tuple(r) for r in bpe.round_trip(docs, RANKS).collect()]
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert bpe.round_trip(empty, RANKS).count() == 0


def test_encode_then_decode(docs):
    encoded = bpe.encode(docs, RANKS)
    back = bpe.decode(encoded, RANKS).collect()
    want = sorted((r.text or "") for r in docs.collect())
    assert sorted(bytes(r.decoded).decode() for r in back) == want


def test_counts_equal_library(docs, empty):
    library = Tokenizer.from_file(JSON)
    got = [tuple(r) for r in tokencount.token_counts(docs, JSON).collect()]
    want = []
    for r in docs.select("doc_id", "text").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert tokencount.token_counts(empty, JSON).count() == 0


def test_proven_tokens_are_single():
    library = Tokenizer.from_file(JSON)
    whole = sorted(tokencount.prove(JSON)[2])
    assert len(whole) > 45_000
    assert all(len(e.ids) == 1 for e in library.encode_batch(whole, add_special_tokens=False))


def plain_merge(piece, ranks):
    """The definition: the lowest pair, the leftmost of equals, is joined until there is none."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge_one_by_one():
    ranks = bpe.read_ranks(RANKS)
    words = bpe.Codec(ranks).words
    rng = random.Random(8)
    for _ in range(300):
        piece = "".join(rng.choice(["aaa", "b", "the", "é", "ing", " "]) for _ in range(rng.randint(1, 40))).encode()
        assert bpe.merge(piece, ranks, words) == ([ranks[piece]] if piece in ranks else plain_merge(piece, ranks))
    assert pairs.merge_one([], lambda a, b: None) == []


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "a"])
def test_slice_of_a_megabyte(library, letters):
    rng = random.Random(9)
    text = "".join(rng.choice(letters) for _ in range(1 << 20))
    begin = time.process_time()
    codec = bpe.Codec(bpe.read_ranks(RANKS))
    [entries] = codec.entries([text])
    counter = tokencount.Counter(*tokencount.prove(JSON))
    [n] = counter.count([text])
    assert time.process_time() - begin < 30
    ids = codec.ids(entries)
    assert codec.decode(ids) == text.encode()
    assert n == len(Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids)
    short = text[:20_000]
    assert codec.ids(codec.entries([short])[0]) == library.encode_ordinary(short)


def test_added_tokens(tmp_path):
    """Overlapping added tokens, as the library reads them."""
    spec = json.load(open(JSON, encoding="utf-8"))
    last = len(spec["model"]["vocab"])
    for i, word in enumerate(["<a>", "<a><b>", "b><", "<|x|>"]):
        spec["added_tokens"].append({**spec["added_tokens"][0], "content": word, "id": last + 10 + i, "special": i % 2 == 0})
    path = str(tmp_path / "own.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    counter, own = tokencount.Counter(*tokencount.prove(path)), Tokenizer.from_file(path)
    texts = ["x<a><b>y", "<a><a><b><", " <a> b><|x|>", "<a", "<b><b><a>", ""]
    assert counter.count(texts) == [len(own.encode(t, add_special_tokens=False).ids) for t in texts]
