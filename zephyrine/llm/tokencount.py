"""Token counts of a byte-level BPE with a merge list, with a whole-token shortcut.

Before the run, every vocabulary string is encoded alone by the merge list. Those that come out as
one token, and that the pre-tokeniser does not cut, form a proven set: a pre-token in it counts one,
with no merging. Only other pre-tokens are merged, once per worker.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.llm import bpe, common, pretoken
from zephyrine.llm.pairs import merge_one

#: Distinct pre-tokens outside the proven set whose counts a worker keeps.
CACHED = 400_000


def byte_chars() -> list[str]:
    """Byte -> the printable character that stands for it in vocabulary files of this kind."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Merges:
    """Merge list over ids: (left, right) -> (rank, joint)."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.first = [vocab[c] for c in byte_chars()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def encode(self, piece: bytes) -> list[int]:
        get = self.pairs.get
        return merge_one([self.first[b] for b in piece], lambda a, b: get((a, b)))


def prove(path: str) -> tuple[dict[str, int], list, frozenset[str], list[str]]:
    """Vocabulary, merges, the proven whole tokens as text, and special strings, of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    added = spec.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("added tokens that take in what is around them are not supported")
    special = [t["content"] for t in added]
    back = {c: b for b, c in enumerate(byte_chars())}
    m = Merges(vocab, merges)
    whole = []
    for word, i in vocab.items():
        if not all(c in back for c in word):
            continue
        piece = bytes(back[c] for c in word)
        try:
            said = piece.decode()
        except UnicodeDecodeError:
            continue
        if said and m.encode(piece) == [i]:
            whole.append(said)
    cut = pretoken.split(whole)
    return vocab, merges, frozenset(w for w, p in zip(whole, cut) if len(p) == 1), special


class Counter:
    def __init__(self, vocab: dict[str, int], merges: list, whole: frozenset[str], special: list[str]):
        self.merges, self.whole = Merges(vocab, merges), whole
        # where several begin at one place the longest is meant
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known = dict.fromkeys(whole, 1)

    def learn(self, piece: str) -> int:
        if len(self.known) >= CACHED + len(self.whole):
            self.known = dict.fromkeys(self.whole, 1)
        n = self.known[piece] = len(self.merges.encode(piece.encode("utf-8", "surrogatepass")))
        return n

    def count(self, texts: list[str]) -> list[int]:
        parts, owner, out = [], [], [0] * len(texts)
        for k, text in enumerate(texts):
            own = self.special.split(text) if self.special else [text]
            out[k] = len(own) - 1
            parts += own
            owner += [k] * len(own)
        for k, pieces in zip(owner, pretoken.split(parts)):
            get = self.known.get
            n = [get(p) for p in pieces]
            if None in n:
                n = [x or self.known.get(p) or self.learn(p) for x, p in zip(n, pieces)]
            out[k] += sum(n)
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(shared: bpe.Shared) -> Counter:
    if shared.id not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[shared.id] = Counter(*shared.value)
    return _COUNTERS[shared.id]


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Strings of the file's added tokens inside a text count one token each and part the text there.
    Null counts as empty: zero bytes and tokens. Rows are independent; other columns are not read.
    """
    shared = bpe.Shared(docs.sparkSession, prove(path))

    def make():
        c = counter(shared)
        return lambda cols: [cols[0], [len(t.encode("utf-8", "surrogatepass")) for t in cols[1]], c.count(cols[1])]

    out = common.map_texts(docs, common.id_text(docs, doc_id, text), 1, make, SCHEMA)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
