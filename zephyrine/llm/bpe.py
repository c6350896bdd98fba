"""Byte-level BPE: encoding with offsets, decoding, and digests of both.

Texts are split by :mod:`pretoken`; new slices of a batch are merged together (:mod:`pairs`) and their ids
cached, so the cost per occurrence is one look-up. The cache is bounded: it starts again when full.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.llm import common, pretoken
from zephyrine.llm.pairs import LONGEST, Pairs, merge_one

#: Distinct slices whose ids a worker keeps.
CACHED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A ranks file: lines of a base64 token and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], words: list[bytes]) -> list[int]:
    """Ids of one slice of any length; ``words`` are the tokens by id. A slice that is a token itself is that
    token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    get = ranks.get

    def find(a: int, b: int) -> tuple[int, int] | None:
        joint = get(words[a] + words[b])
        return None if joint is None else (joint, joint)

    return merge_one([ranks[piece[i : i + 1]] for i in range(len(piece))], find)


Entry = tuple[tuple[int, ...], str]


class Codec:
    """Encoder and decoder over one ranks table. An entry is a slice's ids and their decimal numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, i in ranks.items():
            self.words[i] = word
        self.ints = list(range(len(self.words)))
        self.said = list(map(str, self.ints))
        self.pairs = Pairs(ranks)
        self.cache: dict[str, Entry] = {}

    def learn(self, slices: list[str]) -> dict[str, Entry]:
        """Entries of slices that the cache lacks; all are merged together. Nothing that is made here holds a
        cycle, so the collector need not walk it meanwhile."""
        gc.disable()
        try:
            return self._learn(slices)
        finally:
            gc.enable()

    def _learn(self, slices: list[str]) -> dict[str, Entry]:
        raw = [p.encode("utf-8", "surrogatepass") for p in slices]
        get, short = self.ranks.get, []
        ids: list[list[int]] = []
        for k, piece in enumerate(raw):
            whole = get(piece)
            if whole is not None:
                ids.append([whole])
            elif len(piece) <= LONGEST:
                ids.append([])
                short.append(k)
            else:
                ids.append(merge(piece, self.ranks, self.words))
        for k, own in zip(short, self.pairs.merge([raw[k] for k in short])):
            ids[k] = own
        ints, said = self.ints, self.said
        found = {p: (tuple([ints[i] for i in own]), " ".join([said[i] for i in own])) for p, own in zip(slices, ids)}
        if len(self.cache) + len(found) > CACHED:
            self.cache.clear()
        self.cache.update(found)
        return found

    def look(self, texts: list[list[str]]) -> list[list[Entry]]:
        """The entries of the slices of each text."""
        get = self.cache.get
        out = [[get(p) for p in own] for own in texts]
        holes = [k for k, own in enumerate(out) if None in own]
        if holes:
            found = self.learn(list({p for k in holes for p, e in zip(texts[k], out[k]) if e is None}))
            for k in holes:
                out[k] = [e or found[p] for p, e in zip(texts[k], out[k])]
        return out

    def entries(self, texts: list[str]) -> list[list[Entry]]:
        return self.look(pretoken.split(texts))

    @staticmethod
    def ids(entries: list[Entry]) -> list[int]:
        return list(chain.from_iterable([e[0] for e in entries]))

    @staticmethod
    def decimals(entries: list[Entry]) -> str:
        """The ids as decimal numbers with one space between."""
        return " ".join([e[1] for e in entries])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def offsets(self, ids: list[int]) -> list[int]:
        """Where each token's bytes begin in the encoded text."""
        out, at = [], 0
        for i in ids:
            out.append(at)
            at += len(self.words[i])
        return out


_CODECS: dict[int, Codec] = {}


def codec(shared) -> Codec:
    """This worker's codec for a broadcast ranks table."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(shared.value)
        # the tables stay, so the collector need not walk them again
        gc.collect()
        gc.freeze()
    return _CODECS[shared.id]


class Shared:
    """A broadcast with a key by which workers find what they made of it."""

    def __init__(self, spark: SparkSession, value):
        common.ship(spark)
        self.held = spark.sparkContext.broadcast(value)
        self.id = f"{spark.sparkContext.applicationId}/{self.held._jbroadcast.id()}"

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self):
        return self.held.value


ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("offsets", T.ArrayType(T.LongType())),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def encode(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, offsets``: token ids of every whole text and the byte at which each begins.

    Null and empty texts give empty arrays; repeated rows give repeated rows; no size limit.
    """
    shared = Shared(docs.sparkSession, read_ranks(ranks_path))

    def make():
        c = codec(shared)

        def step(cols):
            ids = [c.ids(e) for e in c.entries(cols[1])]
            return [cols[0], ids, [c.offsets(x) for x in ids]]

        return step

    return common.map_texts(docs, common.id_text(docs, doc_id, text), 1, make, ENCODED)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column ``to``: the bytes that the ids stand for (null ids: empty).

    An id that the table lacks decodes to nothing. Other columns pass through; a column named ``to``
    is replaced.
    """
    shared = Shared(encoded.sparkSession, read_ranks(ranks_path))

    @F.pandas_udf(T.BinaryType())
    def back(rows):
        words = codec(shared).words
        return rows.map(lambda x: b"".join(words[i] for i in (x if x is not None else ()) if 0 <= i < len(words)))

    return encoded.withColumn(to, back(F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", place: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, and the long column ``place`` if given.

    The ids' digest is over their decimal numbers joined by one space, the other over the bytes that
    decoding the ids gives. Null counts as empty: no tokens, and both digests are the empty string's.
    Rows are independent, so ties and repeated rows change nothing.
    """
    shared = Shared(docs.sparkSession, read_ranks(ranks_path))

    def make():
        c = codec(shared)
        sha = hashlib.sha256

        def step(cols):
            n, said, back = [], [], []
            for own in c.entries(cols[1]):
                ids = c.ids(own)
                n.append(len(ids))
                said.append(sha(c.decimals(own).encode()).hexdigest())
                back.append(sha(c.decode(ids)).hexdigest())
            return [cols[0], n, said, back, *cols[2:]]

        return step

    columns, schema = common.id_text(docs, doc_id, text), DIGESTS
    if place is not None:
        columns = [*columns, F.col(f"`{place}`").cast("long").alias(place)]
        schema = T.StructType([*DIGESTS.fields, T.StructField(place, T.LongType())])
    return common.map_texts(docs, columns, 1, make, schema)
