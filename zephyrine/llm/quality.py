"""Quality classifier: gated attention over passages (multiple-instance learning).

A document is a bag of passages and only the bag is labelled. Each passage is encoded by a small
learned layer over its character and word statistics; a gated attention (Ilse, Tomczak and Welling,
2018) weighs the passages; the weighted mean of their codes gives the document's score. Labels teach
both the encoder and the attention. Fitting uses a bounded labelled sample, scoring is one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zephyrine.llm import common
from zephyrine.llm.rules import labelled

#: Words in a passage.
PASSAGE = 64
#: Labelled rows at most that the model is fitted on.
LABELLED = 6000
CODE, ATTENTION, EPOCHS, BATCH, RATE, DECAY, SEED = 16, 8, 30, 64, 0.01, 1e-4, 9
THRESHOLD = 0.3

#: Groups of bytes whose shares are features of a passage.
GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b"\n",
    b".",
    b",",
    b"!",
    b"?",
    b"|",
    b"#$%&*",
    b"<>{}[]=/\\_",
    b"@:;",
    b"'\"()-",
    bytes(range(128, 256)),
    bytes(x for x in range(32) if x != 10),
]
WIDTH = len(GROUPS) + 6


def _groups() -> np.ndarray:
    out = np.zeros((256, len(GROUPS)))
    for k, group in enumerate(GROUPS):
        out[list(group), k] = 1
    return out


GROUP_OF = _groups()


def passages(text: str) -> np.ndarray:
    """A row of statistics for each passage of PASSAGE words; the last may be shorter.

    A text without words has one passage of zeros. Every whole text is used.
    """
    raw = text.encode("utf-8", "surrogatepass")
    lines = raw.replace(b"\n", b" \n ").split(b" ")
    words = [w for w in lines if w]
    if not words:
        return np.zeros((1, WIDTH))
    histogram, more = [], []
    for lo in range(0, len(words), PASSAGE):
        own = words[lo : lo + PASSAGE]
        n = len(own)
        joined = b" ".join(own)
        histogram.append(np.bincount(np.frombuffer(joined, np.uint8), minlength=256))
        distinct = len(set(own))
        same = sum(a == b for a, b in zip(own, own[1:]))
        short = sum(len(w) <= 3 for w in own)
        more.append((n / PASSAGE, distinct / n, same / n, short / n, min(len(joined) / n / 10, 10.0), min(max(map(len, own)) / 20, 10.0)))
    h = np.array(histogram, float)
    share = (h @ GROUP_OF) / np.maximum(h.sum(axis=1, keepdims=True), 1)
    return np.hstack([np.sqrt(share), np.array(more)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def initial(rng: np.random.Generator, width: int) -> dict[str, np.ndarray]:
        def normal(a: int, b: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(a), (a, b))

        return {
            "E": normal(width, CODE), "e": np.zeros(CODE),
            "V": normal(CODE, ATTENTION), "U": normal(CODE, ATTENTION), "w": normal(ATTENTION, 1)[:, 0],
            "o": rng.normal(0, 1 / np.sqrt(CODE), CODE), "b": np.zeros(1),
        }

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def forward(self, x: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        """All steps for bags whose passages are the rows of ``x`` from ``begins`` on."""
        p = self.weights
        bag = np.zeros(len(x), int)
        bag[begins[1:]] = 1
        bag = np.cumsum(bag)
        h = np.tanh(x @ p["E"] + p["e"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (tv * su) @ p["w"]
        top = np.maximum.reduceat(raw, begins)
        a = np.exp(raw - top[bag])
        a /= np.add.reduceat(a, begins)[bag]
        z = np.add.reduceat(a[:, None] * h, begins, axis=0)
        logit = z @ p["o"] + p["b"][0]
        return {"bag": bag, "h": h, "tv": tv, "su": su, "a": a, "z": z, "logit": logit}

    def gradient(self, x: np.ndarray, begins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, s = self.weights, self.forward(x, begins)
        d = (1 / (1 + np.exp(-s["logit"])) - y) * weight / len(y)
        bag, h, a = s["bag"], s["h"], s["a"]
        dz = d[:, None] * p["o"]
        da = (h * dz[bag]).sum(axis=1)
        draw = a * (da - np.add.reduceat(a * da, begins)[bag])
        gate = draw[:, None] * p["w"]
        dv, du = gate * s["su"] * (1 - s["tv"] ** 2), gate * s["tv"] * s["su"] * (1 - s["su"])
        dh = (a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {
            "E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du,
            "w": (s["tv"] * s["su"]).T @ draw, "o": s["z"].T @ d, "b": np.array([d.sum()]),
        }

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1, for every text."""
        if not texts:
            return np.zeros(0)
        own = [passages(t) for t in texts]
        begins = np.cumsum([0, *map(len, own[:-1])])
        logit = self.forward(self.encode(np.vstack(own)), begins)["logit"]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train(bags_of: list[np.ndarray], y: np.ndarray, seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Fit by Adam over bags of passages, both labels weighing the same. Without both labels the score
    is constant."""
    rng = np.random.default_rng(seed)
    own = bags_of or [np.zeros((1, WIDTH))]
    every = np.vstack(own)
    model = Model(every.mean(axis=0), every.std(axis=0) + 1e-3, Model.initial(rng, WIDTH))
    if len(set(y.tolist())) < 2:
        model.weights["o"][:] = 0
        model.weights["b"][:] = 8.0 if len(y) and y[0] else -8.0 if len(y) else 0.0
        return model
    own = [model.encode(x) for x in own]
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    t = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(own))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            bags = [own[i] for i in part]
            g = model.gradient(np.vstack(bags), np.cumsum([0, *map(len, bags[:-1])]), y[part], weight[part])
            t += 1
            for k, v in model.weights.items():
                step = g[k] + DECAY * v
                first[k] += 0.1 * (step - first[k])
                second[k] += 0.001 * (step**2 - second[k])
                v -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, seed: int = SEED) -> Model:
    """A model learnt from at most ``most`` labelled rows (the first by a hash of the id), none of them held out
    (crc32 of the id as text, modulo 5, is zero). Only texts and labels are seen."""
    chosen = labelled(docs, labels, most, common.crc_mod("doc_id", 5) != 0)

    def make():
        return lambda cols: [cols[0], cols[1], [passages(t).astype(np.float32).tobytes() for t in cols[2]]]

    rows = common.map_texts(chosen, ["doc_id", "quality", "text"], 2, make, BAGS)
    # an id may have many rows
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(most).toArrow()
    bags = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, WIDTH).astype(float) for x in rows.column("x")]
    return train(bags, (rows.column("quality").to_numpy() == 1).astype(float), seed)


BAGS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("x", T.BinaryType())])
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row: the score is the probability of label 1.

    Null and empty texts have one passage of zeros and so a score too. Repeated rows score the same;
    null ids stay null and are not held out unless crc32 of the empty text says so.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(cols):
            s = shared.value.score(cols[1])
            return [cols[0], cols[2], s.tolist(), (s >= THRESHOLD).astype(int).tolist()]

        return step

    columns = [*common.id_text(docs, doc_id, text), (common.crc_mod(doc_id, 5) == 0).alias("held_out")]
    return common.map_texts(docs, columns, 1, make, SCORED)


def keep(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that the classifier predicts to be good, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.keep_rows(docs, text, lambda: lambda texts: (shared.value.score(texts) >= THRESHOLD).tolist())
