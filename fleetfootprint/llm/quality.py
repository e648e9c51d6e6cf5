"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded from the make-up of its
characters and words; gated attention weighs the encodings (softmax of w . (tanh(V h) * sigmoid(U h))), and the weighed
sum is scored by a logistic unit. All weights are learned together from the documents' labels.

The model is fitted on a bounded sample: labelled documents in the order of a hash of the id, at most ``TRAIN_ROWS`` of
them and ``TRAIN_PASSAGES`` passages, with every passage of each; one that would go beyond the bound is passed over. Scoring
uses every passage of every text, a text at a time.

Defined cases: a null or empty text is one passage of zeros and gets a score like any other; rows with a null label are
not learned from; with no labels of both kinds the score is the share of label 1 (0.5 without labels); rows that repeat
are scored each by itself, a repeated id teaches its least text and label; ties in the hash are ordered by id; memory for a very long text is
``FEATURES`` numbers per passage; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfootprint.session import settle

PASSAGE_WORDS = 100
TRAIN_ROWS = 4_000
TRAIN_PASSAGES = 200_000
HIDDEN = 24
ATTENTION = 12
EPOCHS = 60
RATE = 0.01
DECAY = 1e-4

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = len(PUNCTUATION) + 6
FEATURES = CLASSES + 7

_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of each code point: lower, upper, other letter, digit, space, any other, then each punctuation mark."""
    global _CLASS
    if _CLASS is None:
        table = np.full(0x110000, 5, np.uint8)
        for code in range(0x30000):
            char = chr(code)
            if char.islower():
                table[code] = 0
            elif char.isupper():
                table[code] = 1
            elif char.isalpha():
                table[code] = 2
            elif char.isdigit():
                table[code] = 3
            elif char.isspace():
                table[code] = 4
        for k, char in enumerate(PUNCTUATION):
            table[ord(char)] = 6 + k
        _CLASS = table
    return _CLASS


def passages(text: str | None) -> np.ndarray:
    """One row of features per passage; a single row of zeros for a text without words."""
    if not text:
        return np.zeros((1, FEATURES), np.float32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _classes()[codes]
    word = kinds != 4
    starts = np.flatnonzero(word & np.r_[True, ~word[:-1]])
    if not len(starts):
        return np.zeros((1, FEATURES), np.float32)
    heads = starts[::PASSAGE_WORDS]
    heads[0] = 0
    count, sizes = len(heads), np.diff(np.r_[heads, len(codes)])
    of_char = np.repeat(np.arange(count), sizes)
    made = np.bincount(of_char * CLASSES + kinds, minlength=count * CLASSES).reshape(count, CLASSES)
    out = np.zeros((count, FEATURES), np.float32)
    out[:, :CLASSES] = np.sqrt(made / sizes[:, None])
    # words: length, repeats of the word before, different words, capital starts; lines
    of_word = np.arange(len(starts)) // PASSAGE_WORDS
    words = np.bincount(of_word, minlength=count)
    letters = np.add.reduceat(word.astype(np.int64), starts)
    spread = np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
    place = np.arange(len(codes)) - np.r_[np.zeros(starts[0], np.int64), spread]
    mixed = np.where(word, (codes.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
    mixed ^= mixed >> np.uint64(29)
    code = np.add.reduceat(mixed, starts)
    again = np.r_[False, code[1:] == code[:-1]]
    order = np.lexsort((code, of_word))
    fresh = np.r_[True, (code[order][1:] != code[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])]
    lines = np.bincount(of_char[codes == 10], minlength=count)
    out[:, CLASSES] = np.bincount(of_word, letters, minlength=count) / words / 10
    out[:, CLASSES + 1] = np.bincount(of_word, again, minlength=count) / words
    out[:, CLASSES + 2] = np.bincount(of_word[order], fresh, minlength=count) / words
    out[:, CLASSES + 3] = np.bincount(of_word, kinds[starts] == 1, minlength=count) / words
    out[:, CLASSES + 4] = np.bincount(of_word, letters > 20, minlength=count) / words
    out[:, CLASSES + 5] = np.log1p(lines) / 4
    out[:, CLASSES + 6] = np.log1p(words) / 5
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    """Weights; ``constant`` replaces them where there was nothing to learn."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, rows: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """All that training needs of one pass over bags laid end to end (``starts``: first passage of each)."""
        w, sizes = self.weights, np.diff(np.r_[starts, len(rows)])
        x = (rows - self.mean) / self.scale
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        t, g = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
        s = (t * g) @ w["attend"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = s / np.repeat(np.add.reduceat(s, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = _sigmoid(z @ w["score"] + w["score_0"])
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "sizes": sizes}

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return float(self.forward(passages(text), np.zeros(1, np.int64))["p"][0])


def _gradient(model: Model, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    w, f = model.weights, model.forward(rows, starts)
    error = (f["p"] - labels) / len(labels)
    dz = np.repeat(error[:, None] * w["score"], f["sizes"], axis=0)
    pull = (dz * f["h"]).sum(axis=1)
    mean_pull = np.repeat(np.add.reduceat(f["a"] * pull, starts), f["sizes"])
    ds = f["a"] * (pull - mean_pull)
    tg = f["t"] * f["g"]
    dtg = ds[:, None] * w["attend"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz + dt @ w["value"].T + dg @ w["gate"].T
    du = dh * (1 - f["h"] ** 2)
    return {
        "encode": f["x"].T @ du, "encode_0": du.sum(axis=0), "value": f["h"].T @ dt, "gate": f["h"].T @ dg,
        "attend": tg.T @ ds, "score": f["z"].T @ error, "score_0": np.array(error.sum()),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1, batch: int = 128) -> Model:
    """Adam on the cross entropy of the bags' labels."""
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(1), np.ones(1), {}, share)
    rng, rows = np.random.default_rng(seed), np.concatenate(bags).astype(np.float64)
    init = lambda *shape: rng.normal(size=shape) / np.sqrt(shape[0])
    weights = {
        "encode": init(FEATURES, HIDDEN), "encode_0": np.zeros(HIDDEN), "value": init(HIDDEN, ATTENTION),
        "gate": init(HIDDEN, ATTENTION), "attend": init(ATTENTION), "score": init(HIDDEN), "score_0": np.zeros(()),
    }
    model = Model(rows.mean(axis=0), rows.std(axis=0) + 0.05, weights)
    sizes = np.array([len(b) for b in bags])
    ends = np.cumsum(sizes)
    first, second, step = {k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}, 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            part = np.concatenate([rows[ends[i] - sizes[i] : ends[i]] for i in own])
            starts = np.cumsum(sizes[own]) - sizes[own]
            step += 1
            for name, grad in _gradient(model, part, starts, labels[own]).items():
                grad = grad + DECAY * weights[name]
                first[name] = 0.9 * first[name] + 0.1 * grad
                second[name] = 0.999 * second[name] + 0.001 * grad**2
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                weights[name] = weights[name] - rate * move
    return model


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_passages: int = TRAIN_PASSAGES) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality of 0 or 1)."""
    ids = docs.select("doc_id").join(labels.filter("quality in (0, 1)").select("doc_id", "quality"), "doc_id")
    # one label and one text per id: the least, so a repeated id takes one place and brings one row to the driver
    place = F.xxhash64("doc_id", F.lit(5))
    chosen = ids.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(place, "doc_id").limit(train_rows)
    texts = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")
    )

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, text, quality in zip(frame["doc_id"], frame["text"], frame["quality"]):
                rows = passages(text)
                yield pd.DataFrame({"doc_id": [doc_id], "quality": [quality], "n": [len(rows)], "packed": [rows.astype("<f4").tobytes()]})

    bags_of = settle(texts.mapInPandas(encode, "doc_id long, quality int, n long, packed binary"), "bags")
    # at most ``train_rows`` numbers, to see which bags fit; only those are fetched
    sizes, free, fit_in = bags_of.select("doc_id", "n").orderBy(place, "doc_id").collect(), train_passages, []
    for row in sizes:
        if row["n"] <= free:
            free -= row["n"]
            fit_in.append(row["doc_id"])
    left_out = sorted({row["doc_id"] for row in sizes} - set(fit_in))
    got = bags_of.filter(~F.col("doc_id").isin(left_out)) if left_out else bags_of
    got = got.select("doc_id", "quality", "packed").toPandas().sort_values(["doc_id", "packed"], ignore_index=True)
    bags = [np.frombuffer(p, dtype="<f4").reshape(-1, FEATURES) for p in got["packed"]]
    return train(bags, got["quality"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0..1, higher: label 1 likelier) and predicted (1 from 0.5 on) of ``docs`` (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": [model.score(t) for t in frame["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
