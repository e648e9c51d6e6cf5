"""Language identification by nearest centroid: TF-IDF vectors of hashed letter n-grams, several centroids a language.

The classifier is fitted on a bounded sample of labelled documents (about ``TRAIN_ROWS`` in all, shared evenly by
the languages and chosen by a hash of the id): inverse document frequencies, then spherical k-means within each language.
A document's whole text is compared with all centroids by cosine; its language is that of the nearest one. It is
rejected when even the nearest is further away than nearly all training documents of that language were.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; a language that is null is not
learned from; without any language to learn from every document is ``und``; ties go to the language that comes first by
code point; rows that repeat are predicted each by itself, a repeated id teaches its least text; very long texts are
counted in chunks of ``CHUNK`` characters, an n-gram over the edge of two is not counted; an empty table gives an empty result. Other columns stay as
they are; one with the name of the result gives way to it, ``frames.free_name`` finds a name that is free.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfootprint.session import settle

DIMENSIONS = 4096
ORDERS = (1, 2, 3)
CLUSTERS = 3
TRAIN_ROWS = 4_000
STEPS = 12
REJECT_SHARE = 0.5
CHUNK = 1 << 20
PLACES = 1 << 30
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def gram_counts(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text's letters, words set apart by one space; None without a letter."""
    letter, counts, any_letter = _letters(), np.zeros(dimensions, np.int64), False
    for at in range(0, len(text or ""), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        good = letter[codes]
        if not good.any():
            continue
        any_letter = True
        codes = np.where(good, codes, np.uint64(32))
        codes = np.r_[np.uint64(32), codes[good | np.r_[False, good[:-1]]], np.uint64(32)]
        for order in ORDERS:
            code = codes[: len(codes) - order + 1].copy()
            for k in range(1, order):
                code = code * np.uint64(0x100000001B3) + codes[k : len(codes) - order + 1 + k]
            mixed = (code + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % dimensions, minlength=dimensions)
    return counts if any_letter else None


@dataclass
class Model:
    """Centroids (rows of unit length), their languages, and the least cosine at which each language is accepted."""

    idf: np.ndarray
    centroids: np.ndarray
    language: np.ndarray
    accept: dict[str, float]

    def vector(self, counts: np.ndarray) -> np.ndarray:
        weighed = np.log1p(counts) * self.idf
        return (weighed / max(np.linalg.norm(weighed), 1e-12)).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine with its nearest centroid (0..1) and whether it is rejected."""
        counts = gram_counts(text, len(self.idf)) if len(self.centroids) else None
        if counts is None:
            return UNKNOWN, 0.0, True
        near = self.centroids @ self.vector(counts)
        best = int(np.argmax(near))
        score = float(min(max(near[best], 0.0), 1.0))
        name = str(self.language[best])
        return name, score, score < self.accept[name]


def _spherical_means(rows: np.ndarray, clusters: int, steps: int) -> np.ndarray:
    """Centroids of unit vectors; starts from rows that are far apart."""
    chosen = [rows.mean(axis=0)]
    chosen[0] /= max(np.linalg.norm(chosen[0]), 1e-12)
    while len(chosen) < min(clusters, len(rows)):
        chosen.append(rows[int(np.argmin(np.max(rows @ np.stack(chosen).T, axis=1)))])
    centroids = np.stack(chosen)
    for _ in range(steps):
        own = np.argmax(rows @ centroids.T, axis=1)
        for k in range(len(centroids)):
            if (own == k).any():
                mean = rows[own == k].mean(axis=0)
                centroids[k] = mean / max(np.linalg.norm(mean), 1e-12)
    return centroids


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, clusters: int = CLUSTERS, dimensions: int = DIMENSIONS) -> Model:
    """Model from ``labelled`` (doc_id, text, lang): at most ``train_rows`` documents, as many of each language.

    Of more than ``train_rows`` languages the largest are learned, ties by code point.
    """
    known = labelled.filter("lang is not null and text is not null").select("lang", "doc_id", "text")
    # the largest languages, a row each; their number is at most that of the documents to learn from
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(PLACES))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("least")).orderBy(F.desc("size"), "lang").limit(train_rows)
    sizes = settle(sizes, "languages")
    languages = sizes.count()
    if not languages:
        return Model(np.ones(dimensions), np.zeros((0, dimensions), np.float32), np.array([]), {})
    # a share of each language's documents by the hash of the id, its first one at least: no rank, no sort, one scan
    each = max(1, train_rows // languages)
    share = F.least(F.lit(PLACES), F.floor(F.lit(PLACES) * 1.1 * each / F.col("size")).cast("long") + 1)
    below = F.greatest(share, F.col("least") + 1)
    chosen = known.join(sizes.select("lang", below.alias("below")), "lang").filter(place < F.col("below"))
    # one text per id, the least, so a repeated id brings the same text at every run
    sample = chosen.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = [gram_counts(t, dimensions) for t in frame["text"]]
            good = [c is not None for c in counts]
            packed = [zlib.compress(c.astype("<i4").tobytes(), 1) for c in counts if c is not None]
            yield pd.DataFrame({"lang": frame["lang"][good], "doc_id": frame["doc_id"][good], "counts": packed})

    got = sample.mapInPandas(grams, "lang string, doc_id long, counts binary").toPandas()
    got = got.sort_values(["lang", "doc_id"], ignore_index=True).groupby("lang").head(each)
    if got.empty:
        return Model(np.ones(dimensions), np.zeros((0, dimensions), np.float32), np.array([]), {})
    rows = np.stack([np.frombuffer(zlib.decompress(c), dtype="<i4").astype(np.float32) for c in got["counts"]])
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1
    np.log1p(rows, out=rows)
    rows *= idf.astype(np.float32)
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    centroids, names, accept = [], [], {}
    for lang in sorted(got["lang"].unique()):
        own = rows[(got["lang"] == lang).to_numpy()]
        means = _spherical_means(own, clusters, STEPS)
        centroids.append(means)
        names += [lang] * len(means)
        accept[lang] = REJECT_SHARE * float(np.quantile((own @ means.T).max(axis=1), 0.005))
    return Model(idf, np.concatenate(centroids), np.array(names, dtype=object), accept)


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with the struct ``into``: lang_pred, score and rejected."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [model.predict(None if pd.isna(t) else t) for t in batch]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "rejected"])

    return docs.withColumn(into, predict(F.col(text_col)))


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
