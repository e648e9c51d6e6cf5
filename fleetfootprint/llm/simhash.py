"""SimHash near-duplicates: fingerprints linked at few differing bits, found by a Gray-order hierarchical index.

Two fingerprints that differ in at most ``max_bits`` bits agree on at least one of ``max_bits + 1`` blocks of bits, so
every fingerprint goes to one bucket per block, by the block's value. Within a value the fingerprints are sorted by
their rank in the Gray code, which puts codes with few differences side by side; runs of sixteen form the leaves of a
tree, and each node keeps the bits that all codes below it share and its ancestors do not: a mask and a pattern. A
search adds up the differences to the patterns on its way down and drops a whole group when they exceed the limit or
when the group is already known to be linked with the code. A task passes on a spanning forest of its links only.

A value that holds more than ``HOT_KEY`` different fingerprints is dealt out again by blocks of the remaining bits,
which by the same argument loses no pair. Equal fingerprints are one node however many documents have them.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and is linked like any other; rows that
repeat get a row each; a null doc_id is kept and never names a component unless all its members are null; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfootprint.llm.components import connected_components
from fleetfootprint.session import settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
SHINGLE = 3
SEED = 42
BITS = 64
MAX_BITS = 3
FANOUT = 16
BUCKET_ROWS = 20_000
HOT_KEY = 10_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included."""
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    total, ones = len(shingles), np.zeros(BITS, np.int64)
    for at in range(0, total, 65_536):
        part = shingles[at : at + 65_536]
        codes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in part], dtype=">u8")
        ones += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes = np.array([fingerprint(t) for t in frame["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": codes})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Index of the codes of one or more values; ``keys`` and ``codes`` are sorted by key, then Gray rank."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, fanout: int = FANOUT) -> None:
        self.codes = codes
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        # levels[0] are the codes themselves; a node is a run of children that never crosses a key
        self.levels = [np.arange(len(codes) + 1)]
        self.masks = [np.full(len(codes), ~np.uint64(0))]
        self.patterns = [codes]
        group = starts
        while True:
            size = len(self.masks[-1])
            ends = np.r_[group[1:], size]
            counts = -(-(ends - group) // fanout)
            first = np.repeat(group, counts)
            step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = first + step * fanout
            both = np.bitwise_and.reduceat(self.masks[-1], begin)
            ones = np.bitwise_and.reduceat(self.patterns[-1] & self.masks[-1], begin)
            zeros = np.bitwise_and.reduceat(~self.patterns[-1] & self.masks[-1], begin)
            self.levels.append(np.r_[begin, size])
            self.masks.append(both & (ones | zeros))
            self.patterns.append(ones)
            group = np.cumsum(counts) - counts
            if (counts == 1).all():
                break
        self.top_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
        # bits that a parent already tests are not tested again below it
        self.rest = []
        for level in range(len(self.levels) - 1, -1, -1):
            mask = self.masks[level]
            if level < len(self.levels) - 1:
                mask = mask & ~np.repeat(self.masks[level + 1], np.diff(self.levels[level + 1]))
            self.rest.append(mask)
        self.rest.reverse()
        self.spans = [np.arange(len(codes) + 1)]
        for level in range(1, len(self.levels)):
            self.spans.append(self.spans[-1][self.levels[level]])

    def links(self, limit: int, chunk: int = 2048) -> np.ndarray:
        """Least linked position, per code, after joining every pair of codes of a key within ``limit`` bits."""
        label = np.arange(len(self.codes))
        for at in range(0, len(self.codes), chunk):
            query = np.arange(at, min(at + chunk, len(self.codes)))
            node, spent = self.top_of[query], np.zeros(len(query), np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                spent = spent + np.bitwise_count((self.codes[query] ^ self.patterns[level][node]) & self.rest[level][node])
                keep = (spent <= limit) & (self.spans[level][node + 1] - 1 > query)
                if level:
                    least = np.minimum.reduceat(label, self.spans[level][:-1])
                    most = np.maximum.reduceat(label, self.spans[level][:-1])
                    keep &= (least[node] != most[node]) | (least[node] != label[query])
                query, node, spent = query[keep], node[keep], spent[keep]
                if level:
                    begin = self.levels[level][node]
                    width = self.levels[level][node + 1] - begin
                    query, spent = np.repeat(query, width), np.repeat(spent, width)
                    node = np.repeat(begin, width) + np.arange(len(query)) - np.repeat(np.cumsum(width) - width, width)
            label = merge(label, query, node)
        return label


def merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Join the classes of each pair; labels are the least position of a class."""
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _blocks(width: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of ``parts`` blocks that make up ``width`` bits."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _outside(shift: int, width: int, column):
    """The bits of a fingerprint that are not in a block, drawn together."""
    low = column.bitwiseAND(F.lit((1 << shift) - 1)) if shift else F.lit(0).cast("long")
    high = F.shiftrightunsigned(column, shift + width) if shift + width < BITS else F.lit(0).cast("long")
    return low.bitwiseOR(F.shiftleft(high, shift))


def forest(codes: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS, hot_key: int = HOT_KEY) -> DataFrame:
    """Links (a, b) between different fingerprints ``fp`` that join what lies within ``max_bits`` bits.

    ``codes`` holds each fingerprint once.
    """
    parts = max_bits + 1
    value = lambda column, shift, width: F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1))
    keyed = codes.select(
        "fp",
        F.inline(
            F.array(*(
                F.struct(F.lit(i).alias("block"), value(F.col("fp"), s, w).alias("value"), _outside(s, w, F.col("fp")).alias("left"))
                for i, (s, w) in enumerate(_blocks(BITS, parts))
            ))
        ),
    )
    hot = settle(keyed.groupBy("block", "value").count().filter(F.col("count") > hot_key).select("block", "value", F.lit(True).alias("hot")), "hot-blocks")
    again = F.array(*(
        F.xxhash64(F.lit(i), value(F.col("left"), s, w)) for i, (s, w) in enumerate(_blocks(BITS - BITS // parts, parts))
    ))
    dealt = keyed.join(hot, ["block", "value"], "left").select(
        "fp", "block", "value", F.explode(F.when(F.col("hot"), again).otherwise(F.array(F.lit(0).cast("long")))).alias("deeper")
    )
    buckets = max(1, -(-codes.count() * parts // bucket_rows))
    dealt = dealt.select("fp", F.xxhash64("block", "value", "deeper").alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        keys, own = frame["key"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(own), keys))
        keys, own = keys[order], own[order]
        label = GrayIndex(keys, own).links(max_bits)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": own[moved].view(np.int64), "b": own[label[moved]].view(np.int64)})

    return dealt.groupBy("bucket").applyInPandas(search, "a long, b long")


def classes(codes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, component_id (smallest id reachable) for ``codes`` (fp, least: the smallest id of each fingerprint)."""
    joined = connected_components(forest(codes, max_bits))
    placed = codes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    return settle(placed.join(named, "component").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable through links of at most ``max_bits`` bits)."""
    coded = settle(fingerprints(docs, id_col, text_col), "fingerprints")
    codes = settle(coded.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    return coded.join(classes(codes, max_bits), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per group of near-duplicates: that with the smallest id (null last), then the smallest row hash.

    Rows are told apart by their id and a hash of the whole row, so only these and the fingerprints are written in
    between; texts move once, to meet the rows that stay. That join sorts both sides at every size. Rows that are the
    same in every column count as one.
    """

    @F.pandas_udf("long")
    def code(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(None if pd.isna(t) else t) for t in batch], dtype=np.uint64).view(np.int64))

    mark = F.xxhash64(*docs.columns)
    slim = settle(docs.select(F.col(id_col).alias("id"), mark.alias("mark"), code(F.col(text_col)).alias("fp")), "marks")
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("mark"))
    best = settle(slim.groupBy("fp").agg(F.min(rank).alias("best")), "best")
    joined = connected_components(forest(best.select("fp"), max_bits))
    placed = best.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    winners = settle(placed.groupBy("component").agg(F.min("best").alias("best")).select("best.id", "best.mark"), "winners")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), mark.alias("mark"))
    same = (rows["mark"] == winners["mark"]) & rows["id"].eqNullSafe(winners["id"])
    kept = rows.join(winners.hint("merge"), same, "left_semi")
    twins = slim.groupBy("id", "mark").count().filter("count > 1")
    if not twins.isEmpty():
        kept = kept.dropDuplicates(["id", "mark"])
    return kept.select("row.*")
