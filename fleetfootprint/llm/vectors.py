"""Near-duplicate embeddings: an exact cosine join by subspace blocks.

For unit vectors cosine >= c means a squared distance of at most 2 - 2c. The vectors are rotated (principal axes of a
bounded sample) and cut into blocks of 16 axes; each block gets a share of the squared distance in proportion to its
variance. By the pigeonhole principle a linked pair is within the share in at least one block, so the blocks are
joined one by one: a block's leading axes are cut into cells wider than the block's radius, a vector goes to its own
cell and to the next one where its radius reaches into it. Within a cell a pair of vectors is a candidate only if it is
within the radius along every axis of the block, and of ``TURNS`` more rotations of its axes: an index of bits holds, for
every direction and slice of it, the vectors within the radius of the slice, so a vector's candidates are the intersection of one row of bits per
direction. Only for these the distance in the block is evaluated. What passes is verified on the whole vectors in double precision. A pair counts in the first block whose share it meets
and in the cell of its larger coordinates, so nothing is counted twice and no pairs leave a task: only numbers of links
per vector and a spanning forest of the links do.

A cell that holds more than ``TILE_ROWS`` vectors is dealt into tiles, each pair of tiles being one task. The rotation
moves the work, never the result: it is fitted on at most ``SAMPLE_ROWS`` vectors, chosen by a hash.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and get
n_links 0; vectors of different lengths never link; equal vectors are one node whose number of copies is counted; a cosine of
exactly the threshold links; rows that repeat a vec_id get a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetfootprint.llm.components import connected_components
from fleetfootprint.llm.simhash import merge
from fleetfootprint.session import settle

THRESHOLD = 0.9
BLOCK_AXES = 16
GRID_AXES = 2
CELL_RADII = 4
TILE_ROWS = 16_384
SAMPLE_ROWS = 4_096
SLACK = 1e-9
TURNS = 2
SLICES = 64
QUERIES = 256
PAIRS_AT_ONCE = 200_000


def _unit(packed: pd.Series, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as given (float64) and scaled to length one."""
    raw = np.frombuffer(b"".join(packed), dtype="<f8").reshape(-1, length)
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _pack(frames):
    """(vec_id, packed) with the vector as float64 bytes; null where it cannot link."""
    for frame in frames:
        packed = []
        for vector in frame["embedding"]:
            values = None if vector is None else np.asarray(vector, dtype="<f8")
            good = values is not None and len(values) and np.isfinite(values).all() and values.any()
            packed.append(values.tobytes() if good else None)
        yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "packed": pd.Series(packed, dtype=object)})


class Blocks:
    """Rotation, blocks and their shares of the squared distance for vectors of one length."""

    def __init__(self, sample: np.ndarray, budget: float, block_axes: int = BLOCK_AXES) -> None:
        length = sample.shape[1]
        spread = sample.T @ sample / max(1, len(sample)) + np.eye(length) * 1e-6
        values, axes = np.linalg.eigh(spread)
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        values = values[::-1]
        count = max(1, length // block_axes)
        self.edges = [length * i // count for i in range(count + 1)]
        parts = np.array([values[a:b].sum() for a, b in zip(self.edges, self.edges[1:])])
        self.shares = budget * parts / parts.sum()

    def project(self, unit: np.ndarray, block: int) -> np.ndarray:
        return unit @ self.axes[:, self.edges[block] : self.edges[block + 1]]


def _cells(blocks: Blocks, unit: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Own cell on the leading axes, and the cell of the point moved up by the radius."""
    radius = float(np.sqrt(blocks.shares[block])) * (1 + SLACK) + SLACK
    width = CELL_RADII * radius
    lead = blocks.project(unit, block)[:, :GRID_AXES]
    return np.floor(lead / width + 0.5).astype(np.int64), np.floor((lead + radius) / width + 0.5).astype(np.int64)


class RangeIndex:
    """Which points of a block may be within a radius along each of its axes and of some rotations of them, as bits.

    Along a direction the points are cut into slices; a row of bits holds the points of all slices that come within the radius of a
    slice, so it has every point that is within the radius of anything in that slice.
    """

    def __init__(self, points: np.ndarray, radius: float, turns: int, slices: int) -> None:
        axes, rng = points.shape[1], np.random.default_rng(7)
        self.turned = np.hstack([np.eye(axes), *[np.linalg.qr(rng.normal(size=(axes, axes)))[0] for _ in range(turns)]])
        self.words = (len(points) + 63) // 64
        slices = max(1, min(slices, len(points) // 16))
        reach, at = radius + SLACK, np.arange(len(points))
        bit = np.uint64(1) << (at % 64).astype(np.uint64)
        self.cuts, self.rows, self.own = [], [], []
        for along in self.along(points):
            # slices of about equal numbers; where they are cut changes how much is let through, never what must be
            some = np.sort(along[:: max(1, len(along) // 2048)])
            cuts = some[len(some) * np.arange(1, slices) // slices]
            own = np.searchsorted(cuts, along, side="right")
            each = np.zeros((slices, self.words), np.uint64)
            np.add.at(each.reshape(-1), own * self.words + at // 64, bit)
            first = np.searchsorted(cuts, np.r_[-np.inf, cuts] - reach, side="left")
            last = np.searchsorted(cuts, np.r_[cuts, np.inf] + reach, side="right")
            self.rows.append(np.stack([np.bitwise_or.reduce(each[i : j + 1], axis=0) for i, j in zip(first, last)]))
            self.cuts.append(cuts)
            self.own.append(own)

    def along(self, points: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray((points @ self.turned).T)

    def slices_of(self, points: np.ndarray) -> list[np.ndarray]:
        """The slice of each point along each direction."""
        return [np.searchsorted(cuts, along, side="right") for cuts, along in zip(self.cuts, self.along(points))]

    def candidates(self, slices: list[np.ndarray], from_word: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``slices``, point) that every direction lets through, of the points from 64 * ``from_word`` on."""
        bits = self.rows[0][slices[0], from_word:]
        other = np.empty((len(bits), self.words), np.uint64)
        for rows, own in zip(self.rows[1:], slices[1:]):
            # whole rows are taken faster than parts of rows
            np.take(rows, own, axis=0, out=other, mode="clip")
            np.bitwise_and(bits, other[:, from_word:], out=bits)
        flat = bits.reshape(-1)
        some = np.flatnonzero(flat)
        found = np.flatnonzero(np.unpackbits(flat[some].view(np.uint8), bitorder="little"))
        query, word = np.divmod(some, bits.shape[1])
        return query[found >> 6], ((word[found >> 6] + from_word) << 6) + (found & 63)


def block_pairs(points: np.ndarray, radius: float, left: np.ndarray, right: np.ndarray):
    """Candidate pairs (i, j) of rows of ``points`` in pieces: i of ``left`` and j of ``right``, or i < j where both are the same."""
    if not len(left) or not len(right):
        return
    index, same = RangeIndex(points[right], radius, TURNS, SLICES), left is right
    slices = index.own if same else index.slices_of(points[left])
    for at in range(0, len(left), QUERIES):
        i, j = index.candidates([own[at : at + QUERIES] for own in slices], at // 64 if same else 0)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        for part in range(0, len(i), PAIRS_AT_ONCE):
            yield left[i[part : part + PAIRS_AT_ONCE]], right[j[part : part + PAIRS_AT_ONCE]]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding)."""
    budget = 2 - 2 * threshold
    every = settle(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(
            _pack, "vec_id long, packed binary"
        ),
        "vectors",
    )
    distinct = settle(
        every.filter("packed is not null").groupBy("packed").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()).withColumn("length", (F.octet_length("packed") / 8).cast("int")),
        "distinct-vectors",
    )
    lengths = [r["length"] for r in distinct.groupBy("length").count().orderBy(F.desc("count")).collect()]
    plans = {}
    for length in lengths:
        sample = distinct.filter(F.col("length") == length).orderBy(F.xxhash64("packed"), "least").limit(sample_rows).select("packed").toPandas()["packed"]
        plans[length] = Blocks(_unit(sample, length)[1], budget)

    def deal(frames):
        for frame in frames:
            for length, part in frame.groupby("length"):
                blocks, unit = plans[length], _unit(part["packed"], length)[1]
                for block in range(len(blocks.shares)):
                    own, far = _cells(blocks, unit, block)
                    for corner in range(1 << own.shape[1]):
                        up = np.array([(corner >> k) & 1 for k in range(own.shape[1])], bool)
                        here = (far[:, up] > own[:, up]).all(axis=1)
                        cell = np.where(up, far, own)[here]
                        rows = part[here]
                        yield pd.DataFrame({
                            "node": rows["node"], "packed": rows["packed"], "copies": rows["copies"], "length": length, "block": block,
                            "x": cell[:, 0], "y": cell[:, 1] if cell.shape[1] > 1 else 0,
                        })

    key = ["length", "block", "x", "y"]
    dealt = distinct.select("node", "packed", "copies", "length").mapInPandas(
        deal, "node long, packed binary, copies long, length int, block int, x long, y long"
    )
    sizes = settle(dealt.groupBy(*key).count().select(*key, F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")), "cells")
    tile = F.pmod(F.xxhash64("node", F.lit(11)), F.col("tiles")).cast("int")
    tiled = dealt.join(sizes, key).withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))

    def compare(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        length, block, x, y, low, high = keys
        blocks, cell = plans[length], np.array([x, y])
        frame = frame.sort_values("node", ignore_index=True)
        raw, unit = _unit(frame["packed"], length)
        node, copies, tiles = frame["node"].to_numpy(), frame["copies"].to_numpy(), frame["tile"].to_numpy()
        parts = [blocks.project(unit, b) for b in range(len(blocks.shares))]
        own, links, label = _cells(blocks, unit, block)[0], np.zeros(len(frame), np.int64), np.arange(len(frame))
        mine, radius = parts[block], float(np.sqrt(blocks.shares[block] * (1 + SLACK) + SLACK))
        norm = np.linalg.norm(raw, axis=1)
        left_rows = np.flatnonzero(tiles == low)
        right_rows = left_rows if low == high else np.flatnonzero(tiles == high)
        g = own.shape[1]
        for a, b in block_pairs(mine, radius, left_rows, right_rows):
            # exactly here, by the condition that later blocks use
            first = ((mine[a] - mine[b]) ** 2).sum(axis=1) <= blocks.shares[block] * (1 + SLACK) + SLACK
            a, b = a[first], b[first]
            first = (np.maximum(own[a], own[b]) == cell[:g]).all(axis=1)
            for earlier in range(block):  # counted there
                gap = ((parts[earlier][a] - parts[earlier][b]) ** 2).sum(axis=1)
                first &= gap > blocks.shares[earlier] * (1 + SLACK) + SLACK
            a, b = a[first], b[first]
            linked = np.einsum("ij,ij->i", raw[a], raw[b]) / (norm[a] * norm[b]) >= threshold
            a, b = a[linked], b[linked]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            label = merge(label, a, b)
        some = np.flatnonzero(links)
        return pd.DataFrame({"node": node[some], "links": links[some], "to": node[label[some]]})

    found = settle(
        tiled.select("node", "packed", "copies", *key, "tile", "low", "high").groupBy(*key, "low", "high").applyInPandas(compare, "node long, links long, to long"),
        "links",
    )
    joined = connected_components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        distinct.select("node", "packed", "least", "copies").join(links, "node", "left").join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_vector = settle(
        placed.join(named, "component").select("packed", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"),
        "vector-classes",
    )
    return every.join(of_vector, "packed", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
