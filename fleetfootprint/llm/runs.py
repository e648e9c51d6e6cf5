"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q that is at least ``EXPONENT`` periods and ``MIN_WORDS`` words long and
that no neighbouring word prolongs. The words are cut into blocks of 2, 4, 8 ... words. A run of period q, with B the
power of two above q, holds a whole block of B words whose nearest occurrence to the right or to the left is exactly q
words away: nearer ones would give the primitive period a period of its own. As the occurrences in a window under twice
the block's length form a progression, that nearest occurrence gives its difference, the candidate period.

Where a block occurs is an interval of the suffix array; the nearest position in it is a range successor, answered by a
wavelet tree over the array. Candidates are then prolonged word by word to both sides, each stretch once.

Documents are worked on in groups of about ``GROUP_WORDS`` words, in which a word counts as another word in every
document. Memory is about 100 bytes a word of the group, so of the longest document; nothing leaves its task but results.

Defined cases: a null text counts as empty and has no words, no runs and an empty collapsed text; rows that repeat are
worked on each by itself; of equally long runs all are returned; a text may be one word of any length; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPONENT = 4
MIN_WORDS = 6
GROUP_WORDS = 1 << 16
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ONE = np.uint64(1)


class WaveletTree:
    """The numbers 0 .. n-1 in some order, one level of bits per binary digit, the leading digit first."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = []
        for digit in reversed(range(max(1, int(len(values) - 1).bit_length()))):
            bits = (values >> digit) & 1
            packed = np.zeros(len(values) // 64 + 1, np.uint64)
            raw = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((digit, packed, before, len(values) - int(bits.sum())))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Set bits in front of ``end``."""
        word = end >> 6
        mask = (ONE << (end & 63).astype(np.uint64)) - ONE
        return before[word] + np.bitwise_count(packed[word] & mask)

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of the values at places low .. high-1 are under ``limit``."""
        count = np.zeros(len(low), np.int64)
        for digit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            one = (limit >> digit) & 1 == 1
            count += np.where(one, (high - b) - (low - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of rank 0, 1 ... among those at places low .. high-1."""
        value = np.zeros(len(low), np.int64)
        for digit, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            left = (high - b) - (low - a)
            one = rank >= left
            rank = np.where(one, rank - left, rank)
            value |= one.astype(np.int64) << digit
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return value


def _blocks(codes: np.ndarray, inner: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array, and for B = 2, 4, ... the blocks that occur twice or more: positions and their interval of the array.

    The array is sorted by doubling, as deep as blocks go. A position whose prefix is unique is in place; only others are
    sorted on. ``inner`` are the positions within the documents, ``longest`` the words of the longest one.
    """
    size = len(codes)
    order = np.argsort(codes, kind="stable")
    sorted_codes = codes[order]
    heads = np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1], [True]])
    starts = np.flatnonzero(heads)
    rank = np.empty(size, np.int64)
    rank[order] = np.repeat(starts[:-1], np.diff(starts))
    places = np.flatnonzero(~(heads[:-1] & heads[1:]))
    found, width = [], 1
    # a block of B words serves periods under B, and a period is at most a fourth of the text
    while len(places) and width <= longest // 2:
        items = order[places]
        key = rank[items] * size + rank[items + width]
        sort = np.argsort(key, kind="stable")
        items, key = items[sort], key[sort]
        order[places] = items
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[items] = places[np.maximum.accumulate(np.where(new, np.arange(len(items)), 0))]
        # groups lie in a row in ``places``; one that ends there ends with its last place
        ends = np.concatenate([np.flatnonzero(new)[1:], [len(items)]])
        end = np.repeat(places[ends - 1] + 1, np.diff(np.concatenate([[0], ends])))
        width *= 2
        many = end - rank[items] > 1
        items, places, end = items[many], places[many], end[many]
        block = inner[items] & (width - 1) == 0
        found.append((width, items[block], rank[items[block]], end[block]))
    return order, found


def _ahead(codes: np.ndarray, at: int, period: int) -> int:
    """The first position from ``at`` on whose word is not the one ``period`` words later."""
    size = 16
    while True:
        later = codes[at + period : at + period + size]
        differ = codes[at : at + len(later)] != later
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, size = at + size, size * 2


def _back(codes: np.ndarray, at: int, period: int) -> int:
    """The position after the last one before ``at`` whose word is not the one ``period`` words later."""
    size = 16
    while True:
        low = max(0, at - size)
        differ = codes[low:at] != codes[low + period : at + period]
        last = int(differ[::-1].argmax())
        if differ[len(differ) - 1 - last]:
            return at - last
        at, size = low, size * 2


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of word codes, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(texts) or sizes.max() < MIN_WORDS:
        return runs
    # every text between two codes of its own, which end all matches; codes of different texts differ
    starts = np.cumsum(sizes + 1) - sizes
    size = int(starts[-1] + sizes[-1] + 1)
    words = np.concatenate(texts).astype(np.int64)
    codes = np.empty(size, np.int64)
    walls = np.concatenate([[0], starts + sizes])
    codes[walls] = -1 - np.arange(len(walls))
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(words))
    codes[inside] = words + np.repeat(np.arange(len(texts)) * (int(words.max()) + 1), sizes)
    inner = np.zeros(size, np.int64)
    inner[inside] = inside - np.repeat(starts, sizes)
    order, blocks = _blocks(codes, inner, int(sizes.max()))
    tree, stretches = None, []
    for width, at, low, high in blocks:
        if not len(at):
            continue
        tree = tree or WaveletTree(order)
        before = tree.below(low, high, at)
        for step in (1, -1):
            rank = before + step
            there = (rank >= 0) & (rank < high - low)
            here = at[there]
            period = (tree.smallest(low[there], high[there], rank[there]) - here) * step
            fits = (period >= width // 2) & (period < width)
            here, period = here[fits], period[fits]
            left = here if step == 1 else here - period
            stretches.append(np.stack([period, left, left + period + width], axis=1))
    if not stretches:
        return runs
    stretches = np.unique(np.concatenate(stretches), axis=0)
    found, last, done = [], 0, 0
    for period, left, right in stretches.tolist():
        if period == last and right <= done:
            continue
        end, start = _ahead(codes, right - period, period) + period, _back(codes, left, period)
        last, done = period, end
        if end - start >= max(MIN_WORDS, EXPONENT * period):
            found.append((start, end - start, period))
    found.sort(key=lambda run: (run[0], run[2]))
    owner = np.searchsorted(starts, [run[0] for run in found], side="right") - 1
    for text, (start, length, period) in zip(owner.tolist(), found):
        runs[text].append((start - int(starts[text]), length, period))
    return runs


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def _group(ids: list, split: list[list[bytes]]) -> pa.RecordBatch:
    codes = pd.factorize(np.array([w for words in split for w in words], dtype=object))[0] if any(split) else np.zeros(0, np.int64)
    found = find_runs(np.split(codes, np.cumsum([len(words) for words in split])[:-1]))
    offsets = np.cumsum([0, *map(len, found)])
    flat = np.array([run for runs in found for run in runs], np.int64).reshape(-1, 3)
    fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)
    collapsed = pa.array([_collapsed(*pair) for pair in zip(split, found)], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, collapsed], ["doc_id", "runs", "collapsed"])


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, split, held = [], [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            # bytes fall apart at exactly the six characters that part words
            words = text.as_py().encode().split()
            if held and held + len(words) > GROUP_WORDS:
                yield _group(ids, split)
                ids, split, held = [], [], 0
            ids.append(doc_id.as_py())
            split.append(words)
            held += len(words)
        if ids:
            yield _group(ids, split)


def periodic_runs(docs: DataFrame, text: Column | str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text without repetitions.

    Of every run the first period stays; a word that any run holds after its first period goes. The words that stay are
    joined by one space.
    """
    text = F.col(text) if isinstance(text, str) else text
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(_tasks, SCHEMA)


def longest(runs: Column) -> Column:
    """The longest run, ties by smallest start, then period; null where there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(ranked)


def listing(runs: Column) -> Column:
    """The runs as lines ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def with_planted_periods(text: Column, doc_id: Column) -> Column:
    """The text, and for every tenth document by hash the same words with a periodic end, as the query's contract sets them."""
    hashed = F.crc32(doc_id.cast("string").cast("binary"))
    seed = F.floor(hashed / 10)

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        start = seed % n
        period = F.floor((n - start) / (seed % 8 + 3)) + 1
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < start, i).otherwise(start + (i - start) % period))
        return F.array_join(F.transform(place, lambda i: F.get(words, i.cast("int"))), " ")

    # bound by a one-element array, or the words would be found again for every place
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit(""))), 1)
    return F.when(hashed % 10 == 0, changed).otherwise(text)
