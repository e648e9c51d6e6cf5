"""Harmonic packing of token sequences.

A document's ids are cut into pieces; a piece whose length lies in (capacity/(k+1), capacity/k] belongs to class k,
and a bin of class k takes exactly k pieces. Classes are independent, so each task fills its own bins while it
streams over its documents: no shuffle and no shared state; what it holds is one open bin per class.

Documents are cut into whole sequences and the rest by halves (512, 256, ... tokens), which fill the bins of
their classes to the last token; only the tail of at most ``capacity / 16`` tokens leaves its class's bins slightly
open. Open bins left at the end of a task are closed together, largest piece first, in as few bins as next-fit
gives. A sequence's id is the task's number and a count within it, so a task that is run again gives the same ids.

Defined cases: a null or empty text is the separator alone; rows that repeat are packed each by itself; null ids
stay null; pieces of equal length keep the order in which they come; a very long text is encoded as a whole by its task; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
SEPARATOR = 0
TAIL_SHARE = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_bpe() -> Callable[[list[str]], list[np.ndarray]]:
    """Encoder of byte_bpe_50k.json without special tokens added.

    The rank file of the same vocabulary gives the same ids several times faster; only a text in which a special
    token is spelled out goes through the tokenizer file, which reads it as one token.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    specials = [token.content for token in exact.get_added_tokens_decoder().values()]

    def encode(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if any(token in text for token in specials):
                ids = exact.encode(text, add_special_tokens=False).ids
            else:
                ids = fast.encode_ordinary(text)
            out.append(np.asarray(ids, dtype="<u4"))
        return out

    return encode


def cuts(n: int, capacity: int, tail: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: whole sequences, then halves, then a tail of at most ``tail``."""
    lengths = [capacity] * (n // capacity)
    rest, half = n % capacity, capacity
    while rest > tail:
        half //= 2
        if rest >= half:
            lengths.append(half)
            rest -= half
    if rest:
        lengths.append(rest)
    return lengths


class HarmonicBins:
    """Open bins of one task, one per class; ``add`` returns the pieces of a bin that became full."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: dict[int, list[tuple]] = {}

    def add(self, piece: tuple, length: int) -> list[tuple] | None:
        k = self.capacity // length
        pieces = self.open.setdefault(k, [])
        pieces.append((length, piece))
        return self.open.pop(k) if len(pieces) == k else None

    def rest(self) -> Iterator[list[tuple]]:
        left = sorted((x for pieces in self.open.values() for x in pieces), key=lambda x: -x[0])
        bin_, used = [], 0
        for length, piece in left:
            if used + length > self.capacity:
                yield bin_
                bin_, used = [], 0
            bin_.append((length, piece))
            used += length
        if bin_:
            yield bin_


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]] = byte_bpe,
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece, as ``PIECES``; ``with_ids`` adds the piece's token ids."""
    schema = PIECES + (", ids array<long>" if with_ids else "")
    tail = max(1, capacity // TAIL_SHARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(), HarmonicBins(capacity)
        first = TaskContext.get().partitionId() << 40
        made, rows = 0, []

        def close(pieces: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for length, piece in pieces:
                rows.append((*piece[:5], first + made, offset, *piece[5:]))
                offset += length
            made += 1

        def flush() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
            columns = list(zip(*rows)) or [()] * (8 if with_ids else 7)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])
            rows.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                doc_ids = part.column(0).to_pylist()
                for doc_id, ids in zip(doc_ids, encode(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(separator)).astype("<u4")
                    start = 0
                    for length in cuts(len(ids), capacity, tail):
                        own = ids[start : start + length]
                        piece = (doc_id, start, length, zlib.crc32(own.tobytes()), len(ids))
                        full = bins.add(piece + ((own.tolist(),) if with_ids else ()), length)
                        if full:
                            close(full)
                        start += length
                if len(rows) >= 10_000:
                    yield flush()
        for pieces in bins.rest():
            close(pieces)
        if rows:
            yield flush()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, schema)
