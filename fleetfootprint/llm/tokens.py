"""Token counts by dynamic programming over prefixes.

A byte-pair encoding of a text ends in one token, and what stands before that token is the encoding of the shorter
prefix. So the last token of every prefix follows from those of shorter prefixes: it is the token that fits its
predecessor, i.e. the pair encodes to just these two tokens. Every prefix thus gets its exact count once, and
truncation and budget questions are answered from the stored counts without encoding again.

No piece of the vocabulary goes on over a space, so the encoding of a text falls apart at its spaces; the counts of a
word's prefixes are computed once per worker and looked up afterwards. Both memories are emptied when full, which
costs time and changes nothing.

Defined cases: a null text counts as empty and has no tokens; a text's last count is what the library gives for it;
rows that repeat are counted each by itself, so nothing depends on ties; a very
long text costs 4 bytes a character of it in one task; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
WORDS_KEPT = 1_000_000
PAIRS_KEPT = 1_000_000
HEAD = 6
HEADS_KEPT = 200_000
OUT_CHARS = 1_000_000

WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


class PrefixCounter:
    """Tokens of every prefix of a text under a sentencepiece BPE model with byte fallback and a dummy prefix."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        proto.normalizer_spec.add_dummy_prefix = False
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()).encode
        self.ids = {p.piece: [i] for i, p in enumerate(proto.pieces) if p.type == 1 and self.encode(p.piece) == [i]}
        # lengths of the tokens that end in two given characters, longest first
        tails: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                tails.setdefault(piece[-2:], set()).add(len(piece))
        self.tails = {tail: sorted(lengths, reverse=True) for tail, lengths in tails.items()}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("pieces of this model go on over spaces")
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.heads: dict[str, tuple[list[str], list[int]]] = {}

    def own(self, token: str) -> list[int]:
        """Ids of a token; a character without a piece of its own is spelled in bytes."""
        found = self.ids.get(token)
        if found is None:
            found = self.ids[token] = self.encode(token)
        return found

    def fit(self, left: str, right: str) -> bool:
        """Whether the two tokens stand side by side in the encoding of their text."""
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= PAIRS_KEPT:
                self.fits.clear()
            found = self.fits[left, right] = self.encode(left + right) == self.own(left) + self.own(right)
        return found

    def word(self, word: str) -> list[int]:
        """Tokens of each prefix of ``word``, whose spaces are written as pieces write them."""
        ids, fits, tails = self.ids, self.fits, self.tails
        head = word[:HEAD]
        known = self.heads.get(head)
        last, counts = (known[0].copy(), known[1].copy()) if known else ([""], [0])
        for end in range(len(last), len(word) + 1):
            for length in tails.get(word[end - 2 : end], ()) if end > 1 else ():
                start = end - length
                if start < 0:
                    continue
                token = word[start:end]
                if token in ids:
                    if not start:
                        break
                    pair = last[start], token
                    if fits[pair] if pair in fits else self.fit(*pair):
                        break
            else:  # no longer token fits, so the character stands alone
                start, token = end - 1, word[end - 1]
            last.append(token)
            counts.append(counts[start] + len(ids[token] if token in ids else self.own(token)))
            if end == HEAD and not known:
                if len(self.heads) >= HEADS_KEPT:
                    self.heads.clear()
                self.heads[head] = last.copy(), counts.copy()
        return counts[1:]

    def _small(self, part: str) -> bytes | None:
        """Counts of a space and ``part`` as bytes, remembered; None where they don't fit a byte."""
        counts = self.word(SPACE + part)
        if max(counts) > 255:
            return None
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        out = bytes(counts)
        if len(part) <= 64:
            self.words[part] = out
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of the prefixes of 0, 1, ... len(text) characters."""
        if not text:
            return np.zeros(1, np.int32)
        parts = None
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            parts, known = [], self.words.get
            for part in text.split(" "):
                found = known(part) or self._small(part)
                if found is None:
                    parts = None
                    break
                parts.append(found)
        if parts is not None:
            inside = np.frombuffer(b"".join(parts), np.uint8).astype(np.int32)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        else:
            words = [np.array(self.word(w), np.int32) for w in WORD.findall(SPACE + text.replace(" ", SPACE))]
            inside, sizes = np.concatenate(words), np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        totals = inside[ends - 1]
        out = inside + np.repeat(np.cumsum(totals) - totals, sizes).astype(np.int32)
        out[0] = 0
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str = MODEL) -> PrefixCounter:
    """The worker's counter of a model file of the public tokenizers."""
    if model not in _COUNTERS:
        import public_tokenizers

        _COUNTERS[model] = PrefixCounter(public_tokenizers.path(model))
    return _COUNTERS[model]


def prefix_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and ``counts``: the tokens of the text's first 0, 1, 2 ... characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).prefixes
        for batch in batches:
            ids, sizes, texts = batch.columns
            tables, first, held = [], 0, 0
            for row, text in enumerate(texts):
                tables.append(count(text.as_py()))
                held += len(tables[-1])
                if held >= OUT_CHARS or row + 1 == len(texts):
                    offsets = np.cumsum([0, *map(len, tables)])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tables), pa.int32()))
                    part = slice(first, row + 1)
                    yield pa.RecordBatch.from_arrays([ids[part], sizes[part], lists], ["doc_id", "n_bytes", "counts"])
                    tables, first, held = [], row + 1, 0

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, counts array<int>")


def n_tokens(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(counts, -1).cast("long")


def within(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens; counts may fall where a character completes a piece."""
    return F.array_max(F.transform(counts, lambda n, at: F.when(n <= budget, at)))
