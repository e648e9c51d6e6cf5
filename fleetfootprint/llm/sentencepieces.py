"""Encoding and decoding with a sentencepiece BPE model, exactly, by backtracking.

A sequence of pieces is the model's encoding of its text if every two neighbours are the encoding of what they spell
together: merges never cross the end of a piece that stays, so what lies on both sides is merged as if it stood alone. The encoder
therefore looks for the sequence itself. An Aho-Corasick automaton over the pieces gives the longest piece at every
place; a piece is taken if it is compatible with the piece before it, else a shorter one is tried; if none fits, the
place is marked as failed in a bitfield and the piece before it gives way. Two pieces are compatible if merging the
characters of both again, by score and from the left, ends in just these two. Characters without a piece of their own
are spelled in bytes and are compatible with everything.

If no piece of the model goes on over a space, the encoding of a text falls apart at its spaces. The texts of a slice of
about ``IN_BYTES`` are cut into words at once, every different word is encoded once, and ``SIDE_BY_SIDE`` words of up to
``LONG_WORD`` characters are searched together in arrays: a step takes or refuses one piece of each. Longer words are searched one
by one, and so is the whole text under other models. Pairs found compatible or not are remembered per worker; the memory
is emptied when full. Memory besides: 20 to 50 bytes a byte of a slice and 100 bytes a character of the longest word.

Defined cases: a null text counts as empty, its ids are begin and end only; special strings in a text are ordinary text;
a character that stands for the space in pieces is decoded as a space, as the library does; rows that repeat
stay rows of their own; an id outside the model or an invalid byte is decoded as the library does (an error, or U+FFFD per byte); an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
WORDS_KEPT = 500_000
PAIRS_KEPT = 1_000_000
LONG_WORD = 64
SIDE_BY_SIDE = 50_000
IN_BYTES = 8_000_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
UNKNOWN_SURFACE = " ⁇ "


class Model:
    """Pieces of a sentencepiece BPE model with byte fallback and without text normalisation."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        rules, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        if trainer.model_type != 2 or not trainer.byte_fallback or not plain or trainer.treat_whitespace_as_suffix or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} is not a BPE model with byte fallback and identity normalisation")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.begin, self.end = trainer.bos_id, trainer.eos_id
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        # pieces that merging can reach; only these can stand in an encoding
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL and self.merged(p.piece) == [p.piece]}
        self.splits = not any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        # the pieces by number; the last number is that of any character without a piece, and of what stands before a word
        self.names = [*self.ids, ""]
        self.other = len(self.ids)
        # a single character is always the shortest piece of its place
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(self.ids):
            if len(piece) > 1:
                self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        self.shorter: dict[str, str | None] = {}
        for piece in self.ids:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), None)
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.packed = {piece: i.to_bytes(4, "little") for piece, i in self.ids.items()}
        self.texts = [self._spelled(i) for i in range(len(self.pieces))]
        self.is_byte = np.array([kind == BYTE for kind in self.kinds])
        self.is_control = np.array([kind == CONTROL for kind in self.kinds])
        self._number()

    def _number(self) -> None:
        """The tables by number of a piece, for many words at once, and what each id spells, for many texts at once."""
        numbers = {piece: number for number, piece in enumerate(self.ids)} | {None: -1}
        self.single = np.full(sys.maxunicode + 1, self.other, np.int32)
        for piece in self.ids:
            if len(piece) == 1:
                self.single[ord(piece)] = numbers[piece]
        self.sizes = np.array([*map(len, self.ids), 1], np.int32)
        self.next_shorter = np.array([*(numbers[self.shorter[piece]] for piece in self.ids), -1], np.int32)
        self.number_ids = np.array([*self.ids.values(), 0], np.uint32)
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.uint32)
        self.pairs, self.pair_fits = pd.Index([], np.int64), np.zeros(1, bool)
        self.new_pairs: dict[int, bool] = {}
        # an id's text, and after all of them the same without its first character
        self.spelled = pa.array([*self.texts, *(text[1:] for text in self.texts)], pa.binary())
        self.is_high = np.array([kind == BYTE and text[0] > 127 for kind, text in zip(self.kinds, self.texts)])
        self.is_spaced = np.array([kind == NORMAL and piece.startswith(SPACE) for kind, piece in zip(self.kinds, self.pieces)])

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best score first, from the left among equals."""
        parts, scores = list(text), self.scores
        while True:
            best = max(((scores[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in scores), default=None)
            if best is None:
                return parts
            at = -best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two pieces stand side by side in the encoding of what they spell; everything follows the start."""
        if len(self.fits) >= PAIRS_KEPT:
            self.fits.clear()
        whole = left not in self.ids or right not in self.ids
        found = self.fits[left, right] = whole or self.merged(left + right) == [left, right]
        return found

    def split(self, word: str) -> list[str]:
        """The pieces of a word; characters without a piece stand for themselves."""
        longest, names = list(word), self.names
        for end, number in self.automaton.iter(word):
            piece = names[number]
            longest[end + 1 - len(piece)] = piece  # matches come by their ends, so the longest of a place comes last
        known, shorter, size = self.fits.get, self.shorter.get, len(word)
        failed, any_failed = bytearray(size // 8 + 1), False
        out: list[str] = []
        at, last, piece = 0, "", longest[0]
        while True:
            fits = known((last, piece))
            if fits is None:
                fits = self.compatible(last, piece)
            end = at + len(piece)
            if fits and not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                out.append(piece)
                if end == size:
                    return out
                at, last, piece = end, piece, longest[end]
                continue
            piece = shorter(piece)
            while piece is None:
                # no piece fits here: the one before gives way to a shorter one
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
                piece = shorter(piece)

    def _packed(self, word: str) -> bytes:
        own = self.packed
        found = [own.get(piece) or self._in_bytes(piece) for piece in self.split(word)]
        out = b"".join(found)
        if len(word) <= LONG_WORD:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[word] = out
        return out

    def _in_bytes(self, character: str) -> bytes:
        return b"".join(self.bytes[b].to_bytes(4, "little") for b in character.encode())

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        spaced = self.prefix + text.replace(" ", SPACE) if text else ""
        known, packed = self.words.get, self._packed
        words = WORD.findall(spaced) if self.splits else [spaced] * bool(spaced)
        # the memory may be emptied on the way, so each word is looked up and kept at once
        parts = [known(word) or packed(word) for word in words]
        if begin:
            parts.insert(0, self.begin.to_bytes(4, "little"))
        if end:
            parts.append(self.end.to_bytes(4, "little"))
        return b"".join(parts)

    def _all_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` for pairs of numbers."""
        keys = left.astype(np.int64) * len(self.names) + right
        at = self.pairs.get_indexer(keys)
        fits, unknown = self.pair_fits[at], np.flatnonzero(at < 0)
        if len(unknown):
            fresh, back = np.unique(keys[unknown], return_inverse=True)
            known, names = self.new_pairs, self.names
            for key in fresh.tolist():
                if key not in known:
                    first, second = names[key // len(names)], names[key % len(names)]
                    known[key] = not first or not second or self.merged(first + second) == [first, second]
            fits[unknown] = np.array([known[key] for key in fresh.tolist()])[back]
        return fits

    def _keep_pairs(self) -> None:
        """New pairs go to the index once there are enough of them."""
        if len(self.pairs) + len(self.new_pairs) > PAIRS_KEPT:
            self.pairs, self.pair_fits = pd.Index([], np.int64), np.zeros(1, bool)
            self.new_pairs.clear()
        if len(self.new_pairs) > len(self.pairs) // 16:
            # the last entry is no pair's
            self.pair_fits = np.concatenate([self.pair_fits[:-1], [*self.new_pairs.values(), False]])
            self.pairs = pd.Index(np.concatenate([self.pairs.to_numpy(), [*self.new_pairs]]).astype(np.int64))
            self.new_pairs.clear()

    def _search(self, longest: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``split`` for words side by side: the number of the piece that starts at each place, -1 where none does."""
        sizes, next_shorter, other = self.sizes, self.next_shorter, self.other
        chosen, before = np.full(len(longest), -1, np.int32), np.zeros(len(longest) + 1, np.int64)
        failed, longest = np.zeros(len(longest) + 1, bool), np.append(longest, other)
        at, last, piece = begins.copy(), np.full(len(begins), other, np.int32), longest[begins]
        while len(at):
            while len(none := np.flatnonzero(piece < 0)):
                # no piece fits here: the one before gives way to a shorter one
                failed[at[none]] = True
                at[none] = gone = before[at[none]]
                piece[none] = next_shorter[chosen[gone]]
                chosen[gone] = -1
                last[none] = np.where(gone > begins[none], chosen[before[gone]], other)
            end = at + sizes[piece]
            fits = self._all_fit(last, piece) & ~failed[end]
            chosen[at[fits]] = piece[fits]
            before[end[fits]] = at[fits]
            going = ~(fits & (end == ends))
            piece, last = np.where(fits, longest[end], next_shorter[piece])[going], np.where(fits, piece, last)[going]
            at, begins, ends = np.where(fits, end, at)[going], begins[going], ends[going]
        return chosen

    def _words_packed(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short words that end in no space, one after the other, and how many each has."""
        self._keep_pairs()
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        begins = ends - size
        joined = _content(words)[1].tobytes().decode().replace(" ", SPACE)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        longest = self.single[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
        # by their ends, so the longest of a place stays
        longest[found[:, 0] + 1 - self.sizes[found[:, 1]]] = found[:, 1]
        chosen = self._search(longest, begins, ends)
        places = np.flatnonzero(chosen >= 0)
        numbers = chosen[places]
        count = np.ones(len(places), np.int64)
        spelled = np.flatnonzero(numbers == self.other)
        if len(spelled):
            letters = np.frombuffer(joined.encode(), np.uint8)
            starts = np.append(np.flatnonzero(letters & 0xC0 != 0x80), len(letters))
            count[spelled] = np.diff(starts)[places[spelled]]
        ids, first = np.repeat(self.number_ids[numbers], count), np.cumsum(count) - count
        for k in range(4 if len(spelled) else 0):
            more = spelled[count[spelled] > k]
            ids[first[more] + k] = self.byte_ids[letters[starts[places[more]] + k]]
        return ids, np.add.reduceat(count, np.searchsorted(places, begins))

    def encode_all(self, texts: pa.StringArray, begin: bool = True, end: bool = True) -> pa.BinaryArray:
        """``encode`` of each text."""
        if not self.splits or not self.prefix:
            return pa.array([self.encode(text, begin, end) for text in texts.to_pylist()], pa.binary())
        words, per_text = _words(texts.cast(pa.string()))
        coded = words.dictionary_encode()
        apart = pc.or_(pc.greater(pc.utf8_length(coded.dictionary), LONG_WORD), pc.ends_with(coded.dictionary, " "))
        short = coded.dictionary.filter(pc.invert(apart))
        parts = [self._words_packed(short.slice(first, SIDE_BY_SIDE)) for first in range(0, len(short), SIDE_BY_SIDE)]
        known, packed = self.words.get, self._packed
        spaced = [word.replace(" ", SPACE) for word in coded.dictionary.filter(apart).to_pylist()]
        single = [np.frombuffer(known(word) or packed(word), "<u4") for word in spaced]
        # after the words of the slice: those that were encoded apart, begin, end
        ids = np.concatenate([*(ids for ids, _ in parts), *single, [self.begin, self.end]]).astype("<u4")
        count = np.concatenate([*(count for _, count in parts), [*map(len, single), 1, 1]]).astype(np.int64)
        is_apart = np.append(apart.to_numpy(zero_copy_only=False), [True, True])
        order = np.argsort(is_apart, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        starts, marks = np.cumsum(count) - count, [len(count) - 2] * begin + [len(count) - 1] * end
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        sequence = place[coded.indices.to_numpy()]
        if marks:
            around = np.stack([bounds[:-1]] * begin + [bounds[1:]] * end, axis=-1)
            sequence = np.insert(sequence, around.ravel(), np.tile(marks, len(texts)))
        sizes = count[sequence]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = ids[np.arange(ends[-1]) + np.repeat(starts[sequence] - ends[:-1], sizes)]
        offsets = 4 * ends[bounds + len(marks) * np.arange(len(bounds))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(_offsets(offsets)), pa.py_buffer(out)])

    def _spelled(self, at: int) -> bytes:
        """What an id adds to a text; bytes stand for themselves."""
        kind, piece = self.kinds[at], self.pieces[at]
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        if kind == CONTROL:
            return b""
        return (UNKNOWN_SURFACE if kind == UNKNOWN else piece.replace(SPACE, " ")).encode()

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: without control ids and without the space that encoding puts first."""
        ids = np.frombuffer(packed, "<u4")
        if len(ids) and ids.max() >= len(self.pieces):
            raise ValueError(f"id {ids.max()} is not in the model")
        texts = self.texts
        spelled = [texts[i] for i in ids.tolist()]
        first = next((i for i in ids.tolist() if self.kinds[i] != CONTROL), None)
        out = b"".join(spelled)
        strip = self.prefix and first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(SPACE)
        if strip:
            out = out[1:]
        try:
            # a control id between two bytes parts them
            if not self.is_control[ids[1:-1]].any():
                return out.decode()
        except UnicodeDecodeError:
            pass
        return _repaired(spelled, self.is_byte[ids].tolist())[1 if strip else 0 :]

    def decode_all(self, packed: pa.BinaryArray) -> pa.StringArray:
        """``decode`` of each list of ids. Only lists with bytes that are no character of their own are decoded one by one."""
        packed = packed.cast(pa.binary())
        bounds, letters = _content(packed)
        if (bounds % 4).any():
            raise ValueError("packed ids have 4 bytes each")
        ids, bounds = letters.view("<u4").astype(np.int64), bounds // 4
        if len(ids) and ids.max() >= len(self.pieces):
            raise ValueError(f"id {ids.max()} is not in the model")
        high = np.concatenate([[0], np.cumsum(self.is_high[ids])])[bounds]
        if self.prefix:
            shown = np.append(np.flatnonzero(~self.is_control[ids]), len(ids))
            first = shown[np.searchsorted(shown[:-1], bounds[:-1])]
            first = first[first < bounds[1:]]
            ids[first[self.is_spaced[ids[first]]]] += len(self.pieces)
        spelled = self.spelled.take(pa.array(ids))
        ends, letters = _content(spelled)
        texts = pa.Array.from_buffers(pa.string(), len(packed), [None, pa.py_buffer(_offsets(ends[bounds])), pa.py_buffer(letters)])
        apart = pa.array(np.diff(high) > 0)
        single = [self.decode(one) for one in packed.filter(apart).to_pylist()]
        return pc.replace_with_mask(texts, apart, pa.array(single, pa.string())) if single else texts


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a column of strings without nulls begin and end in its bytes, and these."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, letters = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if bounds[0] == bounds[-1]:
        return bounds - bounds[0], np.zeros(0, np.uint8)
    return bounds - bounds[0], np.frombuffer(letters, np.uint8)[bounds[0] : bounds[-1]]


def _offsets(places: np.ndarray) -> np.ndarray:
    """Places as offsets of an Arrow array, which has 32 bits for them."""
    if len(places) and places[-1] > np.iinfo(np.int32).max:
        raise OverflowError(f"{places[-1]} bytes are too many for a column")
    return places.astype(np.int32)


def _words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts in order, each from its first space on, the one put before a text included; how many each text has."""
    texts = pc.replace_substring(texts, SPACE, " ")
    filled = pc.greater(pc.binary_length(texts), 0)
    bounds, letters = _content(pc.binary_join_element_wise(pc.if_else(filled, " ", ""), texts, ""))
    is_first = letters == ord(" ")
    is_first[1:] &= letters[:-1] != ord(" ")
    is_first[bounds[:-1][filled.to_numpy(zero_copy_only=False)]] = True
    starts = np.flatnonzero(is_first)
    buffers = [None, pa.py_buffer(_offsets(np.append(starts, len(letters)))), pa.py_buffer(letters)]
    return pa.Array.from_buffers(pa.string(), len(starts), buffers), np.diff(np.searchsorted(starts, bounds))


def _repaired(spelled: list[bytes], is_byte: list[bool]) -> str:
    """Decode with U+FFFD for every byte that is no part of a character; a character's bytes stand in one stretch of byte ids."""
    parts: list[str] = []
    stretch = b""
    for text, single in [*zip(spelled, is_byte), (b"", False)]:
        if single:
            stretch += text
            continue
        while stretch:
            for size in range(1, 5):
                try:
                    parts.append(stretch[:size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                parts.append("�")
                size = 1
            stretch = stretch[size:]
        parts.append(text.decode())
    return "".join(parts)


_MODELS: dict[str, Model] = {}


def load(model: str = MODEL) -> Model:
    """The worker's model of a file of the public tokenizers."""
    if model not in _MODELS:
        import public_tokenizers

        _MODELS[model] = Model(public_tokenizers.path(model))
    return _MODELS[model]


def _mapped(rows: DataFrame, schema: str, work: Callable[[Model, pa.Array], list[pa.Array]], model: str) -> DataFrame:
    """``work`` on the second column of ``rows``, in slices of about ``IN_BYTES``; its columns follow doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = load(model)
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            held = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64) // IN_BYTES
            cuts = np.flatnonzero(np.diff(held)) + 1
            for first, after in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(first, after - first)
                yield pa.RecordBatch.from_arrays([part.column(0), *work(use, part.column(1))], names)

    return rows.mapInArrow(run, schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, begin: bool = True, end: bool = True, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids``, packed as little-endian unsigned 32-bit integers."""
    return _mapped(_texts(docs, id_col, text_col), "doc_id long, ids binary", lambda use, texts: [use.encode_all(texts, begin, end)], model)


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the ``text`` of packed ids; null ids count as none."""
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    return _mapped(rows, "doc_id long, text string", lambda use, ids: [use.decode_all(ids)], model)


def round_trip(docs: DataFrame, begin: bool = True, end: bool = True, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, packed ``ids`` and ``decoded``, the text those ids stand for, in one pass."""

    def both(use: Model, texts: pa.Array) -> list[pa.Array]:
        ids = use.encode_all(texts, begin, end)
        return [ids, use.decode_all(ids)]

    return _mapped(_texts(docs, id_col, text_col), "doc_id long, ids binary, decoded string", both, model)
