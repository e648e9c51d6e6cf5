"""Token-ratio similarity of pairs of names, vectorised with numpy for use inside Spark tasks.

The score (0-100) of a pair is the larger of
* token sort: Indel ratio of the texts with their tokens sorted, and
* token set: 100 when one token set holds the other, else the best Indel ratio among
  common / common+left / common+right tokens,
with the Indel ratio of texts a, b being 100 - 100 * (|a| + |b| - 2 * LCS(a, b)) / (|a| + |b|).

Subsequences are found with one bit per character of the right text: a step takes the next character of the left text
for all pairs of a batch. Texts are arrays of integers; tokens that a pair shares are left out by masks of positions, so
no text is built for a pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

PAIRS_AT_ONCE = 20_000
CELLS = 8_000_000
FULL = np.uint64(2**64 - 1)


class Texts:
    """Words of one side of a batch: letters by number, and per token its letters and the space in front of it."""

    def __init__(self, tokens: list[list[str]], letters: dict[str, int], vocabulary: dict[str, int]) -> None:
        texts = [" ".join(t) for t in tokens]
        rows = len(texts)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.width = max(1, int(self.length.max(initial=0)))
        self.count = np.array([len(t) for t in tokens], np.int64)
        self.characters = np.array([sum(map(len, t)) for t in tokens], np.int64)
        most = max(1, int(self.count.max(initial=0)))
        none = len(letters)
        self.codes = np.full((rows, self.width), none, np.int32)
        self.tokens = np.full((rows, most), -1, np.int64)
        self.sizes = np.zeros((rows, most), np.int64)
        # what a position belongs to: token t, the space before token t, or nothing
        self.owner = np.full((rows, self.width), 2 * most, np.int32)
        for row, (text, parts) in enumerate(zip(texts, tokens)):
            self.codes[row, : len(text)] = [letters[c] for c in text]
            at = 0
            for t, part in enumerate(parts):
                self.tokens[row, t] = vocabulary[part]
                self.sizes[row, t] = len(part)
                if t:
                    self.owner[row, at - 1] = most + t
                self.owner[row, at : at + len(part)] = t
                at += len(part) + 1

    def masks(self, letters: int) -> np.ndarray:
        """For each text and letter the positions of the letter, as bits of 64-bit words."""
        words = (self.width + 63) // 64
        out = np.zeros((len(self.codes), letters + 1, words), np.uint64)
        row, at = np.nonzero(self.codes < letters)
        np.bitwise_or.at(out, (row, self.codes[row, at], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        return out

    def owned(self) -> np.ndarray:
        """For each text and owner the positions that belong to it, as bits."""
        words = (self.width + 63) // 64
        out = np.zeros((len(self.codes), 2 * self.tokens.shape[1] + 1, words), np.uint64)
        row, at = np.nonzero(self.owner < 2 * self.tokens.shape[1])
        np.bitwise_or.at(out, (row, self.owner[row, at], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        return out


def _lcs(left: Texts, masks: np.ndarray, i: np.ndarray, j: np.ndarray, keep_left: np.ndarray | None = None, keep_right: np.ndarray | None = None) -> np.ndarray:
    """Longest common subsequences of the pairs of rows (i, j).

    ``keep_left`` tells per pair and owner which positions of the left text count, ``keep_right`` has the bits of the right text that do.
    """
    words = masks.shape[2]
    open_bits = np.full((len(i), words), FULL)
    pairs = np.arange(len(i))
    for step in range(int(left.length[i].max(initial=0))):
        match = masks[j, left.codes[i, step]]
        if keep_left is not None:
            match = np.where(keep_left[pairs, left.owner[i, step]][:, None], match & keep_right, np.uint64(0))
        used, kept = open_bits & match, open_bits & ~match
        carry = np.zeros(len(i), np.uint64)
        for word in range(words):
            now = open_bits[:, word]
            total = now + used[:, word]
            over = total < now
            total = total + carry
            if words > 1:
                carry = (over | (total < carry)).astype(np.uint64)
            open_bits[:, word] = total | kept[:, word]
    # bits behind the text never match, so they stay open
    return np.bitwise_count(~open_bits).sum(axis=1).astype(np.int64)


def indel_ratio(distance: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 100.0 - 100.0 * distance / np.maximum(total, 1), 100.0)


def _joined_length(characters: np.ndarray, count: np.ndarray) -> np.ndarray:
    return characters + np.maximum(count - 1, 0)


class Scorer:
    """Scores of pairs out of two lists of names."""

    def __init__(self, names: list[str], specs: list[str]) -> None:
        split = [sorted(n.split()) for n in names], [sorted(n.split()) for n in specs]
        distinct = [[sorted(set(t)) for t in side] for side in split]
        letters = {c: n for n, c in enumerate(sorted({c for side in split for t in side for part in t for c in part} | {" "}))}
        vocabulary = {t: n for n, t in enumerate(sorted({t for side in split for parts in side for t in parts}))}
        self.sorted_left, self.sorted_right = (Texts(side, letters, vocabulary) for side in split)
        self.left, self.right = (Texts(side, letters, vocabulary) for side in distinct)
        self.sorted_masks, self.masks = self.sorted_right.masks(len(letters)), self.right.masks(len(letters))
        self.owned = self.right.owned()

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Scores of names ``i`` with specs ``j``."""
        size = max(1, min(PAIRS_AT_ONCE, CELLS // (self.left.tokens.shape[1] * self.right.tokens.shape[1] + self.masks.shape[2])))
        parts = [self._scores(i[at : at + size], j[at : at + size]) for at in range(0, len(i), size)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        left, right = self.left, self.right
        total = self.sorted_left.length[i] + self.sorted_right.length[j]
        score = indel_ratio(total - 2 * _lcs(self.sorted_left, self.sorted_masks, i, j), total)
        same = (left.tokens[i][:, :, None] == right.tokens[j][:, None, :]) & (left.tokens[i] >= 0)[:, :, None]
        in_left, in_right = same.any(axis=2), same.any(axis=1)
        common, common_chars = in_left.sum(axis=1), (in_left * left.sizes[i]).sum(axis=1)
        left_only, right_only = left.count[i] - common, right.count[j] - common
        left_rest = _joined_length(left.characters[i] - common_chars, left_only)
        right_rest = _joined_length(right.characters[j] - common_chars, right_only)
        shared, gap = _joined_length(common_chars, common), (common > 0).astype(int)
        left_full, right_full = shared + gap + left_rest, shared + gap + right_rest
        for rest, full in ((left_rest, left_full), (right_rest, right_full)):
            score = np.maximum(score, np.where(common > 0, indel_ratio(gap + rest, shared + full), 0.0))
        score[(common > 0) & ((left_only == 0) | (right_only == 0))] = 100.0
        rest = np.flatnonzero(score < 100)
        if len(rest):
            a, b = i[rest], j[rest]
            keep_left = self._kept(~in_left[rest] & (left.tokens[a] >= 0))
            keep_right = self._kept(~in_right[rest] & (right.tokens[b] >= 0))
            bits = np.zeros((len(rest), self.owned.shape[2]), np.uint64)
            for owner in range(keep_right.shape[1] - 1):
                bits |= np.where(keep_right[:, owner][:, None], self.owned[b, owner], np.uint64(0))
            distance = left_rest[rest] + right_rest[rest] - 2 * _lcs(left, self.masks, a, b, keep_left, bits)
            score[rest] = np.maximum(score[rest], indel_ratio(distance, left_full[rest] + right_full[rest]))
        return score

    @staticmethod
    def _kept(tokens: np.ndarray) -> np.ndarray:
        """Owners that stay: the tokens, the spaces in front of all of them but the first, and not the rest of the row."""
        later = (np.cumsum(tokens, axis=1) > 1) & tokens
        return np.hstack([tokens, later, np.zeros((len(tokens), 1), bool)])


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Longest common subsequence of each aligned pair of texts."""
    letters = {c: n for n, c in enumerate(sorted({c for t in (*left, *right) for c in t}))}
    # one token each, so the texts are taken as they are
    vocabulary = {t: n for n, t in enumerate({*left, *right})}
    a, b = (Texts([[t] for t in side], letters, vocabulary) for side in (left, right))
    rows = np.arange(len(left))
    return _lcs(a, b.masks(len(letters)), rows, rows)


def pair_scores(names: pd.Series, specs: pd.Series) -> np.ndarray:
    """Score of each aligned pair."""
    i, unique_names = pd.factorize(names)
    j, unique_specs = pd.factorize(specs)
    return Scorer(list(unique_names), list(unique_specs)).scores(i, j)


def block_candidates(names: pd.Series, specs: pd.Series, hit: float, relative: float) -> pd.DataFrame:
    """Pairs whose score reaches ``hit``, or for names without one, ``relative`` x their best: every name with every spec."""
    i, j = (grid.ravel() for grid in np.indices((len(names), len(specs))))
    score = Scorer(list(names), list(specs)).scores(i, j)
    best = np.zeros(len(names))
    np.maximum.at(best, i, score)
    keep = score >= np.where(best >= hit, hit, relative * best)[i]
    return pd.DataFrame({"name": names.to_numpy()[i[keep]], "spec_name": specs.to_numpy()[j[keep]], "score": score[keep]})


def token_ratio(a: str, b: str) -> float:
    """Score of a single pair, for checks by hand."""
    return float(pair_scores(pd.Series([a]), pd.Series([b]))[0])
