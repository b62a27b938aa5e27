"""Character n-gram models of words, stored in sorted hash arrays.

A word is a start mark, its characters and an end mark; contexts don't cross its start. The hash of an n-gram is built from
its last character leftwards, so the hash of its suffix is the step before. `SortedModel` holds, for each order, the sorted
hashes of the n-grams that were seen with their log probabilities (a column for each class), and the sorted hashes of the
contexts with their log back-off weights; a word is scored from the longest n-gram that was seen downwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Private-use characters, so that no word holds them.
START, END = "\ue000", "\ue001"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a hash and a character."""
    with np.errstate(over="ignore"):
        x = (h ^ (code + np.uint64(1)) * _A) * _B
        x ^= x >> np.uint64(29)
        x *= _A
        return x ^ (x >> np.uint64(32))


@dataclass
class Places:
    """The predicted places of some words: every character and end mark."""

    order: np.ndarray  # the longest n-gram that ends here, with the start mark
    word: np.ndarray  # the number of the word
    hashes: list[np.ndarray]  # [m - 1]: of the n-gram of m characters that ends here, where order >= m
    before: list[np.ndarray]  # [m - 1]: of its context, the m - 1 characters before; 0 for m = 1


def places(words: list[str], n: int) -> Places:
    codes = np.frombuffer("".join([START + w + END for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(len(codes)) - np.repeat(starts, lengths)
    hashes, h = [], np.zeros(len(codes), np.uint64)
    for m in range(1, n + 1):
        left = np.concatenate([np.zeros(m - 1, np.uint64), codes[: len(codes) - m + 1]]) if m > 1 else codes
        h = mix(h, left[: len(codes)])
        hashes.append(h)
    at = np.flatnonzero(inside > 0)
    before = [np.zeros(len(at), np.uint64), *(hashes[m - 2][at - 1] for m in range(2, n + 1))]
    return Places(np.minimum(inside[at] + 1, n), np.repeat(np.arange(len(words)), lengths)[at], [x[at] for x in hashes], before)


def find(sorted_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in a sorted array, and whether they do."""
    if not len(sorted_):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)
    return at, sorted_[at] == keys


@dataclass
class SortedModel:
    classes: list[str]
    base: np.ndarray  # log probability of a character that was never seen, by class
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)

    @property
    def n(self) -> int:
        return len(self.grams)

    def place_logs(self, p: Places) -> np.ndarray:
        out = np.zeros((len(p.order), len(self.classes)))
        rest = np.arange(len(p.order))
        for m in range(self.n, 0, -1):
            mine = rest[p.order[rest] >= m]
            later = rest[p.order[rest] < m]
            at, seen = find(self.grams[m - 1], p.hashes[m - 1][mine])
            out[mine[seen]] += self.logp[m - 1][at[seen]]
            left = mine[~seen]
            at, known = find(self.contexts[m - 1], p.before[m - 1][left])
            out[left[known]] += self.backoff[m - 1][at[known]]
            rest = np.concatenate([left, later])
        out[rest] += self.base
        return out

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word, by class."""
        if not words:
            return np.zeros((0, len(self.classes)))
        p = places(words, self.n)
        logs = self.place_logs(p)
        first = np.flatnonzero(np.diff(p.word, prepend=-1))
        return np.add.reduceat(logs, first, axis=0)


@dataclass
class _Level:
    """The n-grams of one order and class."""

    key: np.ndarray
    count: np.ndarray
    context: np.ndarray
    suffix: np.ndarray


def _grouped(keys: np.ndarray, weights: np.ndarray, context: np.ndarray, suffix: np.ndarray) -> _Level:
    key, first, group = np.unique(keys, return_index=True, return_inverse=True)
    return _Level(key, np.bincount(group, weights, len(key)), context[first], suffix[first])


def levels(words: list[str], counts: np.ndarray, n: int) -> list[_Level]:
    """Kneser-Ney counts by order: as seen for the longest n-grams and those from a word's start, else distinct left extensions."""
    p = places(words, n)
    weight = counts[p.word].astype(float)
    out: list[_Level] = []
    for m in range(n, 0, -1):
        own = p.order == m
        suffix = p.hashes[m - 2] if m > 1 else np.zeros(len(p.order), np.uint64)
        seen = _grouped(p.hashes[m - 1][own], weight[own], p.before[m - 1][own], suffix[own])
        if out:
            longer = out[-1]
            # contexts and suffixes of the shorter n-grams, from any place where they stand
            any_ = p.order > m
            where, first = np.unique(p.hashes[m - 1][any_], return_index=True)
            at, _ = find(where, longer.suffix)
            idx = np.flatnonzero(any_)[first[at]]
            more = _grouped(longer.suffix, np.ones(len(longer.suffix)), p.before[m - 1][idx], suffix[idx])
            seen = _grouped(*(np.concatenate([getattr(seen, k), getattr(more, k)]) for k in ("key", "count", "context", "suffix")))
        out.append(seen)
    return out[::-1]


def kneser_ney(by_class: dict[str, tuple[list[str], np.ndarray]], n: int = 5) -> SortedModel:
    """Interpolated Kneser-Ney models of each class's words and counts, over the n-grams of all classes."""
    classes = sorted(by_class)
    each = {c: levels(*by_class[c], n) for c in classes}
    symbols = len(np.unique(np.concatenate([each[c][0].key for c in classes]))) + 1
    model = SortedModel(classes, np.full(len(classes), -np.log(symbols)))
    lower_p, lower_key = np.full((1, len(classes)), 1 / symbols), np.zeros(1, np.uint64)
    for m in range(n):
        mine = [each[c][m] for c in classes]
        key, first = np.unique(np.concatenate([x.key for x in mine]), return_index=True)
        context, suffix = (np.concatenate([getattr(x, k) for x in mine])[first] for k in ("context", "suffix"))
        contexts = np.unique(context)
        at_context = np.searchsorted(contexts, context)
        at_lower = np.searchsorted(lower_key, suffix) if m else np.zeros(len(key), np.int64)
        p, weights = np.zeros((len(key), len(classes))), np.ones((len(contexts), len(classes)))
        for k, x in enumerate(mine):
            n1, n2 = (x.count == 1).sum(), (x.count == 2).sum()
            d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.95)
            at = np.searchsorted(contexts, x.context)
            total, kinds = np.bincount(at, x.count, len(contexts)), np.bincount(at, minlength=len(contexts))
            seen = total > 0
            weights[seen, k] = d * kinds[seen] / total[seen]
            p[np.searchsorted(key, x.key), k] = np.maximum(x.count - d, 0) / total[at]
            p[:, k] += weights[at_context, k] * lower_p[at_lower, k]
        model.grams.append(key)
        model.logp.append(np.log(p).astype(np.float32))
        model.contexts.append(contexts)
        model.backoff.append(np.log(weights).astype(np.float32))
        lower_p, lower_key = p, key
    return model
