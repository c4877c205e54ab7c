"""Character n-gram models in sorted hash arrays.

A model keeps, for every order k, the hashes of the k-grams seen (sorted) beside their interpolated
log-probabilities, and the hashes of the contexts seen beside the log of their back-off weight. A lookup is one
binary search; only the distinct n-grams of a batch are looked up.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np

from folium.llm.common import code_points

_BASE = 0x9E3779B97F4A7C15
POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(16)], dtype=np.uint64)
#: Characters that a model holds possible: the mass of what it never saw is spread over so many.
ALPHABET = 4096


def rolling(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the k-gram that ends at each position, for k = 1..order; positions before the start count as 0."""
    codes = codes.astype(np.uint64)
    out, total = [], np.zeros(len(codes), dtype=np.uint64)
    for k in range(order):
        term = np.zeros(len(codes), dtype=np.uint64)
        term[k:] = codes[: len(codes) - k] * POWERS[k] if k else codes
        total = total + term
        out.append(total)
    return out


def gram_hash(gram: str) -> int:
    return sum(ord(c) * pow(_BASE, j, 1 << 64) for j, c in enumerate(reversed(gram))) % (1 << 64)


def _arrays(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.array([gram_hash(g) for g in values], dtype=np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.array(list(values.values()), dtype=np.float64)[order]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class CharModel:
    """One interpolated model. grams[k], contexts[k]: (sorted hashes, log values) for order k + 1."""

    def __init__(self, order: int, grams: list, contexts: list, floor: float):
        self.order, self.grams, self.contexts, self.floor = order, grams, contexts, floor

    def log_prob(self, hashes: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """hashes[k]: of the (k + 1)-grams; before[k]: of the k characters before the last one."""
        at, hit = _find(self.grams[0][0], hashes[0])
        value = np.where(hit, self.grams[0][1][at] if len(self.grams[0][1]) else 0.0, self.floor)
        for k in range(1, self.order):
            at, seen = _find(self.contexts[k][0], before[k])
            if len(self.contexts[k][0]):
                value = value + np.where(seen, self.contexts[k][1][at], 0.0)
            at, hit = _find(self.grams[k][0], hashes[k])
            if len(self.grams[k][0]):
                value = np.where(hit, self.grams[k][1][at], value)
        return value


def kneser_ney(counts: dict[str, int], order: int) -> CharModel:
    """Interpolated Kneser-Ney from the counts of full-order n-grams; lower orders count distinct left extensions."""
    levels: list[dict[str, int]] = [dict() for _ in range(order)]
    levels[order - 1] = counts
    for k in range(order - 2, -1, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    probs: dict[str, float] = {}
    grams, contexts, floor = [], [], -math.log(ALPHABET)
    for k, level in enumerate(levels):
        once, twice = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        totals, types = defaultdict(int), defaultdict(int)
        for g, c in level.items():
            totals[g[:-1]] += c
            types[g[:-1]] += 1
        weight = {h: discount * types[h] / totals[h] for h in totals}
        lower = probs
        if k == 0:
            share = weight.get("", 1.0) / ALPHABET
            floor = math.log(share)
            probs = {g: (c - discount) / totals[""] + share for g, c in level.items()}
            contexts.append((np.zeros(0, np.uint64), np.zeros(0)))
        else:
            probs = {g: (c - discount) / totals[g[:-1]] + weight[g[:-1]] * lower[g[1:]] for g, c in level.items()}
            contexts.append(_arrays({h: math.log(w) for h, w in weight.items()}))
        grams.append(_arrays({g: math.log(p) for g, p in probs.items()}))
    return CharModel(order, grams, contexts, floor)


def witten_bell(counts: dict[str, int], order: int, least: int = 2) -> CharModel:
    """Variable-order Markov model: raw counts at every order, Witten-Bell weights, and no context seen under `least` times,
    so that the order used at a position is that of the longest context known well enough."""
    return witten_bell_of(code_points("".join(counts)).reshape(-1, order), np.fromiter(counts.values(), np.int64, len(counts)), least)


def witten_bell_of(codes: np.ndarray, counts: np.ndarray, least: int = 2) -> CharModel:
    """witten_bell of full-order n-grams as rows of code points, and their counts."""
    order = codes.shape[1]
    # hashes of each row's last k + 1 characters, and of the k before the last one
    gram, before = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64)
    lower = np.full(len(codes), 1 / ALPHABET)
    grams, contexts, floor = [], [], -math.log(ALPHABET)
    for k in range(order):
        code = codes[:, order - 1 - k].astype(np.uint64)
        gram = gram + code * POWERS[k]
        before = before + code * POWERS[k - 1] if k else before
        keys, first, of = np.unique(gram, return_index=True, return_inverse=True)
        n = np.bincount(of, weights=counts, minlength=len(keys))
        histories, history = np.unique(before[first], return_inverse=True)
        types = np.bincount(history, minlength=len(histories))
        total = np.bincount(history, weights=n, minlength=len(histories)) + types
        known = total - types >= (least if k else 0)
        weight = np.where(known, types / total, 1.0)
        probs = np.where(known[history], n / total[history], 0.0) + weight[history] * lower[first]
        if k:
            contexts.append((histories[known], np.log(weight[known])))
        else:
            floor = math.log((weight[0] if len(weight) else 1.0) / ALPHABET)
            contexts.append((np.zeros(0, np.uint64), np.zeros(0)))
        grams.append((keys, np.log(probs)))
        lower = probs[of]
    return CharModel(order, grams, contexts, floor)


def padded(words: list[str], order: int) -> tuple[str, np.ndarray]:
    """The words, each after order - 1 blanks and before one, and the length of each with its closing blank."""
    pad = " " * (order - 1)
    return "".join([f"{pad}{w} " for w in words]), np.array([len(w) + 1 for w in words], dtype=np.int64)


def word_scores(models: list[CharModel], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each word under each model (words x models), and the characters scored."""
    order = models[0].order
    text, lengths = padded(words, order)
    if not words:
        return np.zeros((0, len(models))), lengths
    hashes = rolling(code_points(text), order)
    starts = np.concatenate(([0], np.cumsum(lengths + order - 1)[:-1])) + order - 1
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    places = np.arange(int(lengths.sum())) + np.repeat(starts - offsets, lengths)
    _, first, inverse = np.unique(hashes[-1][places], return_index=True, return_inverse=True)
    at = places[first]
    grams = [h[at] for h in hashes]
    before = [np.zeros(len(at), np.uint64)] + [h[at - 1] for h in hashes[:-1]]
    known = np.stack([m.log_prob(grams, before) for m in models], axis=1)
    return np.add.reduceat(known[inverse], offsets, axis=0), lengths


def count_grams(words: dict[str, int], order: int, out: Counter | None = None) -> Counter:
    """Counts of full-order n-grams over padded words with their numbers, added to out."""
    pad, out = " " * (order - 1), Counter() if out is None else out
    for w, n in words.items():
        s = f"{pad}{w} "
        for i in range(len(w) + 1):
            out[s[i : i + order]] += n
    return out
