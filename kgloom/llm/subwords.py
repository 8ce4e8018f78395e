"""Supervised subword embeddings: hashed word, word-pair and character n-gram
vectors are averaged over a document and a linear softmax reads the average.
Both are learned by numpy stochastic gradient descent on a bounded sample; the
score's temperature is fitted on a part of the sample that is left out.

A trained model is linear in the features, so for scoring the vectors and the
softmax weights fold into one table of ``2**BITS`` rows, and whole texts of any
length are scored in cut-free runs of bytes with sums by document.

Defined results: null text is empty text; a text without features gets the
bias alone; repeated rows and ties score alike; words are runs without space;
very long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from kgloom.llm.common import LOWER, SPACE, mix, utf8_parts, word_hashes, words_of

BITS = 18
GRAMS = (3, 4)
#: Bytes of a stretch of a long row.
RUN = 1 << 19
SHIFT = np.uint64(64 - BITS)


def features(array: pa.Array, lower: bool) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of rows (first, after) with parts (features, upto): the features of row
    first+i in a part are features[upto[i]:upto[i + 1]]. A long row comes several times, with its words first and
    then its character grams by the stretch in which they start, so memory doesn't follow its length."""
    for first, after, data, offsets in utf8_parts(array):
        text = LOWER[data] if lower else data
        starts, ends, at = words_of(data, offsets)
        word = word_hashes(text, starts, ends)
        parts = [(feature(word, 1), at)]
        if len(word) > 1:
            first_word = np.zeros(len(word), dtype=bool)
            first_word[at[:-1][at[:-1] < len(word)]] = True
            later = np.flatnonzero(~first_word)
            # that a word repeats the one before says the same about a text whatever the word: one feature
            pair = np.where(word[later] == word[later - 1], np.uint64(1), mix(word[later] * np.uint64(3) + word[later - 1]))
            parts.append((feature(pair, 2), np.searchsorted(later, at)))
        if after - first > 1 or len(data) <= RUN:
            yield first, after, parts + char_grams(text, offsets, 0, len(data))
        else:
            yield first, after, parts
            for low in range(0, len(data), RUN):
                yield first, after, char_grams(text, offsets, low, min(low + RUN, len(data)))


def char_grams(text: np.ndarray, offsets: np.ndarray, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Parts with the character grams that start in text[low:high]; a stretch that isn't the whole holds one row."""
    chars = low + np.flatnonzero((text[low : high + 4 * max(GRAMS)] & 0xC0) != 0x80)
    begin = int(np.searchsorted(chars, high))
    if high + 4 * max(GRAMS) >= len(text):
        chars = np.append(chars, len(text))
    chars_at = np.minimum(np.searchsorted(chars, offsets), begin)
    blanks = np.cumsum(np.append(0, SPACE[text[chars[:-1]]]))
    parts = []
    for n in GRAMS:
        count = min(begin, len(chars) - n)
        if count <= 0:
            continue
        # spaces only at either end, so that a gram knows where a word starts or stops
        ok = blanks[n - 1 : n - 1 + count] == blanks[1 : 1 + count]
        for cut in chars_at[1:-1]:
            ok[max(0, cut - n + 1) : cut] = False
        take = np.flatnonzero(ok)
        parts.append((feature(word_hashes(text, chars[take], chars[take + n]), 2 + n), np.searchsorted(take, chars_at)))
    return parts


def feature(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind << 32)) >> SHIFT).astype(np.int32)


def bags(texts: list[str | None], lower: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, shares) of every text."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for first, after, parts in features(pa.array([t or "" for t in texts], pa.large_string()), lower):
        for i in range(after - first):
            found[first + i] += [x[u[i] : u[i + 1]] for x, u in parts]
    out = []
    for f in found:
        f, n = np.unique(np.concatenate([*f, np.zeros(0, np.int32)]), return_counts=True)
        out.append((f, (n / max(1, n.sum())).astype(np.float32)))
    return out


@dataclass
class Model:
    classes: list
    table: np.ndarray  # 2**BITS x classes
    bias: np.ndarray
    #: What the classes' shares add to the calibrated logits.
    shift: np.ndarray
    temperature: float
    reject_below: float
    lower: bool

    def probabilities(self, array: pa.Array) -> np.ndarray:
        total, count = np.zeros((len(array), len(self.classes))), np.zeros(len(array))
        for first, after, parts in features(array, self.lower):
            for f, upto in parts:
                for c in range(len(self.classes)):
                    total[first:after, c] += np.diff(np.append(0, np.cumsum(self.table[c][f], dtype=np.float64))[upto])
                count[first:after] += np.diff(upto)
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature + self.shift)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str | None], labels: list, priors: dict, lower: bool, dim: int = 16, updates: int = 24_000, rate: float = 0.6, held: int = 8, target: float = 0.99, seed: int = 7) -> Model:
    """A model of the labels; ``priors`` (shares of the classes in the population)
    correct for a sample that is even over classes; every ``held``-th text only calibrates. Classes are those
    that a text teaches; without two of them nothing is learned."""
    classes = sorted(set(labels))
    if len(classes) < 2:
        only = classes or [None]
        return Model(only, np.zeros((1, 1 << BITS), np.float32), np.zeros(1), np.zeros(1), 1.0, 0.0, lower)
    rng = np.random.default_rng(seed)
    bag = bags(texts, lower)
    y = np.array([classes.index(x) for x in labels])
    order = rng.permutation(len(y))
    calibrate = order[::held] if len(order) >= 10 * held else order[:0]
    learn = np.setdiff1d(order, calibrate)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    seen = np.zeros(1 << BITS, dtype=bool)
    out = np.zeros((len(classes), dim), dtype=np.float32)
    bias = np.zeros(len(classes), dtype=np.float32)
    epochs = int(np.clip(updates // max(1, len(learn)), 4, 60))
    steps, t = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            f, share = bag[i]
            step = rate * (1 - t / steps)
            t += 1
            if not len(f):
                continue
            seen[f] = True
            rows = vectors[f]
            hidden = share @ rows
            error = softmax(out @ hidden + bias)
            error[y[i]] -= 1
            back = error @ out
            out -= step * error[:, None] * hidden
            bias -= step * 0.1 * error
            # a share of the step for each feature, enlarged so that frequent ones move at a usable pace
            vectors[f] = rows - (step * 20 * share)[:, None] * back
    vectors[~seen] = 0
    table = np.ascontiguousarray((vectors @ out.T).T.astype(np.float32))
    sampled = np.bincount(y, minlength=len(classes)) / len(y)
    shift = np.log([max(priors[c], 1e-6) for c in classes]) - np.log(np.maximum(sampled, 1e-6))
    model = Model(classes, table, bias.astype(np.float64), shift, 1.0, 0.0, lower)
    if len(calibrate):
        truth = y[calibrate]
        logits = np.array([table[:, bag[i][0]] @ bag[i][1] + bias for i in calibrate])
        # scores are those that are given later, with the shares of the classes, and every text counts for its class's share
        weight = np.exp(shift)[truth]
        score = lambda t: softmax(logits / t + shift)
        model.temperature = min(np.geomspace(0.4, 4, 40), key=lambda t: (-np.log(np.maximum(1e-12, score(t)[np.arange(len(truth)), truth])) * weight).sum())
        p = score(model.temperature)
        right, top = p.argmax(axis=1) == truth, p.max(axis=1)
        by = np.argsort(-top, kind="stable")
        good = np.cumsum((right * weight)[by]) / np.cumsum(weight[by]) >= target
        # the lowest score down to which enough texts are right: below what was seen nothing is known
        model.reject_below = float(top[by][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model
