"""Hashed word features and small logistic models shared by the text classifiers."""

from __future__ import annotations

import numpy as np

from tracewright.llm.batches import ALNUM, Words, mix, span_hashes

BITS = 20
#: Bytes of the word beginnings that are features beside the whole words.
STEMS = (4, 5, 6)


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and of its beginnings."""
    words = Words(data, offsets, ALNUM)
    folded = ALNUM[data]
    rows, hashes = [words.row], [words.hash]
    for size in STEMS:
        long = words.end - words.start > size
        start = words.start[long]
        rows.append(words.row[long])
        hashes.append(mix(span_hashes(folded, start, start + size), size))
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def present(data: np.ndarray, offsets: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """Rows of 0 and 1 over the features; ``column`` maps buckets to features, -1 for none."""
    row, bucket = word_features(data, offsets)
    feature = column[bucket]
    x = np.zeros((len(offsets) - 1, width))
    x[row[feature >= 0], feature[feature >= 0]] = 1
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 25, count: np.ndarray | None = None) -> np.ndarray:
    """Weights of a ridge-penalised logistic model by Newton steps; the last weight is the bias, unpenalised.

    ``y`` may be soft; ``count`` says how many rows each row stands for.
    """
    x = np.column_stack([x, np.ones(len(x))])
    count = np.ones(len(x)) if count is None else count
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    mean = float(np.clip((y * count).sum() / count.sum() if len(y) else 0.5, 1e-4, 1 - 1e-4))
    w[-1] = np.log(mean / (1 - mean))

    def loss(w: np.ndarray) -> float:
        margin = x @ w
        return float((count * (np.logaddexp(0, margin) - y * margin)).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (count * (p - y)) + ridge * w
        curve = (x * (count * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        while (after := loss(w - step)) > now + 1e-9 and np.abs(step).max() > 1e-6:
            step /= 2
        if after > now + 1e-9:
            break
        w, now = w - step, after
        if np.abs(step).max() < 1e-4:
            break
    return w


def apply_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])
