"""A linear-chain conditional random field with two labels over sparse features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """Weight of each feature for label 1 against 0, and scores of the first label and of label pairs."""

    weights: dict[str, float]
    first: np.ndarray
    pairs: np.ndarray

    def decode(self, features: list[list[str]]) -> list[int]:
        """The best labels by Viterbi; ties go to label 0."""
        if not features:
            return []
        get = self.weights.get
        scores = [sum([get(f, 0.0) for f in x]) for x in features]
        (ff, ft), (tf, tt) = self.pairs.tolist()
        a, b = float(self.first[0]), float(self.first[1]) + scores[0]
        back = []
        for score in scores[1:]:
            from_a, from_b = tf + b > ff + a, tt + b > ft + a
            back.append((from_a, from_b))
            a, b = (tf + b if from_a else ff + a), (tt + b if from_b else ft + a) + score
        label = int(b > a)
        out = [label]
        for steps in reversed(back):
            label = int(steps[label])
            out.append(label)
        return out[::-1]


def train(sequences: list[tuple[list[list[str]], list[int]]], min_count: int = 2, rounds: int = 200, penalty: float = 1e-3) -> Chain:
    """Maximum likelihood with a quadratic penalty, by Adam; features of fewer blocks than min_count are left out."""
    counts: dict[str, int] = {}
    for features, _ in sequences:
        for x in features:
            for f in x:
                counts[f] = counts.get(f, 0) + 1
    names = {f: i for i, f in enumerate(f for f, n in counts.items() if n >= min_count)}
    longest = max(len(y) for _, y in sequences)
    n = len(sequences)
    cell, feature = [], []
    truth, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (features, labels) in enumerate(sequences):
        truth[i, : len(labels)], real[i, : len(labels)] = labels, True
        for t, x in enumerate(features):
            for f in x:
                if f in names:
                    cell.append(i * longest + t)
                    feature.append(names[f])
    cell, feature = np.array(cell), np.array(feature)
    size = len(names)
    theta, mean, square = np.zeros(size + 6), np.zeros(size + 6), np.zeros(size + 6)
    blocks = real.sum()

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for step in range(1, rounds + 1):
        first, pairs = theta[size : size + 2], theta[size + 2 :].reshape(2, 2)
        scores = np.zeros((n, longest, 2))
        scores[:, :, 1] = np.bincount(cell, theta[feature], n * longest).reshape(n, longest)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = first + scores[:, 0]
        for t in range(1, longest):
            new = log_sum(forward[:, t - 1, :, None] + pairs, 1) + scores[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        total = log_sum(forward[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            new = log_sum(pairs + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], new, 0)
        chance = np.exp(forward + backward - total[:, None, None])[:, :, 1] * real
        slope = np.zeros_like(theta)
        slope[:size] = np.bincount(feature, (chance - truth * real).ravel()[cell], size)
        slope[size] = (1 - chance[:, 0] - (1 - truth[:, 0])).sum()
        slope[size + 1] = (chance[:, 0] - truth[:, 0]).sum()
        both = forward[:, :-1, :, None] + pairs + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        linked = real[:, 1:, None, None]
        expected = (np.exp(np.minimum(both, 0)) * linked).sum(axis=(0, 1))
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[:, :-1][real[:, 1:]], truth[:, 1:][real[:, 1:]]), 1)
        slope[size + 2 :] = (expected - seen).ravel()
        slope = slope / blocks + penalty * theta / 10
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta = theta - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return Chain({f: float(theta[i]) for f, i in names.items()}, theta[size : size + 2].copy(), theta[size + 2 :].reshape(2, 2).copy())
