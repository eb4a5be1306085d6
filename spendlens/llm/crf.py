"""A linear-chain conditional random field over binary features, for two or more labels.

Trained by Adam on the exact log-likelihood gradient (forward-backward over all sequences of a
padded batch at once) and decoded by Viterbi.
"""

from __future__ import annotations

import numpy as np


class Crf:
    def __init__(self, features: list[str], labels: int, state: np.ndarray, change: np.ndarray):
        self.labels, self.change = labels, change  # change[i, j]: score of label j after label i
        self.weights = dict(zip(features, state.tolist(), strict=True))

    def viterbi(self, sequence: list[set[str]]) -> list[int]:
        """The best labels; features not seen in training count nothing. Plain numbers: with few
        labels these are quicker than arrays of their size."""
        if not sequence:
            return []
        labels, weights, change = range(self.labels), self.weights, self.change.T.tolist()
        best, back = None, []
        for found in sequence:
            rows = [w for f in found if (w := weights.get(f))]
            score = [sum(column) for column in zip(*rows, strict=True)] or [0.0] * self.labels
            if best is None:
                best = score
                continue
            ways = [[b + c for b, c in zip(best, change[j], strict=True)] for j in labels]
            tops = [max(w) for w in ways]
            back.append([w.index(t) for w, t in zip(ways, tops, strict=True)])
            best = [t + s for t, s in zip(tops, score, strict=True)]
        path = [best.index(max(best))]
        for b in reversed(back):
            path.append(b[path[-1]])
        return path[::-1]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(
    pages: list[tuple[list[set[str]], list[int]]], labels: int = 2, steps: int = 80, rate: float = 0.15, l2: float = 2.0
) -> Crf:
    """Fit to (feature sets, labels) per sequence; features seen fewer than three times are left out."""
    counts: dict[str, int] = {}
    for sequence, _ in pages:
        for found in sequence:
            for f in found:
                counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, n in counts.items() if n >= 3)
    index = {f: i for i, f in enumerate(names)}
    longest = max(len(s) for s, _ in pages)
    n = len(pages)
    x = np.zeros((n, longest, len(names)), dtype=np.float32)
    y = np.zeros((n, longest), dtype=np.int64)
    mask = np.zeros((n, longest), dtype=bool)
    for p, (sequence, tags) in enumerate(pages):
        mask[p, : len(sequence)] = True
        y[p, : len(tags)] = tags
        for t, found in enumerate(sequence):
            x[p, t, [index[f] for f in found if f in index]] = 1
    flat = x.reshape(-1, len(names))
    gold = np.eye(labels)[y] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_change = np.einsum("pti,ptj->ij", gold[:, :-1] * both[..., None], gold[:, 1:])
    gold_state = flat.T @ gold.reshape(-1, labels)
    size = len(names) * labels
    theta = np.zeros(size + labels * labels)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    last = mask.sum(axis=1) - 1
    for step in range(1, steps + 1):
        state, change = theta[:size].reshape(-1, labels), theta[size:].reshape(labels, labels)
        score = (flat @ state).reshape(n, longest, labels)
        forward = np.zeros_like(score)
        backward = np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = _logsumexp(forward[:, t - 1, :, None] + change, 1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _logsumexp(change + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], new, 0)
        total = _logsumexp(forward[np.arange(n), last], 1)
        node = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        edge = np.exp(
            forward[:, :-1, :, None]
            + change
            + (score[:, 1:] + backward[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        )
        edge = (edge * both[..., None, None]).sum(axis=(0, 1))
        gradient = np.concatenate(
            [(gold_state - flat.T @ node.reshape(-1, labels)).ravel(), (gold_change - edge).ravel()]
        )
        gradient = gradient / n - l2 * theta / n
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(names, labels, theta[:size].reshape(-1, labels), theta[size:].reshape(labels, labels))
