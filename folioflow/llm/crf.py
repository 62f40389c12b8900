"""A linear-chain conditional random field in numpy: trained by full-batch Adam, decoded by Viterbi for many sequences at once."""

from __future__ import annotations

import numpy as np

_NO = -1e9


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Crf:
    """labels[0] is outside; allowed[i, j]: whether label j may follow label i (what stands before counts as outside)."""

    def __init__(self, labels: list[str], allowed: np.ndarray):
        self.labels, self.allowed = labels, allowed
        self.features: dict[str, int] = {}
        self.emit = np.zeros((1, len(labels)))
        self.move = np.zeros((len(labels), len(labels)))

    def _scores(self, tokens: list[list[str]]) -> np.ndarray:
        known = self.features
        rows = [[known[f] for f in t if f in known] for t in tokens]
        size = np.asarray([len(r) for r in rows], np.int64)
        out = np.zeros((len(rows), len(self.labels)))
        if size.sum():
            flat = np.fromiter((i for r in rows for i in r), np.int64, int(size.sum()))
            full = np.flatnonzero(size)
            out[full] = np.add.reduceat(self.emit[flat], (np.cumsum(size) - size)[full])
        return out

    def fit(self, sequences: list[list[list[str]]], truth: list[list[int]], rounds: int = 80, rate: float = 0.15, decay: float = 2e-3) -> Crf:
        """sequences: the features of each token of each sequence; truth: the label numbers."""
        for s in sequences:
            for t in s:
                for f in t:
                    self.features.setdefault(f, len(self.features))
        n, length, labels = len(sequences), max(map(len, sequences)), len(self.labels)
        x = np.zeros((sum(map(len, sequences)), len(self.features)), np.float32)
        gold = np.zeros((n, length, labels), np.float32)
        real = np.zeros((n, length), bool)
        moves = np.zeros((labels, labels))
        row = 0
        for i, (s, y) in enumerate(zip(sequences, truth, strict=True)):
            before = 0
            for j, t in enumerate(s):
                x[row, [self.features[f] for f in t]] = 1
                row += 1
                gold[i, j, y[j]] = 1
                real[i, j] = True
                moves[before, y[j]] += 1
                before = y[j]
        self.emit = np.zeros((len(self.features), labels))
        params = [self.emit, self.move]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for r in range(1, rounds + 1):
            e = np.zeros((n, length, labels), np.float32)
            e[real] = x @ self.emit.astype(np.float32)
            t = np.where(self.allowed, self.move, _NO).astype(np.float32)
            ahead = np.zeros((n, length, labels), np.float32)
            ahead[:, 0] = e[:, 0] + t[0]
            for j in range(1, length):
                step = _log_sum(ahead[:, j - 1, :, None] + t, 1) + e[:, j]
                ahead[:, j] = np.where(real[:, j, None], step, ahead[:, j - 1])
            total = _log_sum(ahead[:, -1], 1)
            back = np.zeros((n, length, labels), np.float32)
            grad_move = -moves.copy()
            for j in range(length - 1, 0, -1):
                v = e[:, j] + back[:, j]
                both = np.exp(ahead[:, j - 1, :, None] + t + v[:, None] - total[:, None, None])
                grad_move += (both * real[:, j, None, None]).sum(0)
                back[:, j - 1] = np.where(real[:, j, None], _log_sum(t + v[:, None], 2), back[:, j])
            p = np.exp(ahead + back - total[:, None, None]) * real[..., None]
            grad_move[0] += p[:, 0].sum(0)
            grads = [x.T @ (p - gold)[real].astype(np.float32) / n + decay * self.emit, np.where(self.allowed, grad_move, 0) / n + decay * self.move]
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.999**r)) + 1e-8)
        return self

    def decode(self, sequences: list[list[list[str]]], cells: int = 1 << 18) -> list[np.ndarray]:
        """The best label numbers of each sequence; sequences of like length run together, at most `cells` tokens at once."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        order = sorted((i for i in range(len(sequences)) if sequences[i]), key=lambda i: len(sequences[i]))
        t = np.where(self.allowed, self.move, _NO)
        while order:
            length = len(sequences[order[-1]])
            take = max(1, cells // length)
            some, order = order[-take:], order[:-take]
            size = np.asarray([len(sequences[i]) for i in some])
            scores = self._scores([f for i in some for f in sequences[i]])
            begin = np.cumsum(size) - size
            best = scores[begin] + t[0]
            came = np.zeros((length, len(some), len(self.labels)), np.uint8)
            ends = np.where(size == 1, best.argmax(1), 0)
            for j in range(1, length):
                live = np.flatnonzero(size > j)
                step = best[live][:, :, None] + t
                came[j, live] = step.argmax(1)
                best[live] = step.max(1) + scores[begin[live] + j]
                done = live[size[live] == j + 1]
                ends[done] = best[done].argmax(1)
            path = np.zeros((length, len(some)), np.int64)
            path[size - 1, np.arange(len(some))] = ends
            for j in range(length - 1, 0, -1):
                live = np.flatnonzero(size > j)
                path[j - 1, live] = came[j, live, path[j, live]]
            for k, i in enumerate(some):
                out[i] = path[: size[k], k].copy()
        return out
