"""A character-level bidirectional LSTM with CRF transitions, in numpy.

A window is an array of character ids.  Each direction's gates are a row of a table, one row a character, plus the last
state times a matrix; both directions run as one batched product.  Emissions are linear in both states, and the CRF adds a
score for each pair of neighbouring labels.  Training is by exact gradients (forward-backward for the CRF, back-propagation
through time for the LSTMs) with Adam; decoding is Viterbi, for a batch of windows at once.
"""

from __future__ import annotations

import numpy as np

FORBIDDEN = np.float32(-1e4)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Weights over ``symbols`` characters, ``hidden`` units a direction and ``labels`` labels, of which 0 is outside and odd ones begin a span."""

    def __init__(self, symbols: int, hidden: int, labels: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.hidden, self.labels = hidden, labels
        self.w = {
            "table": draw(2, symbols, 4 * hidden, scale=0.3),
            "state": draw(2, hidden, 4 * hidden, scale=hidden**-0.5),
            "out": draw(2 * hidden, labels, scale=hidden**-0.5),
            "bias": np.zeros(labels, np.float32),
            "step": np.zeros((labels, labels), np.float32),
            "start": np.zeros(labels, np.float32),
        }
        self.w["table"][:, :, hidden : 2 * hidden] += 1  # remember at first

    def _rules(self) -> tuple[np.ndarray, np.ndarray]:
        """Transitions and starts, without those into the inside of a span from elsewhere.  A window may begin within a span."""
        step = self.w["step"].copy()
        for inside in range(2, self.labels, 2):
            step[[x for x in range(self.labels) if x not in (inside - 1, inside)], inside] = FORBIDDEN
        return step, self.w["start"]

    def _run(self, ids: np.ndarray, keep: bool = False):
        """Emissions (windows, places, labels), and what training needs."""
        n, t = ids.shape
        h = self.hidden
        both = np.stack([ids, ids[:, ::-1]])
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        states, kept = np.empty((2, n, t, h), np.float32), []
        for k in range(t):
            pre = state @ self.w["state"]
            for d in range(2):
                pre[d] += self.w["table"][d][both[d, :, k]]
            gate = _sigmoid(pre[..., : 3 * h])
            new = np.tanh(pre[..., 3 * h :])
            before, last = cell, state
            cell = gate[..., h : 2 * h] * before + gate[..., :h] * new
            squashed = np.tanh(cell)
            state = gate[..., 2 * h :] * squashed
            states[:, :, k] = state
            if keep:
                kept.append((gate, new, before, squashed, last))
        joined = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
        return joined @ self.w["out"] + self.w["bias"], joined, both, kept

    def _crf(self, emit: np.ndarray, gold: np.ndarray):
        """Loss a window, and the gradients of emissions, transitions and starts."""
        n, t, m = emit.shape
        step, start = self._rules()
        forward = np.empty_like(emit)
        forward[:, 0] = start + emit[:, 0]
        total = lambda x, axis: (top := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis=axis))
        for k in range(1, t):
            forward[:, k] = total(forward[:, k - 1, :, None] + step, 1) + emit[:, k]
        z = total(forward[:, -1], 1)
        backward = np.zeros((n, m), np.float32)
        d_emit, d_step = np.empty_like(emit), np.zeros_like(step)
        for k in range(t - 1, -1, -1):
            d_emit[:, k] = np.exp(forward[:, k] + backward - z[:, None])
            if k:
                ahead = emit[:, k] + backward
                d_step += np.exp(forward[:, k - 1, :, None] + step + ahead[:, None, :] - z[:, None, None]).sum(axis=0)
                backward = total(step + ahead[:, None, :], 2)
        rows = np.arange(n)
        d_start = d_emit[:, 0].sum(axis=0)
        score = start[gold[:, 0]] + np.take_along_axis(emit, gold[:, :, None], 2).sum(axis=(1, 2)) + step[gold[:, :-1], gold[:, 1:]].sum(axis=1)
        np.add.at(d_start, gold[:, 0], -1)
        np.add.at(d_step, (gold[:, :-1], gold[:, 1:]), -1)
        d_emit[rows[:, None], np.arange(t)[None, :], gold] -= 1
        return float((z - score).mean()), d_emit / n, d_step / n, d_start / n

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        emit, joined, both, kept = self._run(ids, True)
        loss, d_emit, d_step, d_start = self._crf(emit, gold)
        n, t = ids.shape
        h = self.hidden
        flat = d_emit.reshape(-1, self.labels)
        d_joined = d_emit @ self.w["out"].T
        d_states = np.stack([d_joined[..., :h], d_joined[:, ::-1, h:]])
        d_pre = np.empty((2, n, t, 4 * h), np.float32)
        d_u = np.zeros_like(self.w["state"])
        d_state, d_cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        back = self.w["state"].transpose(0, 2, 1)
        for k in range(t - 1, -1, -1):
            gate, new, before, squashed, last = kept[k]
            i, f, o = gate[..., :h], gate[..., h : 2 * h], gate[..., 2 * h :]
            d_state = d_state + d_states[:, :, k]
            d_cell = d_cell + d_state * o * (1 - squashed**2)
            g = d_pre[:, :, k]
            g[..., :h] = d_cell * new * i * (1 - i)
            g[..., h : 2 * h] = d_cell * before * f * (1 - f)
            g[..., 2 * h : 3 * h] = d_state * squashed * o * (1 - o)
            g[..., 3 * h :] = d_cell * i * (1 - new**2)
            d_u += last.transpose(0, 2, 1) @ g
            d_state = g @ back
            d_cell = d_cell * f
        d_table = np.empty_like(self.w["table"])
        one = np.eye(d_table.shape[1], dtype=np.float32)
        for d in range(2):
            d_table[d] = one[both[d].ravel()].T @ d_pre[d].reshape(-1, 4 * h)
        out = joined.reshape(-1, 2 * h).T @ flat
        return loss, {"table": d_table, "state": d_u, "out": out, "bias": flat.sum(axis=0), "step": d_step.astype(np.float32), "start": d_start.astype(np.float32)}

    def fit(self, ids: np.ndarray, gold: np.ndarray, batch: int = 64, rounds: int = 4, rate: float = 0.01, seed: int = 42) -> list[float]:
        """The mean loss of each round.  The step shrinks to a tenth over the rounds."""
        rng, losses, count = np.random.default_rng(seed), [], 0
        first = {k: np.zeros_like(x) for k, x in self.w.items()}
        second = {k: np.zeros_like(x) for k, x in self.w.items()}
        steps = rounds * max(1, len(ids) // batch)
        for _ in range(rounds):
            order, seen = rng.permutation(len(ids)), []
            for at in range(0, max(1, len(ids) - batch + 1), batch):
                pick = order[at : at + batch]
                loss, slope = self.gradients(ids[pick], gold[pick])
                size = np.sqrt(sum(float((g**2).sum()) for g in slope.values()))
                count += 1
                now = rate * (1 - 0.9 * count / steps)
                for k, g in slope.items():
                    g = g * min(1.0, 5 / (size + 1e-6))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= (now * (first[k] / (1 - 0.9**count)) / (np.sqrt(second[k] / (1 - 0.999**count)) + 1e-8)).astype(np.float32)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best labels of each window, and at each place how much its label's emission and transition are above those of outside."""
        emit = self._run(ids)[0]
        step, start = self._rules()
        n, t, m = emit.shape
        score = start + emit[:, 0]
        back = np.empty((n, t, m), np.int8)
        for k in range(1, t):
            ways = score[:, :, None] + step
            back[:, k] = ways.argmax(axis=1)
            score = ways.max(axis=1) + emit[:, k]
        best = np.empty((n, t), np.int64)
        best[:, -1] = score.argmax(axis=1)
        rows = np.arange(n)
        for k in range(t - 1, 0, -1):
            best[:, k - 1] = back[rows, k, best[:, k]]
        above = np.take_along_axis(emit, best[:, :, None], 2)[..., 0] - emit[..., 0]
        above[:, 1:] += step[best[:, :-1], best[:, 1:]] - step[0, 0]
        return best, above
