"""A bidirectional LSTM over characters with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np


def logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def _gate(z):
    return 1 / (1 + np.exp(-z))


class Tagger:
    """Tags of character classes. Inputs are (time, batch) arrays of classes; scores come out as (time, batch, tag)."""

    def __init__(self, classes: int, tags: int, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.normal(size=shape) * 0.2).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"out": make(2 * hidden, tags), "out_b": np.zeros(tags, np.float32), "move": make(tags, tags), "begin": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": make(classes, 4 * hidden), f"h{d}": make(hidden, 4 * hidden)}
            self.p[f"x{d}"][:, hidden : 2 * hidden] += 1  # remember at first

    def _run(self, x: np.ndarray, d: str, keep: bool):
        steps, batch = x.shape
        n, wx, wh = self.hidden, self.p[f"x{d}"], self.p[f"h{d}"]
        h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
        out, past = np.empty((steps, batch, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[x[t]] + h @ wh
            s = _gate(z[:, : 3 * n])
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            if keep:
                past.append((t, h, c, i, f, o, g))
            c = f * c + i * g
            h = o * np.tanh(c)
            out[t] = h
        return out, past

    def emissions(self, x: np.ndarray, keep: bool = False):
        f, pf = self._run(x, "f", keep)
        b, pb = self._run(x, "b", keep)
        both = np.concatenate([f, b], 2)
        return both @ self.p["out"] + self.p["out_b"], (both, pf, pb)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags y, and its gradients."""
        e, (both, pf, pb) = self.emissions(x, keep=True)
        e = e.astype(np.float64)
        steps, batch, k = e.shape
        move, begin = self.p["move"].astype(np.float64), self.p["begin"].astype(np.float64)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = begin + e[0]
        for t in range(1, steps):
            alpha[t] = logsumexp(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = logsumexp(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = logsumexp(alpha[-1], 1)
        rows = np.arange(batch)
        gold = begin[y[0]] + sum(e[t, rows, y[t]] for t in range(steps)) + sum(move[y[t - 1], y[t]] for t in range(1, steps))
        de = np.exp(alpha + beta - total[:, None])
        g_begin = de[0].sum(0)
        g_move = np.zeros_like(move)
        for t in range(1, steps):
            g_move += np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
            np.add.at(g_move, (y[t - 1], y[t]), -1)
        np.add.at(g_begin, y[0], -1)
        for t in range(steps):
            de[t, rows, y[t]] -= 1
        de /= batch
        n = self.hidden
        grads = {"begin": g_begin / batch, "move": g_move / batch, "out_b": de.sum((0, 1)), "out": np.einsum("tbh,tbk->hk", both, de)}
        back = de @ self.p["out"].T.astype(np.float64)
        for d, past, part in (("f", pf, back[:, :, :n]), ("b", pb, back[:, :, n:])):
            wh = self.p[f"h{d}"].astype(np.float64)
            gx, gh = np.zeros(self.p[f"x{d}"].shape), np.zeros(wh.shape)
            dh, dc = np.zeros((batch, n)), np.zeros((batch, n))
            for t, h0, c0, i, f, o, g in reversed(past):
                dh = dh + part[t]
                tc = np.tanh(f * c0 + i * g)
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                np.add.at(gx, x[t], dz)
                gh += h0.T @ dz
                dh, dc = dz @ wh.T, dc * f
            grads |= {f"x{d}": gx, f"h{d}": gh}
        return float((total - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam steps over shuffled batches; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros(v.shape) for k, v in self.p.items()}
        second = {k: np.zeros(v.shape) for k, v in self.p.items()}
        step, losses = 0, []
        for _ in range(epochs):
            order, loss = rng.permutation(x.shape[1]), []
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                value, grads = self.gradients(x[:, part], y[:, part])
                loss.append(value)
                step += 1
                for k, g in grads.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] = (self.p[k] - move).astype(np.float32)
            losses.append(float(np.mean(loss)))
        return losses

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags of (time, batch, tag) scores, as (time, batch)."""
        steps, batch, k = e.shape
        best = self.p["begin"] + e[0]
        back = np.empty((steps, batch, k), np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + self.p["move"]
            back[t] = options.argmax(1)
            best = options.max(1) + e[t]
        out = np.empty((steps, batch), np.int8)
        out[-1] = best.argmax(1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, rows, out[t]]
        return out
