"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

# Characters with a class of their own; the rest share classes.
OWN = "@.-_+%() \n:/\"'=#*$&!,;?[]|<>"
N_CLASSES = 1 + len(OWN) + 26 + 1 + 1 + 1 + 1
PAD = 0


def _classes() -> np.ndarray:
    out = np.full(0x180, N_CLASSES - 1, np.int16)
    for i, c in enumerate(OWN):
        out[ord(c)] = 1 + i
    at = 1 + len(OWN)
    for i in range(26):
        out[ord("a") + i] = at + i
        out[ord("A") + i] = at + 26
    for c in range(0x30, 0x3A):
        out[c] = at + 27
    out[0xC0:0x180] = at + 28
    return out


CLASSES = _classes()


def encode(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return CLASSES[np.minimum(code, len(CLASSES) - 1)]


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Tags are O and, for each kind, B and I."""

    def __init__(self, kinds: int, hidden: int = 20, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, 1 + 2 * kinds
        h, g = hidden, 4 * hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (rng.standard_normal((N_CLASSES, g)) * 0.2).astype(np.float32)
            self.p["h" + d] = (rng.standard_normal((h, g)) / np.sqrt(h)).astype(np.float32)
            bias = np.zeros(g, np.float32)
            bias[h:2 * h] = 1
            self.p["b" + d] = bias
        self.p["o"] = (rng.standard_normal((2 * h, self.tags)) * 0.2).astype(np.float32)
        self.p["c"] = np.zeros(self.tags, np.float32)
        self.p["t"] = np.zeros((self.tags, self.tags), np.float32)
        self.p["s"] = np.zeros(self.tags, np.float32)
        self.barred = np.zeros((self.tags, self.tags), np.float32)
        for b in range(1, self.tags, 2):
            self.barred[:, b + 1] = -1e4
            self.barred[b, b + 1] = self.barred[b + 1, b + 1] = 0

    def _run(self, x, d, keep=False):
        n, steps = x.shape
        h = np.zeros((n, self.hidden), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((steps, n, self.hidden), np.float32)
        saved = []
        k = self.hidden
        weights = self.p["x" + d] + self.p["b" + d]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = weights[x[:, t]] + h @ self.p["h" + d]
            s = sigmoid(a[:, :3 * k])
            g = np.tanh(a[:, 3 * k:])
            before, c_before = h, c
            c = s[:, k:2 * k] * c + s[:, :k] * g
            tc = np.tanh(c)
            h = s[:, 2 * k:] * tc
            out[t] = h
            if keep:
                saved.append((t, s, g, tc, before, c_before))
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(windows, steps, tags) scores of windows of class numbers."""
        both = np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], 2)
        return (both @ self.p["o"] + self.p["c"]).transpose(1, 0, 2)

    def _back(self, x, d, saved, up, grads):
        k = self.hidden
        dh = np.zeros((x.shape[0], k), np.float32)
        dc = np.zeros_like(dh)
        for t, s, g, tc, before, c_before in reversed(saved):
            dh = dh + up[t]
            i, f, o = s[:, :k], s[:, k:2 * k], s[:, 2 * k:]
            dc = dc + dh * o * (1 - tc * tc)
            a = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f),
                                dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            grads["h" + d] += before.T @ a
            grads["b" + d] += a.sum(0)
            np.add.at(grads["x" + d], x[:, t], a)
            dh, dc = a @ self.p["h" + d].T, dc * f

    def _crf(self, e, y):
        """Loss and gradients of the log likelihood of paths ``y``; e is (steps, n, tags)."""
        steps, n, k = e.shape
        move = self.p["t"] + self.barred
        alpha = np.empty((steps, n, k))
        alpha[0] = self.p["s"] + e[0]
        for t in range(1, steps):
            z = alpha[t - 1][:, :, None] + move
            m = z.max(1)
            alpha[t] = m + np.log(np.exp(z - m[:, None, :]).sum(1)) + e[t]
        beta = np.zeros((steps, n, k))
        for t in range(steps - 2, -1, -1):
            z = move + (e[t + 1] + beta[t + 1])[:, None, :]
            m = z.max(2)
            beta[t] = m + np.log(np.exp(z - m[:, :, None]).sum(2))
        total = np.logaddexp.reduce(alpha[-1], axis=1)
        gold = np.zeros((steps, n, k))
        gold[np.arange(steps)[:, None], np.arange(n)[None], y.T] = 1
        node = np.exp(alpha + beta - total[:, None]) - gold
        edge = np.zeros((k, k))
        for t in range(1, steps):
            z = alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - total[:, None, None]
            edge += np.exp(z).sum(0) - np.einsum("ni,nj->ij", gold[t - 1], gold[t])
        path = self.p["s"][y[:, 0]] + e[np.arange(steps)[:, None], np.arange(n)[None], y.T].sum(0)
        path = path + move[y[:, :-1], y[:, 1:]].sum(1)
        return (total - path).mean(), node / n, edge / n

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 64,
            rate: float = 0.02, seed: int = 3) -> float:
        """Adam over windows ``x`` with tags ``y``; returns the last mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for at in range(0, len(x), batch):
                own = order[at:at + batch]
                xs, ys = x[own], y[own]
                f, saved_f = self._run(xs, "f", True)
                b, saved_b = self._run(xs, "b", True)
                both = np.concatenate([f, b], 2)
                loss, node, edge = self._crf(both @ self.p["o"] + self.p["c"], ys)
                losses.append(loss)
                node = node.astype(np.float32)
                grads = {k: np.zeros_like(v) for k, v in self.p.items()}
                grads["o"] += np.einsum("tnh,tnk->hk", both, node)
                grads["c"] += node.sum((0, 1))
                grads["t"] += edge.astype(np.float32)
                grads["s"] += node[0].sum(0)
                up = node @ self.p["o"].T
                self._back(xs, "f", saved_f, up[:, :, :self.hidden], grads)
                self._back(xs, "b", saved_b, up[:, :, self.hidden:], grads)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                scale = min(1.0, 5.0 / max(norm, 1e-9))
                for k, g in grads.items():
                    g = g * scale
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    own_rate = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.p[k] = (self.p[k] - own_rate * first[k] / (np.sqrt(second[k]) + 1e-8)
                                 ).astype(np.float32)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best path over (n, steps, tags) scores."""
        n, steps, k = e.shape
        move = self.p["t"] + self.barred
        score = self.p["s"] + e[:, 0]
        score[:, 2::2] += -1e4
        back = np.zeros((steps, n, k), np.int8)
        for t in range(1, steps):
            z = score[:, :, None] + move
            back[t] = z.argmax(1)
            score = z.max(1) + e[:, t]
        out = np.zeros((n, steps), np.int8)
        out[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(n), out[:, t]]
        return out
