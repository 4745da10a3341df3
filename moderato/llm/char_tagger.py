"""A character-level bidirectional LSTM with a CRF on top, in numpy."""

from __future__ import annotations

import functools

import numpy as np

_SIGNS = "\n !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_CODES = len(_SIGNS) + 6


@functools.cache
def _table() -> np.ndarray:
    """Code points below 128: each sign is a code; digits and letters are classes."""
    t = np.full(128, 1, np.int16)
    t[48:58], t[65:91], t[97:123] = 2, 3, 4
    for i, c in enumerate(_SIGNS):
        t[ord(c)] = 6 + i
    return t


def encode(text: str, size: int) -> np.ndarray:
    """Codes of a text, filled up with 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[:size]
    out = np.zeros(size, np.int16)
    out[:len(points)] = np.where(points < 128, _table()[np.minimum(points, 127)], 5)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Weights are float32 arrays in ``w``; sequences are code arrays (batch, length)."""

    def __init__(self, n_tags: int, embed: int = 12, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.h, self.t = hidden, n_tags
        self.w = {"e": f(N_CODES, embed) * 2, "o": f(2 * hidden, n_tags), "ob": np.zeros(n_tags, np.float32),
                  "a": np.zeros((n_tags, n_tags), np.float32), "s": np.zeros(n_tags, np.float32)}
        for d in "lr":
            self.w |= {d + "x": f(embed, 4 * hidden), d + "h": f(hidden, 4 * hidden), d + "b": np.zeros(4 * hidden, np.float32)}
            self.w[d + "b"][hidden:2 * hidden] = 1      # open forget gates

    def _run(self, x, d, keep=False):
        """Hidden states (batch, length, hidden) of one direction, and what its gradient needs."""
        h_, (n, size) = self.h, x.shape[:2]
        wx, wh, b = (self.w[d + k] for k in "xhb")
        z = x @ wx + b
        h, c = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
        out, kept = np.empty((n, size, h_), np.float32), []
        for t in range(size):
            g = z[:, t] + h @ wh
            s, u = _sigmoid(g[:, :3 * h_]), np.tanh(g[:, 3 * h_:])
            before, c = c, s[:, h_:2 * h_] * c + s[:, :h_] * u
            tc = np.tanh(c)
            if keep:
                kept.append((s, u, before, tc, h))
            h = s[:, 2 * h_:] * tc
            out[:, t] = h
        return out, kept

    def emissions(self, codes, keep=False):
        x = self.w["e"][codes]
        left, kl = self._run(x, "l", keep)
        right, kr = self._run(x[:, ::-1], "r", keep)
        both = np.concatenate([left, right[:, ::-1]], axis=2)
        return both @ self.w["o"] + self.w["ob"], (x, both, kl, kr)

    def _back(self, x, d, kept, dh_all, grads):
        h_, wx, wh = self.h, self.w[d + "x"], self.w[d + "h"]
        dh, dc = np.zeros_like(dh_all[:, 0]), np.zeros_like(dh_all[:, 0])
        dz_all = np.empty((*x.shape[:2], 4 * h_), np.float32)
        for t in reversed(range(x.shape[1])):
            s, u, before, tc, h = kept[t]
            i, f, o = s[:, :h_], s[:, h_:2 * h_], s[:, 2 * h_:]
            dh = dh + dh_all[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            dz_all[:, t] = dz
            grads[d + "h"] += h.T @ dz
            dh, dc = dz @ wh.T, dc * f
        flat = dz_all.reshape(-1, 4 * h_)
        grads[d + "x"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[d + "b"] += flat.sum(axis=0)
        return dz_all @ wx.T

    def loss(self, codes, tags):
        """Mean negative log likelihood and its gradients."""
        em, (x, both, kl, kr) = self.emissions(codes, keep=True)
        n, size, t_ = em.shape
        a = self.w["a"]
        lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        fwd, bwd = np.empty_like(em), np.zeros_like(em)
        fwd[:, 0] = em[:, 0] + self.w["s"]
        for t in range(1, size):
            fwd[:, t] = lse(fwd[:, t - 1, :, None] + a, 1) + em[:, t]
        for t in reversed(range(size - 1)):
            bwd[:, t] = lse(a + (em[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        z = lse(fwd[:, -1], 1)
        marginal = np.exp(fwd + bwd - z[:, None, None])
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        pair = np.exp(fwd[:, :-1, :, None] + a + (em[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grads["a"] = pair.sum(axis=(0, 1))
        np.subtract.at(grads["a"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        rows, cols = np.arange(n)[:, None], np.arange(size)[None]
        gold = em[rows, cols, tags].sum(axis=1) + self.w["s"][tags[:, 0]] + a[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        d = marginal
        d[rows, cols, tags] -= 1
        grads["s"] = d[:, 0].sum(axis=0)
        flat = d.reshape(-1, t_)
        grads["o"], grads["ob"] = both.reshape(-1, both.shape[2]).T @ flat, flat.sum(axis=0)
        db = d @ self.w["o"].T
        dx = self._back(x, "l", kl, db[:, :, :self.h], grads)
        dx = dx + self._back(x[:, ::-1], "r", kr, db[:, ::-1, self.h:], grads)[:, ::-1]
        np.add.at(grads["e"], codes.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((z - gold).mean()), {k: v / n for k, v in grads.items()}

    def fit(self, codes, tags, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 11):
        """Adam over shuffled batches."""
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        loss = 0.0
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for at in range(0, len(order), batch):
                some, step = order[at:at + batch], step + 1
                loss, grads = self.loss(codes[some], tags[some])
                scale = min(1.0, 5.0 / (np.sqrt(sum(float((g * g).sum()) for g in grads.values())) + 1e-9))
                for k, g in grads.items():
                    g = g * scale
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def decode(self, codes) -> np.ndarray:
        """The best tag sequences (Viterbi)."""
        em, _ = self.emissions(codes)
        n, size, _ = em.shape
        score, back = em[:, 0] + self.w["s"], np.empty(em.shape, np.int8)
        for t in range(1, size):
            all_ = score[:, :, None] + self.w["a"]
            back[:, t] = all_.argmax(axis=1)
            score = all_.max(axis=1) + em[:, t]
        tags = np.empty((n, size), np.int8)
        tags[:, -1] = score.argmax(axis=1)
        for t in reversed(range(1, size)):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags
