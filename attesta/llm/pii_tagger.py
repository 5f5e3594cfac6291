"""A character-level bidirectional LSTM with a CRF on top, in numpy: training by Adam, and emissions and decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
SIZE, STEP, MARGIN = 96, 64, 16  # window k covers the characters from STEP * k - MARGIN on
MARKS = "0@.-+() _%\n:/=\",[]"
CLASSES = 26 + len(MARKS) + 4
PAD = CLASSES - 1

_TABLE = np.full(129, CLASSES - 4, np.uint8)
for _i, _c in enumerate(MARKS):
    _TABLE[ord(_c)] = 26 + _i
for _i in range(26):
    _TABLE[97 + _i] = _TABLE[65 + _i] = _i
_TABLE[48:58] = 26
_TABLE[128] = CLASSES - 3


def classes(text: str) -> np.ndarray:
    """The class of each character: its letter, digit, mark, other, or not ASCII."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(x, 128)]


def allowed() -> np.ndarray:
    """0 where tag j may follow tag i, else a large penalty: I of a kind follows B or I of it."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for j in range(2, TAGS, 2):
        out[:, j] = -1e4
        out[j - 1, j] = out[j, j] = 0
    return out


FORBID = allowed()
FIRST = np.where(np.arange(TAGS) % 2 * 1 + (np.arange(TAGS) == 0) > 0, 0, -1e4).astype(np.float32)


@dataclass
class Tagger:
    """Weights of both directions stacked: x (2, classes, 4h), h (2, h, 4h), b (2, 1, 4h), out (2h, tags), bias, moves."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, hidden: int, seed: int) -> Tagger:
        r = np.random.default_rng(seed)
        g = lambda *s, scale: (r.normal(size=s) * scale).astype(np.float32)
        b = np.zeros((2, 1, 4 * hidden), np.float32)
        b[:, :, hidden : 2 * hidden] = 1
        return cls({"x": g(2, CLASSES, 4 * hidden, scale=0.3), "h": g(2, hidden, 4 * hidden, scale=hidden**-0.5), "b": b, "out": g(2 * hidden, TAGS, scale=0.2), "bias": np.zeros(TAGS, np.float32), "moves": np.zeros((TAGS, TAGS), np.float32)})

    def states(self, c: np.ndarray, keep: bool = False):
        """Hidden states (2, T, N, h) of windows c (N, T), the second direction read from the right; keep: for training."""
        n, t = c.shape
        h = self.p["h"].shape[1]
        kind = self.p["x"].dtype
        both = np.stack([c.T, c.T[::-1]])  # (2, T, N)
        # A sigmoid is half a tanh of half its input and a half, so that all four gates are one tanh.
        half = np.ones(4 * h, kind)
        half[: 3 * h] = 0.5
        x = (self.p["x"] + self.p["b"]) * half
        w = self.p["h"] * half
        which = np.arange(2)[:, None]
        hs, cs = np.zeros((2, t + 1, n, h), kind), np.zeros((2, t + 1, n, h), kind)
        gates = np.zeros((2, t, n, 4 * h), kind) if keep else None
        for i in range(t):
            z = x[which, both[:, i]]
            z += hs[:, i] @ w
            np.tanh(z, out=z)
            z[..., : 3 * h] *= 0.5
            z[..., : 3 * h] += 0.5
            cs[:, i + 1] = z[..., h : 2 * h] * cs[:, i] + z[..., :h] * z[..., 3 * h :]
            hs[:, i + 1] = z[..., 2 * h : 3 * h] * np.tanh(cs[:, i + 1])
            if keep:
                gates[:, i] = z
        return (both, hs, cs, gates) if keep else hs

    def emissions(self, c: np.ndarray) -> np.ndarray:
        """(N, T, tags) of windows c (N, T)."""
        hs = self.states(c)[:, 1:]
        x = np.concatenate([hs[0], hs[1, ::-1]], axis=-1)
        return (x @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tag path (N, T) of emissions (N, T, tags)."""
        n, t, _ = e.shape
        moves = self.p["moves"] + FORBID
        back = np.zeros((t, n, TAGS), np.int8)
        s = e[:, 0] + FIRST
        for i in range(1, t):
            x = s[:, :, None] + moves
            back[i] = x.argmax(axis=1)
            s = x.max(axis=1) + e[:, i]
        out = np.zeros((n, t), np.int8)
        out[:, -1] = s.argmax(axis=1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[i, np.arange(n), out[:, i]]
        return out

    def loss(self, c: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y (N, T) for windows c, and its gradient."""
        n, t = c.shape
        h = self.p["h"].shape[1]
        both, hs, cs, gates = self.states(c, keep=True)
        x = np.concatenate([hs[0, 1:], hs[1, 1:][::-1]], axis=-1)  # (T, N, 2h)
        e = x @ self.p["out"] + self.p["bias"]
        # Forward and backward in probabilities, scaled to sum to one at each place.
        top = e.max(axis=2, keepdims=True)
        odds, moves = np.exp(e - top), np.exp(self.p["moves"] + FORBID)
        a, b, scale = np.zeros_like(e), np.ones_like(e), np.zeros((t, n, 1), e.dtype)
        now = odds[0] * np.exp(FIRST)
        for i in range(t):
            if i:
                now = (a[i - 1] @ moves) * odds[i]
            scale[i] = now.sum(axis=1, keepdims=True)
            a[i] = now / scale[i]
        for i in range(t - 2, -1, -1):
            b[i] = (odds[i + 1] * b[i + 1] / scale[i + 1]) @ moves.T
        z = (np.log(scale) + top).sum(axis=(0, 2))
        d = a * b  # marginals (T, N, tags)
        rows = np.arange(n)
        gold = sum(e[i, rows, y[:, i]] for i in range(t)) + FIRST[y[:, 0]] + (self.p["moves"] + FORBID)[y[:, :-1], y[:, 1:]].sum(axis=1)
        g = {"moves": moves * (a[:-1].reshape(-1, TAGS).T @ (odds[1:] * b[1:] / scale[1:]).reshape(-1, TAGS))}
        np.subtract.at(g["moves"], (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        d[np.arange(t)[:, None], rows, y.T] -= 1
        d /= n
        g["moves"] /= n
        g["out"] = x.reshape(-1, 2 * h).T @ d.reshape(-1, TAGS)
        g["bias"] = d.sum(axis=(0, 1))
        dx = d @ self.p["out"].T
        dh_out = np.stack([dx[..., :h], dx[::-1, :, h:]])
        # What the steps back multiply by, for all places at once.
        one, forget, out, new = (gates[..., k * h : (k + 1) * h] for k in range(4))
        th = np.tanh(cs[:, 1:])
        into = out * (1 - th * th)
        by = [new * one * (1 - one), cs[:, :-1] * forget * (1 - forget), th * out * (1 - out), one * (1 - new * new)]
        dz = np.zeros((2, t, n, 4 * h), e.dtype)
        dh, dc, back = np.zeros((2, n, h), e.dtype), np.zeros((2, n, h), e.dtype), self.p["h"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            dh = dh + dh_out[:, i]
            dc = dc + dh * into[:, i]
            own = np.concatenate([dc * by[0][:, i], dc * by[1][:, i], dh * by[2][:, i], dc * by[3][:, i]], axis=-1)
            dz[:, i] = own
            dh = own @ back
            dc = dc * forget[:, i]
        every = dz.reshape(2, -1, 4 * h)
        hot = (both.reshape(2, -1)[:, :, None] == np.arange(CLASSES)).astype(e.dtype)
        g |= {"x": hot.transpose(0, 2, 1) @ every, "h": hs[:, :-1].reshape(2, -1, h).transpose(0, 2, 1) @ every, "b": every.sum(axis=1, keepdims=True)}
        return float((z - gold).mean()), g


def fit(c: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 12, batch: int = 96, rate: float = 0.02, seed: int = 5) -> Tagger:
    """Train on windows c (N, SIZE) and tags y (N, SIZE)."""
    model, r = Tagger.new(hidden, seed), np.random.default_rng(seed)
    m, v = {n: np.zeros_like(x) for n, x in model.p.items()}, {n: np.zeros_like(x) for n, x in model.p.items()}
    k, steps = 0, epochs * max(1, -(-len(c) // batch))
    for _ in range(epochs):
        order = r.permutation(len(c))
        for s in range(0, len(c), batch):
            own = order[s : s + batch]
            _, g = model.loss(c[own], y[own])
            k += 1
            norm = max(1.0, float(np.sqrt(sum((x * x).sum() for x in g.values()))) / 5)
            for n, x in g.items():
                m[n] = 0.9 * m[n] + 0.1 * x / norm
                v[n] = 0.99 * v[n] + 0.01 * (x / norm) ** 2
                model.p[n] -= rate * (1 - k / (steps + 1)) * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-6)
    return model
