"""A small causal self-attention model in numpy: forward, gradients, Adam."""

from __future__ import annotations

import math

import numpy as np

F32 = np.float32


class Attention:
    """Predicts the class of the next token from the (first, last) subword
    classes of up to ``length`` tokens before it: one attention layer with a
    causal mask, one hidden layer, and a softmax over classes."""

    def __init__(self, classes: int, last_classes: int, length: int, width: int = 16, hidden: int = 32, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.length, self.width = length, width

        def normal(*shape: int, scale: float = 0.2) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(F32)

        self.p = {"e1": normal(classes, width), "e2": normal(last_classes, width), "pos": normal(length, width, scale=0.05),
                  "q": normal(width, width), "k": normal(width, width), "v": normal(width, width), "o": normal(width, width),
                  "w1": normal(width, hidden), "b1": np.zeros(hidden, F32), "w2": normal(hidden, width), "u": normal(width, classes, scale=0.02),
                  "b": np.zeros(classes, F32)}
        self.seen = np.tril(np.ones((length, length), F32))
        self.mask = np.triu(np.full((length, length), -1e9, F32), 1)
        ends = np.cumsum([v.size for v in self.p.values()]).tolist()
        self.places = {k: (end - v.size, end) for (k, v), end in zip(self.p.items(), ends, strict=True)}
        self.m, self.s = np.zeros(ends[-1], F32), np.zeros(ends[-1], F32)
        self.moments = {k: tuple(x[at: end].reshape(self.p[k].shape) for x in (self.m, self.s)) for k, (at, end) in self.places.items()}
        self.rooms: dict[str, np.ndarray] = {}
        self.steps = 0

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at: at + n].reshape(self.p[k].shape).astype(F32)
            at += n

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array that is written anew by each call: fresh memory costs more than the sums in it."""
        size = math.prod(shape)
        if name not in self.rooms or self.rooms[name].size < size:
            self.rooms[name] = np.empty(size, F32)
        return self.rooms[name][:size].reshape(shape)

    def _product(self, name: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.matmul(left, right, out=self._room(name, *left.shape[:-1], right.shape[-1]))

    def _attend(self, x1: np.ndarray, x2: np.ndarray) -> tuple:
        p, (n, length), width = self.p, x1.shape, self.width
        x = np.take(p["e1"], x1, axis=0, out=self._room("x", n, length, width), mode="clip")
        x += np.take(p["e2"], x2, axis=0, out=self._room("z", n, length, width), mode="clip")
        x += p["pos"]
        into = np.concatenate([p["q"] * F32(width ** -0.5), p["k"], p["v"]], axis=1)
        qkv = self._product("qkv", x, into)
        q, k, v = qkv[..., :width], qkv[..., width: 2 * width], qkv[..., 2 * width:]
        a = self._product("a", q, k.transpose(0, 2, 1))
        if _small(a):
            np.exp(a, out=a)
            a *= self.seen
        else:
            a += self.mask
            a -= a.max(axis=-1, keepdims=True)
            np.exp(a, out=a)
        a *= (1 / (a @ np.ones(length, F32)))[..., None]
        z = self._product("z", a, v)
        h = self._product("h", z, p["o"])
        h += x
        return x, into, q, k, v, a, z, h

    def _predict(self, h: np.ndarray) -> tuple:
        """``o`` has a last column of ones, which takes the classes' bias."""
        p, width = self.p, self.width
        r = self._product("r", h, p["w1"])
        r += p["b1"]
        np.maximum(r, 0, out=r)
        o = self._room("o", *h.shape[:-1], width + 1)
        np.add(h, self._product("r2", r, p["w2"]), out=o[..., :width])
        o[..., width] = 1
        logits = self._product("logits", o, np.concatenate([p["u"], p["b"][None]]))
        if not _small(logits):
            logits -= logits.max(axis=-1, keepdims=True)
        return r, o, logits

    def log_probs(self, x1: np.ndarray, x2: np.ndarray, target: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each target class; all (windows, length).
        With ``live``, a mask, only of the targets in it, as one list."""
        h, y = self._attend(x1, x2)[-1], target
        if live is not None:
            at = np.flatnonzero(live)
            h, y = np.take(h.reshape(-1, self.width), at, axis=0), np.take(target, at)
        logits = self._predict(h)[-1]
        picked = logits.reshape(-1, logits.shape[-1])[np.arange(y.size), y.ravel()].reshape(y.shape)
        return picked - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[-1], F32))

    def step(self, x1: np.ndarray, x2: np.ndarray, target: np.ndarray, live: np.ndarray, rate: float) -> None:
        """One Adam step on the mean loss of the live targets."""
        p, g, width = self.p, {}, self.width
        x, into, q, k, v, a, z, h = self._attend(x1, x2)
        r, o, logits = self._predict(h)
        d = np.exp(logits, out=logits)
        total = d @ np.ones(d.shape[-1], F32)
        d.reshape(-1, d.shape[-1])[np.arange(target.size), target.ravel()] -= total.ravel()
        # the loss's gradient by the logits is weight * d, position by position
        weight = (live / (total * max(live.sum(), 1))).astype(F32)[..., None]
        do = self._product("do", d, np.ascontiguousarray(p["u"].T))
        do *= weight
        o *= weight
        by = _outer(o, d)
        g["u"], g["b"] = by[:width], by[width]
        g["w2"] = _outer(r, do)
        dr = self._product("dr", do, np.ascontiguousarray(p["w2"].T))
        dr *= r > 0
        g["w1"], g["b1"] = _outer(h, dr), _total(dr)
        dh = do
        dh += self._product("x2", dr, np.ascontiguousarray(p["w1"].T))
        g["o"] = _outer(z, dh)
        dz = self._product("dz", dh, np.ascontiguousarray(p["o"].T))
        ds = self._product("ds", dz, v.transpose(0, 2, 1))
        ds -= (np.multiply(dz, z, out=z) @ np.ones(width, F32))[..., None]
        ds *= a
        back = self._room("back", *x.shape[:2], 3 * width)
        np.matmul(ds, k, out=back[..., :width])
        np.matmul(ds.transpose(0, 2, 1), q, out=back[..., width: 2 * width])
        np.matmul(a.transpose(0, 2, 1), dz, out=back[..., 2 * width:])
        by = _outer(x, back)
        g["q"], g["k"], g["v"] = by[:, :width] * F32(width ** -0.5), by[:, width: 2 * width], by[:, 2 * width:]
        dx = dh
        dx += self._product("x2", back, np.ascontiguousarray(into.T))
        g["pos"] = dx.sum(0)
        dx = dx.reshape(-1, width)
        g["e1"], g["e2"] = _sums(dx, x1.ravel(), len(p["e1"])), _sums(dx, x2.ravel(), len(p["e2"]))
        self.steps += 1
        fix = np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        grad = np.concatenate([g[name].ravel() for name in self.places])
        self.m += F32(0.1) * (grad - self.m)
        self.s += F32(0.001) * (grad * grad - self.s)
        by = F32(rate * fix) * self.m / (np.sqrt(self.s) + F32(1e-8))
        for name, (at, end) in self.places.items():
            p[name] -= by[at: end].reshape(p[name].shape)


def _small(x: np.ndarray) -> bool:
    """Whether exponentials of ``x``, and their sums, keep within single precision as they are."""
    return x.size == 0 or bool(x.max() < 60 and x.min() > -60)


def _outer(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sum over all positions of the products of their rows."""
    rows = 128 if left.shape[0] * left.shape[1] % 128 == 0 else left.shape[1]
    left, right = left.reshape(-1, rows, left.shape[-1]), right.reshape(-1, rows, right.shape[-1])
    return np.matmul(left.transpose(0, 2, 1), right).sum(0)


def _total(rows: np.ndarray) -> np.ndarray:
    rows = rows.reshape(-1, rows.shape[-1])
    return np.ones(len(rows), F32) @ rows


def _sums(rows: np.ndarray, classes: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each class."""
    order = np.argsort(classes, kind="stable")
    classes = classes[order]
    starts = np.concatenate([[0], np.flatnonzero(classes[1:] != classes[:-1]) + 1])
    out = np.zeros((n, rows.shape[1]), F32)
    out[classes[starts]] = np.add.reduceat(np.take(rows, order, axis=0), starts, axis=0)
    return out
