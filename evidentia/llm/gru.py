"""A gated recurrent language model in numpy with a class-factored softmax.

Symbols are split into classes of about equal probability; P(symbol | state) = P(class | state) P(symbol | class, state),
so a token costs about two square roots of the vocabulary instead of all of it. Documents are packed one behind the
other into lanes that run side by side; the state is carried from window to window and set to zero where a document
starts, so a document's likelihood is that of the whole text, however long. Training is backpropagation through time
truncated at ``WINDOW`` steps, with Adam.
"""

from __future__ import annotations

import heapq

import numpy as np

EMBED, HIDDEN, WINDOW = 16, 16, 20
SPAN = 50 * WINDOW
NAMES = ("E", "Wx", "b", "U", "bu", "Wc", "bc", "Ww", "bw")


def classes_of(freq: np.ndarray) -> np.ndarray:
    """Class of each symbol: symbols by falling frequency, cut where the mass passes another share of the square root."""
    count = max(1, int(np.sqrt(len(freq))))
    order = np.argsort(-freq, kind="stable")
    mass = np.cumsum((freq[order] + 1.0) ** 0.5)
    out = np.empty(len(freq), np.int64)
    out[order] = np.minimum((mass - 1e-9) / mass[-1] * count, count - 1).astype(np.int64)
    return np.unique(out, return_inverse=True)[1]


def _sigmoid(x):
    """Of -x, in place: numpy's exp is twice as fast as its tanh. What overflows ends at 0."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x):
    x *= -2
    np.exp(x, out=x)
    x += 1
    np.divide(2, x, out=x)
    x -= 1
    return x


def _exps(logits):
    """exp of ``logits`` in place, and its sums over columns; logits of states within [-1, 1] are far from overflow."""
    e = np.exp(np.minimum(logits, 80, out=logits), out=logits)
    return e, e.sum(0)


class Adam:
    """Steps on ``weights`` in place: warmed up, then falling to a twentieth of ``rate`` over about ``steps``; gradients are clipped to norm 1."""

    def __init__(self, weights: np.ndarray, rate: float, steps: int):
        self.weights, self.rate, self.steps, self.at = weights, rate, steps, 0
        self.m, self.v = np.zeros_like(weights), np.zeros_like(weights)

    def step(self, g: np.ndarray) -> None:
        self.at += 1
        now = self.rate * min(1.0, self.at / 20) * max(0.05, 1 - self.at / (self.steps * 1.1 + 20))
        g = g * np.float32(min(1.0, 1.0 / (np.sqrt(float(g @ g)) + 1e-9)))
        self.m += np.float32(0.1) * (g - self.m)
        self.v += np.float32(0.01) * (g * g - self.v)
        self.weights -= np.float32(now / (1 - 0.9**self.at)) * self.m / (np.sqrt(self.v / np.float32(1 - 0.99**self.at)) + np.float32(1e-8))


class Gru:
    def __init__(self, freq: np.ndarray, end: int, seed: int = 3):
        rng, m = np.random.default_rng(seed), len(freq)
        self.end, self.cls, self.inputs = end, classes_of(freq), None
        c = int(self.cls.max()) + 1
        # Rows of Ww and bw lie class by class, so a class is a slice of them.
        order = np.argsort(self.cls, kind="stable")
        self.starts = np.searchsorted(self.cls[order], np.arange(c + 1))
        self.row = np.empty(m, np.int64)
        self.row[order] = np.arange(m)
        f32 = lambda *s: (rng.normal(0, 1 / np.sqrt(s[0] if len(s) > 1 else 1), s)).astype(np.float32)
        p = np.log((freq + 1) / (freq.sum() + m))
        mass = np.bincount(self.cls, np.exp(p), c)
        start = {
            "E": f32(m, EMBED) * np.float32(np.sqrt(m) * 0.3), "Wx": f32(EMBED, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN), "U": f32(HIDDEN, 3 * HIDDEN), "bu": np.zeros(3 * HIDDEN),
            "Wc": f32(HIDDEN, c) * np.float32(0.1), "bc": np.log(mass), "Ww": rng.normal(0, 0.02, (m, HIDDEN)), "bw": (p - np.log(mass)[self.cls])[order],
        }
        self.weights = np.concatenate([start[k].ravel() for k in NAMES]).astype(np.float32)
        cuts = np.cumsum([start[k].size for k in NAMES])[:-1]
        self.p = {k: v.reshape(start[k].shape) for k, v in zip(NAMES, np.split(self.weights, cuts))}  # views

    def flat(self) -> np.ndarray:
        return self.weights.copy()

    def load(self, flat: np.ndarray) -> "Gru":
        self.weights[:] = flat
        return self

    def _inputs(self) -> np.ndarray:
        """What each symbol adds to the gates, those of :func:`_sigmoid` negated and with both biases."""
        g = self.p["Wx"].T @ self.p["E"].T + self.p["b"][:, None]
        g[: 2 * HIDDEN] += self.p["bu"][: 2 * HIDDEN, None]
        np.negative(g[: 2 * HIDDEN], out=g[: 2 * HIDDEN])
        return g

    @np.errstate(over="ignore")
    def _run(self, x, fresh, h, keep=False):
        """States (H, T, B) of inputs x (T, B); where ``fresh``, the state starts at zero. Units come first, so what is done to a gate is done to whole rows."""
        p, shape = self.p, x.shape
        g = np.take(self._inputs() if keep else self.inputs, x, 1)
        hs = np.empty((HIDDEN, *shape), g.dtype)
        was, zr, cs, uc = (np.empty((w, *shape), g.dtype) for w in (HIDDEN, 2 * HIDDEN, HIDDEN, HIDDEN)) if keep else (None,) * 4
        starts, left, bias = fresh.any(1), p["U"].T.copy(), p["bu"][2 * HIDDEN :, None]
        np.negative(left[: 2 * HIDDEN], out=left[: 2 * HIDDEN])
        for t in range(len(x)):
            if starts[t]:
                h = np.where(fresh[t], g.dtype.type(0), h)
            u = left @ h
            a, last = u[: 2 * HIDDEN], u[2 * HIDDEN :]
            a += g[: 2 * HIDDEN, t]
            last += bias
            z, r = _sigmoid(a)[:HIDDEN], a[HIDDEN:]
            c = r * last
            c += g[2 * HIDDEN :, t]
            c = _tanh(c)
            if keep:
                was[:, t], zr[:, t], cs[:, t], uc[:, t] = h, a, c, last
            h = h - c
            h *= z
            h += c
            hs[:, t] = h
        return hs, h, (was, zr, cs, uc)

    def _out(self, hs, y, live, grads=None):
        """Natural log-probabilities of the live symbols y (T, B), row by row, given states; fills ``grads`` and returns the states' gradient too."""
        p = self.p
        cells = np.flatnonzero(live)
        y = y.ravel()[cells]
        order = np.argsort(self.cls[y].astype(np.int16), kind="stable")
        y = y[order]
        sorted_cells, cls, row, at = cells[order], self.cls[y], self.row[y], np.arange(len(y))
        units = hs.reshape(HIDDEN, -1)
        hs = np.take(units, sorted_cells, 1)
        logits = p["Wc"].T @ hs
        logits += p["bc"][:, None]
        lp = logits[cls, at]
        e, s = _exps(logits)
        lp -= np.log(s)
        d = None
        if grads is not None:
            e /= s
            e[cls, at] -= 1
            grads["Wc"], grads["bc"] = hs @ e.T, e.sum(1)
            d = p["Wc"] @ e
        cuts = np.searchsorted(cls, np.arange(len(self.starts)))
        for k in np.flatnonzero(np.diff(cuts)):
            a, z, first, last = cuts[k], cuts[k + 1], self.starts[k], self.starts[k + 1]
            if last - first == 1:
                continue
            hk, place, words = hs[:, a:z], row[a:z] - first, p["Ww"][first:last]
            w = words @ hk
            w += p["bw"][first:last, None]
            mine = w[place, at[: z - a]]
            w, sw = _exps(w)
            lp[a:z] += mine - np.log(sw)
            if grads is not None:
                w /= sw
                w[place, at[: z - a]] -= 1
                grads["Ww"][first:last] = w @ hk.T
                grads["bw"][first:last] = w.sum(1)
                d[:, a:z] += words.T @ w
        out = np.empty_like(lp)
        out[order] = lp
        if d is not None:
            back = np.zeros_like(units)
            back[:, sorted_cells] = d
            d = back
        return out, d

    def _step(self, x, fresh, y, live, h):
        """Loss gradient over one window."""
        p = self.p
        hs, last, (was, zr, cs, uc) = self._run(x, fresh, h, keep=True)
        g = {k: np.zeros_like(p[k]) for k in NAMES}
        lp, d = self._out(hs, y, live, g)
        n = max(1, len(lp))
        dhs, du, dcs, nxt = d.reshape(hs.shape), np.empty((3 * HIDDEN, *x.shape), hs.dtype), np.empty_like(hs), np.zeros_like(last)
        # What each step multiplies by, for all steps at once.
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        rest = 1 - z
        by_z, by_c, by_r = (was - cs) * z * rest, rest * (1 - cs * cs), uc * r * (1 - r)
        starts = fresh.any(1)
        for t in range(len(x) - 1, -1, -1):
            dh = dhs[:, t] + nxt
            dc = dh * by_c[:, t]
            dcs[:, t] = dc
            np.multiply(dh, by_z[:, t], out=du[:HIDDEN, t])
            np.multiply(dc, by_r[:, t], out=du[HIDDEN : 2 * HIDDEN, t])
            np.multiply(dc, r[:, t], out=du[2 * HIDDEN :, t])
            nxt = p["U"] @ du[:, t]
            dh *= z[:, t]
            nxt += dh
            if starts[t]:
                nxt[:, fresh[t]] = 0
        flat = du.reshape(3 * HIDDEN, -1)
        g["U"], g["bu"] = was.reshape(HIDDEN, -1) @ flat.T, flat.sum(1)
        flat[2 * HIDDEN :] = dcs.reshape(HIDDEN, -1)
        x = x.ravel()
        g["Wx"], g["b"] = np.take(p["E"].T, x, 1) @ flat.T, flat.sum(1)
        for k, column in enumerate(p["Wx"] @ flat):
            g["E"][:, k] = np.bincount(x, column, len(self.cls))
        return {k: v / n for k, v in g.items()}, last, float(lp.sum()), n

    def train(self, docs: list[np.ndarray], epochs: int, rate: float, lanes: int = 32, seed: int = 1, leads: list[int] | None = None) -> int:
        """Passes over documents (symbol ids, each with its end) or pieces of them; gives the tokens of one pass."""
        leads = leads or [0] * len(docs)
        total = sum(map(len, docs)) - sum(leads)
        fit = Adam(self.weights, rate, max(1, epochs * total // (lanes * WINDOW)))
        for k in range(epochs if total else 0):
            order = np.random.default_rng(seed + k).permutation(len(docs))
            self.learn([docs[i] for i in order], fit, lanes, [leads[i] for i in order])
        return total

    def learn(self, docs: list[np.ndarray], fit: "Adam", lanes: int, leads: list[int] | None = None) -> None:
        """One pass over ``docs``. The first ``leads`` symbols of each only bring the state to where the rest begins."""
        for x, fresh, y, live, h, *_ in self._windows(docs, lanes, carry := {}, leads):
            g, carry["h"], _, _ = self._step(x, fresh, y, live, h)
            if live.any():
                fit.step(np.concatenate([g[k].ravel() for k in NAMES]))

    def _windows(self, docs, lanes, carry, leads=None):
        """Windows over packed lanes: inputs, fresh starts, targets, live cells, state, and the document of each cell."""
        leads = leads or [0] * len(docs)
        heap = [(0, k, []) for k in range(max(1, min(lanes, len(docs))))]
        for i, d in enumerate(docs):
            n, k, own = heap[0]
            own.append(i)
            heapq.heapreplace(heap, (n + len(d), k, own))
        heap = sorted((x for x in heap if x[0]), key=lambda x: (-x[0], x[1]))
        lens = np.array([x[0] for x in heap])
        ys = [np.concatenate([docs[i] for i in x[2]]) for x in heap]
        of = [np.repeat(np.array(x[2], np.int32), [len(docs[i]) for i in x[2]]) for x in heap]
        told = [np.concatenate([np.arange(len(docs[i])) >= leads[i] for i in x[2]]) for x in heap]
        carry["h"] = np.zeros((HIDDEN, len(heap)), np.float32)
        for start in range(0, int(lens[0]) if len(heap) else 0, SPAN):
            # Lanes are laid side by side for many windows at once; those that have ended drop out, as the longest come first.
            b = int((lens > start).sum())
            rows = min(SPAN, int(lens[0]) - start)
            y, d, live = np.full((rows + 1, b), self.end, np.int32), np.full((rows + 1, b), -1, np.int32), np.zeros((rows, b), bool)
            for k in range(b):  # a row more in front: what came before
                a, z = max(start - 1, 0), min(start + rows, int(lens[k]))
                at = 0 if start else 1
                y[at : at + z - a, k], d[at : at + z - a, k] = ys[k][a:z], of[k][a:z]
                live[: z - start, k] = told[k][start:z]
            fresh = d[1:] != d[:-1]
            x = np.where(fresh, self.end, y[:-1])
            for at in range(0, rows, WINDOW):
                now, w = int((lens > start + at).sum()), slice(at, at + WINDOW)
                yield x[w, :now], fresh[w, :now] & (d[1:][w, :now] >= 0), y[1:][w, :now], live[w, :now], carry["h"][:, :now], d[1:][w, :now]

    def score(self, docs: list[np.ndarray], lanes: int = 256) -> np.ndarray:
        """Natural log-probability of each whole document. The longest are dealt first, so lanes end at about one time."""
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        found, self.inputs = np.zeros(len(docs)), self._inputs()
        for x, fresh, y, live, h, d in self._windows([docs[i] for i in order], lanes, carry := {}):
            hs, carry["h"], _ = self._run(x, fresh, h)
            lp, _ = self._out(hs, y, live)
            found += np.bincount(d[live], lp, len(docs))
        out = np.empty(len(docs))
        out[order] = found
        return out
