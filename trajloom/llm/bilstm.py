"""A character-level bidirectional LSTM with CRF transitions, trained and decoded in numpy."""

from __future__ import annotations

import numpy as np


def char_id(c: str) -> int:
    return ord(c) - 31 if 32 <= ord(c) < 127 else 96 if c.isspace() else 97 if c.isalpha() else 98 if c.isdigit() else 99


#: The ids of the characters that two bytes hold.
IDS = np.array([char_id(chr(i)) for i in range(1 << 16)], np.uint8)


def char_ids(text: str) -> np.ndarray:
    """0: padding; printable ASCII has an id each; white space, letters, digits and other signs beyond it share one each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = IDS[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        ids[i] = char_id(text[i])
    return ids


VOCABULARY = 100


def bent(x: np.ndarray) -> np.ndarray:
    """From -1 to 1 as tanh is, of the same slope at 0, without an exponential: numpy takes about half the time."""
    return x / np.sqrt(1 + x * x)


def slope(y: np.ndarray) -> np.ndarray:
    """bent()'s, where its value is y."""
    return (1 - y * y) ** 1.5


def gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * (bent(0.5 * x) + 1)


def gate_slope(g: np.ndarray) -> np.ndarray:
    return 0.25 * slope(2 * g - 1)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Tags each character of windows. The windows of a call have one length; their padding follows the text."""

    def __init__(self, n_tags: int, embed: int = 10, hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) * (1.0 / np.sqrt(shape[0]))).astype(np.float32)
        self.hidden, self.k = hidden, n_tags
        self.p = {"E": init(VOCABULARY, embed), "O": init(2 * hidden, n_tags), "o": np.zeros(n_tags, np.float32), "A": np.zeros((n_tags, n_tags), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(embed, 4 * hidden), f"U{d}": init(hidden, 4 * hidden), f"B{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"B{d}"][hidden : 2 * hidden] = 1  # gates start open for what they remember

    def run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states (time, window, unit) of one direction over embedded windows, and what the way back needs."""
        p, n = self.p, self.hidden
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        pre = x @ p[f"W{d}"] + p[f"B{d}"]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, kept = np.empty((len(x), x.shape[1], n), np.float32), []
        for t in steps:
            z = pre[t] + h @ p[f"U{d}"]
            g = gate(z[:, : 3 * n])
            a = bent(z[:, 3 * n :])
            i, f, o = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :]
            before, h_before = c, h
            c = f * c + i * a
            th = bent(c)
            h = o * th
            out[t] = h
            kept.append((t, i, f, o, a, before, h_before, th))
        return out, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (time, window, tag) of windows (window, time)."""
        x = self.p["E"][ids.T]
        return np.concatenate([self.run(x, "f")[0], self.run(x, "b")[0]], axis=2) @ self.p["O"] + self.p["o"]

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags (window, time) and its gradients."""
        p, n, w = self.p, self.hidden, len(ids)
        x = p["E"][ids.T]
        hf, kf = self.run(x, "f")
        hb, kb = self.run(x, "b")
        h = np.concatenate([hf, hb], axis=2)
        s = h @ p["O"] + p["o"]
        steps, y = len(s), tags.T
        fwd, bwd = np.empty_like(s), np.zeros_like(s)
        fwd[0] = s[0]
        for t in range(1, steps):
            fwd[t] = s[t] + logsum(fwd[t - 1][:, :, None] + p["A"][None], 1)
        for t in range(steps - 2, -1, -1):
            bwd[t] = logsum(p["A"][None] + (s[t + 1] + bwd[t + 1])[:, None, :], 2)
        total = logsum(fwd[-1], 1)
        gold = np.take_along_axis(s, y[:, :, None], 2)[:, :, 0].sum(0) + p["A"][y[:-1], y[1:]].sum(0)
        ds = np.exp(fwd + bwd - total[None, :, None])
        np.put_along_axis(ds, y[:, :, None], np.take_along_axis(ds, y[:, :, None], 2) - 1, 2)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        pair = fwd[:-1, :, :, None] + p["A"][None, None] + (s[1:] + bwd[1:])[:, :, None, :] - total[None, :, None, None]
        g["A"] = np.exp(pair).sum((0, 1)).astype(np.float32)
        np.subtract.at(g["A"], (y[:-1].ravel(), y[1:].ravel()), 1)
        ds = (ds / w).astype(np.float32)
        g["A"] /= w
        g["O"] = np.tensordot(h, ds, ([0, 1], [0, 1]))
        g["o"] = ds.sum((0, 1))
        dh = ds @ p["O"].T
        dx = np.zeros_like(x)
        for d, kept, grad in (("f", kf, dh[:, :, :n]), ("b", kb, dh[:, :, n:])):
            dnext = np.zeros((w, n), np.float32)
            dc = np.zeros((w, n), np.float32)
            for t, i, f, o, a, before, h_before, th in reversed(kept):
                dht = grad[t] + dnext
                dc = dc + dht * o * slope(th)
                dz = np.concatenate([dc * a * gate_slope(i), dc * before * gate_slope(f), dht * th * gate_slope(o), dc * i * slope(a)], axis=1)
                g[f"W{d}"] += x[t].T @ dz
                g[f"U{d}"] += h_before.T @ dz
                g[f"B{d}"] += dz.sum(0)
                dx[t] += dz @ p[f"W{d}"].T
                dnext = dz @ p[f"U{d}"].T
                dc = dc * f
        np.add.at(g["E"], ids.T, dx)
        return float((total - gold).mean()), g

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over shuffled batches with a falling rate; the mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        last = epochs * -(-len(ids) // batch)
        for _ in range(epochs):
            order, sums = rng.permutation(len(ids)), []
            for at in range(0, len(ids), batch):
                some = order[at : at + batch]
                loss, g = self.gradients(ids[some], tags[some])
                sums.append(loss)
                step += 1
                size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                clip = min(1.0, 5.0 / (size + 1e-9))
                now = rate * (1 - step / (last + 1)) + 1e-4
                for k, x in g.items():
                    x = x * clip
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x * x
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """emissions() as (time, tag, window), for many windows: both directions side by side, one product a step for all gates.

        All gates are bent() of rows that hold the factors; a gate's half and a state's are left to the products they go into.
        """
        n, p = self.hidden, self.p
        steps, width, embed = ids.shape[1], ids.shape[0], p["E"].shape[1]
        codes = np.ascontiguousarray(ids.T, np.intp)
        s = np.empty((steps, self.k, width), np.float32)
        s[:] = p["o"][:, None]
        scale = np.full((4 * n, 1), 0.5, np.float32)
        scale[3 * n :] = 1
        chars = np.ascontiguousarray(p["E"].T)
        u = np.stack([np.concatenate([0.5 * p[f"U{d}"], p[f"W{d}"], p[f"B{d}"][None]]).T * scale for d in "fb"])
        out, half = 0.5 * np.stack([p["O"][:n].T, p["O"][n:].T]), np.float32(0.5)
        x = np.ones((2, n + embed + 1, width), np.float32)  # a step's states, characters, and one for the bias
        z, root, held, tagged = (np.empty((2, k, width), np.float32) for k in (4 * n, 4 * n, n, self.k))
        c, h = np.zeros((2, n, width), np.float32), x[:, :n]
        h[:] = 0
        gates, i, f, o, new = z[:, : 3 * n], z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
        for t in range(steps):
            np.take(chars, codes[t], axis=1, out=x[0, n:-1], mode="clip")
            np.take(chars, codes[-1 - t], axis=1, out=x[1, n:-1], mode="clip")
            np.matmul(u, x, out=z)
            np.square(z, out=root)
            root += 1
            z /= np.sqrt(root, out=root)
            gates += 1
            c *= f
            c += np.multiply(i, new, out=held)
            c *= half
            np.square(c, out=held)
            held += 1
            np.divide(c, np.sqrt(held, out=held), out=held)
            np.multiply(held, o, out=h)
            np.matmul(out, h, out=tagged)
            s[t] += tagged[0]
            s[-1 - t] += tagged[1]
        return s

    def may_hold(self, s: np.ndarray) -> np.ndarray:
        """(window): whether any character of scores can have another tag than 0 in the best path.

        Tags come in pairs, one for a span's first character and one for the others. The best score and the best way of any kind's first
        characters, and of any kind's others, make a path whose gain over tag 0 no path exceeds. A window stands between two characters of
        tag 0. The slack is for rounding.
        """
        a = (self.p["A"] - self.p["A"][0, 0]).astype(np.float32)
        pair = (slice(1, None, 2), slice(2, None, 2))
        gains = [s[:, k].max(axis=1) - s[:, 0] for k in pair]
        into, out = [a[0, k].max() for k in pair], [a[k, 0].max() for k in pair]
        ways = [[a[j, k].max() for j in pair] for k in pair]
        f, m, top, to_f, to_m, way = np.full((6, s.shape[2]), -1e9, np.float32)
        for gain in zip(*gains, strict=True):
            for to, (by_f, by_m), start, g in zip((to_f, to_m), ways, into, gain, strict=True):
                np.add(f, by_f, out=to)
                np.maximum(to, np.add(m, by_m, out=way), out=to)
                np.maximum(to, start, out=to)
                to += g
            f, m, to_f, to_m = to_f, to_m, f, m
            np.maximum(top, np.add(f, out[0], out=way), out=top)
            np.maximum(top, np.add(m, out[1], out=way), out=top)
        return top > -1e-3

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, tags, gain): of the windows whose best tags aren't all 0, their rows in ids, the tags (window, time), and how far each character's score is above that of tag 0.

        Windows whose tags must be 0 are left out of the Viterbi pass.
        """
        s, a = self.scores(ids), self.p["A"]
        held = np.flatnonzero(self.may_hold(s))
        s = s[:, :, held]
        best = np.empty_like(s)
        best[0] = s[0] + a[0][:, None]
        for t in range(1, len(s)):
            np.add((best[t - 1][:, None] + a[:, :, None]).max(axis=0), s[t], out=best[t])
        y = np.empty(s.shape[::2], np.int8)
        y[-1] = (best[-1] + a[:, :1]).argmax(axis=0)
        for t in range(len(s) - 2, -1, -1):
            y[t] = (best[t] + a[:, y[t + 1]]).argmax(axis=0)
        rows = np.flatnonzero(y.any(axis=0))
        tags, own = y[:, rows].astype(np.int64), s[:, :, rows]
        gain = np.take_along_axis(own, tags[:, None], 1)[:, 0] - own[:, 0]
        return held[rows], tags.T, gain.T
