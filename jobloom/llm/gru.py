"""A bidirectional gated recurrent network over bytes, in numpy.

Gates and candidates use x / (1 + |x|), scaled for gates, in place of the logistic function
and the hyperbolic tangent: it is trained and applied the same way, and costs less.
"""

from __future__ import annotations

import numpy as np

PAD = 256
#: Each class of bytes that letters are made of: A-Z, a-z, and all of a letter's bytes beyond ASCII.
_LETTER = np.zeros(257, np.float32)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = 1


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


class Network:
    """Labels every byte of windows of bytes with language probabilities."""

    def __init__(self, languages: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = hidden
        near = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.hidden = h
        self.typical = 1 / languages  # the right language's probability in the last epoch, a geometric mean
        # for each direction: what a byte adds to update gate, reset gate and candidate; and the state's weights
        self.p = {f"{d}{k}": v for d in "fb" for k, v in (("x", near(257, 3 * h)), ("g", near(h, 2 * h)), ("c", near(h, h)))}
        self.p |= {"o": near(2 * h, languages), "ob": np.zeros(languages, np.float32)}
        self._close()

    def _close(self) -> None:
        for d in "fb":  # padding leaves the state as it is
            self.p[f"{d}x"][PAD] = 0
            self.p[f"{d}x"][PAD, : self.hidden] = -1e9

    def _run(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each byte of x (time, window), read onward ("f") or backward ("b")."""
        h, (wx, wg, wc) = self.hidden, (self.p[d + k] for k in "xgc")
        steps, n = x.shape
        states, tape = np.empty((steps, n, h), np.float32), []
        now = np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            add = wx[x[t]]
            gates = now @ wg
            gates += add[:, : 2 * h]
            _soft(gates)
            kept = gates.copy() if keep else None
            gates *= 0.5
            gates += 0.5
            update, reset = gates[:, :h], gates[:, h:]
            reset = reset * now
            candidate = reset @ wc
            candidate += add[:, 2 * h :]
            _soft(candidate)
            if keep:
                tape.append((t, now, kept, update.copy(), reset, candidate))
            step = states[t]
            np.subtract(candidate, now, out=step)
            step *= update
            step += now
            now = step
        return states, tape

    def _logits(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        h = self.hidden
        out = forward @ self.p["o"][:h]
        out += backward @ self.p["o"][h:]
        out += self.p["ob"]
        return out

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities at each byte of x (time, window)."""
        out = self._logits(self._run("f", x, False)[0], self._run("b", x, False)[0])
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        return out

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: the sum of probabilities over its letters' bytes, and how many those are."""
        weight = _LETTER[x]
        return np.einsum("tnl,tn->nl", self.position_probabilities(x), weight, optimize=False), weight.sum(axis=0)

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the letters' bytes, and its gradients by backpropagation through time."""
        h = self.hidden
        states = {d: self._run(d, x, True) for d in "fb"}
        out = self._logits(states["f"][0], states["b"][0])
        out -= out.max(axis=2, keepdims=True)
        p = np.exp(out)
        p /= p.sum(axis=2, keepdims=True)
        weight = _LETTER[x]
        weight = weight / max(1.0, float(weight.sum()))
        loss = -float((np.log(np.maximum(np.take_along_axis(p, label[None, :, None], 2)[..., 0], 1e-12)) * weight).sum())
        dl = p
        np.put_along_axis(dl, np.broadcast_to(label[None, :, None], (*x.shape, 1)), np.take_along_axis(p, label[None, :, None], 2) - 1, 2)
        dl *= weight[..., None]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["ob"] = dl.sum(axis=(0, 1))
        flat = dl.reshape(-1, dl.shape[2])
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            run, tape = states[d]
            g["o"][part] = run.reshape(-1, h).T @ flat
            from_output = dl @ self.p["o"][part].T
            wg, wc = self.p[d + "g"], self.p[d + "c"]
            carried = np.zeros(run.shape[1:], np.float32)
            for t, before, gates, update, reset, candidate in reversed(tape):
                dh = carried + from_output[t]
                dc = dh * update * (1 - np.abs(candidate)) ** 2
                dreset = dc @ wc.T
                opened = 0.5 + 0.5 * gates[:, h:]
                dgates = np.concatenate([dh * (candidate - before), dreset * before], axis=1)
                dgates *= 0.5 * (1 - np.abs(gates)) ** 2
                g[d + "g"] += before.T @ dgates
                g[d + "c"] += reset.T @ dc
                np.add.at(g[d + "x"], x[t], np.concatenate([dgates, dc], axis=1))
                carried = dh * (1 - update) + dreset * opened + dgates @ wg.T
        for d in "fb":
            g[d + "x"][PAD] = 0
        return loss, g

    def fit(self, x: np.ndarray, label: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 7) -> list[float]:
        """Trains on windows x (time, window) by Adam; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step, losses = 0, []
        for epoch in range(epochs):
            order, seen = rng.permutation(x.shape[1]), []
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                loss, g = self.gradients(x[:, some], label[some])
                seen.append(loss)
                step += 1
                now = rate * 0.6**epoch
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for k, a in g.items():
                    a *= min(1.0, 1.0 / max(norm, 1e-12))
                    m[k] += 0.1 * (a - m[k])
                    v[k] += 0.01 * (a * a - v[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                self._close()
            losses.append(float(np.mean(seen)))
            self.typical = float(np.exp(-losses[-1]))
        return losses
