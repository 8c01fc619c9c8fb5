"""A stacked LSTM with a linear head in NumPy: forecasts, gradients, and random draws that depend on keys alone.

Names and order of the parameters, and of the gates (input, forget, cell, output), are those of the usual state dict, so
weights can be exchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

Weights = dict[str, np.ndarray]

# Fixed values of the splitmix64 generator.
_STEP, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _MIX_A
    z = (z ^ (z >> np.uint64(27))) * _MIX_B
    return z ^ (z >> np.uint64(31))


def draws(keys: np.ndarray | Sequence[int], n: int, *use: int | str) -> np.ndarray:
    """n uniform numbers in [0, 1) for each 64-bit key, which depend on the key and on `use` alone.

    use says what they are for: a seed, an epoch, a name. So they are equal however rows are dealt to partitions.
    """
    with np.errstate(over="ignore"):
        state = np.asarray(keys, np.int64).astype(np.uint64)
        for u in use:
            state = _mix(state + _STEP * np.uint64((zlib.crc32(u.encode()) if isinstance(u, str) else u) + 1 & 0xFFFFFFFFFFFFFFFF))
        z = _mix(state[:, None] + _STEP * np.arange(1, n + 1, dtype=np.uint64))
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


@dataclass(frozen=True)
class Shape:
    inputs: int = 6
    hidden: int = 64
    layers: int = 2
    steps: int = 16
    dropout: float = 0.1

    def parameters(self) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {}
        for k in range(self.layers):
            own = self.inputs if k == 0 else self.hidden
            out |= {f"lstm.weight_ih_l{k}": (4 * self.hidden, own), f"lstm.weight_hh_l{k}": (4 * self.hidden, self.hidden), f"lstm.bias_ih_l{k}": (4 * self.hidden,), f"lstm.bias_hh_l{k}": (4 * self.hidden,)}
        return out | {"fc.weight": (self.steps, self.hidden), "fc.bias": (self.steps,)}

    def flat(self, weights: Weights) -> np.ndarray:
        return np.concatenate([weights[n].reshape(-1) for n in self.parameters()])

    def named(self, flat: np.ndarray) -> Weights:
        out, at = {}, 0
        for name, size in self.parameters().items():
            n = int(np.prod(size))
            out[name] = flat[at : at + n].reshape(size)
            at += n
        if at != len(flat):
            raise ValueError(f"{len(flat)} numbers for a model of {at}")
        return out

    def initial(self, seed: int) -> Weights:
        """Uniform within 1 / sqrt(hidden), drawn by seed and name."""
        most = 1 / np.sqrt(self.hidden)
        return {n: (draws([0], int(np.prod(s)), seed, n)[0] * 2 - 1).reshape(s) * most for n, s in self.parameters().items()}

    def masks(self, keys: np.ndarray, length: int, *use: int | str) -> list[np.ndarray]:
        """What dropout leaves of each layer's output but the last's, scaled up, for the windows of these keys."""
        if not self.dropout or self.layers < 2:
            return []
        kept = [draws(keys, length * self.hidden, *use, f"dropout{k}") >= self.dropout for k in range(self.layers - 1)]
        return [m.reshape(len(keys), length, self.hidden) / (1 - self.dropout) for m in kept]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _layer(w: Weights, k: int, x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """The outputs (windows, steps, hidden) of layer k, and for each step what its gradient needs."""
    u = w[f"lstm.weight_hh_l{k}"].T
    given = x @ w[f"lstm.weight_ih_l{k}"].T + (w[f"lstm.bias_ih_l{k}"] + w[f"lstm.bias_hh_l{k}"])
    n = u.shape[0]
    h = c = np.zeros((len(x), n))
    tape, out = [], np.empty((len(x), x.shape[1], n))
    for t in range(x.shape[1]):
        z = given[:, t] + h @ u
        gates = _sigmoid(z[:, : 2 * n])
        i, f, g, o = gates[:, :n], gates[:, n:], np.tanh(z[:, 2 * n : 3 * n]), _sigmoid(z[:, 3 * n :])
        before, was = c, h
        c = f * c + i * g
        tanh = np.tanh(c)
        h = o * tanh
        out[:, t] = h
        tape.append((i, f, g, o, before, tanh, was))
    return out, tape


def predict(shape: Shape, w: Weights, x: np.ndarray) -> np.ndarray:
    """Forecasts (windows, steps) from inputs (windows, length, inputs); each window's is its own."""
    h = x
    for k in range(shape.layers):
        h, _ = _layer(w, k, h)
    return h[:, -1] @ w["fc.weight"].T + w["fc.bias"]


def gradient(shape: Shape, w: Weights, x: np.ndarray, y: np.ndarray, masks: Sequence[np.ndarray] = ()) -> tuple[float, Weights]:
    """The sum of squared errors over windows and steps, and its gradient by backpropagation through time."""
    inputs, tapes, h = [], [], x
    for k in range(shape.layers):
        if k and masks:
            h = h * masks[k - 1]
        inputs.append(h)
        h, tape = _layer(w, k, h)
        tapes.append(tape)
    error = h[:, -1] @ w["fc.weight"].T + w["fc.bias"] - y
    d = 2 * error
    out: Weights = {"fc.weight": d.T @ h[:, -1], "fc.bias": d.sum(0)}
    above = np.zeros_like(h)
    above[:, -1] = d @ w["fc.weight"]
    for k in reversed(range(shape.layers)):
        own, u = inputs[k], w[f"lstm.weight_hh_l{k}"]
        dz = np.empty((len(x), x.shape[1], 4 * shape.hidden))
        dw = np.zeros_like(u)
        dh = dc = np.zeros((len(x), shape.hidden))
        for t in reversed(range(x.shape[1])):
            i, f, g, o, before, tanh, was = tapes[k][t]
            dh = dh + above[:, t]
            dc = dc + dh * o * (1 - tanh * tanh)
            dz[:, t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dc * i * (1 - g * g), dh * tanh * o * (1 - o)], 1)
            dw += dz[:, t].T @ was
            dh, dc = dz[:, t] @ u, dc * f
        flat = dz.reshape(-1, dz.shape[2])
        bias = flat.sum(0)
        out |= {f"lstm.weight_ih_l{k}": flat.T @ own.reshape(-1, own.shape[2]), f"lstm.weight_hh_l{k}": dw, f"lstm.bias_ih_l{k}": bias, f"lstm.bias_hh_l{k}": bias}
        if k:
            above = dz @ w[f"lstm.weight_ih_l{k}"]
            if masks:
                above = above * masks[k - 1]
    return float((error * error).sum()), out
