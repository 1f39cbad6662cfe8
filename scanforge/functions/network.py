"""A small network over a masked sequence and further values, with its gradient, in numpy. Knows nothing of Spark.

Convolutions keep the length. Masked positions are 0 before and after each of them and don't count in the
mean over positions; the mean and the further values then go through dense layers to one output.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: What a position of a peptide can hold; ``o`` and ``a`` stand for oxidation and acetyl.
RESIDUE_CODES = "ACDEFGHIKLMNPQRSTVWYoa"


@dataclass(frozen=True)
class Shape:
    """``convs``: (filters, kernel) of each; ``dense``: units of each; ``loss``: ``logistic`` or ``squared``."""

    length: int
    channels: int = 1
    convs: tuple[tuple[int, int], ...] = ((16, 5), (16, 5))
    extra: int = 0
    dense: tuple[int, ...] = (16,)
    loss: str = "logistic"
    l2: float = 0.0
    dropout: float = 0.0
    fill: float = -1.0

    def __post_init__(self):
        if self.loss not in ("logistic", "squared"):
            raise ValueError(f"unknown loss {self.loss}")
        if not self.convs and not self.extra:
            raise ValueError("a network needs convolutions or further values")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout lies in [0, 1)")

    def layers(self) -> list[tuple[str, tuple[int, ...]]]:
        """Name and shape of each parameter, weights and bias of a layer one after the other."""
        out, width = [], self.channels
        for i, (filters, kernel) in enumerate(self.convs, 1):
            out += [(f"conv{i}", (kernel * width, filters)), (f"conv{i}", (filters,))]
            width = filters
        width = (width if self.convs else 0) + self.extra
        for i, units in enumerate(self.dense, 1):
            out += [(f"dense{i}", (width, units)), (f"dense{i}", (units,))]
            width = units
        return [*out, ("out", (width, 1)), ("out", (1,))]

    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.layers())

    def unpack(self, flat: np.ndarray) -> list[np.ndarray]:
        parts, at = [], 0
        for _, shape in self.layers():
            n = int(np.prod(shape))
            parts.append(flat[at : at + n].reshape(shape))
            at += n
        return parts

    def start(self, seed: int = 0, bias: float = 0.0) -> np.ndarray:
        """Random weights of variance 2 / inputs, no biases but the output's."""
        rng, parts = np.random.default_rng(seed), []
        for _, shape in self.layers():
            parts.append(rng.normal(0, np.sqrt(2 / shape[0]), shape).ravel() if len(shape) == 2 else np.zeros(shape))
        parts[-1][:] = bias
        return np.concatenate(parts)

    def free(self, frozen: tuple[str, ...]) -> np.ndarray:
        """1 for the parameters of layers that may move; ``conv`` and ``dense`` name all of their kind."""
        known = {name for name, _ in self.layers()}
        for f in frozen:
            if not any(name.startswith(f) for name in known):
                raise ValueError(f"no layer {f}")
        return np.concatenate([np.full(int(np.prod(s)), not any(name.startswith(f) for f in frozen), float) for name, s in self.layers()])

    def penalty(self, flat: np.ndarray) -> tuple[float, np.ndarray]:
        """Squared weights of the dense layers times ``l2``, and its gradient."""
        on = np.concatenate([np.full(int(np.prod(s)), name.startswith("dense") and len(s) == 2, float) for name, s in self.layers()])
        return self.l2 * float((on * flat * flat).sum()), 2 * self.l2 * on * flat


def encode_arrays(shape: Shape, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``channels * length`` values, channel after channel, as positions x channels; a position is masked where the first channel holds ``fill`` or nothing."""
    x = x.reshape(len(x), shape.channels, shape.length).transpose(0, 2, 1)
    mask = np.isfinite(x[:, :, 0]) & (x[:, :, 0] != shape.fill)
    return np.where(mask[:, :, None], np.nan_to_num(x), 0.0), mask


def encode_residues(shape: Shape, sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One channel for each residue or modification, one position for each residue; what is longer than ``length`` is an error."""
    x = np.zeros((len(sequences), shape.length, len(RESIDUE_CODES)))
    mask = np.zeros((len(sequences), shape.length), bool)
    code = {c: i for i, c in enumerate(RESIDUE_CODES)}
    for row, s in enumerate(sequences):
        place = 0
        for c in s.strip("_").replace("(ox)", "o").replace("(ac)", "a"):
            if c.isupper():
                if place >= shape.length:
                    raise ValueError(f"a sequence is longer than {shape.length}")
                mask[row, place] = True
                place += 1
            # A modification belongs to the residue before it, or to the first one.
            x[row, max(place - 1, 0), code[c]] = 1
    return x, mask


def _windows(h: np.ndarray, kernel: int) -> np.ndarray:
    before = (kernel - 1) // 2
    padded = np.pad(h, ((0, 0), (before, kernel - 1 - before), (0, 0)))
    seen = np.lib.stride_tricks.sliding_window_view(padded, kernel, axis=1)
    return seen.transpose(0, 1, 3, 2).reshape(h.shape[0], h.shape[1], kernel * h.shape[2])


def forward(shape: Shape, flat: np.ndarray, x: np.ndarray, mask: np.ndarray, extra: np.ndarray, rng=None) -> tuple[np.ndarray, list]:
    """Outputs before the link, and what the gradient needs. ``rng`` turns dropout on."""
    p, kept = shape.unpack(flat), []
    h, at = x, 0
    for _, kernel in shape.convs:
        seen = _windows(h, kernel)
        h = np.maximum(seen @ p[at] + p[at + 1], 0) * mask[:, :, None]
        kept.append((seen, h))
        at += 2
    count = np.maximum(mask.sum(axis=1), 1)[:, None]
    z = np.concatenate([h.sum(axis=1) / count, extra], axis=1) if shape.convs else extra
    kept.append((z, None))
    for _ in shape.dense:
        z = np.maximum(z @ p[at] + p[at + 1], 0)
        kept.append((z, None))
        at += 2
    if rng is not None and shape.dropout:
        drop = (rng.random(z.shape) >= shape.dropout) / (1 - shape.dropout)
        kept.append((z * drop, drop))
    return (kept[-1][0] @ p[at] + p[at + 1])[:, 0], kept


def predict(shape: Shape, flat: np.ndarray, x: np.ndarray, mask: np.ndarray, extra: np.ndarray) -> np.ndarray:
    out, _ = forward(shape, flat, x, mask, extra)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500))) if shape.loss == "logistic" else out


def loss_and_gradient(shape: Shape, flat: np.ndarray, x: np.ndarray, mask: np.ndarray, extra: np.ndarray, y: np.ndarray, w: np.ndarray, rng=None) -> tuple[float, np.ndarray]:
    """Weighted sums, over the rows, of the loss and of its gradient by all parameters."""
    p = shape.unpack(flat)
    out, kept = forward(shape, flat, x, mask, extra, rng)
    if shape.loss == "logistic":
        loss = np.logaddexp(0, out) - y * out
        slope = 1 / (1 + np.exp(-np.clip(out, -500, 500))) - y
    else:
        loss, slope = (out - y) ** 2 / 2, out - y
    g, at = [None] * len(p), len(p) - 2
    d = (w * slope)[:, None]
    dropped = kept.pop() if kept[-1][1] is not None and kept[-1][1].ndim == 2 else None
    last = dropped[0] if dropped else kept[-1][0]
    g[at], g[at + 1] = last.T @ d, d.sum(axis=0)
    d = d @ p[at].T
    if dropped:
        d = d * dropped[1]
    for _ in shape.dense:
        at -= 2
        z = kept.pop()[0]
        d = d * (z > 0)
        g[at], g[at + 1] = kept[-1][0].T @ d, d.sum(axis=0)
        d = d @ p[at].T
    if shape.convs:
        count = np.maximum(mask.sum(axis=1), 1)[:, None]
        kept.pop()
        d = np.broadcast_to((d[:, : shape.convs[-1][0]] / count)[:, None, :], (*mask.shape, shape.convs[-1][0]))
        for _, kernel in reversed(shape.convs):
            at -= 2
            seen, h = kept.pop()
            d = d * (h > 0)
            g[at] = seen.reshape(-1, seen.shape[2]).T @ d.reshape(-1, d.shape[2])
            g[at + 1] = d.sum(axis=(0, 1))
            if at:
                back = (d @ p[at].T).reshape(*mask.shape, kernel, -1)
                before, length = (kernel - 1) // 2, mask.shape[1]
                padded = np.zeros((len(mask), length + kernel - 1, back.shape[3]))
                for k in range(kernel):
                    padded[:, k : k + length] += back[:, :, k]
                d = padded[:, before : before + length] * mask[:, :, None]
    return float((w * loss).sum()), np.concatenate([x.ravel() for x in g])


class Adam:
    """Steps along the gradient's running mean over the root of its running square."""

    def __init__(self, size: int, rate: float):
        self.rate, self.t = rate, 0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.999 * self.square + 0.001 * gradient * gradient
        return -self.rate * (self.mean / (1 - 0.9**self.t)) / (np.sqrt(self.square / (1 - 0.999**self.t)) + 1e-8)
