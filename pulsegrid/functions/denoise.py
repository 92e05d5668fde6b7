"""The neural denoiser: a dense encoder and decoder over stretches of ten seconds at 500 Hz, in NumPy, for inference only.

Weights are a file of arrays (``.npz``) named as in the network's state: a state saved by another framework can be written as
such a file unchanged (names of older states are understood). None come with this package, as none are public; with
:func:`random_weights` the whole path can be run and tested.

A trunk is a first convolution and dense blocks with a transition between each two. In a dense block every layer sees what all
before it gave. A transition of the encoder compresses and strides; one of the decoder compresses and spreads.

Defined results: null and empty leads stay null; other rates are resampled there and back, so a length may change by rounding.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column

from pulsegrid.functions import kernels

RATE, STRETCH, BATCH = 500, 5000, 32
# Layers of a dense block, channels a layer adds, strides of the encoder and spreads of the decoder, channels between them.
LAYERS, GROWTH, DOWN, UP, LATENT = 8, 12, (2, 2, 2, 5), (5, 2, 2, 2), 8
HEADS = ("_signal_output", "_baseline_output")

Weights = dict[str, np.ndarray]


def convolve(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, stride: int = 1) -> np.ndarray:
    """(batch, channels, time) convolved with (out, in, width), padded by half the width."""
    half = weight.shape[2] // 2
    seen = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (half, half))), weight.shape[2], axis=2)[:, :, ::stride]
    flat = np.ascontiguousarray(seen.transpose(0, 2, 1, 3)).reshape(len(x), seen.shape[2], -1)
    return (flat @ weight.reshape(len(weight), -1).T + bias).transpose(0, 2, 1)


def spread(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, factor: int) -> np.ndarray:
    """The transposed convolution that makes a series ``factor`` times as long; ``weight`` is (in, out, width)."""
    n, width = x.shape[2], weight.shape[2]
    out = np.zeros((len(x), weight.shape[1], n * factor + width))
    for k in range(width):
        out[:, :, k : k + n * factor : factor] += np.einsum("bit,io->bot", x, weight[:, :, k])
    half = width // 2
    return out[:, :, half : half + n * factor] + bias[:, None]


def elu(x: np.ndarray, alpha: float) -> np.ndarray:
    return np.where(x > 0, x, alpha * np.expm1(np.minimum(x, 0)))


class Network:
    """The forward pass over named weights."""

    def __init__(self, weights: Weights) -> None:
        self.w = {current_name(k): np.asarray(v, float) for k, v in weights.items()}
        missing = [name for name, shape in layout() if name not in self.w or self.w[name].shape != shape]
        if missing:
            raise ValueError(f"weights lack or misshape {len(missing)} arrays, the first being {missing[0]}")

    def _normed(self, x: np.ndarray, name: str, alpha: float) -> np.ndarray:
        scale = self.w[f"{name}.weight"] / np.sqrt(self.w[f"{name}.running_var"] + 1e-5)
        return elu((x - self.w[f"{name}.running_mean"][:, None]) * scale[:, None] + self.w[f"{name}.bias"][:, None], alpha)

    def _unit(self, x: np.ndarray, name: str, alpha: float = 0.1, stride: int = 1) -> np.ndarray:
        """Convolution, normalisation and activation."""
        y = convolve(x, self.w[f"{name}._layers.0.weight"], self.w[f"{name}._layers.0.bias"], stride)
        return self._normed(y, f"{name}._layers.1", alpha)

    def _trunk(self, x: np.ndarray, name: str, steps: tuple[int, ...], down: bool) -> np.ndarray:
        x = self._unit(x, f"{name}._initial_layer")
        for b in range(len(steps) + 1):
            for k in range(LAYERS):
                x = np.concatenate([x, self._unit(x, f"{name}._blocks.{2 * b}.DenseLayer_{k}")], axis=1)
            if b < len(steps):
                at = f"{name}._blocks.{2 * b + 1}"
                x = self._unit(x, f"{at}.compression_block")
                if down:
                    x = self._unit(x, f"{at}.pooling_layer", stride=steps[b])
                else:
                    x = spread(x, self.w[f"{at}.deconvolution_layer.0.weight"], self.w[f"{at}.deconvolution_layer.0.bias"], steps[b])
                    x = self._normed(x, f"{at}.deconvolution_layer.1", 0.1)
        return x

    def __call__(self, x: np.ndarray, heads: tuple[str, ...] = HEADS) -> list[np.ndarray]:
        """The heads' outputs (signal, baseline) of stretches (batch, time)."""
        latent = self._unit(self._trunk(x[:, None], "_encoder._trunk", DOWN, True), "_encoder._latent_conv")
        seen = self._trunk(latent, "_decoder._trunk", UP, False)
        out = []
        for head in heads:
            y = self._unit(self._unit(seen, f"_decoder.{head}.0", 1.0), f"_decoder.{head}.1", 1.0)
            out.append(convolve(y, self.w[f"_decoder.{head}.2.weight"], self.w[f"_decoder.{head}.2.bias"])[:, 0])
        return out


def layout() -> Iterator[tuple[str, tuple[int, ...]]]:
    """(name, shape) of all arrays of the network."""

    def norm(name: str, n: int) -> Iterator[tuple[str, tuple[int, ...]]]:
        yield from ((f"{name}.{part}", (n,)) for part in ("weight", "bias", "running_mean", "running_var"))

    def unit(name: str, inner: int, outer: int, width: int = 3) -> Iterator[tuple[str, tuple[int, ...]]]:
        yield f"{name}._layers.0.weight", (outer, inner, width)
        yield f"{name}._layers.0.bias", (outer,)
        yield from norm(f"{name}._layers.1", outer)

    def trunk(name: str, inner: int, steps: tuple[int, ...], down: bool):  # noqa: ANN202
        first = own = 2 * GROWTH
        yield from unit(f"{name}._initial_layer", inner, first)
        for b in range(len(steps) + 1):
            for k in range(LAYERS):
                yield from unit(f"{name}._blocks.{2 * b}.DenseLayer_{k}", own, first + k * GROWTH)
                own += first + k * GROWTH
            first = GROWTH * LAYERS
            if b < len(steps):
                at = f"{name}._blocks.{2 * b + 1}"
                yield from unit(f"{at}.compression_block", own, first, 1)
                if down:
                    yield from unit(f"{at}.pooling_layer", first, first)
                else:
                    yield f"{at}.deconvolution_layer.0.weight", (first, 1, 3)
                    yield f"{at}.deconvolution_layer.0.bias", (1,)
                    yield from norm(f"{at}.deconvolution_layer.1", 1)
                own = first if down else 1
        return own

    seen = yield from trunk("_encoder._trunk", 1, DOWN, True)
    yield from unit("_encoder._latent_conv", seen, LATENT)
    seen = yield from trunk("_decoder._trunk", LATENT, UP, False)
    for head in HEADS:
        yield from unit(f"_decoder.{head}.0", seen, 32)
        yield from unit(f"_decoder.{head}.1", 32, 16)
        yield f"_decoder.{head}.2.weight", (1, 16, 3)
        yield f"_decoder.{head}.2.bias", (1,)


def random_weights(seed: int = 0) -> Weights:
    """Weights of the right names and shapes, small and untrained."""
    rng = np.random.default_rng(seed)
    draw = lambda name, shape: np.ones(shape) if name.endswith("running_var") else rng.normal(0, 1 / np.sqrt(np.prod(shape[1:]) or 1), shape)
    return {name: draw(name, shape) for name, shape in layout()}


def current_name(name: str) -> str:
    """A name of an older state as it is now: no wrapper, no mangled classes, blocks by number."""
    name = re.sub(r"_[A-Z]\w*?__", "_", name.removeprefix("module.")).replace("._dense_trunk.", "._trunk.")
    return re.sub(r"(Dense|Transition)Block_(\d+)", lambda m: f"_blocks.{2 * int(m[2]) + (m[1] == 'Transition')}", name)


def denoised(leads: np.ndarray, rate: int, network: Callable[..., list[np.ndarray]]) -> np.ndarray:
    """The denoised rows: cut into stretches, the last filled with zeros, and put together again."""
    x = kernels.resample(leads, rate, RATE) if rate != RATE else leads
    rows, n = x.shape
    count = -(-n // STRETCH)
    padded = np.zeros((rows, count * STRETCH))
    padded[:, :n] = x
    stretches = padded.reshape(rows * count, STRETCH)
    out = np.concatenate([network(stretches[k : k + BATCH], HEADS[:1])[0] for k in range(0, len(stretches), BATCH)])
    out = out.reshape(rows, count * STRETCH)[:, :n]
    return kernels.resample(out, RATE, rate) if rate != RATE else out


@functools.lru_cache(maxsize=1)
def load(path: str) -> Network:
    """The network of a file of weights, kept by each worker."""
    with np.load(path) as held:
        return Network(dict(held))


def denoise(samples: Column, fs: Column, weights: str | None) -> Column:
    """The denoised leads by the network whose weights lie at a path all executors can read."""
    from pulsegrid.functions.arrow import _udf

    if not weights:
        raise ValueError("the neural denoiser needs the path of its weights; none come with this package")
    return _udf(lambda m, f: denoised(m, f, load(weights)), "array<double>")(samples, fs)
