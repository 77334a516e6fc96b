"""The character classifier's forward pass: four 3 x 3 convolutions, two poolings, two dense layers."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: The shapes of the network's weights, layer by layer; inputs are 28 x 28, outputs 94 classes.
LAYERS = [("conv1", (3, 3, 1, 32)), ("conv2", (3, 3, 32, 32)), ("conv3", (3, 3, 32, 64)), ("conv4", (3, 3, 64, 64)), ("dense1", (1024, 256)), ("dense2", (256, 94))]
SIDE, CLASSES = 28, 94


def parameter_count() -> int:
    return sum(int(np.prod(shape)) + shape[-1] for _, shape in LAYERS)


def random_weights(seed: int = 0) -> dict[str, np.ndarray]:
    """Weights of the right shapes, for tests: {name: kernel, name_bias: bias}."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in LAYERS:
        fan = int(np.prod(shape[:-1]))
        out[name] = (rng.standard_normal(shape) * np.sqrt(2 / fan)).astype(np.float32)
        out[f"{name}_bias"] = np.zeros(shape[-1], np.float32)
    return out


def _convolve(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A valid convolution of (n, height, width, channels) and a rectifier."""
    patches = sliding_window_view(x, kernel.shape[:2], axis=(1, 2))  # n, h, w, channels, 3, 3
    return np.maximum(np.tensordot(patches, kernel.transpose(2, 0, 1, 3), axes=3) + bias, 0)


def _pool(x: np.ndarray) -> np.ndarray:
    n, h, w, c = x.shape
    return x.reshape(n, h // 2, 2, w // 2, 2, c).max(axis=(2, 4))


#: So many pictures go through the layers at once: the patches of a convolution are up to 660 kB a picture.
AT_ONCE = 64


def forward(weights: dict[str, np.ndarray], pixels: np.ndarray) -> np.ndarray:
    """Class probabilities of rows of 784 pixels of 0 to 1."""
    if len(pixels) > AT_ONCE:
        return np.concatenate([forward(weights, pixels[k : k + AT_ONCE]) for k in range(0, len(pixels), AT_ONCE)])
    layer = lambda x, name: _convolve(x, weights[name], weights[f"{name}_bias"])
    x = np.asarray(pixels, np.float32).reshape(-1, SIDE, SIDE, 1)
    x = _pool(layer(layer(x, "conv1"), "conv2"))
    x = _pool(layer(layer(x, "conv3"), "conv4"))
    x = np.maximum(x.reshape(len(x), -1) @ weights["dense1"] + weights["dense1_bias"], 0)
    x = x @ weights["dense2"] + weights["dense2_bias"]
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
