"""Scoring of patches by a small integer network, given as a list of layers. No weights are shipped.

A layer has a kind (conv, depthwise, mean, dense), weights of 8 bits, a bias of 32 bits, and
the float factor that brings its sums back to 8 bits. Sums are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Layer:
    kind: str
    weights: np.ndarray | None = None  # conv: out, h, w, in; depthwise: h, w, channels; dense: out, in
    bias: np.ndarray | None = None
    factor: float = 1.0
    stride: int = 1
    relu: bool = True


def windows(x: np.ndarray, h: int, w: int, stride: int) -> np.ndarray:
    """Patches around every stride-th place, zeros outside: batch, rows, columns, h, w, channels."""
    rows, columns = -(-x.shape[1] // stride), -(-x.shape[2] // stride)
    ph, pw = max(0, (rows - 1) * stride + h - x.shape[1]), max(0, (columns - 1) * stride + w - x.shape[2])
    x = np.pad(x, ((0, 0), (ph // 2, ph - ph // 2), (pw // 2, pw - pw // 2), (0, 0)))
    view = np.lib.stride_tricks.sliding_window_view(x, (h, w), (1, 2))[:, ::stride, ::stride]
    return view.transpose(0, 1, 2, 4, 5, 3)


def narrowed(sums: np.ndarray, layer: Layer) -> np.ndarray:
    """Sums scaled to 8 bits, rounded half up, negatives cut where the layer says so."""
    y = np.floor((sums + (0 if layer.bias is None else layer.bias)) * layer.factor + 0.5).astype(np.int64)
    return np.clip(y, 0 if layer.relu else -128, 127)


def run(x: np.ndarray, layers: Sequence[Layer]) -> np.ndarray:
    """Shares in 1/256 of a batch of patches (n, rows, bands), from the last layer by softmax."""
    x = x.astype(np.int64)[..., None]
    for layer in layers:
        if layer.kind == "conv":
            out, h, w, _ = layer.weights.shape
            x = narrowed(np.einsum("nrchwi,ohwi->nrco", windows(x, h, w, layer.stride), layer.weights.astype(np.int64), optimize=True), layer)
        elif layer.kind == "depthwise":
            h, w, _ = layer.weights.shape
            x = narrowed(np.einsum("nrchwi,hwi->nrci", windows(x, h, w, layer.stride), layer.weights.astype(np.int64), optimize=True), layer)
        elif layer.kind == "mean":
            x = np.floor(x.mean(axis=(1, 2)) + 0.5).astype(np.int64)
        elif layer.kind == "dense":
            x = x.reshape(len(x), -1) @ layer.weights.astype(np.int64).T + (0 if layer.bias is None else layer.bias)
        else:
            raise ValueError(layer.kind)
    e = np.exp((x - x.max(axis=1, keepdims=True)) * layers[-1].factor)
    return np.minimum(255, np.floor(e / e.sum(axis=1, keepdims=True) * 256 + 0.5)).astype(np.int64)


def scored(patches: DataFrame, layers: Sequence[Layer], rows: int = 80, bands: int = 26) -> DataFrame:
    """utt_id, q of patches (utt_id, patch of rows * bands signed bytes): counts of 256 for each class, in Arrow batches."""
    kind = dict(patches.dtypes)["utt_id"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack([np.frombuffer(bytes(p), np.int8).reshape(rows, bands) for p in b["patch"]])
                yield pd.DataFrame({"utt_id": b["utt_id"], "q": [r.astype(np.int32) for r in run(x, layers)]})

    return patches.select("utt_id", "patch").mapInPandas(each, f"utt_id {kind}, q array<int>")
