"""Seeded augmentation of recordings: gain, tilt, noise, silence, jitter, masks and shifts."""

from __future__ import annotations

import hashlib

import numpy as np


def source(*key) -> np.random.Generator:
    """Random numbers by key, the same in every task and run."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "little"))


def level(x: np.ndarray) -> float:
    """Mean magnitude in decibels below full scale; -120 for silence."""
    mean = float(np.abs(x).mean()) if len(x) else 0.0
    return 20 * np.log10(mean / 32768) if mean > 0 else -120.0


def snr_db(clean: np.ndarray, other: np.ndarray) -> float:
    """Signal to noise of what a round trip left; infinite without any."""
    noise, signal = ((clean.astype(float) - other) ** 2).sum(), (clean.astype(float) ** 2).sum()
    return float("inf") if not noise else float("-inf") if not signal else float(10 * np.log10(signal / noise))


def channel(x: np.ndarray, *key, gain_db: float = 0.0, tilt: float = 0.0, snr: float | None = None, lead: int = 0, tail: int = 0) -> np.ndarray:
    """x with a gain, a one-pole tilt, silence around it, and noise at a ratio below its level; clipped to 16 bits."""
    y = x.astype(np.float64) * 10 ** (gain_db / 20)
    y = y - tilt * np.concatenate([y[:1], y[:-1]]) if len(y) else y
    y = np.concatenate([np.zeros(lead), y, np.zeros(tail)])
    if snr is not None and len(y):
        y = y + source(*key).normal(0, max(np.sqrt((y**2).mean()), 1e-9) * 10 ** (-snr / 20), len(y))
    return np.clip(np.rint(y), -32768, 32767).astype(np.int16)


def jittered(start: int, stop: int, length: int, *key, most: int = 480, step: int = 160) -> tuple[int, int]:
    """Endpoints moved by up to most samples in whole steps, inside the recording."""
    a, b = source(*key).integers(-(most // step), most // step + 1, 2) * step
    return int(max(0, start + a)), int(min(length, stop + b))


def masked(patch: np.ndarray, *key, bands: int = 4, frames: int = 12) -> np.ndarray:
    """A patch with one run of bands and one of frames set to 0."""
    rng, out = source(*key), patch.copy()
    w, h = rng.integers(0, bands + 1), rng.integers(0, frames + 1)
    i, j = rng.integers(0, out.shape[1] - w + 1), rng.integers(0, out.shape[0] - h + 1)
    out[:, i : i + w] = 0
    out[j : j + h] = 0
    return out


def shifted(patch: np.ndarray, by: int) -> np.ndarray:
    """A patch moved by frames, with zeros where none come."""
    out = np.zeros_like(patch)
    out[max(0, by) : len(patch) + min(0, by)] = patch[max(0, -by) : len(patch) - max(0, by)]
    return out


def trimmed(x: np.ndarray, floor: int, pad: int) -> np.ndarray:
    """x from pad samples before the first that reaches the floor up to pad after the last one."""
    loud = np.flatnonzero(np.abs(x.astype(np.int64)) >= floor)
    return x[max(0, loud[0] - pad) : loud[-1] + pad] if len(loud) else x[:0]


def peaked(x: np.ndarray, peak: int = 29_491) -> np.ndarray:
    """x scaled to a peak, truncated toward zero; silence stays."""
    top = int(np.abs(x.astype(np.int64)).max(initial=0))
    return np.trunc(x * (peak / top)).astype(np.int16) if top else x


def faded(x: np.ndarray, n: int) -> np.ndarray:
    """x with linear ramps of n samples at both ends."""
    ramp = np.ones(len(x))
    n = min(n, len(x) // 2)
    if n:
        ramp[:n], ramp[len(x) - n :] = np.arange(n) / n, np.arange(n)[::-1] / n
    return np.rint(x * ramp).astype(np.int16)


def spliced(parts: list[np.ndarray], overlap: int) -> tuple[np.ndarray, list[int]]:
    """Parts joined with linear crossfades, and where each begins."""
    out, starts = np.zeros(0), []
    for p in parts:
        n = min(overlap, len(out), len(p))
        starts.append(len(out) - n)
        up = np.arange(n) / max(n, 1)
        out = np.concatenate([out[: len(out) - n], out[len(out) - n :] * (1 - up) + p[:n] * up, p[n:]])
    return np.rint(out).astype(np.int16), starts
