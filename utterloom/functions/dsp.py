"""Integer speech features as numpy kernels over whole utterances, and their Spark wrappers.

All stages work on every frame of an utterance at once, in 64-bit integers. Shifts floor;
stages round half up, but for the pre-emphasis, which floors. 16 kHz mono, frames of 400 samples every 160.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RATE, FRAME, STRIDE, FFT, BANDS, CEPSTRA = 16_000, 400, 160, 512, 26, 12
LOW_HZ, HIGH_HZ, EMPHASIS = 100.0, 7600.0, 31_785  # emphasis in Q15
ROWS, SHIFT = 80, 4  # patch rows, and the shift from Q8 to 8 bits


def rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(x).astype(np.int64)


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Window, twiddles, filterbank, cosine rows and logarithms from their definitions, in fixed point."""
    n, k, i = np.arange(FRAME), np.arange(FFT // 2), np.arange(BANDS)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** ((mel(LOW_HZ) + (mel(HIGH_HZ) - mel(LOW_HZ)) * np.arange(BANDS + 2) / (BANDS + 1)) / 2595) - 1)
    hz = np.arange(FFT // 2 + 1) * RATE / FFT
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.clip(np.where(hz <= mid, (hz - low) / (mid - low), (high - hz) / (high - mid)), 0, 1)
    bits = FFT.bit_length() - 1
    return {
        "window": rounded((0.54 - 0.46 * np.cos(2 * np.pi * n / (FRAME - 1))) * 32767),
        "re": rounded(32767 * np.cos(2 * np.pi * k / FFT)),
        "im": rounded(-32767 * np.sin(2 * np.pi * k / FFT)),
        "bank": rounded(bank * 32768),
        "cos": rounded(32767 * np.cos(np.pi * np.arange(1, CEPSTRA + 1)[:, None] * (i + 0.5) / BANDS)),
        "log": rounded(256 * np.log2(1 + np.arange(65) / 64)),
        "order": np.array([int(f"{x:0{bits}b}"[::-1], 2) for x in range(FFT)]),
    }


def preemphasis(x: np.ndarray) -> np.ndarray:
    """x minus the coefficient times the sample before, which is floored; the first follows itself; clamped to 16 bits."""
    x = np.asarray(x, np.int64)
    before = np.concatenate([x[:1], x[:-1]])
    return np.clip(x - (before * EMPHASIS >> 15), -32768, 32767)


def framed(x: np.ndarray) -> np.ndarray:
    """Whole frames as rows."""
    n = 0 if len(x) < FRAME else 1 + (len(x) - FRAME) // STRIDE
    return np.asarray(x, np.int64)[np.arange(n)[:, None] * STRIDE + np.arange(FRAME)] if n else np.empty((0, FRAME), np.int64)


def length_of(x: np.ndarray) -> np.ndarray:
    """Bit lengths of numbers that aren't negative."""
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.int64)


def normalised(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windowed frames shifted left so that the peak has 15 bits, and the shifts."""
    x = frames * tables()["window"] + 16384 >> 15
    peak = np.abs(x).max(axis=1, initial=0)
    shift = np.where(peak > 0, np.maximum(15 - length_of(peak), 0), 0)
    return x << shift[:, None], shift


def fft(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point transform of rows of at most FFT samples, halved in each of its nine stages."""
    t = tables()
    re = np.zeros((len(x), FFT), np.int64)
    re[:, : x.shape[1]] = x
    re = re[:, t["order"]]
    im, half = np.zeros_like(re), 1
    while half < FFT:
        a, b = re.reshape(len(x), -1, 2, half), im.reshape(len(x), -1, 2, half)
        wr, wi = t["re"][:: FFT // (2 * half)], t["im"][:: FFT // (2 * half)]
        tr = wr * a[:, :, 1] - wi * b[:, :, 1] + 16384 >> 15
        ti = wr * b[:, :, 1] + wi * a[:, :, 1] + 16384 >> 15
        re = np.stack([a[:, :, 0] + tr + 1 >> 1, a[:, :, 0] - tr + 1 >> 1], 2).reshape(len(x), FFT)
        im = np.stack([b[:, :, 0] + ti + 1 >> 1, b[:, :, 0] - ti + 1 >> 1], 2).reshape(len(x), FFT)
        half *= 2
    return re, im


def isqrt(x: np.ndarray) -> np.ndarray:
    r = np.floor(np.sqrt(x.astype(np.float64))).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def magnitude(re: np.ndarray, im: np.ndarray) -> np.ndarray:
    """Rounded magnitudes of the bins up to half the rate."""
    p = (re * re + im * im)[:, : FFT // 2 + 1]
    r = isqrt(p)
    return r + (p - r * r > r)


def mel(bins: np.ndarray) -> np.ndarray:
    """Triangular bands; each product loses its last 8 bits before it is added."""
    bank = tables()["bank"]
    out = np.empty((len(bins), BANDS), np.int64)
    for i, w in enumerate(bank):
        k = np.flatnonzero(w)
        out[:, i] = (bins[:, k] * w[k] + 128 >> 8).sum(axis=1)
    return out


def log2_q8(x: np.ndarray) -> np.ndarray:
    """256 * log2, from 65 entries and linear interpolation; below 1 counts as 1."""
    x = np.maximum(x, 1)
    top = length_of(x) - 1
    scaled = np.where(top >= 16, x >> np.maximum(top - 16, 0), x << np.maximum(16 - top, 0))
    slot, part, log = (scaled >> 10) - 64, scaled & 1023, tables()["log"]
    return (top << 8) + log[slot] + ((log[slot + 1] - log[slot]) * part + 512 >> 10)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Log band energies of each frame in Q8, the shifts of all stages undone."""
    frames = framed(preemphasis(x))
    if not len(frames):
        return np.empty((0, BANDS), np.int64)
    rows, shift = normalised(frames)
    return log2_q8(mel(magnitude(*fft(rows)))) + (2 - shift << 8)[:, None]


def lifter(length: int = 0) -> np.ndarray:
    """Gains of the cepstra in Q12; 4096, which changes nothing, without a length."""
    j = np.arange(1, CEPSTRA + 1)
    return rounded(4096 * (1 + length / 2 * np.sin(np.pi * j / length))) if length else np.full(CEPSTRA, 4096)


def cepstra(logs: np.ndarray, length: int = 0) -> np.ndarray:
    """Cosine coefficients 1 to 12, liftered; each product is rounded before it is added."""
    return (logs[:, None, :] * tables()["cos"] + 16384 >> 15).sum(axis=2) * lifter(length) + 2048 >> 12


def without_mean(rows: np.ndarray) -> np.ndarray:
    """Column means, truncated toward zero, taken away."""
    total = rows.sum(axis=0)
    return rows - np.sign(total) * (np.abs(total) // max(len(rows), 1))


def deltas(rows: np.ndarray) -> np.ndarray:
    """Regression over two neighbours on each side, edges repeated, with 3277 for 1/10 in Q15."""
    p = np.concatenate([rows[:1].repeat(2, 0), rows, rows[-1:].repeat(2, 0)])
    n = len(rows)
    return ((p[3 : n + 3] - p[1 : n + 1]) + 2 * (p[4:] - p[:n])) * 3277 + 16384 >> 15


def features(x: np.ndarray) -> np.ndarray:
    """24 columns: mean-free cepstra in Q4, and their deltas in Q6, which brings them to a like size."""
    logs = log_mel(x)
    if not len(logs):
        return np.empty((0, 2 * CEPSTRA), np.int64)
    c = without_mean(cepstra(logs))
    return np.concatenate([c + 8 >> 4, deltas(c) + 2 >> 2], 1)


def patch(x: np.ndarray) -> tuple[np.ndarray, int, int]:
    """ROWS x BANDS of 8 bits, the number of frames, and how many values were clipped."""
    rows = log_mel(x)
    raw = without_mean(rows) + (1 << SHIFT - 1) >> SHIFT if len(rows) else rows
    q, n = np.clip(raw, -128, 127), len(rows)
    start = max(0, (n - ROWS) // 2)
    q = q[start : start + ROWS]
    before = (ROWS - len(q)) // 2
    return np.pad(q, ((before, ROWS - len(q) - before), (0, 0))).astype(np.int8), n, int((raw != np.clip(raw, -128, 127)).sum())


def float_log_mel(x: np.ndarray) -> np.ndarray:
    """The same bands in floating point, as the yardstick of the integer ones."""
    rows = framed(preemphasis(x)) * (tables()["window"] / 32767)
    bins = np.abs(np.fft.rfft(rows, FFT))
    return 256 * np.log2(np.maximum(bins @ (tables()["bank"] / 32768).T, 1e-9))


def pitch(x: np.ndarray, rate: int = RATE, low: int = 70, high: int = 400, loud: float = 2_000_000, clear: float = 0.3) -> float:
    """Middle pitch of the voiced frames of 40 ms every 20, by autocorrelation over every other sample; 0 for none."""
    x, window, hop, found = np.asarray(x, np.float64), int(0.04 * rate), int(0.02 * rate), []
    lags = np.arange(rate // high, rate // low)
    for start in range(0, max(0, len(x) - window), hop):
        f = x[start : start + window]
        power = float((f * f).sum())
        if power / window < loud:
            continue
        r = np.array([(f[: window - g : 2] * f[g::2][: len(f[: window - g : 2])]).sum() / (power * (window - g) / window + 1) for g in lags])
        if r.max() > clear:
            found.append(rate / lags[int(r.argmax())])
    return sorted(found)[len(found) // 2] if found else 0.0


# ---- Spark ------------------------------------------------------------------


def with_rows(utterances: DataFrame, kernel: Callable[[np.ndarray], np.ndarray] = features) -> DataFrame:
    """utt_id, frame_no, vec of utterances (utt_id, samples): the rows that a kernel makes; one utterance in memory at a time, in Arrow batches."""
    kind = dict(utterances.dtypes)["utt_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, x in zip(b["utt_id"], b["samples"]):
                rows = kernel(np.asarray(x if x is not None else [], np.int64))
                if len(rows):
                    yield pd.DataFrame({"utt_id": [key] * len(rows), "frame_no": np.arange(len(rows), dtype=np.int32), "vec": list(rows.astype(np.int32))})

    return utterances.select("utt_id", "samples").mapInPandas(run, f"utt_id {kind}, frame_no int, vec array<int>")


def with_features(utterances: DataFrame) -> DataFrame:
    """utt_id, frame_no, vec: the 24 features of each frame."""
    return with_rows(utterances, features)


def signal(n: int, seed: int = 12_345, rate: int = RATE) -> np.ndarray:
    """A test signal: tones of 320, 1180 and 2600 Hz under one swell, and noise from a congruential generator."""
    i, noise, state = np.arange(n), np.empty(n, np.int64), seed
    for k in range(n):
        state = (1_103_515_245 * state + 12_345) & 0x7FFFFFFF
        noise[k] = (state >> 16) % 401 - 200
    tones = sum(a * np.sin(2 * np.pi * f * i / rate) for a, f in ((7000, 320), (3500, 1180), (1500, 2600)))
    return np.clip(np.trunc(tones * (0.5 - 0.5 * np.cos(2 * np.pi * i / max(n, 1)))).astype(np.int64) + noise, -32768, 32767)


def with_patches(utterances: DataFrame) -> DataFrame:
    """utt_id, n_frames, clipped, patch."""
    kind = dict(utterances.dtypes)["utt_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [patch(np.asarray(x if x is not None else [], np.int64)) for x in b["samples"]]
            yield pd.DataFrame({"utt_id": b["utt_id"], "n_frames": [n for _, n, _ in made], "clipped": [c for _, _, c in made], "patch": [p.tobytes() for p, _, _ in made]})

    return utterances.select("utt_id", "samples").mapInPandas(run, f"utt_id {kind}, n_frames int, clipped int, patch binary")
