"""Four-bit adaptive audio: encoding, decoding in one go or in chunks, and archives of clips."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the IMA standard: how a code moves the step's index.
MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
HEAD = struct.Struct("<IhBB")
PAK_MAGIC, PAK_HEAD, PAK_ENTRY, ALIGN = b"VPAK", struct.Struct("<4sHHII"), struct.Struct("<8sIII"), 4


#: Fixed values of the IMA standard: the step sizes.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)


def moved(value: int, index: int, code: int) -> tuple[int, int]:
    """The decoder's state after a code."""
    step = STEPS[index]
    change = (step >> 3) + sum(step >> (2 - bit) for bit in (2, 1, 0) if code >> bit & 1)
    value = min(32767, max(-32768, value - change if code & 8 else value + change))
    return value, min(88, max(0, index + MOVES[code & 7]))


def chosen(error: int, index: int) -> int:
    """The code whose change comes next below the error's size."""
    code, left = (8 if error < 0 else 0), abs(error)
    for bit in (2, 1, 0):
        part = STEPS[index] >> (2 - bit)
        if left >= part:
            code, left = code | 1 << bit, left - part
    return code


def encode(samples) -> bytes:
    """A clip: header with the first sample, then two codes a byte, the low one first."""
    x = np.clip(np.asarray(samples, np.int64), -32768, 32767).tolist()
    if not x:
        return HEAD.pack(0, 0, 0, 0)
    value, index, codes = x[0], 0, []
    for s in x[1:]:
        codes.append(chosen(s - value, index))
        value, index = moved(value, index, codes[-1])
    codes += [0] * (len(codes) % 2)
    return HEAD.pack(len(x), x[0], 0, 0) + bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2]))


def decode_codes(data: bytes, count: int, value: int, index: int) -> tuple[list[int], int, int]:
    """count samples and the state to go on from; every chunk but the last has an even count."""
    out = []
    for i in range(count):
        value, index = moved(value, index, data[i // 2] >> 4 * (i % 2) & 15)
        out.append(value)
    return out, value, index


def decode(clip: bytes) -> list[int]:
    n, value, index, _ = HEAD.unpack_from(clip)
    return [value, *decode_codes(clip[HEAD.size :], n - 1, value, index)[0]] if n else []


def clip_length(n: int) -> int:
    return HEAD.size + n // 2 if n > 1 else HEAD.size


def encoded(clips: DataFrame) -> DataFrame:
    """clips (id, pcm) with n_samples and blob."""

    @F.pandas_udf("binary")
    def run(pcm: pd.Series) -> pd.Series:
        return pcm.map(lambda x: encode(x if x is not None else []))

    return clips.select("*", F.coalesce(F.size("pcm"), F.lit(0)).alias("n_samples"), run("pcm").alias("blob"))


def decoded(clips: DataFrame) -> DataFrame:
    """clips (id, blob) with pcm."""

    @F.pandas_udf("array<int>")
    def run(blob: pd.Series) -> pd.Series:
        return blob.map(decode)

    return clips.select("*", run("blob").alias("pcm"))


def pack_archive(clips: list[tuple[str, bytes, int]], rate: int = 16_000) -> bytes:
    """An archive of one device: (id of 8 characters, blob, samples), by id; equal ids are an error."""
    clips = sorted(clips)
    if len({c[0] for c in clips}) != len(clips):
        raise ValueError("two clips have one id")
    up = lambda n: -(-n // ALIGN) * ALIGN
    at = up(PAK_HEAD.size + PAK_ENTRY.size * len(clips))
    index, body = PAK_HEAD.pack(PAK_MAGIC, 1, 0, len(clips), rate), b""
    for key, blob, n in clips:
        index += PAK_ENTRY.pack(key.encode(), at + len(body), len(blob), n)
        body += blob.ljust(up(len(blob)), b"\0")
    return index.ljust(at, b"\0") + body


def open_archive(data: bytes) -> tuple[int, list[tuple[str, bytes, int]]]:
    """Rate and clips of an archive."""
    magic, version, _, count, rate = PAK_HEAD.unpack_from(data)
    if magic != PAK_MAGIC or version != 1:
        raise ValueError("not an archive of clips")
    entries = [PAK_ENTRY.unpack_from(data, PAK_HEAD.size + i * PAK_ENTRY.size) for i in range(count)]
    return rate, [(key.decode(), data[at : at + n], samples) for key, at, n, samples in entries]
