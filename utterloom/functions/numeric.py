"""Integer and signal arithmetic as column expressions. Division truncates or floors as named."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD32, WORD31, WORD30 = (1 << 32) - 1, (1 << 31) - 1, (1 << 30) - 1


def isqrt(x: Column) -> Column:
    """Largest integer whose square is at most x, for x below 2^62."""
    r = F.floor(F.sqrt(x)).cast("long")
    return F.when(r * r > x, r - 1).when((r + 1) * (r + 1) <= x, r + 1).otherwise(r)


def bit_length(x: Column) -> Column:
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x)))


def clamp16(x: Column) -> Column:
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), x))


def log2_q8(x: Column) -> Column:
    """256 * log2(x) from 65 entries and linear interpolation between them; below 1 counts as 1."""
    entries = F.array(*[F.lit(round(256 * math.log2(1 + i / 64))) for i in range(65)])
    v = F.greatest(x.cast("long"), F.lit(1))
    top = bit_length(v) - 1
    scaled = F.when(top >= 16, F.call_function("shiftright", v, F.greatest(top - 16, F.lit(0)))).otherwise(F.call_function("shiftleft", v, F.greatest(16 - top, F.lit(0))))
    slot = (F.shiftright(scaled, 10) - 64).cast("int")
    low, high = F.get(entries, slot), F.get(entries, slot + 1)
    return top * 256 + low + F.shiftright((high - low) * scaled.bitwiseAND(1023) + 512, 10)


def hz_to_mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel_to_hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def dbfs(level: Column, full: int = 32768) -> Column:
    """Decibels below full scale; -120 for nothing."""
    return F.when(level <= 0, -120.0).otherwise(20 * F.log10(level / full))


def db_to_q15(db: Column) -> Column:
    return F.floor(F.pow(F.lit(10.0), db / 20) * 32768 + 0.5).cast("long")


def semitones(a: Column, b: Column) -> Column:
    """Distance from pitch a to b; 0 where either is unvoiced."""
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(12 * F.log2(b / a))


def lcg(seed: Column, steps: int) -> Column:
    """States of the linear congruential generator modulo 2^31 after 1..steps."""
    start = F.struct(seed.cast("long").alias("x"), F.array().cast("array<long>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        x = (s["x"] * 1103515245 + 12345).bitwiseAND(WORD31)
        return F.struct(x.alias("x"), F.concat(s["out"], F.array(x)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["out"])


def xorshift32(seed: Column, steps: int) -> Column:
    """States of xorshift 13, 17, 5 on 32 bits after 1..steps."""
    start = F.struct(seed.cast("long").alias("x"), F.array().cast("array<long>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        x = s["x"].bitwiseXOR(F.shiftleft(s["x"], 13)).bitwiseAND(WORD32)
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
        x = x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(WORD32)
        return F.struct(x.alias("x"), F.concat(s["out"], F.array(x)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["out"])


def checksum31(values: Column) -> Column:
    """Order-sensitive: acc * 31 + v on 30 bits."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: (acc * 31 + v).bitwiseAND(WORD30))


def clip_id(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 8)


def lower_median(values: Column) -> Column:
    """The element at index n div 2 of the sorted values."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def aligned(length: Column, to: int = 4) -> Column:
    return F.floor((length + (to - 1)) / to).cast("long") * to


def clip_bytes(samples: Column, head: int = 8) -> Column:
    """Bytes of a four-bit clip of so many samples: its header, and half a byte for each sample but the first."""
    return (F.when(samples > 1, F.floor(samples / 2)).otherwise(0) + head).cast("long")
