"""Frames and windows over sample streams, a stream per key.

Streams are long rows (key, i, x) with i from 0 without gaps, or one array per row. Long
rows are grouped by key and frame, so that a stream of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """key, i, x: the values of each key, numbered from 0 in order."""
    return rows.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long").alias("i"), value.alias("x"))


def frame_stats(samples: DataFrame, key: str, size: int) -> DataFrame:
    """key, frame, energy, crossings of whole frames: the sum of magnitudes, and sign changes inside the frame; 0 counts as positive."""
    rows = samples.withColumn("frame", F.floor(F.col("i") / size))
    before = F.lag("x").over(Window.partitionBy(key, "frame").orderBy("i"))
    rows = rows.withColumn("turn", F.when(before.isNotNull() & ((F.col("x") < 0) != (before < 0)), 1).otherwise(0))
    out = rows.groupBy(key, "frame").agg(F.sum(F.abs("x")).alias("energy"), F.sum("turn").alias("crossings"), F.count("*").alias("n"))
    return out.where(F.col("n") == size).drop("n")


def sliding(samples: Column, size: int, stride: int) -> Column:
    """Whole frames of an array; none of a shorter one."""
    n = F.floor((F.size(samples) - size) / stride).cast("int")
    return F.when(F.size(samples) < size, F.array().cast("array<array<int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda f: F.slice(samples, f * stride + 1, size)))


def units(stats: DataFrame, key: str, frames: int = 2) -> DataFrame:
    """key, unit, energy of whole units of frames."""
    out = stats.groupBy(key, F.floor(F.col("frame") / frames).alias("unit")).agg(F.sum("energy").alias("energy"), F.count("*").alias("n"))
    return out.where(F.col("n") == frames).drop("n")


def deltas(rows: DataFrame, key: str, reach: int = 2, reciprocal: int = 3277) -> DataFrame:
    """rows (key, i, x) with d: the regression slope over reach neighbours on each side in Q15, edges repeated, rounded half up."""
    w = Window.partitionBy(key).orderBy("i")
    ends = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("x").over(ends), F.last("x").over(ends)
    total = sum((n * (F.coalesce(F.lead("x", n).over(w), last) - F.coalesce(F.lag("x", n).over(w), first)) for n in range(1, reach + 1)), F.lit(0))
    return rows.withColumn("d", F.shiftright((total * reciprocal + 16384).cast("long"), 15))


def without_mean(rows: DataFrame, key: str) -> DataFrame:
    """rows with c: x minus the key's mean, truncated toward zero."""
    means = rows.groupBy(key).agg(F.expr("sum(x) div count(x)").alias("m"))
    return rows.join(means, key).withColumn("c", F.col("x") - F.col("m")).drop("m")


def loudest(rows: DataFrame, key: str, size: int) -> DataFrame:
    """key, start, total of the loudest window of size rows; the first of equals, whole windows only."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(0, size - 1)
    full = rows.select(key, F.col("i").cast("long").alias("start"), F.sum("x").over(w).alias("total"), F.count("*").over(w).alias("n")).where(F.col("n") == size)
    best = full.groupBy(key).agg(F.min(F.struct((-F.col("total")).alias("t"), "start")).alias("b"))
    return best.select(key, F.col("b.start").alias("start"), (-F.col("b.t")).alias("total"))


def preemphasis(rows: DataFrame, key: str, q15: int = 31785) -> DataFrame:
    """rows with y: x minus the coefficient (Q15) times the one before, floored, and clamped to 16 bits; the first follows itself."""
    before = F.lag("x", 1).over(Window.partitionBy(key).orderBy("i"))
    y = F.col("x") - F.shiftright((F.coalesce(before, F.col("x")) * q15).cast("long"), 15)
    return rows.withColumn("y", F.greatest(F.lit(-32768), F.least(F.lit(32767), y)))


def int8_patch(rows: DataFrame, key: str, shift: int = 4) -> DataFrame:
    """key, i, q, clipped: mean-free values shifted right, rounded half up, clipped to 8 bits."""
    raw = F.shiftright((F.col("c") + (1 << shift - 1)).cast("long"), shift)
    return without_mean(rows, key).select(key, "i", F.greatest(F.lit(-128), F.least(F.lit(127), raw)).alias("q"), ((raw < -128) | (raw > 127)).alias("clipped"))


def centred(values: Column, rows: int, pad: int = 0) -> Column:
    """Exactly rows values: padded before by half of what is missing, or cut by half of what is over."""
    lack, over = F.lit(rows) - F.size(values), F.size(values) - F.lit(rows)
    before = F.floor(lack / 2).cast("int")
    return F.when(lack > 0, F.concat(F.array_repeat(F.lit(pad), F.greatest(before, F.lit(0))), values, F.array_repeat(F.lit(pad), F.greatest(lack - before, F.lit(0))))).otherwise(F.slice(values, F.floor(F.greatest(over, F.lit(0)) / 2).cast("int") + 1, rows))


def capture_stats(samples: DataFrame, key: str) -> DataFrame:
    """key, n, low, high, mean, rms, peak, clipped, flat of each capture."""
    x = F.col("x")
    return samples.groupBy(key).agg(
        F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"),
        F.sqrt(F.sum(x.cast("long") * x) / F.count("*")).alias("rms"), F.max(F.abs(x)).alias("peak"),
        F.sum(F.when(F.abs(x) >= 32767, 1).otherwise(0)).alias("clipped"), (F.min(x) == F.max(x)).alias("flat"),
    )


def capture_verdict(stats: DataFrame, quiet: float = 200, dc: float = 1000) -> DataFrame:
    """stats with fatal, and notes on what is wrong with a capture."""
    notes = F.array_compact(F.array(
        F.when(F.col("flat"), F.lit("flat")), F.when(F.col("rms") < quiet, F.lit("too quiet")),
        F.when(F.col("clipped") * 1000 > F.col("n"), F.lit("clipped")), F.when(F.abs("mean") > dc, F.lit("offset")),
    ))
    return stats.withColumn("fatal", F.col("flat") | (F.col("rms") < quiet)).withColumn("notes", notes)
