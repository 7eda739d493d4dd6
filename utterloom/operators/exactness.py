"""Comparing score vectors exactly, counts of 256, packed templates, and plans that bring files and a manifest together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIAS = 32_768


def shares(counts: Column, zero: int = -128, scale: float = 1 / 256) -> Column:
    """Quantised outputs as shares: (q - zero) * scale, which is exact."""
    return F.transform(counts, lambda q: (q - zero) * scale)


def counts(scores: Column) -> Column:
    """Shares as counts of 256."""
    return F.transform(scores, lambda p: F.floor(p * 256 + 0.5).cast("int"))


def whole_counts(scores: Column) -> Column:
    """Whether every share is a multiple of 1/256."""
    return F.forall(scores, lambda p: p * 256 == F.floor(p * 256))


def first_best(values: Column) -> Column:
    """Index of the largest value, the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1


def exactness(reference: DataFrame, device: DataFrame, key: str = "name", values: str = "q") -> DataFrame:
    """key, state, exact, worst, same_best of each vector: missing, extra, or compared; vectors of other lengths are never exact."""
    a, b = reference.select(key, F.col(values).alias("a")), device.select(key, F.col(values).alias("b"))
    x, y = F.col("a"), F.col("b")
    both = a.join(b, key, "full_outer")
    state = F.when(y.isNull(), "missing").when(x.isNull(), "extra").otherwise("compared")
    same = F.size(x) == F.size(y)
    worst = F.when(same, F.array_max(F.zip_with(x, y, lambda p, q: F.abs(p - q))))
    return both.select(key, state.alias("state"), F.coalesce(x == y, F.lit(False)).alias("exact"), worst.alias("worst"), (first_best(x) == first_best(y)).alias("same_best"))


def gate(compared: DataFrame, error_lines: int = 0) -> DataFrame:
    """One row: exact, n, worst, best_agreement, passed; anything missing, extra, unequal or an error line fails it, and so does nothing at all."""
    total = compared.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.col("exact").cast("int")), F.lit(0)).alias("exact"), F.max("worst").alias("worst"),
        F.avg(F.col("same_best").cast("int")).alias("best_agreement"),
    )
    return total.withColumn("passed", (F.col("n") > 0) & (F.col("exact") == F.col("n")) & F.lit(error_lines == 0))


def packed_templates(templates: list[tuple[str, np.ndarray]]) -> tuple[bytes, list[tuple[str, int, int]]]:
    """Frames of all templates as little-endian 16 bits biased to be positive, and (label, first frame, frames) of each."""
    blob, index, at = [], [], 0
    for label, frames in templates:
        x = np.asarray(frames, np.int64)
        if x.size and (x.min() < -BIAS or x.max() >= BIAS):
            raise ValueError(f"{label}: a value doesn't fit 16 bits")
        blob.append((x + BIAS).astype("<u2").tobytes())
        index.append((label, at, len(x)))
        at += len(x)
    return b"".join(blob), index


def unpacked_templates(blob: bytes, index: list[tuple[str, int, int]], width: int) -> list[tuple[str, np.ndarray]]:
    rows = np.frombuffer(blob, "<u2").astype(np.int64).reshape(-1, width) - BIAS
    return [(label, rows[at : at + n]) for label, at, n in index]


def reconcile(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """file, action, to: index for files without a row, relocate for rows whose name exists at one other place, quarantine for the rest without a file, keep.

    manifest and files have file; names are what follows the last slash. Only a plan: nothing is moved.
    """
    name = lambda c: F.regexp_replace(c, r"^.*/", "")
    rows, there = manifest.select("file").distinct(), files.select("file").distinct()
    free = there.join(rows, "file", "left_anti")
    by_name = free.groupBy(name("file").alias("name")).agg(F.min("file").alias("to"), F.count("*").alias("n"))
    gone = rows.join(there, "file", "left_anti").withColumn("name", name("file")).join(by_name.where("n = 1"), "name", "left")
    moved = gone.select("file", F.when(F.col("to").isNotNull(), "relocate").otherwise("quarantine").alias("action"), "to")
    new = free.join(moved.where("to is not null").select(F.col("to").alias("file")), "file", "left_anti").select("file", F.lit("index").alias("action"), F.lit(None).cast("string").alias("to"))
    kept = rows.join(there, "file", "left_semi").select("file", F.lit("keep").alias("action"), F.lit(None).cast("string").alias("to"))
    return moved.unionByName(new).unionByName(kept)


def queries_with_both(words: DataFrame, silent: DataFrame) -> DataFrame:
    """Rows of both sets; without either the measures mean nothing, and that is an error."""
    if words.isEmpty() or silent.isEmpty():
        raise ValueError("words and rows that must stay silent are both needed")
    return words.unionByName(silent)


def fingerprint_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two vectors of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def without_level(values: Column) -> Column:
    """A vector less its mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return F.transform(values, lambda x: x - mean)
