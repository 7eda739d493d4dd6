"""Finding the word in a capture from frame energies and zero crossings.

A capture's frames are light rows; they are dealt by capture once, sorted, and read as a
stream, so that a task sorts its frames and holds one capture, however many captures
there are and however much is derived from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUIET, LOOK, HITS, FLOOR, SIGMA, GATE, MARGIN, SHORTEST, LONGEST = 10, 25, 3, 25, 4, 3, 3, 15, 180
#: Result rows of a batch.
ROWS = 4096


def per_capture(stats: DataFrame, key: str, work: Callable[..., tuple | None], columns: str) -> DataFrame:
    """key and columns (longs), a row for each capture that work has one for; work gets the capture's frames, energies and crossings in order, and which energies are known."""
    names = columns.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, out, kind = [], [], [], None

        def done() -> None:
            made = work(*(np.concatenate(c) for c in zip(*held)))
            if made is not None:
                keys.append(current)
                out.append(made)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c, pa.int64()) for c in zip(*out))], names=[key, *names])
            keys.clear()
            out.clear()
            return made

        current = None
        for b in batches:
            if not len(b):
                continue
            kind, ids = b.column(key).type, b.column(key)
            values = [b.column("frame").to_numpy(zero_copy_only=False), *(b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("energy", "crossings")), b.column("energy").is_valid().to_numpy(zero_copy_only=False)]
            starts = [0, *(np.nonzero(pa.compute.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))[0] + 1).tolist(), len(b)]
            for i, j in zip(starts, starts[1:]):
                at = ids[i].as_py()
                if held and at != current:
                    done()
                    held.clear()
                current = at
                held.append([v[i:j] for v in values])
                if len(out) >= ROWS:
                    yield flush()
        if held:
            done()
        if out:
            yield flush()

    rows = stats.where(F.col(key).isNotNull()).select(key, F.col("frame").cast("long").alias("frame"), F.col("energy").cast("long").alias("energy"), F.col("crossings").cast("long").alias("crossings"))
    rows = rows.repartition(key).sortWithinPartitions(key, "frame")
    return rows.mapInArrow(run, f"{key} {stats.schema[key].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names))


def limits(frame: np.ndarray, energy: np.ndarray, crossings: np.ndarray, known: np.ndarray, quiet: int) -> tuple | None:
    """n, itl, itu, izct, egate of a capture; None without a quiet frame."""
    lead = frame < quiet
    k = int(lead.sum())
    if not known[lead].any():
        return None
    e, c = energy[lead & known].tolist(), crossings[lead].tolist()
    em, cm = sum(e) // k, sum(c) // k
    es, cs = isqrt(sum((x - em) ** 2 for x in e) // k), isqrt(sum((x - cm) ** 2 for x in c) // k)
    itl = max(1, min(3 * (int(energy[known].max()) - em) // 100 + em, 4 * em))
    return len(frame), itl, 5 * itl, max(cm + 2 * cs, FLOOR), max(em + SIGMA * es, em + (em >> GATE))


def outer(frame: np.ndarray, energy: np.ndarray, itl: int, itu: int) -> tuple | None:
    """The outer frames of the first and the last run over itl that reaches itu."""
    over = np.nonzero(energy > itl)[0]
    if not len(over):
        return None
    run = np.cumsum(np.diff(frame[over], prepend=frame[over[0]]) > 1)
    loud = run[energy[over] > itu]
    if not len(loud):
        return None
    return int(frame[over[np.searchsorted(run, loud[0])]]), int(frame[over[np.searchsorted(run, loud[-1], "right") - 1]])


def moved(frame: np.ndarray, energy: np.ndarray, crossings: np.ndarray, first: int, last: int, izct: int, egate: int, look: int, hits: int) -> tuple:
    """first and last moved out to the outermost of enough friction frames within look frames."""
    friction = frame[(crossings > izct) & (energy > egate)]
    before, after = friction[(friction < first) & (friction >= first - look)], friction[(friction > last) & (friction <= last + look)]
    return int(before[0]) if len(before) >= max(hits, 1) else first, int(after[-1]) if len(after) >= max(hits, 1) else last


def thresholds(stats: DataFrame, key: str, quiet: int = QUIET) -> DataFrame:
    """key, n, itl, itu, izct, egate from the first quiet frames and the loudest one; means and deviations are floored."""
    return per_capture(stats, key, lambda f, e, c, known: limits(f, e, c, known, quiet), "n itl itu izct egate")


def onsets(stats: DataFrame, key: str, quiet: int = QUIET) -> DataFrame:
    """key, first, last: the outer frames of the first and the last run over itl that reaches itu."""

    def work(f, e, c, known):
        found = limits(f, e, c, known, quiet)
        return found and outer(f, e, *found[1:3])

    return per_capture(stats, key, work, "first last")


def backoff(stats: DataFrame, key: str, quiet: int = QUIET, crossings: int | None = None, look: int = LOOK, hits: int = HITS) -> DataFrame:
    """onsets() moved out to the outermost of enough friction frames within look frames; crossings stands for a capture's own threshold."""

    def work(f, e, c, known):
        found = limits(f, e, c, known, quiet)
        ends = found and outer(f, e, *found[1:3])
        return ends and moved(f, e, c, *ends, found[3] if crossings is None else crossings, found[4], look, hits)

    return per_capture(stats, key, work, "first last")


def endpoints(stats: DataFrame, key: str, frame: int = 160, quiet: int = QUIET, margin: int = MARGIN, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """key, start, stop in samples of the word in each capture that has one; an over-long one keeps its loudest part."""

    def work(f, e, c, known):
        found = limits(f, e, c, known, quiet)
        if not found or found[0] < quiet + shortest:
            return None
        ends = outer(f, e, *found[1:3])
        if not ends or ends[1] <= ends[0]:
            return None
        first, last = moved(f, e, c, *ends, *found[3:], LOOK, HITS)
        a, b = max(first - margin, 0), min(last + margin, found[0] - 1)
        if b - a + 1 < shortest:
            return None
        inside = (f >= a) & (f <= b)
        if b - a + 1 > longest and inside.sum() >= longest:
            sums = np.cumsum(np.concatenate([[0], e[inside]]))
            a = int(f[inside][np.argmax(sums[longest:] - sums[:-longest])])  # the first of equals
            b = a + longest - 1
        return a * frame, (b + 1) * frame

    return per_capture(stats, key, work, "start stop")


def noise_floor(units: DataFrame, key: str, first: int = 15, shift: int = 5, low: int = 10_240, high: int = 640_000) -> DataFrame:
    """key, floor: an integer moving average over the first units, seeded by the first and clamped at each step, then frozen."""
    seq = units.where(F.col("unit") < first).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("unit", "energy"))).alias("u"))
    clamp = lambda x: F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), x))
    fold = F.aggregate(F.slice("u", 2, first), clamp(F.get("u", F.lit(0))["energy"]), lambda f, x: clamp(f + F.shiftright(x["energy"] - f, shift)))
    return seq.select(key, fold.alias("floor"))
