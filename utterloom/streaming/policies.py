"""Small policies with counters as state, folded over a key's events in order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(n: int, *key) -> int:
    """A number below n from a hash of the key, so that reruns agree."""
    return int(hashlib.md5(repr(key).encode()).hexdigest()[:12], 16) % n


def alternates(key, count: int, least: int = 5, odds: int = 3) -> Iterator[bool]:
    """Whether each of count sounds is the alternate one: least plain ones in between, then one in odds."""
    plain = 0
    for i in range(count):
        other = plain >= least and draw(odds, key, i) == 0
        plain = 0 if other else plain + 1
        yield other


def refreshes(times: list[float], partials: int = 8, idle: float = 60) -> Iterator[str]:
    """full for the first update, after partials partial ones, and for the first one after a sleep; else partial."""
    left, last = 0, None
    for t in times:
        if not left or (last is not None and t - last >= idle):
            yield "full"
            left = partials
        else:
            yield "partial"
            left -= 1
        last = t


def unrepeated(key, count: int, choices: int) -> Iterator[int]:
    """count choices, none equal to the one before."""
    last = None
    for i in range(count):
        pick = draw(choices if last is None else choices - 1, key, i)
        last = pick if last is None or pick < last else pick + 1
        yield last


def folded(events: DataFrame, key: str, order: str, run: Callable[[object, pd.DataFrame], list], kind: str) -> DataFrame:
    """events' key and order with out, what run makes of a key's events in order."""
    kinds = dict(events.dtypes)

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return pd.DataFrame({key: rows[key], order: rows[order], "out": list(run(rows[key].iloc[0], rows))})

    return events.groupBy(key).applyInPandas(each, f"{key} {kinds[key]}, {order} {kinds[order]}, out {kind}")


def edges(events: DataFrame, key: str, order: str, level: Column, stuck_s: float = 30) -> DataFrame:
    """Rows at which a level rises, or at which it has been up for stuck_s since the last row that counted as one; order is a time."""
    w = Window.partitionBy(key).orderBy(order)
    rows = events.withColumn("_up", level).withColumn("_was", F.lag(level).over(w)).withColumn("_at", F.col(order).cast("timestamp").cast("double"))
    rows = rows.withColumn("_rise", F.last(F.when(F.col("_up") & ~F.coalesce("_was", F.lit(False)), F.col("_at")), True).over(w))
    spell = F.floor((F.col("_at") - F.col("_rise")) / stuck_s)
    before = F.lag(spell).over(Window.partitionBy(key, "_rise").orderBy(order))
    rows = rows.withColumn("_n", spell).withColumn("_b", before)
    return rows.where("_up and (_b is null or _n > _b)").drop("_up", "_was", "_at", "_rise", "_n", "_b")
