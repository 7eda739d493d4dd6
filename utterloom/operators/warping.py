"""Dynamic time warping of feature sequences against a template library."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FAR, BAND, RATIO = 1 << 29, 10, 200  # no path, half width of the band, percent of the lengths' ratio


def distance(q: np.ndarray, t: np.ndarray, band: int = BAND, ratio: int = RATIO) -> int:
    """Least path cost over n + m, floored; steps along one side cost the L1 distance, diagonal ones twice that. FAR for none.

    Rows of distances inside the band come from one array operation; only the running
    minimum along a row is sequential.
    """
    n, m = len(q), len(t)
    if not n or not m or n * 100 > m * ratio or m * 100 > n * ratio:
        return FAR
    before = np.full(m + 1, FAR, np.int64)  # shifted by one: entry 0 stands before the first column
    for i in range(n):
        low, high = max(0, i * m // n - band), min(m - 1, i * m // n + band)
        d = np.abs(t[low : high + 1].astype(np.int64) - q[i]).sum(axis=1)
        enter = np.minimum(before[low + 1 : high + 2] + d, before[low : high + 1] + 2 * d)
        if i == 0:
            enter = np.full(len(d), FAR, np.int64)
            if low == 0:
                enter[0] = 2 * d[0]
        # a run along the row costs a prefix sum of d, so its best start is a running minimum
        total = np.cumsum(d)
        row = np.minimum.accumulate(enter - total) + total
        before = np.full(m + 1, FAR, np.int64)
        before[low + 1 : high + 2] = np.minimum(row, FAR)
    return FAR if before[m] >= FAR else int(before[m] // (n + m))


def class_distances(queries: DataFrame, templates: list[tuple[str, np.ndarray]], band: int = BAND) -> DataFrame:
    """query, label, score: the least distance to each label's templates, for queries (query, frames).

    The library is a stated list that goes to the tasks with the function; the length
    gate comes before the warping.
    """
    library = [(label, np.asarray(t, np.int64)) for label, t in templates]
    kind = dict(queries.dtypes)["query"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, frames in zip(b["query"], b["frames"]):
                x, best = np.array([np.asarray(f) for f in frames], np.int64), {}
                for label, t in library:
                    best[label] = min(best.get(label, FAR), distance(x, t, band))
                rows += [(key, k, v) for k, v in best.items()]
            yield pd.DataFrame(rows, columns=["query", "label", "score"])

    return queries.select("query", "frames").mapInPandas(run, f"query {kind}, label string, score long")
