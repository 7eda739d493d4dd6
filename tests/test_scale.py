"""Steps whose work must not grow faster than it has to: how often a plan makes scores, pairs without a join, pieces, rows of a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterloom.operators import endpoints
from utterloom.operators import evaluation as ev
from utterloom.operators import matching as m
from utterloom.plans import registry

DATA = "/root/testdata/sf0.001"


def vectors(spark, n, seed=5):
    """vec_id, label, v: few values, so that distances tie; one key twice, a null vector, and nulls in the other columns."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 4)), rng.integers(-2, 3, 3).tolist()) for i in rng.permutation(n)]
    rows += [(7, 1, [1, 1, 1]), (n + 1, 2, None), (None, 1, [0, 0, 0]), (n + 2, None, [2, 2, 2])]
    return rows, spark.createDataFrame(rows, "vec_id long, label int, v array<int>")


def l1(a, b):
    return int(np.abs(np.array(a) - b).sum())


@pytest.mark.parametrize("piece", [1, 1 << 18])
def test_nearest_other_against_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(m, "PIECE", piece)
    rows, df = vectors(spark, 300)
    rows = [r for r in rows if r[0] is not None]
    want = {}
    for i, label, v in rows:
        for o, guess, t in rows:
            if i != o:
                far = m.NONE if v is None or t is None else l1(v, t)
                want[i] = min(want.get(i, (m.NONE + 1, 0, 0, 0)), (far, o, -1 if label is None else label, -1 if guess is None else guess))
    got = {r.vec_id: (-1 if r.label is None else r.label, -1 if r.guess is None else r.guess) for r in m.nearest_other(df).collect()}
    assert got == {i: x[2:] for i, x in want.items()}
    assert m.nearest_other(df.where("vec_id = 3")).count() == 0


def test_within_between_against_all_pairs(spark):
    rows, df = vectors(spark, 60)
    rows = [r for r in rows if None not in r]
    pairs = [(a[1] == b[1], l1(a[2], b[2])) for a in rows for b in rows if a[0] < b[0]]
    within, between = (np.mean([d for s, d in pairs if s == k]) for k in (True, False))
    frame = ev.within_between(df)
    assert frame.collect()[0] == pytest.approx((within, between, between / within))
    assert ev.within_between(df.where("vec_id = 3")).collect()[0] == (None, None, None)


def test_more_templates_than_a_small_table(spark):
    t = spark.range(m.TEMPLATE_BOUND + 1).select((F.col("id") % 3).cast("int").alias("label"), F.array(F.col("id").cast("int"), F.lit(1)).alias("t"))
    q = spark.createDataFrame([(1, [20_000, 1]), (2, [-4, 2])], "query long, v array<int>")
    got = {(r.query, r.label): r.score for r in m.class_scores(q, t).collect()}
    assert got == {(1, 20_000 % 3): 0, (1, 19_999 % 3): 1, (1, 19_998 % 3): 2, (2, 0): 5, (2, 1): 6, (2, 2): 7}


def test_class_scores_in_pieces_and_wide_values(spark, monkeypatch):
    monkeypatch.setattr(m, "PIECE", 1)
    rng = np.random.default_rng(1)
    q, t = rng.integers(-(1 << 30), 1 << 30, (5, 4)), rng.integers(-(1 << 30), 1 << 30, (260, 4))
    left = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query long, v array<int>")
    right = spark.createDataFrame([(i % 2, x.tolist()) for i, x in enumerate(t)], "label int, t array<int>")
    want = {(i, k): min(l1(x, y) for y in t[k::2]) for i, x in enumerate(q) for k in (0, 1)}
    assert {(r.query, r.label): r.score for r in m.class_scores(left, right).collect()} == want
    with pytest.raises(Exception, match="one length"):
        m.class_scores(left, right.unionByName(right.withColumn("t", F.slice("t", 1, 2)))).collect()


@pytest.mark.parametrize("name", ["result_diff", "steals", "top_steals", "threshold_sweep", "recommend_point"])
def test_scores_are_made_once(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def slow_ends(rows, quiet, look, hits, cross):
    """first, last of a capture's (frame, energy, crossings), step by step."""
    lead = [r for r in rows if r[0] < quiet]
    em, cm = (sum(r[k] for r in lead) // len(lead) for k in (1, 2))
    es = int(np.sqrt(sum((r[1] - em) ** 2 for r in lead) // len(lead)))
    itl = max(1, min(3 * (max(r[1] for r in rows) - em) // 100 + em, 4 * em))
    gate, runs = max(em + 4 * es, em + (em >> 3)), []
    for f, e, _ in rows:
        if e > itl:
            if runs and runs[-1][-1][0] == f - 1:
                runs[-1].append((f, e))
            else:
                runs.append([(f, e)])
    runs = [r for r in runs if max(e for _, e in r) > 5 * itl]
    if not runs:
        return None
    first, last = runs[0][0][0], runs[-1][-1][0]
    friction = [f for f, e, c in rows if c > cross and e > gate]
    before, after = [f for f in friction if first - look <= f < first], [f for f in friction if last < f <= last + look]
    return before[0] if len(before) >= hits else first, after[-1] if len(after) >= hits else last


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_captures_over_batches(spark, batch):
    rng = np.random.default_rng(2)
    stats = {k: [(f, int(e), int(c)) for f, (e, c) in enumerate(zip(rng.choice([3, 9, 20, 200], 30, p=[0.5, 0.2, 0.2, 0.1]), rng.integers(0, 5, 30)))] for k in range(40)}
    df = spark.createDataFrame([(k, *r) for k, rows in stats.items() for r in reversed(rows)], "key long, frame long, energy long, crossings long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.key: (r.first, r.last) for r in endpoints.backoff(df, "key", 3, 1, 5, 2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {k: slow_ends(rows, 3, 5, 2, 1) for k, rows in stats.items()}
    assert got == {k: x for k, x in want.items() if x} and len(got) > 20


@pytest.mark.parametrize("name", ["endpoints", "zcr_backoff", "vad_thresholds", "energy_onset"])
def test_frames_are_read_once(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("parquet") == 1
