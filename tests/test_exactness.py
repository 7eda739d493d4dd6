import numpy as np
import pytest
from pyspark.sql import functions as F

from utterloom.operators import exactness as ex
from utterloom.operators import scorer


def test_gate_can_say_no(spark):
    rows = [(f"v{i}", [i, 9, 3]) for i in range(4)]
    schema = "name string, q array<int>"
    good = spark.createDataFrame(rows, schema)
    assert ex.gate(ex.exactness(good, good)).first().passed
    assert not ex.gate(ex.exactness(good, good), error_lines=1).first().passed
    for bad in ([*rows[:3], ("v3", [3, 9, 4])], rows[:3], [*rows, ("v9", [1, 2, 3])], [*rows[:3], ("v3", [3, 9])], []):
        assert not ex.gate(ex.exactness(good, spark.createDataFrame(bad, schema))).first().passed
    assert not ex.gate(ex.exactness(good.limit(0), good.limit(0))).first().passed


def test_counts(spark):
    row = spark.createDataFrame([([0.5, 0.25, 0.0],), ([0.1],)], "p array<double>").select(ex.counts(F.col("p")).alias("c"), ex.whole_counts(F.col("p")).alias("w")).collect()
    assert row[0].c == [128, 64, 0] and row[0].w and not row[1].w


def test_templates_round_trip():
    x = [("a", np.array([[1, -2], [3, 32767]])), ("b", np.array([[-32768, 0]]))]
    blob, index = ex.packed_templates(x)
    assert index == [("a", 0, 2), ("b", 2, 1)]
    assert all(n == m and (p == q).all() for (n, p), (m, q) in zip(x, ex.unpacked_templates(blob, index, 2)))
    with pytest.raises(ValueError):
        ex.packed_templates([("a", np.array([[40000]]))])


def test_both_kinds_are_needed(spark):
    a = spark.range(2)
    assert ex.queries_with_both(a, a).count() == 4
    with pytest.raises(ValueError):
        ex.queries_with_both(a, a.limit(0))


def slow_conv(x, w, stride):
    n, rows, columns, _ = x.shape
    out, h, k, _ = w.shape
    r, c = -(-rows // stride), -(-columns // stride)
    top, left = max(0, (r - 1) * stride + h - rows) // 2, max(0, (c - 1) * stride + k - columns) // 2
    y = np.zeros((n, r, c, out), np.int64)
    for b in range(n):
        for i in range(r):
            for j in range(c):
                for o in range(out):
                    for p in range(h):
                        for q in range(k):
                            u, v = i * stride + p - top, j * stride + q - left
                            if 0 <= u < rows and 0 <= v < columns:
                                y[b, i, j, o] += int((x[b, u, v].astype(int) * w[o, p, q]).sum())
    return y


def test_network(spark):
    rng = np.random.default_rng(1)
    w = rng.integers(-128, 128, (3, 5, 3, 2))
    x = rng.integers(-128, 128, (2, 7, 6, 2))
    got = np.einsum("nrchwi,ohwi->nrco", scorer.windows(x, 5, 3, 2), w)
    assert (got == slow_conv(x, w, 2)).all()
    layers = [scorer.Layer("conv", rng.integers(-99, 99, (4, 5, 5, 1)), rng.integers(-500, 500, 4), 0.0005, 2), scorer.Layer("depthwise", rng.integers(-99, 99, (3, 3, 4)), None, 0.002), scorer.Layer("mean"), scorer.Layer("dense", rng.integers(-99, 99, (5, 4)), rng.integers(-9, 9, 5), 0.001)]
    patch = rng.integers(-128, 128, (80, 26)).astype(np.int8)
    rows = spark.createDataFrame([("a", bytearray(patch.tobytes())), ("b", bytearray(80 * 26))], "utt_id string, patch binary")
    q = {r.utt_id: r.q for r in scorer.scored(rows, layers).collect()}
    assert q["a"] == scorer.run(patch[None], layers)[0].tolist() and abs(sum(q["b"]) - 256) <= 3
