import math
import random

import numpy as np
from pyspark.sql import functions as F

from utterloom.functions import augment, dsp
from utterloom.functions import numeric as nu
from utterloom.functions import text as tx


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first().x


def test_words_and_clauses(spark):
    w = tx.words(F.col("t"))
    assert one(spark, w, t='  (Well) "my dear: friend. but  no ,stop!') == ["WELL", "MY", "DEAR", "FRIEND.", "BUT", "NO", "STOP!"]
    assert one(spark, F.array_join(tx.clause_with(tx.words(F.col("t")), ["HELP"]), " "), t="Good day, I need help. but not now") == "I NEED HELP"
    assert one(spark, tx.clause_with(tx.words(F.col("t")), ["X"]), t="a, b") == ["A"]
    assert one(spark, tx.clause_with(tx.words(F.col("t")), ["X"]), t=" ,.") == []


def test_sentence_case_wrap_and_fit(spark):
    assert one(spark, tx.sentence_case(F.col("t")), t="HOW DO YOU DO. I SPEAK ONLY ENGLISH. I'M GLAD") == "How do you do. I speak only English. I'm glad"
    assert one(spark, tx.wrap(F.col("t"), 5), t="ab cd efg hijklmnop") == ["ab cd", "efg", "hijkl", "mnop"]
    sizes = [(3, 5, 2), (2, 8, 3), (1, 12, 6)]
    assert one(spark, tx.fit(F.col("t"), sizes), t="ab cd efg") == 3
    assert one(spark, tx.fit(F.col("t"), sizes), t="abcdefg hij klm") == 2
    assert one(spark, tx.fit(F.col("t"), sizes), t="abcdefghijklmnopq") == 1


def test_names(spark):
    assert one(spark, tx.slug(F.col("t")), t="a-b é.1") == "a_b_é_1"
    assert one(spark, tx.form_of_file(F.col("t")), t="/x/hello_world_07.wav") == "hello_world"
    assert one(spark, tx.name_stem(F.col("t")), t="Anna (Premium)") == "Anna"
    assert one(spark, tx.quality_of(F.col("t")), t="Anna (Premium)") == 2
    assert one(spark, tx.punctuate(F.col("t"), F.lit(True)), t="WHY") == "WHY?"
    assert one(spark, tx.bag(F.col("t"), {"MOTHER": "family", "SAD": "mood"}), t="sad, Mother sad") == ["family", "mood"]


def test_integers(spark):
    rng = random.Random(1)
    xs = [0, 1, 2, 3, 4, 2**40, (2**26) ** 2 - 1, *[rng.randrange(2**52) for _ in range(200)]]
    rows = spark.createDataFrame([(x,) for x in xs], "x long").select("x", nu.isqrt(F.col("x")).alias("r"), nu.bit_length(F.col("x")).alias("b"), nu.log2_q8(F.col("x")).alias("l")).collect()
    for r in rows:
        assert r.r == math.isqrt(r.x) and r.b == r.x.bit_length()
        assert r.l == int(dsp.log2_q8(np.array([r.x]))[0])
        assert abs(r.l - 256 * math.log2(max(r.x, 1))) < 1.1
    state, out = 7, []
    for _ in range(5):
        state ^= state << 13 & nu.WORD32
        state ^= state >> 17
        state ^= state << 5 & nu.WORD32
        state &= nu.WORD32
        out.append(state)
    assert one(spark, nu.xorshift32(F.lit(7), 5)) == out
    assert one(spark, nu.semitones(F.lit(100.0), F.lit(200.0))) == 12.0 and one(spark, nu.semitones(F.lit(0.0), F.lit(200.0))) == 0.0
    assert one(spark, nu.dbfs(F.lit(0))) == -120.0


def signal(n, kind):
    t = np.arange(n)
    if kind == "silence":
        return np.zeros(n, np.int64)
    if kind == "loud":
        return np.where(t // 37 % 2, 32767, -32768).astype(np.int64)
    return (8000 * np.sin(t * 0.21) + 3000 * np.sin(t * 0.011) + (t * 7919 % 301) - 150).astype(np.int64)


def test_transform_is_that_of_its_definition():
    x = dsp.normalised(dsp.framed(signal(2000, "tone")))[0]
    re, im = dsp.fft(x)
    want = np.fft.fft(x, dsp.FFT) / dsp.FFT
    assert np.abs(re + 1j * im - want).max() < 6


def test_bands_follow_the_floating_ones():
    for kind in ("tone", "loud"):
        got, want = dsp.log_mel(signal(4000, kind)), dsp.float_log_mel(signal(4000, kind))
        near = want > want.max() - 256 * 6
        assert np.median(np.abs((got - want)[near] - np.median((got - want)[near]))) < 24


def test_shapes_and_silence():
    assert dsp.features(signal(399, "tone")).shape == (0, 24)
    assert dsp.features(signal(400, "tone")).shape == (1, 24)
    assert not dsp.features(signal(1600, "silence")).any()
    for n in (400, 400 + 160 * 79, 400 + 160 * 120):
        p, frames, _ = dsp.patch(signal(n, "tone"))
        assert p.shape == (80, 26) and frames == 1 + (n - 400) // 160
    c = np.array([[1], [2], [4], [8], [16]])
    assert dsp.deltas(c)[2, 0] == ((8 - 2) + 2 * (16 - 1)) * 3277 + 16384 >> 15
    assert (dsp.without_mean(np.array([[-3], [0]])) == np.array([[-2], [1]])).all()


def test_pitch():
    t = np.arange(16000)
    assert abs(dsp.pitch(12000 * np.sin(2 * np.pi * 125 * t / 16000)) - 125) < 2
    assert dsp.pitch(np.zeros(16000)) == 0.0


def test_features_in_spark(spark):
    rows = spark.createDataFrame([("a", signal(900, "tone").tolist()), ("b", []), ("c", None)], "utt_id string, samples array<int>")
    got = dsp.with_features(rows).orderBy("frame_no").collect()
    assert [r.vec for r in got] == dsp.features(signal(900, "tone")).tolist() and {r.utt_id for r in got} == {"a"}
    assert {r.utt_id: r.n_frames for r in dsp.with_patches(rows).collect()} == {"a": 4, "b": 0, "c": 0}


def test_augmentation_is_seeded():
    x = signal(3000, "tone").astype(np.int16)
    a = augment.channel(x, "v", 1, gain_db=-6, snr=20, lead=100)
    assert (a == augment.channel(x, "v", 1, gain_db=-6, snr=20, lead=100)).all() and len(a) == 3100
    assert not (a == augment.channel(x, "v", 2, gain_db=-6, snr=20, lead=100)).all()
    assert augment.snr_db(x, x) == float("inf") and augment.level(np.zeros(3)) == -120.0
    y, starts = augment.spliced([x[:100], x[100:300]], 10)
    assert len(y) == 290 and starts == [0, 90]
    assert (augment.shifted(np.arange(6).reshape(3, 2), 1) == [[0, 0], [0, 1], [2, 3]]).all()
    assert len(augment.trimmed(np.array([0, 0, 9, 0, 9, 0, 0]), 5, 1)) == 4
