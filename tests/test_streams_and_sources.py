import json
import os
import struct

import numpy as np
import pytest

from utterloom.operators import codec, rules
from utterloom.sources import audio, logs, manifests
from utterloom.streaming import conversation, endpointing, policies

SCRIPT = "(NONE (GO ON.) (MORE?)) (SUB MY YOUR) (MY ((0 YOUR 0) (WHY YOUR 3?) (AND?)))"


def drained(frames, name, mode):
    q = frames.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return frames.sparkSession.table(name).collect()


def files(tmp_path, rows, per):
    at = tmp_path / "in"
    at.mkdir()
    for i in range(0, len(rows), per):
        (at / f"{i:04d}.json").write_text("\n".join(map(json.dumps, rows[i : i + per])))
        os.utime(at / f"{i:04d}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # streams read files in order of their times
    return str(at)


def test_stream_of_conversations_equals_batch(spark, tmp_path):
    rows = [{"conv_id": c, "turn": t, "text": x} for t, x in enumerate(["my dog", "hm", "my cat", "my dog", "oh"]) for c in (1, 2)]
    schema = "conv_id long, turn long, text string"
    at, script = files(tmp_path, rows, 3), rules.compile_script(SCRIPT)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(at)
    got = {(r.conv_id, r.turn, r.reply) for r in drained(conversation.reply_stream(stream, script), "replies", "append")}
    assert got == {(r.conv_id, r.turn, r.reply) for r in rules.replies(spark.createDataFrame([tuple(r.values()) for r in rows], schema), script).collect()}


def talk():
    rng = np.random.default_rng(4)
    x = rng.integers(-60, 60, 160 * 140)
    x[160 * 50 : 160 * 80] += (8000 * np.sin(np.arange(160 * 30) * 0.3)).astype(int)
    return x


@pytest.mark.parametrize("size", [1, 97, 160, 4096])
def test_detector_does_not_depend_on_chunks(size):
    x, live, whole = talk(), endpointing.Live(), endpointing.Live()
    whole.feed(x)
    step = size if size > 50 else 1600 + size
    for i in range(0, len(x), step):
        live.feed(x[i : i + step])
    assert (live.state, live.frames, live.floor) == (whole.state, whole.frames, whole.floor) and whole.state == endpointing.DONE


def test_detector_ignores_clicks_and_muted_frames():
    live = endpointing.Live()
    x = np.full(160 * 120, 40)
    x[160 * 60 : 160 * 62] = 20_000
    live.feed(x)
    assert live.state == endpointing.IDLE
    muted = endpointing.Live()
    assert muted.feed(x, muted=True) == 0 and muted.frames == 0 and not muted.rest


def test_stream_of_captures(spark, tmp_path):
    x = talk().tolist()
    rows = [{"key": "a", "seq": i, "samples": x[i * 2000 : (i + 1) * 2000], "muted": False} for i in range(12)]
    stream = spark.readStream.schema("key string, seq long, samples array<int>, muted boolean").option("maxFilesPerTrigger", 1).json(files(tmp_path, rows, 4))
    got = drained(endpointing.capture_stream(stream), "captures", "update")
    whole = endpointing.Live()
    whole.feed(x)
    assert (max(got, key=lambda r: r.frames).state, max(r.frames for r in got)) == (whole.state, whole.frames)


def test_policies():
    sounds = list(policies.alternates("k", 400))
    gaps = np.diff([-1, *[i for i, s in enumerate(sounds) if s]])
    assert any(sounds) and gaps.min() > 5
    assert list(policies.refreshes([0, 1, 2, 70], 2)) == ["full", "partial", "partial", "full"]
    picks = list(policies.unrepeated("k", 200, 3))
    assert set(picks) == {0, 1, 2} and all(a != b for a, b in zip(picks, picks[1:]))


def test_edges(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, t, v) for t, v in ((0, 0), (1, 1), (2, 1), (3, 0), (4, 1), (40, 1), (41, 1))], "k int, t long, v int")
    rows = rows.withColumn("at", F.timestamp_seconds("t"))
    assert [r.t for r in policies.edges(rows, "k", "at", F.col("v") == 1).orderBy("t").collect()] == [1, 4, 40]


def test_wavs_captures_and_archives(spark, tmp_path):
    x = np.array([0, 1, -32768, 32767, 5], np.int16)
    (tmp_path / "a.wav").write_bytes(audio.wav_bytes(x))
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.read_wavs(spark, str(tmp_path)).collect()}
    assert got["a.wav"].samples == x.tolist() and got["a.wav"].error is None and got["b.wav"].error and got["b.wav"].samples is None
    body = struct.pack("<II", 16_000, 5) + x.astype("<i2").tobytes()
    assert audio.capture(b"noise" + audio.START + body + audio.STOP)[1].tolist() == x.tolist()
    for bad in (b"", audio.START + b"\0", audio.START + body[:-2], audio.START + body + b"??????", audio.START + struct.pack("<II", 16_000, 10**8), b"z" + audio.ERROR + b" no mic\n"):
        with pytest.raises(ValueError):
            audio.capture(bad)
    (tmp_path / "pak").mkdir()
    (tmp_path / "pak" / "v.pak").write_bytes(codec.pack_archive([("c" * 8, codec.encode(x), 5)]))
    assert [(r.id, r.n_samples, codec.decode(bytes(r.blob))[0]) for r in audio.read_archives(spark, str(tmp_path / "pak")).collect()] == [("cccccccc", 5, 0)]


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"entries": [{"wav": "x.wav", "class": "yes", "speaker": "v", "snr_db": 3}, {"wav": "/abs.wav", "class": "no", "speaker": None, "snr_db": None}]}))
    rows = manifests.read_manifest(spark, str(tmp_path / "m.json"), "/root")
    assert [(r.file, r.label, r.voice, r.split, r.snr_db) for r in rows.orderBy("label").collect()] == [("/abs.wav", "no", None, None, None), ("/root/x.wav", "yes", "v", None, 3)]
    vocabulary = spark.createDataFrame([("yes", "YES", "word"), ("no", "NO", "variant")], "form string, class string, kind string")
    assert {r.label: r["class"] for r in manifests.classed(rows, vocabulary).collect()} == {"yes": "YES", "no": "unknown"}
    there, gone = manifests.present(rows, spark.createDataFrame([("/abs.wav",)], "file string"))
    assert there.count() == 1 and gone.first().missing == 1
    with pytest.raises(ValueError):
        manifests.chosen(rows, "human")


def test_feature_cache(spark, tmp_path):
    calls = []

    def make(n):
        def run():
            calls.append(n)
            return spark.range(n)

        return run

    at = str(tmp_path / "cache")
    assert [manifests.cached_features(spark, at, {"fft": 512}, make(3)).count() for _ in range(2)] == [3, 3] and calls == [3]
    assert manifests.cached_features(spark, at, {"fft": 256}, make(4)).count() == 4 and calls == [3, 4]


def test_score_logs(spark):
    lines = spark.createDataFrame([("noise",), ("SCORE runtime=a set=x name=n frames=3 clipped=0 us=9 q=256,0",), ("SCORE runtime=b set=x name=n p=0.5,0.25",)], "value string")
    assert [(r.name, r.runtime, r.p) for r in logs.score_rows(lines, 2).collect()] == [("n", "a", [1.0, 0.0]), ("n", "b", [0.5, 0.25])]
    assert logs.score_rows(lines, only_runtime="b").count() == 1
    with pytest.raises(Exception, match="wrong number"):
        logs.score_rows(lines, 3).collect()
    case = logs.case_rows(spark.createDataFrame([("CASE a 00ff",), ("CASE b zz",)], "value string")).collect()
    assert case[0].payload == b"\x00\xff" and case[1].payload is None
