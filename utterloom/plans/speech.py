"""The fixed-point speech pipeline, warping, the codec and the live detector, each against SQL that does the same in tables.

A thousand events in order of their ids are an utterance; values become 16-bit samples with
the sign of every third turned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.functions import augment, dsp
from utterloom.functions import numeric as nu
from utterloom.operators import codec, warping
from utterloom.operators.matching import small_rows
from utterloom.plans.registry import query, table
from utterloom.plans.signals import ARRAYS, arrays
from utterloom.sources import audio
from utterloom.streaming import endpointing

LONG = 1000
VALUE = "floor(value * 40 + 0.5)::BIGINT * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """utt_id, samples."""
    x = F.floor(F.col("value") * 40 + 0.5).cast("int") * F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    rows = table(spark, sf_dir, "events").select(F.expr(f"event_id div {LONG}").alias("utt_id"), (F.col("event_id") % LONG).alias("i"), x.alias("x"))
    rows = rows.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return rows.select("utt_id", F.transform("s", lambda r: r["x"]).alias("samples"))


# ---- features ---------------------------------------------------------------

BITS = " + ".join(f"(((n >> {i}) & 1) << {8 - i})" for i in range(9))
STAGES = ",\n".join(
    f"""a{k + 1} AS MATERIALIZED (SELECT utt, frame, unnest([j, l]) AS j, unnest([(jr + tr + 1) >> 1, (jr - tr + 1) >> 1]) AS re, unnest([(ji + ti + 1) >> 1, (ji - ti + 1) >> 1]) AS im
  FROM (SELECT a.utt, a.frame, a.j, b.j AS l, a.re AS jr, a.im AS ji, (wr * b.re - wi * b.im + 16384) >> 15 AS tr, (wr * b.im + wi * b.re + 16384) >> 15 AS ti
    FROM a{k} a JOIN a{k} b ON a.utt = b.utt AND a.frame = b.frame AND b.j = a.j + {1 << k} JOIN tw ON tw.k = (a.j % {1 << k}) * {256 >> k} WHERE a.j % {2 << k} < {1 << k}))"""
    for k in range(9)
)
MEL = "(2595 * log10(1 + {0} / 700.0))"
LOGS = f"""s AS (SELECT event_id // {LONG} AS utt, event_id % {LONG} AS i, {VALUE} AS x FROM events),
p AS (SELECT utt, i, greatest(-32768, least(32767, x - ((31785 * coalesce(lag(x) OVER (PARTITION BY utt ORDER BY i), x)) >> 15))) AS y FROM s),
f AS (SELECT utt, unnest(range(0, CASE WHEN count(*) < 400 THEN 0 ELSE 1 + (count(*) - 400) // 160 END)) AS frame FROM s GROUP BY utt),
w AS MATERIALIZED (SELECT f.utt, frame, i - frame * 160 AS n, (y * round((0.54 - 0.46 * cos(2 * pi() * (i - frame * 160) / 399)) * 32767)::BIGINT + 16384) >> 15 AS v FROM f JOIN p ON p.utt = f.utt AND p.i >= frame * 160 AND p.i < frame * 160 + 400),
g AS MATERIALIZED (SELECT utt, frame, CASE WHEN max(abs(v)) = 0 THEN 0 ELSE greatest(0, 15 - length(bin(max(abs(v))))) END AS g FROM w GROUP BY 1, 2),
a0 AS MATERIALIZED (SELECT g.utt, g.frame, {BITS} AS j, coalesce(v, 0) * (1::BIGINT << g) AS re, 0::BIGINT AS im FROM (SELECT *, unnest(range(0, 512)) AS n FROM g) g LEFT JOIN w USING (utt, frame, n)),
tw AS MATERIALIZED (SELECT k, round(32767 * cos(2 * pi() * k / 512))::BIGINT AS wr, round(-32767 * sin(2 * pi() * k / 512))::BIGINT AS wi FROM (SELECT unnest(range(0, 256)) AS k)),
{STAGES},
m AS (SELECT utt, frame, j, m + (q - m * m > m)::BIGINT AS mag FROM (SELECT *, floor(sqrt(q))::BIGINT AS m FROM (SELECT utt, frame, j, re * re + im * im AS q FROM a9 WHERE j <= 256))),
e AS (SELECT unnest(range(0, 28)) AS n), ed AS (SELECT n, 700 * (power(10, ({MEL.format(100.0)} + ({MEL.format(7600.0)} - {MEL.format(100.0)}) * n / 27) / 2595) - 1) AS hz FROM e),
b AS MATERIALIZED (SELECT lo.n AS band, j, round(32768 * greatest(0, least(1, CASE WHEN j * 31.25 <= mi.hz THEN (j * 31.25 - lo.hz) / (mi.hz - lo.hz) ELSE (hi.hz - j * 31.25) / (hi.hz - mi.hz) END)))::BIGINT AS bw
  FROM ed lo JOIN ed mi ON mi.n = lo.n + 1 JOIN ed hi ON hi.n = lo.n + 2, (SELECT unnest(range(0, 257)) AS j)),
t AS (SELECT list(round(256 * log2(1 + n / 64))::BIGINT ORDER BY n) AS t FROM (SELECT unnest(range(0, 65)) AS n)),
ml AS (SELECT utt, frame, band, greatest(1, sum((mag * bw + 128) >> 8))::BIGINT AS v FROM m JOIN b USING (j) WHERE bw > 0 GROUP BY 1, 2, 3),
me AS (SELECT utt, frame, band, length(bin(v)) - 1 AS e, CASE WHEN length(bin(v)) > 17 THEN v >> (length(bin(v)) - 17) ELSE v << (17 - length(bin(v))) END AS c FROM ml),
logs AS MATERIALIZED (SELECT utt, frame, band, (e * 256 + t[(c >> 10) - 63] + (((t[(c >> 10) - 62] - t[(c >> 10) - 63]) * (c & 1023) + 512) >> 10) + (2 - g) * 256)::BIGINT AS v FROM me JOIN g USING (utt, frame), t)"""
CEPSTRA = f"""{LOGS},
cep AS MATERIALIZED (SELECT utt, frame, j, sum((v * round(32767 * cos(pi() * j * (band + 0.5) / 26))::BIGINT + 16384) >> 15)::BIGINT AS c FROM logs, (SELECT unnest(range(1, 13)) AS j) GROUP BY 1, 2, 3)"""


def long(rows: DataFrame, name: str, first: int = 0) -> DataFrame:
    out = rows.select(F.col("utt_id").alias("utt"), F.col("frame_no").cast("long").alias("frame"), F.posexplode("vec").alias("pos", "v"))
    return out.select("utt", "frame", (F.col("pos") + first).cast("long").alias(name), F.col("v").cast("long").alias("v"))


@query("log_mel", f"WITH {LOGS} SELECT utt, frame, band, v FROM logs")
def log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window, block scaling, transform, magnitude, bands and logarithm of every frame."""
    return long(dsp.with_rows(utterances(spark, sf_dir), dsp.log_mel), "band")


@query("cepstra", f"WITH {CEPSTRA} SELECT utt, frame, j, c AS v FROM cep")
def cepstra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(dsp.with_rows(utterances(spark, sf_dir), lambda x: dsp.cepstra(dsp.log_mel(x))), "j", 1)


@query(
    "speech_features",
    f"""WITH {CEPSTRA}, z AS (SELECT utt, frame, j, c - (sum(c) OVER (PARTITION BY utt, j) // count(*) OVER (PARTITION BY utt, j))::BIGINT AS c FROM cep),
    n AS (SELECT *, first_value(c) OVER x AS a, last_value(c) OVER x AS b FROM z WINDOW x AS (PARTITION BY utt, j ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    d AS (SELECT utt, frame, j, c, ((coalesce(lead(c) OVER y, b) - coalesce(lag(c) OVER y, a) + 2 * (coalesce(lead(c, 2) OVER y, b) - coalesce(lag(c, 2) OVER y, a))) * 3277 + 16384) >> 15 AS d FROM n WINDOW y AS (PARTITION BY utt, j ORDER BY frame))
    SELECT utt, frame, j - 1 AS j, (c + 8) >> 4 AS v FROM d UNION ALL SELECT utt, frame, j + 11, (d + 2) >> 2 FROM d""",
)
def speech_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(dsp.with_features(utterances(spark, sf_dir)), "j")


@query(
    "speech_patch",
    f"""WITH {LOGS}, r AS (SELECT utt, frame, band, (v - (sum(v) OVER (PARTITION BY utt, band) // count(*) OVER (PARTITION BY utt, band))::BIGINT + 8) >> 4 AS raw FROM logs),
    n AS (SELECT utt, max(frame) + 1 AS n FROM r GROUP BY 1)
    SELECT utt, n AS n_frames, (count(*) FILTER (WHERE raw NOT BETWEEN -128 AND 127))::BIGINT AS clipped,
      repeat('00', (26 * ((80 - n) // 2))::BIGINT) || string_agg(printf('%02X', greatest(-128, least(127, raw)) & 255), '' ORDER BY frame, band) || repeat('00', (26 * (80 - n - (80 - n) // 2))::BIGINT) AS patch
    FROM r JOIN n USING (utt) GROUP BY utt, n""",
)
def speech_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dsp.with_patches(utterances(spark, sf_dir)).where("n_frames > 0")
    return rows.select(F.col("utt_id").alias("utt"), F.col("n_frames").cast("long").alias("n_frames"), F.col("clipped").cast("long").alias("clipped"), F.hex("patch").alias("patch"))


@query("lifter_gains", "SELECT l AS length, j, CASE WHEN l = 0 THEN 4096 ELSE round(4096 * (1 + l / 2 * sin(pi() * j / l))) END::BIGINT AS gain FROM (SELECT unnest([0, 12, 22, 30]) AS l), (SELECT unnest(range(1, 13)) AS j)")
def lifter_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, j + 1, int(g)) for n in (0, 12, 22, 30) for j, g in enumerate(dsp.lifter(n))], "length int, j long, gain long")


@query(
    "test_signal",
    """WITH RECURSIVE g(seed, i, s) AS (SELECT r_regionkey * 77 + 5, -1, (r_regionkey * 77 + 5)::BIGINT FROM region UNION ALL SELECT seed, i + 1, (1103515245 * s + 12345) & 2147483647 FROM g WHERE i < 799)
    SELECT seed, i::BIGINT AS i, greatest(-32768, least(32767, trunc((7000 * sin(2 * pi() * 320 * i / 16000) + 3500 * sin(2 * pi() * 1180 * i / 16000) + 1500 * sin(2 * pi() * 2600 * i / 16000)) * (0.5 - 0.5 * cos(2 * pi() * i / 800)))::BIGINT + (s >> 16) % 401 - 200)) AS x FROM g WHERE i >= 0""",
)
def test_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test signal of 800 samples for five seeds."""

    @F.pandas_udf("array<long>")
    def made(seed):
        return seed.map(lambda s: dsp.signal(800, int(s)))

    rows = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 77 + 5).alias("seed"))
    return rows.select("seed", F.posexplode(made("seed")).alias("i", "x")).select("seed", F.col("i").cast("long").alias("i"), "x")


test_signal.__test__ = False


@query(
    "trim_peak_fade",
    f"""WITH {ARRAYS}, l AS (SELECT user_id, list_transform(v, lambda x: greatest(-32768, least(32767, x // 8))) AS v FROM a),
    h AS (SELECT *, list_filter(range(0, len(v)), lambda i: abs(v[i + 1]) >= 20000) AS loud FROM l),
    t AS (SELECT user_id, CASE WHEN len(loud) = 0 THEN [] ELSE v[greatest(0, loud[1] - 3) + 1 : loud[-1] + 3] END AS t FROM h),
    k AS (SELECT *, coalesce(list_max(list_transform(t, lambda x: abs(x))), 0) AS top FROM t),
    p AS (SELECT user_id, CASE WHEN top = 0 THEN t ELSE list_transform(t, lambda x: trunc(x * (29491 / top))::BIGINT) END AS p FROM k)
    SELECT user_id, len(p)::BIGINT AS n, coalesce(list_sum(list_transform(p, lambda x, i: x * i)), 0)::BIGINT AS weighed, coalesce(list_max(list_transform(p, lambda x: abs(x))), 0)::BIGINT AS peak,
      coalesce(list_sum(list_transform(p, lambda x, i: i * round_even(x * CASE WHEN least(5, len(p) // 2) = 0 THEN 1.0 ELSE least(1.0, (i - 1) / least(5, len(p) // 2), (len(p) - i) / least(5, len(p) // 2)) END, 0))), 0)::BIGINT AS faded FROM p""",
)
def trim_peak_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's capture trimmed around what is loud, scaled to a peak, and faded at both ends, as sums weighed by place."""
    rows = clips(spark, sf_dir).select(F.col("id").alias("user_id"), F.col("pcm").alias("v"))

    @F.pandas_udf("array<long>")
    def made(v):
        return v.map(lambda x: augment.peaked(augment.trimmed(np.asarray(x, np.int64), 20_000, 3)).astype(np.int64))

    @F.pandas_udf("array<long>")
    def faded(p):
        return p.map(lambda x: augment.faded(np.asarray(x, np.int64), 5).astype(np.int64))

    weighed = lambda c: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumn("p", made("v")).withColumn("f", faded("p"))
    return rows.select("user_id", F.size("p").cast("long").alias("n"), weighed("p").alias("weighed"), F.coalesce(F.array_max(F.transform("p", lambda x: F.abs(x))), F.lit(0)).cast("long").alias("peak"), weighed("f").alias("faded"))


# ---- warping ----------------------------------------------------------------

DTW_BAND = 2


@query(
    "warped_distance",
    f"""WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 64 + 0.5)::BIGINT) AS q FROM embeddings),
    lib AS (SELECT label, arg_min(q, vec_id) AS t FROM v GROUP BY 1),
    d AS (SELECT vec_id AS query, lib.label, list_transform(range(0, 64), lambda c: list_sum(list_transform(range(1, 9), lambda k: abs(q[(c // 8) * 8 + k] - t[(c % 8) * 8 + k])))::BIGINT) AS d FROM v, lib),
    r(query, label, k, cells) AS (SELECT query, label, 0, [2 * d[1]] FROM d UNION ALL
      SELECT r.query, r.label, k + 1, list_append(cells, CASE WHEN abs((k + 1) % 8 - (k + 1) // 8) > {DTW_BAND} THEN {1 << 29} ELSE least({1 << 29},
        CASE WHEN k + 1 >= 8 THEN cells[k + 1 - 7] + d[k + 2] ELSE {1 << 29} END, CASE WHEN (k + 1) % 8 > 0 THEN cells[k + 1] + d[k + 2] ELSE {1 << 29} END,
        CASE WHEN k + 1 >= 8 AND (k + 1) % 8 > 0 THEN cells[k + 1 - 8] + 2 * d[k + 2] ELSE {1 << 29} END) END)
      FROM r JOIN d ON r.query = d.query AND r.label = d.label WHERE k < 63)
    SELECT query, label::VARCHAR AS label, CASE WHEN cells[64] >= {1 << 29} THEN {1 << 29} ELSE cells[64] // 16 END::BIGINT AS score FROM r WHERE k = 63""",
)
def warped_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as eight frames of eight bands, warped onto the first vector of every label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64 + 0.5).cast("int")).alias("q"))
    library = small_rows(v.groupBy("label").agg(F.min_by("q", "vec_id").alias("t")))
    templates = [(str(r.label), np.array(r.t).reshape(8, 8)) for r in library]
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("q", i * 8 + 1, 8))
    return warping.class_distances(v.select(F.col("vec_id").alias("query"), frames.alias("frames")), templates, DTW_BAND)


# ---- codec and containers ---------------------------------------------------

STEPS, MOVES = (str(list(x)) for x in (codec.STEPS, codec.MOVES))
CLIPS = f"{ARRAYS}, c AS (SELECT user_id, list_transform(v, lambda x: greatest(-32768, least(32767, x // 8))) AS v FROM a)"
LE16 = "printf('%02X%02X', {0} & 255, ({0} >> 8) & 255)"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pcm: each user's values as a clip."""
    eighth = lambda x: nu.clamp16(F.when(x < 0, -F.floor(-x / 8)).otherwise(F.floor(x / 8))).cast("int")
    return arrays(spark, sf_dir).select(F.col("user_id").alias("id"), F.transform("v", eighth).alias("pcm"))


@query(
    "adpcm_clips",
    f"""WITH RECURSIVE {CLIPS}, steps AS (SELECT {STEPS} AS st, {MOVES} AS mv),
    r(user_id, i, value, idx, code) AS (SELECT user_id, 1::BIGINT, v[1], 0::BIGINT, NULL::BIGINT FROM c UNION ALL
      SELECT user_id, i, greatest(-32768, least(32767, CASE WHEN code >= 8 THEN value - change ELSE value + change END)), greatest(0, least(88, idx + mv[(code & 7) + 1])), code FROM (
        SELECT *, (step >> 3) + CASE WHEN code & 4 > 0 THEN step ELSE 0 END + CASE WHEN code & 2 > 0 THEN step >> 1 ELSE 0 END + CASE WHEN code & 1 > 0 THEN step >> 2 ELSE 0 END AS change FROM (
          SELECT *, sign + b4 + b2 + CASE WHEN e2 >= step >> 2 THEN 1 ELSE 0 END AS code FROM (
            SELECT *, CASE WHEN e1 >= step >> 1 THEN 2 ELSE 0 END AS b2, CASE WHEN e1 >= step >> 1 THEN e1 - (step >> 1) ELSE e1 END AS e2 FROM (
              SELECT *, CASE WHEN e0 >= step THEN 4 ELSE 0 END AS b4, CASE WHEN e0 >= step THEN e0 - step ELSE e0 END AS e1 FROM (
                SELECT r.user_id, r.i + 1 AS i, r.value, r.idx, st[r.idx + 1]::BIGINT AS step, mv, abs(c.v[r.i + 1] - r.value) AS e0, CASE WHEN c.v[r.i + 1] < r.value THEN 8 ELSE 0 END AS sign
                FROM r JOIN c ON c.user_id = r.user_id, steps WHERE r.i < len(c.v))))))),
    o AS (SELECT user_id, list(value ORDER BY i) AS pcm, list(coalesce(code, 0) ORDER BY i)[2:] AS codes FROM r GROUP BY 1)
    SELECT o.user_id, len(pcm)::BIGINT AS n, {LE16.format("len(pcm)")} || '0000' || {LE16.format("(pcm[1])")} || '0000' || array_to_string(list_transform(range(0, (len(codes) + 1) // 2), lambda k: printf('%02X', codes[2 * k + 1] | (coalesce(codes[2 * k + 2], 0) << 4))), '') AS blob,
      list_reduce(list_concat([0::BIGINT], pcm), lambda x, y: (x * 31 + y) & 1073741823) AS decoded FROM o""",
)
def adpcm_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips encoded in four bits, and a checksum of what decoding gives back."""
    rows = codec.decoded(codec.encoded(clips(spark, sf_dir)).drop("pcm"))
    return rows.select(F.col("id").alias("user_id"), F.col("n_samples").cast("long").alias("n"), F.hex("blob").alias("blob"), nu.checksum31(F.transform("pcm", lambda x: x.cast("long"))).alias("decoded"))


SUMMED = f"WITH {CLIPS} SELECT user_id, len(v)::BIGINT AS n, list_reduce(list_concat([0::BIGINT], v), lambda x, y: (x * 31 + y) & 1073741823) AS checksum, NULL::VARCHAR AS error FROM c"


def summed(rows: DataFrame) -> DataFrame:
    total = nu.checksum31(F.transform("samples", lambda x: x.cast("long")))
    return rows.select(F.col("path").cast("long").alias("user_id"), F.size("samples").cast("long").alias("n"), total.alias("checksum"), "error")


@query("wav_round_trip", SUMMED)
def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's clip written as a WAV file and read again."""

    @F.pandas_udf("binary")
    def written(pcm):
        return pcm.map(audio.wav_bytes)

    files = clips(spark, sf_dir).select(F.col("id").cast("string").alias("path"), written("pcm").alias("content"))
    return summed(audio.parsed(files, lambda data: (audio.RATE, audio.wav_samples(data))))


@query("capture_parse", f"SELECT user_id, CASE WHEN user_id % 4 > 0 THEN n END AS n, CASE WHEN user_id % 4 > 0 THEN checksum END AS checksum, CASE WHEN user_id % 4 = 0 THEN (n - 1) || ' of ' || n || ' samples' END AS error FROM ({SUMMED})")
def capture_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framed captures with noise before them; every fourth has lost its end."""

    @F.pandas_udf("binary")
    def framed(key, pcm):
        whole = [b"noise" + audio.START + np.array([audio.RATE, len(x)], "<u4").tobytes() + np.asarray(x, "<i2").tobytes() + audio.STOP for x in pcm]
        return type(pcm)([w[: -len(audio.STOP) - 1] if k % 4 == 0 else w for k, w in zip(key, whole)])

    files = clips(spark, sf_dir).select(F.col("id").cast("string").alias("path"), framed("id", "pcm").alias("content"))
    return summed(audio.parsed(files, audio.capture))


@query("pak_round_trip", f"SELECT n_nationkey % 5 AS pak, lpad(n_nationkey::VARCHAR, 8, '0') AS id, (n_nationkey * 7 + 3)::BIGINT AS n_samples, 8 + CASE WHEN n_nationkey * 7 + 3 > 1 THEN (n_nationkey * 7 + 3) // 2 ELSE 0 END::BIGINT AS length FROM nation")
def pak_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of a few clips each, packed and opened again."""

    def run(rows):
        import pandas as pd

        made = [(f"{k:08d}", codec.encode(range(k * 7 + 3)), k * 7 + 3) for k in rows["n_nationkey"]]
        opened = codec.open_archive(codec.pack_archive(made))[1]
        if opened != sorted(made):
            raise ValueError("an archive came back changed")
        return pd.DataFrame([(rows["pak"].iloc[0], key, n, len(blob)) for key, blob, n in opened], columns=["pak", "id", "n_samples", "length"])

    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("pak"))
    return rows.groupBy("pak").applyInPandas(run, f"pak {dict(rows.dtypes)['pak']}, id string, n_samples long, length long")


@query("blob_lengths", "SELECT doc_id, (8 + CASE WHEN n_chars > 1 THEN n_chars // 2 ELSE 0 END)::BIGINT AS length, ((8 + CASE WHEN n_chars > 1 THEN n_chars // 2 ELSE 0 END + 3) // 4 * 4)::BIGINT AS aligned FROM documents")
def blob_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", nu.clip_bytes(F.col("n_chars")).alias("length"))
    return rows.withColumn("aligned", nu.aligned(F.col("length")))


# ---- live detector ----------------------------------------------------------

LOUD = "floor(value + 0.5)::BIGINT * 40 * CASE WHEN i BETWEEN 40 AND 70 THEN 60 ELSE 1 END"


@query(
    "live_detector",
    f"""WITH RECURSIVE o AS (SELECT user_id // 3 AS key, value, row_number() OVER (PARTITION BY user_id // 3 ORDER BY ts, event_id) - 1 AS i FROM events),
    s AS (SELECT key, i, {LOUD} AS x FROM o), n AS (SELECT key, count(*) AS n FROM s GROUP BY 1),
    u AS MATERIALIZED (SELECT key, i // 2 + 1 AS k, sum(abs(x))::BIGINT AS e FROM s GROUP BY 1, 2 HAVING count(*) = 2),
    r(key, k, state, floor, loud, quiet, speech) AS (SELECT key, 0::BIGINT, 'idle', 0::BIGINT, 0, 0, 0 FROM n UNION ALL
      SELECT key, k, CASE WHEN state = 'idle' AND up >= 3 THEN 'speaking' WHEN state = 'speaking' AND down >= 20 THEN CASE WHEN speech >= 7 THEN 'done' ELSE 'idle' END ELSE state END,
        CASE WHEN k <= 15 THEN greatest(10240, least(640000, CASE WHEN k = 1 THEN e ELSE floor + ((e - floor) >> 5) END)) ELSE floor END,
        CASE WHEN state = 'speaking' AND down >= 20 THEN 0 ELSE up END, CASE WHEN state = 'idle' AND up >= 3 THEN 0 WHEN state = 'speaking' AND down >= 20 THEN 0 ELSE down END,
        CASE WHEN state = 'idle' AND up >= 3 THEN up WHEN state = 'speaking' AND k > 15 AND e >= 2 * floor THEN speech + 1 ELSE speech END
      FROM (SELECT r.key, u.k, u.e, state, floor, speech, CASE WHEN u.k > 15 AND state = 'idle' THEN CASE WHEN u.e > 4 * floor THEN loud + 1 ELSE 0 END ELSE loud END AS up,
          CASE WHEN state = 'speaking' THEN CASE WHEN u.e >= 2 * floor THEN 0 ELSE quiet + 1 END ELSE quiet END AS down
        FROM r JOIN u ON u.key = r.key AND u.k = r.k + 1 WHERE state <> 'done'))
    SELECT key, last.state AS state, CASE WHEN last.state = 'done' THEN last.k * 2 ELSE n END::BIGINT AS frames, last.floor AS floor FROM (SELECT key, arg_max({{'state': state, 'k': k, 'floor': floor}}, k) AS last FROM r GROUP BY 1) JOIN n USING (key)""",
)
def live_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live detector over each three users' values in order, in chunks of seven samples, with a frame a sample."""
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("key").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").withColumn("key", F.expr("user_id div 3")).withColumn("i", i)
    x = (F.floor(F.col("value") + 0.5) * 40 * F.when(F.col("i").between(40, 70), 60).otherwise(1)).cast("long")
    rows = rows.select("key", "i", F.floor(F.col("i") / 7).alias("seq"), x.alias("x")).groupBy("key", "seq").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    chunks = rows.select("key", "seq", F.transform("s", lambda r: r["x"]).alias("samples"), F.lit(False).alias("muted"))
    return endpointing.captures(chunks, 1)
