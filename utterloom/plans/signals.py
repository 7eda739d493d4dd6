"""Frames, windows and endpoints over events: each user's values, in order of time, are a capture.

Values become integers by their squares, for the range that a recording has, with the sign
of every third event turned; frames are 4 values, since a user has only some dozens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.functions import numeric as nu
from utterloom.operators import endpoints as ep
from utterloom.operators import frames as fr
from utterloom.plans.registry import query, table

SIZE = 4
SAMPLES = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, floor(value * value + 0.5)::BIGINT * CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS x FROM events)"
FRAMES = f"""f AS (SELECT user_id, i // {SIZE} AS frame, sum(abs(x))::BIGINT AS energy, sum(turn)::BIGINT AS crossings
  FROM (SELECT *, CASE WHEN i % {SIZE} > 0 AND (x < 0) <> (lag(x) OVER (PARTITION BY user_id ORDER BY i) < 0) THEN 1 ELSE 0 END AS turn FROM s)
  GROUP BY 1, 2 HAVING count(*) = {SIZE})"""
QUIET = 3
LIMITS = f"""m AS (SELECT user_id, count(*) AS n, max(energy) AS imx, (sum(energy) FILTER (WHERE frame < {QUIET}) // count(*) FILTER (WHERE frame < {QUIET}))::BIGINT AS em,
    (sum(crossings) FILTER (WHERE frame < {QUIET}) // count(*) FILTER (WHERE frame < {QUIET}))::BIGINT AS cm FROM f GROUP BY 1),
d AS (SELECT user_id, floor(sqrt(sum((energy - em) * (energy - em)) // count(*)))::BIGINT AS es, floor(sqrt(sum((crossings - cm) * (crossings - cm)) // count(*)))::BIGINT AS cs FROM f JOIN m USING (user_id) WHERE frame < {QUIET} GROUP BY 1),
l AS (SELECT user_id, n, itl, itl * 5 AS itu, greatest(cm + 2 * cs, 25)::BIGINT AS izct, greatest(em + 4 * es, em + (em >> 3))::BIGINT AS egate
  FROM (SELECT *, greatest(1, least((floor(3 * (imx - em) / 100))::BIGINT + em, 4 * em))::BIGINT AS itl FROM m JOIN d USING (user_id)))"""
ONSETS = """r AS (SELECT user_id, frame, energy > itu AS loud, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM f JOIN l USING (user_id) WHERE energy > itl),
o AS (SELECT user_id, min(a) AS "first", max(b) AS "last" FROM (SELECT user_id, run, min(frame) AS a, max(frame) AS b FROM r GROUP BY 1, 2 HAVING bool_or(loud)) GROUP BY 1)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.floor(F.col("value") * F.col("value") + 0.5).cast("long") * F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    return fr.numbered(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], value)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.frame_stats(samples(spark, sf_dir), "user_id", SIZE)


@query("frame_stats", f"WITH {SAMPLES}, {FRAMES} SELECT user_id, frame, energy, crossings FROM f")
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir)


@query("live_units", f"WITH {SAMPLES}, {FRAMES} SELECT user_id, frame // 2 AS unit, sum(energy)::BIGINT AS energy FROM f GROUP BY 1, 2 HAVING count(*) = 2")
def live_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.units(stats(spark, sf_dir), "user_id")


@query("vad_thresholds", f"WITH {SAMPLES}, {FRAMES}, {LIMITS} SELECT user_id, n, itl, itu, izct, egate FROM l")
def vad_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.thresholds(stats(spark, sf_dir), "user_id", QUIET)


@query("energy_onset", f"WITH {SAMPLES}, {FRAMES}, {LIMITS}, {ONSETS} SELECT user_id, \"first\", \"last\" FROM o")
def energy_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.onsets(stats(spark, sf_dir), "user_id", QUIET)


BACKOFF = """n AS (SELECT f.user_id, frame FROM f JOIN l USING (user_id) WHERE crossings > {cross} AND energy > egate),
e AS (SELECT o.user_id, CASE WHEN count(n.frame) FILTER (WHERE n.frame < o."first" AND n.frame >= o."first" - {look}) >= {hits} THEN min(n.frame) FILTER (WHERE n.frame < o."first" AND n.frame >= o."first" - {look}) ELSE o."first" END AS "first",
    CASE WHEN count(n.frame) FILTER (WHERE n.frame > o."last" AND n.frame <= o."last" + {look}) >= {hits} THEN max(n.frame) FILTER (WHERE n.frame > o."last" AND n.frame <= o."last" + {look}) ELSE o."last" END AS "last"
  FROM {onsets} o LEFT JOIN n ON n.user_id = o.user_id GROUP BY o.user_id, o."first", o."last")"""


@query("zcr_backoff", f"WITH {SAMPLES}, {FRAMES}, {LIMITS}, {ONSETS}, {BACKOFF.format(cross=1, look=5, hits=1, onsets='o')} SELECT user_id, \"first\", \"last\" FROM e")
def zcr_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a crossing threshold of 1, since frames are short."""
    return ep.backoff(stats(spark, sf_dir), "user_id", QUIET, 1, 5, 1)


@query(
    "noise_floor_ema",
    f"""WITH {SAMPLES}, {FRAMES}, u AS (SELECT user_id, frame // 2 AS unit, sum(energy)::BIGINT AS energy FROM f GROUP BY 1, 2 HAVING count(*) = 2),
    a AS (SELECT user_id, list(energy ORDER BY unit) AS u FROM u WHERE unit < 4 GROUP BY 1)
    SELECT user_id, list_reduce(list_concat([greatest(1000, least(100000, u[1]))], u[2:]), lambda f, x: greatest(1000, least(100000, f + ((x - f) >> 5)))) AS floor FROM a""",
)
def noise_floor_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.noise_floor(fr.units(stats(spark, sf_dir), "user_id"), "user_id", 4, 5, 1000, 100_000)


@query(
    "endpoints",
    f"""WITH {SAMPLES}, {FRAMES}, {LIMITS}, {ONSETS}, oo AS (SELECT o.* FROM o JOIN l USING (user_id) WHERE n >= {QUIET} + 3 AND "last" > "first"), {BACKOFF.format(cross="izct", look=25, hits=3, onsets='oo')},
    g AS (SELECT user_id, greatest("first" - 1, 0) AS a, least("last" + 1, n - 1) AS b FROM e JOIN l USING (user_id)),
    w AS (SELECT user_id, frame, sum(energy) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS t, count(*) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k
      FROM f JOIN g USING (user_id) WHERE b - a + 1 > 8 AND frame BETWEEN a AND b),
    h AS (SELECT user_id, frame AS peak FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, frame) AS r FROM w WHERE k = 8) WHERE r = 1)
    SELECT user_id, (coalesce(peak, a) * {SIZE})::BIGINT AS start, ((CASE WHEN peak IS NOT NULL THEN peak + 7 ELSE b END + 1) * {SIZE})::BIGINT AS stop FROM g LEFT JOIN h USING (user_id) WHERE b - a + 1 >= 3""",
)
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.endpoints(stats(spark, sf_dir), "user_id", SIZE, QUIET, 1, 3, 8)


@query("loudest_window", f"WITH {SAMPLES}, w AS (SELECT user_id, i, sum(abs(x)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS t, count(*) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM s) SELECT user_id, i AS start, t::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, i) AS r FROM w WHERE n = 10) WHERE r = 1")
def loudest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.loudest(samples(spark, sf_dir).withColumn("x", F.abs("x")), "user_id", 10)


@query("preemphasis", f"WITH {SAMPLES} SELECT user_id, i, x, greatest(-32768, least(32767, x - ((coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY i), x) * 31785) >> 15))) AS y FROM s")
def preemphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.preemphasis(samples(spark, sf_dir), "user_id")


@query(
    "regression_deltas",
    f"""WITH {SAMPLES}, e AS (SELECT *, first_value(x) OVER w AS a, last_value(x) OVER w AS b FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT user_id, i, x, ((coalesce(lead(x) OVER p, b) - coalesce(lag(x) OVER p, a) + 2 * (coalesce(lead(x, 2) OVER p, b) - coalesce(lag(x, 2) OVER p, a))) * 3277 + 16384) >> 15 AS d FROM e WINDOW p AS (PARTITION BY user_id ORDER BY i)""",
)
def regression_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.deltas(samples(spark, sf_dir), "user_id")


@query("mean_removal", f"WITH {SAMPLES}, m AS (SELECT user_id, (sum(x) // count(*))::BIGINT AS m FROM s GROUP BY 1) SELECT user_id, i, x, x - m AS c FROM s JOIN m USING (user_id)")
def mean_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.without_mean(samples(spark, sf_dir), "user_id")


@query("int8_patch", f"WITH {SAMPLES}, m AS (SELECT user_id, (sum(x) // count(*))::BIGINT AS m FROM s GROUP BY 1), r AS (SELECT user_id, i, (x - m + 8) >> 4 AS raw FROM s JOIN m USING (user_id)) SELECT user_id, i, greatest(-128, least(127, raw)) AS q, raw < -128 OR raw > 127 AS clipped FROM r")
def int8_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.int8_patch(samples(spark, sf_dir), "user_id")


ARRAYS = f"{SAMPLES}, a AS (SELECT user_id, list(x ORDER BY i) AS v FROM s GROUP BY 1)"


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select("user_id", F.transform("v", lambda r: r["x"]).alias("v"))


@query("sliding_frames", f"WITH {ARRAYS} SELECT user_id, f AS frame, list_sum(v[16 * f + 1 : 16 * f + 40])::BIGINT AS total FROM (SELECT *, unnest(range(0, CASE WHEN len(v) < 40 THEN 0 ELSE 1 + (len(v) - 40) // 16 END)) AS f FROM a)")
def sliding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrays(spark, sf_dir).select("user_id", F.posexplode(fr.sliding(F.transform("v", lambda x: x.cast("int")), 40, 16)).alias("frame", "x"))
    return rows.select("user_id", F.col("frame").cast("long"), F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("pad_or_crop", f"""WITH {ARRAYS}, c AS (SELECT user_id, len(v) AS n, CASE WHEN len(v) >= 64 THEN v[(len(v) - 64) // 2 + 1 : (len(v) - 64) // 2 + 64]
    ELSE list_concat(list_concat(list_transform(range(0, (64 - len(v)) // 2), lambda i: 0::BIGINT), v), list_transform(range(0, (64 - len(v)) - (64 - len(v)) // 2), lambda i: 0::BIGINT)) END AS p FROM a)
    SELECT user_id, n, len(p) AS m, list_sum(list_transform(p, lambda x, i: x * i))::BIGINT AS weighed FROM c""")
def pad_or_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrays(spark, sf_dir).withColumn("p", fr.centred(F.col("v"), 64))
    weighed = F.aggregate(F.transform("p", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("user_id", F.size("v").cast("long").alias("n"), F.size("p").cast("long").alias("m"), weighed.alias("weighed"))


@query("poly31_checksum", f"WITH {ARRAYS} SELECT user_id, list_reduce(list_concat([0::BIGINT], v), lambda a, x: (a * 31 + x) & 1073741823) AS checksum FROM a")
def poly31_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays(spark, sf_dir).select("user_id", nu.checksum31(F.col("v")).alias("checksum"))


STATS = f"""c AS (SELECT user_id, count(*) AS n, min(x) AS low, max(x) AS high, avg(x) AS mean, sqrt(sum(x * x) / count(*)) AS rms, max(abs(x)) AS peak,
  (count(*) FILTER (WHERE abs(x) >= 32767))::BIGINT AS clipped, min(x) = max(x) AS flat FROM s GROUP BY 1)"""


@query("capture_stats", f"WITH {SAMPLES}, {STATS} SELECT user_id, n, low, high, round(mean, 6) AS mean, round(rms, 6) AS rms, peak, clipped, flat FROM c")
def capture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.capture_stats(samples(spark, sf_dir), "user_id").withColumns({"mean": F.round("mean", 6), "rms": F.round("rms", 6)})


@query("capture_verdict", f"WITH {SAMPLES}, {STATS} SELECT user_id, flat OR rms < 3000 AS fatal, concat_ws(',', CASE WHEN flat THEN 'flat' END, CASE WHEN rms < 3000 THEN 'too quiet' END, CASE WHEN clipped * 1000 > n THEN 'clipped' END, CASE WHEN abs(mean) > 1000 THEN 'offset' END) AS notes FROM c")
def capture_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.capture_verdict(fr.capture_stats(samples(spark, sf_dir), "user_id"), 3000, 1000).select("user_id", "fatal", F.array_join("notes", ",").alias("notes"))


@query("levels", f"WITH {SAMPLES}, l AS (SELECT user_id, avg(abs(x)) AS level FROM s GROUP BY 1) SELECT user_id, round(CASE WHEN level <= 0 THEN -120.0 ELSE 20 * log10(level / 32768) END, 6) AS dbfs FROM l")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).groupBy("user_id").agg(F.avg(F.abs("x")).alias("level"))
    return rows.select("user_id", F.round(nu.dbfs(F.col("level")), 6).alias("dbfs"))


@query("lower_median", f"WITH {ARRAYS} SELECT user_id, list_sort(v)[len(v) // 2 + 1] AS median FROM a")
def lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays(spark, sf_dir).select("user_id", nu.lower_median(F.col("v")).alias("median"))


@query("integer_functions", f"WITH {SAMPLES} SELECT user_id, i, floor(sqrt(abs(x)))::BIGINT AS root, CASE WHEN x <= 0 THEN 0 ELSE length(bin(x)) END::INTEGER AS bits, greatest(-32768, least(32767, x * 10)) AS clamped, round(2595 * log10(1 + abs(x) / 700), 6) AS mel FROM s")
def integer_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, x = samples(spark, sf_dir), F.col("x")
    return rows.select("user_id", "i", nu.isqrt(F.abs(x)).alias("root"), nu.bit_length(x).cast("int").alias("bits"), nu.clamp16(x * 10).alias("clamped"), F.round(nu.hz_to_mel(F.abs(x)), 6).alias("mel"))


@query(
    "lcg_sequence",
    "WITH RECURSIVE g(user_id, n, x) AS (SELECT DISTINCT user_id, 0, user_id::BIGINT FROM events UNION ALL SELECT user_id, n + 1, (x * 1103515245 + 12345) & 2147483647 FROM g WHERE n < 8) SELECT user_id, n, x FROM g WHERE n > 0",
)
def lcg_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.posexplode(nu.lcg(F.col("user_id"), 8)).alias("n", "x")).select("user_id", (F.col("n") + 1).alias("n"), "x")


@query(
    "edge_trigger",
    "WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, event_id, event_type FROM e WHERE before IS DISTINCT FROM event_type",
)
def edge_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type differs from the user's one before."""
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("before", before)
    return rows.where(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("band_average", "SELECT label, band, round(avg(q), 6) AS mean FROM (SELECT label, unnest(range(0, 64)) AS band, unnest(list_transform(embedding, lambda x: floor(x::DOUBLE * 256 + 0.5)::BIGINT)) AS q FROM embeddings) GROUP BY 1, 2")
def band_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each band of a label's vectors: a fingerprint with its level."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("band", "x"))
    return rows.groupBy("label", F.col("band").cast("long").alias("band")).agg(F.round(F.avg(F.floor(F.col("x").cast("double") * 256 + 0.5)), 6).alias("mean"))
