"""Replies of the text engine, its rules as rows, small policies, and text shown on a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.functions import numeric as nu
from utterloom.functions import text as tx
from utterloom.operators import matching as m
from utterloom.operators import rules
from utterloom.plans.registry import query, table
from utterloom.plans.scoring import VECTORS, class_scores
from utterloom.plans.signals import SAMPLES, samples
from utterloom.plans.texts import CLEAN
from utterloom.streaming import policies

SCRIPT = """
; a small script over words that the test prose has
(GREETING HELLO)
(NONE (GO ON.) (I SEE.))
(IS 3 ((0 IS 1 0) (IT IS 3.) (GOTO OF)))
(OF 2 ((0 OF 0) (WHY OF 3?) (TELL ME OF 3.)))
(DE 1 ((0 DE 0) (QUE DE 3?)))
(LA 0 = DE)
"""
KEYS = ("IS", "OF", "DE", "LA")
CLAUSE = f"""w AS (SELECT conv_id, turn, {CLEAN} AS w FROM conversations),
c AS (SELECT conv_id, turn, list_filter(list_transform(string_split(array_to_string(list_transform(w, lambda x: CASE WHEN x = 'BUT' THEN chr(1) WHEN rtrim(x, ',.!?;') <> x THEN rtrim(x, ',.!?;') || ' ' || chr(1) ELSE x END), ' '), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS c FROM w),
f AS (SELECT conv_id, turn, string_split(coalesce(list_filter(c, lambda s: list_has_any(string_split(s, ' '), {list(KEYS)}))[1], c[1], ''), ' ') AS f FROM c)"""


@query(
    "script_replies",
    f"""WITH {CLAUSE},
    k AS (SELECT *, list_filter(range(1, len(f)), lambda i: f[i] = 'IS')[1] AS at_is, list_position(f, 'OF') AS at_of, list_position(f, 'DE') AS at_de FROM f),
    i AS (SELECT *, CASE WHEN at_is IS NOT NULL THEN (count(at_is) OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2 END AS n_is FROM k),
    o AS (SELECT *, CASE WHEN at_of > 0 AND coalesce(n_is, 1) = 1 THEN 1 END AS u FROM i),
    p AS (SELECT *, CASE WHEN u = 1 THEN (count(u) OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2 END AS n_of FROM o),
    d AS (SELECT *, n_is IS DISTINCT FROM 0 AND n_of IS NULL AND at_de > 0 AS de FROM p),
    e AS (SELECT *, CASE WHEN n_is IS DISTINCT FROM 0 AND n_of IS NULL AND NOT coalesce(de, false) THEN 1 END AS none FROM d),
    z AS (SELECT *, CASE WHEN none = 1 THEN (count(none) OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2 END AS n_none,
      CASE WHEN n_is = 0 THEN [f[at_is + 1]] WHEN n_of IS NOT NULL THEN f[at_of + 1 :] WHEN de THEN f[at_de + 1 :] ELSE [] END AS part FROM e),
    y AS (SELECT *, CASE WHEN len(part) > 1 AND part[-1] = 'I' THEN array_to_string(part[:-2], ' ') || ' ME' ELSE array_to_string(part, ' ') END AS s FROM z)
    SELECT conv_id, turn, CASE WHEN n_none = 0 THEN 'GO ON.' WHEN n_none = 1 THEN 'I SEE.' WHEN n_is = 0 THEN 'IT IS ' || s || '.'
      ELSE CASE WHEN n_of = 0 THEN 'WHY OF' WHEN n_of = 1 THEN 'TELL ME OF' ELSE 'QUE DE' END || CASE WHEN s = '' THEN '' ELSE ' ' || s END || CASE WHEN n_of = 1 THEN '.' ELSE '?' END END AS reply FROM y""",
)
def script_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn answered by a script with ranks, a jump that counts as a use, rotation, and last resorts."""
    return rules.replies(table(spark, sf_dir, "conversations"), rules.compile_script(SCRIPT))


@query("rule_rows", "VALUES ('IS', 3, NULL::VARCHAR, 0, '0 IS 1 0', 0, 'T', 'IT IS 3.'), ('IS', 3, NULL, 0, '0 IS 1 0', 1, 'G', 'OF'), ('OF', 2, NULL, 0, '0 OF 0', 0, 'T', 'WHY OF 3?'), ('OF', 2, NULL, 0, '0 OF 0', 1, 'T', 'TELL ME OF 3.'), ('DE', 1, NULL, 0, '0 DE 0', 0, 'T', 'QUE DE 3?')".replace("VALUES", "SELECT * FROM (VALUES") + ") t(keyword, rank, goto, part, pattern, template, kind, payload)")
def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script read and compiled: a row for each template, with its kind."""
    return spark.createDataFrame(rules.rule_rows(rules.compile_script(SCRIPT)), "keyword string, rank int, goto string, part int, pattern string, template int, kind string, payload string")


@query(
    "reachable_replies",
    "WITH RECURSIVE j(a, b) AS (VALUES ('IS', 'OF'), ('LA', 'DE')), r(k) AS (SELECT unnest(['IS', 'LA']) UNION SELECT b FROM r JOIN j ON a = k), t(keyword, reply) AS (VALUES ('IS', 'IT IS 3.'), ('OF', 'WHY OF 3?'), ('OF', 'TELL ME OF 3.'), ('DE', 'QUE DE 3?')) SELECT keyword, reply FROM t WHERE keyword IN (SELECT k FROM r)",
)
def reachable_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply that some branch from two keywords reaches."""
    return rules.reachable(spark, rules.compile_script(SCRIPT), ["IS", "LA"])


DRAW = "('0x' || substr(md5('(' || user_id || ', ' || {0} || ')'), 1, 12))::BIGINT % {1}"
EVENTS = "e AS MATERIALIZED (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"


def folded(spark: SparkSession, sf_dir: str, run, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return policies.folded(rows, "user_id", "event_id", run, kind)


@query(
    "alternate_sounds",
    f"WITH RECURSIVE {EVENTS}, r(user_id, i, event_id, plain, out) AS (SELECT user_id, i, event_id, 1, false FROM e WHERE i = 0 UNION ALL SELECT user_id, i, event_id, CASE WHEN o THEN 0 ELSE plain + 1 END, o FROM (SELECT e.user_id, e.i, e.event_id, plain, plain >= 5 AND {DRAW.format('e.i', 3).replace('user_id', 'e.user_id')} = 0 AS o FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)) SELECT user_id, event_id, out FROM r",
)
def alternate_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir, lambda key, rows: list(policies.alternates(int(key), len(rows))), "boolean")


@query(
    "refresh_policy",
    f"WITH RECURSIVE {EVENTS}, r(user_id, i, event_id, t, n, out) AS (SELECT user_id, i, event_id, t, 8, 'full' FROM e WHERE i = 0 UNION ALL SELECT e.user_id, e.i, e.event_id, e.t, CASE WHEN n = 0 OR e.t - r.t >= 60 THEN 8 ELSE n - 1 END, CASE WHEN n = 0 OR e.t - r.t >= 60 THEN 'full' ELSE 'partial' END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id, out FROM r",
)
def refresh_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir, lambda key, rows: list(policies.refreshes(rows["t"].tolist())), "string")


@query(
    "unrepeated_choices",
    f"WITH RECURSIVE {EVENTS}, r(user_id, i, event_id, out) AS (SELECT user_id, i, event_id, {DRAW.format('i', 5)} FROM e WHERE i = 0 UNION ALL SELECT user_id, i, event_id, CASE WHEN p < last THEN p ELSE p + 1 END FROM (SELECT e.user_id, e.i, e.event_id, r.out AS last, {DRAW.format('e.i', 4).replace('user_id', 'e.user_id')} AS p FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)) SELECT user_id, event_id, out FROM r",
)
def unrepeated_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded choice for each event, never that of the user's event before."""
    return folded(spark, sf_dir, lambda key, rows: list(policies.unrepeated(int(key), len(rows), 5)), "long")


# ---- text -------------------------------------------------------------------

SHORT = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"


@query(
    "sentence_case",
    f"WITH t AS (SELECT conv_id, turn, {SHORT} AS w FROM conversations) SELECT conv_id, turn, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 OR right(w[i - 1], 1) IN ('.', '!', '?') OR x = 'i' OR starts_with(x, 'i''') OR trim(x, '.,?!''') IN ('english', 'the') THEN upper(left(x, 1)) || substr(x, 2) ELSE x END), ' ') AS text FROM t",
)
def sentence_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.sentence_case(F.col("text"), ("english", "the")).alias("text"))


SPELLINGS = {"the": "thee", "of": "off", "de": "du"}


@query(
    "punctuate_respell",
    "WITH t AS (SELECT item_id, rtrim(text, '.,!?;') AS text, item_id % 3 = 0 AS q FROM benchmark), s(word, other) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SPELLINGS.items()) + "), u AS (SELECT item_id, q, text, unnest(string_split(text, ' ')) AS w, unnest(range(0, len(string_split(text, ' ')))) AS i FROM t) SELECT item_id, string_agg(coalesce(other, rtrim(w, ',.!?;')) || substr(w, length(rtrim(w, ',.!?;')) + 1), ' ' ORDER BY i) || CASE WHEN q THEN '?' ELSE '.' END AS text FROM u LEFT JOIN s ON word = rtrim(w, ',.!?;') GROUP BY item_id, q",
)
def punctuate_respell(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.rtrim("text", F.lit(".,!?;")).alias("text"))
    return rows.select("item_id", tx.punctuate(tx.respell(F.col("text"), SPELLINGS), F.col("item_id") % 3 == 0).alias("text"))


PIECES = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
CHOPPED = "flatten(list_transform({0}, lambda w: list_transform(range(0, (length(w) + {1} - 1) // {1}), lambda i: substr(w, i * {1} + 1, {1}))))"
WRAPPED = "list_reduce({0}, lambda s, w: CASE WHEN length(string_split(s, chr(10))[-1]) + 1 + length(w) <= {1} THEN s || ' ' || w ELSE s || chr(10) || w END)"


def wrapped(width: int) -> str:
    return WRAPPED.format(CHOPPED.format(PIECES, width), width)


@query("wrap_lines", f"SELECT item_id, {wrapped(9)} AS lines FROM benchmark")
def wrap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy lines of nine characters; longer words are cut."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.wrap(F.col("text"), 9), "\n").alias("lines"))


SIZES = ((4, 14, 12), (3, 18, 20), (2, 26, 40), (1, 40, 60))


@query("fit_text", "SELECT item_id, CASE " + " ".join(f"WHEN list_max(list_transform({PIECES}, lambda w: length(w))) <= {w} AND len(string_split({wrapped(w)}, chr(10))) <= {n} THEN {s}" for s, w, n in SIZES) + " ELSE 1 END AS scale FROM benchmark")
def fit_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", tx.fit(F.col("text"), SIZES).alias("scale"))


# ---- numbers ----------------------------------------------------------------


@query(
    "log2_q8",
    f"WITH {SAMPLES}, t AS (SELECT list(round(256 * log2(1 + n / 64))::BIGINT ORDER BY n) AS t FROM (SELECT unnest(range(0, 65)) AS n)), e AS (SELECT user_id, i, length(bin(greatest(1, x))) - 1 AS e, greatest(1, x) AS v FROM s), c AS (SELECT *, CASE WHEN e >= 16 THEN v >> (e - 16) ELSE v << (16 - e) END AS c FROM e) SELECT user_id, i, (e * 256 + t[(c >> 10) - 63] + (((t[(c >> 10) - 62] - t[(c >> 10) - 63]) * (c & 1023) + 512) >> 10))::BIGINT AS log FROM c, t",
)
def log2_q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("user_id", "i", nu.log2_q8(F.col("x")).cast("long").alias("log"))


@query("pitch_and_gain", "SELECT event_id, round(CASE WHEN event_id % 7 = 0 OR value <= 0 THEN 0.0 ELSE 12 * log2(value / (event_id % 7 * 50)) END, 6) AS semitones, floor(power(10, (event_id % 60 - 40) / 20) * 32768 + 0.5)::BIGINT AS gain FROM events")
def pitch_and_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from a pitch, none from an unvoiced one; and gains of decibels in Q15."""
    d = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(nu.semitones(d % 7 * 50, F.col("value")), 6).alias("semitones"), nu.db_to_q15((d % 60 - 40).cast("double")).alias("gain"))


@query(
    "xorshift_sequence",
    "WITH RECURSIVE g(user_id, n, x) AS (SELECT DISTINCT user_id, 0, user_id::BIGINT + 1 FROM events UNION ALL SELECT user_id, n + 1, xor(b, (b << 5) & 4294967295) FROM (SELECT user_id, n, xor(a, a >> 17) AS b FROM (SELECT user_id, n, xor(x, (x << 13) & 4294967295) AS a FROM g WHERE n < 8))) SELECT user_id, n, x FROM g WHERE n > 0",
)
def xorshift_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.posexplode(nu.xorshift32(F.col("user_id") + 1, 8)).alias("n", "x")).select("user_id", (F.col("n") + 1).alias("n"), "x")


@query(
    "probability_gate",
    f"""WITH {VECTORS}, p AS (SELECT query, label, exp(-score / 200.0) AS w FROM scores), q AS (SELECT query, label, w / sum(w) OVER (PARTITION BY query) AS p, row_number() OVER (PARTITION BY query ORDER BY w DESC, label) AS r FROM p)
    SELECT a.query, CASE WHEN a.label <> 6 AND a.p >= 0.2 AND a.p - b.p >= 0.02 THEN a.label END AS fired FROM q a JOIN q b ON a.query = b.query WHERE a.r = 1 AND b.r = 2""",
)
def probability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the classes, gated by the best one's share and its lead; class 6 never fires."""
    rows = class_scores(spark, sf_dir).withColumn("w", F.exp(-F.col("score") / 200.0))
    ranks = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("k"), "label"))).alias("r"), F.sum("w").alias("total"))
    ranks = ranks.withColumn("r", F.transform("r", lambda x: F.struct((-x["k"] / F.col("total")).alias("p"), x["label"].alias("label"))))
    return ranks.select("query", m.fires_likely(F.col("r"), 0.2, 0.02, 6).alias("fired"))


SWEPT = ((64, 64), (64, 256), (32, 256), (16, 256))  # bands and scale


@query(
    "front_end_sweep",
    " UNION ALL ".join(
        f"SELECT '{n} bands x{s}' AS variant, count(*) AS n, (count(*) FILTER (WHERE label = truth))::BIGINT AS hits FROM (SELECT arg_min(t.label, list_sum(list_transform(range(1, {n + 1}), lambda i: abs(floor(v.e[i]::DOUBLE * {s} + 0.5) - floor(t.e[i]::DOUBLE * {s} + 0.5))))::BIGINT * 100 + t.label) AS label, v.label AS truth FROM (SELECT vec_id, label, embedding AS e FROM embeddings WHERE vec_id % 5 <> 0 AND label <= 6) v, (SELECT label, embedding AS e FROM embeddings WHERE vec_id % 5 = 0 AND label <= 6) t GROUP BY v.vec_id, v.label)"
        for n, s in SWEPT
    ),
)
def front_end_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same evaluation under several front ends: how many bands, and how finely they are quantised."""
    rows = table(spark, sf_dir, "embeddings").where("label <= 6")
    parts = []
    for bands, scale in SWEPT:
        v = rows.select("vec_id", "label", m.quantised(F.slice("embedding", 1, bands), scale).alias("v"))
        queries = v.where("vec_id % 5 <> 0").select(F.struct(F.col("vec_id").alias("id"), F.col("label").alias("truth")).alias("query"), "v")
        scores = m.class_scores(queries, v.where("vec_id % 5 = 0").select("label", F.col("v").alias("t")))
        best = scores.groupBy("query").agg(F.min(F.struct("score", "label")).alias("b"))
        parts.append(best.agg(F.count("*").alias("n"), F.count(F.when(F.col("b.label") == F.col("query.truth"), 1)).alias("hits")).select(F.lit(f"{bands} bands x{scale}").alias("variant"), "n", "hits"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
