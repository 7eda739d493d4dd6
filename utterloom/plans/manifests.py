"""Manifests, listings, voices and splits over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.operators import corpus as co
from utterloom.operators import exactness as ex
from utterloom.operators import splits as sp
from utterloom.operators.matching import quantised, small, small_rows
from utterloom.plans.registry import query, table
from utterloom.sources import logs
from utterloom.sources import manifests as mf

LANGS = {"en": "english", "de": "german", "fr": "french"}
FORMS = ", ".join(f"('{k}', '{v}', '{'variant' if k == 'fr' else 'word'}')" for k, v in LANGS.items())


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v, "variant" if k == "fr" else "word") for k, v in LANGS.items()], "form string, class string, kind string")


@query(
    "manifest_classes",
    f"WITH v(form, class, kind) AS (VALUES {FORMS}) SELECT 'take' || doc_id || '.wav' AS file, lang AS label, source AS voice, CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, NULL::VARCHAR AS category, n_chars, coalesce(CASE WHEN kind = 'variant' THEN 'unknown' ELSE class END, 'unknown') AS class FROM documents LEFT JOIN v ON form = lang",
)
def manifest_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest under other column names, brought to the usual ones, with the vocabulary's class of each form."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("take"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("wav"), F.col("lang").alias("form"), F.col("source").alias("speaker"), F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train").alias("set"), "n_chars")
    return mf.classed(mf.named(rows), vocabulary(spark)).select("file", "label", "voice", "split", "category", "n_chars", "class")


@query("split_filter", "SELECT doc_id, lang AS category FROM documents WHERE doc_id % 4 = 0 AND lang = 'de'")
def split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split and a category of a manifest; the filters reach the scan."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train").alias("split"))
    return mf.chosen(rows, "val", "de").select("doc_id", "category")


@query(
    "takes_present",
    "WITH t AS (SELECT 'a/' || doc_id AS file, lang AS label FROM documents WHERE source <> 'src1' UNION ALL SELECT 'b/' || doc_id, 'x' FROM labels), l AS (SELECT 'a/' || doc_id AS file FROM labels UNION SELECT 'b/' || doc_id FROM documents WHERE source <> 'src2') SELECT file, label, (SELECT count(*) FROM t WHERE file NOT IN (SELECT file FROM l)) AS missing FROM t WHERE file IN (SELECT file FROM l)",
)
def takes_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of two folders whose file is there, with the number of those whose file isn't."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels").select("doc_id")
    at = lambda folder: F.concat(F.lit(folder), F.col("doc_id").cast("string")).alias("file")
    takes = co.joined_takes([docs.where("source <> 'src1'").select(at("a/"), F.col("lang").alias("label")), labels.select(at("b/"), F.lit("x").alias("label"))])
    listing = labels.select(at("a/")).unionByName(docs.where("source <> 'src2'").select(at("b/"))).distinct()
    there, gone = mf.present(takes, listing)
    return there.join(F.broadcast(gone)).select("file", "label", "missing")  # one row


@query(
    "still_to_take",
    "WITH p AS (SELECT DISTINCT lang AS label, r AS rep FROM documents, (SELECT unnest(range(0, 5)) AS r)), m AS (SELECT DISTINCT lang AS label, doc_id % 7 AS rep, doc_id AS file FROM documents WHERE source = 'src4') SELECT label, rep FROM p WHERE NOT EXISTS (SELECT 1 FROM m JOIN labels l ON l.doc_id = m.file WHERE m.label = p.label AND m.rep = p.rep)",
)
def still_to_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Takes of a plan that a resumed session still has to record: those without a row whose file is there."""
    docs = table(spark, sf_dir, "documents")
    plan = docs.select(F.col("lang").alias("label")).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    done = docs.where("source = 'src4'").select(F.col("lang").alias("label"), (F.col("doc_id") % 7).alias("rep"), F.col("doc_id").alias("file"))
    return mf.still_to_take(plan, done, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file")))


CONSTANTS = {"rate": 16_000, "frame": 400, "bands": 26}


@query("feature_keys", "SELECT r_regionkey, substr(sha1('" + json.dumps(CONSTANTS, sort_keys=True)[:-1] + ", \"shift\": ' || r_regionkey || '}'), 1, 16) AS key FROM region")
def feature_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache keys of five settings of the front end: every constant counts."""
    keys = [(r.k, mf.feature_key({**CONSTANTS, "shift": r.k})) for r in small_rows(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")))]
    return spark.createDataFrame(keys, f"r_regionkey {dict(table(spark, sf_dir, 'region').dtypes)['r_regionkey']}, key string")


@query(
    "case_lines",
    "SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 5 > 0 THEN upper(md5(text)) END AS payload FROM documents WHERE doc_id % 11 > 0",
)
def case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CASE lines among others; every fifth payload isn't hexadecimal."""
    d = F.col("doc_id")
    line = F.when(d % 11 == 0, F.lit("other line")).otherwise(F.concat(F.lit("CASE d"), d.cast("string"), F.lit(" "), F.when(d % 5 == 0, "not-hex").otherwise(F.md5("text"))))
    return logs.case_rows(table(spark, sf_dir, "documents").select(line.alias("value"))).select("name", F.hex("payload").alias("payload"))


VOICES = "SELECT s_suppkey, 'Voice ' || s_suppkey % 30 || CASE s_suppkey % 4 WHEN 0 THEN ' (Premium)' WHEN 1 THEN ' (Enhanced)' WHEN 2 THEN ' (English (UK))' ELSE '' END AS name, ['en_US', 'en_GB', 'de_DE'][s_nationkey % 3 + 1] AS locale, s_nationkey, s_acctbal FROM supplier"
GENDERS = {"Voice 1": "female", "Voice 2": "male", "Voice 5": "female"}


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("s_suppkey") % 4 == 0, " (Premium)").when(F.col("s_suppkey") % 4 == 1, " (Enhanced)").when(F.col("s_suppkey") % 4 == 2, " (English (UK))").otherwise("")
    name = F.concat(F.lit("Voice "), (F.col("s_suppkey") % 30).cast("string"), tail)
    locale = F.element_at(F.array(F.lit("en_US"), F.lit("en_GB"), F.lit("de_DE")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name"), locale.alias("locale"), "s_nationkey", "s_acctbal")


@query("voice_listing", f"WITH v AS ({VOICES}) SELECT name, arg_min(locale, s_suppkey) AS locale FROM v WHERE s_suppkey % 6 > 0 GROUP BY 1")
def voice_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing's lines; the first of equal names counts, and lines of another form are left out."""
    v = voices(spark, sf_dir)
    line = F.when(F.col("s_suppkey") % 6 == 0, F.lit("not a voice")).otherwise(F.concat("name", F.lit("    "), "locale", F.lit("    # Hello, my name is.")))
    return logs.voice_rows(v.select(F.col("s_suppkey").alias("pos"), line.alias("value")))


@query(
    "voice_names",
    f"WITH v AS ({VOICES}), g(stem, gender) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in GENDERS.items()) + ") SELECT s_suppkey, split_part(name, ' (', 1) AS stem, CASE WHEN name LIKE '%(Premium)%' THEN 2 WHEN name LIKE '%(Enhanced)%' THEN 1 ELSE 0 END AS quality, coalesce(gender, 'unknown') AS gender FROM v LEFT JOIN g ON g.stem = split_part(name, ' (', 1)",
)
def voice_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utterloom.functions import text as tx

    name = F.col("name")
    return voices(spark, sf_dir).select("s_suppkey", tx.name_stem(name).alias("stem"), tx.quality_of(name).alias("quality"), tx.gender_of(name, GENDERS).alias("gender"))


@query(
    "tier_rule",
    f"WITH v AS (SELECT s_suppkey, 'f' || CASE WHEN s_suppkey % 3 = 0 THEN 's' || s_suppkey ELSE 'n' || s_nationkey END AS family, locale, s_acctbal / 10 AS word_ms FROM ({VOICES})), f AS (SELECT family, count(*) AS n, count(DISTINCT locale) AS locales FROM v GROUP BY 1) SELECT s_suppkey, family, CASE WHEN n = 1 AND word_ms <= 600 THEN 'natural' WHEN locales > 1 THEN 'expressive' ELSE 'novelty' END AS tier FROM v JOIN f USING (family)",
)
def tier_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """natural: alone in its family and quick enough; expressive: of a family with several locales; else novelty."""
    family = F.concat(F.lit("f"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))))
    rows = voices(spark, sf_dir).select("s_suppkey", family.alias("family"), "locale", (F.col("s_acctbal") / 10).alias("word_ms"))
    return co.with_tier(rows, "family", "locale", "word_ms").select("s_suppkey", "family", "tier")


@query("retired_words", "SELECT lang AS name, count(*) AS n FROM documents WHERE doc_id % 3 = 0 AND lang IN ('fr', 'es', 'xx') GROUP BY 1")
def retired_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances without a class (every third document) whose name is a retired word."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("name"), F.when(F.col("doc_id") % 3 > 0, "word").alias("truth"))
    return co.retired(rows, ["fr", "es", "xx"])


@query(
    "template_voices",
    "WITH v AS (SELECT DISTINCT source AS voice FROM documents), c AS (SELECT voice FROM v ORDER BY md5('7:' || voice), voice LIMIT 3) SELECT voice, label, file FROM (SELECT source AS voice, lang AS label, doc_id AS file, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents WHERE source IN (SELECT voice FROM c)) WHERE r <= 2",
)
def template_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two takes a form of the first three voices in a seeded order: the template set's size is the feature."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("voice"), F.col("lang").alias("label"), F.col("doc_id").alias("file"))
    return co.template_rows(rows, 3, 2, seed=7)


@query(
    "balanced_split",
    """WITH RECURSIVE f AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k, sum(n) OVER () AS total FROM f),
    r(k, source, split, a, b, c) AS (SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT UNION ALL
      SELECT k, source, s, a + CASE WHEN s = 'train' THEN n ELSE 0 END, b + CASE WHEN s = 'val' THEN n ELSE 0 END, c + CASE WHEN s = 'test' THEN n ELSE 0 END FROM (
        SELECT o.k, o.source, n, a, b, c, CASE WHEN total * 3 / 5 - a >= total / 5 - b AND total * 3 / 5 - a >= total / 5 - c THEN 'train' WHEN total / 5 - b >= total / 5 - c THEN 'val' ELSE 'test' END AS s FROM r JOIN o ON o.k = r.k + 1))
    SELECT doc_id, source, split FROM r JOIN documents USING (source)""",
)
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sources to splits by 3 : 1 : 1, largest first, each to the split that lacks most."""
    return sp.with_splits(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "split")


@query(
    "required_split",
    f"""WITH v AS (SELECT DISTINCT split_part(name, ' (', 1) AS family FROM ({VOICES})), n AS (SELECT family, regexp_extract(family, '[0-9]+')::INTEGER AS k FROM v),
    a AS (SELECT family, CASE WHEN k % 5 = 0 THEN 'novelty' ELSE 'natural' END AS tier, CASE WHEN k % 2 = 0 THEN 'en_US' ELSE 'en_GB' END AS locale, ['male', 'female', 'unknown'][k % 3 + 1] AS gender, k % 3 AS quality FROM n),
    u AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY quality DESC, family) AS r FROM a WHERE tier = 'natural' AND locale = 'en_US')
    SELECT family, CASE WHEN gender <> 'unknown' AND r = 1 THEN 'test' ELSE 'train' END AS split FROM u""",
)
def required_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the requirements decide for voices of the wanted locale: the best of each gender is held out, the others train."""
    rows = voices(spark, sf_dir).select(F.split_part("name", F.lit(" ("), F.lit(1)).alias("family")).distinct().withColumn("k", F.regexp_extract("family", "[0-9]+", 0).cast("int"))
    rows = rows.select("family", F.when(F.col("k") % 5 == 0, "novelty").otherwise("natural").alias("tier"), F.when(F.col("k") % 2 == 0, "en_US").otherwise("en_GB").alias("locale"), F.element_at(F.array(F.lit("male"), F.lit("female"), F.lit("unknown")), F.col("k") % 3 + 1).alias("gender"), (F.col("k") % 3).alias("quality"))
    made = sp.required([r.asDict() for r in small_rows(rows)])
    return spark.createDataFrame([(r["family"], r["split"]) for r in made if r["tier"] == "natural" and r["locale"] == "en_US"], "family string, split string")


@query(
    "fingerprint_distance",
    "WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256 + 0.5)::BIGINT) AS q FROM embeddings), f AS (SELECT label, arg_min(q, vec_id) AS f FROM q GROUP BY 1) SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: abs(q[i] - f[i]))) / 64 AS distance FROM q JOIN f USING (label)",
)
def fingerprint_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of each vector from the first of its label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(quantised(F.col("embedding")), lambda x: x.cast("double")).alias("q"))
    first = rows.groupBy("label").agg(F.min_by("q", "vec_id").alias("f"))
    return rows.join(small(first), "label").select("vec_id", ex.fingerprint_distance(F.col("q"), F.col("f")).alias("distance"))


@query("packed_vectors", "SELECT label, (sum(64) OVER (ORDER BY label) - 64)::BIGINT // 8 AS at, 8 AS frames, string_agg(printf('%02X%02X', v & 255, v >> 8), '' ORDER BY i) AS blob FROM (SELECT label, i, floor(q[i]::DOUBLE * 256 + 0.5)::BIGINT + 32768 AS v FROM (SELECT label, arg_min(embedding, vec_id) AS q, unnest(range(1, 65)) AS i FROM embeddings GROUP BY label)) GROUP BY label")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template for each label, eight frames of eight, packed and found again by the index."""
    import numpy as np

    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by(quantised(F.col("embedding")), "vec_id").alias("q"))
    blob, index = ex.packed_templates([(str(r.label), np.array(r.q).reshape(8, 8)) for r in sorted(small_rows(rows), key=lambda r: r.label)])
    found = ex.unpacked_templates(blob, index, 8)
    again, _ = ex.packed_templates(found)
    if again != blob:
        raise ValueError("the templates came back changed")
    return spark.createDataFrame([(int(label), at, n, blob[16 * at : 16 * (at + n)].hex().upper()) for label, at, n in index], "label int, at long, frames int, blob string")


@query("both_query_sets", "SELECT vec_id, label, CASE WHEN label <= 7 THEN 'word' ELSE 'silent' END AS part FROM embeddings")
def both_query_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words and the vectors that must stay silent; both have to be there."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return ex.queries_with_both(rows.where("label <= 7").withColumn("part", F.lit("word")), rows.where("label > 7").withColumn("part", F.lit("silent")))

