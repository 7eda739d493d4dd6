"""Corpus checks over documents, labels and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.operators import corpus as co
from utterloom.operators.matching import small
from utterloom.plans.registry import query, table

SPLIT = "CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'val' ELSE 'test' END"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("split", F.expr(SPLIT))


@query("leak_check", f"SELECT source, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM (SELECT source, {SPLIT} AS split FROM documents) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.leaks(documents(spark, sf_dir), "source").select("source", F.array_join("splits", ",").alias("splits"))


@query("text_leak_check", f"SELECT md5(text) AS digest, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM (SELECT text, {SPLIT} AS split FROM documents) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def text_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand in more than one split."""
    rows = documents(spark, sf_dir).select(F.md5("text").alias("digest"), "split")
    return co.leaks(rows, "digest").select("digest", F.array_join("splits", ",").alias("splits"))


@query("phantom_identity", "SELECT md5(text) AS digest, count(DISTINCT source) AS n, min(source) AS first_name FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def phantom_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.twins(documents(spark, sf_dir), F.md5("text"), "source")


@query("split_completeness", f"WITH d AS (SELECT {SPLIT} AS split, lang || quality AS label FROM documents JOIN labels USING (doc_id)), s AS (SELECT unnest(['train', 'val', 'test']) AS split), c AS (SELECT unnest(['en0', 'en1', 'de0', 'de1', 'fr0', 'fr1', 'es0', 'es1', 'it0']) AS label) SELECT split, label FROM s, c EXCEPT SELECT split, label FROM d")
def split_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that a split lacks among all labels."""
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("split", F.concat("lang", F.col("quality").cast("string")).alias("label"))
    splits = spark.createDataFrame([("train",), ("val",), ("test",)], "split string")
    classes = spark.createDataFrame([(f"{s}{q}",) for s in ("en", "de", "fr", "es") for q in (0, 1)] + [("it0",)], "label string")
    return co.missing_classes(rows, splits, classes)


@query("split_counts", f"SELECT {SPLIT} AS split, lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1, 2")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy("split", "lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query(
    "connected_families",
    """WITH RECURSIVE e AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) AND a.doc_id <> b.doc_id
      UNION SELECT doc_id, doc_id - doc_id % 2 FROM documents WHERE source = 'src3' AND doc_id % 2 = 1),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
    SELECT node, min(root) AS family FROM r WHERE node IN (SELECT doc_id FROM documents) GROUP BY 1""",
)
def connected_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by equal texts, as a star around the smallest id, or by one source's neighbouring ids."""
    docs = documents(spark, sf_dir)
    text = docs.select("doc_id", F.md5("text").alias("digest"))
    star = text.join(text.groupBy("digest").agg(F.min("doc_id").alias("b")), "digest").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    near = docs.where("source = 'src3' and doc_id % 2 = 1").select(F.col("doc_id").alias("a"), (F.col("doc_id") - 1).alias("b"))
    return co.families(star.unionByName(near), docs.select(F.col("doc_id").alias("node")))


@query("manifest_merge", "SELECT key, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY age) AS r FROM (SELECT doc_id // 2 AS key, source, n_chars, 1 AS age FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id // 2, source, n_chars, 0 FROM documents WHERE doc_id % 6 = 1)) WHERE r = 1 AND key IN (SELECT doc_id FROM labels)")
def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests with the newest row of each key, without rows whose file, a labelled id, is gone."""
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("key"), "doc_id", "source", "n_chars")
    old, new = docs.where("doc_id % 2 = 0").drop("doc_id"), docs.where("doc_id % 6 = 1").drop("doc_id")
    listing = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))
    return co.newest([old, new], "key").join(listing, "key", "left_semi").select("key", "source", "n_chars")


@query("listed_but_missing", "SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE source <> 'src5')")
def listed_but_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "documents").where("source <> 'src5'").select("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id").join(there, "doc_id", "left_anti")


@query("first_mentions", "WITH u AS (SELECT 0 AS source, item_id AS pos, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents UNION ALL SELECT 2, doc_id, replace(upper(text), 'ẞ', 'SS') FROM documents), k AS (SELECT *, md5(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '_', 'g')) AS key FROM u) SELECT key, text, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, pos, text) AS r FROM k) WHERE r = 1")
def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First mentions by whole texts, keyed by a digest."""
    from utterloom.functions.text import slug

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    whole = docs.select(F.col("doc_id").alias("pos"), "text")
    sources = [items.select(F.col("item_id").alias("pos"), "text"), whole, whole.withColumn("text", F.upper("text"))]
    return co.first_mentions(sources, F.md5(slug(F.lower("text"))))


@query("capped_takes", "SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def capped_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each source and language, as a report's cap."""
    return co.capped(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"], 3)


@query("best_quality", "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def best_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return co.best_of(rows, ["source", "lang"], F.col("n_chars"), "doc_id")


@query("close_across_splits", f"WITH p AS (SELECT min(doc_id) AS a, max(doc_id) AS b FROM documents GROUP BY md5(text) HAVING count(*) > 1), s AS (SELECT doc_id AS name, {SPLIT} AS split FROM documents) SELECT a, b, x.split AS a_split, y.split AS b_split FROM p JOIN s x ON x.name = a JOIN s y ON y.name = b WHERE x.split <> y.split")
def close_across_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    pairs = docs.groupBy(F.md5("text").alias("d")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("a", "b")
    return co.across(pairs, docs.select(F.col("doc_id").alias("name"), "split"))


@query("voice_pairs", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey = b.s_nationkey AND abs(a.s_acctbal - b.s_acctbal) <= 900")
def voice_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one nation with near balances: cells of the tolerance's width turn the range into equal keys, so that only near rows meet."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("x")).withColumn("cell", F.floor(F.col("x") / 900))
    t = s.select(F.col("a").alias("b"), "nation", F.col("x").alias("y"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    return s.join(t, ["nation", "cell"]).where("a < b and abs(x - y) <= 900").select("a", "b")


@query("utterance_plan", "WITH f AS (SELECT DISTINCT lang AS form FROM documents), n AS (SELECT form, row_number() OVER (ORDER BY form) - 1 AS i FROM f) SELECT form, i, take, [140, 160, 180, 200][(2 + i + take) % 4 + 1] AS rate FROM n, (SELECT unnest(range(0, 4))::INTEGER AS take)")
def utterance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    forms = table(spark, sf_dir, "documents").select(F.col("lang").alias("form")).distinct()
    return co.utterance_plan(forms.withColumn("i", F.row_number().over(Window.orderBy("form")).cast("long") - 1), [140, 160, 180, 200], 2)


@query("pak_layout", "WITH c AS (SELECT lpad(p_partkey::VARCHAR, 8, '0') AS id, p_size::BIGINT * 37 AS length FROM part), n AS (SELECT count(*) AS clips FROM c) SELECT id, ((16 + clips * 20 + 3) // 4) * 4 + coalesce(sum(((length + 3) // 4) * 4) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", length FROM c, n")
def pak_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("id"), (F.col("p_size").cast("long") * 37).alias("length"))
    return co.pak_layout(clips)


@query("pak_lookup", "SELECT l_orderkey, l_linenumber, p_size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40")
def pak_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups in an index as a join; the filter reaches the scan."""
    index = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(small(index), "l_partkey").select("l_orderkey", "l_linenumber", "p_size")


@query("requirement_report", "SELECT lang, count(*) >= 100 AS enough, count(DISTINCT source) >= 3 AS varied, min(n_chars) > 0 AS filled FROM documents GROUP BY 1")
def requirement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg((F.count("*") >= 100).alias("enough"), (F.countDistinct("source") >= 3).alias("varied"), (F.min("n_chars") > 0).alias("filled"))


@query("order_of_takes", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rep, lang AS word FROM documents")
def order_of_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place in a round-robin order of the sources."""
    from pyspark.sql import Window

    rep = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long") - 1
    return table(spark, sf_dir, "documents").select("doc_id", rep.alias("rep"), F.col("lang").alias("word"))


@query("truth_table", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'oov' WHEN quality = 0 THEN 'variant' ELSE 'word' END AS truth_kind, CASE WHEN toxic = 1 THEN NULL ELSE lang END AS truth_label FROM labels JOIN documents USING (doc_id)")
def truth_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    kind = F.when(F.col("toxic") == 1, "oov").when(F.col("quality") == 0, "variant").otherwise("word")
    return rows.select("doc_id", kind.alias("truth_kind"), F.when(F.col("toxic") != 1, F.col("lang")).alias("truth_label"))
