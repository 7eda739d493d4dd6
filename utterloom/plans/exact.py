"""Exact comparisons over embeddings, and a file plan over documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.operators import exactness as ex
from utterloom.plans.registry import query, table

COUNTS = "c AS (SELECT vec_id AS name, list_transform(embedding, lambda x: greatest(-128, least(127, floor(x::DOUBLE * 128 + 0.5)))::INTEGER) AS q FROM embeddings)"
PAIR = f"""{COUNTS}, a AS (SELECT name, q FROM c WHERE name % 10 <> 0), b AS (SELECT name, CASE WHEN name % 17 = 0 THEN list_transform(q, lambda x, i: CASE WHEN i = 2 THEN x + 3 ELSE x END) ELSE q END AS q FROM c WHERE name % 13 <> 0),
e AS (SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'missing' WHEN a.name IS NULL THEN 'extra' ELSE 'compared' END AS state, coalesce(a.q = b.q, false) AS exact,
  list_max(list_transform(range(1, len(a.q) + 1), lambda i: abs(a.q[i] - b.q[i]))) AS worst, list_position(a.q, list_max(a.q)) = list_position(b.q, list_max(b.q)) AS same_best FROM a FULL JOIN b ON a.name = b.name)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.transform("embedding", lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.floor(x.cast("double") * 128 + 0.5))).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("name"), q.alias("q"))


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    changed = F.when(F.col("name") % 17 == 0, F.transform("q", lambda x, i: F.when(i == 1, x + 3).otherwise(x))).otherwise(F.col("q"))
    return ex.exactness(v.where("name % 10 <> 0"), v.where("name % 13 <> 0").select("name", changed.alias("q")))


@query("byte_exactness", f"WITH {PAIR} SELECT name, state, exact, worst, same_best FROM e")
def byte_exactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir)


@query("exactness_gate", f"WITH {PAIR} SELECT count(*) AS n, sum(exact::INTEGER)::BIGINT AS exact, max(worst) AS worst, avg(same_best::INTEGER) AS best_agreement, count(*) > 0 AND sum(exact::INTEGER) = count(*) AS passed FROM e")
def exactness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.gate(compared(spark, sf_dir))


@query("score_counts", f"WITH {COUNTS} SELECT name, list_sum(list_transform(q, lambda x: (x + 128) / 256)) AS total, list_sum(list_transform(q, lambda x, i: (x + 128) * i))::BIGINT AS weighed, true AS whole FROM c")
def score_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised outputs as shares, exact, and back as counts."""
    rows = vectors(spark, sf_dir).withColumn("p", ex.shares(F.col("q")))
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    weighed = F.aggregate(F.transform(ex.counts(F.col("p")), lambda x, i: (x * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("name", total.alias("total"), weighed.alias("weighed"), ex.whole_counts(F.col("p")).alias("whole"))


@query("fingerprint_level", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE - list_avg(list_transform(embedding, lambda y: y::DOUBLE))))) / len(embedding), 6) AS spread FROM embeddings")
def fingerprint_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean magnitude of each vector with its level removed."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    flat = F.transform(v, lambda x: F.lit(0.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(ex.fingerprint_distance(ex.without_level(v), flat), 6).alias("spread"))


@query(
    "reconcile_plan",
    """WITH m AS (SELECT 'a/' || doc_id AS file FROM documents WHERE doc_id % 3 <> 0), f AS (SELECT 'a/' || doc_id AS file FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'b/' || doc_id FROM documents WHERE doc_id % 5 = 1),
    free AS (SELECT file FROM f EXCEPT SELECT file FROM m), n AS (SELECT regexp_replace(file, '^.*/', '') AS name, min(file) AS "to" FROM free GROUP BY 1 HAVING count(*) = 1),
    gone AS (SELECT file, "to" FROM (SELECT file FROM m EXCEPT SELECT file FROM f) LEFT JOIN n ON name = regexp_replace(file, '^.*/', ''))
    SELECT file, CASE WHEN "to" IS NULL THEN 'quarantine' ELSE 'relocate' END AS action, "to" FROM gone
    UNION ALL SELECT file, 'index', NULL FROM free WHERE file NOT IN (SELECT "to" FROM gone WHERE "to" IS NOT NULL)
    UNION ALL SELECT DISTINCT file, 'keep', NULL FROM m WHERE file IN (SELECT file FROM f)""",
)
def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    at = lambda folder, rows: rows.select(F.concat(F.lit(folder + "/"), F.col("doc_id").cast("string")).alias("file"))
    return ex.reconcile(at("a", docs.where("doc_id % 3 <> 0")), at("a", docs.where("doc_id % 2 = 0")).unionByName(at("b", docs.where("doc_id % 5 = 1"))))
