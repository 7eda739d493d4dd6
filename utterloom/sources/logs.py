"""Score logs: tagged lines of key=value fields among noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "SCORE "


def score_rows(lines: DataFrame, classes: int | None = None, only_set: str | None = None, only_runtime: str | None = None) -> DataFrame:
    """name, set, runtime, frames, clipped, us, p of the tagged lines of a column value; other lines are left out.

    q holds counts of 256 and beats p, which holds shares. With classes given, a line
    with another number of scores is an error, and so is a log of mixed sets.
    """
    fields = F.str_to_map(F.expr(f"substring(value, {len(TAG) + 1})"), F.lit(" "), F.lit("="))
    rows = lines.where(F.col("value").startswith(TAG)).select(fields.alias("f"))
    if only_set is not None:
        rows = rows.where(F.col("f")["set"] == only_set)
    if only_runtime is not None:
        rows = rows.where(F.col("f")["runtime"] == only_runtime)
    q = F.transform(F.split(F.col("f")["q"], ","), lambda x: x.cast("int") / 256)
    p = F.transform(F.split(F.col("f")["p"], ","), lambda x: x.cast("double"))
    scores = F.coalesce(q, p)
    if classes is not None:
        scores = F.when(F.size(scores) == classes, scores).otherwise(F.raise_error(F.concat(F.lit("wrong number of scores: "), F.col("f")["name"])).cast("array<double>"))
    number = lambda k: F.col("f")[k].cast("int").alias(k)
    return rows.select(*[F.col("f")[k].alias(k) for k in ("name", "set", "runtime")], number("frames"), number("clipped"), F.col("f")["us"].cast("long").alias("us"), scores.alias("p"))


def read_scores(spark: SparkSession, path: str, **options) -> DataFrame:
    return score_rows(spark.read.text(path), **options)


def case_rows(lines: DataFrame) -> DataFrame:
    """name, payload of CASE lines with a hexadecimal payload; a payload that isn't is null."""
    own = lines.where(F.col("value").startswith("CASE ")).select(F.split("value", " ").alias("f"))
    return own.select(F.get("f", F.lit(1)).alias("name"), F.unhex(F.get("f", F.lit(2))).alias("payload"))


def last_by_case(rows: DataFrame, order: str) -> DataFrame:
    """The last row of each runtime and name, by the order column."""
    rest = [c for c in rows.columns if c not in ("runtime", "name")]
    return rows.groupBy("runtime", "name").agg(F.max_by(F.struct(*rest), order).alias("r")).select("runtime", "name", "r.*")


def voice_rows(lines: DataFrame) -> DataFrame:
    """name, locale of a voice listing; the first of equal names, by the order column pos."""
    pattern = r"^(.+?)\s+([a-z]{2,3}_[A-Za-z0-9]+)\s+#"
    rows = lines.select("pos", F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).alias("locale")).where("name <> ''")
    return rows.groupBy("name").agg(F.min_by("locale", "pos").alias("locale"))
