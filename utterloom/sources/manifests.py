"""Readers of manifests, take lists and file listings, and a cache of features by what made them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.functions.text import form_of_file

#: Names under which a column may come, the first that is there wins.
ALIASES = {"file": ("file", "wav", "path"), "label": ("label", "class", "form"), "voice": ("voice", "speaker"), "split": ("split", "set"), "category": ("category", "kind")}


def named(rows: DataFrame, aliases: Mapping[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """rows with each column of aliases from the first alias that isn't null; columns that never come are null, others stay."""
    there = set(rows.columns)
    used = {a for names in aliases.values() for a in names}

    def pick(names: tuple[str, ...]) -> Column:
        own = [F.col(f"`{n}`") for n in names if n in there]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    return rows.select(*[pick(names).alias(k) for k, names in aliases.items()], *[F.col(f"`{c}`") for c in rows.columns if c not in used])


def read_manifest(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Rows of a manifest by its ending: JSON with entries, JSON lines, or CSV. Relative files are put under root."""
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
    elif path.endswith(".jsonl"):
        rows = spark.read.json(path)
    else:
        rows = spark.read.option("multiLine", True).json(path)
        rows = rows.select(F.explode("entries").alias("e")).select("e.*") if "entries" in rows.columns else rows
    rows = named(rows)
    if root is not None:
        rows = rows.withColumn("file", F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col("file"))))
    return rows


def chosen(rows: DataFrame, split: str | None = None, category: str | None = None) -> DataFrame:
    """Rows of a split and a category; the split of people's takes isn't given out this way."""
    if split == "human":
        raise ValueError("people's takes have a reader of their own")
    rows = rows if split is None else rows.where(F.col("split") == split)
    return rows if category is None else rows.where(F.col("category") == category)


def classed(rows: DataFrame, vocabulary: DataFrame, unknown: str = "unknown") -> DataFrame:
    """rows with class: the vocabulary's (form, class) for the label, else unknown; variants are unknown too."""
    own = vocabulary.select(F.col("form").alias("label"), F.when(F.col("kind") == "variant", F.lit(unknown)).otherwise(F.col("class")).alias("class"))
    return rows.join(F.broadcast(own) if own.count() <= 10_000 else own, "label", "left").withColumn("class", F.coalesce("class", F.lit(unknown)))


def present(rows: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose file is in the listing (file), and one row with the number of those whose file isn't."""
    gone = rows.join(listing.select("file"), "file", "left_anti").agg(F.count("*").alias("missing"))
    return rows.join(listing.select("file"), "file", "left_semi"), gone


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, name, form, rep of the files under path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")
    name = F.regexp_replace("file", r"^.*/", "")
    return files.select("file", "length", name.alias("name"), form_of_file(F.col("file")).alias("form"), F.regexp_extract(name, r"[_.]([0-9]+)\.[^.]*$", 1).alias("rep"))


def feature_key(constants: Mapping) -> str:
    """A fingerprint of every constant that features depend on."""
    return hashlib.sha1(json.dumps(constants, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached_features(spark: SparkSession, path: str, constants: Mapping, make) -> DataFrame:
    """Features from path under this key, made and written first if they aren't there; other keys' are never mixed in."""
    at = f"{path}/feature_key={feature_key(constants)}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def still_to_take(plan: DataFrame, manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of a plan (label, rep) without a row of the manifest (label, rep, file) whose file is in the listing."""
    done = manifest.join(listing.select("file"), "file", "left_semi").select("label", "rep")
    return plan.join(done, ["label", "rep"], "left_anti")


def write_manifest(rows: DataFrame, path: str) -> None:
    """A manifest as JSON lines under path, in place of what is there; a session that is broken off goes on from the last one written."""
    rows.write.mode("overwrite").json(path)
