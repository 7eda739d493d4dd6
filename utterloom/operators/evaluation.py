"""Operating points and error tables of scored rows.

A scored row has truth_kind (word, variant or oov: must stay silent), truth_label, and
best, best_label, second: the two best scores. No fires give a precision of 1, no words a
recall of 0; a variant that fires as its own word is benign and counts in neither.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterloom.operators.matching import pair_sums

MARGINS = (0, 40, 60, 80, 100)


def outcome(fired: Column) -> Column:
    """tp, wrong, oov or benign for a label that fired, null for silence."""
    kind, truth = F.col("truth_kind"), F.col("truth_label")
    return (
        F.when(fired.isNull(), None)
        .when(kind == "oov", "oov")
        .when(kind == "variant", F.when(fired == truth, "benign").otherwise("oov"))
        .when(fired == truth, "tp")
        .otherwise("wrong")
    )


def counts(name: str) -> list[Column]:
    return [F.sum(F.when(F.col(name) == k, 1).otherwise(0)).alias(k) for k in ("tp", "wrong", "oov", "benign")]


def rates() -> list[Column]:
    shots = F.col("tp") + F.col("wrong") + F.col("oov")
    return [F.when(shots > 0, F.col("tp") / shots).otherwise(1.0).alias("precision"), F.when(F.col("n_words") > 0, F.col("tp") / F.col("n_words")).otherwise(0.0).alias("recall")]


def operating_point(scored: DataFrame, threshold: int, margin: int) -> DataFrame:
    """One row: precision, recall and the counts at a threshold and a margin."""
    clear = (F.lit(margin) == 0) | F.col("second").isNull() | (F.col("second") - F.col("best") >= margin)
    rows = scored.withColumn("o", outcome(F.when((F.col("best") <= threshold) & clear, F.col("best_label"))))
    total = rows.agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(counts("o"), ("tp", "wrong", "oov", "benign"))], F.coalesce(F.sum(F.when(F.col("truth_kind") == "word", 1).otherwise(0)), F.lit(0)).alias("n_words"))
    return total.select(*rates(), "tp", "wrong", "oov", "benign", "n_words")


def sweep(scored: DataFrame, margins=MARGINS) -> DataFrame:
    """The operating point of each margin and each threshold at which a decision changes, the observed best scores.

    Rows become counts by (margin, best) first, and thresholds are running sums over
    those, so that no row meets a threshold other than through its score, and scores are
    made once.
    """
    clear = (F.col("margin") == 0) | F.col("second").isNull() | (F.col("second") - F.col("best") >= F.col("margin"))
    rows = scored.withColumn("margin", F.explode(F.array(*[F.lit(m) for m in margins])))
    rows = rows.withColumn("o", outcome(F.when(F.col("best").isNotNull() & clear, F.col("best_label"))))
    per = rows.groupBy("margin", "best").agg(*counts("o"), F.sum(F.when(F.col("truth_kind") == "word", 1).otherwise(0)).alias("words"))
    upto = Window.partitionBy("margin").orderBy("best").rowsBetween(Window.unboundedPreceding, 0)
    run = per.select("margin", F.col("best").alias("threshold"), *[F.sum(c).over(upto).alias(c) for c in ("tp", "wrong", "oov", "benign")], F.sum("words").over(Window.partitionBy("margin")).alias("n_words"))
    return run.where("threshold is not null").select("margin", "threshold", *rates(), "tp", "wrong", "oov", "benign", "n_words")


def recommend(points: DataFrame) -> DataFrame:
    """Two rows of a sweep: the highest recall without a false fire, and with a precision of 0.95; ties by margin, then threshold."""
    first = lambda where: F.min_by(F.struct(*points.columns), F.when(F.expr(where), F.struct(-F.col("recall"), "margin", "threshold")))
    tops = points.agg(first("wrong + oov = 0 and tp > 0").alias("clean"), first("precision >= 0.95").alias("p95"))
    rows = tops.select(F.explode(F.array(*[F.struct(F.lit(n).alias("choice"), F.col(n).alias("p")) for n in ("clean", "p95")])).alias("r"))
    return rows.where("r.p is not null").select("r.choice", "r.p.*")


def confusion(scored: DataFrame, fired: Column) -> DataFrame:
    """truth, fired, n in long form; variants and silence have rows of their own, no fire is (silent)."""
    truth = F.when(F.col("truth_kind") == "oov", "(oov)").when(F.col("truth_kind") == "variant", "(variant)").otherwise(F.col("truth_label").cast("string"))
    return scored.groupBy(truth.alias("truth"), F.coalesce(fired.cast("string"), F.lit("(silent)")).alias("fired")).agg(F.count("*").alias("n"))


def per_class(scored: DataFrame, fired: Column) -> DataFrame:
    """label, n, hits, wrong, recall of each word class."""
    rows = scored.where("truth_kind = 'word'").withColumn("f", fired)
    hit = F.when(F.col("f") == F.col("truth_label"), 1).otherwise(0)
    wrong = F.when(F.col("f") != F.col("truth_label"), 1).otherwise(0)
    return rows.groupBy(F.col("truth_label").alias("label")).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"), F.sum(wrong).alias("wrong"), F.avg(hit).alias("recall"))


def steals(scored: DataFrame) -> DataFrame:
    """thief, victim, n, rate: how often a class is best in place of the true one, as a share of the true one's rows."""
    n = scored.where("truth_kind = 'word'").groupBy(F.col("best_label").alias("thief"), F.col("truth_label").alias("victim")).agg(F.count("*").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("victim"))
    return n.select("thief", "victim", "n", rate.alias("rate")).where("thief <> victim")


def separation(scores: DataFrame) -> DataFrame:
    """label, gap, rival of each class from (query, truth_label, label, score): the floored mean gap to the nearest rival, and the rival met most often (ties: the smallest)."""
    own = F.min(F.when(F.col("label") == F.col("truth_label"), F.col("score")))
    other = F.min(F.when(F.col("label") != F.col("truth_label"), F.struct("score", "label")))
    per = scores.groupBy("query", "truth_label").agg(own.alias("own"), other.alias("other")).where("own is not null and other is not null")
    gaps = per.groupBy(F.col("truth_label").alias("label"), F.col("other.label").alias("rival")).agg(F.count("*").alias("n"), F.sum(F.col("other.score") - F.col("own")).alias("gap"))
    return gaps.groupBy("label").agg(F.floor(F.sum("gap") / F.sum("n")).cast("long").alias("gap"), F.min_by("rival", F.struct(-F.col("n"), F.col("rival"))).alias("rival"))


def within_between(rows: DataFrame) -> DataFrame:
    """within, between, ratio of the mean L1 distances over all pairs of rows (vec_id, label, v) with different keys, from sums and numbers of pairs."""
    rows = rows.where("vec_id is not null and label is not null and v is not null")
    again = rows.join(rows.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id"), "vec_id", "left_semi")

    def sums(*group: str, of: DataFrame = rows) -> DataFrame:
        return pair_sums(of, *group).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))

    parts = {"every": sums(), "own": sums("label"), "same_key": sums("vec_id", of=again), "same_both": sums("vec_id", "label", of=again)}
    one = reduce(DataFrame.crossJoin, [F.broadcast(df.select(F.col("total").alias(f"{k}_d"), F.col("pairs").alias(f"{k}_n"))) for k, df in parts.items()])
    within = F.expr("try_divide(own_d - same_both_d, own_n - same_both_n)")
    between = F.expr("try_divide(every_d - own_d - same_key_d + same_both_d, every_n - own_n - same_key_n + same_both_n)")
    return one.select(within.alias("within"), between.alias("between")).withColumn("ratio", F.try_divide("between", "within"))


def class_weights(rows: DataFrame, classes: DataFrame, boosted: str | int, factor: float) -> DataFrame:
    """label, n, weight of every class: the root of the inverse frequency, absent classes count as one row, one class times a factor."""
    n = classes.join(rows.groupBy("label").agg(F.count("*").alias("k")), "label", "left").select("label", F.greatest(F.coalesce("k", F.lit(0)), F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    weight = F.sqrt(F.col("total") / (F.col("classes") * F.col("n"))) * F.when(F.col("label") == boosted, factor).otherwise(1.0)
    return n.join(F.broadcast(total)).select("label", "n", weight.alias("weight"))
