"""Checks and plans over manifests: leaks, twins, families, splits, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utterloom.operators.matching import small_rows


def leaks(rows: DataFrame, entity: str, split: str = "split") -> DataFrame:
    """entity, splits: what stands in more than one split."""
    per = rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return per.where(F.size("splits") > 1)


def twins(rows: DataFrame, digest: Column, name: str) -> DataFrame:
    """digest, names, n: contents that stand under more than one name. Names are counted by content, so a hot content is summed in the tasks."""
    per = rows.select(digest.alias("digest"), F.col(name).alias("name")).groupBy("digest").agg(F.countDistinct("name").alias("n"), F.min("name").alias("first_name"))
    return per.where("n > 1").select("digest", "n", "first_name")


def missing_classes(rows: DataFrame, splits: DataFrame, classes: DataFrame) -> DataFrame:
    """split, label of every class that a split lacks. The classes are a stated list."""
    every = F.array(*[F.lit(r.label) for r in small_rows(classes.select("label"))])
    wanted = splits.select("split", F.explode(every).alias("label"))
    return wanted.join(rows.select("split", "label").distinct(), ["split", "label"], "left_anti")


def newest(rows: list[DataFrame], key: str) -> DataFrame:
    """Union of manifests, oldest first, with the newest row of each key."""
    tagged = [r.withColumn("_age", F.lit(-i)) for i, r in enumerate(rows)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    columns = [c for c in every.columns if c != key]
    best = every.groupBy(key).agg(F.min_by(F.struct(*columns), "_age").alias("r"))
    return best.select(key, *[F.col(f"r.{c}") for c in columns if c != "_age"])


def joined_takes(folders: list[DataFrame]) -> DataFrame:
    """The takes of several folders; columns that a folder lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), folders)


def with_tier(rows: DataFrame, family: str, locale: str, word_ms: str, most_ms: float = 600) -> DataFrame:
    """rows with tier: natural for a family of one that is quick enough, expressive for a family of several locales, else novelty."""
    own = rows.groupBy(family).agg(F.count("*").alias("_n"), F.min(locale).alias("_low"), F.max(locale).alias("_high"))
    tier = F.when((F.col("_n") == 1) & (F.col(word_ms) <= most_ms), "natural").when(F.col("_low") != F.col("_high"), "expressive").otherwise("novelty")
    return rows.join(own, family).withColumn("tier", tier).drop("_n", "_low", "_high")


def retired(rows: DataFrame, words: list[str], name: str = "name", truth: str = "truth") -> DataFrame:
    """name, n: rows without a truth whose name is a retired word."""
    return rows.where(F.col(truth).isNull() & F.col(name).isin(*words)).groupBy(name).agg(F.count("*").alias("n"))


def template_rows(rows: DataFrame, voices: int, takes: int, seed: int = 0) -> DataFrame:
    """Rows (voice, label, file) of the first voices in the order of a seeded digest, at most so many takes of each label, by file."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), "voice"))
    chosen = rows.select("voice").distinct().orderBy(order, "voice").limit(voices)
    return capped(rows.join(F.broadcast(chosen), "voice", "left_semi"), ["voice", "label"], ["file"], takes).select("voice", "label", "file")


def first_mentions(sources: list[DataFrame], key: Column) -> DataFrame:
    """text, source: the union of text lists without texts whose key came before, by source, then text order."""
    every = reduce(lambda a, b: a.unionByName(b), [s.select("pos", "text", F.lit(i).alias("source")) for i, s in enumerate(sources)])
    return every.groupBy(key.alias("key")).agg(F.min(F.struct("source", "pos", "text")).alias("m")).select("key", "m.text", "m.source")


def result_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, state: missing, extra, equal or different, between a reference and a result."""
    a, b = left.select(key, F.col(value).alias("x"), F.lit(1).alias("l")), right.select(key, F.col(value).alias("y"), F.lit(1).alias("r"))
    return diff_states(a.join(b, key, "full_outer"), key, F.col("l").isNotNull(), F.col("x"), F.col("r").isNotNull(), F.col("y"))


def diff_states(rows: DataFrame, key: str, in_left: Column, x: Column, in_right: Column, y: Column) -> DataFrame:
    """key, state of result_diff() where both sides are columns of the same rows, which are then read once: whether a row is in the reference with x, and in the result with y."""
    state = F.when(~in_right, "missing").when(~in_left, "extra").when(x.eqNullSafe(y), "equal").otherwise("different")
    return rows.where(in_left | in_right).select(key, state.alias("state"))


def capped(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """At most n rows of each group, the first in order: the report's limit is the feature."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def best_of(rows: DataFrame, group: list[str], score: Column, tie: str) -> DataFrame:
    """The row with the best score of each group, ties by the tie column."""
    return rows.groupBy(*group).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in group]), F.struct((-score).alias("s"), F.col(tie).alias("t"))).alias("r")).select(*group, "r.*")


def across(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """a, b, a_split, b_split of the pairs whose ends are in different splits."""
    x, y = splits.select(F.col("name").alias("a"), F.col("split").alias("a_split")), splits.select(F.col("name").alias("b"), F.col("split").alias("b_split"))
    return pairs.join(x, "a").join(y, "b").where("a_split <> b_split").select("a", "b", "a_split", "b_split")


def families(edges: DataFrame, nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, family: the smallest node of each component, by least labels passed on and then jumped; edges (a, b) in either direction.

    Rounds read checkpoints and go on until no label changes; only whether one did reaches
    the driver. With a bound on the rounds, families that are unfinished there are an error.
    """
    sc = edges.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = edges.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None:
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(at)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("family")).checkpoint()
    done = 0
    while True:
        if rounds is not None and done == rounds:
            raise RuntimeError(f"families still changed after {rounds} rounds")
        done += 1
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("family").alias("m"))
        step = labels.join(near, "node", "left").select("node", "family", F.least("family", F.coalesce("m", "family")).alias("new"))
        jump = step.alias("s").join(labels.alias("l"), F.col("s.new") == F.col("l.node")).select("s.node", "s.family", F.least("s.new", "l.family").alias("new")).checkpoint()
        labels = jump.select("node", F.col("new").alias("family"))
        if jump.where("new <> family").isEmpty():
            return labels


def utterance_plan(forms: DataFrame, rates: list[int], offset: int = 0) -> DataFrame:
    """form rows (form, i) times takes, with the rate that turns by offset and index."""
    own = F.array(*[F.lit(r) for r in rates])
    takes = forms.withColumn("take", F.explode(F.sequence(F.lit(0), F.lit(len(rates) - 1))))
    return takes.withColumn("rate", F.element_at(own, ((offset + F.col("i") + F.col("take")) % len(rates) + 1).cast("int")))


def pak_layout(clips: DataFrame, head: int = 16, entry: int = 20, to: int = 4) -> DataFrame:
    """id, offset, length: the places of aligned blobs behind a header and an index, by id.

    Running sums are taken inside ranges of ids, and a range starts with the sum of those
    before it, so no task sees more than its range. Only a row for each range is ever
    ordered in one task.
    """
    up = lambda c: F.floor((c + (to - 1)) / to).cast("long") * to
    parts = int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [r.id for r in clips.select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(64 * parts).select("id").distinct().orderBy("id").collect()][32::64]
    part = F.lit(0)
    for c in cuts if len(cuts) <= 64 else cuts[:: -(-len(cuts) // 64)]:
        part = part + (F.col("id") >= c).cast("int")
    rows = clips.select("id", "length", up(F.col("length")).alias("size"), part.alias("part"))
    sums = rows.groupBy("part").agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    whole, order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("start"), F.sum("k").over(Window.partitionBy()).alias("clips"))
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0))).join(F.broadcast(start), "part")
    return placed.select("id", (up(F.lit(head) + F.col("clips") * entry) + F.col("start") + F.col("before")).alias("offset"), "length")
