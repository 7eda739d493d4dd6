"""Near-duplicate documents by min-max hashing, with links confirmed on whole shingle sets.

One pass over the texts hashes each document's distinct word shingles under a few dozen
permutations and keeps both the smallest and the largest value of each, so that half the
hash evaluations fill a signature. Rows of minima and rows of maxima make bands.

Documents with equal sets form a class, and from there on only classes count. In each
bucket (classes with one band in common) the smallest id is the pivot, and every other
member is compared with it. Pairs of which neither is the pivot matter only if the links
found so far don't join them; such buckets are compared in blocks. So all candidate pairs
are decided, but no task holds a bucket and no list of pairs is ever made.

Two documents that reach the threshold of 0.85 share a band with a probability of
1 - (1 - 0.85^4)^24, over 0.9999999.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.llm.base import arrow_schema, batch, cut, free, partitions, table, text_batches, trim
from utterloom.llm.bits import bits_of, passes
from utterloom.llm.components import components
from utterloom.llm.syncmers import grams, mix

WORDS, PERCENT = 5, 85
ROWS, GROUPS = 4, 12  # a group of ROWS permutations makes two bands, one of minima and one of maxima
BLOCK = 256  # members of a bucket that a task holds at a time, twice
FACTORS = mix(np.arange(1, ROWS * GROUPS + 1, dtype=np.uint64)) | np.uint64(1)
OFFSETS = mix(np.arange(1, ROWS * GROUPS + 1, dtype=np.uint64) << np.uint64(32))
SIGNED = "n_shingles long, digest binary, bands array<long>"


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. A-Z are lower-cased; a text with fewer words is one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 1)], np.uint64)
    return np.unique(mix(grams(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts)), words)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Band hashes of a set that isn't empty."""
    low, high = None, None
    for i in range(0, len(hashes), 4096):
        values = hashes[i : i + 4096, None] * FACTORS + OFFSETS
        a, b = values.min(axis=0), values.max(axis=0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    rows = np.concatenate([low, high]).reshape(2 * GROUPS, ROWS)
    out = np.arange(2 * GROUPS, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out + rows[:, i])
    return out.view(np.int64)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null for an empty one), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *arrow_schema(SIGNED.replace(", ", ","))])
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                x = shingles(text, words)
                rows.append((doc, len(x), xxhash.xxh3_128_digest(x.tobytes()), signature(x)) if len(x) else (doc, 0, None, None))
            yield batch(rows, schema)
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {SIGNED}")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """digest, hashes of the wanted (id, digest). Texts are read again and hashed where a filter of ids lets them pass; no text is shuffled."""
    ids = bits_of(wanted, F.col("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("digest binary,hashes array<long>")
        for b in batches:
            own = b.filter(pa.array(passes(ids.value, b.column("id").to_numpy(zero_copy_only=False))))
            sets = [x for x in (shingles(t, words) for t in own.column("text").to_pylist()) if len(x)]
            yield batch([(xxhash.xxh3_128_digest(x.tobytes()), x.view(np.int64)) for x in sets], schema)

    made = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null").mapInArrow(run, "digest binary, hashes array<long>")
    return made.join(wanted.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.first("hashes").alias("hashes"))


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """Rows of a list column as arrays of unsigned longs."""
    values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [values[s:e] for s, e in zip(ends, ends[1:])]


def common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum())


def linked(shared, size_a, size_b, percent: int):
    return 100 * shared >= percent * (size_a + size_b - shared)


def pivot_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (id, digest, pivot, pivot_digest) that are linked.

    A pivot's members are dealt to parts of about 4 * BLOCK, each with the pivot's set,
    which comes first; the task that reads a part holds two sets.
    """
    spark = pairs.sparkSession
    parts = cut(pairs.groupBy("pivot_digest").agg(F.first("pivot").alias("pivot"), F.ceil(F.count("*") / (4 * BLOCK)).cast("int").alias("parts")))
    own = parts.join(sets, parts.pivot_digest == sets.digest).select("pivot_digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"), F.col("pivot").alias("id"), "hashes")
    dealt = pairs.join(parts.select("pivot_digest", "parts"), "pivot_digest").select("pivot_digest", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"), "id", "digest")
    rows = dealt.join(sets, "digest").select("pivot_digest", "part", "member", "id", "hashes").unionByName(own)
    rows = rows.repartition(partitions(spark), "pivot_digest", "part").sortWithinPartitions("pivot_digest", "part", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, pivot, held = arrow_schema("a long,b long"), None, None
        for b in batches:
            out = []
            for member, i, x in zip(b.column("member").to_pylist(), b.column("id").to_pylist(), lists(b.column("hashes"))):
                if not member:
                    pivot, held = i, x.copy()
                elif linked(common(held, x), len(held), len(x), percent):
                    out.append((pivot, i))
            yield batch(out, schema)

    return rows.mapInArrow(run, "a long, b long")


def block_links(sets: list[np.ndarray], parts: list[int], percent: int) -> list[tuple[int, int]]:
    """Index pairs that join different parts, as few as join all that links join. Counts are products of 0-1 matrices."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.float64)
    every, shared = np.unique(np.concatenate(sets)), np.zeros((n, n))
    at = [np.searchsorted(every, x) for x in sets]
    for lo in range(0, len(every), 8192):
        has = np.zeros((n, min(8192, len(every) - lo)), np.float32)
        for i, x in enumerate(at):
            has[i, x[np.searchsorted(x, lo) : np.searchsorted(x, lo + 8192)] - lo] = 1
        shared += has @ has.T
    root = {p: p for p in parts}

    def find(p: int) -> int:
        while root[p] != p:
            p = root[p]
        return p

    out = []
    for i, j in np.argwhere(np.triu(linked(shared, sizes[:, None], sizes[None, :], percent), 1)):
        a, b = find(parts[i]), find(parts[j])
        if a != b:
            root[a] = b
            out.append((int(i), int(j)))
    return out


def rest_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that the pivots' links don't imply, in buckets of members (bucket, id, digest, part).

    A bucket with n members is cut into about n / BLOCK blocks, and every two blocks meet
    in one task. Buckets with the same members are compared once.
    """
    spark = members.sparkSession
    size = members.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("who"))
    size = cut(size.where("parts > 1 and n > 2").groupBy("n", "who").agg(F.min("bucket").alias("bucket")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    own = members.join(size.select("bucket", "blocks"), "bucket").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = own.select("bucket", "block", "id", "part", "digest", other).select("bucket", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "id", "part", "digest")
    rows = rows.join(sets, "digest").select("bucket", "first", "second", "id", "part", "hashes")
    rows = rows.repartition(partitions(spark), "bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at, held = arrow_schema("a long,b long"), None, []

        def done() -> list[tuple]:
            return [(held[i][0], held[j][0]) for i, j in block_links([x[2] for x in held], [x[1] for x in held], percent)] if held else []

        for b in batches:
            out = []
            keys = zip(*(b.column(c).to_pylist() for c in ("bucket", "first", "second")))
            for key, i, part, x in zip(keys, b.column("id").to_pylist(), b.column("part").to_pylist(), lists(b.column("hashes"))):
                if key != at:
                    out += done()
                    at, held = key, []
                held.append((i, part, x.copy()))
            yield batch(out, schema)
        if held:
            yield batch(done(), schema)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; other columns are left out.

    Documents are linked if the shared shingles are at least percent of both texts'
    together; component_id is the smallest id that links lead to. Null and empty texts
    have no shingles and no links. Rows with equal ids count as one document. A row
    without an id takes the component of its equals that have one; else its component is
    null and it is kept.
    """
    text_batches(docs.sparkSession)
    each = cut(signed(docs, words))
    classes = cut(each.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    rows = classes.where("id is not null").select("id", "digest", F.posexplode("bands").alias("band", "hash"))
    rows = rows.select("id", "digest", F.xxhash64("band", "hash").alias("bucket"))
    buckets = cut(rows.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot"))
    members = cut(rows.join(buckets, "bucket").select("bucket", "id", "digest", "pivot"))
    free(buckets)
    wanted = cut(members.select("id", "digest").distinct())
    pivots = wanted.select(F.col("id").alias("pivot"), F.col("digest").alias("pivot_digest"))
    pairs = cut(members.where("id <> pivot").select("id", "digest", "pivot").distinct().join(pivots, "pivot"))
    sets = cut(sets_of(docs, wanted, words))
    links = cut(pivot_links(pairs, sets, percent))
    free(wanted, pairs)
    roots = components(links)
    free(links)
    parts = cut(members.join(roots, members.id == roots.node, "left").select("bucket", "id", "digest", F.coalesce("root", "id").alias("part")))
    free(members)
    more = cut(rest_links(parts, sets, percent))
    free(parts, sets)
    if not more.isEmpty():
        first, roots = roots, components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        free(first)
    free(more)
    own = cut(classes.select("digest", "id").join(roots, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("root", "id").alias("root")))
    free(classes, roots)
    out = cut(each.select("doc_id", "n_shingles", "digest").join(own, "digest", "left"))
    free(each, own)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("root"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; columns of docs."""
    gone = cut(near_duplicates(docs, percent, words).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
tokens AS (SELECT doc_id, len(w) AS n, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM words),
runs AS (
  SELECT doc_id, n, i, concat_ws(' ', t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o) AS x
  FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, x FROM runs WHERE i + 5 <= n OR (i = 0 AND n < 5)),
sizes AS MATERIALIZED (SELECT w.doc_id, count(s.x) AS n FROM (SELECT DISTINCT doc_id FROM words) w LEFT JOIN shingles s ON s.doc_id = w.doc_id GROUP BY 1),
shared AS MATERIALIZED (SELECT doc_id, x FROM (SELECT *, count(*) OVER (PARTITION BY x) AS k FROM shingles) WHERE k > 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shared a JOIN shared b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id),
roots AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN roots USING (doc_id)
"""
