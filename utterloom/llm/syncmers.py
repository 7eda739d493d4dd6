"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest of its inner s-mers, by hash, is its
first or its last. Whether it is depends on the k-mer alone and not on its neighbours, so
an edit moves only the anchors that it touches: the anchors of a text whose tail was
replaced are the old ones before the cut plus those of the new tail. Shared anchors with
one shift of position mark shared spans.

A fingerprint lists all anchors in order of position, as 32 bits of hash and 32 bits of
position each, in hex; it grows with the text. The likeness of two fingerprints is the
share of common hashes among the distinct ones of both, and their positions tell where
the common spans are, which the result lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.llm.base import arrow_schema, batch, partitions, table, text_batches

K, S = 24, 8
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_spans string, next_spans string"
LOWEST = -(2**63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(n: int) -> np.uint64:
    return np.uint64(pow(int(FACTOR), n, 1 << 64))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def grams(one: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of width codes, in about log(width) passes."""
    h, n = one * FACTOR + np.uint64(1), 1
    single = h
    for bit in bin(width)[3:]:
        h, n = h[: len(h) - n] * power(n) + h[n:], 2 * n
        if bit == "1":
            h, n = h[: len(h) - 1] * FACTOR + single[n:], n + 1
    return h


def lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of width."""
    n, m = 1, x
    while 2 * n <= width:
        m, n = np.minimum(m[: len(m) - n], m[n:]), 2 * n
    return np.minimum(m[: len(x) - width + 1], m[width - n : len(x) - n + 1]) if n < width else m


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers, in order of position."""
    if len(text) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inner = grams(codes(text), s)
    order = mix(inner)
    least, n = lowest(order, k - s + 1), len(text) - k + 1
    at = np.flatnonzero((least == order[:n]) | (least == order[k - s :]))
    h, done = inner[at], s
    while done < k:  # the k-mer's hash from those of its inner runs, which overlap at the end
        step = min(s, k - done)
        h, done = h * power(step) + inner[at + done + step - s], done + step
    return at, mix(h)


def marked(at: np.ndarray, hashes: np.ndarray, text: str) -> np.ndarray:
    """All anchors, hash over position. A text without anchors stands for itself; the empty text has none."""
    if not len(hashes) and text:
        return np.array([xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass")) << 32], np.uint64)
    return hashes >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)


def to_text(marks: np.ndarray) -> str:
    return marks.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the distinct ones of both; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    a, b = np.unique(a >> np.uint64(32)), np.unique(b >> np.uint64(32))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def spans(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int = K) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of what two lists of (positions, hashes) have in common, from anchors with one shift.

    Only anchors that occur once in each list are matched. Spans are in order of their
    start in a and run from the first to the end of the last anchor of the same shift
    without another shift in between; the characters in between may differ.
    """
    once = []
    for at, h in (a, b):
        h, first, n = np.unique(h, return_index=True, return_counts=True)
        once.append((h[n == 1], at[first[n == 1]]))
    _, i, j = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    out: list[list[int]] = []
    for p, q in sorted(zip(once[0][1][i].tolist(), once[1][1][j].tolist())):
        if out and out[-1][0] - out[-1][1] == p - q:
            out[-1][2] = p + k - out[-1][0]
        else:
            out.append([p, q, k])
    return [tuple(x) for x in out]


def matches(a: np.ndarray, b: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """The common spans of two fingerprints' marks, without their texts."""
    low = np.uint64(0xFFFFFFFF)
    return spans(*(((x & low).astype(np.int64), x >> np.uint64(32)) for x in (a, b)), k)


def listed(found: list[tuple[int, int, int]]) -> str:
    """Spans as start:start:length, comma-joined."""
    return ",".join(f"{p}:{q}:{n}" for p, q, n in found)


def shared_spans(a: str, b: str, k: int = K, s: int = S) -> list[tuple[int, int, int]]:
    """The common spans of two texts."""
    return spans(anchors(a, k, s), anchors(b, k, s), k)


class Marked:
    """A text with its anchors and its marks."""

    def __init__(self, doc, text: str | None):
        self.doc, self.text = doc, text or ""
        self.at, self.hashes = anchors(self.text)
        self.marks = marked(self.at, self.hashes, self.text)

    def row(self, after: Marked) -> tuple:
        """The result's row, given the next document."""
        n = len(self.text)
        kept = n - n // 3
        edited = self.text[:kept] + after.text[: n // 3]
        old, cut = self.at <= kept - K, max(0, kept - K + 1)  # anchors depend on their own text alone
        at, tail = anchors(edited[cut:])
        marks = marked(np.concatenate([self.at[old], at + cut]), np.concatenate([self.hashes[old], tail]), edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc, n, sha, to_text(self.marks), to_text(marks), likeness(self.marks, marks), likeness(self.marks, after.marks), listed(matches(self.marks, marks)), listed(matches(self.marks, after.marks))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint and that of its edited text; see SCHEMA.

    Documents follow each other by descending doc_id, nulls last, equal ids by text; the
    last is followed by the first, a single one by itself. They are dealt to buckets by id
    ranges, and the first document of each bucket also goes, as a reader's copy, to the
    bucket before. One shuffle; a task reads its bucket in order and keeps one document.
    A null text is empty. Repeated rows each have a row. No rows give no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kind, parts = dict(docs.dtypes)["doc_id"], partitions(spark)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"))
    cuts = sorted(set(rows.select("key").stat.approxQuantile("key", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    cuts = np.array([int(c) for c in cuts], np.int64)

    @F.arrow_udf("int")
    def bucket_of(key: pa.Array) -> pa.Array:  # by descending key
        return pa.array(len(cuts) - np.searchsorted(cuts, key.to_numpy(zero_copy_only=False), "right"), pa.int32())

    rows = rows.withColumn("bucket", bucket_of("key"))
    heads = {r.bucket: r.key for r in rows.groupBy("bucket").agg(F.max("key").alias("key")).collect()}  # a row for each bucket
    order = sorted(heads, reverse=True)
    first = np.array([heads[b] for b in order], np.int64)  # ascending, as buckets descend by key
    before = np.array([order[(i + 1) % len(order)] for i in range(len(order))], np.int64)

    @F.arrow_udf("int")
    def copy_to(key: pa.Array) -> pa.Array:  # the bucket before, for the keys that a bucket begins with
        key = key.to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(first, key), max(len(first) - 1, 0))
        return pa.array(before[at] if len(first) else key, pa.int32(), mask=first[at] != key if len(first) else np.ones(len(key), bool))

    places = F.array(F.struct("bucket", F.lit(False).alias("copy")), F.struct(copy_to("key").alias("bucket"), F.lit(True).alias("copy")))
    dealt = rows.select("doc_id", "text", "key", F.explode(places).alias("at")).select("doc_id", "text", "key", "at.*").where("bucket is not null")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "copy", F.desc("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, schema = None, None, None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("doc_id"), *arrow_schema(SCHEMA.replace(", ", ","))])
            out = []
            for doc, text, bucket, copy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "copy"))):
                if copy and (last is None or bucket != at):
                    continue
                now = Marked(doc, text)
                if last is not None:
                    out.append(last.row(now))
                last, at = (None if copy else now), bucket
            yield batch(out, schema)

    return dealt.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
