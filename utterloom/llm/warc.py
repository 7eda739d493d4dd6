"""Writing pages as WARC archives and reading archives back in splits.

The writer puts a record for each page into plain files, through Spark's text writer with
the record's end as line separator. The payload's full text goes into one record of each
group of equal payloads; the others are revisits of it.

The reader splits the files at every "WARC/1.0" line, wherever it stands. Each such place
is a candidate record, and its header says where the next record starts. Candidates in
payloads say so too, but their chains are not those of the file: a task follows the chains
inside its split and gives each candidate the place where its chain leaves the split, the
places between splits are followed from the start of the file by pointer jumping, in
rounds that grow with the logarithm of a file's number of splits, and only what the file's
start reaches is a record. Files are plain, of version 1.0. A payload with candidates in it spans several pieces; the
pieces of such records are read again and put together.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterloom.llm.base import arrow_schema, batch, cut, free, partitions, scratch, shuffles_freed, table, text_batches
from utterloom.llm.bits import bits_of, passes

MAGIC, END = b"WARC/1.0\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PIECE = f"file string, size long, split long, at long, length long, span long, whole boolean, {RECORD}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """A record up to its end mark. A revisit holds the headers of the answer without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def header(data: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Fields of the header that data starts with, names in lower case, and its length; None where it isn't one."""
    end = data.find(END)
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields, end + len(END)


def span_of(piece: bytes) -> tuple[int, int] | None:
    """(length of the record that starts with this piece after its magic, magic and end mark included; bytes of the piece it needs)."""
    found = header(piece)
    if found is None or not (n := found[0].get(b"content-length", b"")).isdigit() or len(n) > 18:
        return None
    need = found[1] + int(n)
    return len(MAGIC) + need + len(END), need


def number(mark: bytes | None) -> int | None:
    text = (mark or b"").removeprefix(b"<urn:x-page:").removesuffix(b">")
    return int(text) if text.lstrip(b"-").isdigit() else None


def parse(piece: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a whole record after its magic."""
    fields, at = header(piece)
    block = piece[at : at + int(fields[b"content-length"])]
    kind, page = fields.get(b"warc-type", b"").decode("utf-8", "replace"), number(fields.get(b"warc-record-id"))
    start = block.find(END)
    payload = block[start + len(END) :] if start >= 0 else block
    if kind != "revisit":
        return page, len(payload), base32_sha1(payload), kind, None
    http = dict(x.split(b":", 1) for x in block[: max(start, 0)].lower().split(b"\r\n")[1:] if b":" in x)
    size = http.get(b"content-length", b"").strip()
    digest = fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    return page, int(size) if size.isdigit() else None, digest, kind, number(fields.get(b"warc-refers-to"))


# ---- writer -----------------------------------------------------------------


def write(pages: DataFrame, path: str) -> None:
    """A record for each page under path.

    Payloads travel compressed, and only those of pages that may be a group's response, told
    by a filter of ids; rows of a hot payload are light and split by the skew join.
    """
    text_batches(pages.sparkSession)
    kind = dict(pages.dtypes)["page_id"]
    html = F.coalesce("html", F.lit(""))
    groups = cut(pages.select(F.unhex(F.sha1(html)).alias("digest"), F.col("page_id").cast("long")).groupBy("digest").agg(F.max("page_id").alias("refers_to")))

    bits = bits_of(groups, F.col("refers_to"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=6).compress
        for b in batches:
            own = [x.encode("utf-8", "surrogatepass") for x in b.column("html").to_pylist()]
            ids = b.column("page_id").cast(pa.int64())
            may = passes(bits.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            more = [pa.array([hashlib.sha1(x).digest() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64()), pa.array([squeeze(x) if m else None for x, m in zip(own, may)], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *more], names=["page_id", "url", "digest", "size", "payload"])

    small = pages.select("page_id", "url", html.alias("html")).mapInArrow(shrink, f"page_id {kind}, url string, digest binary, size long, payload binary")
    rows = small.join(groups, "digest").select(F.col("page_id").cast("long").alias("page_id"), "url", "digest", "size", "payload", "refers_to")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        widen = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = []
            for page, url, digest, size, payload, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "payload", "refers_to"))):
                revisit = page != refers
                out.append(record(page, url, b"" if revisit else widen(payload, max_output_size=size or 1), base64.b32encode(digest).decode(), size, refers, revisit))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    with shuffles_freed(pages.sparkSession):
        rows.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).text(path)
    free(groups)


# ---- reader -----------------------------------------------------------------


def split_pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between the magics of the files, in order within each split."""
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[int], pa.RecordBatch]]:
    """Each batch with its pieces' places, counted from the first piece of their split."""
    split, at = None, 0
    for b in batches:
        places = []
        own = list(zip(b.column("file").to_pylist(), b.column("split").to_pylist()))
        for key, n in zip(own, pa.compute.binary_length(b.column("piece")).to_pylist()):
            if key != split:
                split, at = key, 0
            places.append(at)
            at += n + len(MAGIC)
        yield own, places, b


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece: its place, its length, and the record that it would start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(PIECE.replace(", ", ","))
        for own, places, b in numbered(batches):
            rows = []
            for (file, split), at, size, piece in zip(own, places, b.column("size").to_pylist(), b.column("piece").to_pylist()):
                span, need = span_of(piece) or (None, 0)
                whole = span is not None and len(piece) >= need
                rows.append((file, size, split, at, len(piece), span, whole, *(parse(piece) if whole else (None,) * 5)))
            yield batch(rows, schema)

    return split_pieces(spark, path).mapInArrow(run, PIECE)


def place(spark_rows: DataFrame) -> DataFrame:
    """The rows with offset, where the candidate's magic stands in its file, and stop, where the split's last piece ends.

    A split's pieces follow those of the splits before, whatever bytes it starts at; the sum of all has to be the file's size.
    """
    ends = spark_rows.groupBy("file", "split", "size").agg(F.sum(F.col("length") + len(MAGIC)).alias("n"))
    base = ends.withColumn("stop", F.expr(f"sum(n) over (partition by file order by split) - {len(MAGIC)}"))
    base = base.withColumn("last", F.expr("max(stop) over (partition by file)"))
    checked = F.when(F.col("last") == F.col("size"), F.col("stop")).otherwise(F.raise_error(F.concat(F.lit("pieces don't add up to the file: "), F.col("file"))).cast("long"))
    base = cut(base.select("file", "split", checked.alias("stop"), (F.col("stop") - F.col("n")).alias("base")))
    return spark_rows.join(base, ["file", "split"]).withColumn("offset", F.col("base") + F.col("at"))


def leave(rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of one split, where its chain goes on beyond the split; none for a chain that breaks."""
    stop, out = int(rows["stop"].iloc[0]), {}
    for offset, span in sorted(zip(rows["offset"], rows["span"]), reverse=True):
        after = int(offset) + int(span)
        out[int(offset)] = after if after >= stop else out.get(after)
    keep = [(o, a) for o, a in out.items() if a is not None]
    return pd.DataFrame({"file": rows["file"].iloc[0], "offset": [o for o, _ in keep], "after": [a for _, a in keep]})


def follow(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one split that its entry reaches."""
    span = dict(zip(rows["offset"], rows["span"]))
    at, got = rows["entry"].iloc[0], set()
    while at in span:
        got.add(at)
        at += span[at]
    return rows.loc[rows["offset"].isin(got), ["file", "offset"]]


def reached(candidates: DataFrame) -> DataFrame:
    """file, offset of the candidates (file, split, stop, offset, span) that the files' starts reach."""
    spark = candidates.sparkSession
    splits = candidates.groupBy("file").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] or 1
    jumps = candidates.groupBy("file", "split").applyInPandas(leave, "file string, offset long, after long")
    jumps = cut(jumps)
    doors = jumps.select("file", F.col("after").alias("offset")).distinct()
    jumps = cut(jumps.join(doors, ["file", "offset"], "left_semi").unionByName(jumps.where("offset = 0")).distinct())
    entries = candidates.select("file").distinct().withColumn("offset", F.lit(0).cast("long"))
    for _ in range(math.ceil(math.log2(splits)) + (splits > 1)):
        entries = cut(entries.unionByName(entries.join(jumps, ["file", "offset"]).select("file", F.col("after").alias("offset"))).distinct())
        twice = jumps.alias("x").join(jumps.alias("y"), (F.col("x.file") == F.col("y.file")) & (F.col("x.after") == F.col("y.offset")))
        jumps = cut(twice.select("x.file", "x.offset", "y.after"))
    own = candidates.select("file", "split", "offset").join(entries, ["file", "offset"], "left_semi").select("file", "split", F.col("offset").alias("entry"))
    return candidates.join(cut(own), ["file", "split"]).groupBy("file", "split").applyInPandas(follow, "file string, offset long")


def mark() -> Column:
    """A long for a piece, also computed by joined()."""
    return (F.crc32("file") * 1_000_003 + F.col("split") + F.col("at")).cast("long")


def joined(spark: SparkSession, path: str, pieces: DataFrame) -> DataFrame:
    """The records of pieces (file, split, at, record, n), read again. A task puts one record together at a time."""
    bits = bits_of(pieces, mark())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, places, b in numbered(batches):
            marks = np.array([zlib.crc32(f.encode()) * 1_000_003 + s + a for (f, s), a in zip(own, places)], np.int64)
            some = pa.RecordBatch.from_arrays([b.column("file"), b.column("split"), pa.array(places, pa.int64()), b.column("piece")], names=["file", "split", "at", "piece"])
            yield some.filter(pa.array(passes(bits.value, marks)))

    rows = split_pieces(spark, path).mapInArrow(pick, "file string, split long, at long, piece binary").join(pieces, ["file", "split", "at"])
    rows = rows.select("file", "record", "n", "piece").repartition(partitions(spark), "file", "record").sortWithinPartitions("file", "record", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at, held = arrow_schema(RECORD.replace(", ", ",")), None, []
        for b in batches:
            out = []
            for *key, piece in zip(b.column("file").to_pylist(), b.column("record").to_pylist(), b.column("piece").to_pylist()):
                if key != at:
                    out += [parse(MAGIC.join(held))] if held else []
                    at, held = key, []
                held.append(piece)
            yield batch(out, schema)
        if held:
            yield batch([parse(MAGIC.join(held))], schema)

    return rows.mapInArrow(run, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under path; see RECORD. What only looks like a record isn't returned."""
    text_batches(spark)
    scanned = cut(scan(spark, path))
    rows = cut(place(scanned))
    free(scanned)
    found = rows.where("offset >= 0 and span is not null")
    true = cut(reached(found.select("file", "split", "stop", "offset", "span")))
    records = cut(found.join(true, ["file", "offset"]))
    free(true)
    names = [x.split()[0] for x in RECORD.split(", ")]
    whole = records.where("whole").select(*names)
    if records.where("not whole").isEmpty():
        free(rows)
        return whole
    starts = records.select("file", "offset", F.struct(F.col("offset").alias("record"), (F.col("offset") + F.col("span")).alias("until"), "whole").alias("r"))
    own = F.last("r", True).over(Window.partitionBy("file").orderBy("offset"))  # a file's light rows
    inside = rows.select("file", "split", "at", "offset").join(starts, ["file", "offset"], "left").withColumn("r", own)
    inside = inside.where("not r.whole and offset < r.until")
    pieces = cut(inside.select("file", "split", "at", "r.record", F.col("offset").alias("n")))
    return whole.unionByName(joined(spark, path, pieces))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, read back from archives in the shared folder.

    A null html is an empty payload; equal payloads of rows with the group's largest
    page_id are all responses; page_ids of null count as smaller than any. No pages, no records.
    """
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path)


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex, max(page_id) AS top FROM p GROUP BY hex),
bits AS (
  SELECT hex, array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      (('0x' || substr(hex, 1 + (5 * i) // 4, 2) || CASE WHEN (5 * i) // 4 = 39 THEN '0' ELSE '' END)::INTEGER >> (3 - (5 * i) % 4)) & 31)::INTEGER, 1)), '') AS digest
  FROM g)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN g USING (hex) JOIN bits USING (hex)
"""
