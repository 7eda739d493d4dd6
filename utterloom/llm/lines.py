"""Removing repeated and nearly repeated lines with a segment-partition edit join.

A line of length l that may differ in t places is split into t + 1 segments; a line
within t edits of it contains one of them unchanged, at a position that the two lengths
bound. So each line's segments are indexed under (l, number of the segment, content),
and each line probes the substrings that could match the segments of lines as long as
itself or up to t shorter. Lines with a key in common are verified by banded bit-parallel
edit distance, thousands of pairs at a time.

Only hashes travel at first: keys that two lines share are found, and then the texts of
just the lines that have such keys go to the tasks that verify them, in blocks where many
lines share a key. Of each group of linked lines the first, by document and line number,
stays; equal lines are linked whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.llm.base import arrow_schema, batch, cut, free, partitions, portions, table, text_batches, trim
from utterloom.llm.bits import bits_of, passes
from utterloom.llm.components import components
from utterloom.llm.perplexity import SPACES
from utterloom.llm.syncmers import FACTOR, mix

#: Shortest lines, in characters, that may differ in one place and in two.
EDITS = ((20, 1), (40, 2))
BLOCK, PAIRS = 256, 8192  # lines of a key that meet in one task; pairs verified at a time
HELD, COLUMNS = 1 << 21, 128  # characters of lines of several keys that wait to be verified; of a line, laid out at a time
CHARS = 1 << 18  # characters of lines whose keys are made at a time; a longer line is alone


def line_id(line: str) -> int:
    """Signed 64 bits that stand for a line."""
    return (xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) ^ (1 << 63)) - (1 << 63)



def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(line number, line without white space around it) of the lines that hold more than white space."""
    return [(i, x) for i, x in enumerate(y.strip(SPACES) for y in (text or "").split("\n")) if x]


def allowed(length: int, edits=EDITS) -> int:
    """Places in which a line of this length and one as long or longer may differ."""
    return max((t for n, t in edits if length >= n), default=0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd factor modulo 2^64, and their inverses; kept for the largest n so far."""
    if len(_POWERS[0]) < n:
        for i, factor in enumerate((int(FACTOR), pow(int(FACTOR), -1, 1 << 64))):
            steps = np.full(n, factor, np.uint64)
            steps[:1] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


_POWERS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def keys(lines: list[str], edits=EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all lines as signed longs, the line's index of each, and whether it is one of the line's own segments.

    A line of length l splits into t + 1 segments, the last ones longer by one. For each
    segment number and each length that the other line may have, all lines' substrings at
    one shift are hashed at once, from sums of code points times powers.
    """
    n = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first, (up, down) = np.cumsum(n) - n, powers(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up[: len(codes)], dtype=np.uint64)])
    out = []
    for shorter in range(max((t for _, t in edits), default=0) + 1):
        other = n - shorter
        may = np.zeros(len(n), np.int64)
        for least, t in sorted(edits):
            may[other >= least] = t
        for t in {t for _, t in edits if t >= max(shorter, 1)}:
            rows = np.flatnonzero(may == t)
            own, length = n[rows], other[rows]
            size, longer = np.divmod(length, t + 1)
            for i in range(t + 1):
                start, width = i * size + np.maximum(0, i - (t + 1 - longer)), size + (i > t - longer)
                low = np.maximum(np.maximum(0, start - i), start + shorter - (t - i))
                high = np.minimum(np.minimum(own - width, start + i), start + shorter + (t - i))
                for shift in range(-i, i + 1):
                    at = start + shift
                    k = np.flatnonzero((at >= low) & (at <= high))
                    s, e = first[rows[k]] + at[k], first[rows[k]] + at[k] + width[k]
                    mark = mix((length[k] * 8 + i).astype(np.uint64))
                    out.append((mix((sums[e] - sums[s]) * down[s] + mark).view(np.int64), rows[k], np.full(len(k), not shorter and not shift)))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def within(a: list[np.ndarray], b: list[np.ndarray], t: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most t.

    Column by column over all pairs at once. A word's 2t + 1 bits are the cells of the
    band in one column, as vertical differences; the distance is followed along the
    band's lower edge until it reaches the last row, and then along that row. Pairs over
    t leave early. Only the characters of the next COLUMNS columns are laid out, so what
    is held doesn't grow with the lines.
    """
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    ok = np.abs(la - lb) <= t
    on = np.flatnonzero(ok)
    if not len(on):
        return ok
    m, n = la[on], lb[on]
    full, top = np.uint32((1 << 2 * t + 1) - 1), np.uint32(2 * t)
    vp = np.full(len(on), ((1 << t + 1) - 1) << t, np.uint32)
    vn, dist = np.zeros(len(on), np.uint32), np.full(len(on), t)
    done, at = np.zeros(len(ok), bool), np.arange(len(on))
    for j in range(1, int(max(m.max(), n.max())) + 2):
        ended = n < j
        if ended.any():
            done[on[ended & (dist <= t)]] = True
            live = ~ended
            on, m, n, vp, vn, dist, at = on[live], m[live], n[live], vp[live], vn[live], dist[live], at[live]
        if not len(on):
            break
        if (k := (j - 1) % COLUMNS) == 0:
            pa_, pb_, at = columns(a, on, j - 1 - t, COLUMNS + 2 * t), columns(b, on, j - 1, COLUMNS), np.arange(len(on))
        char, match = pb_[at, k], np.zeros(len(on), np.uint32)
        for i in range(2 * t + 1):
            match |= (pa_[at, k + i] == char).astype(np.uint32) << np.uint32(i)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        row = np.maximum(m - j + t, 0).astype(np.uint32)
        dist = dist + np.where(j <= m - t, 1 - (d0 >> top & 1).astype(np.int64), (hp >> row & 1).astype(np.int64) - (hn >> row & 1).astype(np.int64))
        vp, vn = (hn | ~(d0 >> np.uint32(1) | hp)) & full, (d0 >> np.uint32(1)) & hp
        if j % 8 == 0 and (far := dist > 2 * t + np.maximum(n - m, 0)).any():  # along the last row it falls by one a column at most
            live = ~far
            on, m, n, vp, vn, dist, at = on[live], m[live], n[live], vp[live], vn[live], dist[live], at[live]
    done[on[dist <= t]] = True
    return done


def columns(lines: list[np.ndarray], on: np.ndarray, start: int, n: int) -> np.ndarray:
    """The n characters from start of each line in on, plus 2; 0, which matches nothing, where a line has none."""
    out, skip = np.zeros((len(on), n), np.uint32), max(0, -start)
    for k, i in enumerate(on):
        own = lines[i][start + skip : start + n]
        out[k, skip : skip + len(own)] = own + np.uint32(2)
    return out


class Verifier:
    """Pairs of lines, verified in batches; gives as few links as join all that are linked."""

    def __init__(self, edits=EDITS):
        self.edits, self.pairs, self.held, self.root = edits, [], 0, {}

    def find(self, x: int) -> int:
        while (up := self.root.setdefault(x, x)) != x:
            self.root[x] = self.root[up] if up in self.root else up
            x = up
        return x

    def group(self, members: list[tuple[int, str]]) -> Iterator[tuple[int, int]]:
        """Links among lines that share a key, or of earlier groups."""
        rows = sorted((len(s), i, np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")) for i, s in members)
        for x, (n, i, s) in enumerate(rows):
            t = allowed(n, self.edits)
            for k, j, r in rows[x + 1 :]:
                if k - n > t:
                    break
                if i != j and self.find(i) != self.find(j):
                    self.pairs.append((t, i, j, s, r))
            if len(self.pairs) >= PAIRS:
                yield from self.flush()
        self.held += sum(r[0] for r in rows) if self.pairs else 0
        if self.held >= HELD:  # pairs of other keys would keep more lines
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, int]]:
        pairs, self.pairs, self.held = sorted(self.pairs, key=lambda p: (p[0], len(p[3]))), [], 0
        for t in sorted({p[0] for p in pairs}):
            own = [p for p in pairs if p[0] == t]
            for lo in range(0, len(own), 2048):  # of like length
                part = own[lo : lo + 2048]
                for p, ok in zip(part, within([p[3] for p in part], [p[4] for p in part], t)):
                    if ok and (a := self.find(p[1])) != (b := self.find(p[2])):
                        self.root[a] = b
                        yield p[1], p[2]


def new_lines(texts: list[str | None], seen: set[int], edits) -> tuple[list[str], np.ndarray]:
    """Lines that may differ in places and that the task hasn't seen lately, with their ids."""
    if len(seen) > 250_000:  # only spares repeats
        seen.clear()
    own, ids = [], []
    for text in texts:
        for _, x in lines_of(text):
            if allowed(len(x), edits) and (i := line_id(x)) not in seen:
                seen.add(i)
                own.append(x)
                ids.append(i)
    return own, np.array(ids, np.int64)


def shared_keys(docs: DataFrame, edits) -> DataFrame:
    """Keys that are a segment of one line and occur in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, seen = arrow_schema("key long,line long,own int"), set()
        for b in batches:
            own, ids = new_lines(b.column("text").to_pylist(), seen, edits)
            for i, j in portions(own, CHARS):
                key, at, first = keys(own[i:j], edits)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[i:j][at]), pa.array(first.astype(np.int32))], schema=schema)
        trim()

    rows = docs.select("text").mapInArrow(run, "key long, line long, own int")
    return rows.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.max("own").alias("own")).where("a <> b and own = 1").select("key")


def near_links(docs: DataFrame, edits=EDITS) -> DataFrame:
    """a, b: links of line ids that join all lines within the allowed edits of each other; a table of cut()."""
    spark = docs.sparkSession
    useful = cut(shared_keys(docs, edits))
    bits = bits_of(useful, F.col("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, seen = arrow_schema("key long,line long,text string"), set()
        for b in batches:
            own, ids = new_lines(b.column("text").to_pylist(), seen, edits)
            for i, j in portions(own, CHARS):
                key, at, _ = keys(own[i:j], edits)
                k = np.flatnonzero(passes(bits.value, key))
                texts = pa.array(own[i:j], pa.string()).take(pa.array(at[k]))
                yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(ids[i:j][at[k]]), texts], schema=schema)
        trim()

    lines = docs.select("text").mapInArrow(run, "key long, line long, text string").join(useful, "key", "left_semi")
    lines = cut(lines.groupBy("key", "line").agg(F.first("text").alias("text")))
    free(useful)
    size = lines.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("line").cast("decimal(38,0)")).alias("who"))
    size = cut(size.where("n > 1").groupBy("n", "who").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    own = lines.join(size, "key").withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    rows = own.select("key", "block", "line", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "line", "text")
    rows = rows.repartition(partitions(spark), "key", "first", "second").sortWithinPartitions("key", "first", "second")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at, held, work = arrow_schema("a long,b long"), None, [], Verifier(edits)
        for b in batches:
            out: list[tuple] = []
            for *key, line, text in zip(*(b.column(c).to_pylist() for c in ("key", "first", "second", "line", "text"))):
                if key != at:
                    out += work.group(held)
                    at, held = key, []
                held.append((line, text))
            yield batch(out, schema)
        yield batch([*work.group(held), *work.flush()], schema)

    out = cut(rows.mapInArrow(verify, "a long, b long"))
    free(lines, size)
    return out


def places(docs: DataFrame, bits=None) -> DataFrame:
    """line, doc_id, number of every line; with a filter, of the lines that it lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("line long,doc_id long,number long")
        for b in batches:
            rows = [(line_id(x), doc, i) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for i, x in lines_of(text)]
            if bits is not None and rows:
                ok = passes(bits.value, np.array([r[0] for r in rows]))
                rows = [r for r, o in zip(rows, ok) if o]
            yield batch(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "line long, doc_id long, number long")


def removed_places(docs: DataFrame, edits=EDITS) -> DataFrame:
    """doc_id, gone: the place ids of the lines that go from each document that loses lines; a table of cut()."""
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number")
    links = near_links(docs, edits)
    roots = components(links)
    free(links)
    every = places(docs).groupBy("line").agg(F.min(where).alias("first"), F.count("*").alias("n"))
    groups = cut(every.join(roots, every.line == roots.node, "left").where("n > 1 or root is not null").select("line", "first", F.coalesce("root", "line").alias("root")))
    free(roots)
    firsts = groups.groupBy("root").agg(F.min("first").alias("stays"))
    known = cut(groups.select("line", "root").join(firsts, "root").select("line", "stays"))
    free(groups)
    rows = places(docs, bits_of(known, F.col("line"))).join(known, "line")
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("number") == F.col("stays.number"))
    gone = rows.where(~stays).select("doc_id", "line", "number")
    out = cut(gone.groupBy("doc_id").agg(F.collect_list(F.struct("line", "number")).alias("gone")))
    free(known)
    return out


def cleaned(docs: DataFrame, edits=EDITS) -> DataFrame:
    """docs with clean: the text without its removed lines, null for a document that loses none; and n_removed.

    Documents that lose no line are told by a filter of ids and aren't shuffled.
    """
    text_batches(docs.sparkSession)
    gone = removed_places(docs, edits)
    bits = bits_of(gone, F.col("doc_id"))

    @F.arrow_udf("boolean")
    def may_lose(ids: pa.Array) -> pa.Array:  # Arrow's longs stay exact beside nulls
        return pa.array(passes(bits.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False))

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), "text").withColumn("_may", may_lose("_id"))
    kept = whole.where("not _may").select("_row", "text", F.lit(None).cast("string").alias("clean"), F.lit(0).cast("long").alias("n_removed"))
    some = whole.where("_may").join(gone, F.col("_id").eqNullSafe(gone["doc_id"]), "left").select("_row", "text", "gone")
    kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean, counts = [], []
            for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist()):
                drop = {(g["line"], g["number"]) for g in gone or ()}
                lost = {i for i, x in lines_of(text) if (line_id(x), i) in drop} if drop else set()
                clean.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in lost) if lost else None)
                counts.append(len(lost))
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("text"), pa.array(clean, pa.string()), pa.array(counts, pa.int64())], names=["_row", "text", "clean", "n_removed"])

    return kept.unionByName(some.mapInArrow(run, f"_row {kind}, text string, clean string, n_removed long"))


def without_repeated_lines(docs: DataFrame, edits=EDITS) -> DataFrame:
    """docs with the cleaned text, and n_chars, where there is one, as its length. A document goes that loses every line it had."""
    rows = cleaned(docs, edits).where("clean is null or clean rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    text = F.coalesce("clean", F.col("_row.text"))
    change = {"text": text, "n_chars": F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[(change[c] if change.get(c) is not None else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def line_counts(docs: DataFrame, edits=EDITS) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_chars, clean_sha256 of every document.

    Lines are compared without white space around them, and lines of white space alone
    are never removed. Null and empty texts have no lines; a clean text of null is empty.
    Rows with equal ids count as one document, ids of null as the last one. Lines shorter
    than 20 characters are linked with their equals only.
    """
    rows = cleaned(docs, edits).withColumn("clean", F.coalesce("clean", "text", F.lit("")))
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    return rows.select("_row.doc_id", lines.alias("n_lines"), "n_removed", F.length("clean").cast("long").alias("clean_chars"), F.sha2("clean", 256).alias("clean_sha256"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
