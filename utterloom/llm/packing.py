"""Packing documents into training windows by the sum-of-squares rule.

A document's ids are cut into whole windows and a rest. Fill levels are counted in steps
of a few ids. Each rest is placed, in the order in which it arrives, into the level whose
choice leaves the smallest sum of squared counts of partially filled windows; a level
array holds the counts. The rule keeps every level about equally rare, so that a rest of
any size soon finds its complement, and with few levels few windows stay open. A window
that lacks less than a step is closed by the first ids of the next document.

When a task ends, its open windows, about a few for each level however much it has read,
are cut anew into full windows, and what is left over into sequences whose lengths are
powers of two, which need no padding.

A task packs what it reads and nothing is shuffled. A task that is run again reads the
same rows and makes the same sequences.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from utterloom.llm.base import arrow_schema, batch, table, text_batches, trim

WINDOW, END_ID, VOCABULARY = 2048, 1, "byte_bpe_50k.json"
STEP = 32  # ids of a fill level
CACHED = 300_000  # pieces of text whose ids a worker remembers before it starts anew
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: White space next to a space, and other white space than the usual: a text with any is encoded as a whole.
RUNS = ("  ", "\n ", " \n", "\t ", " \t", "\r ", " \r")
RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@functools.cache
def encoder(vocabulary: str = VOCABULARY) -> Callable[[list[str]], list[bytes]]:
    """Texts to ids, as little-endian unsigned 32-bit bytes each.

    The vocabulary's pattern always splits before a single space between other characters,
    so the parts between single spaces are encoded once and remembered. The parts of a few
    texts that aren't known are encoded in one go, by the same vocabulary's ranks, which
    takes a fifth of the time, and told apart by their lengths in bytes. Texts with a
    special string or with other white space are encoded as they are.
    """
    import public_tokenizers
    import tiktoken
    import tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path(vocabulary))
    with open(public_tokenizers.path(vocabulary.removesuffix(".json") + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(x) for x in ranks]
    odd = (*RUNS, *(x.content for x in own.get_added_tokens_decoder().values()))
    known: dict[str, bytes] = {}
    space = np.array(plain(" "), "<u4").tobytes()

    def learn(parts: list[str]) -> None:
        got = np.array(plain(" " + " ".join(parts)), "<u4")
        ends = np.searchsorted(np.cumsum(lengths[got]), np.cumsum([1 + len(x.encode()) for x in parts])) + 1
        data, ends = got.tobytes(), (4 * ends).tolist()
        known.update((x, data[s:e]) for x, s, e in zip(parts, [0, *ends], ends))

    def encode(texts: list[str]) -> list[bytes]:
        if len(known) > CACHED:
            known.clear()
        rows, new = [], {}
        for text in texts:
            if any(x in text for x in odd) or RARE.search(text):
                rows.append((own.encode(text, add_special_tokens=False).ids, (), b""))
                continue
            first, *rest = text.split(" ")
            tail = space if rest and not rest[-1] and rest.pop() == "" else b""
            new.update(dict.fromkeys(set(rest).difference(known)))
            rows.append((plain(first), rest, tail))
        if new:
            learn(list(new))
        return [b"".join((np.array(first, "<u4").tobytes(), *map(known.__getitem__, rest), tail)) for first, rest, tail in rows]

    return encode


class Packer:
    """Online packing of one task's documents. A piece is (document, start, ids as bytes, its document's ids)."""

    def __init__(self, first: int, window: int = WINDOW, step: int = STEP):
        self.window, self.step, self.next = window, step, first
        self.count = np.zeros(-(-window // step) + 1)  # open windows by fill level; the last is that of gaps and stays empty
        self.open: list[list[tuple[int, list]]] = [[] for _ in self.count]  # (fill, pieces) by level
        self.fill = np.full(len(self.count), -1)  # of each level's last window; -1 where there is none
        self.gap: tuple[int, list] | None = None
        self.placed = 0  # ids in windows that the rule has completed

    def level(self, size: int) -> int:
        """The fill level, 0 for a new window, that a rest of this size goes to. Of equals the fullest."""
        top = len(self.count) - 1
        at = np.flatnonzero((self.fill >= 0) & (self.fill + size <= self.window))
        to = -(-(self.fill[at] + size) // self.step)
        after = np.where(to == top, 0.0, 2 * self.count[to] + 1)  # a window that is full, or nearly, is open no more
        change = after - 2 * self.count[at] + 1 - 2 * (to == at)
        new = -(-size // self.step)
        fresh = 0.0 if new == top else 2 * self.count[new] + 1
        if not len(at) or change.min() > fresh:
            return 0
        return int(at[len(at) - 1 - change[::-1].argmin()])

    def push(self, fill: int, pieces: list) -> Iterator[tuple]:
        """Keep a window open, or as the one that the next ids fill up, or close it."""
        if fill == self.window:
            self.placed += fill
            yield from self.close(pieces)
            return
        at = -(-fill // self.step)
        if at == len(self.count) - 1 and self.gap is None:
            self.gap = fill, pieces
            return
        self.count[at] += 1
        self.open[at].append((fill, pieces))
        self.fill[at] = fill

    def pop(self, at: int) -> tuple[int, list]:
        fill, pieces = self.open[at].pop()
        self.count[at] -= 1
        self.fill[at] = self.open[at][-1][0] if self.open[at] else -1
        return fill, pieces

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """Rows of the sequences that this document completes."""
        size, start = len(ids) // 4, 0
        if self.gap:
            (fill, pieces), self.gap = self.gap, None
            start = min(size, self.window - fill)
            yield from self.push(fill + start, [*pieces, (doc, 0, ids[: 4 * start], size)])
        while size - start >= self.window:
            yield from self.push(self.window, [(doc, start, ids[4 * start : 4 * (start + self.window)], size)])
            start += self.window
        if rest := size - start:
            at = self.level(rest)
            fill, pieces = self.pop(at) if at else (0, [])
            yield from self.push(fill + rest, [*pieces, (doc, start, ids[4 * start :], size)])

    def close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, size in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), size, self.next, offset
            offset += len(ids) // 4
        self.next += 1

    def finish(self) -> Iterator[tuple]:
        """Rows of the open windows, cut anew where they would need padding."""
        left: list[tuple] = []
        for fill, pieces in [x for windows in reversed(self.open) for x in windows] + [self.gap] * bool(self.gap):
            if fill & (fill - 1) == 0:
                yield from self.close(pieces)
            else:
                left += pieces
        total = sum(len(p[2]) for p in left) // 4
        lengths = [self.window] * (total // self.window) + [1 << b for b in range(self.window.bit_length(), -1, -1) if (total % self.window) >> b & 1]
        left.reverse()
        for room in lengths:
            pieces = []
            while room:
                doc, start, ids, size = left.pop()
                if len(ids) > 4 * room:
                    left.append((doc, start + room, ids[4 * room :], size))
                    ids = ids[: 4 * room]
                pieces.append((doc, start, ids, size))
                room -= len(ids) // 4
            yield from self.close(pieces)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece of each document; see SCHEMA.

    sequence_id is unique over the table: the task's number times 2^32, plus a count. A null or
    empty text is its end id alone. Repeated rows are packed each on its own, a null doc_id
    stays null, a text longer than a window fills windows of its own. No rows give no rows.
    """
    text_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        packer, schema = Packer(TaskContext.get().partitionId() << 32, window), None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("doc_id"), *arrow_schema(SCHEMA.replace(", ", ","))])
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode([t or "" for t in b.column("text").to_pylist()])):
                rows += packer.add(doc, ids + end)
            yield batch(rows, schema)
        if schema:
            yield batch(list(packer.finish()), schema)
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
