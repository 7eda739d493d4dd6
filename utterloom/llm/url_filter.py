"""URL filtering with a sorted digest array.

A list entry is a full string: host and path of a rule ("example.net/en/") or one
host label ("label:name"). The entries' 64-bit xxhash keys are sorted and stored with
the strings in one file that every executor gets and memory-maps. A batch of URLs
becomes candidate strings (host suffixes times path prefixes of the lengths that occur
among the rules); their keys are found by vectorised binary search, and a found key
counts only if the stored string is equal, so that collisions of keys do no harm.

The file holds the list and does not grow with the pages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.llm.base import put, scratch, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Host labels that the default list blocks where no rule fits; replace by a list of your own.
BLOCKED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "rule string, verdict string"


def key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class DigestArray:
    """Strings with a verdict each, found by their keys in a memory-mapped file."""

    def __init__(self, path: str):
        head = np.memmap(path, np.int64, "r", 0, (2,))
        n, size = int(head[0]), int(head[1])
        self.keys = np.memmap(path, np.uint64, "r", 16, (n,)) if n else np.empty(0, np.uint64)
        self.ends = np.memmap(path, np.int64, "r", 16 + 8 * n, (n + 1,))
        self.block = np.memmap(path, np.uint8, "r", 24 + 16 * n, (n,)) if n else np.empty(0, np.uint8)
        self.blob = np.memmap(path, np.uint8, "r", 24 + 17 * n, (size,)) if size else np.empty(0, np.uint8)

    @staticmethod
    def pack(entries: Iterable[tuple[str, str]]) -> bytes:
        """The file's content."""
        rows = sorted((key(s), s, v == "block") for s, v in dict(entries).items())
        texts = [s.encode("utf-8", "surrogatepass") for _, s, _ in rows]
        head = np.array([len(rows), sum(map(len, texts))], np.int64)
        keys = np.array([k for k, _, _ in rows], np.uint64)
        ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
        block = np.array([b for _, _, b in rows], np.uint8)
        return b"".join([head.tobytes(), keys.tobytes(), ends.tobytes(), block.tobytes(), *texts])

    def text(self, i: int) -> str:
        return self.blob[self.ends[i] : self.ends[i + 1]].tobytes().decode("utf-8", "surrogatepass")

    def find(self, texts: list[str], keys: np.ndarray | None = None) -> np.ndarray:
        """Index of each text's entry, -1 where there is none. Equal keys are compared one by one."""
        keys = np.fromiter(map(key, texts), np.uint64, len(texts)) if keys is None else keys
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(texts), -1, np.int64)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else []
        for j in hit:
            i = int(at[j])
            while i < len(self.keys) and self.keys[i] == keys[j]:
                if self.text(i) == texts[j]:
                    found[j] = i
                    break
                i += 1
        return found


class Shape:
    """What of a URL can match a list: the label counts of its rules' hosts and the lengths of their paths."""

    def __init__(self, rules: Iterable[str]):
        hosts = [(r[: r.index("/")], len(r) - r.index("/")) for r in rules]
        self.labels = max((h.count(".") + 1 for h, _ in hosts), default=0)
        self.lengths = sorted({n for _, n in hosts})

    def candidates(self, host: str, path: str) -> list[str]:
        """Every rule that would fit: the host's last labels, as many as a rule has at most, times path prefixes."""
        if not host:
            return []
        last = host.rsplit(".", self.labels)[-self.labels :] if self.labels else []
        suffixes = [host] if host.count(".") < self.labels else []
        suffixes += [".".join(last[i:]) for i in range(len(last))]
        return [s + path[:n] for s in dict.fromkeys(suffixes) for n in self.lengths if n <= len(path)]


def judge(hosts: list[str], paths: list[str], digests: DigestArray, shape: Shape, default: str) -> list[tuple[str | None, str]]:
    """Rule (or null) and verdict of each URL. The longest rule wins; then listed labels; then the default."""
    texts, owner = [], []
    for i, (h, p) in enumerate(zip(hosts, paths)):
        own = shape.candidates(h, p) + [f"label:{x}" for x in h.split(".")]
        texts += own
        owner += [i] * len(own)
    best: list[tuple[str | None, str]] = [(None, default)] * len(hosts)
    at = digests.find(texts)
    for j in np.flatnonzero(at >= 0):
        i, text, verdict = owner[j], texts[j], "block" if digests.block[at[j]] else "allow"
        if text.startswith("label:"):
            if best[i][0] is None:
                best[i] = (None, verdict)
        elif best[i][0] is None or len(text) > len(best[i][0]):
            best[i] = (text, verdict)
    return best


def read_list(spark: SparkSession, path: str, bound: int = 10_000_000) -> list[tuple[str, str]]:
    """(rule, verdict) of a list in text files: a verdict, block or allow, a space, and host/path in each line; other lines are comments.

    The driver holds the list and refuses more than bound rules.
    """
    line = F.regexp_extract("value", r"^(?:block|allow) ([^/\s]+/\S*)$", 1)
    rows = spark.read.text(path).select(line.alias("rule"), F.substring("value", 1, 5).alias("verdict")).where("rule <> ''").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"the list has more than {bound} rules")
    return [(r.rule, r.verdict) for r in rows]


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path; both empty for a null url or one without "://"."""
    after = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3 + length(regexp_extract(substring(`{url}`, instr(`{url}`, '://') + 3), '^[^/?#]*', 0)))"), r"^[^?#]*", 0)
    there = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    return df.withColumns({"host": F.when(there, F.translate(host, UPPER, LOWER)).otherwise(""), "path": F.when(there, path).otherwise("")})


def filter_urls(pages: DataFrame, rules=RULES, labels=BLOCKED_LABELS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page; other columns, also such of these names, are left out.

    Null urls and urls without "://" have an empty host, which no rule fits: verdict
    is the default. Repeated rows are judged alike. An empty table gives no rows, an
    empty list the default for all.
    """
    spark = pages.sparkSession
    entries = {**dict(rules), **{f"label:{x}": "block" for x in labels}}
    shape = Shape(r for r, _ in rules)
    at = scratch(spark, "urls")
    put(spark, at, DigestArray.pack(entries.items()))
    spark.sparkContext.addFile(at)  # each executor gets a copy to map
    name = at.rpartition("/")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = DigestArray(SparkFiles.get(name))
        for b in batches:
            got = judge(b.column("host").to_pylist(), b.column("path").to_pylist(), digests, shape, default)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], names=[*b.schema.names, "rule", "verdict"])

    parts = split_url(pages.select("page_id", "url")).select("page_id", "host", "path")
    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, {SCHEMA}")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""
