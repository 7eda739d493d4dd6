"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they belong to.
The flow runs from each pattern (an arc for each repetition, its capacity the pattern's
words, its cost rising) through the pattern's sources to the sources' quotas. What it
routes through a pattern is q whole repetitions and a rest; the rest goes to documents in
the order of a seeded hash, up to a cut. The cut is found by a radix descent over sums by
hash digits, so that no source's documents are ever sorted or gathered, and a few more
documents, each the one whose size fits best, close what the cut leaves open.

The driver sees one row for each pattern, and refuses more than PATTERNS of them.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.llm.base import constant, cut, free, n_words, table

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), Fraction(3, 2), 2, 20_240_229
BITS, LEVELS = 12, 3  # digits of the descent; 48 bits of the hash are used in all
PATTERNS = 1_000_000  # membership patterns that the driver plans for
CLOSING = 4  # documents at most that close what a cut leaves open


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> dict[str | None, Fraction]:
    """share of all words by weight; a target over `most` times its source's words stops there, and the excess is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, Fraction] = {}
    while rest := [s for s in order if s not in out]:
        left = share * sum(sizes.values()) - sum(out.values())
        per = max(left, 0) / sum(weight[s] for s in rest)
        full = [s for s in rest if per * weight[s] > most * sizes[s]]
        out.update({s: Fraction(most * sizes[s]) for s in full} if full else {s: per * weight[s] for s in rest})
    return out


class Flow:
    """A flow from patterns through their sources to the sources' quotas, grown by blocking flows."""

    def __init__(self, sources: list[list[int]], quotas: list[int]):
        self.sources, self.need, self.room = sources, quotas, [0] * len(sources)
        self.users: list[list[int]] = [[] for _ in quotas]
        for p, own in enumerate(sources):
            for s in own:
                self.users[s].append(p)
        self.flow = [dict.fromkeys(own, 0) for own in sources]

    def layers(self) -> bool:
        """Number patterns and sources by the steps from a pattern with room, up to the nearest sources that need words; whether there are any."""
        self.p_step, self.s_step = [0 if r else -1 for r in self.room], [-1] * len(self.need)
        now, step, met = [p for p, r in enumerate(self.room) if r], 0, False
        while now and not met:
            after = []
            for p in now:
                for s in self.sources[p]:
                    if self.s_step[s] < 0:
                        self.s_step[s] = step
                        met = met or self.need[s] > 0
                        after.append(s)
            step, now = step + 1, []
            for s in () if met else after:
                for p in self.users[s]:
                    if self.p_step[p] < 0 and self.flow[p][s]:
                        self.p_step[p] = step
                        now.append(p)
        self.p_next, self.s_next = [0] * len(self.sources), [0] * len(self.need)
        return met

    def path(self, first: int) -> list[int]:
        """Pattern, source, pattern, ... to a source that needs words, one step a time; empty if there is none left."""
        way = [first]
        while way:
            if len(way) % 2:  # at a pattern
                p, s = way[-1], -1
                while self.p_next[p] < len(self.sources[p]) and s < 0:
                    s = self.sources[p][self.p_next[p]]
                    s = s if self.s_step[s] == self.p_step[p] else -1
                    self.p_next[p] += s < 0
                if s >= 0:
                    way.append(s)
                    if self.need[s]:
                        return way
                    continue
                way.pop()
                if way:
                    self.s_next[way[-1]] += 1
            else:
                s, p = way[-1], -1
                while self.s_next[s] < len(self.users[s]) and p < 0:
                    p = self.users[s][self.s_next[s]]
                    p = p if self.p_step[p] == self.s_step[s] + 1 and self.flow[p][s] else -1
                    self.s_next[s] += p < 0
                if p >= 0:
                    way.append(p)
                    continue
                way.pop()
                self.p_next[way[-1]] += 1
        return []

    def fill(self) -> None:
        """Raise the flow to the largest that the rooms allow."""
        while self.layers():
            for first in [p for p, r in enumerate(self.room) if r]:
                while self.room[first] and (way := self.path(first)):
                    back = list(zip(way[2::2], way[1::2]))  # patterns that give way to the one before
                    n = min(self.room[first], self.need[way[-1]], *(self.flow[p][s] for p, s in back))
                    for p, s in zip(way[::2], way[1::2]):
                        self.flow[p][s] += n
                    for p, s in back:
                        self.flow[p][s] -= n
                    self.room[first] -= n
                    self.need[way[-1]] -= n


def min_cost_flow(patterns: dict[str, tuple[tuple, int]], quotas: dict, most: int = MOST) -> dict[str, dict]:
    """Words routed from each pattern (its sources, its words) to each source; the largest flow of least cost.

    The n-th repetition of a pattern costs 2n - 1 a word. An augmenting path costs what the
    repetition that it starts with does, since on its way other patterns only change their
    sources; so the rooms of the first repetitions are used up, by blocking flows, before
    those of the second open, and words are repeated only where fresh ones can't do.
    """
    order, names = sorted(patterns), sorted(quotas, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    flow = Flow([[number[s] for s in patterns[p][0]] for p in order], [quotas[s] for s in names])
    for _ in range(most):
        flow.room = [r + patterns[p][1] for r, p in zip(flow.room, order)]
        flow.fill()
    return {p: {names[s]: n for s, n in own.items()} for p, own in zip(order, flow.flow)}


def order_key(doc: str, text: str, seed: int) -> Column:
    """48 bits of a seeded hash as a long."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc), F.col(text)), 64 - BITS * (LEVELS + 1))


def pattern_key(sources: Column) -> Column:
    """The set of sources as JSON, nulls last."""
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> tuple[DataFrame, dict]:
    """For each pattern: whole copies of all its documents, the cut for one more, and the closing documents' keys; and the report.

    sized has pattern, size and u. Each descent step reads the light table once and
    returns one row for each pattern.
    """
    spark = sized.sparkSession
    got = sized.groupBy("pattern").agg(F.sum("size").alias("words")).limit(PATTERNS + 1).collect()
    if len(got) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns; group the sources first")
    words = {r.pattern: int(r.words) for r in got}
    patterns = {p: (tuple(json.loads(p)), n) for p, n in words.items()}
    sizes: dict[str | None, int] = defaultdict(int)
    for sources, n in patterns.values():
        for s in sources:
            sizes[s] += n
    goal = targets(dict(sizes), weights, share, most)
    flow = min_cost_flow(patterns, {s: round(t) for s, t in goal.items()}, most)
    whole = {p: divmod(sum(flow[p].values()), n) if n else (0, 0) for p, n in words.items()}
    rest, head = {p: r for p, (_, r) in whole.items()}, dict.fromkeys(words, 0)
    for level in range(LEVELS):
        if not any(rest.values()):
            break
        shift = BITS * (LEVELS - level)
        at = constant(spark, [(p, head[p], rest[p]) for p in sorted(words) if rest[p]], "pattern string, head long, rest long")
        sums = sized.join(at, "pattern").where(F.shiftright("u", shift + BITS) == F.col("head")).groupBy("pattern", "head", "rest", F.shiftright("u", shift).alias("cell")).agg(F.sum("size").alias("n"))
        run = sums.withColumn("upto", F.expr("sum(n) over (partition by pattern order by cell)")).where("upto > rest").groupBy("pattern").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("n")).alias("below")), "cell").alias("x"))
        got = {r.pattern: (r.x.cell, r.x.below) for r in run.collect()}
        for p in words:
            if p in got and rest[p]:
                head[p], rest[p] = got[p][0], rest[p] - int(got[p][1])
    cut_at = {p: head[p] << BITS if whole[p][1] else 0 for p in words}
    closing: dict[str, list[int]] = {p: [] for p in words}
    for _ in range(CLOSING):
        at = [(p, cut_at[p], rest[p], closing[p]) for p in sorted(words) if rest[p] > 0]
        if not at:
            break
        free = sized.join(constant(spark, at, "pattern string, cut long, rest long, done array<long>"), "pattern").where("u >= cut and size > 0 and not array_contains(done, u) and abs(size - rest) < rest")
        best = free.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("rest")).alias("off"), F.col("u"), F.col("size"))).alias("x"))
        got = {r.pattern: r.x for r in best.collect()}
        for p in words:
            rest[p] = rest[p] - got[p].size if p in got else 0
            closing[p] += [got[p].u] if p in got else []
    rows = [(p, whole[p][0], cut_at[p], closing[p]) for p in sorted(words)]
    report = {"sizes": dict(sizes), "targets": goal, "flow": flow}
    return constant(spark, rows, "pattern string, copies long, cut long, closing array<long>"), report


def copies() -> Column:
    """How often the mix takes a row that has u and its pattern's plan."""
    return F.col("copies") + F.when((F.col("u") < F.col("cut")) | F.array_contains("closing", F.col("u")), 1).otherwise(0)


def sized(docs: DataFrame, sources: Column, seed: int = SEED) -> DataFrame:
    """doc_id, size, pattern, u: what the plan needs of each document, without its text."""
    return docs.select("doc_id", n_words(F.col("text")).alias("size"), pattern_key(sources).alias("pattern"), order_key("doc_id", "text", seed).alias("u"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, seed: int = SEED, sources: Column | None = None) -> DataFrame:
    """The documents that the mix takes, a row for each time it takes them; same columns as docs.

    sources is an array of the sources that a document belongs to; the column source alone
    unless given. Documents of no source aren't taken. Null texts have no words; null
    sources are a source of their own. No rows give no rows.
    """
    sources = F.array("source") if sources is None else sources
    own = cut(sized(docs, sources, seed))
    made, _ = plan(own, weights)
    free(own)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*keep).alias("_row"), pattern_key(sources).alias("pattern"), order_key("doc_id", "text", seed).alias("u"))
    rows = rows.join(made, "pattern").withColumn("_n", copies()).where("_n > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("_row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    Null texts have size 0 and null sources are a source of their own, the last one.
    Repeated rows share a key and are taken alike. All sizes 0 gives targets of 0.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    own = cut(sized(docs, F.array("source")))
    made, report = plan(own)
    rows = [(json.dumps([s], separators=(",", ":"), ensure_ascii=False), int(n), float(report["targets"][s])) for s, n in report["sizes"].items()]
    each = constant(spark, rows, "pattern string, source_size long, target double")
    return own.join(made, "pattern").join(each, "pattern").select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))
