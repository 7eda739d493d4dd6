"""Quality rules with an n-gram perplexity filter.

The language model is a modified Kneser-Ney model of code points, one per language,
counted by Spark over every text: a task counts the n-grams of the highest order, Spark
sums them, and the lower orders' continuation counts, the counts of counts and the
contexts' totals are aggregates of that table. Probabilities are joins from the lowest
order up. A language's model is a set of sorted 64-bit hash arrays with log probabilities
and back-off weights beside them, in one file that executors map and search by bisection.

A model keeps every n-gram and context, so its file grows with the distinct n-grams of the
corpus. Spark sorts the entries; the driver only writes them out, a partition at a time.

A text has two perplexities: by its characters and by its words that hold a letter or a
digit. In the second, characters that are no word's cost without counting, so texts full
of signs score high that the first, where signs become likely with their number, lets
pass. A text passes if both lie in its language's bands: the quartiles over all texts that
pass the base rules, widened by a multiple of their distance.
"""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.llm.base import arrow_schema, batch, collect_garbage, constant, cut, free, partitions, portions, put, scratch, table, text_batches, trim
from utterloom.llm.syncmers import mix

ORDER = 5
HELD = 1 << 16  # entries of a model that go to the driver in one row
MIN_WORDS, MAX_REPEATED = 50, 50  # words; percent of words in repeated 3-word windows
FENCE, LEAST_WIDTH = 3.0, 0.02  # multiples of the quartiles' distance, and the least that it counts as
SCORES, LIMITS = ("log_perplexity", "word_perplexity"), (("low", "high"), ("word_low", "word_high"))
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"
START, BITS, MASK = 2, 21, (1 << 21) - 1  # START pads a text's beginning; BITS of a code point
CHARS = 1 << 19  # characters of texts that a task's arrays hold at a time; a longer text is alone
DENSE = 12  # bits of a code point's number among those of a chunk
COUNTS = "lang string, a long, b long, n long"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_perplexity double, word_perplexity double"


# ---- base rules -------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, at, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice, covered = count[at] > 1, np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return int(covered.sum())


def base_features(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED * len(words)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed


# ---- n-grams ----------------------------------------------------------------


def sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after ORDER - 1 starts, and where each ends. White space runs are one space."""
    plain = [" ".join(t.replace(chr(START), " ").split()) for t in texts]
    pad = chr(START) * (ORDER - 1)
    codes = np.frombuffer("".join(pad + t for t in plain).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return codes, np.cumsum([len(t) + ORDER - 1 for t in plain], dtype=np.int64)


def packed(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """ORDER columns of code points as two longs, the first three and the last two."""
    return grams[0] << 2 * BITS | grams[1] << BITS | grams[2], grams[3] << BITS | grams[4]


def count(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams that don't end in a start, as packed longs, and their counts."""
    if len(codes) < ORDER:
        return (np.empty(0, np.int64),) * 3
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    alphabet = np.flatnonzero(there)
    if len(alphabet) > 1 << DENSE:
        half = len(codes) // 2
        return merged([count(codes[: half + ORDER - 1]), count(codes[half:])])
    dense = (np.cumsum(there) - 1)[codes]
    n = len(codes) - ORDER + 1
    keys = np.zeros(n, np.int64)
    for i in range(ORDER):
        keys = keys << DENSE | dense[i : i + n]
    keys = np.sort(keys[codes[ORDER - 1 :] != START])
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    grams = [alphabet[keys[first] >> DENSE * (ORDER - 1 - i) & ((1 << DENSE) - 1)] for i in range(ORDER)]
    return *packed(grams), np.diff(np.append(first, len(keys)))


def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal n-grams added up."""
    a, b, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0))
    return a[first], b[first], np.add.reduceat(n, first) if len(first) else n


def ngram_counts(docs: DataFrame) -> DataFrame:
    """lang (empty for null), a, b, n: counts of all n-grams of the highest order. Summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(COUNTS.replace(", ", ","))
        held: dict[str, list] = {}

        def flush(lang: str) -> pa.RecordBatch:
            a, b, n = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(n)], schema=schema)

        for x in batches:
            texts: dict[str, list[str]] = {}
            for text, lang in zip(x.column("text").to_pylist(), x.column("lang").to_pylist()):
                texts.setdefault(lang or "", []).append(text or "")
            for lang, own in texts.items():
                parts = held.setdefault(lang, [])
                for i, j in portions(own, CHARS):
                    parts.append(count(sequence(own[i:j])[0]))
                    if sum(len(p[0]) for p in parts) > 600_000:
                        parts[:] = [merged(parts)]
                if sum(len(p[0]) for p in parts) > 500_000 and len(parts) == 1:
                    yield flush(lang)
        for lang in list(held):
            yield flush(lang)
        trim()

    return docs.select("text", "lang").mapInArrow(run, COUNTS).groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))


def levels(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Tables of lang, m, a, b, n: the counts of the highest order; and for each lower order m, from the highest, the number of distinct characters before."""
    whole = below = cut(ngram_counts(docs).select("lang", F.lit(ORDER).alias("m"), "a", "b", "n"))
    lower = []
    for m in range(ORDER - 1, 0, -1):
        drop = ORDER - m
        a = F.col("a").bitwiseAND((1 << BITS * max(0, 3 - drop)) - 1)
        b = F.col("b") if drop <= 3 else F.col("b").bitwiseAND(MASK)
        below = cut(below.select("lang", a.alias("a"), b.alias("b")).groupBy("lang", "a", "b").agg(F.count("*").alias("n")).select("lang", F.lit(m).alias("m"), "a", "b", "n"))
        lower.append(below)
    return whole, lower


# ---- the model --------------------------------------------------------------


def hashed(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """64-bit key of the last m characters."""
    drop = ORDER - m
    a = a & ((1 << BITS * max(0, 3 - drop)) - 1)
    b = b if drop <= 3 else b & MASK
    return mix(mix(a.astype(np.uint64)) + b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(m))


def context(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram without its last character, as the end of a longer one."""
    return a >> BITS, (a & MASK) << BITS | b >> BITS


def discounts(t: list[int]) -> tuple[float, float, float]:
    """What counts of 1, 2, and 3 or more lose, from the numbers of n-grams that occur 1 to 4 times."""
    if not all(t):
        return 0.5, 0.75, 0.9
    y = t[0] / (t[0] + 2 * t[1])
    return tuple(min(max(i - (i + 1) * y * t[i] / t[i - 1], 0.05), i - 0.05) for i in (1, 2, 3))


class Model:
    """One language's sorted arrays: by order m, the m-grams' keys, log probabilities and, below the highest order, the log back-off weights of those that are contexts."""

    def __init__(self, data: np.ndarray):
        at = 8 * (ORDER + 2)
        sizes, (self.floor, self.empty) = data[: 8 * ORDER].view(np.int64), data[8 * ORDER : at].view(np.float64).tolist()
        self.arrays = []
        for m, n in enumerate(sizes.tolist(), 1):
            own, at = [data[at : at + 8 * n].view(np.uint64)], at + 8 * n
            for _ in range(2 if m < ORDER else 1):
                own.append(data[at : at + 4 * n].view(np.float32))
                at += 4 * (n + n % 2)  # what follows starts at a multiple of 8
            self.arrays.append(own)

    def look(self, a: np.ndarray, b: np.ndarray, m: int, what: int) -> np.ndarray:
        """Log probabilities (what = 1) or log back-off weights (2) of m-grams; not a number where there is none."""
        known, values = self.arrays[m - 1][0], self.arrays[m - 1][what]
        if not len(known):
            return np.full(len(a), np.nan)
        keys = hashed(a, b, m)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], np.nan)

    def log_probability(self, a: np.ndarray, b: np.ndarray, m: int = ORDER) -> np.ndarray:
        """Natural logarithm of p(last character | the m - 1 before)."""
        out, back, left = np.empty(len(a)), np.zeros(len(a)), np.arange(len(a))
        while m and len(left):
            value = self.look(a[left], b[left], m, 1)
            found = ~np.isnan(value)
            out[left[found]] = back[left[found]] + value[found]
            left, m = left[~found], m - 1
            if len(left):
                back[left] += np.nan_to_num(self.look(*context(a[left], b[left]), m, 2)) if m else self.empty
        out[left] = back[left] + self.floor
        return out

    def log_perplexities(self, texts: list[str]) -> list[tuple[float | None, float | None]]:
        """The negative log probability of all characters, by their number and by the number of words with a letter or a digit, one at least; nulls for a text without characters."""
        codes, ends = sequence(texts)
        n = len(codes) - ORDER + 1
        ok = codes[ORDER - 1 :] != START
        a, b = packed([codes[i : i + n][ok] for i in range(ORDER)])
        total = np.concatenate([[0.0], np.cumsum(-self.log_probability(a, b))])
        upto = np.cumsum([0, *(e - s - ORDER + 1 for s, e in zip([0, *ends[:-1]], ends))])
        words = np.concatenate([[0], np.cumsum(ends_of_words(codes)[ORDER - 1 :][ok])])
        return [tuple(float((total[e] - total[s]) / n) for n in (e - s, max(words[e] - words[s], 1))) if e > s else (None, None) for s, e in zip(upto, upto[1:])]


def ends_of_words(codes: np.ndarray) -> np.ndarray:
    """Whether each code point of a sequence is the last letter or digit of a word."""
    there = np.zeros(int(codes.max()) + 1, bool)
    there[[c for c in np.unique(codes) if chr(c).isalnum()]] = True
    own = np.flatnonzero(there[codes] | (codes == START) | (codes == ord(" ")))
    word = there[codes[own]]
    last = np.zeros(len(codes), bool)
    last[own[word & ~np.append(word[1:], False)]] = True
    return last


# ---- training ---------------------------------------------------------------


def entries(tables: DataFrame, cuts: dict[tuple[str, int], tuple]) -> DataFrame:
    """A table of lang, m, a, b, p, w: the log probabilities of m-grams, and the log back-off weights of contexts of m characters.

    p(w | context) is the discounted share of the context's total, plus the context's
    back-off weight times p(w | shorter context); below order 1 all characters are alike.
    """
    rates = F.broadcast(tables.sparkSession.createDataFrame([(*k, *v) for k, v in cuts.items()], "lang string, m int, d1 double, d2 double, d3 double, floor double"))
    ca, cb = F.shiftright("a", BITS).alias("ca"), F.shiftleft(F.col("a").bitwiseAND(MASK), BITS).bitwiseOR(F.shiftright("b", BITS)).alias("cb")
    counts = [F.sum(F.when(c, 1).otherwise(0)).alias(f"n{i}") for i, c in ((1, F.col("n") == 1), (2, F.col("n") == 2), (3, F.col("n") > 2))]
    sums = tables.select("lang", "m", ca, cb, "n").groupBy("lang", "m", "ca", "cb").agg(F.sum("n").alias("total"), *counts)
    sums = cut(sums.join(rates, ["lang", "m"]).select("lang", "m", "ca", "cb", "total", F.expr("(d1 * n1 + d2 * n2 + d3 * n3) / total").alias("weight")))
    none, out, below = F.lit(None).cast("float"), [], None
    for m in range(1, ORDER + 1):
        drop = ORDER - m + 1
        sa, sb = F.col("a").bitwiseAND((1 << BITS * max(0, 3 - drop)) - 1), F.col("b") if drop <= 3 else F.col("b").bitwiseAND(MASK)
        own = tables.where(f"m = {m}").select("lang", "a", "b", "n", ca, cb, sa.alias("sa"), sb.alias("sb"))
        own = own.join(sums.where(f"m = {m}").drop("m"), ["lang", "ca", "cb"]).join(rates.where(f"m = {m}").drop("m"), "lang")
        own = own.withColumn("lower", F.col("floor")) if below is None else own.join(below.select("lang", F.col("a").alias("sa"), F.col("b").alias("sb"), F.col("p").alias("lower")), ["lang", "sa", "sb"])
        below = cut(own.select("lang", "a", "b", F.expr("greatest(n - case when n = 1 then d1 when n = 2 then d2 else d3 end, 0) / total + weight * lower").alias("p")))
        out.append(below)
    rows = [t.select("lang", F.lit(m).alias("m"), "a", "b", F.log("p").cast("float").alias("p"), none.alias("w")) for m, t in enumerate(out, 1)]
    rows.append(sums.select("lang", (F.col("m") - 1).alias("m"), F.col("ca").alias("a"), F.col("cb").alias("b"), none.alias("p"), F.log("weight").cast("float").alias("w")))
    whole = cut(functools.reduce(DataFrame.unionByName, rows))
    free(sums, *out)
    return whole


def sorted_blobs(rows: DataFrame) -> DataFrame:
    """lang, m, keys, p, w: the entries by language, order and unsigned key, one for each key, as bytes of about HELD entries."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            order, a, b = (x.column(c).to_numpy() for c in ("m", "a", "b"))
            keys = np.zeros(len(order), np.uint64)  # the empty context's key is 0
            for m in range(1, ORDER + 1):
                at = order == m
                keys[at] = hashed(a[at], b[at], m)
            signed = (keys ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([x.column("lang"), x.column("m"), pa.array(signed), x.column("p"), x.column("w")], names=["lang", "m", "key", "p", "w"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, at, held = arrow_schema("lang string,m int,keys binary,p binary,w binary"), None, []

        def flush(more: bool) -> pa.RecordBatch:
            """A probability and a back-off weight of one key meet; with more to come, the last key waits."""
            keys, p, w = (np.concatenate(c) for c in zip(*held))
            held.clear()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            if more:
                held.append((keys[first[-1] :], p[first[-1] :], w[first[-1] :]))
                keys, p, w, first = keys[: first[-1]], p[: first[-1]], w[: first[-1]], first[:-1]
            p, w = (np.fmax.reduceat(x, first) if len(first) else x for x in (p, w))
            return batch([(*at, (keys[first].view(np.uint64) ^ np.uint64(1 << 63)).tobytes(), p.tobytes(), w.tobytes())], schema)

        for x in batches:
            order, key, p, w = (x.column(c).to_numpy(zero_copy_only=False) for c in ("m", "key", "p", "w"))
            lang = np.array(x.column("lang").to_pylist(), object)
            edges = [0, *(np.flatnonzero((lang[1:] != lang[:-1]) | (order[1:] != order[:-1])) + 1), len(order)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if held and (lang[i], int(order[i])) != at:
                    yield flush(False)
                at = lang[i], int(order[i])
                held.append((key[i:j], p[i:j].astype(np.float32), w[i:j].astype(np.float32)))
                if sum(len(k) for k, _, _ in held) >= HELD:
                    yield flush(True)
        if held:
            yield flush(False)

    keyed = rows.mapInArrow(key, "lang string, m int, key long, p float, w float")
    ordered = keyed.repartitionByRange(partitions(rows.sparkSession), "lang", "m", "key").sortWithinPartitions("lang", "m", "key")
    return ordered.mapInArrow(pack, "lang string, m int, keys binary, p binary, w binary")


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Each language's model with all n-grams, as a mapped file on the driver, which holds a partition of entries at a time.

    The files have no name any more: their space is free once the arrays are gone.
    """
    whole, lower = levels(docs)
    tables = functools.reduce(DataFrame.unionByName, lower, whole)
    often = {(r.lang, r.m, r.c): r.k for r in tables.groupBy("lang", "m", F.least("n", F.lit(5)).alias("c")).agg(F.count("*").alias("k")).collect()}
    floors = {s: -np.log(sum(often.get((s, 1, c), 0) for c in range(1, 6)) + 1.0) for s in {k[0] for k in often}}
    if not floors:
        return {}
    cuts = {(s, m): (*discounts([often.get((s, m, c), 0) for c in (1, 2, 3, 4)]), float(np.exp(v))) for s, v in floors.items() for m in range(1, ORDER + 1)}
    rows = entries(tables, cuts)
    free(whole, *lower)
    folder = tempfile.mkdtemp(prefix="utterloom-")
    paths, sizes, empty = {s: f"{folder}/{i}" for i, s in enumerate(floors)}, {s: [0] * ORDER for s in floors}, dict.fromkeys(floors, 0.0)
    for path in paths.values():
        with open(path, "wb") as f:
            f.write(bytes(8 * (ORDER + 2)))
    with open(f"{folder}/p", "w+b") as p, open(f"{folder}/w", "w+b") as w:
        at = None

        def close() -> None:  # an order's values follow its keys
            with open(paths[at[0]], "ab") as f:
                for x in (p, w)[: 2 if at[1] < ORDER else 1]:
                    x.write(bytes(4 * (sizes[at[0]][at[1] - 1] % 2)))
                    x.seek(0)
                    shutil.copyfileobj(x, f)
            for x in (p, w):
                x.seek(0)
                x.truncate()

        for r in sorted_blobs(rows).toLocalIterator():
            if not r.m:
                empty[r.lang] = float(np.frombuffer(r.w, np.float32)[0])
                continue
            if at and at != (r.lang, r.m):
                close()
            at = r.lang, r.m
            with open(paths[r.lang], "ab") as f:
                f.write(r["keys"])
            p.write(r.p)
            w.write(r.w)
            sizes[r.lang][r.m - 1] += len(r["keys"]) // 8
        close()
    free(rows)
    for s, path in paths.items():
        with open(path, "r+b") as f:
            f.write(np.array(sizes[s], np.int64).tobytes() + np.array([floors[s], empty[s]]).tobytes())
    models = {s: np.memmap(path, np.uint8, "r") for s, path in paths.items()}
    shutil.rmtree(folder, True)
    return models


def published(spark: SparkSession, models: dict[str, np.ndarray]) -> dict[str, str]:
    """The name under which each executor maps its copy of a language's model."""
    names = {}
    for lang, data in models.items():
        put(spark, at := scratch(spark, "ngrams"), data)
        spark.sparkContext.addFile(at)
        names[lang] = at.rpartition("/")[2]
    return names


# ---- the filter -------------------------------------------------------------


def score(docs: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    """The columns keep of docs, then FEATURES. A text is scored by its language's published model; null text is empty."""
    inner = docs.select(F.col("text").alias("_text"), F.col("lang").alias("_lang"), *[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Model] = {}
        features = arrow_schema(FEATURES.replace(", ", ","))
        for x in batches:
            texts = [t or "" for t in x.column(0).to_pylist()]
            langs = [s or "" for s in x.column(1).to_pylist()]
            base = [base_features(t) for t in texts]
            logs: list[tuple] = [(None, None)] * len(texts)
            for lang in set(langs) & set(names):  # a language without characters has no model
                if lang not in known:
                    known[lang] = Model(np.memmap(SparkFiles.get(names[lang]), np.uint8, "r"))
                own = [i for i, s in enumerate(langs) if s == lang and not base[i][-1]]
                for s, e in portions([texts[i] for i in own], CHARS):
                    for i, v in zip(own[s:e], known[lang].log_perplexities([texts[i] for i in own[s:e]])):
                        logs[i] = v
            more = batch([(*f, *v) for f, v in zip(base, logs)], features)
            yield pa.RecordBatch.from_arrays([*x.columns[2:], *more.columns], schema=pa.schema([*list(x.schema)[2:], *features]))
        trim()

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return inner.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), FEATURES]))


def bands(scored: DataFrame, lang: str) -> DataFrame:
    """A row for each language: low and high, between which a text's log perplexity passes, and the same of words."""
    q = [F.percentile(F.round(c, 3), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in SCORES]  # exact; rounded, so that the counts by value stay few
    per = scored.where("not base_failed").groupBy(F.coalesce(F.col(lang), F.lit("")).alias("_lang")).agg(*q)
    width = [F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(LEAST_WIDTH)) * FENCE for c in SCORES]
    return per.select("_lang", *[x.alias(n) for c, w, names in zip(SCORES, width, LIMITS) for x, n in zip((F.col(c)[0] - w, F.col(c)[1] + w), names)])


def verdicts(scored: DataFrame, lang: str) -> DataFrame:
    """scored with LIMITS and kept. One row a language goes to the driver and back as a plan's constant; texts in scored stay where they are."""
    rows = [tuple(r) for r in bands(scored, lang).collect()]
    own = constant(scored.sparkSession, rows, "_lang string, " + ", ".join(f"{n} double" for names in LIMITS for n in names))
    ok = ~F.col("base_failed")
    for c, (low, high) in zip(SCORES, LIMITS):
        ok &= F.coalesce(F.col(c).between(F.col(low), F.col(high)), F.lit(False))
    return scored.withColumn("_lang", F.coalesce(F.col(lang), F.lit(""))).join(own, "_lang", "left").withColumn("kept", ok).drop("_lang")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, lang, FEATURES, LIMITS, kept of every document.

    Null texts are empty and fail the base rules; null languages are a language of their
    own. Repeated rows are judged alike. No rows give no rows.
    """
    text_batches(docs.sparkSession)
    names = published(docs.sparkSession, train(docs))
    collect_garbage(docs.sparkSession)
    return verdicts(cut(score(docs, names, ["doc_id", "lang"])), "lang")


def passed(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of docs. They are scored once, into a table that holds them, and filtered from it."""
    spark = docs.sparkSession
    text_batches(spark)
    names = published(spark, train(docs))
    collect_garbage(spark)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang")
    scored = cut(score(whole, names, ["_row", "lang"]).where("not base_failed").select("_row", "lang", "base_failed", *SCORES))
    return verdicts(scored, "lang").where("kept").select("_row.*")


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
