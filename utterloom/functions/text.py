"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a clause, and those that only decorate a word.
BREAKS, QUOTES, BREAK_WORD = ",.!?;", ':"()', "BUT"


def words(text: Column) -> Column:
    """Upper-case words. Quotes go at both ends, breaks at the front only, so that a clause still shows its end."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    clean = F.transform(raw, lambda w: F.ltrim(F.upper(F.trim(w, F.lit(QUOTES))), F.lit(BREAKS)))
    return F.filter(clean, lambda w: w != "")


def clauses(tokens: Column) -> Column:
    """Words cut into clauses, as space-joined strings: after a trailing break, and at BUT. Empty clauses go."""
    marked = F.transform(tokens, lambda w: F.when(w == BREAK_WORD, F.lit("\x01")).when(F.length(F.rtrim(w, F.lit(BREAKS))) < F.length(w), F.concat(F.rtrim(w, F.lit(BREAKS)), F.lit(" \x01"))).otherwise(w))
    parts = F.split(F.array_join(marked, " "), "\x01")
    return F.filter(F.transform(parts, lambda c: F.trim(c)), lambda c: c != "")


def clause_with(tokens: Column, keywords: Sequence[str]) -> Column:
    """Words of the first clause that holds a keyword, else of the first, else none."""
    found = clauses(tokens)
    keys = F.array(*[F.lit(k) for k in keywords])
    holds = F.filter(found, lambda c: F.arrays_overlap(F.split(c, " "), keys))
    chosen = F.coalesce(F.get(holds, F.lit(0)), F.get(found, F.lit(0)))
    return F.when(chosen.isNull(), F.array().cast("array<string>")).otherwise(F.split(chosen, " "))


def substitute(tokens: Column, table: Mapping[str, str]) -> Column:
    """Each word by its entry, or itself."""
    if not table:
        return tokens
    own = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(tokens, lambda w: F.coalesce(F.element_at(own, w), w))


def slug(text: Column) -> Column:
    """Everything but letters and digits as underscores."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def bag(text: Column, classes: Mapping[str, str]) -> Column:
    """Sorted distinct classes of the words of a text."""
    plain = F.transform(F.split(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}']+"), lambda w: w)
    own = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    return F.array_sort(F.array_distinct(F.filter(F.transform(plain, lambda w: F.element_at(own, w)), lambda c: c.isNotNull())))


def sentence_case(text: Column, proper: Sequence[str] = ("english",)) -> Column:
    """Lower case with capitals at the start, after . ! ?, on i and i'..., and on proper names."""
    tokens = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    names = F.array(*[F.lit(p) for p in proper])

    def step(state: Column, w: Column) -> Column:
        up = state["start"] | (w == "i") | w.startswith("i'") | F.array_contains(names, F.trim(w, F.lit(".,?!'")))
        shown = F.when(up, F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(w)
        return F.struct(F.concat(state["out"], F.array(shown)).alias("out"), F.substring(w, -1, 1).isin(".", "!", "?").alias("start"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("start"))
    return F.array_join(F.aggregate(tokens, start, step, lambda s: s["out"]), " ")


def punctuate(text: Column, question: Column) -> Column:
    """The text with a closing mark: ? for questions, else a full stop; a mark that is there stays."""
    return F.when(F.substring(text, -1, 1).isin(".", "!", "?"), text).otherwise(F.concat(text, F.when(question, "?").otherwise(".")))


def wrap(text: Column, width: int) -> Column:
    """Lines of at most width characters, filled greedily; longer words are cut."""
    tokens = F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / width).cast("int")), lambda i: F.substr(w, i * width + 1, F.lit(width)))))

    def step(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.length(last) + 1 + F.length(w) <= width
        return F.when(F.size(lines) == 0, F.array(w)).when(fits, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat_ws(" ", last, w)))).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def fit(text: Column, sizes: Sequence[tuple[int, int, int]]) -> Column:
    """The largest (scale, width, lines) of sizes, given largest first, in whose lines the text fits without cutting a word; else the last."""
    longest = F.coalesce(F.array_max(F.transform(F.split(text, r"\s+"), lambda w: F.length(w))), F.lit(0))
    out = F.lit(sizes[-1][0])
    for scale, width, lines in reversed(sizes):
        out = F.when((longest <= width) & (F.size(wrap(text, width)) <= lines), scale).otherwise(out)
    return out


def form_of_file(name: Column) -> Column:
    """The file's name without folder, extension, and a trailing number."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", ""), r"[_.][0-9]+$", "")


def case_of_file(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")


def name_stem(name: Column) -> Column:
    """A voice's name without what stands in brackets."""
    return F.trim(F.substring_index(name, " (", 1))


def quality_of(name: Column) -> Column:
    """2 for premium voices, 1 for enhanced ones, else 0."""
    low = F.lower(name)
    return F.when(low.contains("(premium)"), 2).when(low.contains("(enhanced)"), 1).otherwise(0)


def gender_of(name: Column, genders: Mapping[str, str]) -> Column:
    """The gender that a stated list gives for a voice's stem, else unknown."""
    if not genders:
        return F.lit("unknown")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in genders.items() for x in kv]), name_stem(name)), F.lit("unknown"))


def respell(text: Column, spellings: Mapping[str, str]) -> Column:
    """Each word, without the marks around it, by its entry; marks stay."""
    if not spellings:
        return text
    own = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    bare = lambda w: F.rtrim(w, F.lit(BREAKS))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.coalesce(F.element_at(own, bare(w)), bare(w)), F.substr(w, F.length(bare(w)) + 1))), " ")
