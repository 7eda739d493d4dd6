"""Whole-family splits and requirement reports. Families are few; their sizes are aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterloom.operators.matching import small, small_rows

FAMILIES = 1_000_000  # families that the driver plans for; more are an error


def balanced(sizes: Mapping[str, int], shares: Sequence[tuple[str, int]] = (("train", 3), ("val", 1), ("test", 1))) -> dict[str, str]:
    """Families, largest first and then by name, each to the split that lacks most of its share."""
    total, whole, got = sum(sizes.values()), sum(n for _, n in shares), {s: 0 for s, _ in shares}
    out = {}
    for family in sorted(sizes, key=lambda f: (-sizes[f], f)):
        lack = lambda s: total * dict(shares)[s] / whole - got[s]
        best = max((s for s, _ in shares), key=lambda s: (lack(s), -[x for x, _ in shares].index(s)))
        out[family], got[best] = best, got[best] + sizes[family]
    return out


def required(families: Sequence[Mapping], locale: str = "en_US", shares: Sequence[tuple[str, int]] = (("train", 3), ("val", 1), ("test", 1))) -> list[dict]:
    """families (family, tier, locale, gender, quality) with split, by requirements in this order.

    Only natural ones are held out. Of the wanted locale, the best of each known gender is
    for test, then one of each for train, and all others train. Of the other locales, genders
    that train, test and val lack are filled in that order, best first; what is left is
    balanced by the shares. Better means a higher quality, then the name.
    """
    rows = [dict(f, split="train" if f["tier"] != "natural" else None) for f in families]
    free = sorted((r for r in rows if r["split"] is None), key=lambda r: (-r["quality"], r["family"]))
    near, far, known = [r for r in free if r["locale"] == locale], [r for r in free if r["locale"] != locale], ("male", "female")

    def place(pools: Sequence[list[dict]], gender: str, split: str) -> None:
        one = next((r for pool in pools for r in pool if r["split"] is None and r["gender"] == gender), None)
        if one:
            one["split"] = split

    for split in ("test", "train"):
        for gender in known:
            place([near], gender, split)
    for r in near:
        r["split"] = r["split"] or "train"
    for split in ("train", "test", "val"):
        there = {r["gender"] for r in rows if r["split"] == split}
        for gender in known:
            if gender not in there:
                place([far], gender, split)
    plan = balanced({r["family"]: r.get("size", 1) for r in far if r["split"] is None}, shares)
    return [dict(r, split=r["split"] or plan[r["family"]]) for r in rows]


def with_splits(rows: DataFrame, family: str, held: Mapping[str, str] | None = None, shares: Sequence[tuple[str, int]] = (("train", 3), ("val", 1), ("test", 1))) -> DataFrame:
    """rows with split, the same for a whole family; held names families whose split is given.

    One row for each family goes to the driver, of at most FAMILIES; the plan goes back as a
    table, which the join broadcasts if its size allows.
    """
    some = small_rows(rows.groupBy(F.col(family).alias("f")).agg(F.count("*").alias("n")), FAMILIES)
    free = {r.f: r.n for r in some if r.f is not None and r.f not in (held or {})}
    plan = {**balanced(free, shares), **(held or {})}
    made = rows.sparkSession.createDataFrame(list(plan.items()) or [("", "")], "f string, split string")
    return rows.join(small(made), rows[family] == made["f"], "left").drop("f")


def requirements(rows: DataFrame, tiers: Sequence[str] = ("natural",)) -> DataFrame:
    """split, voices, rows, odd_tiers, ok: a held-out split has voices, and only of the wanted tiers."""
    odd = F.sum(F.when(~F.coalesce(F.col("tier").isin(*tiers), F.lit(False)), 1).otherwise(0))
    out = rows.groupBy("split").agg(F.countDistinct("voice").alias("voices"), F.count("*").alias("rows"), odd.alias("odd_tiers"))
    return out.withColumn("ok", (F.col("voices") > 0) & ((F.col("split") == "train") | (F.col("odd_tiers") == 0)))


def margin_verdict(within: float, between: float, least: float = 1.5) -> str:
    """usable where classes lie apart by the wanted ratio, marginal where they lie apart at all, else unusable."""
    ratio = between / within if within else float("inf")
    return "usable" if ratio >= least else "marginal" if ratio > 1 else "unusable"
