"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, from two hashes of
its name. The shards take turns, and each claims the first slot of its permutation that
is still free, until the table is full. Shares differ by one slot at most, and a shard
that comes or goes moves few keys but its own. A key's slot is its hash modulo the
table's size, so that placement is one lookup in a table that is small whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.llm.base import table

SLOTS = 65_537  # a prime; the broadcast table never has more rows
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))


def lookup(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Index of the shard that owns each slot. Reruns agree, and the order of the names doesn't matter."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards are distinct names, one at least and no more than slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots has to be a prime")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: xxhash.xxh64_intdigest(shards[i], 1) % slots for i in order}
    skip = {i: xxhash.xxh64_intdigest(shards[i], 2) % (slots - 1) + 1 for i in order}
    owner, left = np.full(slots, -1, np.int32), slots
    while left:
        for i in order:
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with slot (long) and shard (string); columns of these names are replaced.

    Rows with equal keys share a shard; null keys have the slot of their own hash.
    """
    spark = df.sparkSession
    names = [shards[i] for i in lookup(shards, slots)]
    owners = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "slot long, shard string")
    placed = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("long"))
    return placed.join(F.broadcast(owners), "slot").select(*placed.columns, "shard")


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS, files: int = 4) -> None:
    """Parquet folders shard=... under path. Each shard's rows go to `files` tasks by slot, so that none writes a shard alone."""
    rows = place(df, key, shards, slots).withColumn("_part", F.pmod("slot", F.lit(files)))
    rows.repartition(len(shards) * files, "shard", "_part").drop("slot", "_part").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document, placed by doc_id."""
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
