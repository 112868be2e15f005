"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: a walk from an
offset by a skip, both hashed from its name. The shards take turns, each claiming the first
free slot of its order, until the table is full; so all hold equal parts within one slot, and
when a shard goes few other slots change hands. The table follows from the shard names alone
and has ``slots`` entries however many rows there are; it is broadcast and a row is placed by
one hash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelens.llm.common import read

SLOTS = 65537
SHARDS = 96
#: The broadcast table has no more entries than this.
MOST_SLOTS = 1 << 22


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot."""
    if not is_prime(slots) or slots > MOST_SLOTS:
        raise ValueError(f"the table size must be a prime of at most {MOST_SLOTS}")
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shards need distinct names, no more than slots")
    walks = []
    for name in names:
        h = hashlib.sha256(name.encode()).digest()
        walks.append((int.from_bytes(h[:8], "little") % slots, int.from_bytes(h[8:16], "little") % (slots - 1) + 1))
    owner, at, left = [-1] * slots, [w[0] for w in walks], slots
    while True:
        for k, (_, skip) in enumerate(walks):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip) % slots
            owner[at[k]] = k
            left -= 1
            if not left:
                return owner


def table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): one row a slot."""
    owner = fill(names, slots)
    text = F.lit(" ".join(map(str, owner)))
    rows = spark.range(1).select(F.posexplode(F.split(text, " ")).alias("slot", "k"))
    return rows.select("slot", F.element_at(F.lit(names), F.col("k").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key by its text; a null key goes as the empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` put after its columns (columns of those names are replaced).

    Equal keys, null ones too, share a slot; every row keeps its other columns.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    rows = df.select(*rest, slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return rows.join(F.broadcast(table(df.sparkSession, names, slots)), "slot").select(*rest, "slot", "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def op4_lookup_placement(spark, sf_dir: str) -> DataFrame:
    """Placement of every document, and where it goes when the last shard is taken away."""
    names = shard_names()
    docs = read(spark, sf_dir, "documents").select("doc_id")
    now = place(docs, "doc_id", names)
    later = table(spark, names[:-1]).withColumnRenamed("shard", "shard_after")
    return now.join(F.broadcast(later), "slot").select("doc_id", F.col("slot").cast("long").alias("slot"), "shard", "shard_after")
