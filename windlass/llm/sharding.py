"""Sharding by a permutation-filled lookup table (native: DataFrame functions only)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table, a prime; at least a hundred per shard keeps shares within about one percent.
SLOTS = 16381
SHARDS = 64


def _number(*parts: object) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``shards``) that owns each slot.

    A shard prefers the slots ``offset + j * step`` for j = 0, 1, ...; as ``slots`` is prime that
    runs through all of them. Shards take turns, each claiming its first slot that is still free.
    Its size is fixed by ``slots``, whatever the data, and names alone decide it, so adding or
    losing a shard moves few slots besides its own.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have distinct names, one at least")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime, no fewer than the shards")
    nxt = [_number("offset", s) % slots for s in shards]
    step = [_number("step", s) % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            at = nxt[k]
            while owner[at] >= 0:
                at = (at + step[k]) % slots
            owner[at], nxt[k], free = k, (at + step[k]) % slots, free - 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, owner: list[int]) -> DataFrame:
    """(slot, shard) as a DataFrame, read off one constant string."""
    text = F.lit(",".join(map(str, owner)))
    return spark.range(1).select(F.posexplode(F.split(text, ",")).alias("slot", "s")).select("slot", F.col("s").cast("int").alias("shard"))


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    """The slot of a document by its id; of one without an id by its text."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard_documents(docs: DataFrame, shards: int | list[str] = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (columns of those names are replaced), every row kept.

    Placement is one lookup in a broadcast table of ``slots`` rows, a bound that no data moves;
    nothing shuffles. Copies of an id share a shard. Rows without an id go by text, the empty
    text standing for null.
    """
    names = [f"shard-{k:05d}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    table = lookup_table(docs.sparkSession, fill_table(names, slots)).withColumnsRenamed({"slot": "_slot", "shard": "_shard"})
    kept = docs.drop("slot", "shard").withColumn("slot", slot_of(docs[id_col], docs[text_col], slots))
    return kept.join(F.broadcast(table), kept["slot"] == table["_slot"]).withColumn("shard", table["_shard"]).drop(table["_slot"], table["_shard"])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows of a shard may come from any task, so none holds a whole one."""
    sharded.write.partitionBy("shard").mode("errorifexists").parquet(path)
