"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size: it starts at an offset and goes on by a
skip, both from the hash of its name, and so meets every slot once. The shards take turns; at its turn a shard claims
the first slot of its order that is free. Slots differ by at most one between shards, and when a shard comes or goes
most slots keep their shard.

The table has ``slots`` rows, a parameter that does not depend on the data, and is filled once on the driver. Rows find
their shard by a broadcast join on the slot of their key: one pass, no shuffle, whatever keys are frequent.

A null key counts as the empty string. Equal keys go to the same shard; with many rows of one key, pass further columns
as the key. An empty table gives an empty table. Columns of the input named ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime; at least a hundred slots for each shard keep the shards even.
SLOTS = 65_537


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard of each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, no more than slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    step = [zlib.crc32(f"skip:{s}".encode()) % (slots - 1) + 1 for s in shards]
    at = [zlib.crc32(f"offset:{s}".encode()) % slots for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return table


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot and shard, made from one literal array."""
    owners = fill(shards, slots)
    names = F.array(*(F.lit(s) for s in shards))
    # chunks of 256 slots, four hexadecimal digits each
    chunks = F.array(*(F.lit("".join(f"{i:04x}" for i in owners[at : at + 256])) for at in range(0, slots, 256)))
    rows = spark.range(-(-slots // 256), numPartitions=1).select(F.col("id").cast("int").alias("chunk"), F.get(chunks, F.col("id").cast("int")).alias("digits"))
    each = rows.select("chunk", "digits", F.explode(F.sequence(F.lit(0), (F.length("digits") / 4 - 1).cast("int"))).alias("i"))
    i = F.col("i")
    return each.select((F.col("chunk") * 256 + i).alias("slot"), names[F.conv(F.substr(F.col("digits"), i * 4 + 1, F.lit(4)), 16, 10).cast("int")].alias("shard"))


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, so that any system can find it."""
    text = F.concat_ws("\x1f", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def assign(df: DataFrame, keys: list[str], shards: list[str], *, slots: int = SLOTS) -> DataFrame:
    """``df`` with the slot and the shard of each row."""
    return df.drop("slot", "shard").withColumn("slot", slot_of(*(F.col(k) for k in keys), slots=slots)).join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot").select(*(F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")), "slot", "shard")


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str, *, slots: int = SLOTS, rows_per_file: int = 1_000_000) -> None:
    """One folder for each shard; each task writes the shards that its rows have, so nothing is shuffled."""
    assign(df, keys, shards, slots=slots).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
