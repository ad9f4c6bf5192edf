"""Sharding by jump consistent hashing, in DataFrame functions only.

The published loop draws from a 64-bit linear congruential generator seeded with the key and jumps to the next shard
count at which the key would move; where it stops is the shard. No ring table exists, and appending a shard moves only
the rows that land in it. The generator's product does not fit a signed long, so it is kept as four 16-bit limbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wicker.llm.common import documents

#: Fixed value of the published algorithm: the generator's multiplier.
MULTIPLIER = 2862933555777941757
#: Rows of one shard are numbered in runs of about this many, dealt by a hash of the row, so that no task numbers a whole shard.
RUN_ROWS = 1 << 18


def _step(state: Column) -> Column:
    a = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
    k = [state[f"k{i}"] for i in range(4)]
    low = lambda c: c.bitwiseAND(F.lit(0xFFFF))
    r = [k[0] * a[0] + F.lit(1)]
    r.append(k[0] * a[1] + k[1] * a[0] + F.shiftright(r[0], 16))
    r.append(k[0] * a[2] + k[1] * a[1] + k[2] * a[0] + F.shiftright(r[1], 16))
    r.append(k[0] * a[3] + k[1] * a[2] + k[2] * a[1] + k[3] * a[0] + F.shiftright(r[2], 16))
    top31 = F.shiftleft(low(r[3]), 15).bitwiseOR(F.shiftright(low(r[2]), 1))
    jump = F.floor((state["next"] + F.lit(1)) * (F.lit(2147483648.0) / (top31 + F.lit(1)))).cast("long")
    return _state([low(x) for x in r], state["next"], jump, state["at"])


def _state(limbs: list[Column], at: Column, following: Column, before: Column) -> Column:
    return F.struct(*[x.cast("long").alias(f"k{i}") for i, x in enumerate(limbs)], at.cast("long").alias("at"), following.cast("long").alias("next"), before.cast("long").alias("before"))


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard): where a long key lands among `shards`, and among one more."""
    limbs = [F.shiftrightunsigned(key, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    end = F.aggregate(
        F.sequence(F.lit(0), F.lit(shards + 1)),
        _state(limbs, F.lit(-1), F.lit(0), F.lit(-1)),
        lambda s, _: F.when(s["next"] < shards + 1, _step(s)).otherwise(s),
    )
    return F.transform(F.array(end), lambda s: F.struct(F.when(s["at"] < shards, s["at"]).otherwise(s["before"]).cast("int").alias("shard"), s["at"].cast("int").alias("grown_shard")))[0]


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Law `key`: id and shard count alone decide. size is the text's UTF-8 bytes plus 16. slot numbers each shard's rows
    from 0 without gaps, in order of a hash of id, text_crc32 and size, so that ids may be dense, sparse or null. Null or
    empty text: size 16, crc 0. Null id: treated as id -1. Repeated rows land in one shard and take neighbouring slots.
    An empty table gives no rows; other columns of the input are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("k"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("to", jump_shards(F.col("k"), shards)).select("*", "to.*").drop("to")
    rows = rows.withColumn("run", F.pmod(F.xxhash64("k", "text_crc32", "size"), F.lit(docs.count() // (shards * RUN_ROWS) + 1)))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n")).select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "run").orderBy("k", "text_crc32", "size")
    placed = rows.join(starts, ["shard", "run"]).withColumn("slot", (F.col("start") + F.row_number().over(inside) - 1).cast("long"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 40)
