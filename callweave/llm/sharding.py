"""Shards by jump consistent hashing.

The stable key alone and the number of shards decide the shard: no ring, no table.  Growing from n to n + 1 shards
moves about 1 / (n + 1) of the rows, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import common

#: Fixed value: the multiplier of the generator in the published algorithm.
_MULTIPLIER = np.uint64(2862933555777941757)
ROWS_PER_RANGE = 20_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.zeros(len(state), dtype=np.int64)
    jump = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while len(live):
        bucket[live] = jump[live]
        s = state[live] * _MULTIPLIER + np.uint64(1)
        state[live] = s
        jump[live] = np.floor((bucket[live] + 1) * (float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[jump[live] < shards]
    return bucket


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long column as an int; null keys count as key 0."""

    @F.pandas_udf("int")
    def jump(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return jump(F.coalesce(key, F.lit(0).cast("long")))


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`.  size is the text's UTF-8 bytes plus 1 (null: 1).  slot numbers the rows of a shard from 0
    without gaps in the order of the MD5 of the id: rows fall into ranges of that order whose number grows with the
    input, ranges are counted, and rows are numbered inside their range, so no task holds a shard.  A null id is
    keyed as 0.  Rows that repeat an id share a shard and get slots of their own.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    d = d.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    d = common.stored(d, "shards")
    ranges = max(1, -(-d.count() // ROWS_PER_RANGE))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = d.withColumn("_h", order).withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int"))
    counts = d.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("shard", "_b").orderBy("_h", "doc_id", "text_crc32", "size")
    d = d.withColumn("_in", F.row_number().over(inside)).join(before, ["shard", "_b"])
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_off") + F.col("_in") - 1).alias("slot"), "grown_shard")
