"""Change detection between a listing and the stored files, and differences between two edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.lookups import edge_labels


def suspects(listing: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Listed files whose content must be looked at: new, or with another time or size than stored."""
    old = files.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.col("hash").alias("old_hash"))
    x = listing.join(old, "path", "left")
    same = (F.col("mtime") == F.col("_mtime")) & (F.col("_size").isNull() | (F.col("size") == F.col("_size")))
    return (x if force else x.where(~F.coalesce(same, F.lit(False)))).drop("_mtime", "_size")


def removed(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Stored paths that are not listed."""
    return files.select("path").join(listing.select("path"), "path", "left_anti")


def changed_files(hashed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state): new, modified or deleted, by the hashes of what is there now (path, hash) and what is stored."""
    now, old = hashed.select("path", F.col("hash").alias("now")), files.select("path", F.col("hash").alias("old"), F.lit(True).alias("was"))
    there = now.withColumn("is_", F.lit(True))
    x = there.join(old, "path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("is_").isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("old")), "modified")
    return x.select("path", state.alias("state")).where("state is not null").orderBy("path")


def edge_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, added, removed): sorted strings `src -> dst [resolution]` of labelled edges, for files that differ."""
    cols = ["file", "src_label", "dst_label", "resolution"]
    a, b = before.select(cols).distinct().withColumn("_a", F.lit(True)), after.select(cols).distinct().withColumn("_b", F.lit(True))
    x = a.join(b, cols, "full_outer").where("_a is null or _b is null")
    text = F.concat("src_label", F.lit(" -> "), "dst_label", F.lit(" ["), "resolution", F.lit("]"))
    pick = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNull(), text)))
    return x.groupBy("file").agg(pick("_a").alias("added"), pick("_b").alias("removed"))


def labelled_difference(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """edge_difference of two (edges, symbols) pairs."""
    return edge_difference(edge_labels(*before), edge_labels(*after))
