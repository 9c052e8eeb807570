"""Exact de-duplication through an extendible-hash index in shared files (DataFrame functions only).

A text's key is the 64-bit hash of its normalised form.  The directory is addressed by the first bits of the key and
maps every slot to a bucket, a range of keys.  A bucket with more than `capacity` different keys is split by one more
bit; where it was as deep as the directory, the directory doubles.  Directory and entries are files of the index; a
later load starts from them, splits what its new keys overfill, and moves the entries of split buckets.

Rows are dealt by bucket, so one task owns all of a bucket's key range: it sorts the range by key and text, numbers the
different texts under one key (the chain, told apart by their bytes), and finds the row that stays, without any look-up
afterwards.  A key that very many rows share is dealt over several tasks, each of which compares bytes on its part;
only the first row of each text per part meets the others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import common

#: Different keys in a bucket, and the least share of them all (so that the directory stays bounded).
CAPACITY, BUCKETS = 2_000, 1 << 15
#: Rows of one key that one task takes, and the least share of all rows (so that there are at most 65,536 hot keys).
HOT, HOT_SHARE = 500, 1 << 16
#: Bits of the key beyond the even depth that the directory can tell apart.
SPARE = 3

_ROW = ("id", "is_new", "bucket", "depth", "key", "chain", "is_entry", "text", "text_sha256", "keep_id", "group_size")
_PARTS = "bucket int, key long, part int, chain int, keep_id long, group_size long, whole int, is_head boolean"
_ENTRY = "bucket int, depth int, key long, chain int, text string, keep_id long, group_size long"


def normalised(text: Column) -> Column:
    return common.ascii_lower(F.coalesce(text, F.lit("")))


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits) if bits else key * 0


def split_directory(counts: dict[int, int], bits: int, capacity: int, buckets: list[tuple[int, int]] = [(0, 0)]) -> list[tuple[int, int]]:  # noqa: B006
    """Buckets (prefix, depth) after splitting, in order of their keys.

    counts: keys in each slot of a directory of `bits` bits.  `buckets` are those before: a bucket is the range of
    keys that begin with the `depth` bits of `prefix`.  One is split while it is overfull and has bits left.
    """
    sums = [0]
    for slot in range(1 << bits):
        sums.append(sums[-1] + counts.get(slot, 0))
    out, todo = [], sorted(buckets, key=lambda b: b[0] / (1 << b[1]), reverse=True)
    while todo:
        prefix, depth = todo.pop()
        if depth < bits:
            width = 1 << (bits - depth)
            if sums[(prefix + 1) * width] - sums[prefix * width] > capacity:
                todo += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
                continue
        out.append((prefix, depth))
    return out


def directory_of(buckets: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """(global depth, rows (slot, bucket, depth)): all slots of the smallest directory that addresses the buckets."""
    bits = max(d for _, d in buckets)
    return bits, [(slot, n, d) for n, (prefix, d) in enumerate(buckets) for slot in range(prefix << (bits - d), (prefix + 1) << (bits - d))]


class Index:
    """An extendible-hash index in a shared folder: one directory and one set of entries per generation."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _folder(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        """The number of the last complete load; 0 for none."""
        at, fs = self._folder()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[5:]) for n in names if n.startswith("done-")), default=0)

    def complete(self, generation: int) -> None:
        """Makes a load the present one; a load that was cut off before is ignored and written over."""
        at, fs = self._folder()
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(at, f"done-{generation}"), True).close()

    def directory(self, generation: int) -> list[tuple[int, int]]:
        """Its buckets (prefix, depth)."""
        rows = self.spark.read.parquet(f"{self.path}/{generation}/directory").groupBy("bucket").agg(F.min("slot").alias("slot"), F.max("depth").alias("depth"), F.max("bits").alias("bits")).collect()
        return [(r["slot"] >> (r["bits"] - r["depth"]), r["depth"]) for r in rows]

    def rows(self, generation: int) -> DataFrame:
        """One row per document of the load and per older entry that it carried over; is_entry marks the entries, which hold the text."""
        found, parts = self.spark.read.parquet(f"{self.path}/{generation}/rows"), self.spark.read.schema(_PARTS).parquet(f"{self.path}/{generation}/parts")
        # few rows name the parts of hot keys; all other rows are whole as they are
        hot = found.where("hot").drop("keep_id", "group_size").join(parts, ["bucket", "key", "part", "chain"])
        hot = hot.withColumn("is_entry", F.col("is_entry") & F.col("is_head")).withColumn("chain", F.col("whole"))
        return found.where("not hot").select(*_ROW).unionByName(hot.withColumn("text", F.when(F.col("is_entry"), F.col("text"))).select(*_ROW))

    def entries(self, generation: int | None = None) -> DataFrame:
        """bucket, depth, key, chain, text, keep_id, group_size: one row per different text of all loads."""
        generation = generation or self.generation()
        if not generation:
            return self.spark.createDataFrame([], _ENTRY)
        return self.rows(generation).where("is_entry").select("bucket", "depth", "key", "chain", "text", "keep_id", "group_size")


def _dealt(keyed: DataFrame, index: Index | None, capacity: int | None) -> tuple[DataFrame, list[tuple[int, int]], bool]:
    """keyed (with column key) plus bucket, depth, hot and part, dealt by bucket and part; the buckets; whether any key is hot.

    The keys are counted first, apart from the texts; the driver sees at most the counts of 2^18 slots and 65,536 hot
    keys, whatever the input.
    """
    spark = keyed.sparkSession
    keys = common.stored(keyed.groupBy("key").agg(F.count("*").alias("n")), "dedup-keys")
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys")).first()
    capacity = capacity or max(CAPACITY, total["keys"] // BUCKETS)
    old = index.directory(index.generation()) if index and index.generation() else [(0, 0)]
    bits = max(max(d for _, d in old), (max(1, total["keys"] // capacity)).bit_length() + SPARE)
    counts = {r["slot"]: r["n"] for r in keys.groupBy(_prefix(F.col("key"), bits).alias("slot")).agg(F.count("*").alias("n")).collect()}
    buckets = split_directory(counts, bits, capacity, old)
    depth, slots = directory_of(buckets)
    directory = spark.createDataFrame(slots, "slot long, bucket int, depth int")
    hot = max(HOT, total["rows"] // HOT_SHARE)
    many = [(r["key"], -(-r["n"] // hot)) for r in keys.where(F.col("n") > hot).collect()]
    common.dropped(keys)
    parts = spark.createDataFrame(many, "key long, parts long")
    rows = keyed.withColumn("slot", _prefix(F.col("key"), depth)).join(F.broadcast(directory), "slot").join(F.broadcast(parts), "key", "left")
    # rows of a hot key are dealt in turn: nothing in them need be spread evenly
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("parts")))
    return rows.withColumn("hot", F.col("parts").isNotNull()).withColumn("part", part.cast("int")).drop("slot", "parts").repartition("bucket", "part"), buckets, bool(many)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_path: str | None = None, capacity: int | None = None, key: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, depth, key, chain.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty.  The row with the
    largest id of its group stays.  Ids are meant to be unique: where rows repeat both the id and the text, all of
    them carry kept = true, and `deduplicated` returns one of them.  A null id never wins over another; a group of
    null ids only has keep_id null and all of it kept.  Other columns are ignored, so their names cannot clash.
    An empty table gives an empty result.

    With an index_path that holds earlier loads, groups span all loads: group_size and keep_id count them too, and
    rows are returned for this load's documents.  `key` replaces the 64-bit hash of column `text` (for tests).
    """
    spark = docs.sparkSession
    index = Index(spark, index_path or f"{common.shared_dir(spark)}/dedup-index-{uuid.uuid4().hex}")
    before = index.generation()
    new = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("text"), F.lit(1).cast("long").alias("weight"), F.lit(True).alias("is_new"))
    every = new.unionByName(index.entries(before).select(F.col("keep_id").alias("id"), "text", F.col("group_size").alias("weight"), F.lit(False).alias("is_new"))) if before else new
    rows, buckets, any_hot = _dealt(every.withColumn("key", F.xxhash64("text") if key is None else key), index, capacity)
    # both windows and the numbering follow one sort by key and text within the owner's partition
    range_ = Window.partitionBy("bucket", "part", "key").orderBy("text")
    group = Window.partitionBy("bucket", "part", "key", "text")
    rows = rows.withColumn("chain", F.dense_rank().over(range_) - 1).withColumn("keep_id", F.max("id").over(group)).withColumn("group_size", F.sum("weight").over(group))
    rows = rows.withColumn("is_entry", F.row_number().over(group.orderBy("text")) == 1)
    rows = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).withColumn("text", F.when(F.col("is_entry"), F.col("text")))
    generation = before + 1
    at = f"{index.path}/{generation}"
    # small row groups: a task holds no more of its texts than this while it writes
    rows.select(*_ROW, "hot", "part").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{at}/rows")
    found = spark.read.parquet(f"{at}/rows")
    (_joined_parts(found) if any_hot else spark.createDataFrame([], _PARTS)).write.mode("overwrite").parquet(f"{at}/parts")
    bits, slots = directory_of(buckets)
    spark.createDataFrame([(s, b, d, bits) for s, b, d in slots], "slot long, bucket int, depth int, bits int").coalesce(1).write.mode("overwrite").parquet(f"{at}/directory")
    index.complete(generation)
    done = index.rows(generation).where("is_new")
    return done.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "depth", "key", "chain")


def _joined_parts(found: DataFrame) -> DataFrame:
    """For each part of a hot key and chain in it: the chain, keep_id and group_size of all parts together, and whether its entry stands for them.

    The first rows of each text and part meet here, by their bytes.
    """
    first = found.where("hot and is_entry").groupBy("bucket", "key", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.sort_array(F.collect_list(F.struct("part", "chain"))).alias("at"))
    first = first.withColumn("whole", F.dense_rank().over(Window.partitionBy("bucket", "key").orderBy("text")) - 1)
    joined = first.select("bucket", "key", "keep_id", "group_size", "whole", F.explode("at").alias("p"), F.element_at("at", 1).alias("head"))
    return joined.select("bucket", "key", F.col("p.part").alias("part"), F.col("p.chain").alias("chain"), "keep_id", "group_size", "whole", (F.col("p") == F.col("head")).alias("is_head"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; one of those that repeat id and text.

    A row with a null id goes if its text also stands under an id; of a group of null ids only, one row stays.  The
    whole rows are dealt by bucket, and the owner of a bucket lets the first of each text through: what stays is the
    index's entries, so nothing besides is written.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(normalised(F.col(text_col))).alias("key"))
    rows, _, any_hot = _dealt(keyed, None, capacity)

    def first(some: DataFrame, *by: str) -> DataFrame:
        best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("id")))
        return some.withColumn("n", best).where("n = 1")

    rows = rows.withColumn("text", normalised(F.col(f"doc.`{text_col}`")))
    own = ("bucket", "part", "key", "text")
    if not any_hot:
        return first(rows, *own).select("doc.*")
    # a hot key leaves one row for each text and part, and these meet once more
    return first(rows.where("not hot"), *own).select("doc.*").unionByName(first(first(rows.where("hot"), *own), "key", "text").select("doc.*"))
