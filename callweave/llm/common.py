"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: space and 0x09-0x0D, and nothing else.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(c, _UPPER, _LOWER)


def fold(c: Column, n: int) -> Column:
    """crc32 of a value's text form, modulo n."""
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  A local session without one (tests) gets a temporary folder; a cluster is refused."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="callweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage and lets several branches use it."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Removes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def trimmed(batches: Iterator) -> Iterator:
    """The batches; before each, memory that the one before freed goes back to the system.

    Python workers outlive their stage and would keep their peak beside the next stage's.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library
        yield batch
        del batch


def some_texts(column: pa.Array, room: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a column, some at a time: (place of the first, texts of about `room` characters or one longer)."""
    lo, held, part = 0, 0, []
    for k in range(len(column)):
        t = column[k].as_py()
        if part and held + len(t or "") > room:
            yield lo, part
            lo, held, part = k, 0, []
        part.append(t)
        held += len(t or "")
    if part:
        yield lo, part


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the offsets of their groups, from batches whose equal keys stand together.

    Keys are integer columns without nulls.  A table holds one batch and the tail of the one before; only a
    group longer than a batch makes it larger.
    """
    rest: list[pa.RecordBatch] = []
    for batch in trimmed(batches):
        if not batch.num_rows:
            continue
        rest.append(batch)
        table = pa.Table.from_batches(rest)
        cuts = _cuts(table, keys)
        if len(cuts) > 1:
            yield table.slice(0, cuts[-1]), np.append(cuts[:-1], cuts[-1])
            rest = table.slice(cuts[-1]).combine_chunks().to_batches()
    if rest:
        table = pa.Table.from_batches(rest)
        yield table, np.append(_cuts(table, keys), table.num_rows)


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def fixed_binary(column: pa.ChunkedArray | pa.Array, dtype, width: int) -> np.ndarray:
    """A matrix from a binary column whose values all hold `width` numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def in_blocks(df: DataFrame, key: str, blocks: Column, member: Column) -> DataFrame:
    """Deals the members of each key into blocks and copies each to every pair of blocks it is part of.

    Adds blk (the row's own block), bi <= bj (the pair); every two members of a key meet in exactly one pair:
    in (b, b) if they share block b, else in the pair of their two blocks.
    """
    df = df.withColumn("_nb", F.greatest(F.lit(1), blocks).cast("int"))
    df = df.withColumn("blk", F.pmod(F.xxhash64(member), F.col("_nb")).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return df.withColumn("bi", F.least("blk", "_o")).withColumn("bj", F.greatest("blk", "_o")).drop("_nb", "_o")


#: Rows of one key that a join gives one task, and the least share of all rows (so at most 65,536 keys are dealt over more).
ROWS_A_TASK, TASK_SHARE = 500, 1 << 16


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], member: str, total: int) -> DataFrame:
    """rows join table on keys, where table has one row per key with `many`, the rows under it.

    Keys with very many of the `total` rows are dealt over several tasks by the hash of `member`, and their table row
    is copied to each.  The list of those keys is broadcast; as each has at least 1/65,536 of all rows, it is bounded.
    """
    most = max(ROWS_A_TASK, total // TASK_SHARE)
    salts = F.ceil(F.col("many") / most).cast("int")
    hot = table.where(F.col("many") > most).select(*keys, salts.alias("_salts"))
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(member), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), salts) - 1))).drop("many")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def by_group(df: DataFrame, keys: list[str], f: Callable, schema: str) -> DataFrame:
    """mapInArrow(f) over partitions in which the rows of each group stand together."""
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(f, schema)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node.

    Alternates large-star and small-star steps until the edges are a forest of stars; the number of rounds grows
    with the logarithm of the longest path.  Each step is a grouped minimum and an equi-join; a node with very many
    neighbours is pre-aggregated in the first and dealt over tasks in the second.  The state of a round is cut with a
    table in the shared folder, which goes when the next is written.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "cc")
    before, size = None, e.count()
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many")).select("u", F.least("u", "m").alias("m"), "many")
        large = salted_join(both, low, ["u"], "v", 2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("many"))
        small = salted_join(large, low, ["u"], "v", size).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, e = e, stored(small.distinct(), "cc")
        dropped(old)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("sum")).first()
        size = now["n"]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
