"""Filters, lookups and projections over symbols, edges and hooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.expressions import label, targets_file


def find(symbols: DataFrame, name: str, lang: str | None = None, kind: str | None = None) -> DataFrame:
    """Definitions of a name by file and line."""
    s = symbols.where(F.col("name") == name)
    s = s.where(F.col("lang") == lang) if lang else s
    s = s.where(F.col("kind") == kind) if kind else s
    return s.orderBy("file", "start_line", "start_byte")


def qualified(symbols: DataFrame, name: str, lang: str | None = None, kind: str | None = None, file: str | None = None) -> DataFrame:
    """Definitions of `name` or `Container.name`; a name with :: is never split."""
    container = None
    if "." in name and "::" not in name:
        container, _, name = name.rpartition(".")
    s = find(symbols, name, lang, kind)
    s = s.where(F.coalesce("container", F.lit("")) == container) if container else s
    return s.where(F.col("file").contains(file)) if file else s


def by_file(symbols: DataFrame, target: str) -> DataFrame:
    return symbols.where(targets_file(F.col("file"), target))


def by_ids(symbols: DataFrame, ids: DataFrame) -> DataFrame:
    """The definitions whose id is among `ids` (id); one id or many, it is a join."""
    return symbols.join(ids.select("id").distinct(), "id", "left_semi")


def file_states(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, hash, mtime, size) of the stored files among `paths` (path)."""
    return files.join(paths.select("path").distinct(), "path", "left_semi").select("path", "hash", "mtime", "size")


def labelled(symbols: DataFrame) -> DataFrame:
    return symbols.select("id", label(F.col("container"), F.col("name")).alias("symbol"), "kind", "file", F.col("start_line").alias("line"), "lang")


def neighbours(edges: DataFrame, symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, direction, symbol columns, at_line, resolution): who calls the seeds (id) and what they call, one hop."""
    e = edges.select("src", "dst", F.col("line").alias("at_line"), "resolution")
    s = seeds.select(F.col("id").alias("seed")).distinct()
    near = labelled(symbols)
    calls = e.join(s, e.src == s.seed).select("seed", F.lit("out").alias("direction"), F.col("dst").alias("id"), "at_line", "resolution")
    called = e.where("src is not null").join(s, e.dst == s.seed).select("seed", F.lit("in").alias("direction"), F.col("src").alias("id"), "at_line", "resolution")
    return calls.union(called).join(near, "id")


def known_edges(edges: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst) of edges with a caller, without some resolutions."""
    e = edges.where(F.col("src").isNotNull())
    return (e.where(~F.col("resolution").isin(*exclude)) if exclude else e).select("src", "dst")


def edge_labels(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, src_label, dst_label, resolution); a call outside any definition has the label <module>."""
    s = symbols.select("id", label(F.col("container"), F.col("name")).alias("label"))
    a, b = s.select(F.col("id").alias("src"), F.col("label").alias("src_label")), s.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(b, "dst").join(a, "src", "left").select("file", F.coalesce("src_label", F.lit("<module>")).alias("src_label"), "dst_label", "resolution")


# --- hooks ---
def hooks_of_symbol(hooks: DataFrame, symbol: Column | int) -> DataFrame:
    return hooks.where(F.col("callback_symbol") == symbol)


def listeners(hooks: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Listeners of a hook with the label of their callback, which is its text where it has no definition."""
    return _with_callback(hooks.where((F.col("kind") == "listen") & (F.col("hook") == name)), symbols).orderBy("file", "line", "id")


def fires(hooks: DataFrame, name: str) -> DataFrame:
    return hooks.where((F.col("kind") == "fire") & (F.col("hook") == name)).orderBy("file", "line", "id")


def entry_points(hooks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Entry points, those without authentication first, then by class and hook."""
    return _with_callback(hooks.where("entry_point"), symbols).orderBy(F.desc("unauth"), "hook_class", "hook", "file", "line", "id")


def _with_callback(hooks: DataFrame, symbols: DataFrame) -> DataFrame:
    s = symbols.select(F.col("id").alias("callback_symbol"), label(F.col("container"), F.col("name")).alias("_label"), F.col("file").alias("cb_file"), F.col("start_line").alias("cb_line"))
    return hooks.join(s, "callback_symbol", "left").withColumn("callback", F.coalesce("_label", "cb_raw")).drop("_label")
