"""Snapshots: immutable versions of all tables, and the index that writes them.

<root>/.callweave/CURRENT names the version that readers see; it is replaced in one step after a version is complete, so
a half-written version is never visible, readers are never disturbed, and there is no state to repair after a crash.
A version holds its fact tables, the edges computed from them, and a manifest.  Facts of unchanged files are carried
over; edges are recomputed over all facts.
"""

from __future__ import annotations

import errno
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import languages as L
from callweave.model import DERIVED, FACTS, SCHEMA_VERSION, Facts, conform, empty
from callweave.operators import aggregates, changes
from callweave.operators.storage import stored
from callweave.parse.extract import facts_from, parse_files
from callweave.plans.hooks import resolve_hooks
from callweave.plans.resolve import call_edges, resolve_refs, unresolved_calls
from callweave.sources import discovery as D

STALE_LOCK = 3600.0


class Locked(RuntimeError):
    """Another process is writing the index."""


class Corrupt(RuntimeError):
    """The present version cannot be read."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.base = os.path.join(root, D.STATE)

    # --- reading ---
    def current(self) -> str | None:
        try:
            with open(os.path.join(self.base, "CURRENT"), encoding="utf-8") as f:
                return f.read().strip() or None
        except FileNotFoundError:
            return None

    def manifest(self) -> dict:
        version = self.current()
        if version is None:
            return {}
        try:
            with open(os.path.join(self.base, version, "manifest.json"), encoding="utf-8") as f:
                got = json.load(f)
            if not isinstance(got, dict) or "schema" not in got:
                raise ValueError("not a manifest")
            return got
        except (OSError, ValueError) as e:
            raise Corrupt(str(e)) from e

    def table(self, name: str) -> DataFrame:
        """A table of the present version in the current schema; empty before the first index."""
        version = self.current()
        if version is None:
            return empty(self.spark, name)
        at = os.path.join(self.base, version, name)
        try:
            return conform(self.spark.read.parquet(f"file://{at}"), name)
        except PySparkException as e:
            raise Corrupt(f"{name}: {e}"[:300]) from e

    def facts(self) -> Facts:
        return Facts(self.spark, **{t: self.table(t) for t in FACTS})

    def check(self, deep: bool = False) -> None:
        """Reads the manifest and the footers of every table's files, or if deep all of them; raises Corrupt if one is damaged."""
        version = self.current()
        if version is None:
            return
        self.manifest()
        for t in (*FACTS, *DERIVED):
            try:
                if deep:
                    self.table(t).write.format("noop").mode("overwrite").save()
                else:
                    at = os.path.join(self.base, version, t)
                    for name in os.listdir(at):
                        if name.endswith(".parquet"):
                            pq.read_metadata(os.path.join(at, name))
            except (OSError, pa.ArrowException) as e:
                raise Corrupt(f"{t}: {e}"[:300]) from e
            except PySparkException as e:
                raise Corrupt(f"{t}: {e}"[:300]) from e

    def quarantine(self) -> str | None:
        """Moves a damaged version aside, so that the next index starts anew."""
        version = self.current()
        moved = None
        if version and os.path.isdir(os.path.join(self.base, version)):
            moved = os.path.join(self.base, f"{version}.corrupt")
            shutil.rmtree(moved, ignore_errors=True)
            os.replace(os.path.join(self.base, version), moved)
        if os.path.exists(os.path.join(self.base, "CURRENT")):
            os.remove(os.path.join(self.base, "CURRENT"))
        return moved

    # --- writing ---
    @contextmanager
    def lock(self) -> Iterator[None]:
        os.makedirs(self.base, exist_ok=True)
        at = os.path.join(self.base, "LOCK")
        try:
            if time.time() - os.stat(at).st_mtime > STALE_LOCK:
                os.remove(at)
        except FileNotFoundError:
            pass
        try:
            fd = os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except OSError as e:
            if e.errno == errno.EEXIST:
                raise Locked(self.root) from None
            raise
        try:
            os.write(fd, str(os.getpid()).encode())
            os.close(fd)
            yield
        finally:
            if os.path.exists(at):
                os.remove(at)

    def write(self, facts: Facts, info: dict) -> str:
        """A new version from facts: edges and unresolved calls are computed, then all is made current."""
        version = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        at = os.path.join(self.base, version)
        put = lambda df, t: (df.write.parquet(f"file://{at}/{t}"), self.spark.read.parquet(f"file://{at}/{t}"))[1]
        for t in FACTS:
            if t != "hooks":
                facts[t] = conform(put(facts[t], t), t)
        raw = stored(facts["hooks"], "hooks")
        hooks, hook_edges = resolve_hooks(Facts(self.spark, **(dict(facts) | {"hooks": raw})))
        put(hooks, "hooks")
        resolved = stored(resolve_refs(facts), "resolved")
        put(call_edges(resolved).unionByName(hook_edges), "edges")
        put(unresolved_calls(resolved), "unresolved")
        with open(os.path.join(at, "manifest.json"), "w", encoding="utf-8") as f:
            json.dump({"schema": SCHEMA_VERSION, **info}, f)
        old = self.current()
        part = os.path.join(self.base, f"CURRENT.{version}")
        with open(part, "w", encoding="utf-8") as f:
            f.write(version)
        os.replace(part, os.path.join(self.base, "CURRENT"))
        self._drop_old(version, old)
        return version

    def _drop_old(self, *keep: str | None) -> None:
        """Versions other than the present and the one before it; readers of those two go on."""
        for d in os.listdir(self.base):
            if d.startswith("v") and "." not in d and d not in keep:
                shutil.rmtree(os.path.join(self.base, d), ignore_errors=True)


def max_file_bytes() -> int:
    return int(os.environ.get("CALLWEAVE_MAX_FILE_BYTES", L.MAX_FILE_BYTES))


def index(spark: SparkSession, root: str, force: bool = False, now: float | None = None) -> dict:
    """Brings the index of a tree up to date and reports what was done.

    Only files whose time or size moved are read, only those whose hash moved are parsed; if nothing moved, nothing is
    written.  A damaged version is moved aside and the tree indexed anew (healed in the result).  Manifest and footers
    are looked at beforehand, whole tables only after an error.
    """
    root = D.guard_root(root)
    snaps = Snapshots(spark, root)
    with snaps.lock():
        try:
            snaps.check()
            try:
                return _index(snaps, force, now)
            except PySparkException:
                snaps.check(deep=True)
                raise
        except Corrupt:
            snaps.quarantine()
            return _index(snaps, True, now) | {"healed": True}


def index_safe(spark: SparkSession, root: str, force: bool = False) -> dict:
    """index(), with a result instead of an error while another process writes."""
    try:
        return index(spark, root, force)
    except Locked:
        return {"error": "the index is being written by another process; try again shortly", "locked": True, "root": os.path.abspath(root)}


def _index(snaps: Snapshots, force: bool, now: float | None) -> dict:
    spark, root = snaps.spark, snaps.root
    now = time.time() if now is None else now
    cap = max_file_bytes()
    first = snaps.current() is None
    old = snaps.facts()
    listing = stored(D.discover(spark, root), "listing")
    gone = changes.removed(listing, old.files)
    large = listing.where(F.col("size") > cap)
    look = changes.suspects(listing.where(F.col("size") <= cap), old.files, force)
    # content is read once, for the suspects only, and hashed and judged where it is read
    read = D.contents(spark, root, look)
    read = read.withColumn("hash", D.content_hash(F.col("content"))).withColumn("minified", F.coalesce(D.is_minified(F.col("content")), F.lit(False)))
    read = stored(read, "read")
    unreadable = read.where("content is null")
    minified = read.where("minified")
    fine = read.where("content is not null and not minified")
    touched = fine.where("hash = old_hash") if not force else fine.limit(0)
    fresh = fine.where("old_hash is null or hash <> old_hash") if not force else fine
    stale = large.select("path").union(minified.select("path")).join(old.files.select("path"), "path", "left_semi")
    parts = {"discovered": listing, "reindexed": fresh, "removed": gone, "unreadable": unreadable, "large": large, "minified": minified, "dropped": stale}
    tagged = [df.select(F.lit(k).alias("k")) for k, df in parts.items()]
    n = dict.fromkeys(parts, 0) | {r["k"]: r["count"] for r in reduce(DataFrame.union, tagged).groupBy("k").count().collect()}
    out = {"root": root, "discovered": n["discovered"], "reindexed": n["reindexed"], "unchanged": n["discovered"] - n["reindexed"] - n["unreadable"] - n["large"] - n["minified"], "removed": n["removed"], "unreadable": n["unreadable"], "skipped_large": n["large"] + n["minified"]}
    warnings = [(r["path"], f"skipped: {r['size']} bytes, the cap is {cap}") for r in large.select("path", "size").orderBy("path").limit(1000).collect()]
    warnings += [(r["path"], "skipped: looks minified or generated") for r in minified.select("path").orderBy("path").limit(1000).collect()]
    extra = 0
    if force or first or n["reindexed"] or n["removed"] or n["dropped"]:
        parsed = stored(parse_files(fresh), "parsed")
        meta = fresh.join(parsed.select("path", "warnings"), "path").select("path", "lang", "hash", "mtime", "size", F.lit(now).alias("indexed_at"), "warnings")
        new = facts_from(parsed, meta)
        # an unreadable file keeps the facts of its last good version
        leave = stored(gone.union(stale).union(fresh.select("path")).distinct(), "leave")
        kept_files = old.files.join(leave, "path", "left_anti")
        moved = touched.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
        kept_files = kept_files.join(moved, "path", "left").withColumn("mtime", F.coalesce("_m", "mtime")).withColumn("size", F.coalesce("_s", "size")).drop("_m", "_s")
        tables = {"files": kept_files.unionByName(new.files)}
        for t in FACTS:
            if t != "files":
                kept = old[t].join(leave.withColumnRenamed("path", "file"), "file", "left_anti")
                kept = kept.withColumn("hook", F.col("hook_raw")) if t == "hooks" else kept
                tables[t] = kept.unionByName(new[t])
        snaps.write(Facts(spark, **tables), {"indexed_at": now, "files": n["discovered"]})
        got = parsed.where(F.size("warnings") > 0).select("path", F.explode("warnings").alias("w"))
        extra = got.count()
        warnings += [(r["path"], r["w"]) for r in got.orderBy("path").limit(20).collect()]
        extra = max(0, extra - 20)
    elif not touched.isEmpty():
        _touch(snaps, touched)
    out |= aggregates.site_counts(snaps.table("edges"), snaps.table("unresolved")).first().asDict()
    texts = [f"{p}: {w}" for p, w in sorted(warnings)]
    out |= {"warnings": texts[:20], "warning_count": len(texts) + extra + max(0, n["large"] - 1000) + max(0, n["minified"] - 1000)}
    return out | scope_state(spark, root, n["discovered"])


def _touch(snaps: Snapshots, touched: DataFrame) -> None:
    """New times for files whose content did not move: only the files table is written again, in the present version's place."""
    version = snaps.current()
    at = os.path.join(snaps.base, version)
    files = snaps.table("files")
    moved = touched.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    new = files.join(moved, "path", "left").withColumn("mtime", F.coalesce("_m", "mtime")).withColumn("size", F.coalesce("_s", "size")).drop("_m", "_s")
    # a new version directory that shares the other tables by hard links keeps the old one intact for its readers
    version = f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
    to = os.path.join(snaps.base, version)
    shutil.copytree(at, to, copy_function=os.link, ignore=lambda d, names: ["files"] if d == at else [])
    new.write.parquet(f"file://{to}/files")
    part = os.path.join(snaps.base, f"CURRENT.{version}")
    with open(part, "w", encoding="utf-8") as f:
        f.write(version)
    os.replace(part, os.path.join(snaps.base, "CURRENT"))
    snaps._drop_old(version, os.path.basename(at))


def scope_state(spark: SparkSession, root: str, files: int) -> dict:
    """How the tree is scoped, always; with a suggestion where it is large and is not."""
    if os.path.exists(D.config_path(root)):
        return {"scope": {"applied": True, **D.read_scope(root)}}
    globs = D.suggest_scope(D.listing(spark, root)) if files > L.SUGGEST_SCOPE_ABOVE else []
    if not globs:
        return {"scope": {"applied": False, "files": files, "note": "not scoped; no scope is needed at this size"}}
    found = {"applied": False, "files": files, "suggested_exclude": globs, "reason": "core and known vendor directories of a WordPress tree", "directive": "Review the list and pass it to scope(exclude=...), so that rankings show the tree's own code."}
    return {"scope": found, "scope_suggestion": found}


def hashed_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash) of every file that index() would take, from its present content."""
    files = D.discover(spark, root).where(F.col("size") <= max_file_bytes())
    read = D.contents(spark, root, files).where("content is not null")
    return read.withColumn("_min", D.is_minified(F.col("content"))).where("not _min").select("path", D.content_hash(F.col("content")).alias("hash"))


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, state) of files that differ from the index, by content; a file too large or minified is no new file."""
    root = os.path.realpath(root)
    snaps = Snapshots(spark, root)
    listed = D.discover(spark, root).select("path")
    found = changes.changed_files(stored(hashed_tree(spark, root), "hashes"), snaps.table("files"))
    # what is listed but cannot be taken now (grew, unreadable) is not deleted
    return found.join(listed.withColumn("_there", F.lit(True)), "path", "left").where("state <> 'deleted' or _there is null").select("path", "state").orderBy("path")
