"""A stream of file changes, and the watcher that re-indexes on them.

The file stream of Spark tells of new files only, so the source here is a Python data source.  Its first offset is what
the present snapshot holds, so a change made while no watcher ran, or before the stream got going, is in the first
batch.  The rows between two offsets are the paths whose (mtime, size) moved, came or went.  An offset names a listing;
the listings are files in the state folder, of which a committed batch leaves the last.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Iterator

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from callweave import snapshot as S
from callweave.functions import languages as L
from callweave.functions.expressions import glob_regex
from callweave.sources import discovery as D

POLL, IDLE = 2.0, 1800.0
CHANGES = "path string, mtime double, size long, state string"
Listing = dict[str, tuple[float, int]]


def _any_of(globs: list[str]) -> re.Pattern:
    return re.compile("|".join(f"(?:{glob_regex(g).removesuffix(chr(92) + 'z').removeprefix('(?s)')}" + r"\Z)" for g in globs) or r"(?!)", re.DOTALL)


def scan(root: str) -> Listing:
    """(mtime, size) of the files that an index would look at: known dialect, in scope, not too large."""
    out = {}
    names, scope, cap = D.git_files(root), D.read_scope(root), S.max_file_bytes()
    wanted, unwanted = _any_of(scope["include"] or ["*"]), _any_of([*D.DEFAULT_EXCLUDES, *scope["exclude"]])
    for name in D.walk_files(root) if names is None else names:
        path = name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        if os.path.splitext(name)[1].lower() in L.EXTENSIONS and wanted.match(path) and not unwanted.match(path):
            try:
                s = os.stat(os.path.join(root, name))
            except OSError:
                continue
            if s.st_size <= cap:
                out[path] = (s.st_mtime, s.st_size)
    return out


def known(root: str) -> Listing:
    """The same of the files in the present snapshot; nothing before the first index."""
    try:
        with open(os.path.join(root, D.STATE, "CURRENT"), encoding="utf-8") as f:
            at = os.path.join(root, D.STATE, f.read().strip(), "files")
        got = pq.read_table(at, columns=["path", "mtime", "size"]).to_pydict()
    except (OSError, ValueError):
        return {}
    return {p: (m, n) for p, m, n in zip(got["path"], got["mtime"], got["size"])}


def moved(old: Listing, new: Listing) -> list[tuple[str, float, int, str]]:
    rows = [(p, *new[p], "modified" if p in old else "new") for p in sorted(new) if old.get(p) != new[p]]
    return rows + [(p, *old[p], "deleted") for p in sorted(old) if p not in new]


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, state: str):
        self.root, self.state = root, state

    def _put(self, n: int, files: Listing) -> dict:
        text = json.dumps(files, sort_keys=True)
        name = f"{n}-{hashlib.sha1(text.encode()).hexdigest()[:16]}.json"
        os.makedirs(self.state, exist_ok=True)
        part = os.path.join(self.state, f"{name}.part")
        with open(part, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(part, os.path.join(self.state, name))
        return {"n": n, "listing": name}

    def _get(self, offset: dict) -> Listing:
        try:
            with open(os.path.join(self.state, offset["listing"]), encoding="utf-8") as f:
                return {p: tuple(v) for p, v in json.load(f).items()}
        except FileNotFoundError:  # the state was cleaned: what the snapshot holds is certain
            return known(self.root)

    def initialOffset(self) -> dict:
        return self._put(0, known(self.root))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        new = scan(self.root)
        rows = moved(self._get(start), new)
        if not rows:
            return iter([]), start
        return iter(rows), self._put(start["n"] + 1, new)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(moved(self._get(start), self._get(end)))

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.state):
            number = name.partition("-")[0]
            if number.isdigit() and int(number) < end["n"]:
                os.remove(os.path.join(self.state, name))


class TreeChanges(DataSource):
    """format("tree_changes").option("root", ...).option("state", a folder of this stream's own)"""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return CHANGES

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options["root"], self.options["state"])


def changes(spark: SparkSession, root: str, state: str) -> DataFrame:
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("root", root).option("state", state).load()


def start(spark: SparkSession, root: str, checkpoint: str, poll: float = POLL, on_index=None) -> StreamingQuery:
    """Re-indexes the tree at every batch of changes, after waiting for another writer's lock (which goes stale)."""

    def fold(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        end = time.monotonic() + 2 * S.STALE_LOCK
        while True:
            try:
                done = S.index_safe(spark, root)
            except Exception as e:  # a watcher outlives a broken state of the tree
                done = {"error": str(e)}
            if not done.get("locked") or time.monotonic() > end:
                break
            time.sleep(poll)
        if on_index:
            on_index(number, done)

    state = checkpoint.removeprefix("file://") + "-listings"
    query = changes(spark, root, state).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(poll * 1000)} milliseconds")
    return query.start()


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
        with open(f"/proc/{pid}/cmdline", "rb") as f:
            return b"callweave" in f.read()
    except FileNotFoundError:
        return True  # no /proc: the process lives
    except OSError:
        return False


def claim(root: str) -> bool:
    """Makes this process the tree's watcher; False if another one lives."""
    at = os.path.join(root, D.STATE, "WATCHER")
    os.makedirs(os.path.dirname(at), exist_ok=True)
    for _ in range(2):
        try:
            fd = os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            os.write(fd, str(os.getpid()).encode())
            os.close(fd)
            return True
        except FileExistsError:
            try:
                with open(at, encoding="utf-8") as f:
                    pid = int(f.read() or 0)
            except (OSError, ValueError):
                pid = 0
            if pid and pid != os.getpid() and _alive(pid):
                return False
            try:
                os.remove(at)
            except FileNotFoundError:
                pass
    return False


def watch(spark: SparkSession, root: str, poll: float = POLL, idle: float = IDLE) -> None:
    """Watches until nothing has changed for `idle` seconds; one watcher per tree."""
    root = D.guard_root(root)
    if not claim(root):
        return
    last = [time.monotonic()]
    try:
        checkpoint = os.path.join(root, D.STATE, f"watch-{os.getpid()}")
        query = start(spark, root, f"file://{checkpoint}", poll, lambda *_: last.__setitem__(0, time.monotonic()))
        while query.isActive and time.monotonic() - last[0] < idle:
            query.awaitTermination(poll)
        query.stop()
    finally:
        at = os.path.join(root, D.STATE, "WATCHER")
        if os.path.exists(at):
            os.remove(at)
