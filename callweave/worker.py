"""Command line: `pre` and `post` around an edit (JSON on standard input), and `watch`.

Workers never stand in the way of an edit: any failure ends them silently.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from callweave.sources import discovery as D


def edited_path(data: dict) -> str | None:
    given = data.get("tool_input") or {}
    return given.get("file_path") or given.get("notebook_path")


def session() -> SparkSession:
    return SparkSession.builder.master("local[2]").appName("callweave").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def edit(mode: str, start: str, raw: str, spark: SparkSession | None = None) -> str | None:
    """The JSON answer to one edit, or None."""
    from callweave.api import DependencyGraph

    root = D.governing_root(start)
    path = edited_path(json.loads(raw) if raw.strip() else {})
    if not root or not path:
        return None
    graph = DependencyGraph(spark or session(), root)
    if mode == "pre":
        said = graph.before_edit(path)
        return json.dumps({"hookSpecificOutput": {"hookEventName": "PreToolUse", "additionalContext": said}}) if said else None
    said = graph.after_edit(path)
    return json.dumps({"systemMessage": said}) if said else None


def main(argv: list[str]) -> int:
    try:
        if argv[0] == "watch":
            from callweave.streaming.watcher import watch

            watch(session(), argv[1], float(argv[2]) if len(argv) > 2 else 2.0)
        else:
            said = edit(argv[0], argv[1], sys.stdin.read())
            if said:
                print(said)
    except Exception:  # fail open: an edit goes on whatever happens here
        return 0
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
