"""Indexing a real tree, keeping it up to date, and the tools on top."""

import json
import os
import shutil
import subprocess
import time

import pytest

from callweave import snapshot, worker
from callweave.api import DependencyGraph
from callweave.functions.expressions import glob_regex
from callweave.sources import discovery
from callweave.streaming import watcher


def put(root, files):
    for name, text in files.items():
        at = os.path.join(root, name)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w", encoding="utf-8") as f:
            f.write(text)


TREE = {
    "shop/cart.py": "from shop.tax import rate\n\n\nclass Cart:\n    def add(self, x):\n        return self.total(x)\n\n    def total(self, x):\n        return rate(x)\n",
    "shop/tax.py": "def rate(x):\n    return rate(x - 1)\n",
    "shop/app.py": "import cart\n\n\ndef main():\n    c = Cart()\n    c.add(1)\n\n\nmain()\n",
    "web/a.php": "<?php class Api { function boot() { add_action('wp_ajax_nopriv_go', [$this, 'go']); } function go() {} function fire() { do_action('wp_ajax_nopriv_go'); } }\n",
    "notes.txt": "no code",
}
LONE = "class Alone:\n    def stay(self): pass\n"


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    put(root, TREE)
    return os.path.realpath(root)


def test_the_life_of_an_index(spark, tree):
    g = DependencyGraph(spark, tree)
    first = g.index()
    assert (first["discovered"], first["reindexed"], first["unchanged"], first["removed"]) == (4, 4, 0, 0)
    assert first["edges_hook"] == 1 and first["scope"]["applied"] is False and first["warning_count"] == 0
    version = g.snaps.current()
    again = g.index()
    assert (again["reindexed"], again["unchanged"]) == (0, 4) and g.snaps.current() == version
    stats = g.stats()
    assert all(stats[k] == first[k] for k in ("edges_exact", "edges_inferred", "edges_ambiguous", "edges_hook", "unresolved", "edge_rows"))
    assert stats["files"] == 4 and stats["by_language"] == {"python": 5, "php": 4} and stats["unauth_entry_points"] == 1

    # tools
    up = g.callers("rate")
    assert [(n["symbol"], n["depth"]) for n in up["nodes"]] == [("Cart.total", 1), ("Cart.add", 2), ("main", 3)]
    assert [n["symbol"] for n in g.callees("main", depth=1)["nodes"]] == ["Cart", "Cart.add"]
    assert "error" in g.callers("nothing")
    assert g.find("rate")["matches"][0]["signature"] == "def rate(x):"
    near = g.neighbors("Cart.add")["definitions"][0]
    assert [n["symbol"] for n in near["called_by"]] == ["main"] and [n["resolution"] for n in near["calls"]] == ["exact"]
    way = g.path("main", "rate")
    assert (way["hops"], way["path"], way["src_candidates"], way["dst_candidates"]) == (3, ["main", "Cart.add", "Cart.total", "rate"], 1, 1) and way["detail"][0]["file"] == "shop/app.py"
    assert g.path("rate", "main")["hops"] is None and "error" in g.path("rate", "none")
    assert g.cycles() == {"cycle_count": 1, "cycles": [{"size": 1, "members": [{"symbol": "rate", "file": "shop/tax.py", "line": 1}]}]}
    hot = g.hotspots(top=2)
    assert hot["betweenness_computed"] and hot["most_depended_upon"][0]["symbol"] == "rate" and len(hot["most_depended_upon"]) == 2
    blast = g.blast_radius("./shop/tax.py")
    # only the seed itself is left out, per seed
    assert blast["impacted_symbol_count"] == 3 and list(blast["by_file"]) == ["shop/app.py", "shop/cart.py"]
    assert "error" in g.blast_radius("  ") and "error" in g.blast_radius("none.py")
    assert g.blast_radius("Api.go")["hook_context"] == ["Api.go fires on 'wp_ajax_nopriv_go' [UNAUTH ENTRY]"]
    entry = g.hooks(entry_points=True)
    assert entry["count"] == 1 and entry["entry_points"][0]["auth"] == "UNAUTH" and entry["entry_points"][0]["callback"] == "Api.go"
    assert g.hooks("wp_ajax_nopriv_go")["listeners"][0]["resolved"] and g.hooks("Api.go")["registered_on"][0]["unauth"] and "error" in g.hooks("none")

    # drift
    assert g.pending() == {"root": tree, "changed_files": 0, "deltas": []}
    put(tree, {"shop/cart.py": TREE["shop/cart.py"].replace("return rate(x)", "return flat(x)"), "shop/flat.py": "def flat(x):\n    return x\n", "lone.py": LONE})
    os.remove(os.path.join(tree, "shop/app.py"))
    drift = g.pending()
    assert {d["file"]: d["state"] for d in drift["deltas"]} == {"lone.py": "new", "shop/app.py": "deleted", "shop/cart.py": "modified", "shop/flat.py": "new"}
    cart = next(d for d in drift["deltas"] if d["file"] == "shop/cart.py")
    assert cart["added"] == ["Cart.total -> flat [exact]"] and cart["removed"] == ["Cart.total -> rate [exact]"]
    assert "error" in g.callers("main")

    # same time, other size; then another time, same content
    at = os.path.join(tree, "shop/tax.py")
    stamp = os.stat(at)
    put(tree, {"shop/tax.py": "def rate(x):\n    return 1\n"})
    os.utime(at, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert g.index()["reindexed"] == 1 and g.cycles()["cycle_count"] == 0
    os.utime(at, (1, 1))
    assert g.index()["reindexed"] == 0
    assert g.table("files").where("path = 'shop/tax.py'").first()["mtime"] == 1.0

    # workers
    said = g.before_edit(os.path.join(tree, "shop/flat.py"))
    assert "2 caller(s)" in said and "Cart.total (shop/cart.py:8)" in said
    assert g.before_edit(os.path.join(tree, "notes.txt")) is None and "2 symbol(s) and no callers" in g.before_edit(os.path.join(tree, "lone.py"))
    put(tree, {"shop/cart.py": TREE["shop/cart.py"]})
    assert g.after_edit(os.path.join(tree, "shop/cart.py")) == "callweave: calls of shop/cart.py changed: +1 (Cart.total -> rate) -1 (Cart.total -> flat)"
    raw = json.dumps({"tool_input": {"file_path": os.path.join(tree, "shop/tax.py")}})
    assert "caller(s)" in json.loads(worker.edit("pre", os.path.join(tree, "shop"), raw, spark))["hookSpecificOutput"]["additionalContext"]
    assert worker.edit("post", tree, "", spark) is None and worker.main(["pre", "/nonexistent"]) == 0

    # damage
    version = os.path.join(tree, ".callweave", g.snaps.current())
    with open(os.path.join(version, "manifest.json"), "w") as f:
        f.write("{")
    healed = DependencyGraph(spark, tree).index()
    assert healed["healed"] and healed["reindexed"] == 5 and os.path.isdir(version + ".corrupt")

    # another writer
    with g.snaps.lock():
        assert g.index()["locked"]
    # a crash while a version is written leaves the old one
    now = g.snaps.current()
    os.makedirs(os.path.join(tree, ".callweave", "v0-half", "symbols"))
    assert g.snaps.current() == now and g.stats()["files"] == 5


def test_large_and_minified_files_are_left_out(spark, tree, monkeypatch):
    put(tree, {"big.js": "function big() {}\n" + "//" + "x" * 300 + "\n", "min.js": "function min(){}" + "a();" * 60_000})
    monkeypatch.setenv("CALLWEAVE_MAX_FILE_BYTES", "250")
    done = snapshot.index(spark, tree)
    assert done["skipped_large"] == 2 and done["warning_count"] == 2
    monkeypatch.setenv("CALLWEAVE_MAX_FILE_BYTES", "5000000")
    done = snapshot.index(spark, tree)
    assert done["skipped_large"] == 1 and "minified" in done["warnings"][0] and done["reindexed"] == 1
    # a file that grows past the cap loses its facts
    monkeypatch.setenv("CALLWEAVE_MAX_FILE_BYTES", "100")
    snapshot.index(spark, tree)
    assert not DependencyGraph(spark, tree).find("big")["matches"]
    assert snapshot.changed_files(spark, tree).collect() == []


def test_scope(spark, tree):
    g = DependencyGraph(spark, tree)
    assert g.scope()["dry_run"] and g.scope()["suggested_exclude"] == []
    done = g.scope(exclude="web/*")
    assert done["config"] == {"include": [], "exclude": ["web/*"]} and done["reindexed"]["discovered"] == 3
    done = g.scope(include=["shop/*"], exclude=["*/tax.py"])
    assert done["config"]["exclude"] == ["*/tax.py", "web/*"] and done["reindexed"]["discovered"] == 2
    for bad in ('{"include": "shop/*"}', '{"exclude": 3}', "[1]", "{", ""):
        with open(discovery.config_path(tree), "w") as f:
            f.write(bad)
        assert discovery.read_scope(tree) == {"include": [], "exclude": []}
    assert discovery.discover(spark, tree).count() == 4


def test_discovery(spark, tmp_path):
    root = str(tmp_path / "repo")
    put(root, {"a.py": "", "é ü.py": "", "skip.py": "", "node_modules/x.js": "", ".hidden/y.py": "", "backup/z.py": "", "src/old.bak": "", "my-backup/q.py": "", "B.PY": "", "backup_tool.py": "", ".gitignore": "skip.py\n"})
    names = lambda: {r["path"] for r in discovery.discover(spark, root).collect()}
    assert names() == {"a.py", "é ü.py", "skip.py", "B.PY", "backup_tool.py"}
    if subprocess.run(["git", "init", "-q", root], capture_output=True).returncode == 0:
        inner = os.path.join(root, "inner")
        put(root, {"inner/w.py": ""})
        subprocess.run(["git", "init", "-q", inner], capture_output=True)
        assert names() == {"a.py", "é ü.py", "B.PY", "backup_tool.py", "node_modules/x.js", ".hidden/y.py", "inner/w.py"}


def test_vendor_directories_are_suggested(spark, tmp_path):
    root = str(tmp_path)
    put(root, {"wp-config.php": "", "wp-admin/x.php": "", "wp-content/plugins/Akismet/a.php": "", "wp-content/plugins/own/b.php": "", "wp-content/themes/astra/c.php": ""})
    found = lambda: discovery.suggest_scope(discovery.listing(spark, root))
    assert found() == ["wp-admin/*", "*/wp-admin/*", "wp-content/plugins/Akismet/*", "wp-content/themes/astra/*"]
    assert discovery.suggest_scope(spark.createDataFrame([("a/wp-admin/x.php",), ("plugins/akismet/a.php",)], "path string")) == []
    assert discovery.suggest_scope(spark.createDataFrame([], "path string")) == []


def test_roots(tmp_path):
    home = tmp_path / "home"
    inside = home / "work" / "deep"
    inside.mkdir(parents=True)
    for bad in (str(home), str(tmp_path), "/", str(tmp_path / "none")):
        with pytest.raises(discovery.RootError):
            discovery.guard_root(bad, str(home))
    (tmp_path / "alias").symlink_to(home)
    with pytest.raises(discovery.RootError):
        discovery.guard_root(str(tmp_path / "alias"), str(home))
    assert discovery.guard_root(str(inside), str(home)) == os.path.realpath(inside)
    for d in (home, home / "work"):
        (d / ".callweave").mkdir()
        (d / ".callweave" / "CURRENT").write_text("v1")
    assert discovery.governing_root(str(inside), str(home)) == os.path.realpath(home / "work")
    (home / "work" / ".callweave" / "CURRENT").unlink()
    assert discovery.governing_root(str(inside), str(home)) is None


def test_globs():
    import re

    fits = lambda p, s: re.match(glob_regex(p).replace(r"\z", r"\Z"), s) is not None
    assert fits("a/*", "a/b/c.py") and not fits("a/*", "A/b") and fits("?.py", "x.py") and fits("[!a]b", "cb") and not fits("[!a]b", "ab") and fits("a[.]b", "a.b") and not fits("a.b", "axb")


def test_watching_a_tree(spark, tree, tmp_path):
    snapshot.index(spark, tree)
    seen = []
    query = watcher.start(spark, tree, f"file://{tmp_path}/watch", 0.5, lambda n, done: seen.append(done))
    try:
        time.sleep(2)
        put(tree, {"shop/tax.py": "def rate(x):\n    return other(x)\n\n\ndef other(x):\n    return x\n"})
        end = time.time() + 90
        while not seen and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen and seen[0].get("reindexed") == 1
    assert DependencyGraph(spark, tree).find("other")["matches"]


def test_a_table_of_an_older_schema(spark, tree):
    """A version written before a column existed reads with nulls there, and the next index carries it over."""
    snapshot.index(spark, tree)
    snaps = snapshot.Snapshots(spark, tree)
    at = os.path.join(tree, ".callweave", snaps.current())
    names = {r["name"] for r in snaps.table("symbols").collect()}
    snaps.table("symbols").drop("signature", "end_byte").coalesce(1).write.parquet(f"file://{at}/older")
    shutil.rmtree(os.path.join(at, "symbols"))
    os.rename(os.path.join(at, "older"), os.path.join(at, "symbols"))
    old = snaps.table("symbols").collect()
    assert {r["name"] for r in old} == names and all(r["signature"] is None and r["end_byte"] is None for r in old)
    put(tree, {"shop/later.py": "def later():\n    return 1\n"})
    done = snapshot.index(spark, tree)
    assert done["reindexed"] == 1 and "healed" not in done
    now = {r["name"]: r["signature"] for r in snaps.table("symbols").collect()}
    assert names | {"later"} == set(now) and now["later"] == "def later():"


def test_a_damaged_table_is_found_by_its_footer(spark, tree):
    snapshot.index(spark, tree)
    snaps = snapshot.Snapshots(spark, tree)
    at = os.path.join(tree, ".callweave", snaps.current(), "refs")
    for name in os.listdir(at):
        if name.endswith(".parquet"):
            with open(os.path.join(at, name), "r+b") as f:
                f.truncate(10)
    with pytest.raises(snapshot.Corrupt):
        snaps.check()
    assert snapshot.index(spark, tree)["healed"]


def test_a_change_before_the_watcher_starts(spark, tree, tmp_path):
    snapshot.index(spark, tree)
    put(tree, {"shop/early.py": "def early():\n    return 1\n"})
    os.remove(os.path.join(tree, "shop", "tax.py"))
    reader = watcher._Reader(tree, str(tmp_path / "state"))
    first = reader.initialOffset()
    rows, end = reader.read(first)
    assert [(r[0], r[3]) for r in rows] == [("shop/early.py", "new"), ("shop/tax.py", "deleted")]
    assert [(r[0], r[3]) for r in reader.readBetweenOffsets(first, end)] == [("shop/early.py", "new"), ("shop/tax.py", "deleted")]
    reader.commit(end)
    assert os.listdir(tmp_path / "state") == [end["listing"]]
    again, same = reader.read(end)
    assert not list(again) and same == end
    seen = []
    query = watcher.start(spark, tree, f"file://{tmp_path}/watch2", 0.5, lambda n, done: seen.append(done))
    try:
        stop = time.time() + 90
        while not seen and time.time() < stop:
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen and seen[0].get("reindexed") == 1 and seen[0].get("removed") == 1


def test_moves_and_claims(tree):
    a = {"x": (1.0, 1), "y": (1.0, 1)}
    assert watcher.moved(a, {"x": (1.0, 2), "z": (3.0, 1)}) == [("x", 1.0, 2, "modified"), ("z", 3.0, 1, "new"), ("y", 1.0, 1, "deleted")]
    assert watcher.claim(tree)
    with open(os.path.join(tree, ".callweave", "WATCHER"), "w") as f:
        f.write("999999")
    assert watcher.claim(tree)


def test_parsers_in_sql(spark):
    from callweave.functions.udtf import register

    register(spark)
    spark.createDataFrame([("def f():\n    return g.h(1)\n", "python"), (None, "go")], "content string, lang string").createOrReplaceTempView("sources")
    assert [tuple(r) for r in spark.sql("SELECT s.name, s.kind FROM sources, LATERAL parse_symbols(content, lang) s").collect()] == [("f", "function")]
    assert [tuple(r) for r in spark.sql("SELECT c.callee, c.receiver FROM sources, LATERAL parse_calls(content, lang) c").collect()] == [("h", "g")]
