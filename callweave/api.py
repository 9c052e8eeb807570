"""The tools: one method each, returning plain dictionaries; the DataFrames behind them are in callweave.operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave import snapshot as S
from callweave.functions import languages as L
from callweave.operators import aggregates, centrality, changes, components, lookups, traverse
from callweave.operators.storage import stored
from callweave.sources import discovery as D


class DependencyGraph:
    """The call graph of one source tree."""

    def __init__(self, spark: SparkSession, root: str = "."):
        self.spark = spark
        self.root = D.governing_root(root) or D.guard_root(root)
        self.snaps = S.Snapshots(spark, self.root)

    def _ensure(self) -> None:
        """Builds the index on first use, and anew where it is damaged."""
        try:
            ready = self.snaps.current() is not None and bool(self.snaps.manifest())
        except S.Corrupt:
            ready = False
        if not ready:
            S.index(self.spark, self.root)

    def table(self, name: str) -> DataFrame:
        self._ensure()
        return self.snaps.table(name)

    # --- building ---
    def index(self, force: bool = False) -> dict:
        return S.index_safe(self.spark, self.root, force)

    def scope(self, include: list[str] | str | None = None, exclude: list[str] | str | None = None) -> dict:
        if include is None and exclude is None:
            globs = D.suggest_scope(D.listing(self.spark, self.root))
            now = D.read_scope(self.root) if os.path.exists(D.config_path(self.root)) else {}
            return {"dry_run": True, "current_config": now, "suggested_exclude": globs, "reason": "core and known vendor directories" if globs else "no vendor directories found"}
        config = D.write_scope(self.root, include, exclude)
        done = self.index(force=True)
        keep = ("discovered", "edges_exact", "edges_inferred", "edges_ambiguous", "edge_rows", "unresolved")
        return {"config": config, "config_path": D.config_path(self.root), "reindexed": {k: done.get(k) for k in keep}}

    # --- overview ---
    def stats(self) -> dict:
        symbols, hooks = self.table("symbols"), self.table("hooks")
        out = {"files": self.table("files").count(), "symbols": symbols.count()}
        out |= aggregates.site_counts(self.table("edges"), self.table("unresolved")).first().asDict()
        out |= aggregates.hook_counts(hooks).first().asDict()
        out["unresolved_calls"] = out["unresolved"]
        counts = aggregates.symbol_counts(symbols).collect()
        out["by_language"] = {r["lang"]: r["n"] for r in counts if r["lang"] is not None}
        out["by_kind"] = {r["kind"]: r["n"] for r in counts if r["kind"] is not None}
        if not out["edges_hook"] and out["hook_registrations"]:
            out["edges_hook_note"] = f"{out['hook_registrations']} registrations are captured, but nothing in the tree fires them; frameworks do. See hooks(entry_points=True)."
        return out

    def find(self, name: str, lang: str | None = None, kind: str | None = None) -> dict:
        rows = lookups.find(self.table("symbols"), name, lang, kind).collect()
        return {"matches": [self._ref(r) | {"signature": r["signature"]} for r in rows]}

    @staticmethod
    def _label(r) -> str:
        return f"{r['container']}.{r['name']}" if r["container"] else r["name"]

    def _ref(self, r) -> dict:
        return {"symbol": self._label(r), "kind": r["kind"], "file": r["file"], "line": r["start_line"], "lang": r["lang"]}

    def _definitions(self, name: str, lang: str | None = None) -> list:
        return lookups.qualified(self.table("symbols"), name, lang).collect()

    def _seeds(self, rows: list) -> DataFrame:
        return self.spark.createDataFrame([(r["id"],) for r in rows], "id long")

    # --- reachability ---
    def callers(self, symbol: str, depth: object = 3, lang: str | None = None) -> dict:
        return self._reach(symbol, depth, lang, "callers")

    def callees(self, symbol: str, depth: object = 3, lang: str | None = None) -> dict:
        return self._reach(symbol, depth, lang, "callees")

    def _reach(self, symbol: str, depth: object, lang: str | None, direction: str) -> dict:
        depth = traverse.clamp(depth, 1, L.MAX_DEPTH, 3)
        roots = self._definitions(symbol, lang)
        if not roots:
            return {"error": f"no definition named '{symbol}'", "hint": "try find()"}
        found = traverse.callers(self.table("edges"), self.table("symbols"), self._seeds(roots), depth, direction)
        nodes: dict[int, list[dict]] = {r["id"]: [] for r in roots}
        for r in found.orderBy("seed", "depth", "file", "line", "id").collect():
            nodes[r["seed"]].append({k: r[k] for k in ("symbol", "kind", "file", "line", "lang", "depth")})
        head = {"symbol": symbol, "matched_definitions": [self._ref(r) for r in roots], "direction": direction, "max_depth": depth}
        if len(roots) == 1:
            own = nodes[roots[0]["id"]]
            return head | {"count": len(own), "nodes": own}
        bare = symbol.rpartition(".")[2] or symbol
        note = f"'{symbol}' has {len(roots)} definitions; each has a group of its own. Ask for '<Container>.{bare}' to get one."
        return head | {"ambiguous": True, "note": note, "groups": [{"definition": self._ref(r), "count": len(nodes[r["id"]]), "nodes": nodes[r["id"]]} for r in roots]}

    def neighbors(self, symbol: str, lang: str | None = None) -> dict:
        rows = self._definitions(symbol, lang)
        if not rows:
            return {"error": f"no definition named '{symbol}'", "hint": "try find()"}
        near = lookups.neighbours(self.table("edges"), self.table("symbols"), self._seeds(rows)).orderBy("file", "line", "at_line", "id").collect()
        show = lambda seed, way: [{k: n[k] for k in ("symbol", "kind", "file", "line", "lang", "at_line", "resolution")} for n in near if n["seed"] == seed and n["direction"] == way]
        return {"symbol": symbol, "definitions": [{"definition": self._ref(r), "called_by": show(r["id"], "in"), "calls": show(r["id"], "out")} for r in rows]}

    def blast_radius(self, target: str, depth: object = 6) -> dict:
        target = target.strip()
        while target.startswith("./"):
            target = target[2:]
        if not target:
            return {"error": "target required: a symbol or a file"}
        seeds = [] if os.sep in target else self._definitions(target)
        is_file = not seeds and (os.sep in target or os.path.splitext(target)[1].lower() in L.EXTENSIONS)
        if is_file:
            inside = os.path.relpath(target, self.root) if os.path.isabs(target) else target
            seeds = lookups.by_file(self.table("symbols"), inside).orderBy("file", "start_byte").collect()
        if not seeds:
            return {"error": f"no symbol or file matching '{target}'"}
        found = traverse.blast_radius(self.table("edges"), self.table("symbols"), self._seeds(seeds), depth).collect()
        by_file = {r["file"]: [{"symbol": x["symbol"], "line": x["line"], "depth": x["depth"]} for x in r["impacted"]] for r in found}
        out = {"target": target, "seed_symbols": [self._ref(s) for s in seeds], "impacted_symbol_count": sum(map(len, by_file.values())), "impacted_file_count": len(by_file), "by_file": by_file}
        files = sorted({s["file"] for s in seeds})
        if not is_file and len(seeds) > 1:
            out |= {"ambiguous_seed": True, "note": f"'{target}' has {len(seeds)} definitions; this is their union. Name the container to get one."}
        elif is_file and len(files) > 1:
            out |= {"ambiguous_seed": True, "note": f"'{target}' is {len(files)} files; this is their union. Give more of the path: {'; '.join(files[:8])}"}
        context = self._hook_context(seeds)
        return out | ({"hook_context": context} if context else {})

    def _hook_context(self, seeds: list) -> list[str]:
        names = {s["id"]: self._label(s) for s in seeds}
        own = self.table("hooks").join(self._seeds(seeds).withColumnRenamed("id", "callback_symbol"), "callback_symbol")
        out = []
        for h in own.orderBy("file", "line", "id").collect():
            tag = "UNAUTH ENTRY" if h["unauth"] else "ENTRY" if h["entry_point"] else h["hook_class"]
            out.append(f"{names[h['callback_symbol']]} fires on '{h['hook']}' [{tag}]" + (f" - {h['note']}" if h["note"] else ""))
        return out

    def path(self, src: str, dst: str) -> dict:
        a, b = self._definitions(src), self._definitions(dst)
        if not a or not b:
            return {"error": "src or dst not found", "src_found": bool(a), "dst_found": bool(b)}
        best = traverse.shortest_path(self.table("edges"), self._seeds(a), self._seeds(b))
        if best is None:
            return {"hops": None, "path": [], "note": "no path"}
        rows = {r["id"]: r for r in self.table("symbols").join(self._seeds([{"id": i} for i in best]), "id", "left_semi").collect()}
        return {"hops": len(best) - 1, "path": [self._label(rows[i]) for i in best], "detail": [self._ref(rows[i]) for i in best], "src_candidates": len(a), "dst_candidates": len(b)}

    # --- structure ---
    def cycles(self, min_size: int = 2, exclude: tuple[str, ...] = ("inferred", "hook")) -> dict:
        found = components.cycles(self.table("edges"), min_size, exclude).withColumn("n", F.monotonically_increasing_id())
        members = found.select("n", "size", F.explode("members").alias("id")).join(lookups.labelled(self.table("symbols")), "id")
        groups: dict[int, dict] = {}
        for r in members.orderBy(F.desc("size"), "n", "file", "line", "id").collect():
            g = groups.setdefault(r["n"], {"size": r["size"], "members": []})
            g["members"].append({"symbol": r["symbol"], "file": r["file"], "line": r["line"]})
        return {"cycle_count": len(groups), "cycles": list(groups.values())}

    def hotspots(self, top: object = 20, betweenness_nodes: int = L.BETWEENNESS_NODES) -> dict:
        edges, symbols = self.table("edges"), self.table("symbols")
        drop = lambda rows: [{k: v for k, v in r.asDict().items() if k != "id"} for r in rows]
        out: dict = {"most_depended_upon": drop(centrality.hotspots(edges, symbols, top).collect())}
        try:
            scores = centrality.betweenness(edges, betweenness_nodes)
        except centrality.TooLarge:
            scores = None
        out["betweenness_computed"] = scores is not None and not scores.isEmpty()
        if out["betweenness_computed"]:
            out["most_central"] = drop(centrality.hotspots(edges, symbols, top, scores).collect())
        files = sorted({r["file"] for r in out["most_depended_upon"] if r["suspected_shadow"]})
        if files:
            out["suspected_shadow_note"] = f"{len(files)} file(s) define symbols that much of the tree calls; likely copies of library functions. Exclude them with scope(): {files}"
        return out

    # --- drift ---
    def pending(self) -> dict:
        self._ensure()
        states = {r["path"]: r["state"] for r in S.changed_files(self.spark, self.root).collect()}
        if not states:
            return {"root": self.root, "changed_files": 0, "deltas": []}
        before = lookups.edge_labels(self.table("edges"), self.table("symbols"))
        before = stored(before, "before")  # the index below replaces what it reads
        done = self.index()
        if done.get("locked"):
            return {"root": self.root, "changed_files": len(states), "deltas": [], **done}
        after = lookups.edge_labels(self.table("edges"), self.table("symbols"))
        diff = {r["file"]: r for r in changes.edge_difference(before, after).collect()}
        deltas = []
        for f in sorted({*diff, *states}):
            state = states.get(f, "reresolved")
            if f in diff or state in ("new", "deleted"):
                deltas.append({"file": f, "state": state, "added": list(diff[f]["added"]) if f in diff else [], "removed": list(diff[f]["removed"]) if f in diff else []})
        return {"root": self.root, "changed_files": len(deltas), "content_changes": len(states), "deltas": deltas}

    # --- hooks ---
    def hooks(self, name: str = "", entry_points: bool = False) -> dict:
        hooks, symbols = self.table("hooks"), self.table("symbols")
        if entry_points or not name:
            rows = lookups.entry_points(hooks, symbols).collect()
            return {"entry_points": [{"auth": "UNAUTH" if r["unauth"] else "auth", "type": r["hook_class"], "hook": r["hook"], "callback": r["callback"], "where": f"{r['cb_file']}:{r['cb_line']}" if r["cb_file"] else None, "note": r["note"] or None} for r in rows], "count": len(rows)}
        heard, fired = lookups.listeners(hooks, symbols, name).collect(), lookups.fires(hooks, name).collect()
        if heard or fired:
            return {"hook": name, "listeners": [{"callback": r["callback"], "type": r["hook_class"], "resolved": r["callback_symbol"] is not None, "at": f"{r['file']}:{r['line']}"} for r in heard], "fired_at": [f"{r['file']}:{r['line']}" for r in fired]}
        rows = []
        for s in self._definitions(name):
            rows += [{"symbol": self._label(s), "fires_on": h["hook"], "type": h["hook_class"], "entry_point": h["entry_point"], "unauth": h["unauth"], "note": h["note"] or None} for h in lookups.hooks_of_symbol(hooks, s["id"]).orderBy("file", "line", "id").collect()]
        if rows:
            return {"symbol": name, "registered_on": rows}
        return {"error": f"no hook, route or registered callback matching '{name}'", "hint": "hooks(entry_points=True) lists the entry points; stats() counts registrations"}

    # --- edits ---
    def before_edit(self, path: str) -> str | None:
        """What depends on a file that is about to change; None for a file without symbols."""
        rel = os.path.relpath(os.path.realpath(path), self.root)
        symbols = self.table("symbols")
        seeds = symbols.where(F.col("file") == rel).select("id").collect()
        if not seeds:
            return None
        found = traverse.callers(self.table("edges"), symbols, self._seeds(seeds), 3)
        rows = found.groupBy("id", "symbol", "file", "line").agg(F.min("depth").alias("depth")).orderBy("depth", "file", "line", "id").collect()
        if not rows:
            return f"callweave: {rel} has {len(seeds)} symbol(s) and no callers in this tree."
        lines = [f"{r['symbol']} ({r['file']}:{r['line']})" for r in rows[:12]]
        more = f"\n  …and {len(rows) - 12} more" if len(rows) > 12 else ""
        return f"callweave: {rel} has {len(rows)} caller(s) in {len({r['file'] for r in rows})} file(s). Check them before its behaviour changes:\n  - " + "\n  - ".join(lines) + more

    def after_edit(self, path: str) -> str | None:
        """Re-indexes and tells which resolved calls of a file came and went; None if none did."""
        rel = os.path.relpath(os.path.realpath(path), self.root)
        cut = lambda: {(r["src_label"], r["dst_label"]) for r in lookups.edge_labels(self.table("edges").where(F.col("file") == rel), self.table("symbols")).select("src_label", "dst_label").distinct().collect()}
        before = cut()
        S.index(self.spark, self.root)
        after = cut()
        parts = []
        for sign, got in (("+", after - before), ("-", before - after)):
            if got:
                parts.append(f"{sign}{len(got)} (" + "; ".join(f"{a} -> {b}" for a, b in sorted(got)[:5]) + ")")
        return f"callweave: calls of {rel} changed: " + " ".join(parts) if parts else None
