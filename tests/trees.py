"""Small source trees and what becomes of them."""

from pyspark.sql import functions as F

from callweave.functions.expressions import label, language_of
from callweave.operators.storage import stored
from callweave.parse.extract import facts_from, parse_files
from callweave.plans.hooks import resolve_hooks
from callweave.plans.resolve import call_edges, resolve_refs, unresolved_calls


def facts(spark, tree):
    rows = [(p, s.encode() if isinstance(s, str) else s) for p, s in tree.items()]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("lang", language_of(F.col("path")))
    return facts_from(stored(parse_files(df), "parsed"))


def graph(spark, tree):
    """(edge map {(caller, callee): set of tiers}, {(caller, callee name)} unresolved, facts, hooks with callbacks)."""
    f = facts(spark, tree)
    r = stored(resolve_refs(f), "resolved")
    hooks, calls = f.hooks, call_edges(r)
    if not hooks.isEmpty():
        hooks, hook_edges = resolve_hooks(f)
        calls = calls.unionByName(hook_edges)
    edges = stored(calls, "edges")
    lost = stored(unresolved_calls(r), "lost")
    check_partition(f, edges, lost)
    s = f.symbols.select("id", label(F.col("container"), F.col("name")).alias("label"), F.col("file").alias("in_file"))
    named = edges.join(s.select(F.col("id").alias("dst"), F.col("label").alias("b"), F.col("in_file")), "dst").join(s.select(F.col("id").alias("src"), F.col("label").alias("a")), "src", "left")
    out = {}
    for x in named.collect():
        out.setdefault((x["a"] or "<module>", x["b"]), set()).add(x["resolution"])
    gone = {(x["a"] or "<module>", x["callee"]) for x in lost.join(s.select(F.col("id").alias("src_symbol"), F.col("label").alias("a")), "src_symbol", "left").collect()}
    return out, gone, f, hooks


def check_partition(f, edges, lost):
    """Every ref is resolved or not; exact and inferred ones have one edge, ambiguous ones several."""
    refs = {r["id"] for r in f.refs.collect()}
    per = {}
    for e in edges.where("ref_id is not null").collect():
        per.setdefault(e["ref_id"], []).append(e["resolution"])
    missed = [r["ref_id"] for r in lost.collect()]
    assert len(missed) == len(set(missed))
    assert refs == set(per) | set(missed) and not set(per) & set(missed)
    for tiers in per.values():
        assert len(set(tiers)) == 1
        assert (len(tiers) == 1) == (tiers[0] in ("exact", "inferred"))

