"""Counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def site_counts(edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row: call sites by resolution, hook edges, unresolved calls, and edge rows."""
    tier = lambda t: F.count_distinct(F.when(F.col("resolution") == t, F.col("ref_id"))).alias(f"edges_{t}")
    e = edges.agg(tier("exact"), tier("inferred"), tier("ambiguous"), F.count(F.when(F.col("resolution") == "hook", 1)).alias("edges_hook"), F.count("*").alias("edge_rows"))
    return e.crossJoin(unresolved.agg(F.count("*").alias("unresolved")))  # one row each


def counted_sites(sites: DataFrame) -> DataFrame:
    """The row of site_counts from call sites (ref_id, resolution, n) with the number n of their edges; none are hooks."""
    tiers = ("exact", "inferred", "ambiguous")
    one = sites.groupBy("ref_id").agg(*[F.max(F.col("resolution") == t).alias(t) for t in tiers], F.sum("n").alias("n"), F.count(F.when(F.col("resolution") == "unresolved", 1)).alias("lost"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    counts = [F.count(F.when(F.col(t) & F.col("ref_id").isNotNull(), 1)).alias(f"edges_{t}") for t in tiers]
    return one.agg(*counts, F.lit(0).cast("long").alias("edges_hook"), total("n").alias("edge_rows"), total("lost").alias("unresolved"))


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """(lang, kind, n) with one of lang and kind null: counts by dialect and by kind in one scan, largest first."""
    s = symbols.groupingSets([[F.col("lang")], [F.col("kind")]], F.col("lang"), F.col("kind")).agg(F.count("*").alias("n"))
    return s.orderBy(F.desc("n"), F.coalesce("lang", "kind"))


def hook_counts(hooks: DataFrame) -> DataFrame:
    one = lambda c: F.count(F.when(c, 1))
    return hooks.agg(one(F.col("kind") == "listen").alias("hook_registrations"), one(F.col("entry_point")).alias("entry_points"), one(F.col("unauth")).alias("unauth_entry_points"))
