"""Strongly connected components and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.lookups import known_edges
from callweave.operators.storage import dropped, stored
from callweave.operators.traverse import LOCAL_EDGES, local_graph


def strong_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for every node of the edges (src, dst); component is the smallest id of the node's component."""
    spark = edges.sparkSession
    e = edges.where("src is not null").select("src", "dst").distinct()
    graph = local_graph(e, local_edges)
    if graph is not None:
        label = graph.components()
        return spark.createDataFrame([(int(i), int(c)) for i, c in zip(graph.ids, label)], "id long, component long")
    return _coloured(e)


def _coloured(e: DataFrame) -> DataFrame:
    """Forward colouring: the least id that reaches a node is its colour; what the id reaches backwards within its colour is its component."""
    spark = e.sparkSession
    nodes = stored(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct(), "nodes")
    e = stored(e.where("src <> dst"), "edges")
    done = None
    while True:
        colour = stored(nodes.withColumn("c", F.col("id")), "colour")
        while True:
            low = e.join(colour, e.src == colour.id).groupBy("dst").agg(F.min("c").alias("m"))
            new = colour.join(low, colour.id == low.dst, "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"))
            # what reaches a node's colour reaches the node: the colour of the colour is a short cut
            jump = colour.select(F.col("id").alias("c"), F.col("c").alias("j"))
            new = stored(new.join(jump, "c").select("id", F.least("c", "j").alias("c")), "colour")
            moved = not new.join(colour.withColumnRenamed("c", "old"), "id").where("c <> old").isEmpty()
            dropped(spark, colour)
            colour = new
            if not moved:
                break
        # backwards from each colour's root, inside the colour
        cs, cd = colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inner = stored(e.join(cs, "src").join(cd, "dst").where("cs = cd").select("src", "dst", "cs"), "inner")
        found = front = first = stored(colour.where("id = c"), "found")
        while True:
            new = inner.join(front, inner.dst == front.id).select(F.col("src").alias("id"), F.col("cs").alias("c")).distinct().join(found, "id", "left_anti")
            front = stored(new, "front")
            if front.isEmpty():
                break
            old, found = found, stored(found.unionByName(front), "found")
            if old is not first:
                dropped(spark, old)
        part = found.select("id", F.col("c").alias("component"))
        done = part if done is None else stored(done.unionByName(part), "done")
        nodes = stored(nodes.join(found, "id", "left_anti"), "nodes")
        if nodes.isEmpty():
            return done
        gone = found.select("id")
        e = stored(e.join(gone, e.src == gone.id, "left_anti").join(gone, e.dst == gone.id, "left_anti"), "edges")


def cycles(edges: DataFrame, min_size: int = 2, exclude: tuple[str, ...] = ("inferred", "hook"), **options) -> DataFrame:
    """(size, members): components of at least `min_size`, and one of size 1 for each self-call; largest first.

    Inferred and hook edges are left out by default; ambiguous ones count.  A node that calls itself and is in a
    larger component is in both.
    """
    e = stored(known_edges(edges, exclude).distinct(), "cycle-edges")
    big = strong_components(e, **options).groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members"))
    big = big.where(F.size("members") >= min_size).select("members")
    own = e.where("src = dst").select(F.array("src").alias("members"))
    return big.union(own).select(F.size("members").alias("size"), "members").orderBy(F.desc("size"), F.col("members")[0])
