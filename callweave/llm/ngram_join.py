"""N-gram Jaccard self-join with Bayesian candidate pruning.

Plan
----
1. One pass over the texts makes each document's shingle set, a signature of the set and a sketch of 128 MinHash
   values (16 bits each).  Documents with equal sets become one node, named by the smallest id.
2. 32 bands of 4 values give the candidate buckets: a pair at Jaccard 0.8 shares none with probability 5e-8.
3. Inside a bucket pairs are compared 16 values at a time.  After each step a pair goes when the posterior
   probability (uniform prior) that its similarity reaches the threshold is below `tolerance`.  A block of members
   returns only a spanning star of what survives, never the pairs, so a group of n near copies makes O(n) rows.
4. The components of these stars bound the search: all links lie inside them.  Every pair inside a component is
   pruned as in 3 and the rest verified exactly on the shingle sets; each block returns link counts and a star.
5. The components of the verified stars are the classes.

A bucket or component larger than a block is dealt into blocks, and each pair of blocks is a task's group of its own,
so no task holds more than two blocks and none is skipped.  The comparisons inside one group of near copies remain
quadratic in the number of its *different* sets, since their links are counted exactly; rows moved grow as n^2/256.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import common
from callweave.llm.shingles import minhashes, mix, shingle_set

HASHES, ROWS, STEP = 128, 4, 16
BLOCK = 256
#: Shingles in one block of the verification, so that a pair of blocks stays near 16 MB.
BLOCK_SHINGLES = 1_000_000


def min_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """For each step the least number of equal values at which a pair is still worth comparing.

    With a uniform prior and m of n values equal, the similarity is Beta(m+1, n-m+1); its tail above t is the
    binomial sum over j <= m of C(n+1, j) t^j (1-t)^(n+1-j).
    """
    need = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        need.append(m)
    return need


def surviving_pairs(sketch: np.ndarray, sizes: np.ndarray, blk: np.ndarray, same: bool, threshold: float, need: list[int]):
    """Index pairs that pass the size bound and the incremental comparison."""
    order = np.argsort(blk, kind="stable")
    if same:
        left = right = order
    else:
        cut = np.searchsorted(blk[order], blk[order[-1]]) if len(order) else 0
        left, right = order[:cut], order[cut:]
    if not len(left) or not len(right):
        return np.empty(0, int), np.empty(0, int)
    a, b = sizes[left][:, None], sizes[right][None, :]
    ok = np.minimum(a, b) >= threshold * np.maximum(a, b)
    if same:
        ok &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    i, j = np.nonzero(ok)
    i, j = left[i], right[j]
    hits = np.zeros(len(i), dtype=np.int32)
    for k, least in enumerate(need):
        part = slice(k * STEP, (k + 1) * STEP)
        hits += (sketch[i, part] == sketch[j, part]).sum(1, dtype=np.int32)
        keep = hits >= least
        i, j, hits = i[keep], j[keep], hits[keep]
        if not len(i):
            break
    return i, j


def star(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the given pairs."""
    flat = np.concatenate(sets)
    code = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    at = np.cumsum([0] + [len(s) for s in sets])
    mark = np.zeros(int(code.max()) + 1, dtype=bool)
    order = np.argsort(i, kind="stable")
    out = np.empty(len(i), dtype=np.int64)
    cuts = np.flatnonzero(np.r_[True, i[order][1:] != i[order][:-1]])
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
        own = code[at[i[order[lo]]] : at[i[order[lo]] + 1]]
        mark[own] = True
        for p in order[lo:hi]:
            out[p] = np.count_nonzero(mark[code[at[j[p]] : at[j[p] + 1]]])
        mark[own] = False
    return out


def _sketches(width: int, hashes: int):
    def run(batches):
        for batch in common.trimmed(batches):
            for lo, texts in common.some_texts(batch.column(1)):
                yield _sketched(batch.column(0).slice(lo, len(texts)), [shingle_set(t, width) for t in texts], hashes)

    return run


def _sketched(ids: pa.Array, sets: list[np.ndarray], hashes: int) -> pa.RecordBatch:
    full = [k for k, s in enumerate(sets) if len(s)]
    sk: list[bytes | None] = [None] * len(sets)
    s1: list[int | None] = [None] * len(sets)
    s2: list[int | None] = [None] * len(sets)
    if full:
        low = (minhashes([sets[k] for k in full], hashes) & np.uint64(0xFFFF)).astype(np.uint16)
        for row, k in zip(low, full):
            sk[k] = row.tobytes()
            s1[k] = int(sets[k].sum(dtype=np.uint64).astype(np.int64))
            s2[k] = int(mix(sets[k] ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sk, pa.binary())], names=["id", "s1", "s2", "n", "sketch"])


def _bands(hashes: int, rows: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            m = common.fixed_binary(batch.column(1), np.uint16, hashes).reshape(len(ids), hashes // rows, rows).astype(np.uint64)
            key = np.broadcast_to(np.arange(hashes // rows, dtype=np.uint64) + np.uint64(1), m.shape[:2]).copy()
            for k in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, hashes // rows))], names=["key", "id"])

    return run


def _candidates(threshold: float, need: list[int], hashes: int):
    def run(batches):
        for table, cuts in common.runs(batches, ["key", "bi", "bj"]):
            ids, n, blk = (table.column(c).to_numpy() for c in ("id", "n", "blk"))
            bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
            sketch = common.fixed_binary(table.column("sketch"), np.uint16, hashes)
            a, b = [], []
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo < 2:
                    continue
                i, j = surviving_pairs(sketch[lo:hi], n[lo:hi], blk[lo:hi], bi[lo] == bj[lo], threshold, need)
                if len(i):
                    root = star(hi - lo, i, j)
                    own = np.flatnonzero(root != np.arange(hi - lo))
                    a.append(ids[lo + own])
                    b.append(ids[lo + root[own]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _with_sets(width: int):
    def run(batches):
        for batch in common.trimmed(batches):
            at = batch.schema.get_field_index("text")
            names = ["shingles" if k == at else f.name for k, f in enumerate(batch.schema)]
            for lo, texts in common.some_texts(batch.column(at)):
                sets = pa.array([shingle_set(t, width).tobytes() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([sets if k == at else batch.column(k).slice(lo, len(texts)) for k in range(batch.num_columns)], names=names)

    return run


def _verified(threshold: float, need: list[int], hashes: int):
    def run(batches):
        for table, cuts in common.runs(batches, ["class", "bi", "bj"]):
            ids, n, blk = (table.column(c).to_numpy() for c in ("id", "n", "blk"))
            bi, bj = table.column("bi").to_numpy(), table.column("bj").to_numpy()
            sketch = common.fixed_binary(table.column("sketch"), np.uint16, hashes)
            raw = table.column("shingles").to_pylist()
            a, b, links = [], [], []
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo < 2:
                    continue
                i, j = surviving_pairs(sketch[lo:hi], n[lo:hi], blk[lo:hi], bi[lo] == bj[lo], threshold, need)
                if not len(i):
                    continue
                both = overlaps([np.frombuffer(x, dtype=np.uint64) for x in raw[lo:hi]], i, j)
                # in whole numbers: both / union >= threshold, without rounding at the edge
                ok = both >= threshold * (n[lo + i].astype(np.int64) + n[lo + j] - both) - 1e-9
                i, j = i[ok], j[ok]
                if len(i):
                    count = np.bincount(np.r_[i, j], minlength=hi - lo)
                    root = star(hi - lo, i, j)
                    own = np.flatnonzero(count)
                    a.append(ids[lo + own])
                    b.append(ids[lo + root[own]])
                    links.append(count[own])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(links).astype(np.int64))], names=["a", "b", "links"])

    return run


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, width: int = 5, tolerance: float = 1e-7) -> DataFrame:
    """One row per input row: doc_id, class_id, set_id, n_links, copies.

    Two documents link when the Jaccard similarity of their sets of `width`-word shingles (A-Z lower-cased) is at
    least `threshold`; classes are the connected components of the links.  set_id is the smallest id with the same
    set, class_id the smallest id of the class, n_links the number of *other sets* linked, copies the number of rows
    with the same set.

    Null and empty texts, and texts of white space only, have no shingles: a class of their own, no links.  A text
    of fewer than `width` words is one shingle.  A null id gets a row with null class unless a copy has an id.  Rows
    that share an id count as one node.  Other columns of the input are ignored.
    """
    need = min_matches(threshold, tolerance)
    spark = docs.sparkSession
    common.shared_dir(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = common.stored(src.mapInArrow(_sketches(width, HASHES), "id long, s1 long, s2 long, n int, sketch binary"), "sketches")
    sets = base.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("set_id"), F.count("*").alias("copies"))
    # the smallest id of a set carries its sketch; an id that repeats is taken once
    nodes = base.where("n > 0").join(sets.select("s1", "s2", "n", F.col("set_id").alias("id")), ["s1", "s2", "n", "id"], "left_semi").select("id", "n", "sketch").groupBy("id").agg(F.min(F.struct("n", "sketch")).alias("x")).select("id", "x.n", "x.sketch")
    nodes = common.stored(nodes, "nodes")

    bands = common.stored(nodes.select("id", "sketch").mapInArrow(_bands(HASHES, ROWS), "key long, id long"), "bands")
    full = bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").withColumn("many", F.col("m"))
    members = common.salted_join(bands, full, ["key"], "id", bands.count()).join(nodes, "id").select("key", "m", "id", "n", "sketch")
    dealt = common.in_blocks(members, "key", F.ceil(F.col("m") / BLOCK), F.col("id"))
    maybe = common.by_group(dealt, ["key", "bi", "bj"], _candidates(threshold, need, HASHES), "a long, b long")
    groups = common.stored(common.connected_components(maybe), "groups")

    sizes = groups.join(nodes.select("id", "n"), groups.node == nodes.id).groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("words"))
    inside = common.salted_join(groups, sizes.withColumn("many", F.col("m")), ["component"], "node", groups.count()).select(F.col("node").alias("id"), F.col("component").alias("class"), "m", "words")
    texts = src.join(inside, "id").join(nodes, "id").dropDuplicates(["id"]).select("id", "class", "m", "words", "n", "sketch", "text").mapInArrow(_with_sets(width), "id long, class long, m long, words long, n int, sketch binary, shingles binary")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("words") / BLOCK_SHINGLES))
    dealt = common.in_blocks(texts, "class", blocks, F.col("id")).drop("m", "words")
    found = common.stored(common.by_group(dealt, ["class", "bi", "bj"], _verified(threshold, need, HASHES), "a long, b long, links long"), "links")

    classes = common.connected_components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("n_links"))
    per_set = sets.join(classes, sets.set_id == classes.node, "left").join(links, sets.set_id == links.a, "left").select("s1", "s2", "n", "set_id", "copies", F.col("copies").alias("many"), F.coalesce("component", "set_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # rows without a shingle meet nothing; a set of very many copies is dealt over tasks
    full, bare = base.where("n > 0").select("id", "s1", "s2", "n"), base.where("n = 0").select("id")
    found = common.salted_join(full, per_set, ["s1", "s2", "n"], "id", base.count())
    out = found.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("set_id", "id").alias("set_id"), "n_links", "copies")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return out.unionByName(bare.select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.col("id").alias("set_id"), zero.alias("n_links"), one.alias("copies")))
