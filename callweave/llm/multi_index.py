"""Approximate nearest neighbours by cosine through an inverted multi-index.

Unit vectors are cut into two halves, and each half is quantised by its own k-means codebook, fitted to a bounded
sample; a pair of centroids is a cell, and every row is indexed under its cell.  A query visits cells by rising sum
of its two distances, taken from a heap, until the cells hold `share` of all rows, and the entries are reranked by
the exact cosine in double precision.

`share` is measured, not guessed: queries from the sample are answered by brute force within the sample, and the
smallest share whose recall reaches `recall` is taken.  The sample is thinner than the table, so neighbours in the
table are nearer and its recall is higher.  Without structure in the vectors (high-dimensional noise) this share is
large, and says so.

Cells in order, some thousand rows together, make parts, and queries with near cells make blocks of as many; a cell
with more rows than a part is dealt over several.  A part meets only the blocks that visit a cell of it, and a query is
sent only to the parts it visits, with the distance at which its traversal stopped in place of the list of its cells.
So a tile of one part and one block is bounded, moves its rows and queries once, and returns five rows per query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import common

SAMPLE, PROBES = 16_384, 128
SHARES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Rows of a part and queries of a block: TILES-th of the table, between these bounds.
TILE, TILES = (1_024, 16_384), 64
#: Centroids of a half, at most; with the square root of the rows in between.
CENTROIDS = 256
#: Slack of the distance at which a traversal stops, for sums that are rounded in another order.
SLACK = 1e-9


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            s = np.bincount(near, weights=x[:, d], minlength=k)
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def visit(u: np.ndarray, v: np.ndarray, counts: np.ndarray, enough: int) -> tuple[list[int], float]:
    """Cells by rising u[i] + v[j] until they hold `enough` rows (multi-sequence traversal), and the last one's sum."""
    iu, iv = np.argsort(u, kind="stable"), np.argsort(v, kind="stable")
    su, sv, k = u[iu].tolist(), v[iv].tolist(), len(v)
    heap, out, held, last = [(su[0] + sv[0], 0, 0)], [], 0, 0.0
    while heap and held < enough:
        last, a, b = heapq.heappop(heap)
        cell = int(iu[a]) * k + int(iv[b])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if b + 1 < k:
            heapq.heappush(heap, (su[a] + sv[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(u):
            heapq.heappush(heap, (su[a + 1] + sv[0], a + 1, 0))
    return out, last


class Codebooks:
    def __init__(self, sample: np.ndarray, k: int | None = None, recall: float = 0.96, top: int = 5, rows: int | None = None):
        """`rows` are those of the whole table: with the number of cells near a quarter of them, cells stay small."""
        x = unit(sample)
        self.half = x.shape[1] // 2
        different = len(np.unique(x, axis=0))
        k = k or int(min(CENTROIDS, max(1, (rows or different) ** 0.5 / 2, 1), max(1, different / 16)))
        self.k = max(1, min(k, len(x)))
        self.a, self.b = k_means(x[:, : self.half], self.k), k_means(x[:, self.half :], self.k, seed=2)
        self.share = self._measure(x, recall, top)

    def cells(self, x: np.ndarray) -> np.ndarray:
        x = unit(x)
        return nearest(x[:, : self.half], self.a) * self.k + nearest(x[:, self.half :], self.b)

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = unit(x)
        return distances(x[:, : self.half], self.a), distances(x[:, self.half :], self.b)

    def _measure(self, x: np.ndarray, recall: float, top: int) -> float:
        if len(x) <= top + 1:
            return 1.0
        q = np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int)
        cell = self.cells(x)
        counts = np.bincount(cell, minlength=self.k**2)
        score = x[q] @ x.T
        score[np.arange(len(q)), q] = -np.inf
        best = np.argpartition(-score, top - 1, axis=1)[:, :top]
        u, v = self.sums(x[q])
        need = np.empty((len(q), top))
        for n in range(len(q)):
            order, _ = visit(u[n], v[n], counts, len(x))
            held = np.zeros(self.k**2)
            held[order] = np.cumsum(counts[order]) - counts[order] + 1
            need[n] = held[cell[best[n]]] / len(x)
        return next((s for s in SHARES if (need <= s).mean() >= recall), 1.0)


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _indexed(sent, dim: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell = sent.value.cells(_matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "vec", "cell"])

    return run


def parts_of_cells(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first part, number of parts) of every cell: cells in order fill parts of `size` rows, a larger cell has several of its own."""
    first, wide = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    part = held = 0
    for cell, n in enumerate(counts.tolist()):
        if n > size:
            part += held > 0
            first[cell], wide[cell], held = part, -(-n // size), 0
            part += int(wide[cell])
            continue
        if held and held + n > size:
            part, held = part + 1, 0
        first[cell] = part
        held += n
    return first, wide


def _visits(sent, counts: np.ndarray, enough: int, dim: int, first: np.ndarray, wide: np.ndarray):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = sent.value.sums(_matrix(batch.column(1), dim))
            parts, limits = [], []
            for a, b in zip(u, v):
                cells, last = visit(a, b, counts, enough)
                parts.append(np.unique(np.concatenate([first[cells], *(np.arange(first[c], first[c] + wide[c]) for c in cells if wide[c] > 1)])))
                limits.append(last + SLACK)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(limits, pa.float64()), pa.array(parts, pa.list_(pa.int64()))], names=["vec_id", "vec", "block", "limit", "parts"])

    return run


def _ranked(sent, dim: int, top: int):
    def run(batches):
        for table, cuts in common.runs(batches, ["part", "block"]):
            ids, kind, cell, limit = (table.column(c).to_numpy() for c in ("vec_id", "kind", "cell", "limit"))
            raw, out = table.column("vec"), []
            for lo, hi in zip(cuts, cuts[1:]):
                nq = int(np.count_nonzero(kind[lo:hi] == 0))
                if nq == 0 or lo + nq == hi:
                    continue
                x = _matrix(raw.slice(lo, hi - lo), dim)
                r, rid = x[nq:], ids[lo + nq : hi]
                ra, rb = np.divmod(cell[lo + nq : hi], sent.value.k)
                rn = np.sqrt((r * r).sum(1))
                rows = r / rn[:, None]
                # some queries at a time, so that their scores stay near 32 MB
                some = max(1, (1 << 22) // len(r))
                for at in range(0, nq, some):
                    q, qid, far = x[at : min(nq, at + some)], ids[lo + at : lo + min(nq, at + some)], limit[lo + at : lo + min(nq, at + some)]
                    qn = np.sqrt((q * q).sum(1))
                    near = (q / qn[:, None]) @ rows.T
                    u, v = sent.value.sums(q)
                    near[(u[:, ra] + v[:, rb] > far[:, None]) | (qid[:, None] == rid[None, :])] = -np.inf
                    out += [_best(near[n], r, rn, rid, q[n], qn[n], int(qid[n]), top) for n in range(len(q))]
            out = [o for o in out if len(o[0])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], names=["query_id", "vec_id", "score"])

    return run


def _best(near: np.ndarray, r: np.ndarray, rn: np.ndarray, rid: np.ndarray, q: np.ndarray, qn: float, qid: int, top: int):
    """The best rows of one query: all that may be among them by the matrix product, ties included, are scored exactly."""
    cut = np.partition(near, len(near) - top)[len(near) - top] if len(near) > top else -np.inf
    at = np.flatnonzero((near >= cut - 1e-9) & (near > -np.inf))
    exact = (r[at] * q).sum(1) / (rn[at] * qn)
    best = np.lexsort((rid[at], -exact))[:top]
    return np.full(len(best), qid), rid[at][best], exact[best]


def neighbours(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, top: int = 5, sample: int = SAMPLE, recall: float = 0.96, k: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found of each row whose id is divisible by `every`.

    score is the cosine of the original vectors in double precision; nearest first, ties to the smaller id; the
    query's own row is no candidate.  Rows with a null id take no part, nor do vectors that are null, zero, of a
    length other than the commonest, or hold a null or non-finite component.  All rows are indexed; only the
    codebooks and the share to visit come from a sample of at most `sample` rows.  A query gets all candidates if
    there are at most `top`.  Rows that repeat a query's id answer as one query.  An empty table gives no rows.
    """
    spark = table.sparkSession
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and v is not null and size(v) > 0").where(finite).where(F.exists(v, lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    width, total = dims["d"], dims["count"]
    dim = max(2, width)  # a single component gets a zero beside it, which changes no cosine
    rows = rows.where(F.size("v") == width)

    def packed(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            flat = np.pad(flat, ((0, 0), (0, dim - width)))
            # squares that underflow or overflow: a power of two brings the largest component to 0.5..1
            with np.errstate(over="ignore", under="ignore"):
                square = (flat * flat).sum(1)
                far = ~((square >= 1e-290) & (square <= 1e290))
                flat[far] = np.ldexp(flat[far], -np.frexp(np.abs(flat[far]).max(1))[1][:, None])
            # vectors travel as bytes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], names=["vec_id", "vec"])

    rows = common.stored(rows.mapInArrow(packed, "vec_id long, vec binary"), "vectors")
    bits = 1 << 30
    part = rows if total <= sample else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(bits)) < int(bits * 0.95 * sample / total))
    got = sorted(bytes(r["vec"]) for r in part.select("vec").limit(sample).collect())
    books = Codebooks(np.frombuffer(b"".join(got), dtype=np.float64).reshape(-1, dim), k, recall, top, total)
    sent = spark.sparkContext.broadcast(books)
    index = common.stored(rows.mapInArrow(_indexed(sent, dim), "vec_id long, vec binary, cell int"), "multi-index")

    is_query = F.col("vec_id") % every == 0
    held = index.groupBy("cell").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).collect()  # at most k * k
    counts = np.zeros(books.k**2, dtype=np.int64)
    asked = np.zeros(books.k**2, dtype=np.int64)
    for r in held:
        counts[r["cell"]], asked[r["cell"]] = r["n"], r["q"]
    enough = int(min(total, max(np.ceil(books.share * total), 4 * top)) + 1)
    tile = int(min(TILE[1], max(TILE[0], total // TILES)))
    first, wide = parts_of_cells(counts, tile)
    block, blocks = parts_of_cells(asked, tile)
    plan = spark.createDataFrame([(c, int(first[c]), int(wide[c]), int(block[c]), int(blocks[c])) for c in np.flatnonzero(counts).tolist()], "cell int, _part long, _wide long, _block long, _blocks long")
    dealt_over = lambda a, n: F.col(a) + F.pmod(F.xxhash64("vec_id"), F.col(n))
    placed = index.join(F.broadcast(plan), "cell")  # a row per cell: at most CENTROIDS squared
    queries = placed.where(is_query).dropDuplicates(["vec_id"]).select("vec_id", "vec", dealt_over("_block", "_blocks").alias("block"))
    # traversals cost far more than their few bytes tell: a task takes about a hundred
    queries = queries.repartition(max(1, min(10_000, -(-int(asked.sum()) // 128))), "vec_id")
    queries = common.stored(queries.mapInArrow(_visits(sent, counts, enough, dim, first, wide), "vec_id long, vec binary, block long, limit double, parts array<long>"), "visits")
    asks = queries.select(F.explode("parts").alias("part"), "block", F.lit(0).alias("kind"), "vec_id", "vec", F.lit(-1).alias("cell"), "limit")
    # a part goes to each block that visits it: the pairs are as many as tiles
    pairs = asks.select("part", "block").distinct().groupBy("part").agg(F.collect_list("block").alias("blocks"))
    entries = placed.withColumn("part", dealt_over("_part", "_wide")).join(pairs, "part").select("part", F.explode("blocks").alias("block"), F.lit(1).alias("kind"), "vec_id", "vec", "cell", F.lit(0.0).alias("limit"))
    dealt = asks.union(entries).repartition("part", "block").sortWithinPartitions("part", "block", "kind")
    found = dealt.mapInArrow(_ranked(sent, dim, top), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
