"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Every source has a base weight and a schedule g(t) over training time 0..1, linear from `start` to `end`.  Base
weights and sizes give each source's target; its demand up to time t is target * G(t), with G the integral of g
scaled to G(1) = 1.  Documents of a source stand in the order of the MD5 of their id; a copy that starts after
`x` words of the source's stream is read when the demand reaches x, so its position is G^-1(x / target).

The running sums need no task that holds a source: documents fall into hash ranges (the number grows with the rows),
ranges are summed first, and only then are documents numbered inside their range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import common

#: Base weights by the source's rank modulo 3.
WEIGHTS = (3, 1, 2)
#: Words of the mix per word of the corpus, and the most a source is repeated.
BUDGET, REPEAT = 1.5, 2
#: (start, end) of the schedules by the source's rank modulo 3: falling, flat, rising.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
ROWS_PER_RANGE = 4_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, repeat: float = REPEAT, schedules=SCHEDULES) -> DataFrame:
    """(source, source_size) -> the same with target, start and end.

    Targets share budget * total by weight; those above repeat * source_size stop there and the excess is shared
    again.  With sources by rising cap-to-weight ratio, the first source whose cap exceeds the level reached with
    all before it at their caps fixes the final level.  The table has a row per source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pick = lambda values, r: F.element_at(F.array(*[F.lit(v) for v in values]), (r % len(values)).cast("int") + 1)
    s = sizes.withColumn("_r", F.row_number().over(by_name) - 1)
    s = s.withColumn("_w", pick([float(w) for w in weights], F.col("_r"))).withColumn("_cap", F.lit(float(repeat)) * F.col("source_size"))
    s = s.withColumn("start", pick([float(a) for a, _ in schedules], F.col("_r"))).withColumn("end", pick([float(b) for _, b in schedules], F.col("_r")))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    total = Window.partitionBy()
    s = s.withColumn("_before", F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.lit(float(budget)) * F.sum("source_size").over(total) - F.col("_before")) / F.col("_rest"))
    s = s.withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_w"))
    s = s.withColumn("_final", F.min_by("_level", F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_w"), F.col("_r")))).over(total))
    s = s.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap"))))
    return s.select("source", "source_size", "target", "start", "end")


def position(share: Column, start: Column, end: Column) -> Column:
    """G^-1: the time at which a linear schedule has spent `share` of its integral."""
    slope = end - start
    area = share * (start + end) / 2
    root = (F.sqrt(F.greatest(F.lit(0.0), start * start + slope * area * 2)) - start) / slope
    return F.when(F.abs(slope) < 1e-12, share).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), root)))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies, positions, position, position2.

    copies is how many times the mix reads the whole document: the whole part of target / source_size, and once
    more for the documents that come first in the source's order until the target is reached (a document whose
    middle lies before that point counts), so a source's words miss its target by half a document at most.  The
    positions (0 to 1) are those of all copies; position and position2 are the first two, null where there is none.

    Null texts and texts of white space have size 0; null sources are one source.  A source of size 0 has target 0
    and no copies.  Rows that repeat an id stand side by side in the order.  An empty table gives no rows.
    """
    return _planned(common.stored(_sized(docs, id_col, text_col, source_col), "mix-sizes"), **options)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size and tie, the hash of the whole row (but for maps, which have none)."""
    return docs.select(*_sizes(docs, id_col, text_col, source_col))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), tie.alias("tie")]


def _planned(sizes: DataFrame, full: DataFrame | None = None, **options) -> DataFrame:
    """The plan of a stored table (doc_id, source, size, tie); tie orders what else is equal.

    full: the same rows with further columns, which pass through.
    """
    ranges = max(1, -(-sizes.count() // ROWS_PER_RANGE))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))

    def ranged(t: DataFrame) -> DataFrame:
        # a null source is a key like any other, so that window and join share one way of dealing rows
        t = t.withColumn("_k", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull())
        return t.withColumn("_h", order).withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32)).cast("int"))

    sums = common.stored(ranged(sizes).groupBy("source", "_b").agg(F.sum("size").alias("_sum")), "mix-sums")
    d = ranged(sizes if full is None else full)
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), **options)
    place = ["_k", "_n", "_b"]
    before = sums.withColumn("_k", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull()).withColumn("_off", F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    small = before.join(targets, before.source.eqNullSafe(targets.source)).select(*place, "_off", "source_size", "target", "start", "end")
    inside = Window.partitionBy(*place).orderBy("_h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    x = d.join(small, place)
    x = x.withColumn("_at", F.col("_off") + F.col("_in")).withColumn("_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    x = x.withColumn("_whole", F.floor("_ratio"))
    extra = (F.col("_at") + F.col("size") / 2) < (F.col("target") - F.col("_whole") * F.col("source_size"))
    x = x.withColumn("copies", F.when(F.col("size") > 0, F.col("_whole") + extra.cast("long")).otherwise(0).cast("int"))
    at = lambda k: position(F.least(F.lit(1.0), (F.col("_at") + k * F.col("source_size")) / F.col("target")), F.col("start"), F.col("end"))
    # a sequence from 0 to -1 would run backwards
    x = x.withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("copies") - 1)), at)).otherwise(F.array().cast("array<double>")))
    nth = lambda k: F.try_element_at("positions", F.lit(k))
    more = [c for c in (full.columns if full is not None else ()) if c not in sizes.columns]
    return x.select(*more, "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "positions", nth(1).alias("position"), nth(2).alias("position2"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns, range-sorted by position.

    Sizes are summed first, apart from the texts; then the rows travel whole to their range of the source's order, are
    planned there, and go on to their positions.  So no plan is joined back: rows with a null id, and rows that repeat
    an id, are each taken as often as planned, and no column of theirs can clash.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    sizes = common.stored(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    full = docs.select(whole, *_sizes(docs, id_col, text_col, source_col))
    plan = _planned(sizes, full, **options).where("copies > 0")
    return plan.select("doc", "doc_id", F.explode("positions").alias("at")).sort("at", "doc_id").select("doc.*")
