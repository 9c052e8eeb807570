"""Secret scan over an incremental blob ledger (DataFrame functions only).

Every version of a file is a (path, blob) pair; a blob is addressed by the SHA-256 of its bytes.  The ledger holds,
for each blob and rule version that was ever scanned, the spans found.  A scan addresses all versions, takes the
blobs that the ledger lacks under the current rule version, reads each of them once, appends their findings and joins
the findings back to all paths.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm import common

#: Fixed values.  kind -> (pattern, group whose length counts, least length); order breaks ties of equal starts.
RULES = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
SPAN = "array<struct<start:int,kind_no:int,end:int>>"
LEDGER = f"blob string, rules string, spans {SPAN}"


def rule_version(rules: dict = RULES) -> str:
    return hashlib.sha256(repr(sorted(rules.items())).encode()).hexdigest()[:16]


def _spans(text: Column, kind_no: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points.

    Split gives the pieces between the matches, so a match starts where the pieces and matches before it end.
    """
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    counted = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    steps = F.arrays_zip(F.split(text, pattern).alias("gap"), whole.alias("hit"), counted.alias("part"))
    # split returns one piece more than there are matches: the last step has no hit
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"))
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.when(F.length(x["part"]) >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out")))

    return F.when(F.regexp_like(text, p), F.aggregate(steps, zero, step)["out"]).otherwise(F.array().cast(SPAN))


def find_spans(text: Column, rules: dict = RULES) -> Column:
    """All spans of a text (null: empty) by start, then rule order."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans(text, k, *rule) for k, rule in enumerate(rules.values())]))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_versions(versions: DataFrame, path_col: str, text_col: str, ledger: str | None = None, rules: dict = RULES) -> DataFrame:
    """Scans what the ledger has not seen and returns path, blob, spans for every version.

    `ledger` is a folder all executors see; it is made at the first scan and grows by one write per scan.  Without
    one, a new ledger is made in the shared folder.  Null texts are the empty blob.  Versions that repeat path and
    blob are each returned.  Where an earlier scan was cut off half way its write left nothing, and its blobs are
    scanned again.  Other columns of `versions` are ignored.
    """
    spark = versions.sparkSession
    at = ledger or f"{common.shared_dir(spark)}/blob-ledger-{uuid.uuid4().hex}"
    version = rule_version(rules)
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(at)
    known = spark.read.schema(LEDGER).parquet(at).where(F.col("rules") == version)

    rows = versions.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).withColumn("blob", blob_of(F.col("text")))
    addressed = common.stored(rows.select("path", "blob"), "versions")
    held = addressed.groupBy("blob").agg(F.min("path").alias("path"), F.count("*").alias("many"))
    # one version of each unseen blob; the texts are not part of this shuffle
    unseen = held.join(known.select("blob"), "blob", "left_anti").select("blob", F.col("path").alias("_p"))
    todo = rows.join(unseen, (rows["blob"] == unseen["blob"]) & rows["path"].eqNullSafe(unseen["_p"]), "left_semi")
    found = todo.select("blob", F.lit(version).alias("rules"), find_spans(F.col("text"), rules).alias("spans")).groupBy("blob", "rules").agg(F.first("spans").alias("spans"))
    found.write.mode("append").parquet(at)

    findings = spark.read.schema(LEDGER).parquet(at).where(F.col("rules") == version).groupBy("blob").agg(F.first("spans").alias("spans"))
    # all versions of one blob may be a large part of the table
    return common.salted_join(addressed, held.select("blob", "many").join(findings, "blob"), ["blob"], "path", addressed.count()).select("path", "blob", "spans")


def digest(scanned: DataFrame, rules: dict = RULES) -> DataFrame:
    """path, one count per rule, and the spans as text with its SHA-256."""
    kinds = F.array(*[F.lit(k) for k in rules])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", kinds[s["kind_no"]], s["start"], s["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_no"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(rules)]
    return scanned.select("path", *counts, text.alias("spans")).withColumn("base_sha256", F.sha2(F.col("spans").cast("binary"), 256))
