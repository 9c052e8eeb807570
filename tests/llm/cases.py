"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing column names."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "river", "stone", "light", "under", "walk", "seven", "glass", "north", "paper", "quiet", "amber", "field", "metal", "cloud", "ember", "grove", "hollow", "ivory"]


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(200)) for _ in range(n))


def odd_rows():
    base = prose(1, 80)
    parts = base.split(" ")
    near = " ".join([*parts[:40], "changed", *parts[41:]])
    rows = [
        (1, base, "en", "a", None), (2, base.upper(), "en", "a", 3), (3, near, None, "b", 1), (4, None, "en", "b", 0), (5, "", None, None, 0),
        (6, " \t\n", "de", None, 3), (7, "one two", "en", "c", 7), (8, "one  two", "en", "c", 8), (9, "12 34 !!", "fr", "c", 8), (10, "é🙂 ß\u2581x", "de", "d", 6),
        (11, prose(2, 60), "en", "a", 5), (11, prose(2, 60), "en", "a", 5), (12, prose(3, 30_000), "en", "hot", 5), (None, prose(4, 20), None, None, None),
    ]
    return rows + [(100 + i, prose(50 + i, 30), "en" if i % 2 else "de", "hot", 1) for i in range(20)]


def frame(spark, rows=None, clash=True):
    """The rows, with columns whose names operators might use themselves."""
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    if clash:
        for c in ("id", "key", "n", "class", "shard", "_key", "_text", "rank", "word", "value", "row", "doc", "at", "other", "lang_pred", "_lang_pred", "_p", "_k", "_s", "_s0", "_many", "_row", "part", "hot", "size"):
            df = df.selectExpr("*", f"'x' as `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s):
    return (s or "").translate({i: i + 32 for i in range(65, 91)})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()
