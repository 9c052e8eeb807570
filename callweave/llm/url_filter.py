"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule is (host, path, verdict): it fits its host and all subdomains if the URL's path starts with the rule's; the
longest fitting rule wins.  URLs that a rule fits are the labelled ones: the trees learn their verdicts from lexical
features (lengths, depth, digit ratio, entropy, parameter counts, statistics of the host's suffix) and judge the URLs
that no rule fits.  The trees are fitted on the driver to at most `SAMPLE` labelled URLs, taken by the hash of the
URL; the suffix statistics count all labelled URLs, and there are no more of those suffixes than rules, since a
host that a rule fits ends as the rule's host does.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm import common

#: Fixed values: (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
SAMPLE, TREES, DEPTH, RATE, BINS = 20_000, 40, 4, 0.2, 32
NAMES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "has_fragment", "has_extension", "is_https", "last_segment_length", "last_segment_digits", "suffix_count", "suffix_block_rate")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for a null or without ://."""
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that wins, as host and path together, and its verdict; nulls where none fits."""
    name = verdict = F.lit(None).cast("string")
    # the shortest first, so that longer ones are tested before them
    for r in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        name, verdict = F.when(fits(host, path, r), r[0] + r[1]).otherwise(name), F.when(fits(host, path, r), r[2]).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def lexical(url: str | None, host: str, path: str, stats: dict[str, tuple[float, float]]) -> list[float]:
    url = url or ""
    rest = url.split("#", 1)[0].partition("?")[2]
    last = path.rstrip("/").rpartition("/")[2]
    count, rate = stats.get(host.rpartition(".")[2], (0.0, 0.5))
    digits = lambda s: sum(c.isdigit() for c in s) / max(1, len(s))
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1, digits(url), digits(host), host.count("-"), _entropy(url), _entropy(host),
        sum(1 for p in rest.split("&") if p), len(rest), "#" in url, "." in last, url.startswith("https"), len(last), digits(last), math.log1p(count), rate,
    ]


@dataclass
class Trees:
    """Complete trees of one depth: for each level's nodes a feature and a cut (x > cut goes right), and leaf values."""

    bias: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - len(f)]
        return 1 / (1 + np.exp(-out))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins; ties go to the lower feature and cut."""
    p = np.clip(y.mean() if len(y) else 0.0, 0.02, 0.98)
    bias = float(np.log(p / (1 - p)))
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(bias, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y) or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score = np.full(len(y), bias)
    features, values, leaf_values = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            choice = [(0, np.inf)] * width
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                bins = len(cuts[f]) + 1
                at = (node - base) * bins + code[:, f]
                gs = np.bincount(at, weights=g, minlength=width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(at, weights=h, minlength=width * bins).reshape(width, bins).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                top = gain.argmax(1)
                for n in np.flatnonzero(gain[np.arange(width), top] > best + 1e-9):
                    best[n], choice[n] = gain[n, top[n]], (f, cuts[f][top[n]])
            for n, (f, c) in enumerate(choice):
                feature[base + n], cut[base + n] = f, c
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + l2)
        score += leaf[at]
        features.append(feature)
        values.append(cut)
        leaf_values.append(leaf)
    return Trees(bias, np.array(features), np.array(values), np.array(leaf_values))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[Trees, dict[str, tuple[float, float]]]:
    """Trees and suffix statistics from (url, host, path, verdict)."""
    by_suffix = labelled.groupBy(suffix_of(F.col("host")).alias("s")).agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b")).collect()
    stats = {r["s"]: (float(r["n"]), (r["b"] + 1) / (r["n"] + 2)) for r in by_suffix}
    rows = sum(r["n"] for r in by_suffix)
    bits = 1 << 30
    if rows > sample:
        # by the hash of the URL alone: copies of a URL have the same features, and one of them is enough
        labelled = labelled.dropDuplicates(["url"]).withColumn("at", F.pmod(F.xxhash64("url"), F.lit(bits)))
        labelled = labelled.where(F.col("at") < int(bits * min(1.0, 0.95 * sample / labelled.count()))).orderBy("at", "url").limit(sample)
    got = sorted(((r["url"], r["host"], r["path"], r["verdict"]) for r in labelled.select("url", "host", "path", "verdict").collect()), key=str)
    x = np.array([lexical(u, h, p, stats) for u, h, p, _ in got], dtype=float).reshape(len(got), len(NAMES))
    return boost(x, np.array([v == "block" for *_, v in got], dtype=float)), stats


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, p_block.

    verdict is the winning rule's, else `block` where the trees' probability reaches `threshold`, else `allow`.
    p_block is the trees' probability for every row.  A null URL, or one without ://, has empty host and path, fits
    no rule and is judged by its features.  Without labelled URLs, or with one kind only, the trees are their prior.
    Repeated rows are judged alike.  Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    sent = pages.sparkSession.sparkContext.broadcast(fit(rows.where("verdict is not null"), sample))

    @F.pandas_udf("double")
    def p_block(url, host, path):
        import pandas as pd

        trees, stats = sent.value
        x = np.array([lexical(u if isinstance(u, str) else None, h, p, stats) for u, h, p in zip(url, host, path)], dtype=float).reshape(len(url), len(NAMES))
        return pd.Series(trees.predict(x))

    rows = rows.withColumn("p_block", p_block("url", "host", "path"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_block")
