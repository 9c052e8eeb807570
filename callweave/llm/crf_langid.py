"""Language labels for the words of code-switched text: a linear-chain conditional random field.

A word is a run of letters, lower-cased.  Its features are hashed: character trigrams with word boundaries, its first
and last three letters with the boundary (affixes), and the word itself if it is in the lexicon of frequent training
words, else the mark of an unknown word.  Labels are the languages of the training documents; transitions are learned
with the rest.  Training chains are spliced from runs of several documents, so that the learned transitions allow
text to switch.  Labelling is exact forward-backward over the whole text.

The model is fitted on the driver to a bounded sample of labelled rows: `sample` documents (4,096), and of each of them
`runs` (8) runs of `run` (16) words, spread over the whole text.  The sample is a function of the rows, not of how they
are partitioned.  Everything else covers all words of all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import chain, common
from callweave.llm.shingles import mix

SAMPLE, RUNS, RUN = 4_096, 8, 16
#: Rows of the sample that a rare label gets.
FLOOR = 16
BUCKETS, LEXICON = 1 << 16, 20_000
UNDETERMINED = "und"
_U = np.uint64
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def words_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters."""
    inside = np.zeros(len(code) + 2, dtype=bool)
    inside[1:-1] = _is_letter()[code]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


@dataclass
class Features:
    """Hashed feature numbers: a flat list of trigrams with the word each starts at, and three per word."""

    tri: np.ndarray
    tri_at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    word: np.ndarray


def features(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> Features:
    """code is lower-cased and has a non-letter before, between and after words."""
    n = end - start
    tri_at = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat(start - tri_at, n)
    edge = np.full(len(code), 0, dtype=np.uint64)
    letters = _is_letter()[code]
    edge[letters] = code[letters]
    before, here, after = edge[at - 1], edge[at], edge[at + 1]
    tri = mix((before << _U(42)) | (here << _U(21)) | after)
    def affix(step: int, base: np.ndarray, salt: int) -> np.ndarray:
        h = np.full(len(base), salt, dtype=np.uint64)
        live = np.ones(len(base), dtype=bool)
        for k in range(3):
            live &= k < n
            h = np.where(live, mix(h * _U(31) + edge[np.where(live, base + k * step, 0)]), h)
        return h
    total = np.zeros(len(at) + 1, dtype=np.uint64)
    order = (np.arange(len(at)) - np.repeat(tri_at, n)).astype(np.uint64)
    np.cumsum(mix(here + order * _U(0x200000)), out=total[1:])
    word = mix(total[tri_at + n] - total[tri_at] + n.astype(np.uint64))
    mask = _U(BUCKETS - 1)
    return Features((tri & mask).astype(np.int32), tri_at, (affix(1, start, 1) & mask).astype(np.int32), (affix(-1, end - 1, 2) & mask).astype(np.int32), word)


@dataclass
class Crf:
    labels: list[str]
    lexicon: np.ndarray  # sorted word hashes
    tri: np.ndarray  # BUCKETS x labels, likewise the others
    first: np.ndarray
    last: np.ndarray
    word: np.ndarray  # lexicon + 1 rows, the last for unknown words
    start: np.ndarray
    move: np.ndarray

    def entry(self, word: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(word), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, word), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == word, at, len(self.lexicon))

    def unary(self, f: Features) -> np.ndarray:
        out = np.add.reduceat(self.tri[f.tri], f.tri_at, axis=0) if len(f.tri_at) else np.zeros((0, len(self.labels)), np.float32)
        return out + self.first[f.first] + self.last[f.last] + self.word[self.entry(f.word)]


def posteriors(crf: Crf, f: Features, lengths: np.ndarray) -> np.ndarray:
    """Label probabilities of every word; lengths are the words of each chain."""
    score = crf.unary(f).astype(np.float64)
    emit = np.exp(score - score.max(1, keepdims=True)) + 1e-12
    first, move = np.exp(crf.start - crf.start.max()), np.exp(crf.move - crf.move.max())
    out = np.empty_like(emit)
    offsets = np.cumsum(lengths) - lengths
    for part in chain.chunks(lengths):
        at = chain.gather(offsets, lengths, part)
        place, step = chain.time_order(lengths[part])
        e = np.empty((len(at), emit.shape[1]))
        e[place] = emit[at]
        gamma, scale = chain.forward(step, e, first, move)
        chain.backward(step, e, move, gamma, scale)
        out[at] = gamma[place]
    return out


def _encoded(texts: list[str | None]):
    """Joined code points of the texts, their words, and how many words each has."""
    lower = [(t or "").lower() for t in texts]
    code = code_points("\n" + "\n".join(lower) + "\n")
    start, end = words_of(code)
    cut = 1 + np.cumsum([0] + [len(t) + 1 for t in lower])
    return code, start, end, np.diff(np.searchsorted(start, cut))


def fit(runs: list[tuple[str, str]], seed: int = 3, epochs: int = 3, rate: float = 0.15, l2: float = 1e-6) -> Crf:
    """Learns from (language, run of words) by AdaGrad on the exact likelihood of spliced chains."""
    labels = sorted({lang for lang, _ in runs})
    k = len(labels)
    code, start, end, n = _encoded([t for _, t in runs])
    f = features(code, start, end)
    word, count = np.unique(f.word, return_counts=True)
    lexicon = np.sort(word[np.argsort(-count, kind="stable")[:LEXICON]][count[np.argsort(-count, kind="stable")[:LEXICON]] > 1])
    zero = lambda rows: np.zeros((rows, k), dtype=np.float32)
    crf = Crf(labels, lexicon, zero(BUCKETS), zero(BUCKETS), zero(BUCKETS), zero(len(lexicon) + 1), np.zeros(k), np.zeros((k, k)))
    gold = np.repeat(np.array([labels.index(lang) for lang, _ in runs], dtype=np.int64), n)
    entry = crf.entry(f.word)
    tri_n = np.diff(np.append(f.tri_at, len(f.tri)))
    offsets = np.cumsum(n) - n
    rng = np.random.default_rng(seed)
    params = {"tri": crf.tri, "first": crf.first, "last": crf.last, "word": crf.word, "start": crf.start, "move": crf.move}
    seen = {name: np.full(p.shape, 1e-3) for name, p in params.items()}
    usable = np.flatnonzero(n > 0)
    for _ in range(epochs):
        order = rng.permutation(usable)
        for lo in range(0, len(order), 1024):
            some = order[lo : lo + 1024]
            at = chain.gather(offsets, n, some)
            tri = chain.gather(f.tri_at, tri_n, at)
            part = Features(f.tri[tri], np.cumsum(tri_n[at]) - tri_n[at], f.first[at], f.last[at], f.word[at])
            # three runs make a chain
            lengths = np.add.reduceat(n[some], np.arange(0, len(some), 3))
            score = crf.unary(part).astype(np.float64)
            emit = np.exp(score - score.max(1, keepdims=True)) + 1e-12
            own = np.arange(len(lengths))[np.argsort(-lengths, kind="stable")]
            off = np.cumsum(lengths) - lengths
            idx = chain.gather(off, lengths, own)
            first, move = np.exp(crf.start), np.exp(crf.move)
            place, step = chain.time_order(lengths[own])
            e = np.empty((len(idx), k))
            e[place] = emit[idx]
            gamma, scale = chain.forward(step, e, first, move)
            pairs = chain.backward(step, e, move, gamma, scale)
            gamma = gamma[place]
            y = gold[at]
            diff = np.zeros((len(at), k))
            diff[idx] = -gamma
            diff[np.arange(len(at)), y] += 1
            grad = {"start": diff[off].sum(0), "move": -pairs}
            inside = np.ones(len(at), dtype=bool)
            inside[off] = False
            nxt = np.flatnonzero(inside)
            np.add.at(grad["move"], (y[nxt - 1], y[nxt]), 1)
            word_of_tri = np.repeat(np.arange(len(at)), tri_n[at])
            for name, where, rows in (("tri", part.tri, diff[word_of_tri]), ("first", part.first, diff), ("last", part.last, diff), ("word", entry[at], diff)):
                size = len(params[name])
                grad[name] = np.stack([np.bincount(where, weights=rows[:, c], minlength=size) for c in range(k)], axis=1)
            for name, g in grad.items():
                p = params[name]
                g = g / len(lengths) - l2 * p
                seen[name] += g * g
                p += (rate * g / np.sqrt(seen[name])).astype(p.dtype)
    return crf


def _cut_runs(runs: int, run: int):
    def cut(batches):
        for batch in batches:
            lang, out = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = re.findall(r"[^\W\d_]+", (text or "").lower())
                step = max(run, -(-len(words) // runs))
                for at in range(0, len(words), step):
                    lang.append(label)
                    out.append(" ".join(words[at : at + run]))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.string())], names=["lang", "run"])

    return cut


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, runs: int = RUNS, run: int = RUN) -> Crf | None:
    """Fits a model to at most `sample` of the labelled rows, taken by a hash of id and text; None without labels.

    Every label with a letter in a text has a row in the sample and about FLOOR of them, or an even share of half the
    sample if there are many labels; the rest is in proportion.  Of more than `sample` labels the commonest are learnt.
    """
    bits = 1 << 30
    labelled = docs.where(F.col(lang_col).isNotNull() & F.regexp_like(text_col, F.lit(r"\p{L}"))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    labelled = labelled.withColumn("at", F.pmod(F.xxhash64("id", "text"), F.lit(bits)))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy(F.desc("n"), "lang").limit(sample).collect()
    rows = sum(r["n"] for r in counts)
    if rows > sample:
        least = min(FLOOR, max(1, sample // (2 * len(counts))))
        share = 0.9 * max(0, sample - least * len(counts)) / rows
        cuts = [(r["lang"], r["first"], max(r["first"], int(bits * min(1.0, max(share, least / r["n"]))))) for r in counts]
        labelled = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, first long, cut long")), "lang").where("at <= cut")
        # the first of each label, then the rest; rows that repeat id and text share their hash, and the bound holds for them too
        labelled = labelled.orderBy(F.col("at") > F.col("first"), "at", "id", "lang").limit(sample)
    got = labelled.select("lang", "text").mapInArrow(_cut_runs(runs, run), "lang string, run string").collect()
    return fit(sorted((r["lang"], r["run"]) for r in got)) if got else None


def _labelled(model, folds_col: bool):
    def run(batches):
        for batch in common.trimmed(batches):
            crf = model.value
            pred, score, count, switches = [], [], [], []
            for _, part in common.some_texts(batch.column("text"), 1 << 19):
                if crf is None:
                    n = np.zeros(len(part), dtype=np.int64)
                else:
                    code, start, end, n = _encoded(part)
                if not n.sum():
                    pred += [UNDETERMINED] * len(part)
                    score += [0.0] * len(part)
                    count += [0] * len(part)
                    switches += [0] * len(part)
                    continue
                p = posteriors(crf, features(code, start, end), n)
                best = p.argmax(1)
                doc = np.repeat(np.arange(len(part)), n)
                mean = np.stack([np.bincount(doc, weights=p[:, c], minlength=len(part)) for c in range(p.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
                turn = (best[1:] != best[:-1]) & (doc[1:] == doc[:-1])
                top = mean.argmax(1)
                pred += [crf.labels[c] if k else UNDETERMINED for c, k in zip(top, n)]
                score += [min(1.0, float(mean[d, c])) for d, c in enumerate(top)]
                count += n.tolist()
                switches += np.bincount(doc[1:][turn], minlength=len(part)).tolist()
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(switches, pa.int64())], names=[*kept, "lang_pred", "score", "n_words", "n_switches"])

    return run


def label_words(crf: Crf, text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, language, probability) of every word of a text, in code points of its lower-cased form."""
    code, start, end, n = _encoded([text])
    if not n.sum():
        return []
    p = posteriors(crf, features(code, start, end), n)
    return [(int(a) - 1, int(b) - 1, crf.labels[c], float(q[c])) for a, b, q, c in zip(start, end, p, p.argmax(1))]


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, sample: int = SAMPLE, runs: int = RUNS, run: int = RUN) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, n_words, n_switches.

    Learns from the rows with a text and a label whose crc32(id as text) modulo `folds` is not 0 (a null id counts as
    held out).  lang_pred is the label with the highest mean probability over the words, score that mean.  A null
    text, or one without a letter, is `und` with score 0; so is every row if there is nothing to learn from.
    n_switches counts neighbouring words with different labels.  Equal texts get equal results.
    """
    held = F.coalesce(common.fold(F.col(id_col), folds) == 0, F.lit(True))
    crf = train(docs.where(~held), id_col, text_col, lang_col, sample, runs, run)
    sent = docs.sparkSession.sparkContext.broadcast(crf)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_labelled(sent, True), "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long")


def with_language(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, sample: int = SAMPLE, runs: int = RUNS, run: int = RUN) -> DataFrame | None:
    """docs with the predicted language as one more column `out`; the other columns, whatever their names, pass through.

    As in predict_languages a null text, or one without a letter, is `und`; rows with a null id are predicted like
    others and learnt from by none.  Repeated rows get equal labels.  None without anything to learn from.
    """
    held = F.coalesce(common.fold(F.col(id_col), folds) == 0, F.lit(True))
    crf = train(docs.where(~held), id_col, text_col, lang_col, sample, runs, run)
    if crf is None:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    @F.pandas_udf("string")
    def label(text):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(text.where(text.notna(), None), pa.string())], names=["text"])
        return pd.concat([b.column("lang_pred").to_pandas() for b in _labelled(sent, False)([batch])], ignore_index=True) if len(text) else pd.Series([], dtype=str)

    return docs.withColumn(out, label(F.col(text_col)))
