"""Hidden Markov language model: corpus-wide counts, distributed Baum-Welch, exact scaled forward scores.

Words.  A token is a word (A-Z lower-cased) or the end of a text.  Counts cover all training texts and stay a
distributed table, keyed by a 64-bit hash of the word.  A word that makes up at least 1/65536 of the tokens is a
head word; there are at most 65,536 of them, which bounds what the tasks get by broadcast.  All other words are
looked up by a join, once for each (document, different word).

States.  The hidden states emit word classes: each word with at least 1/2048 of the tokens is a class of its own
(at most 2,048), the rest share 256 classes by length and last byte, and a shared class emits its words by their
smoothed counts.  So log10 P(text) is the forward likelihood of the class chain plus, for each word of a shared
class, log10((c + 0.1) / (n + 0.1 (v + 1))) with the class's tokens n and distinct words v.

Training.  Each Baum-Welch round runs forward-backward over all training texts; a task adds up its own expected
counts, in fixed point so that their sum does not depend on the order, and only parameter-sized sums meet.  Without
training texts the model stays the initial one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import chain, common
from callweave.llm.shingles import mix, word_spans

HEAD, OWN, SHARED = 65_536, 2_048, 256
STATES, ROUNDS = 8, 6
SMOOTH = 0.1
_FIXED = float(1 << 20)
#: Characters of texts that a task holds at once, and tokens whose counts it looks up at once (a longer text is one).
ROOM, LOOKED = 1 << 23, 1 << 17
END = int(mix(np.array([0xE0F], dtype=np.uint64)).view(np.int64)[0])


def _tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (int64, the end included) and shared-class numbers of a text's tokens."""
    h, start, end, raw = word_spans(text)
    shared = np.empty(len(h) + 1, dtype=np.uint16)
    if len(h):
        # a continuation byte says little about the ending: its low four bits and the length are the class
        shared[:-1] = np.minimum(end - start, 16).astype(np.uint16) * 16 - 16 + (raw[end - 1] & 15)
    shared[-1] = 0
    return np.append(h.view(np.int64), END), shared


def _flat(texts: list[str | None]):
    parts = [_tokens(t) for t in texts]
    lengths = np.array([len(p[0]) for p in parts], dtype=np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), lengths


def _counts(batches):
    for batch in common.trimmed(batches):
        for _, texts in common.some_texts(batch.column(0), ROOM // 2):
            h, shared, _ = _flat(texts)
            word, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(shared[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "shared", "n"])


@dataclass
class Vocabulary:
    """What the tasks need of the counts: bounded by HEAD, OWN and SHARED."""

    tokens: int
    distinct: int
    head: np.ndarray  # sorted hashes
    head_n: np.ndarray
    head_class: np.ndarray  # own class, or -1
    own: int
    shared_log: np.ndarray  # log10 of n + 0.1 (v + 1) for each shared class

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions in head, -1 for other words."""
        if not len(self.head):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, at, -1)

    def classes(self, at: np.ndarray, shared: np.ndarray) -> np.ndarray:
        own = np.where(at >= 0, self.head_class[at] if len(self.head) else -1, -1)
        return np.where(own >= 0, own, self.own + shared).astype(np.uint16)


def vocabulary(words: DataFrame) -> Vocabulary:
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = int(total["n"] or 0), int(total["v"])
    head = words.where(F.col("n") * HEAD >= n).select("word", "n").toPandas().sort_values("word")
    rest = words.where(F.col("n") * OWN < n).groupBy("shared").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    is_own = (head["n"].to_numpy() * OWN >= n) if len(head) else np.zeros(0, bool)
    log = np.full(SHARED, np.log10(SMOOTH))
    for s, a, b in rest.itertuples(index=False):
        log[int(s)] = np.log10(a + SMOOTH * (b + 1))
    return Vocabulary(n, v, head["word"].to_numpy(np.int64), head["n"].to_numpy(np.int64), np.where(is_own, np.cumsum(is_own) - 1, -1), int(is_own.sum()), log)


@dataclass
class Model:
    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class x state


def initial(classes: int, states: int = STATES, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    emit = rng.gamma(1.0, size=(classes, states)) + 0.05
    move = rng.gamma(1.0, size=(states, states)) + 0.2 + 4 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def expected_counts(model: Model, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, float]:
    """Flat expected counts (first, move, emit) and the log likelihood of the chains."""
    k = len(model.first)
    offsets = np.cumsum(lengths) - lengths
    first, move, emit, log = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
    table, start, go = (x.astype(np.float32) for x in (model.emit, model.first, model.move))
    for part in chain.chunks(lengths, 1 << 19):
        place, step = chain.time_order(lengths[part])
        own = np.empty(len(place), dtype=np.int64)
        own[place] = classes[chain.gather(offsets, lengths, part)]
        e = table[own]
        gamma, scale = chain.forward(step, e, start, go)
        move += chain.backward(step, e, go, gamma, scale)
        first += gamma[: step[1]].sum(0)
        for s in range(k):
            emit[:, s] += np.bincount(own, weights=gamma[:, s], minlength=len(emit))
        log += float(np.log(scale.astype(np.float64)).sum())
    return np.concatenate([first, move.ravel(), emit.ravel()]), log


def maximised(counts: np.ndarray, classes: int, states: int) -> Model:
    first, move, emit = counts[:states] + 0.1, counts[states : states + states**2].reshape(states, states) + 0.1, counts[states + states**2 :].reshape(classes, states) + 0.01
    return Model(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _as_classes(vocab):
    def run(batches):
        for batch in common.trimmed(batches):
            for _, texts in common.some_texts(batch.column(0), ROOM):
                out = []
                for t in texts:
                    h, shared = _tokens(t)
                    out.append(vocab.value.classes(vocab.value.find(h), shared).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["classes"])

    return run


def _expected(model):
    def run(batches):
        total, log = None, 0.0
        for batch in common.trimmed(batches):
            raw = batch.column(0).to_pylist()
            if raw:
                counts, ll = expected_counts(model.value, np.frombuffer(b"".join(raw), dtype=np.uint16), np.array([len(x) // 2 for x in raw], dtype=np.int64))
                total, log = counts if total is None else total + counts, log + ll
        if total is not None:
            at = np.flatnonzero(total)
            idx, val = np.append(at, -1), np.append(total[at], log)
            yield pa.RecordBatch.from_arrays([pa.array(idx.astype(np.int32)), pa.array(np.round(val * _FIXED).astype(np.int64))], names=["i", "v"])

    return run


def train(chains: DataFrame, classes: int, states: int = STATES, rounds: int = ROUNDS, seed: int = 5) -> tuple[Model, list[float]]:
    """Baum-Welch over a table of class chains; also the training log likelihood before each round."""
    model, logs = initial(classes, states, seed), []
    sc = chains.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast(model)
        sums = chains.mapInArrow(_expected(sent), "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(30,0)")).cast("double").alias("v")).toPandas()
        sent.unpersist()
        if sums.empty:
            break  # no chains, so no counts to maximise on
        counts = np.zeros(states + states**2 + classes * states)
        at, val = sums["i"].to_numpy(), sums["v"].to_numpy(float) / _FIXED
        counts[at[at >= 0]] = val[at >= 0]
        logs.append(float(val[at < 0].sum()))
        model = maximised(counts, classes, states)
    return model, logs


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_rest long, known long, base double, log double, word long, tf long"


def _scored(vocab, model):
    names = [f.split()[0] for f in _SCORED.split(", ")]

    def run(batches):
        for batch in common.trimmed(batches):
            v, m = vocab.value, model.value
            for lo, texts in common.some_texts(batch.column(3), ROOM):
                rows, ids, held = (batch.column(k).slice(lo, len(texts)) for k in range(3))
                h, shared, lengths = _flat(texts)
                end = np.cumsum(lengths)
                at, cls = np.empty(len(h), dtype=np.int32), np.empty(len(h), dtype=np.uint16)
                for k in range(0, len(h), LOOKED):
                    here = slice(k, k + LOOKED)
                    at[here] = v.find(h[here])
                    cls[here] = v.classes(at[here], shared[here])
                log = np.zeros(len(lengths))
                for part in chain.chunks(lengths):
                    place, step = chain.time_order(lengths[part])
                    own = np.empty(len(place), dtype=np.int64)
                    own[place] = cls[chain.gather(end - lengths, lengths, part)]
                    log[part] = chain.log_likelihoods(step, chain.forward(step, m.emit[own], m.first, m.move, keep=False)[1])
                log /= np.log(10)
                first = 0
                while first < len(lengths):
                    begin = end[first] - lengths[first]
                    last = max(first + 1, int(np.searchsorted(end, begin + LOOKED, side="right")))
                    here, mine = slice(begin, end[last - 1]), slice(first, last)
                    n, first = last - first, last
                    doc, in_head = np.repeat(np.arange(n), lengths[mine]), at[here] >= 0
                    base = np.where(in_head, np.log10(np.maximum(v.head_n[at[here]] if len(v.head) else 0, 1) + SMOOTH), 0.0)
                    is_shared = cls[here] >= v.own
                    inside = np.where(is_shared, base - v.shared_log[np.where(is_shared, cls[here] - v.own, 0)], 0.0)
                    rest = ~in_head
                    of, none = rows.slice(mine.start, n), pa.nulls(n, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        of, ids.slice(mine.start, n), held.slice(mine.start, n), pa.array(lengths[mine]),
                        pa.array(np.bincount(doc[rest], minlength=n).astype(np.int64)), pa.array(np.bincount(doc[in_head], minlength=n).astype(np.int64)),
                        pa.array(np.bincount(doc, weights=base, minlength=n)), pa.array(log[mine] + np.bincount(doc, weights=inside, minlength=n)), none, none,
                    ], names=names)
                    # words that need a lookup: one row for each different word of a document
                    d, w = doc[rest], h[here][rest]
                    if len(d):
                        order = np.lexsort((w, d))
                        d, w = d[order], w[order]
                        cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])])
                        tf = np.diff(np.append(cut, len(d)))
                        k = len(cut)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(of.to_numpy()[d[cut]]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                            pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(w[cut]), pa.array(tf.astype(np.int64)),
                        ], names=names)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(id as text) modulo `folds` is not 0 (a null id counts as the empty text, whose
    remainder is 0).  Null texts are empty: one token, the end.  Rows that repeat an id are scored each; equal texts
    get equal scores.  Without training rows every word is unknown and the model is the initial one.  Other columns
    are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    held = F.coalesce(common.fold(F.col(id_col), folds) == 0, F.lit(True))
    train_rows = docs.where(~held).select(F.col(text_col).alias("text"))
    words = common.stored(train_rows.mapInArrow(_counts, "word long, shared int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.min("shared").alias("shared")), "words")
    vocab = vocabulary(words)
    sent = sc.broadcast(vocab)
    chains = common.stored(train_rows.mapInArrow(_as_classes(sent), "classes binary"), "chains")
    model, _ = train(chains, vocab.own + SHARED, states, rounds)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scored(sent, sc.broadcast(model)), _SCORED)
    # rows without a word look up a key of their own, which spreads them
    key = F.coalesce("word", F.col("row"))
    looked = scored.withColumn("_w", key).join(words.select(F.col("word").alias("_w"), F.col("n").alias("_n")), "_w", "left")
    c = F.coalesce("_n", F.lit(0))
    is_word = F.col("word").isNotNull()
    out = looked.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("n_rest").alias("n_rest"), F.max("known").alias("known"), F.max("base").alias("base"), F.max("log").alias("log"),
        F.coalesce(F.sum(F.when(is_word & (c > 0), F.col("tf"))), F.lit(0)).alias("more"),
        F.coalesce(F.sum(F.when(is_word, F.col("tf") * F.log10(c + SMOOTH))), F.lit(0.0)).alias("sum"),
    )
    whole = F.log10(F.lit(vocab.tokens + SMOOTH * (vocab.distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("sum") - F.col("n_tokens") * whole).alias("base_score"), (F.col("log") + F.col("sum")).alias("score"),
    )
