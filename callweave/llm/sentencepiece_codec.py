"""SentencePiece encoding and decoding by unigram Viterbi over a double-array trie of pieces.

The model file is read for its pieces, scores, types and flags; the best segmentation is the one whose piece scores
sum highest, whatever algorithm the file was made for.  A character without a piece costs the lowest score minus 10
and becomes its UTF-8 bytes if the model falls back to bytes, else the unknown id.  Of equal sums the one with the
longer last piece wins, at every prefix.

White space: with the model's flags, a space is put before the text and every space becomes the marker U+2581.  No
piece has a marker after another character (checked when a model is read), so no piece crosses the start of a word;
words are segmented apart and each different word of a batch once.  Walking the trie and the recursion run over all
these words together.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import chain, common
from callweave.llm.shingles import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Piece types of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_U = np.uint64
#: Characters segmented together.
ROOM = 1 << 20
#: Characters of different words that are segmented at once.
TABLE = 1 << 18


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n, at = number(at)
            value, at = raw[at : at + n], at + n
        yield key >> 3, value


@dataclass
class DoubleArray:
    """base and check over nodes; a child of s by code c stands at base[s] + c and has check = s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id or -1


def double_array(keys: dict[tuple[int, ...], int]) -> DoubleArray:
    """Places the nodes of a trie of code sequences (codes from 1), widest first, at the first base that fits."""
    children: dict[tuple[int, ...], list[int]] = {}
    for key in keys:
        for k in range(len(key)):
            children.setdefault(key[:k], []).append(key[k])
    kids = {p: np.unique(np.array(c)) for p, c in children.items()}
    most = max((int(c[-1]) for c in kids.values()), default=1)
    size = 2 * (sum(len(c) for c in kids.values()) + most + 2)
    used = np.zeros(size + most, dtype=bool)
    used[0] = True
    base, check, value = (np.full(size + most, -1, dtype=np.int32) for _ in range(3))
    slots: dict[tuple[int, ...], int] = {(): 0}
    spot: dict[tuple[int, ...], int] = {}
    low = 1
    for p, c in sorted(kids.items(), key=lambda x: (-len(x[1]), x[0])):
        while used[low]:
            low += 1
        # free places for the first child, tried together
        at, b, step = max(low, int(c[0])), -1, 64
        while b < 0:
            free = at + np.flatnonzero(~used[at : at + step])
            fits = free[~used[np.minimum((free - c[0])[:, None] + c, len(used) - 1)].any(1)] if len(c) > 1 else free
            b = int(fits[0] - c[0]) if len(fits) else -1
            at, step = at + step, min(4 * step, 1 << 14)
            if b < 0 and at >= size:
                raise ValueError("the trie does not fit")
        used[b + c] = True
        spot[p] = b
        for code in c.tolist():
            slots[(*p, code)] = b + code
    for p, b in spot.items():
        at = slots[p]
        base[at] = b
        check[b + kids[p]] = at
    for key, v in keys.items():
        value[slots[key]] = v
    return DoubleArray(base, check, value)


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    unknown: int
    byte_ids: np.ndarray | None  # id of each byte's piece
    prefix: bool
    code_of: np.ndarray  # sorted code points that pieces use; its position + 1 is the code
    trie: DoubleArray
    longest: int
    out: np.ndarray  # bytes of all pieces when decoded, one after another
    out_at: np.ndarray

    @property
    def unknown_score(self) -> float:
        normal = self.scores[self.types == NORMAL]
        return float(normal.min() if len(normal) else 0.0) - 10.0


def load(path: str = MODEL) -> Model:
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, types, trainer, normal = [], [], [], {}, {}
    for no, value in _fields(raw):
        if no == 1:
            x = dict(_fields(value))
            pieces.append(x.get(1, b"").decode())
            scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
            types.append(x.get(3, NORMAL))
        elif no == 2:
            trainer = dict(_fields(value))
        elif no == 3:
            normal = dict(_fields(value))
    if normal.get(1, b"identity") != b"identity" or normal.get(2):
        raise ValueError("only models with the identity normaliser are supported")
    if normal.get(4, 1) or not normal.get(5, 1):
        raise ValueError("only models that keep and mark all white space are supported")
    return model_of(pieces, scores, types, bool(trainer.get(35, 0)), bool(normal.get(3, 1)))


def model_of(pieces: list[str], scores: list[float], types: list[int], byte_fallback: bool, prefix: bool = True) -> Model:
    kinds = np.array(types)
    usable = [k for k, t in enumerate(types) if t in (NORMAL, USER) and pieces[k]]
    if any(MARK in pieces[k].lstrip(MARK) for k in usable):
        raise ValueError("a piece has a white-space marker after another character")
    code_of = np.array(sorted({ord(c) for k in usable for c in pieces[k]}), dtype=np.uint32)
    code = {int(c): n + 1 for n, c in enumerate(code_of)}
    trie = double_array({tuple(code[ord(c)] for c in pieces[k]): k for k in usable})
    bytes_of = None
    if byte_fallback:
        named = {pieces[k]: k for k, t in enumerate(types) if t == BYTE}
        bytes_of = np.array([named[f"<0x{b:02X}>"] for b in range(256)])
    out = [bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else p.replace(MARK, " ").encode() for p, t in zip(pieces, types)]
    return Model(pieces, np.array(scores), kinds, next((k for k, t in enumerate(types) if t == UNKNOWN), 0), bytes_of, prefix, code_of, trie, max((len(pieces[k]) for k in usable), default=1), np.frombuffer(b"".join(out), dtype=np.uint8), np.cumsum([0] + [len(x) for x in out]))


def _segment(model: Model, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words, one word after another, and how many each has.  Words tile points."""
    n = len(points)
    at = np.minimum(np.searchsorted(model.code_of, points), len(model.code_of) - 1)
    code = np.where(model.code_of[at] == points, at + 1, 0).astype(np.int64)
    end = np.repeat(start + length, length)
    # score[k - 1, e]: of the piece of k characters that ends before position e
    top = min(model.longest, int(length.max()))
    score = np.full((top, n + 1), -np.inf)
    piece = np.full((top, n + 1), -1, dtype=np.int32)
    pos, node = np.arange(n), np.zeros(n, dtype=np.int64)
    for k in range(1, top + 1):
        live = pos + k <= end[pos]
        pos, node = pos[live], node[live]
        c = code[pos + k - 1]
        to = model.trie.base[node] + c
        ok = (c > 0) & (model.trie.base[node] >= 0)
        to = np.where(ok, to, 0)
        ok &= (to < len(model.trie.check)) & (model.trie.check[np.minimum(to, len(model.trie.check) - 1)] == node)
        pos, node = pos[ok], to[ok]
        found = model.trie.value[node]
        hit = found >= 0
        score[k - 1, pos[hit] + k] = model.scores[found[hit]]
        piece[k - 1, pos[hit] + k] = found[hit]
    bare = piece[0, 1:] < 0
    score[0, 1:][bare] = model.unknown_score
    took = np.ones(n + 1, dtype=np.int32)
    order = np.argsort(-length, kind="stable")
    first = start[order]
    prefix = np.zeros(n)  # best of the prefix that ends with this character
    for j, live in enumerate(chain.running(length[order])):
        e = first[:live] + j + 1
        value, kk = np.full(live, -np.inf), np.ones(live, dtype=np.int32)
        for k in range(min(top, j + 1), 0, -1):
            before = prefix[e - k - 1] if k <= j else 0.0
            v = before + score[k - 1, e]
            more = v > value
            value[more] = v[more]
            kk[more] = k
        prefix[e - 1] = value
        took[e] = kk
    begins = np.zeros(n, dtype=bool)
    ids = np.full(n, -1, dtype=np.int64)
    where, stop = start + length, start
    while len(where):
        k = took[where]
        begins[where - k] = True
        ids[where - k] = piece[k - 1, where]
        where = where - k
        on = where > stop
        where, stop = where[on], stop[on]
    word = np.repeat(np.arange(len(start)), length)
    which, got, owner = np.flatnonzero(begins), ids[begins], word[begins]
    count = np.ones(len(got), dtype=np.int64)
    if model.byte_ids is None:
        return np.where(got < 0, model.unknown, got), np.bincount(owner, minlength=len(start))
    lost = got < 0
    p = points[which].astype(np.int64)
    width = 1 + (p > 0x7F) + (p > 0x7FF) + (p > 0xFFFF)
    count[lost] = width[lost]
    flat = np.repeat(got, count)
    base = np.cumsum(count) - count
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for b in range(4):
        some = lost & (width > b)
        byte = (p >> (6 * np.maximum(width - 1 - b, 0))) & 0x3F | 0x80
        if b == 0:
            byte = np.where(width == 1, p, (p >> (6 * (width - 1))) | lead[width])
        flat[base[some] + b] = model.byte_ids[byte[some]]
    return flat, np.bincount(owner, weights=count, minlength=len(start)).astype(np.int64)


def encode(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids of all texts and how many each has; null and empty texts have none."""
    marked = [((MARK if model.prefix else "") + t.replace(" ", MARK)) if t else "" for t in texts]
    sizes = np.array([len(t) for t in marked], dtype=np.int64)
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    is_mark = points == ord(MARK)
    begin = is_mark.copy()
    begin[1:] &= ~is_mark[:-1]
    text_at = (np.cumsum(sizes) - sizes)[sizes > 0]
    begin[text_at] = True
    start = np.flatnonzero(begin)
    length = np.diff(np.append(start, len(points)))
    # equal words have equal sums of mixed (character, place) pairs; two different ones do with chance 2^-64
    place = (np.arange(len(points)) - np.repeat(start, length)).astype(np.uint64)
    total = np.add.reduceat(mix(points.astype(np.uint64) | (place << _U(21))), start) + mix(length.astype(np.uint64))
    _, seen, which = np.unique(total, return_index=True, return_inverse=True)
    found = []
    # some of the different words at a time: the table of piece scores holds that many characters, or one longer word
    n = length[seen]
    for some in np.split(np.arange(len(seen)), np.flatnonzero(np.diff((np.cumsum(n) - 1) // TABLE)) + 1):
        own, k = chain.gather(start, length, seen[some]), n[some]
        found.append(_segment(model, points[own], np.cumsum(k) - k, k))
    ids, count = (np.concatenate(x) for x in zip(*found))
    flat = ids[chain.gather(np.cumsum(count) - count, count, which)]
    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    return flat.astype(np.int32), np.bincount(owner, weights=count[which], minlength=len(texts)).astype(np.int64)


def decode(model: Model, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """UTF-8 of the texts: pieces joined, markers as spaces, byte pieces as bytes, the space before the text dropped."""
    n = np.diff(model.out_at)
    raw = model.out[chain.gather(model.out_at[:-1], n, ids)].tobytes()
    end = np.cumsum(np.append(0, n[ids]))[np.append(0, np.cumsum(counts))]
    out = [raw[a:b] for a, b in zip(end, end[1:])]
    return [x[1:] if model.prefix and x[:1] == b" " else x for x in out]


def _encoded(sent):
    def run(batches):
        for batch in common.trimmed(batches):
            m = sent.value
            for lo, part in common.some_texts(batch.column(1), ROOM):
                ids, counts = encode(m, part)
                back = decode(m, ids, counts)
                same = [b == (t or "").encode("utf-8", "surrogatepass") for b, t in zip(back, part)]
                pieces = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.array(counts), pieces, pa.array(same)], names=["doc_id", "n_pieces", "ids", "round_trip"])

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """One row per input row: doc_id, n_pieces, ids, round_trip (decoding gives the text back).

    Null and empty texts have no pieces; a null's round trip is the empty text and counts as true.  A text that
    holds the marker U+2581 itself decodes to a space there, so its round_trip is false.  Special pieces in a text
    are ordinary text.  Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(model_path))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(sent), "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with piece ids (null: empty); bytes that are not UTF-8 become U+FFFD."""
    sent = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches):
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            back = decode(sent.value, np.array([i for x in lists for i in x], dtype=np.int64), np.array([len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.decode("utf-8", "replace") for b in back], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
