"""Scaled forward and backward recursions over many label chains at once (numpy only).

Chains lie one after another in flat arrays.  Sorted by falling length, the chains that are still running at step t
are the first ones.  The recursions work on arrays in time order: all first items, then all second items, and so on, so
a step is one matrix operation on a contiguous slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def chunks(lengths: np.ndarray, room: int = 1 << 18) -> Iterator[np.ndarray]:
    """Chain numbers by falling length, in parts of about `room` items (a longer chain is a part of its own)."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    end = np.cumsum(lengths[order])
    first = 0
    while first < len(order):
        base = end[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(end, base + room, side="right")))
        yield order[first:last]
        first = last


def gather(offsets: np.ndarray, lengths: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Indices into the flat array of all items of the chains in `part`, chain after chain."""
    n = lengths[part]
    start = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(offsets[part] - start, n)


def running(lengths: np.ndarray) -> np.ndarray:
    """For each step the number of chains (by falling length) that have it."""
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), side="right")


def time_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each item of the chains (by falling length) stands in time order, and where each step begins."""
    step = np.append(0, np.cumsum(running(lengths)))
    rank = np.repeat(np.arange(len(lengths)), lengths)
    t = np.arange(len(rank)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return step[t] + rank, step


def forward(step: np.ndarray, emit: np.ndarray, first: np.ndarray, move: np.ndarray, keep: bool = True):
    """alpha (scaled to sum 1 per item; None unless kept) and the scale of every item, in time order.

    emit: a row of non-negative weights per item, in time order; first, move: start and transition weights.
    """
    alpha = np.empty_like(emit) if keep else None
    scale = np.empty(len(emit), dtype=emit.dtype)
    state = None
    for t in range(len(step) - 1):
        lo, hi = step[t], step[t + 1]
        state = emit[lo:hi] * (first if t == 0 else state[: hi - lo] @ move)
        c = state.sum(1)
        state /= c[:, None]
        scale[lo:hi] = c
        if keep:
            alpha[lo:hi] = state
    return alpha, scale


def log_likelihoods(step: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The log likelihood of each chain from the scales."""
    rank = np.arange(len(scale)) - np.repeat(step[:-1], np.diff(step))
    return np.bincount(rank, weights=np.log(scale.astype(np.float64)))


def backward(step: np.ndarray, emit: np.ndarray, move: np.ndarray, alpha: np.ndarray, scale: np.ndarray):
    """Turns alpha into the posteriors of all items, in place; returns the summed expected transition counts."""
    pairs = np.zeros(move.shape)
    ahead = emit / scale[:, None]
    back = np.ascontiguousarray(move.T)
    beta = np.ones((step[1] if len(step) > 1 else 0, move.shape[0]), dtype=emit.dtype)
    for t in range(len(step) - 2, 0, -1):
        lo, hi = step[t], step[t + 1]
        n = hi - lo
        w = ahead[lo:hi] * beta[:n]
        before = alpha[step[t - 1] : step[t - 1] + n]
        pairs += before.T @ w
        beta[:n] = w @ back
        before *= beta[:n]
    return pairs * move
