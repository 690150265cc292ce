"""Weighted sums of the earlier lines within each line's window, in one pass over sorted lines and without pairs.

Lines come by conversation in their order.  A chunk's lines are compared with one another; the lines before it stand in runs sorted
by place, each with the sums from every line to the run's end, so that a window is one search in each run.  Runs of like
length are merged, so that there are few.  Lines that no later line of the conversation can reach are dropped.
Nothing is subtracted, so that sums of codes are as exact as those over pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# The code travels with the function, so that executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lines that are compared each with each.
CHUNK = 512


def first_within(at: np.ndarray, line: np.ndarray, window: np.ndarray) -> np.ndarray:
    """For each line the first of the sorted places with line - place < window, by that very comparison: line - window may be rounded."""
    k, last = np.searchsorted(at, line - window, "right"), len(at) - 1
    while True:
        before, here = at[np.maximum(k - 1, 0)], at[np.minimum(k, last)]
        down, up = (k > 0) & (line - before < window), (k <= last) & ~(line - here < window)
        if not (down | up).any():
            return k
        k = np.where(down, np.searchsorted(at, before, "left"), np.where(up, np.searchsorted(at, here, "right"), k))


class Runs:
    """Earlier lines of one class as sorted runs of places, values and sums to the end."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, at: np.ndarray, values: np.ndarray) -> None:
        real = ~np.isnan(at)
        at, values = at[real], values[real]
        if not len(at):
            return
        while self.runs and len(self.runs[-1][0]) <= 2 * len(at):
            more_at, more_values, _ = self.runs.pop()
            at, values = np.concatenate([more_at, at]), np.concatenate([more_values, values])
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
        sums = np.zeros((len(at) + 1, values.shape[1]))
        sums[:-1] = np.cumsum(values[::-1], axis=0)[::-1]
        self.runs.append((at, values, sums))

    def drop(self, low: float, window: float) -> None:
        """Forget what lies outside the window of every line from ``low`` on."""
        kept = []
        for at, values, sums in self.runs:
            k = int(first_within(at, np.array([low]), np.array([window]))[0])
            if 2 * k > len(at):
                at, values, sums = at[k:].copy(), values[k:].copy(), sums[k:].copy()
            if len(at):
                kept.append((at, values, sums))
        self.runs = kept

    def within(self, line: np.ndarray, window: np.ndarray) -> np.ndarray | float:
        return sum(sums[first_within(at, line, window)] for at, _, sums in self.runs)


def window_sums(values: list[str], windows: np.ndarray, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that adds ``__h0`` ...: for each line the weighted sums of ``values`` over its ground.

    Lines have ``__n`` (from 1 in each conversation, in which order they come), ``__at``, ``__low`` (the least ``__at`` from here on), and the
    classes ``__g`` and ``__r`` as ground and response, for which ``windows`` and ``weights`` are tables.
    """
    alike, group = np.unique(np.hstack([windows, weights]), axis=0, return_inverse=True)
    group = group.reshape(-1)
    windows, weights = np.hsplit(alike, 2)

    def chunk_sums(same: np.ndarray, at, g, r, v) -> np.ndarray:
        near = same & (at[:, None] - at[None, :] < windows[g[None, :], r[:, None]])
        w = near * weights[g[None, :], r[:, None]]
        if np.isfinite(v).all():
            return w @ v
        return np.stack([np.where(near, w * x[None, :], 0.0).sum(axis=1) for x in v.T], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        earlier: dict[int, Runs] = {}
        lower = np.tri(CHUNK, k=-1, dtype=bool)
        with np.errstate(invalid="ignore"):
            for batch in batches:
                n, at, low, g, r = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__n", "__at", "__low", "__g", "__r"))
                g = group[g]
                v = np.stack([pc.fill_null(batch.column(c), 0.0).to_numpy(zero_copy_only=False) for c in values], axis=1)
                h = np.zeros(v.shape)
                for begin in range(0, len(n), CHUNK):
                    part = slice(begin, min(begin + CHUNK, len(n)))
                    talk = np.cumsum(n[part] == 1)
                    m, same = len(talk), lower[: len(talk), : len(talk)]
                    if talk[-1] != talk[0]:
                        same = same & (talk[:, None] == talk[None, :])
                    h[part] = chunk_sums(same, at[part], g[part], r[part], v[part])
                    on = slice(begin, begin + int(np.searchsorted(talk, 1)))
                    if on.stop > begin:
                        for k, runs in earlier.items():
                            runs.drop(low[begin], windows[k].max())
                            if runs.runs:
                                h[on] += weights[k][r[on], None] * runs.within(at[on], windows[k][r[on]])
                    if talk[-1]:
                        earlier = {}
                    last = slice(begin + int(np.searchsorted(talk, talk[-1])), begin + m)
                    for k in np.unique(g[last]):
                        own = g[last] == k
                        earlier.setdefault(int(k), Runs()).add(at[last][own], v[last][own])
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x) for x in h.T]], names=[*batch.schema.names, *[f"__h{k}" for k in range(len(values))]])

    return run
