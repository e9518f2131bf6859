"""Inverted lists walked in sorted order, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class Pairs:
    """Index pairs i < j of rows that stand in one short list."""

    rows: np.ndarray
    i: np.ndarray
    j: np.ndarray


@dataclass
class LongPart:
    """Rows start..stop-1 of one long list; those from ``fresh`` on were not given before."""

    rows: np.ndarray
    start: int
    stop: int
    fresh: int


def walk_lists(batches: Iterable[pa.RecordBatch], width: int, short: int, head: Callable[[np.ndarray, int, int], int]) -> Iterator[Pairs | LongPart]:
    """Pairs and parts of the lists in ``batches``, ``width`` integer columns sorted by the first.

    Rows with equal first columns are a list. A list of at most ``short`` rows gives all
    its pairs. A longer one may span any number of batches and comes in parts; between
    them only one row is kept, the one that ``head(rows, start, stop)`` names, and it begins
    the next part."""

    def short_lists(rows, usable, of_list):
        n = rows.shape[1]
        for d in range(1, min(short, n)):
            i = np.flatnonzero(usable[: n - d] & (of_list[: n - d] == of_list[d:]))
            if not len(i):
                break
            yield Pairs(rows, i, i + d)

    carry, in_long = np.zeros((width, 0), np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        before, was_long = carry.shape[1], in_long
        rows = np.concatenate((carry, np.stack([batch.column(i).to_numpy() for i in range(width)]).astype(np.int64)), axis=1)
        key = rows[0]
        cut = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        size = np.diff(cut)
        is_long = size > short
        is_long[0] |= was_long and size[0] > before
        for r in np.flatnonzero(is_long):
            a, b = int(cut[r]), int(cut[r + 1])
            yield LongPart(rows, a, b, before if r == 0 and was_long else a)
        of_list = np.repeat(np.arange(len(size)), size)
        done = np.arange(len(size)) < len(size) - 1
        yield from short_lists(rows, (done & ~is_long & (size > 1))[of_list], of_list)
        in_long = bool(is_long[-1])
        if in_long:
            at = head(rows, int(cut[-2]), int(cut[-1]))
            carry = rows[:, at : at + 1].copy()
        else:
            carry = rows[:, cut[-2] :].copy()
    if not in_long and carry.shape[1] > 1:
        yield from short_lists(carry, np.ones(carry.shape[1], bool), np.zeros(carry.shape[1], np.int64))
