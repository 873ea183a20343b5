"""Counts that a transducer emits over a long string, by state maps of its chunks and a parallel prefix scan.

The string is cut into chunks of equal length. A chunk's state map tells, for each entry state, the exit state and
the count emitted between. Entry states are taken from a run over the symbols before the chunk; where such a run
crosses a place that resets the transducer, no other state can come. Every exit of a chunk that the next chunk's
map lacks is added to it, for all chunks at once, until the maps are closed under succession. Then maps compose:
a prefix scan doubles the reach of each in every step, and applying the scanned maps to the start state gives each
chunk's true entry and the count before it, whatever the first guesses were.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from millrace.llm.lockstep import CHUNK, LEAD


def _run(grid: np.ndarray, states: np.ndarray, step: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(exit states, counts after each symbol) of all lanes of ``grid`` from ``states``."""
    out = np.empty(grid.shape, np.int8)
    for t in range(len(grid)):
        states, out[t] = step(states, grid[t])
    return states, np.cumsum(out, axis=0, dtype=np.int32)


def closed_maps(grid: np.ndarray, start: int, step: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries, to, counts, within): maps of all lanes, a row for each entry state, -1 where a lane has fewer.

    ``to`` is the row of the next lane's map that an entry's exit is; ``within`` holds the counts after each symbol
    from the entries of row 0.
    """
    lanes = grid.shape[1]
    guess = np.full(lanes, start, np.int32)
    if lanes > 1:
        late = guess[1:]
        for row in grid[CHUNK - LEAD :, :-1]:
            late, _ = step(late, row)
        guess[1:] = late
    left, within = _run(grid, guess, step)
    entries, exits, counts = guess[None], left[None].astype(np.int32), within[-1][None]
    while True:
        same = entries[:, None, 1:] == exits[None, :, :-1]
        lacks = (exits[:, :-1] >= 0) & ~same.any(axis=0)
        which = np.flatnonzero(lacks.any(axis=0))
        if not len(which):
            to = np.zeros(exits.shape, np.int64)
            to[:, :-1] = same.argmax(axis=0)
            return entries, to, counts, within
        more = exits[lacks.argmax(axis=0)[which], which]
        left, found = _run(np.ascontiguousarray(grid[:, which + 1]), more, step)
        row = np.full((3, 1, lanes), -1, np.int32)
        row[:, 0, which + 1] = more, left, found[-1]
        entries, exits, counts = (np.concatenate(pair) for pair in zip((entries, exits, counts), row, strict=True))


def scanned(to: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, before): for each lane the row of its map that is true and the count emitted before it."""
    to, counts = to.copy(), counts.astype(np.int64)
    lanes, reach = to.shape[1], 1
    while reach < lanes:
        first = to[:, :-reach]
        to_, counts_ = to.copy(), counts.copy()
        to_[:, reach:] = np.take_along_axis(to[:, reach:], first, axis=0)
        counts_[:, reach:] = counts[:, :-reach] + np.take_along_axis(counts[:, reach:], first, axis=0)
        to, counts, reach = to_, counts_, 2 * reach
    return np.concatenate([[0], to[0, :-1]]), np.concatenate([[0], counts[0, :-1]])


def totals(symbols: np.ndarray, stops: np.ndarray, start: int, step: Callable, reset: int) -> np.ndarray:
    """The count emitted by the first ``stop`` symbols, for each of ``stops`` (1 at least)."""
    n = len(symbols)
    if not n:
        return np.zeros(len(stops), np.int64)
    lanes = -(-n // CHUNK)
    padded = np.full(lanes * CHUNK, reset, symbols.dtype)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    entries, to, counts, within = closed_maps(grid, start, step)
    row, before = scanned(to, counts)
    other = np.flatnonzero(row)
    if len(other):
        within[:, other] = _run(np.ascontiguousarray(grid[:, other]), entries[row[other], other], step)[1]
    lane, at = np.divmod(np.asarray(stops, np.int64) - 1, CHUNK)
    return before[lane] + within[at, lane]
