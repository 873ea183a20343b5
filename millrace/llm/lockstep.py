"""Running one automaton over many chunks of a byte string at once.

The string is cut into chunks of equal length, one lane each. A lane begins a little before its chunk in
the start state; its state at the chunk's first byte is then a guess. When all lanes have run, the exit
state of each chunk is composed into the next: a lane whose guess was wrong runs again from the true state,
and so on until every entry equals the exit before it. The scan thus gives what one pass from left to right
would give, whatever the guesses were.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CHUNK = 1024
LEAD = 48
#: Bytes that fill the lanes well.
LANES_BYTES = 4 << 20


def scan(symbols: np.ndarray, start: int, step: Callable, reset: int, out_type: type) -> np.ndarray:
    """One output for each symbol. ``step(states, symbols) -> (states, outputs)`` works on whole lanes."""
    n = len(symbols)
    if not n:
        return np.zeros(0, out_type)
    lanes = -(-n // CHUNK)
    padded = np.full(lanes * CHUNK, reset, symbols.dtype)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    entry = np.full(lanes, start, np.int32)
    if lanes > 1:
        guess = entry[1:]
        for row in grid[CHUNK - LEAD :, :-1]:
            guess, _ = step(guess, row)
        entry[1:] = guess
    out = np.empty((CHUNK, lanes), out_type)
    exits = _run(grid, entry, step, out)
    while True:
        true = np.concatenate(([start], exits[:-1])).astype(np.int32)
        wrong = np.flatnonzero(true != entry)
        if not len(wrong):
            return np.ascontiguousarray(out.T).reshape(-1)[:n]
        entry[wrong] = true[wrong]
        again = np.empty((CHUNK, len(wrong)), out_type)
        exits[wrong] = _run(np.ascontiguousarray(grid[:, wrong]), entry[wrong], step, again)
        out[:, wrong] = again


def _run(grid: np.ndarray, states: np.ndarray, step: Callable, out: np.ndarray) -> np.ndarray:
    for t in range(len(grid)):
        states, out[t] = step(states, grid[t])
    return states
