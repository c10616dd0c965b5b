"""Finite-state machines over byte buffers, run in chunks whose state transitions compose."""

from __future__ import annotations

import numpy as np


class Machine:
    """A deterministic machine of at most 256 states.

    ``step[state, class]`` is the next state and ``classes[byte]`` a byte's class. ``run`` cuts the buffer into equal
    chunks and advances all chunks together, one byte at a time, from every possible state at once: that gives each
    chunk's transition as a function from state to state. Composing these functions in order gives the state at each
    chunk's start, and a second pass from there the state after each byte. Records start in state 0: the function of
    a byte that opens a record is constant, so no record depends on its neighbours and a chunk may cut one anywhere.
    """

    def __init__(self, step: np.ndarray, classes: np.ndarray) -> None:
        self.step = step.astype(np.uint8)
        self.classes = classes.astype(np.uint8)

    def run(self, data: np.ndarray, starts: np.ndarray, chunk: int = 512) -> np.ndarray:
        """State after each byte of ``data``; ``starts`` are the offsets at which records begin."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint8)
        s, k = self.step.shape
        # Twice the classes: the upper half reads the byte as the first of a record.
        table = np.concatenate([self.step, np.broadcast_to(self.step[0], (s, k))], axis=1)
        codes = self.classes[data]
        codes[starts[starts < n]] += k
        rows = -(-n // chunk)
        padded = np.zeros(rows * chunk, np.uint8)
        padded[:n] = codes
        columns = np.ascontiguousarray(padded.reshape(rows, chunk).T)
        flat, width = np.ascontiguousarray(table.T).ravel(), s
        ends = np.tile(np.arange(s, dtype=np.uint8)[:, None], (1, rows))
        for column in columns:
            ends = flat[column.astype(np.int32) * width + ends]
        at = np.zeros(rows, np.uint8)
        state = 0
        for i, after in enumerate(ends.T.tolist()):
            at[i] = state
            state = after[state]
        out = np.empty((chunk, rows), np.uint8)
        for j, column in enumerate(columns):
            at = flat[column.astype(np.int32) * width + at]
            out[j] = at
        return out.T.ravel()[:n]


def machine(states: int, alphabet: dict[str, bytes], rules: dict[tuple[int, str], int], default: dict[int, int]) -> Machine:
    """A machine from readable parts: named byte sets, ``(state, name) -> state`` and each state's ``default``; a byte in no set is ``other``."""
    names = ["other", *alphabet]
    classes = np.zeros(256, np.uint8)
    for i, name in enumerate(alphabet, 1):
        classes[list(alphabet[name])] = i
    step = np.array([[rules.get((s, name), default[s]) for name in names] for s in range(states)])
    return Machine(step, classes)
