"""Simple-8b: sequences of unsigned integers in 64-bit words, in blocks that are coded and read back as arrays.

The four high bits of a word are its selector: how many values it holds in its other sixty bits, and how wide each is.
A word is filled exactly, so the last words of a block take the counts that its rest is made of. A value of 2**60 or more
stands as an escape: a word whose value is the place among the block's exceptions, which follow its words at full width.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Fixed values: (values in a word, bits of each), by selector. The first is a run of zeros, the last the escape.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (1, 60))
ESCAPE = 15
COUNT = np.array([c for c, _ in SELECTORS])
WIDTH = np.array([b for _, b in SELECTORS])
#: The first value that a selector is too narrow for.
LIMITS = np.array([1 << b for _, b in SELECTORS[:ESCAPE]], U)
#: Values of a block.
BLOCK = 1024


def _choices(values: np.ndarray, block: int) -> np.ndarray:
    """For each place, if a word began there: its selector, the fullest whose values fit and end inside the block."""
    n, blocks = len(values), -(-len(values) // block)
    need = np.full(blocks * block, 255, np.uint8)  # the narrowest selector for a value; past the end none
    need[:n] = np.searchsorted(LIMITS, values, "right")
    need = need.reshape(blocks, block)
    selector, widest = np.maximum(need, ESCAPE - 1), need
    for s in range(ESCAPE - 2, -1, -1):  # fuller words override
        for count in range(int(COUNT[s + 1]) + 1, int(COUNT[s]) + 1):
            if count > block:
                return selector.reshape(-1)
            widest = np.maximum(widest[:, :-1], need[:, count - 1 :])
        fits = widest <= s
        selector[:, : fits.shape[1]][fits] = s
        if not fits.any():
            break
    return selector.reshape(-1)


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, ends): the coded blocks one after the other, and per block its number of words and of exceptions.

    All blocks are walked at once: a step finds the next word of every block that isn't at its end.
    """
    values = np.ascontiguousarray(values, U)
    n, blocks = len(values), -(-len(values) // block)
    sizes = np.zeros((blocks, 2), np.uint32)
    if not n:
        return np.empty(0, U), sizes
    selector = _choices(values, block)
    step = COUNT[selector[:n]]
    ends = np.minimum(np.arange(1, blocks + 1) * block, n)
    at, begins = np.arange(blocks) * block, np.zeros(n, bool)
    while len(at):
        begins[at] = True
        at = at + step[at]
        inside = at < ends
        at, ends = at[inside], ends[inside]
    starts = np.flatnonzero(begins)
    chosen = selector[starts].astype(np.int64)
    words = chosen.astype(U) << U(60)
    for s in range(1, ESCAPE):
        mine = np.flatnonzero(chosen == s)
        count, bits = SELECTORS[s]
        for j in range(count if len(mine) else 0):
            words[mine] |= values[starts[mine] + j] << U(bits * j)
    home = starts // block
    held = np.bincount(home, minlength=blocks)
    escaped = np.flatnonzero(chosen == ESCAPE)
    extra = np.bincount(home[escaped], minlength=blocks)
    sizes[:, 0], sizes[:, 1] = held, extra
    if not len(escaped):
        return words, sizes
    before = np.cumsum(extra) - extra
    words[escaped] |= (np.arange(len(escaped)) - before[home[escaped]]).astype(U)
    out = np.empty(len(words) + len(escaped), U)
    out[np.arange(len(words)) + before[home]] = words
    first = np.cumsum(held) + before  # where a block's exceptions begin
    out[first[home[escaped]] + np.arange(len(escaped)) - before[home[escaped]]] = values[starts[escaped]]
    return out, sizes


def decode(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of whole blocks, given their words and sizes."""
    words, sizes = np.asarray(words, U), np.asarray(sizes, np.int64).reshape(-1, 2)
    held, extra = sizes[:, 0], sizes[:, 1]
    if extra.any():
        first = np.cumsum(held + extra) - held - extra
        coded = np.repeat(first - (np.cumsum(held) - held), held) + np.arange(int(held.sum()))
        exceptions, words = words, words[coded]
    chosen = (words >> U(60)).astype(np.int64)
    step = COUNT[chosen]
    at = np.cumsum(step) - step
    out = np.zeros(int(step.sum()), U)
    for s in range(1, ESCAPE):
        mine = np.flatnonzero(chosen == s)
        count, bits = SELECTORS[s]
        mask = U((1 << bits) - 1)
        for j in range(count if len(mine) else 0):
            out[at[mine] + j] = (words[mine] >> U(bits * j)) & mask
    escaped = np.flatnonzero(chosen == ESCAPE)
    if len(escaped):
        home = np.repeat(np.arange(len(held)), held)[escaped]
        out[at[escaped]] = exceptions[first[home] + held[home] + (words[escaped] & U((1 << 60) - 1)).astype(np.int64)]
    return out
