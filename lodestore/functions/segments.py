"""Texts cut into segments under a token budget: paragraphs, then sentences, then hard cuts, packed greedily.

Tokens are found once a text; counts and cuts are searches among their offsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Where paragraphs and sentences part, the share of what fits that a cut at a space must leave, and the budget where none is known.
PARAGRAPH, SENTENCE = re.compile(r"\n\s*\n+"), re.compile(r"(?<=[.!?。！？])\s+|\n+")
LEAST_FILL, FALLBACK_BUDGET = 0.6, 280
# End of fixed values.
#: Words and marks; a stand-in for an embedder's own tokens.
TOKEN = r"\w+|[^\w\s]"

Span = tuple[int, int]


class Measured:
    """A text with the offsets at which its tokens begin."""

    def __init__(self, text: str, token: str = TOKEN):
        self.text = text
        self.begin = np.array([m.start() for m in re.finditer(token, text, re.DOTALL)], np.int64)

    def count(self, span: Span) -> int:
        a, b = np.searchsorted(self.begin, span)
        return int(b - a)

    def between(self, pattern: re.Pattern, span: Span) -> Iterator[Span]:
        """The stretches between a pattern's matches, without blanks at their ends; blank ones go."""
        edges = [span[0], *(x for m in pattern.finditer(self.text, *span) for x in m.span()), span[1]]
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            piece = self.text[a:b]
            if piece.strip():
                yield a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())

    def cuts(self, span: Span, budget: int) -> Iterator[Span]:
        """A stretch in pieces that each hold the budget's tokens at most, cut back to a space where that costs little."""
        a, b = span
        while a < b:
            over = int(np.searchsorted(self.begin, a)) + budget
            stop = int(self.begin[over]) if over < len(self.begin) and self.begin[over] < b else b
            space = self.text.rfind(" ", a, stop) if stop < b else -1
            stop = space if space - a > LEAST_FILL * (stop - a) else stop
            yield from self.between(_NOWHERE, (a, stop))
            a = stop + len(self.text[stop:b]) - len(self.text[stop:b].lstrip())

    def units(self, budget: int) -> Iterator[Span]:
        """The largest of paragraphs, sentences and cut pieces that fit the budget, in order."""
        for paragraph in self.between(PARAGRAPH, (0, len(self.text))):
            fits = self.count(paragraph) <= budget
            for sentence in [paragraph] if fits else self.between(SENTENCE, paragraph):
                yield from [sentence] if fits or self.count(sentence) <= budget else self.cuts(sentence, budget)


_NOWHERE = re.compile(r"(?!)")


def segments(text: str | None, budget: int | None, token: str = TOKEN) -> list[str]:
    """Segments of at most `budget` tokens, a join costing one; the whole text without a budget, nothing for a blank one."""
    whole = (text or "").strip()
    if not whole:
        return []
    m = Measured(whole, token)
    if budget is None or len(m.begin) <= budget:
        return [whole]
    units = list(m.units(budget))
    cost = np.cumsum([0, *(m.count(u) + 1 for u in units)])
    out, i = [], 0
    while i < len(units):
        j = max(i + 1, int(np.searchsorted(cost, cost[i] + budget + 1, "right")) - 1)
        out.append("\n".join(whole[a:b] for a, b in units[i:j]))
        i = j
    return out


def segmented(text: Column, budget: int | None) -> Column:
    """The segments as an array, in Arrow batches."""
    return F.pandas_udf(lambda s: pd.Series([segments(t, budget) for t in s]), "array<string>")(text)


def segment_budget(reliable: Column, window: Column) -> Column:
    """The smaller of what an embedder embeds reliably and what its window holds; null if neither is known."""
    return F.least(reliable, window)
