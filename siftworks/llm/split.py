"""Splitting oversized items at natural boundaries with a sparse-table range-maximum index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import ship
from .tokens import PYTHON_TOKEN, token_count

#: Boundary strengths, from the gap between two tokens.
PAGE, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, NONE = 6, 5, 4, 3, 2, 1, 0

_TOKEN = re.compile(PYTHON_TOKEN)
_SENTENCE_END = frozenset(".!?…。！？")
_CLAUSE_END = frozenset(",;:)]}»”–—")
_CLOSERS = frozenset("\"'”’)]»")
SCHEMA = "piece_no int, n_pieces int, start_token bigint, end_token bigint, start_char bigint, end_char bigint, strength int"


def boundary_strengths(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each token the strength of a cut right after it, 0 where no white space follows."""
    out = np.zeros(len(starts), np.int8)
    if not len(starts):
        return out
    spaced = np.flatnonzero(starts[1:] > ends[:-1])
    out[spaced] = WORD
    for i in spaced.tolist():
        gap = text[ends[i] : starts[i + 1]]
        if "\f" in gap:
            out[i] = PAGE
        elif gap != " " and (lines := gap.count("\n") or gap.count("\r") or gap.count(" ")):
            out[i] = PARAGRAPH if lines > 1 or " " in gap else LINE
        else:
            last = text[ends[i] - 1]
            if last in _CLOSERS and i and ends[i - 1] == starts[i]:
                last = text[ends[i - 1] - 1] if text[ends[i - 1] - 1] in _SENTENCE_END else last
            if last in _SENTENCE_END:
                out[i] = SENTENCE
            elif last in _CLAUSE_END:
                out[i] = CLAUSE
    out[-1] = PAGE
    return out


class RangeMaximum:
    """Sparse table over ``values``: the rightmost maximum of any window of at most ``widest`` entries in constant time."""

    def __init__(self, values: np.ndarray, widest: int):
        keys = values.astype(np.int64) << 40 | np.arange(len(values))
        self.levels = [keys]
        width = 1
        while width * 2 <= min(widest, len(values)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def rightmost(self, low: int, high: int) -> int:
        """Position of the rightmost maximum in ``[low, high]``."""
        k = (high - low + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[low], level[high - (1 << k) + 1]) & ((1 << 40) - 1))


def cuts(strengths: np.ndarray, limit: int, overlap: int, least_fill: float) -> list[tuple[int, int, int]]:
    """``(start, end, strength)`` of the pieces in tokens, ``end`` exclusive.

    Each piece ends at the strongest boundary whose piece has between ``least_fill * limit`` and ``limit`` tokens, the
    rightmost of equals; the next piece starts ``overlap`` tokens before that end.
    """
    n, start, out = len(strengths), 0, []
    least = max(overlap + 1, int(limit * least_fill))
    index = RangeMaximum(strengths, limit)
    while n - start > limit:
        at = index.rightmost(start + least - 1, start + limit - 1)
        out.append((start, at + 1, int(strengths[at])))
        start = at + 1 - overlap
    out.append((start, n, PAGE))
    return out


def split_documents(docs: DataFrame, limit: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, least_fill: float = 0.5) -> DataFrame:
    """One row per piece of each document with more than ``limit`` tokens; smaller documents have no row.

    Columns: the id, ``piece_no`` from 0, ``n_pieces``, token and character range (ends exclusive), ``strength`` of the
    boundary at its end, and ``text`` if ``with_text``. A piece has at most ``limit`` tokens; each piece but the first
    begins with the last ``overlap`` tokens of the one before. Piece texts run from the first to the last token of the
    piece, so white space between two pieces belongs to neither.

    The test for size is a JVM expression; only oversized texts go to Python, one at a time within Arrow batches, with no
    shuffle. Per text, the strengths of all gaps are indexed by a sparse table with log2(limit) levels of 8 bytes a token.

    NULL, empty and blank texts have no tokens and no row; repeated ids are split one by one; other columns, whatever
    their names, are not read. ``overlap`` must lie below ``least_fill * limit``.
    """
    if not 0 <= overlap < limit * least_fill or not 0 < least_fill <= 1:
        raise ValueError("overlap must be at least 0 and below least_fill * limit")
    ship(docs.sparkSession)
    large = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.length("_text") > limit).where(token_count(F.col("_text")) > limit)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["_id"], batch["_text"]):
                spans = np.array([m.span() for m in _TOKEN.finditer(text)], np.int64).reshape(-1, 2)
                starts, ends = spans[:, 0], spans[:, 1]
                strengths = boundary_strengths(text, starts, ends)
                found = cuts(strengths, limit, overlap, least_fill)
                rows = [(key, k, len(found), a, b, int(starts[a]), int(ends[b - 1]), s) for k, (a, b, s) in enumerate(found)]
                frame = pd.DataFrame(rows, columns=["_id", "piece_no", "n_pieces", "start_token", "end_token", "start_char", "end_char", "strength"])
                if with_text:
                    frame["text"] = [text[a:b] for a, b in zip(frame["start_char"], frame["end_char"])]
                yield frame

    kind = dict(docs.dtypes)[id_col]
    out = large.mapInPandas(pieces, f"_id {kind}, {SCHEMA}" + ", text string" * with_text)
    return out.withColumnRenamed("_id", id_col)
