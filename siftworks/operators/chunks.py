"""Cutting documents into chunks of about a number of tokens, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import ship

_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE_END = re.compile(r"[.!?][\"')\]]?\s+|\n+")


def _boundary(text: str, at: int, low: int, high: int) -> int:
    """The sentence end nearest to ``at`` within 200 characters, else the nearest space within 50, else ``at``."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text, max(low, at - 200), min(high, at + 200)) if m.end() > low]
    if not ends:
        ends = [m.end() for m in re.compile(r"\s").finditer(text, max(low, at - 50), min(high, at + 50)) if m.end() > low]
    return min(ends, key=lambda e: (abs(e - at), e)) if ends else at


def chunk_spans(text: str, target: int, most: int, overlap: int) -> list[tuple[int, int, int]]:
    """``(start, end, tokens)`` of the chunks in characters.

    A chunk is as long as ``target`` tokens would be at the text's average and ends at a near boundary; one with more than
    ``most`` tokens is shortened by a tenth until it fits. The next starts about ``overlap`` tokens before, after a space.
    """
    count = lambda a, b: sum(1 for _ in _TOKEN.finditer(text, a, b))
    total = count(0, len(text))
    if total <= most:
        return [(0, len(text), total)] if total else []
    ratio = len(text) / total
    out, start = [], 0
    while start < len(text):
        if count(start, len(text)) <= most - (most - target) // 2:
            out.append((start, len(text), count(start, len(text))))
            break
        size = target * ratio
        end = _boundary(text, min(len(text), start + int(size)), start + 1, len(text))
        while count(start, end) > most:
            size *= 0.9
            end = _boundary(text, start + int(size), start + 1, start + int(size))
        out.append((start, end, count(start, end)))
        back = max(start + 1, end - int(overlap * ratio))
        space = text.find(" ", back, end)
        start = max(space + 1 if space >= 0 else back, start + 1) if overlap else end  # always forward
    return out


def chunk_documents(docs: DataFrame, target: int = 1000, most: int = 2000, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, chunk_index, start_char, end_char, token_count, text)``; documents without tokens have no row. Whole texts, no shuffle."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, i, a, b, n, text[a:b]) for key, text in zip(batch["k"], batch["t"]) for i, (a, b, n) in enumerate(chunk_spans(text, target, most, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "start_char", "end_char", "token_count", "text"])

    known = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null")
    return known.mapInPandas(cut_up, f"`{id_col}` {kind}, chunk_index int, start_char bigint, end_char bigint, token_count bigint, text string")
