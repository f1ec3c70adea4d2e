import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftworks.llm.split import CLAUSE, LINE, PAGE, PARAGRAPH, SENTENCE, WORD, RangeMaximum, boundary_strengths, cuts, split_documents
from siftworks.llm.tokens import PYTHON_TOKEN, token_count


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=80), st.data())
def test_rightmost_maximum(values, data):
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    window = values[low : high + 1]
    want = high - window[::-1].index(max(window))
    assert RangeMaximum(np.array(values, np.int8), len(values)).rightmost(low, high) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=300), st.integers(4, 40), st.integers(0, 9))
def test_cuts_cover_with_overlap(values, limit, overlap):
    overlap = min(overlap, limit // 2 - 1)
    found = cuts(np.array(values, np.int8), limit, overlap, 0.5)
    assert found[0][0] == 0 and found[-1][1] == len(values) and all(b - a <= limit for a, b, _ in found)
    for (_, end, s), (start, _, _) in zip(found, found[1:]):
        assert start == end - overlap and s == values[end - 1]


def test_strengths():
    text = "One, two. Three\nFour\n\nFive\fSix seven-eight"
    spans = np.array([m.span() for m in re.finditer(PYTHON_TOKEN, text)])
    got = boundary_strengths(text, spans[:, 0], spans[:, 1]).tolist()
    words = [text[a:b] for a, b in spans]
    assert {w: s for w, s in zip(words, got)} == {"One": 0, ",": CLAUSE, "two": 0, ".": SENTENCE, "Three": LINE, "Four": PARAGRAPH, "Five": PAGE, "Six": WORD, "seven": 0, "-": 0, "eight": PAGE}


ODD = ["", None, "   ", "a", "naïve café — ünïcode…", "x y z​w", "日本語 テスト。", "١٢٣ a_b²", "é 🙂🙂 ok", "\x1c\x85 a\tb\r\nc"]


def test_token_count_is_the_same_in_both_languages(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", token_count(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: len(re.findall(PYTHON_TOKEN, t or "")) for i, t in enumerate(ODD)}


def test_split_documents(spark):
    long = " ".join(f"w{i}" + ("." if i % 17 == 0 else "") for i in range(1000))
    rows = [(1, long, "c"), (2, "short", "c"), (3, None, "c"), (4, "", "c"), (5, "!" * 500, "c"), (6, long, "c"), (6, long, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece_no string")
    got = split_documents(docs, 100, 10).collect()
    assert {r["doc_id"] for r in got} == {1, 5, 6}
    mine = sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["piece_no"])
    tokens = re.findall(PYTHON_TOKEN, long)
    for r in mine:
        assert re.findall(PYTHON_TOKEN, r["text"]) == tokens[r["start_token"] : r["end_token"]] and r["text"] == long[r["start_char"] : r["end_char"]]
        assert r["end_token"] - r["start_token"] <= 100 and r["n_pieces"] == len(mine)
    assert all(b["start_token"] == a["end_token"] - 10 for a, b in zip(mine, mine[1:]))
    assert all(r["strength"] >= SENTENCE for r in mine)
    with pytest.raises(ValueError):
        split_documents(docs, 100, 50)
