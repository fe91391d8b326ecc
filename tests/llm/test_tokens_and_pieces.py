import random

import pytest

from gridloom.llm import splitting
from gridloom.llm.tokens import encode, token_counts


def check(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    if len(encode(text)) <= limit:
        assert pieces == []
        return pieces
    back, end, last = "", 0, 0
    for i, (s, e, cs, ce, kind, piece) in enumerate(pieces):
        assert piece == text[cs:ce]
        assert len(encode(piece)) <= limit and e - s <= limit
        assert overlap <= last - s <= overlap + 3 if i else s == 0
        assert ce > end
        back += text[end:ce] if i else piece
        end, last = ce, e
    assert back == text and pieces[-1][4] == "end"
    return pieces


def test_random_texts_come_back_whole():
    rng = random.Random(3)
    words = [
        "alpha", "Beta.", "gamma\n", "\n\n# Title\n", "x" * 40, "日本語の文。", "é", "'s", "\r\n", "  ", "1234567", "🧬", "\t", "don't", "ünïcödé"
    ]
    for n in (0, 5, 200, 900, 3000):
        check("".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(n)), 64, 8)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "\n" * 3000, "🧬" * 900, "日本" * 2000, "ab'" * 3000, "\r\n" * 2000, "�\x00" * 1000])
def test_texts_without_boundaries(text):
    check(text, 64, 8)


def test_cuts_at_the_strongest_nearby_boundary():
    part = "One sentence follows another here. " * 12
    text = "\n\n".join(part.strip() for _ in range(8))
    kinds = [p[4] for p in check(text, 128, 0)]
    assert set(kinds[:-1]) <= {"paragraph", "sentence"} and "paragraph" in kinds
    log = "".join(f"2025-01-0{i % 9} step {i} ok value {i * i}\n" for i in range(200))
    assert {p[4] for p in check(log, 128, 16)[:-1]} == {"line"}


def test_least_number_of_pieces_where_boundaries_allow():
    text = "word " * 1000
    n = len(encode(text))
    pieces = check(text, 100, 20)
    assert len(pieces) == 1 + -(-(n - 100) // 80)


def test_frames(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 500, "c"), (3, "word " * 500, "c"), (4, "short", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counts = {r[0]: r[1] for r in token_counts(df.drop("n_tokens")).collect()}
    assert counts[1] == counts[2] == 0 and counts[4] == 1
    out = splitting.split_documents(df, 128, 16).collect()
    assert {r.doc_id for r in out} == {3} and len(out) % 2 == 0 and max(r.n_tokens for r in out) <= 128
    assert splitting.split_documents(df.limit(0), 128, 16).count() == 0
    with pytest.raises(ValueError):
        splitting.split_documents(df, 128, 128)
