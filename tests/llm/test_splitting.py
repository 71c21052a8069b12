import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import splitting


def check(text, limit, overlap):
    spans = splitting.pieces(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert b - a <= limit
    for (_, end), (start, stop) in zip(spans, spans[1:]):
        assert 0 <= end - start <= overlap + 8 and stop > end
    # the pieces without their overlaps give the text back
    out, at = "", 0
    for a, b in spans:
        out, at = out + text[at:b], b
    assert out == text
    return spans


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n{}é漢👍🏽\u200d", max_size=400), st.integers(20, 90), st.integers(0, 6))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    if len(text) > limit:
        check(text, limit, overlap)


def test_cuts_at_natural_boundaries():
    text = "\n\n".join(f"function f{i}() {{\n  return {i};\n}}" for i in range(40))
    spans = check(text, 300, 0)
    assert all(text[b - 1] == "\n" for _, b in spans[:-1])


def test_one_line_longer_than_the_limit():
    check("x" * 10_000, 333, 10)


def test_very_long_text():
    check("word and word\n" * 60_000, 4000, 100)


def test_tables(spark):
    limits = spark.createDataFrame([("api", 50, 5), ("default", 100, 10)], "slice_type string, max_file_size int, overlap_chars int")
    rows = [(1, "api", "y" * 60, 1), (2, None, "y" * 60, 1), (3, None, "z " * 60, 1), (4, "api", None, 1), (5, "api", "", 1), (6, "nolimit", "q" * 900, 1), (1, "api", "y" * 60, 1)]
    slices = spark.createDataFrame(rows, "slice_id long, slice_type string, content string, max_file_size int")
    assert sorted(r[0] for r in splitting.oversized(slices, limits).collect()) == [1, 3, 6]
    assert splitting.oversized(slices.limit(0), limits).count() == 0
    assert splitting.oversized(slices, limits.limit(0)).count() == 0
    pieces = splitting.split_slices(slices, limits)
    assert {r.slice_id for r in pieces.collect()} >= {1, 3}


@pytest.mark.parametrize("limit,overlap", [(10, 0), (64, 16)])
def test_ties_are_deterministic(limit, overlap):
    text = "ab\n" * 100
    assert splitting.pieces(text, limit, overlap) == splitting.pieces(text, limit, overlap)
