import re
from collections import Counter

import pytest

from tessera.llm import mixing as M

try:
    TOKENIZER = M.default_tokenizer()
except Exception:  # no vocabulary files on this machine
    TOKENIZER = None


def test_demands_reach_the_shares_exactly():
    d = M.demands({"a": 1000, "b": 100}, {"a": (0.5, 1), "b": (0.5, 4)})
    assert d["b"] <= 400 and abs(d["a"] - d["b"]) < 1e-6 * d["a"] + 1


def test_demands_of_a_fixed_total_fill_what_is_short():
    d = M.demands({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, total=500)
    assert abs(d["b"] - 20) < 1e-6 and abs(sum(d.values()) - 500) < 1e-6


def test_demands_of_nothing():
    assert sum(M.demands({}, {"a": (1.0, 1)}).values()) == 0


@pytest.mark.skipif(TOKENIZER is None, reason="no vocabulary files")
def test_tables(spark):
    docs = [(i, "a" if i % 3 else "b", f"some words number {i} " * (1 + i % 5), 7) for i in range(300)] + [(900, None, "text of no source", 7), (901, "a", None, 7), (902, "a", "", 7)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, position int")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(d, t)
    rows = mixed.collect()
    repeats = {}
    for r in rows:
        repeats[r.doc_id] = repeats.get(r.doc_id, 0) + 1
    assert max(repeats.values()) <= 3
    by = {}
    for r in M.shares(mixed, t).collect():
        by[r.source] = r
    assert set(by) >= {"a", "b"}
    assert M.mixture(d.limit(0), t).count() == 0
    assert M.mixture(d, t.limit(0)).count() == 0


@pytest.mark.skipif(TOKENIZER is None, reason="no vocabulary files")
def test_shares_against_brute_force(spark, sf):
    """p7: tokens counted and shares worked out in plain Python; no document beyond its cap; order follows the position."""
    documents, targets = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet")
    known = M.encoding(*TOKENIZER)
    plain = lambda s: re.sub(r"[\s\-_.]+", "_", s.strip()).lower()
    wanted = {plain(r.source): (r.target_share, r.max_repeats) for r in targets.collect()}
    tokens, source = {}, {}
    for r in documents.select("doc_id", "text", "source").collect():
        if r.text and r.source and plain(r.source) in wanted:
            tokens[r.doc_id], source[r.doc_id] = len(known.encode_ordinary(r.text)), plain(r.source)
    have = {s: sum(n for d, n in tokens.items() if source[d] == s) for s in set(source.values())}
    rows = M.in_order(M.mixture(documents, targets)).collect()
    copies, sums = Counter(r.doc_id for r in rows), Counter()
    for r in rows:
        assert r.n_tokens == tokens[r.doc_id] and r.source == source[r.doc_id]
        sums[r.source] += r.n_tokens
    assert all(n <= wanted[source[d]][1] for d, n in copies.items())
    open_ = {s: wanted[s][0] for s in have if have[s]}
    total, whole = sum(sums.values()), sum(open_.values())
    largest = max(tokens.values())
    for s, share in open_.items():  # exact but for half a document at the end of each source
        assert abs(sums[s] - share / whole * total) <= 2 * largest
    # as large as the caps allow: one source is used up
    assert any(sums[s] >= have[s] * wanted[s][1] - largest for s in open_)
    positions = [r.position for r in rows]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
