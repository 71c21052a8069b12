"""Trigrams that every match of a regular expression must contain, and an index to look them up.

``required`` walks the parse tree of a pattern and returns alternatives, each a set of grams:
a text can only match if it holds all grams of at least one alternative. Besides trigrams of
the lower-cased text there are run grams (``RUNS``): a pattern such as ``[A-Za-z0-9+/]{40}``
has no literal letters, but demands an unbroken run of token characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import product

import numpy as np

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # Python < 3.11
    import sre_constants as sre
    import sre_parse

#: Lengths of runs of token characters for which a text gets a gram.
RUNS = (16, 24, 32)
RUN_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-")
RUN_RE = {n: re.compile(r"[A-Za-z0-9+/_-]{%d}" % n) for n in RUNS}
#: A character class of more letters than this is not spelled out.
WIDEST, MOST_STRINGS, MOST_SETS = 8, 64, 64

Alternatives = frozenset  # of frozensets of grams
ANYTHING: Alternatives = frozenset([frozenset()])


def _simplest(alts: Iterable[frozenset[str]]) -> Alternatives:
    """Drop alternatives that another one implies."""
    alts = sorted(set(alts), key=len)
    kept: list[frozenset[str]] = []
    for a in alts:
        if not any(k <= a for k in kept):
            kept.append(a)
    return frozenset(kept)


def _both(a: Alternatives, b: Alternatives) -> Alternatives:
    if len(a) * len(b) > MOST_SETS:
        return max(a, b, key=lambda x: min(map(len, x)))
    return _simplest(x | y for x, y in product(a, b))


def _of_strings(strings: Iterable[str]) -> Alternatives:
    return _simplest(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _chars(items) -> frozenset[str] | None:
    """The letters of a class, or None if there are many or it is negated."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 128:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        elif op is sre.CATEGORY and arg is sre.CATEGORY_DIGIT:
            out |= set("0123456789")
        else:
            return None
    return frozenset(out)


def required(pattern: str) -> Alternatives:
    """Alternatives of grams of *pattern*, read without regard to case."""

    def walk(nodes) -> tuple[set[str] | None, Alternatives]:
        """All strings that the nodes match, if few, and what they need."""
        strings: set[str] = {""}
        need, whole = ANYTHING, True

        def broken() -> None:
            nonlocal strings, need, whole
            need, strings, whole = _both(need, _of_strings(strings)), {""}, False

        for op, arg in nodes:
            if op is sre.LITERAL:
                got, also = {chr(arg).lower()}, ANYTHING
            elif op is sre.IN:
                letters = _chars(arg)
                small = letters is not None and len({c.lower() for c in letters}) <= WIDEST
                got, also = ({c.lower() for c in letters} if small else None), ANYTHING
            elif op is sre.SUBPATTERN:
                got, also = walk(arg[-1])
            elif op is sre.BRANCH:
                parts = [walk(x) for x in arg[1]]
                also = _simplest(s for strs, n in parts for s in (_both(n, _of_strings(strs)) if strs is not None else n))
                got = set().union(*(strs for strs, _ in parts)) if all(strs is not None for strs, _ in parts) else None
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, inner = arg
                got, also = None, ANYTHING
                if low == high == 1:
                    got, also = walk(inner)
                elif high == 1 and low == 0:
                    strs, _ = walk(inner)
                    got = strs | {""} if strs is not None else None
                elif low >= 1:
                    also = walk(inner)[1]
                    items = inner[0][1] if len(inner) == 1 and inner[0][0] is sre.IN else None
                    letters = _chars(items) if items is not None else None
                    if letters and letters <= RUN_CHARS:
                        also = _both(also, frozenset([frozenset(f"run{n}" for n in RUNS if n <= low)]))
            elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
                continue
            else:
                got, also = None, ANYTHING
            if got is None or len(strings) * len(got) > MOST_STRINGS:
                broken()
                need = _both(need, also)
                if got is not None:
                    strings = set(got)
            else:
                strings = {a + b for a in strings for b in got}
                need = _both(need, also)
        return (strings if whole else None), (_both(need, _of_strings(strings)))

    return walk(sre_parse.parse(pattern))[1]


class ShardIndex:
    """Inverted trigram index over the chunks of one shard: gram -> ordinals of chunks.

    Only grams that some plan asks for are kept. Postings are sorted arrays, so a plan is
    answered by intersecting and joining arrays.
    """

    def __init__(self, chunks: list[str], plans: dict[str, Alternatives]):
        self.size = len(chunks)
        self.plans = plans
        lowered = [c.lower() for c in chunks]
        self.postings: dict[str, np.ndarray] = {}
        for gram in {g for alts in plans.values() for a in alts for g in a}:
            if gram.startswith("run") and gram[3:].isdigit():
                at = RUN_RE[int(gram[3:])]
                hits = [i for i, c in enumerate(chunks) if at.search(c)]
            else:
                hits = [i for i, c in enumerate(lowered) if gram in c]
            self.postings[gram] = np.array(hits, dtype=np.int32)

    def candidates(self, plan: str) -> np.ndarray:
        """Ordinals of the chunks that may match the detector *plan*."""
        found = np.zeros(0, dtype=np.int32)
        for alternative in self.plans[plan]:
            if not alternative:
                return np.arange(self.size, dtype=np.int32)
            lists = sorted((self.postings[g] for g in alternative), key=len)
            hits = lists[0]
            for other in lists[1:]:
                if not len(hits):
                    break
                hits = np.intersect1d(hits, other, assume_unique=True)
            found = np.union1d(found, hits)
        return found
