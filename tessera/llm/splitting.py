"""Cut oversized texts into pieces at natural boundaries, neighbours sharing an overlap.

Method: agglomerative merging. A text starts as atomic segments (lines; a line too long for a
piece as sentences, then words, then stretches cut between whole characters). All adjacent
pairs wait in a heap; the pair with the weakest boundary between them is merged first, as long
as both and the overlap fit the limit. What remains are the strongest boundaries.

Defined cases: null and empty texts, and texts within the limit, are one piece or none; every
piece has at most *limit* code points; piece k + 1 begins exactly *overlap* code points before
the end of piece k, so dropping the overlap of all but the first gives back the text; an
overlap not smaller than half the limit is cut to what leaves room for progress; slices
delivered twice are cut once; an unknown or null type has the limit of ``default``.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

SENTENCE = re.compile(r"(?<=[。！？；])|(?<=[.!?;])(?=\s)|(?<=>)(?=\s*<)|(?<=[,，、])(?=\s*['\"{\[<])")
WORD = re.compile(r"(?<=\s)(?=\S)|(?<=[,，、：:])")
#: Strengths of boundaries, weakest first.
ANYWHERE, BLANK, CLAUSE, LINE, OUTER_LINE, EMPTY_LINE, TOP_LEVEL = range(7)


def whole_character(text: str, i: int) -> bool:
    """Whether a cut before text[i] leaves line ends, marks and joined signs together."""
    if not 0 < i < len(text):
        return True
    a, b = text[i - 1], text[i]
    if a == "\r" and b == "\n":
        return False
    if a == "‍" or b == "‍" or unicodedata.combining(b) or "︀" <= b <= "️" or "\U0001f3fb" <= b <= "\U0001f3ff" or "\U000e0020" <= b <= "\U000e007f":
        return False
    if "\U0001f1e6" <= b <= "\U0001f1ff":
        k = i
        while k > 0 and "\U0001f1e6" <= text[k - 1] <= "\U0001f1ff":
            k -= 1
        return (i - k) % 2 == 0
    return True


def _cuts(line: str, most: int) -> list[tuple[int, int]]:
    """(place, strength) of the cuts of one line that is longer than *most*."""
    cuts = {m.start(): CLAUSE for m in SENTENCE.finditer(line) if 0 < m.start() < len(line)}
    for m in WORD.finditer(line):
        if 0 < m.start() < len(line):
            cuts.setdefault(m.start(), BLANK)
    at, out = 0, []
    for place in [*sorted(cuts), len(line)]:
        while place - at > most:  # no boundary in reach: between whole characters
            end = at + most
            while end > at + 1 and not whole_character(line, end):
                end -= 1
            if end <= at + 1 and not whole_character(line, end):
                end = at + most
            out.append((end, ANYWHERE))
            at = end
        if place < len(line):
            if whole_character(line, place):
                out.append((place, cuts[place]))
                at = place
    return out


def _line_strength(line: str, following: str) -> int:
    if not line.strip():
        return TOP_LEVEL if following[:1].strip() else EMPTY_LINE
    return OUTER_LINE if following[:1].strip() and following[0] not in ")]}" else LINE


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments of *text*, each at most *most* long, and the strength of each end."""
    lines = text.split("\n")
    ends, strengths, at = [], [], 0
    for n, line in enumerate(lines):
        last = n == len(lines) - 1
        size = len(line) + (not last)
        if size > most:
            for place, strength in _cuts(line + ("" if last else "\n"), most):
                ends.append(at + place)
                strengths.append(strength)
        at += size
        if size:
            ends.append(at)
            strengths.append(TOP_LEVEL if last else _line_strength(line, lines[n + 1]))
    return ends, strengths


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of the pieces of *text*."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    overlap = max(0, min(overlap, (limit - 1) // 2))
    most = limit - overlap
    ends, strength = atoms(text, most)
    start = [0, *ends[:-1]]
    following, before, alive = list(range(1, len(ends) + 1)), list(range(-1, len(ends) - 1)), [True] * len(ends)

    def joined(i: int) -> int:
        return ends[following[i]] - start[i]

    heap = [(strength[i], joined(i), i, ends[i]) for i in range(len(ends) - 1)]
    heapq.heapify(heap)
    while heap:
        force, size, i, end = heapq.heappop(heap)
        if not alive[i] or following[i] >= len(ends) or ends[i] != end or joined(i) != size:
            if alive[i] and following[i] < len(ends) and ends[i] == end:
                heapq.heappush(heap, (force, joined(i), i, end))
            continue
        if size + (overlap if start[i] else 0) > limit:
            continue
        j = following[i]
        ends[i], strength[i], following[i], alive[j] = ends[j], strength[j], following[j], False
        if following[i] < len(ends):
            before[following[i]] = i
            heapq.heappush(heap, (strength[i], joined(i), i, ends[i]))
    cuts = [ends[i] for i in range(len(ends)) if alive[i]]
    if cuts[0] <= overlap and len(cuts) > 1:  # the overlap must lie within the first piece
        first = min(limit, cuts[1])
        while first > overlap + 1 and not whole_character(text, first):
            first -= 1
        cuts[0] = first
        if cuts[0] >= cuts[1]:
            del cuts[0]
    return [(max(0, a - overlap), b) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


PIECE = "slice_id long, piece_no int, n_pieces int, start int, length int, content string"


def split_slices(slices: DataFrame, limits: DataFrame) -> DataFrame:
    """All pieces of the slices that are longer than the limit of their type.

    A null type, and one the limits do not name, has the limit of ``default``; without such a
    limit, and for null texts, there is nothing to cut.
    """
    known = {r.slice_type: (int(r.max_file_size), int(r.overlap_chars or 0)) for r in limits.where("slice_type is not null and max_file_size is not null").collect()}  # a handful of types
    most, shared = (F.lit(known["default"][k]) if "default" in known else F.lit(None).cast("int") for k in (0, 1))
    for name, (limit, overlap) in known.items():
        most = F.when(F.col("type") == name, limit).otherwise(most)
        shared = F.when(F.col("type") == name, overlap).otherwise(shared)
    rows = (
        slices.select(F.col("slice_id").cast("long").alias("slice_id"), F.coalesce("slice_type", F.lit("default")).alias("type"), "content")
        .where(F.col("content").isNotNull())
        .select("slice_id", "content", most.alias("most"), shared.alias("shared"))
        .where(F.length("content") > F.col("most"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, most, shared in zip(batch["slice_id"], batch["content"], batch["most"], batch["shared"], strict=True):
                spans = pieces(text, int(most), int(shared))
                out += [(i, k, len(spans), a, b - a, text[a:b]) for k, (a, b) in enumerate(spans)]
            yield pd.DataFrame(out, columns=["slice_id", "piece_no", "n_pieces", "start", "length", "content"])

    return spread(rows, "slice_id").mapInPandas(run, PIECE).dropDuplicates(["slice_id", "piece_no"])


def oversized(slices: DataFrame, limits: DataFrame) -> DataFrame:
    """``slice_id`` of the slices that had to be cut."""
    return split_slices(slices, limits).where("piece_no = 1").select("slice_id").distinct()
