"""Evaluation items that stand, wholly or in part, in training texts.

Method: suffix arrays over shards of the training texts. A shard is one Arrow batch; its
normalised words are numbered, and the suffixes that can begin a match are sorted by prefix
doubling. Every suffix of every item is then looked up by binary search, which yields all
verbatim matches and their places. Matches are chained over single changed, missing or added
words; a chain of at least ``WORDS`` words of the item (``LETTERS`` letters for items in
Chinese script) with no more than one edit in ten words is a leak. Edits may stand anywhere
within the span, also side by side or next to its first or last word.

Letter case, punctuation, spacing, line layout, line prefixes, character width, invisible
characters and escapes are normalised away on both sides.

Only the items are sent to all tasks. Their total size is checked against ``MOST_ITEM_CHARS``;
beyond it the items are taken in blocks of that size, each block one pass over the texts.

Defined cases: null and empty texts hold nothing; copies of a text are reported under each
doc_id; items shorter than the least length never match; one row per item and document.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import spread

#: Least length of a leak, in words and for Chinese items in letters, and of a verbatim seed.
WORDS, LETTERS, WORD_SEED, LETTER_SEED = 12, 24, 6, 10
#: One edit is allowed in so many words, or letters of Chinese, where a word has about two.
WORDS_AN_EDIT, LETTERS_AN_EDIT = 10, 20
#: Tokens that one edit may change, add or leave out: a word, which in Chinese has up to two letters.
WORD_UNIT, LETTER_UNIT = 1, 2
#: Characters of items that are sent to every task at once.
MOST_ITEM_CHARS = 8_000_000

HAN = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
WORD = re.compile(rf"[{HAN}\u3040-\u30ff]|[^\W_{HAN}\u3040-\u30ff]+")
LETTER = re.compile(r"[^\W_]")
HAN_LETTER = re.compile(f"[{HAN}]")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}){2,}")


def _percent(m: re.Match) -> str:
    return bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "ignore")


def _unescape(m: re.Match) -> str:
    if m[1]:
        return chr(int(m[1], 16))
    return " " if m[2] in "nrtbf" else m[2]


def normal(text: str) -> str:
    """*text* without escapes and invisible characters, in compatibility form and lower case."""
    if "\\" in text:
        text = re.sub(r"\\(?:u([0-9a-fA-F]{4})|([nrtbf\"'/\\]))", _unescape, text)
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "ignore")
    if "&" in text:
        text = html.unescape(text)
    if "%" in text:
        text = PERCENT.sub(_percent, text)
    return unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).lower()


def _han(text: str) -> list[bool]:
    """Which of the letters of *text* are Chinese characters."""
    return [bool(HAN_LETTER.match(c)) for c in LETTER.findall(text)]


def is_chinese(text: str) -> bool:
    """Whether an item is measured in letters: most of its letters are Chinese characters, none Japanese syllables."""
    han = len(re.findall(f"[{HAN}]", text))
    return han * 4 > len(LETTER.findall(text)) and not re.search("[\u3040-\u30ff]", text)


class Shard:
    """Sparse suffix array over the token numbers of one shard."""

    def __init__(self, tokens: np.ndarray, seed: int, depth: int = 16):
        # a suffix can begin a match only if `seed` known tokens follow
        self.seed, self.depth = seed, depth
        self.tokens = np.concatenate([tokens, np.full(depth + 1, -1, dtype=np.int32)])
        known = np.concatenate([[0], np.cumsum(self.tokens >= 0)])
        starts = np.flatnonzero(known[seed : len(tokens) + seed] - known[: len(tokens)] == seed) if len(tokens) else np.zeros(0, int)
        rank = (self.tokens + 1).astype(np.int64)
        step = 1
        while step < depth:  # prefix doubling: ranks by 1, 2, 4, ... tokens
            pair = rank * (int(rank.max()) + 2) + np.concatenate([rank[step:], np.zeros(step, np.int64)])
            _, rank = np.unique(pair, return_inverse=True)
            rank = rank.astype(np.int64)
            step *= 2
        self.suffixes = starts[np.argsort(rank[starts], kind="stable")]

    def _less(self, at: np.ndarray, query: np.ndarray, own: np.ndarray, length: int, or_equal: bool) -> np.ndarray:
        """Whether the suffix at *at* precedes the query suffix, by the first *length* tokens."""
        undecided = np.ones(len(at), bool)
        less = np.zeros(len(at), bool)
        for k in range(length):
            a, b = self.tokens[at + k], query[own + k]
            less |= undecided & (a < b)
            undecided &= a == b
            if not undecided.any():
                break
        return less | undecided if or_equal else less

    def _search(self, query: np.ndarray, own: np.ndarray, length: int, or_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(own), np.int64), np.full(len(own), len(self.suffixes), np.int64)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high) // 2
            before = np.zeros(len(own), bool)
            before[open_] = self._less(self.suffixes[mid[open_]], query, own[open_], length, or_equal)
            low = np.where(open_ & before, mid + 1, low)
            high = np.where(open_ & ~before, mid, high)

    def matches(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in the query, place in the shard) where the next *seed* tokens agree."""
        padded = np.concatenate([query, np.full(self.depth + 1, -2, dtype=np.int32)])
        known = np.concatenate([[0], np.cumsum(padded >= 0)])
        own = np.flatnonzero(known[self.seed : len(query) + self.seed] - known[: len(query)] == self.seed) if len(query) else np.zeros(0, int)
        if not len(own) or not len(self.suffixes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = self._search(padded, own, self.seed, False)
        high = self._search(padded, own, self.seed, True)
        n = high - low
        offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(own, n), self.suffixes[np.repeat(low, n) + offsets]


def _run(item: list[int], text: list[int], i: int, j: int, step: int) -> int:
    """Tokens that agree from (i, j) in direction *step*."""
    n = 0
    while 0 <= i < len(item) and 0 <= j < len(text) and item[i] == text[j]:
        n, i, j = n + 1, i + step, j + step
    return n


def _reach(item: list[int], text: list[int], i: int, j: int, step: int, edits: int, unit: int, apart: int = 0, han: tuple[list[bool], list[bool]] = ((), ())) -> list[int]:
    """Most item tokens spanned from (i, j) in direction *step* with 0, 1, ... *edits* edits.

    Edit distance by diagonals: of each number of edits and each shift of the text against the
    item, the furthest place is kept. An edit replaces up to *unit* tokens by up to *unit* others; more than
    one only where all of them are *han*, Chinese characters of the item and of the text.
    Edits may follow each other, unless *apart* tokens must agree between two of them; the last
    one must be followed by *unit* agreeing tokens, else the span ends before it.
    """
    moves = [(da, db) for da in range(unit + 1) for db in range(unit + 1) if da or db]
    best = [0] * (edits + 1)
    starts = {(0, 0)}
    for e in range(edits + 1):
        furthest: dict[int, int] = {}
        for x, y in starts:
            n = _run(item, text, i + step * x, j + step * y, step)
            if not e or n >= unit:
                best[e] = max(best[e], x + n)
            if not e or n >= apart:
                furthest[y - x] = max(furthest.get(y - x, 0), x + n)
        starts = set()
        for d, x in furthest.items():
            for da, db in moves:
                p, q = i + step * x, j + step * (x + d)
                if not (0 <= p + step * (da - 1) < len(item) and 0 <= q + step * (db - 1) < len(text)):
                    continue
                if max(da, db) == 1 or all(han[0][p + step * k] for k in range(da)) and all(han[1][q + step * k] for k in range(db)):
                    starts.add((x + da, x + d + db))
        if not starts:
            break
    return [max(best[: e + 1]) for e in range(edits + 1)]


def leak_length(item: list[int], text: list[int], seeds: list[tuple[int, int]], least: int, an_edit: int, unit: int = 1, han: tuple[list[bool], list[bool]] = ((), ())) -> tuple[int, int]:
    """Longest span of item tokens in *text* and its edits; 0 if too short.

    A span may hold one edit in *an_edit* of its tokens, or as many as leave at most one in any
    *an_edit* tokens in a row.
    """
    best, done, most = (0, 0), set(), len(item) // an_edit + 1
    for i, j in sorted(seeds):
        if (i, j) in done:
            continue
        n = _run(item, text, i, j, 1)
        done.update((i + k, j + k) for k in range(n))
        for apart in (0, an_edit - unit):
            if best == (len(item), 0):
                break
            ahead = _reach(item, text, i + n, j + n, 1, most, unit, apart, han)
            behind = _reach(item, text, i - 1, j - 1, -1, most, unit, apart, han)
            for a, right in enumerate(ahead):
                for b, left in enumerate(behind):
                    span = n + right + left
                    few = not (a and b) or n >= apart if apart else (a + b) * an_edit <= span
                    if span >= least and few and span > best[0]:
                        best = (span, a + b)
    return best


class Items:
    """The items, numbered by their own vocabulary: words, and letters for Chinese items."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.sides = []
        texts = [(k, normal(t)) for k, t in rows if t]
        self.han = {k: _han(t) for k, t in texts if is_chinese(t)}
        for chinese in (False, True):
            own = [(k, t) for k, t in texts if is_chinese(t) == chinese]
            units = LETTER if chinese else WORD
            vocabulary: dict[str, int] = {}
            items = {k: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in units.findall(t)], dtype=np.int32) for k, t in own}
            joined = np.concatenate([np.concatenate([v, [-2]]) for v in items.values()]).astype(np.int32) if items else np.zeros(0, np.int32)
            ids = np.repeat(list(items), [len(v) + 1 for v in items.values()]) if items else np.zeros(0, np.int64)
            start = {k: s for k, s in zip(items, np.cumsum([0, *(len(v) + 1 for v in items.values())]), strict=False)}
            self.sides.append((chinese, units, vocabulary, items, joined, ids, start))

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, bool]]:
        """(ordinal of the text, item, tokens of the longest span, edits, in letters) for each leak."""
        plain = [normal(t) for t in texts]
        for chinese, units, vocabulary, items, joined, ids, start in self.sides:
            if not items:
                continue
            chosen = [n for n, t in enumerate(plain) if not chinese or len(re.findall(f"[{HAN}]", t)) >= LETTER_SEED]
            numbered = [np.array([vocabulary.get(w, -1) for w in units.findall(plain[n])] + [-1], dtype=np.int32) for n in chosen]
            if not numbered:
                continue
            sizes = np.array([len(x) for x in numbered])
            begin = np.cumsum(sizes) - sizes
            shard = Shard(np.concatenate(numbered), LETTER_SEED if chinese else WORD_SEED)
            own, at = shard.matches(joined)
            owner = np.searchsorted(begin, at, side="right") - 1
            pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for q, o, a in zip(own.tolist(), owner.tolist(), at.tolist(), strict=True):
                k = int(ids[q])
                pairs.setdefault((o, k), []).append((q - int(start[k]), a - int(begin[o])))
            lists: dict[int, tuple[list[int], list[bool]]] = {}
            for (o, k), seeds in sorted(pairs.items()):
                if o not in lists:
                    lists = {o: (numbered[o].tolist(), [*_han(plain[chosen[o]]), False] if chinese else [])}
                words, flags = lists[o]
                span, edits = leak_length(items[k].tolist(), words, seeds, *((LETTERS, LETTERS_AN_EDIT, LETTER_UNIT) if chinese else (WORDS, WORDS_AN_EDIT, WORD_UNIT)), han=(self.han.get(k, []), flags))
                if span:
                    yield chosen[o], k, span, edits, chinese


LEAK = "item_id long, doc_id long, span int, edits int, item_length int"


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, doc_id, span, edits, item_length`` for every document that contains an item."""
    rows = [(int(r[0]), r[1]) for r in items.select("item_id", "text").where(F.col("text").isNotNull()).dropDuplicates(["item_id"]).toLocalIterator()]
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for k, t in sorted(rows):
        if size + len(t) > MOST_ITEM_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((k, t))
        size += len(t)
    texts = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0), "doc_id")

    def one(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = Items(block)
            lengths = {k: len(v) for side in known.sides for k, v in side[3].items()}
            for batch in batches:
                ids = batch["doc_id"].tolist()
                yield pd.DataFrame(
                    [(k, ids[n], span, edits, lengths[k]) for n, k, span, edits, _ in known.find(batch["text"].tolist())],
                    columns=["item_id", "doc_id", "span", "edits", "item_length"],
                )

        return texts.mapInPandas(run, LEAK)

    out = one(blocks[0])
    for block in blocks[1:]:
        out = out.unionByName(one(block))
    return out.dropDuplicates(["item_id", "doc_id"])


def documents_with_items(found: DataFrame) -> DataFrame:
    """One row per affected document: its items in order, how many, and the longest span."""
    return found.groupBy("doc_id").agg(
        F.count("*").cast("long").alias("n_items"),
        F.array_join(F.transform(F.sort_array(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("items"),
        F.max("span").alias("longest"),
    )


def leaked_items(found: DataFrame, items: DataFrame) -> DataFrame:
    """One row per leaked item: suite, number of documents, whether any holds it whole."""
    counts = found.groupBy("item_id").agg(
        F.count("*").cast("long").alias("n_docs"), F.max("span").alias("longest"), F.max((F.col("span") >= F.col("item_length")).cast("int")).alias("whole")
    )
    return counts.join(items.select("item_id", "suite").dropDuplicates(["item_id"]), "item_id")


def cleaned(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without those that hold an item."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
