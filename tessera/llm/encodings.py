"""Text that was decoded with the wrong character encoding: find it and restore it.

Method: a wrong code page acts as a substitution cipher. ``CIPHERS`` holds the ways in which
bytes written in one encoding can be read in another; which of them struck is unknown and
differs by source. Expectation-maximisation learns, against language bigrams of the whole
collection, how often each cipher struck in each source and which letter each unit of a cipher
(the characters that one letter was read as) stands for: the E step weighs the ciphers of every
suspicious run by the gain in bigram likelihood, the M step sums those weights by source and by
unit. The learnt key is then applied: the units of a run go through the learnt table of its
cipher (``str.translate`` where units are single characters). The encodings are the exact
check: a run that the table turns into text which would not have been read as that run is
converted by the encodings instead; ``by_table`` counts the runs that the table restored.

Everything is counted over all documents. What reaches the driver is bounded: bigrams over a
fixed alphabet (``symbol``), weights by (group of sources, cipher), where there are GROUPS
groups, and the likeliest letter by (cipher, unit), whose number the code pages bound.

Defined cases: null and empty texts are no cases; text already right is left alone; a text
with replacement characters is a case that cannot be restored; a quoted sequence that only
shows such a fault (``mentioned``) is no case; text encoded twice is decoded twice.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint, spread

LOST = "�"
NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def _page(name: str) -> dict[int, int]:
    """Character -> byte of a single-byte code page; bytes it leaves out stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            table.setdefault(b, b)
    return table


#: The encodings that are commonly confused.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_15")
DOUBLE = ("gbk", "big5", "cp932", "euc_kr")
#: Swaps that are rarer still: they must gain more.
FAR = (
    *((w, t) for w in ("cp850", "cp1250", "iso8859_15") for t in ("cp1252", "mac_roman", "cp437")),
    *((w, t) for w in ("cp1252", "mac_roman", "cp437") for t in ("cp850", "cp1250", "cp1251", "koi8_r", "cp866")),
    *((w, t) for w in ("cp1251", "koi8_r", "cp866") for t in ("cp1251", "koi8_r", "cp866", "cp1252") if w != t),
)
#: (read as, written in)
CIPHERS: tuple[tuple[str, str], ...] = (
    *((w, "utf-8") for w in SINGLE),
    *((w, "utf-8") for w in DOUBLE),
    *((w, t) for w in ("cp1252", "latin-1", "mac_roman", "cp437", "cp1251") for t in (*DOUBLE, "euc_jp")),
    *((w, t) for w in ("cp1252", "mac_roman", "cp437") for t in ("cp1252", "mac_roman", "cp437") if w != t),
    *((w, t) for w in DOUBLE for t in DOUBLE if w != t),
    *FAR,
)
PAGES = {w: _page(w) for w in SINGLE}
#: Stretches that a page can have produced; of multi-byte encodings all that is not lost.
STRETCH = {w: re.compile("[\\x00-\\x7f" + re.escape("".join(map(chr, sorted(t)))) + "]+") for w, t in PAGES.items()} | {w: re.compile(f"[^{LOST}]+") for w in DOUBLE}


def to_bytes(text: str, read_as: str) -> bytes | None:
    """The bytes that, read as *read_as*, gave *text*."""
    try:
        if read_as in PAGES:
            return text.translate(PAGES[read_as]).encode("latin-1")
        return text.encode(read_as)
    except UnicodeEncodeError:
        return None


def decipher(text: str, cipher: tuple[str, str]) -> str | None:
    """*text* under *cipher*, if all of it can be converted and something changes."""
    return decoded(text, to_bytes(text, cipher[0]), cipher[1])


def decoded(text: str, data: bytes | None, written: str) -> str | None:
    if data is None:
        return None
    try:
        plain = data.decode(written)
    except UnicodeDecodeError:
        return None
    return plain if plain != text and not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", plain) else None


# --- language bigrams ---------------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def symbol(c: str) -> str:
    """The letter of the model's alphabet for *c*: a fixed set of a few thousand symbols."""
    o = ord(c)
    if o < 128:
        return "0" if c.isdigit() else " " if c.isspace() else c.lower()
    if 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return "一"
    if 0xAC00 <= o <= 0xD7AF:
        return "가"
    if o < 0x600 or 0x2010 <= o <= 0x206F or 0x20A0 <= o <= 0x20CF or 0x2100 <= o <= 0x27BF or 0x3000 <= o <= 0x30FF or 0xFF00 <= o <= 0xFFEF:
        return c.lower() if len(c.lower()) == 1 else c
    return ""


class Bigrams:
    """Bigram model over ``symbol`` with a unigram model of Chinese characters and Hangul."""

    def __init__(self, pairs: dict[tuple[str, str], int], singles: dict[str, int]):
        self.pairs = pairs
        self.first: dict[str, int] = defaultdict(int)
        self.second: dict[str, int] = defaultdict(int)
        for (a, b), n in pairs.items():
            self.first[a] += n
            self.second[b] += n
        self.total = sum(self.second.values()) + 1
        self.singles, self.all_singles = singles, sum(singles.values()) + 1
        self.memo: dict[tuple[str, str], float] = {}

    def step(self, a: str, b: str) -> float:
        got = self.memo.get((a, b))
        if got is None:
            sa, sb = symbol(a), symbol(b)
            base = (self.second.get(sb, 0) + 0.05) / (self.total + 300)
            p = (self.pairs.get((sa, sb), 0) + 4 * base) / (self.first.get(sa, 0) + 4)
            if sb in "一가":
                p *= (self.singles.get(b, 0) + 0.05) / (self.all_singles + 2000)
            got = self.memo[(a, b)] = math.log(p)
            if len(self.memo) > 400_000:
                self.memo.clear()
        return got

    def surprise(self, line: str) -> float:
        """Cost of the least expected step to or from a character beyond ASCII."""
        most, last = 0.0, " "
        for c in line:
            if (c > "\x7f" or last > "\x7f") and (cost := -self.step(last, c)) > most:
                most = cost
            last = c
        return max(most, -self.step(last, " ")) if last > "\x7f" else most

    def score(self, text: str, before: str = " ", after: str = " ") -> float:
        total, last = 0.0, before
        for c in text:
            total += self.step(last, c)
            last = c
        return total + self.step(last, after)


#: Control characters, or more accented letters and signs in a row than any language has.
HIGH_RUN = re.compile("[\x80-\x9f]|[\u00a0-\u00ff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2026\u2030\u2039\u203a\u20ac\u2122]{4}")


#: Signs that stand for lead bytes when UTF-8 is read as Mac Roman; letters and quotes alone prove nothing.
SIGNS = re.compile("[√¬‚∂∑∏π∫Ω≈∆◊†‡]")


def suspicious(line: str) -> bool:
    """Whether a line may be garbled: left out when the language model is counted."""
    if LOST in line or HIGH_RUN.search(line):
        return True
    for run in NON_ASCII.findall(line):
        if max(run) >= "\u3000":  # no single-byte page holds it
            continue
        for w in ("cp1252", "cp437", "cp1251", *(("mac_roman",) if SIGNS.search(run) else ())):
            plain = decipher(run, (w, "utf-8"))
            if plain is not None and len(plain) < len(run):
                return True
    return False


# --- whole batches as arrays -----------------------------------------------------------------


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Code point -> code point of its symbol; 0 for the empty symbol."""
    table = np.zeros(0x110000, dtype=np.int32)
    for block in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)):
        table[block[0] : block[1] + 1] = ord("一")
    table[0xAC00:0xD7B0] = ord("가")
    for block in ((0, 0x5FF), (0x2010, 0x206F), (0x20A0, 0x20CF), (0x2100, 0x27BF), (0x3000, 0x30FF), (0xFF00, 0xFFEF)):
        for o in range(block[0], block[1] + 1):
            table[o] = ord(symbol(chr(o)) or "\0")
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def count_bigrams(texts: Iterable[str]) -> tuple[Counter, Counter]:
    """Pairs of symbols of all lines that are not suspicious, and their Chinese characters and Hangul."""
    pairs, singles = Counter(), Counter()
    lines = [line for text in texts for line in text.split("\n") if line and (line.isascii() or not suspicious(line))]
    if not lines:
        return pairs, singles
    points = code_points(" " + " \n ".join(lines) + " ")
    codes = symbol_table()[points].astype(np.int64)
    codes[points == 10] = -1  # the line end keeps its own, so that pairs over it can be left out
    inside = (codes[:-1] >= 0) & (codes[1:] >= 0)
    both, n = np.unique((codes[:-1] << 21 | codes[1:])[inside], return_counts=True)
    letter = lambda o: chr(o) if o else ""
    for x, k in zip(both.tolist(), n.tolist(), strict=True):
        pairs[letter(x >> 21), letter(x & 0x1FFFFF)] += k
    each, n = np.unique(points[(codes == ord("一")) | (codes == ord("가")) | (codes == 0)], return_counts=True)
    for x, k in zip(each.tolist(), n.tolist(), strict=True):
        singles[chr(x)] += k
    return pairs, singles


class Surprises:
    """``Bigrams.surprise`` of all lines of a batch at once."""

    def __init__(self, model: Bigrams):
        known = sorted({x for pair in model.pairs for x in pair})
        table = symbol_table()
        at = np.full(0x110000, len(known), dtype=np.int32)  # symbols never seen share the last place
        for k, x in enumerate(known):
            at[ord(x) if x else 0] = k
        self.place = at[table]
        n = len(known) + 1
        second, first = np.zeros(n, dtype=np.float32), np.zeros(n, dtype=np.float32)
        for k, x in enumerate(known):
            second[k], first[k] = model.second.get(x, 0), model.first.get(x, 0)
        number = {x: k for k, x in enumerate(known)}
        counts = np.zeros((n, n), dtype=np.float32)
        for (a, b), k in model.pairs.items():
            counts[number[a], number[b]] = k
        base = (second + 0.05) / (model.total + 300)
        self.cost = -np.log((counts + 4 * base) / (first + 4)[:, None])
        self.single = np.zeros(0x110000, dtype=np.float32)
        self.single[(table == ord("一")) | (table == ord("가")) | (table == 0)] = -math.log(0.05 / (model.all_singles + 2000))
        for c, k in model.singles.items():
            self.single[ord(c)] = -math.log((k + 0.05) / (model.all_singles + 2000))

    def lines(self, texts: list[str]) -> Iterator[list[float]]:
        """For each text the surprise of each of its lines; lines of ASCII have none."""
        points = code_points("\n" + "\n".join(texts) + "\n")
        p = self.place[points]
        cost = self.cost[p[:-1], p[1:]] + self.single[points[1:]]
        cost[(points[:-1] <= 0x7F) & (points[1:] <= 0x7F)] = 0.0
        ends = np.flatnonzero(points == 10)
        most = np.maximum.reduceat(cost, ends[:-1]).tolist() if len(ends) > 1 else []
        at = 0
        for text in texts:
            n = text.count("\n") + 1
            yield most[at : at + n]
            at += n


# --- runs and their readings --------------------------------------------------------------

QUOTES_BEFORE, QUOTES_AFTER = "\"'“‘«「『：:(（`", "\"'”’»」』，,.。)）`"


def mentioned(line: str, start: int, end: int) -> bool:
    """Whether line[start:end] is quoted alone, as an example of a fault."""
    while start > 0 and end < len(line) and line[start] in QUOTES_BEFORE:
        start += 1
    before, after = line[start - 1 : start], line[end : end + 1]
    return end - start <= 6 and bool(before) and before in QUOTES_BEFORE and (after in QUOTES_AFTER if after else before in "：:")


def pieces(line: str, read_as: str) -> list[tuple[int, int]]:
    """Stretches of *line* that the code page can have produced and that hold more than ASCII."""
    return [m.span() for m in STRETCH[read_as].finditer(line) if not m[0].isascii()]


class Reading:
    """One way to read part of a line."""

    __slots__ = ("start", "end", "plain", "cipher", "gain")

    def __init__(self, start: int, end: int, plain: str, cipher: tuple[str, str], gain: float):
        self.start, self.end, self.plain, self.cipher, self.gain = start, end, plain, cipher, gain


#: Gain in log likelihood over the text as it stands, at least, and per garbled character.
LEAST_GAIN, LEAST_VALID, LEAST_FAR, GAIN_PER_CHARACTER = 6.0, 2.0, 20.0, 0.25
#: A line whose least expected step costs less than this is right as it stands.
SURPRISE = 11.5


def readings(line: str, model: Bigrams) -> Iterator[Reading]:
    """All readings that are clearly likelier than the text as it stands."""
    runs = [m.span() for m in NON_ASCII.finditer(line)]
    seen: dict[tuple[int, int, str], None] = {}
    stretches: dict[str, list[tuple[int, int]]] = {}
    encoded: dict[tuple[str, int, int], bytes | None] = {}
    offered = False
    explained: dict[str, int] = defaultdict(int)  # runs that are valid UTF-8 by page: random letters hardly ever form many valid sequences
    told = sum(end - start for start, end in runs) >= 8
    for cipher in CIPHERS:
        read_as, written = cipher
        if told and (written != "utf-8" or read_as not in PAGES) and max(explained.values(), default=0) == len(runs) or cipher in FAR and offered:
            return
        if written != "utf-8" and read_as not in stretches:
            stretches[read_as] = pieces(line, read_as)
        spans = runs if written == "utf-8" else stretches[read_as]
        for start, end in spans:
            text = line[start:end]
            if written == "utf-8" and LOST in text:
                continue
            if (read_as, start, end) not in encoded:
                encoded[read_as, start, end] = to_bytes(text, read_as)
            plain = decoded(text, encoded[read_as, start, end], written)
            if plain is None or (start, end, plain) in seen:
                continue
            if written != "utf-8":  # trim what stays the same, so that only the garbled part is weighed
                a = 0
                while a < min(len(text), len(plain)) and text[a] == plain[a]:
                    a += 1
                z = 0
                while z < min(len(text), len(plain)) - a and text[-1 - z] == plain[-1 - z]:
                    z += 1
                start, end, text, plain = start + a, end - z, text[a : len(text) - z], plain[a : len(plain) - z]
                if (start, end, plain) in seen:
                    continue
            seen[(start, end, plain)] = None
            before, after = line[start - 1 : start] or " ", line[end : end + 1] or " "
            stands = model.score(text, before, after)
            valid = written == "utf-8" and read_as in PAGES
            least = (LEAST_VALID if valid else LEAST_FAR if cipher in FAR else LEAST_GAIN) + GAIN_PER_CHARACTER * sum(c > "\x7f" for c in text)
            once = plain
            for _ in range(3):  # text encoded wrongly more than once is read more than once
                gain = model.score(plain, before, after) - stands
                if gain >= least:
                    offered = True
                    explained[read_as] += valid and plain is once
                    yield Reading(start, end, plain, cipher, gain)
                again = decipher(plain, cipher) if written == "utf-8" else None
                if again is None or len(again) >= len(plain):
                    break
                plain = again


def best_readings(line: str, source: int, offered: list[Reading], key: Key, number: dict) -> list[Reading]:
    """Those of the *offered* readings that do not overlap and together gain most (weighted interval scheduling)."""
    found = sorted((r for r in offered if not mentioned(line, r.start, r.end)), key=lambda r: r.end)
    if not found:
        return []
    ends = [r.end for r in found]
    best: list[tuple[float, int]] = [(0.0, -1)]  # gain of the first i readings; the one taken
    for i, r in enumerate(found):
        earlier = bisect_right(ends, r.start, 0, i)
        taken = best[earlier][0] + r.gain + key.log_prior(source, number[r.cipher])
        best.append((taken, i) if taken > best[i][0] else (best[i][0], -1))
    chosen, i = [], len(found)
    while i > 0:
        if best[i][1] < 0:
            i -= 1
        else:
            chosen.append(found[i - 1])
            i = bisect_right(ends, found[i - 1].start, 0, i - 1)
    return chosen[::-1]


def units(garbled: str, plain: str, cipher: tuple[str, str]) -> Iterator[tuple[str, str]]:
    """The substitution pairs of a reading: what stands in the text, and the one letter it stands for.

    Both sides are walked by the bytes they share; a pair is given wherever one letter of the
    plain text and whole characters of the garbled text take up the same bytes.
    """
    read_as, written = cipher
    try:
        ours = [1 if read_as in PAGES else len(c.encode(read_as)) for c in garbled]
        theirs = [len(c.encode(written)) for c in plain]
    except UnicodeEncodeError:
        return
    i, at, ahead = 0, 0, 0  # characters taken of the garbled text, its bytes, and bytes of the plain text
    for c, n in zip(plain, theirs, strict=True):
        begin, aligned = i, at == ahead
        ahead += n
        while i < len(ours) and at < ahead:
            at += ours[i]
            i += 1
        unit = garbled[begin:i]
        if aligned and at == ahead and unit and not unit.isascii():
            yield unit, c


class Key:
    """What was learnt: log weights by group of sources and cipher, and the letters of units by cipher."""

    def __init__(self, weights: dict[tuple[int, int], float], letters: dict[tuple[int, str], str]):
        self.prior: dict[tuple[int, int], float] = {}
        totals: dict[int, float] = defaultdict(float)
        for (source, _), w in weights.items():
            totals[source] += w
        for (source, k), w in weights.items():
            self.prior[(source, k)] = math.log((w + 0.1) / (totals[source] + 0.1 * len(CIPHERS)))
        self.floor = {s: math.log(0.1 / (t + 0.1 * len(CIPHERS))) for s, t in totals.items()}
        by: dict[int, dict[str, str]] = defaultdict(dict)
        for (k, unit), letter in letters.items():
            by[k][unit] = letter
        #: By cipher: the table of single characters, the table of longer units, and their lengths.
        self.tables = {k: ({ord(u): c for u, c in table.items() if len(u) == 1}, table, sorted({len(u) for u in table} - {1}, reverse=True)) for k, table in by.items()}

    def log_prior(self, source: int, k: int) -> float:
        return self.prior.get((source, k), self.floor.get(source, 0.0))

    def translate(self, text: str, k: int) -> str:
        """*text* through the learnt table of cipher *k*; what the table does not hold stays."""
        if k not in self.tables:
            return text
        single, table, lengths = self.tables[k]
        if lengths:
            out, i = [], 0
            while i < len(text):
                for n in lengths:
                    if (c := table.get(text[i : i + n])) is not None and i + n <= len(text):
                        out.append(c)
                        i += n
                        break
                else:
                    out.append(text[i].translate(single))
                    i += 1
            return "".join(out)
        return text.translate(single)


NO_KEY = Key({}, {})


def offers(text: str, model: Bigrams, surprises: list[float]) -> dict[int, list[Reading]]:
    """The readings of each line that has any; lines with little surprise are right as they stand."""
    if max(surprises, default=0.0) < SURPRISE:
        return {}
    found = ((n, list(readings(line, model))) for n, (line, cost) in enumerate(zip(text.split("\n"), surprises, strict=True)) if cost >= SURPRISE)
    return {n: r for n, r in found if r}


def packed(offered: dict[int, list[Reading]]) -> str:
    number = {c: k for k, c in enumerate(CIPHERS)}
    return json.dumps([[n, r.start, r.end, r.plain, number[r.cipher], r.gain] for n, found in offered.items() for r in found])


def unpacked(text: str) -> dict[int, list[Reading]]:
    out: dict[int, list[Reading]] = {}
    for n, start, end, plain, k, gain in json.loads(text):
        out.setdefault(n, []).append(Reading(start, end, plain, CIPHERS[k], gain))
    return out


def expect(texts: Iterable[tuple[int, str, dict[int, list[Reading]]]], key: Key) -> tuple[Counter, Counter]:
    """E step over (group of sources, text, readings by line): expected uses by (group, cipher) and of (cipher, unit, letter)."""
    used: Counter = Counter()
    letters: Counter = Counter()
    number = {c: k for k, c in enumerate(CIPHERS)}
    for source, text, by_line in texts:
        lines = text.split("\n")
        for n, offered in by_line.items():
            line = lines[n]
            spans: dict[tuple[int, int], list[Reading]] = {(r.start, r.end): [] for r in best_readings(line, source, offered, key, number)}
            for r in offered:
                if (r.start, r.end) in spans:
                    spans[(r.start, r.end)].append(r)
            for (start, end), found in spans.items():
                logs = [0.0] + [r.gain + key.log_prior(source, number[r.cipher]) for r in found]
                top = max(logs)
                share = [math.exp(x - top) for x in logs]
                whole = sum(share)
                for r, s in zip(found, share[1:], strict=True):
                    w = s / whole
                    if w > 0.01:
                        k = number[r.cipher]
                        used[(source, k)] += w
                        for u, c in units(line[start:end], r.plain, r.cipher):
                            letters[(k, u, c)] += w
    return used, letters


def applied(garbled: str, r: Reading, key: Key, k: int) -> tuple[str, bool]:
    """A run by the learnt table of its cipher, and whether the exact check agrees; else by the encodings.

    The check: written in the cipher's encoding and read in the wrong one, the text is the run again.
    """
    plain = key.translate(garbled, k)
    try:
        data = to_bytes(garbled, r.cipher[0])
        right = plain != garbled and plain.encode(r.cipher[1]) == data
    except UnicodeEncodeError:
        right = False
    if right and r.plain != plain:  # garbled more than once: the reading went on
        again = decipher(plain, r.cipher)
        right = again is None or again != r.plain
    return (plain, True) if right and len(plain) <= len(r.plain) else (r.plain, False)


def restore(text: str, source: int, model: Bigrams, key: Key, offered: dict[int, list[Reading]], times: int = 3) -> tuple[str, int, int, int]:
    """The text restored as far as possible, runs restored, those by the learnt table, and characters lost for good; lines that change are read again."""
    number = {c: k for k, c in enumerate(CIPHERS)}
    out, fixed, by_table, lost = [], 0, 0, 0
    for n, line in enumerate(text.split("\n")):
        for round_ in range(times):
            if line.isascii():
                break
            best = best_readings(line, source, (list(readings(line, model)) if model.surprise(line) >= SURPRISE else []) if round_ else offered.get(n, []), key, number)
            if not best:
                break
            fixed += len(best) if not round_ else 0
            damaged = LOST in line
            k = number[best[0].cipher]
            for r in sorted(best, key=lambda r: -r.start):
                plain, learnt = applied(line[r.start : r.end], r, key, number[r.cipher])
                by_table += learnt and not round_
                line = line[: r.start] + plain + line[r.end :]
            if damaged:
                line = NON_ASCII.sub(lambda m, k=k: key.translate(m[0], k) if LOST in m[0] else m[0], line)
        for m in re.finditer(LOST + "+", line):
            lost += 0 if mentioned(line, *m.span()) else 1
        out.append(line)
    return "\n".join(out), fixed, by_table, lost


# --- Spark ---------------------------------------------------------------------------------


def language_model(documents: DataFrame) -> Bigrams:
    """Bigrams of all documents, added up per batch and then by key; the alphabet bounds the result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, singles = Counter(), Counter()
        for batch in batches:
            p, s = count_bigrams(batch["text"])
            pairs.update(p)
            singles.update(s)
        rows = [(a, b, n) for (a, b), n in pairs.items()] + [("single", c, n) for c, n in singles.items()]
        yield pd.DataFrame(rows, columns=["a", "b", "n"])

    rows = _texts(documents).select("text").mapInPandas(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return Bigrams({(a, b): n for a, b, n in rows if a != "single"}, {b: n for a, b, n in rows if a == "single"})


def candidates(documents: DataFrame, model: Bigrams) -> DataFrame:
    """``doc_id, source, text, offered`` of the documents that can be read otherwise anywhere, or have lost letters.

    Which readings a line has depends on the language model alone, not on what the rounds
    learn, so they are made once, and all later passes need no other documents. The result is
    checkpointed.
    """
    broadcast = documents.sparkSession.sparkContext.broadcast((model.pairs, model.singles))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Bigrams(*broadcast.value)
        all_lines = Surprises(m)
        for batch in batches:
            texts = batch["text"].tolist()
            offered = [offers(text, m, cost) for text, cost in zip(texts, all_lines.lines(texts), strict=True)]
            batch["offered"] = [packed(o) for o in offered]
            yield batch[[bool(o) or LOST in text for o, text in zip(offered, texts, strict=True)]]

    texts = _texts(documents).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    return checkpoint(texts.mapInPandas(run, "doc_id long, text string, source int, offered string"))


#: Groups of sources: what is learnt by source is learnt by the hash of its name, so that any number of sources is bounded.
GROUPS = 256


def learn(worth: DataFrame, rounds: int = 2) -> Key:
    """Expectation-maximisation over all candidates, *rounds* passes."""
    key = NO_KEY
    for _ in range(rounds):
        weights_so_far = key.prior, key.floor

        def run(batches: Iterator[pd.DataFrame], known=weights_so_far) -> Iterator[pd.DataFrame]:
            k = Key({}, {})
            k.prior, k.floor = known
            used, letters = Counter(), Counter()
            for batch in batches:
                u, x = expect(zip(batch["source"].tolist(), batch["text"], map(unpacked, batch["offered"]), strict=True), k)
                used.update(u)
                letters.update(x)
            rows = [(s, c, "", "", w) for (s, c), w in used.items()] + [(-1, c, u, x, w) for (c, u, x), w in letters.items()]
            yield pd.DataFrame(rows, columns=["source", "cipher", "unit", "letter", "w"])

        sums = worth.mapInPandas(run, "source int, cipher int, unit string, letter string, w double").groupBy("source", "cipher", "unit", "letter").agg(F.sum("w").alias("w"))
        rows = sums.groupBy("source", "cipher", "unit").agg(F.sum("w").alias("w"), F.max_by("letter", F.struct("w", "letter")).alias("letter")).collect()
        key = Key({(r.source, r.cipher): r.w for r in rows if r.source >= 0}, {(r.cipher, r.unit): r.letter for r in rows if r.source < 0})
    return key


def _texts(documents: DataFrame) -> DataFrame:
    name = F.coalesce(F.lower(F.regexp_replace("source", "[^A-Za-z0-9]+", "_")), F.lit("")) if "source" in documents.columns else F.lit("")
    source = F.pmod(F.xxhash64(name), F.lit(GROUPS)).cast("int")
    return spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source.alias("source")).where(F.length("text") > 0), "doc_id")


GARBLED = "doc_id long, runs int, by_table int, lost int, restored string"


def garbled(documents: DataFrame, rounds: int = 2) -> DataFrame:
    """``doc_id, runs, by_table, lost, restored`` of every garbled document; restored is null if letters are lost."""
    model = language_model(documents)
    worth = candidates(documents, model)
    key = learn(worth, rounds)
    broadcast = documents.sparkSession.sparkContext.broadcast((model.pairs, model.singles, key))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, singles, k = broadcast.value
        m = Bigrams(pairs, singles)
        for batch in batches:
            out = []
            for i, source, text, offered in zip(batch["doc_id"], batch["source"].tolist(), batch["text"], batch["offered"], strict=True):
                plain, runs, by_table, lost = restore(text, source, m, k, unpacked(offered))
                if runs or lost:
                    out.append((i, runs, by_table, lost, None if lost else plain))
            yield pd.DataFrame(out, columns=["doc_id", "runs", "by_table", "lost", "restored"])

    return worth.mapInPandas(run, GARBLED).dropDuplicates(["doc_id"])
