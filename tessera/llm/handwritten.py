"""Files that nobody wrote by hand: generated, minified or bundled, third-party, or data kept as code.

Method: character n-gram models of the identifiers of each language, trained on all files.
Names are mangled if their cross-entropy lies far above what is usual in the language and they
are far shorter than usual. Names that mostly differ by numbers only (low diversity of
templates) were made by a tool. A file whose identifiers are put together in another way than
those of its language, under a name of a rare style, is foreign. "Usual" is measured over all
files of the language: the median and its robust deviation.

Beside the models stand notices, suffixes, folders and the form of the text (``told``), since
generated files of this project read like hand-written ones, and runs of ``BLOCKS`` blocks of
code that stand in at least two repositories, since copies do too. ``evidence`` names what
decided a row.

Nothing is compared in pairs. The models that reach the driver are bounded by the alphabet of
``folded``, three letters long, for each language of CODE. Shared blocks are counted by hash,
combined on the map side, and joined back; a library that a third of all files copy is dealt
out by its measured count.

Defined cases: null and empty content is judged by its path alone; files delivered twice give
one row; files without identifiers have no cross-entropy; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint, spread

#: Blocks of code (between blank lines) in a row that must agree to count as a copy; least letters of one.
BLOCKS, BLOCK_LETTERS = 5, 20
#: Share of a file's runs of blocks that stand in other repositories, from which on it is a copy.
COPIED = 0.5
#: Names that a file must hold for its cross-entropy, diversity and style to say anything.
LEAST_NAMES = 40
#: Robust deviations from what is usual in the language, beyond which names are mangled or their style is foreign.
SPREADS = 6.0
#: Share of different templates among a file's names, below which a tool has made them.
TEMPLATES = 0.5
#: A stem style of less than this share of a language's files is foreign.
FOREIGN = 0.15
#: A run of blocks with more than one in so many of all rows is dealt into parts for the join.
HOT = 1024

CODE = {"js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "dart", "vue", "java", "kt", "go", "rb", "php", "c", "cc", "cpp", "h", "cs", "swift", "css", "scss"}
# Names that tools give to what they write.
LOCK_FILES = re.compile(
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|bun\.lockb?|composer\.lock|Gemfile\.lock|Podfile\.lock|Pipfile\.lock|poetry\.lock|uv\.lock|pdm\.lock"
    r"|Cargo\.lock|pubspec\.lock|mix\.lock|go\.sum|flake\.lock|packages\.lock\.json|gradle\.lockfile)$"
)
GENERATED_NAME = re.compile(r"(?:\.(?:g|gr|freezed|pb|pbenum|pbjson|pbserver|pbgrpc|mocks|chopper|reflectable|generated|gen|g2)\.\w+|_pb2(?:_grpc)?\.pyi?|_pb\.(?:d\.)?[jt]s|_grpc_pb\.[jt]s|_generated\.\w+)$")
GENERATED_FOLDER = re.compile(r"(?:^|/)(?:__generated__|generated|gen|autogen|auto_generated|\.dart_tool|generated-src)/")
MINIFIED_NAME = re.compile(r"(?:[.-]min\.(?:m?js|css)|\.bundle\.js|\.chunk\.js|[a-z0-9][.-][0-9a-f]{8,32}(?:\.chunk)?\.(?:m?js|css))$")
VENDOR_FOLDER = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|vendored|third[_-]?party|3rdparty|extern|external|externals|Pods|Carthage|site-packages|\.pub-cache)/")
COMMENT = re.compile(r"^\s*(?://+|#+|/\*+!?|\*+|<!--|--|;+)\s?(.*?)\s*(?:\*/|-->)?\s*$")
NOTICE = re.compile(
    r"""(?ix) ^@generated\b | ^code\ generated\ by\b.*do\ not\ edit
    | \bauto(?:matically)?[\s-]*generated\s+(?:file|code|from|by|on|with)\b | \bgenerated\s+(?:code|file)\b.*\bdo\ not\b
    | \b(?:file|code|module|class)\ (?:is|was|has\ been)\ (?:auto(?:matically)?[\s-]*)?(?:generated|produced|created|written)\ (?:by|from|with)\b
    | \b(?:generated|produced|built|compiled)\ (?:from|by)\b.*\b(?:overwritten|will\ be\ lost|do\ not|regenerat\w+|next\ build)\b
    | \bdo\ not\ (?:edit|modify|change|touch)\b.*\b(?:generated|overwritten|regenerated)\b
    | 自动生成.*(?:请勿|不要|切勿|勿).*(?:修改|编辑|改动) | (?:由|通过|使用).{0,12}自动生成"""
)
#: Words of which every notice holds one.
TOLD = re.compile(r"(?i)generated|produced|created|written|built|compiled|自动生成")
LICENSE = re.compile(r"(?i)licen[sc]e|copyright|\(c\)|all rights reserved|SPDX|authors|contributors")
NAME = re.compile(r"[A-Za-z_$][\w$]*")
LITERAL = re.compile(r"""\"\"\"[\s\S]*?(?:\"\"\"|$)|'''[\s\S]*?(?:'''|$)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`""")
COMMENTS = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)|(?m:^\s*#[^\n]*)|<!--[\s\S]*?(?:-->|$)")
SPANS = re.compile(rf"(?P<c>{COMMENTS.pattern})|{LITERAL.pattern}")
#: Lines that may stand above or between the comments at the head of a file.
PROLOGUE = re.compile(r"""\s*(?:$|#!|["']use \w+["'];?\s*$|(?:import|from|package|library|export|part)\b|(?:const|let|var)\s.*\brequire\(|[;!+(]*function\s*\(|<(?:template|script|style)\b)""")


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def stem_style(path: str) -> str:
    """How the name of a file is put together."""
    stem = path.rsplit("/", 1)[-1].split(".", 1)[0]
    if "_" in stem:
        return "snake"
    if "-" in stem:
        return "kebab"
    if re.search(r"[a-z][A-Z]", stem):
        return "camel" if stem[:1].islower() else "pascal"
    return "word"


#: Letters of names that count as one in the models, so that their alphabet is bounded.
DIGIT, FOREIGN_LETTER = re.compile(r"\d"), re.compile(r"[^\x00-\x7f]")


class Source:
    """The text of a file with the places of its comments and literals, which are looked for once."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def spans(self) -> list[tuple[int, int, bool]]:
        """Start, end, and whether it is a comment."""
        return [(*m.span(), m["c"] is not None) for m in SPANS.finditer(self.text)]

    def without(self, comment: str | None, literal: str | None) -> str:
        """The text with comments and literals replaced; None keeps them."""
        out, at = [], 0
        for start, end, is_comment in self.spans:
            put = comment if is_comment else literal
            if put is not None:
                out += [self.text[at:start], put]
                at = end
        return "".join(out) + self.text[at:]

    @cached_property
    def code(self) -> str:
        return self.without(" ", " '' ")

    @cached_property
    def names(self) -> Counter:
        return Counter(NAME.findall(self.code))


def folded(name: str) -> str:
    return FOREIGN_LETTER.sub("¤", DIGIT.sub("0", name.lower()))


@lru_cache(maxsize=1 << 14)
def grams(name: str) -> tuple[str, ...]:
    """Letter trigrams of a name; names recur in many files."""
    s = f"^^{folded(name)}$"
    return tuple(s[i : i + 3] for i in range(len(s) - 2))


#: Ways in which an identifier can be put together.
STYLES = ("short", "upper", "snake", "pascal", "camel", "word")


@lru_cache(maxsize=1 << 14)
def name_style(name: str) -> int:
    """Ordinal of the style of an identifier in STYLES."""
    if len(name) <= 2:
        return 0
    if name.isupper():
        return 1
    if "_" in name.strip("_"):
        return 2
    if name[0].isupper():
        return 3
    return 4 if re.search(r"[a-z][A-Z]", name) else 5


def diversity(words: Iterable[str]) -> float:
    """Share of different templates among different names: names that differ only by numbers have one template."""
    each = set(words)
    return len({folded(re.sub(r"\d+", "0", w)) for w in each}) / len(each) if each else 1.0


class NameModel:
    """Interpolated letter trigram models of names, one for each language."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.three = counts
        self.two: dict[tuple[str, str], int] = defaultdict(int)
        self.one: dict[tuple[str, str], int] = defaultdict(int)
        self.total: dict[str, int] = defaultdict(int)
        for (lang, g), n in counts.items():
            self.two[(lang, g[:2])] += n
            self.one[(lang, g[2])] += n
            self.total[lang] += n
        self.middle: dict[tuple[str, str], int] = defaultdict(int)
        for (lang, g), n in counts.items():
            self.middle[(lang, g[1:])] += n
        self.memo: dict[tuple[str, str], float] = {}
        self.known: dict[tuple[str, str], tuple[float, int]] = {}
        bits: dict[str, float] = defaultdict(float)
        for (lang, g), n in counts.items():
            bits[lang] += n * self.cost(lang, g)
        #: Cross-entropy of each language's own names, bits per letter.
        self.average = {lang: bits[lang] / self.total[lang] for lang in self.total}

    def cost(self, lang: str, g: str) -> float:
        got = self.memo.get((lang, g))
        if got is None:
            p1 = (self.one.get((lang, g[2]), 0) + 0.5) / (self.total.get(lang, 0) + 20)
            p2 = (self.middle.get((lang, g[1:]), 0) + 2 * p1) / (self.one.get((lang, g[1]), 0) + 2) if g[1] != "^" else p1
            p3 = (self.three.get((lang, g), 0) + 2 * p2) / (self.two.get((lang, g[:2]), 0) + 2)
            got = self.memo[(lang, g)] = -math.log2(min(1.0, max(p3, 1e-9)))
        return got

    def cross_entropy(self, lang: str, words: Iterable[str]) -> float:
        """Bits per letter of *words*, each counted once."""
        bits, n = 0.0, 0
        for w in set(words):
            got = self.known.get((lang, w))
            if got is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                got = self.known[(lang, w)] = (sum(self.cost(lang, g) for g in grams(w)), len(grams(w)))
            bits += got[0]
            n += got[1]
        return bits / n if n else 0.0


def comment_lines(source: Source) -> list[tuple[int, str]]:
    """Place and words of every line of comment of the whole text; text within literals is none."""
    text = source.text
    literal, block = [], []
    for start, end, is_comment in source.spans:
        if "\n" in text[start:end]:
            if not is_comment:
                literal.append((start, end))
            elif text[start:end].endswith(("*/", "-->")):
                block.append((start, end))
    out, at, k, j = [], 0, 0, 0
    for line in text.split("\n"):
        while k < len(literal) and literal[k][1] <= at:
            k += 1
        while j < len(block) and block[j][1] <= at:
            j += 1
        if not (k < len(literal) and literal[k][0] < at):
            m = COMMENT.match(line)
            if m:
                out.append((at, m[1]))
            elif j < len(block) and block[j][0] < at:
                out.append((at, line[: block[j][1] - at].strip()))
        at += len(line) + 1
    return out


def has_notice(source: Source) -> bool:
    """Whether a comment anywhere in the file says that a tool wrote it."""
    return bool(TOLD.search(source.text)) and any(NOTICE.search(words) for _, words in comment_lines(source))


def names_library(path: str, source: Source) -> bool:
    """Whether the licence notice above the code names the file itself: its stem or folder."""
    stem = path.rsplit("/", 1)[-1].split(".", 1)[0].lower()
    if len(stem) <= 2 or not LICENSE.search(source.text):
        return False
    comments = dict(comment_lines(source))
    head, at = [], 0
    for line in source.text.split("\n"):
        if at in comments:
            head.append(comments[at])
        elif not PROLOGUE.match(line):
            break
        at += len(line) + 1
    joined = " ".join(head).lower()
    return bool(LICENSE.search(joined)) and bool(re.search(rf"(?<![\w-]){re.escape(stem)}(?![\w-])", joined)) and bool(re.search(r"\d+\.\d+|(?:19|20)\d\d", joined))


def is_lock(ext: str, text: str) -> bool:
    """Whether a settings file has a lockfileVersion, wherever it stands."""
    return ext in ("json", "yaml", "yml") and bool(re.search(r'"lockfileVersion"\s*:|^lockfileVersion\s*:', text, re.M))


def collapsed(text: str) -> bool:
    """Whether line breaks were squeezed out: most of the text is one long line full of statements."""
    longest = max(text.split("\n"), key=len)
    marks = sum(longest.count(c) for c in ";{}")
    return len(longest) >= 500 and len(longest) >= 0.7 * len(text) and marks >= 10 and marks >= 0.012 * len(longest)


def is_data(ext: str, source: Source) -> bool:
    """Whether a code file is nearly all numbers and literals."""
    if ext not in CODE - {"css", "scss", "vue"} or len(source.text) < 500:
        return False
    code = source.without("", "")
    literals = [source.text[start:end] for start, end, is_comment in source.spans if not is_comment]
    letters = sum(map(len, NAME.findall(code)))
    if letters > 0.08 * (len(code) + sum(map(len, literals))):
        return False
    numbers = len(re.findall(r"(?<![\w.])-?\d[\w.]*", code))
    longest = max(literals, key=len, default="")
    return numbers >= 40 or numbers + len(literals) >= 60 or len(longest) >= 400 and not re.search(r"\s", longest[1:-1])


def block_runs(source: Source) -> list[int]:
    """Hashes of BLOCKS blocks of code in a row, or of the whole if it has fewer."""
    blocks = []
    for b in re.split(r"\n[ \t\r]*\n", source.without("", None).replace("\r\n", "\n")):
        squeezed = "".join(b.split())
        if len(squeezed) >= BLOCK_LETTERS:
            blocks.append(squeezed)
    if len(blocks) < BLOCKS:
        whole = "".join(blocks)
        return [xxhash.xxh3_64_intdigest(whole.encode()) - (1 << 63)] if len(whole) >= 800 else []
    return list({xxhash.xxh3_64_intdigest("\n".join(blocks[i : i + BLOCKS]).encode()) - (1 << 63) for i in range(len(blocks) - BLOCKS + 1)})


def told(path: str, ext: str, source: Source) -> str:
    """The kind that the path, a notice or the form of the text tells, beside the models; or ""."""
    text = source.text
    if LOCK_FILES.search(path) or is_lock(ext, text):
        return "lock file"
    if text and has_notice(source) or GENERATED_NAME.search(path) or GENERATED_FOLDER.search(path):
        return "generated"
    if MINIFIED_NAME.search(path) or text and ext in CODE and collapsed(text):
        return "minified"
    if VENDOR_FOLDER.search(path) or text and names_library(path, source):
        return "third-party"
    return "data" if text and is_data(ext, source) else ""


#: Names of a partition that are counted before their trigrams are added up.
MOST_NAMES = 200_000


def name_model(files: DataFrame) -> NameModel:
    """Letter trigrams of the names of all files, each name once a file, added up by language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Counter = Counter()
        counts: Counter = Counter()

        def add_up() -> None:
            for (ext, w), n in known.items():
                for g in grams(w):
                    counts[ext, g] += n
            known.clear()

        for batch in batches:
            for path, text in zip(batch["file_path"], batch["content"], strict=True):
                ext = extension(path)
                if ext in CODE:
                    known.update((ext, w) for w in Source(text).names)
            if len(known) > MOST_NAMES:
                add_up()
        add_up()
        yield pd.DataFrame([(lang, g, n) for (lang, g), n in counts.items()], columns=["lang", "gram", "n"])

    rows = (
        spread(files.select("file_path", "content").where(F.col("file_path").isNotNull() & (F.length("content") > 0)), "file_path")
        .mapInPandas(run, "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return NameModel({(r.lang, r.gram): r.n for r in rows})


FEATURES = "file_id long, repo string, ext string, style string, told string, n_names long, bits double, letters double, diversity double, styles array<double>, runs array<long>"


def features(files: DataFrame, model: NameModel) -> DataFrame:
    """One row per file: what the models measure, and what path and notices tell. Checkpointed, since it is read several times."""
    known = files.sparkSession.sparkContext.broadcast(model.three)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = NameModel(known.value)
        for batch in batches:
            out = []
            for i, repo, path, text in zip(batch["file_id"], batch["repo"], batch["file_path"], batch["content"], strict=True):
                path, source = path or "", Source(text or "")
                ext = extension(path)
                n, bits, letters, alike, styles, runs = 0, 0.0, 0.0, 1.0, [0.0] * len(STYLES), []
                if ext in CODE and source.text:
                    words = source.names
                    n = words.total()
                    if n:
                        bits = m.cross_entropy(ext, words)
                        letters = sum(map(len, words)) / len(words)
                        alike = diversity(words) if len(words) >= LEAST_NAMES else 1.0
                        for w, k in words.items():
                            styles[name_style(w)] += k / n
                    runs = block_runs(source)
                out.append((i, repo, ext, stem_style(path), told(path, ext, source), n, bits, letters, alike, styles, runs))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FEATURES.split(", ")])

    columns = files.select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("repo", F.lit("")).alias("repo"), "file_path", "content")
    return checkpoint(spread(columns, "file_id").mapInPandas(run, FEATURES).dropDuplicates(["file_id"]))


class Limits(NamedTuple):
    """What is usual in a language: the most bits a letter, the fewest letters a name, the most divergence of styles."""

    bits: float
    letters: float
    styles: list[float]
    divergence: float


def _divergence(own: Column, usual: Column) -> Column:
    """Jensen-Shannon divergence of two distributions over STYLES, in bits."""
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    both = F.zip_with(own, usual, lambda x, y: (half(x, y) + half(y, x)) / 2)
    return F.aggregate(both, F.lit(0.0), lambda a, x: a + x)


def limits(measured: DataFrame) -> dict[str, Limits]:
    """The limits of each language: SPREADS robust deviations from the median of its files. One row a language of CODE."""
    judged_by = measured.where(F.col("ext").isin(sorted(CODE)) & (F.col("n_names") >= LEAST_NAMES))
    middle = {
        r.ext: r
        for r in judged_by.groupBy("ext")
        .agg(F.percentile_approx("bits", 0.5, 10_000).alias("bits"), F.percentile_approx("letters", 0.5, 10_000).alias("letters"), F.array(*(F.avg(F.element_at("styles", k + 1)) for k in range(len(STYLES)))).alias("styles"))
        .collect()
    }
    if not middle:
        return {}
    usual = F.create_map(*(x for e, r in middle.items() for x in (F.lit(e), F.struct(F.lit(r.bits).alias("bits"), F.lit(r.letters).alias("letters"), F.array(*map(F.lit, r.styles)).alias("styles")))))[F.col("ext")]
    off = judged_by.withColumn("usual", usual).select("ext", F.abs(F.col("bits") - F.col("usual.bits")).alias("bits"), F.abs(F.col("letters") - F.col("usual.letters")).alias("letters"), _divergence(F.col("styles"), F.col("usual.styles")).alias("d"))
    out = {}
    for r in off.groupBy("ext").agg(*(F.percentile_approx(c, 0.5, 10_000).alias(c) for c in ("bits", "letters", "d"))).collect():
        m = middle[r.ext]
        # 1.4826 median absolute deviations are one standard deviation of a normal distribution
        out[r.ext] = Limits(m.bits + max(SPREADS * 1.4826 * r.bits, 0.15 * m.bits), m.letters - SPREADS / 2 * 1.4826 * r.letters, list(m.styles), SPREADS * 1.4826 * r.d)
    return out


def shared_runs(measured: DataFrame) -> DataFrame:
    """``file_id, n_shared``: how many of a file's runs of blocks stand in another repository too.

    A run that holds more than one in ``HOT`` of all rows is dealt into parts by its measured
    count. There are at most HOT such runs, so their list can be broadcast.
    """
    runs = measured.select("file_id", "repo", F.explode("runs").alias("run"))
    total = measured.agg(F.sum(F.size("runs"))).first()[0] or 0
    part = max(total // HOT, 1000)
    counts = runs.groupBy("run").agg(F.min("repo").alias("a"), F.max("repo").alias("b"), F.count("*").alias("n")).where("a <> b").select("run", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    hot = counts.where("parts > 1")
    shared = counts.select("run", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = runs.join(F.broadcast(hot), "run", "left").select("file_id", "run", F.pmod(F.xxhash64("file_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return dealt.join(shared, ["run", "part"]).groupBy("file_id").agg(F.count("*").alias("n_shared"))


def judged(files: DataFrame) -> DataFrame:
    """One row per file: kind ("" for hand-written), what told it, and what was measured."""
    measured = features(files, name_model(files))
    usual = limits(measured)
    code = F.col("ext").isin(sorted(CODE))
    enough = code & (F.col("n_names") >= LEAST_NAMES)

    def of(pick: Callable[[Limits], Column | float], otherwise: Column) -> Column:
        """A limit of the row's language."""
        return F.coalesce(F.create_map(*(x for e, u in usual.items() for x in (F.lit(e), pick(u) if isinstance(pick(u), Column) else F.lit(pick(u)))))[F.col("ext")], otherwise) if usual else otherwise

    never, always = F.lit(float("inf")), F.lit(float("-inf"))
    styles = measured.where(code).groupBy("ext", "style").agg(F.count("*").alias("n"))
    totals = styles.groupBy("ext").agg(F.sum("n").alias("of"))
    rare = styles.join(F.broadcast(totals), "ext").select("ext", "style", (F.col("n") < FOREIGN * F.col("of")).alias("foreign"))  # a row for each of CODE and of five styles
    foreign = F.coalesce("foreign", F.lit(False))
    rows = (
        measured.join(shared_runs(measured), "file_id", "left")
        .join(F.broadcast(rare), ["ext", "style"], "left")
        .withColumn("copied", F.coalesce(F.col("n_shared") / F.greatest(F.size("runs"), F.lit(1)), F.lit(0.0)))
        .withColumn("apart", F.when(enough, _divergence(F.col("styles"), of(lambda u: F.array(*map(F.lit, u.styles)), F.col("styles")))).otherwise(F.lit(0.0)))
        .withColumn("mangled", enough & (F.col("bits") > of(lambda u: u.bits, never)) & (F.col("letters") < of(lambda u: u.letters, always)))
        .withColumn("templates", enough & (F.col("diversity") < TEMPLATES))
        .withColumn("style_apart", enough & foreign & (F.col("apart") > of(lambda u: u.divergence, never)))
        .withColumn("copy", code & (F.size("runs") > 0) & (F.col("copied") >= F.when(foreign, COPIED / 2).otherwise(COPIED)))
    )
    first = [
        (F.col("told").isin("lock file", "generated"), F.col("told"), F.lit("told")),
        (F.col("mangled"), F.lit("minified"), F.lit("cross-entropy")),
        (F.col("told") == "minified", F.col("told"), F.lit("told")),
        (F.col("templates"), F.lit("generated"), F.lit("diversity")),
        (F.col("copy"), F.lit("third-party"), F.lit("copied")),
        (F.col("told") != "", F.col("told"), F.lit("told")),
        (F.col("style_apart"), F.lit("third-party"), F.lit("style")),
    ]

    def chosen(which: int) -> Column:
        out = F.lit("")
        for choice in reversed(first):
            out = F.when(choice[0], choice[which]).otherwise(out)
        return out

    return rows.select("file_id", chosen(1).alias("kind"), chosen(2).alias("evidence"), F.round("bits", 4).alias("bits"), F.round("diversity", 4).alias("diversity"), F.round("apart", 4).alias("apart"), F.round("copied", 4).alias("copied"), foreign.alias("foreign_style"))
