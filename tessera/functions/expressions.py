"""Column expressions: pure functions of columns, evaluated in the JVM.

Null in, null out, unless a docstring says otherwise. Patterns are written for Java; word
boundaries are spelled out as ASCII look-around, so that they agree with engines whose ``\\b``
is ASCII.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def word(w: str) -> str:
    """Pattern of *w* as a whole ASCII word."""
    return f"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])"


def js_pattern(pattern: str) -> str:
    """A pattern of a rule as Java reads it: ``$`` is the end of the text only, ``\\b`` is ASCII."""
    out = pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")
    return out[:-1] + r"\z" if out.endswith("$") and not out.endswith(r"\$") else out


def count_of(column: Column | str, pattern: str) -> Column:
    return F.regexp_count(c(column), F.lit(pattern)).cast("long")


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole rounded, 0 where the whole is 0 or null."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))


# --- code metrics ---------------------------------------------------------------------------

#: What adds to cyclomatic complexity. "else if" counts twice, switch and case both count.
DECISIONS = {
    "default": (word("if"), word("else") + r"\s+" + word("if"), word("for"), word("while"), word("switch"), word("case"), word("catch"), r"\?\s*:", "&&", r"\|\|"),
    "dart": (word("if"), word("else") + r"\s+" + word("if"), word("for"), word("while"), word("switch"), word("case"), word("on"), r"\?\s*:", "&&", r"\|\|"),
}


def cyclomatic(body: Column | str, lang: Column | str) -> Column:
    """1 + decisions of the body, by language."""
    def total(patterns: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a + b, (count_of(body, p) for p in patterns)) + 1

    return F.when(c(lang) == "dart", total(DECISIONS["dart"])).otherwise(total(DECISIONS["default"]))


def quality_score(complexity: Column, loc: Column, nesting: Column) -> Column:
    """100 less cumulative penalties on complexity, lines and nesting, within 0..100."""
    over = lambda x, most, weight: F.greatest(x - most, F.lit(0)) * weight
    score = F.lit(100.0) - over(complexity, 10, 2) - over(complexity, 20, 3) - over(loc, 50, 0.5) - over(loc, 100, 1) - over(nesting, 4, 5) - over(nesting, 6, 10)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def complexity_level(complexity: Column, loc: Column, nesting: Column) -> Column:
    def above(a: int, b: int, d: int) -> Column:
        return (complexity > a) | (loc > b) | (nesting > d)

    return F.when(above(50, 200, 8), "very-high").when(above(20, 100, 6), "high").when(above(10, 50, 4), "medium").otherwise("low")


#: Purposes of functions, in order; parts of the lower-case name, its beginnings, and parts of the body.
PURPOSES = (
    ("create", ("create", "add", "insert", "post"), (), ()),
    ("read", ("read", "get", "fetch", "find", "query", "list"), (), ()),
    ("update", ("update", "edit", "modify", "put", "patch"), (), ()),
    ("delete", ("delete", "remove", "destroy"), (), ()),
    ("event-handler", (), ("on", "handle"), ("addeventlistener", ".on(")),
    ("lifecycle", ("init", "mount", "unmount", "will", "did"), (), ()),
    ("hook", (), ("use",), ()),
    ("api-call", (), (), ("fetch(", "axios.", "http.", ".get(", ".post(")),
    ("state-management", (), (), ("setstate", "dispatch", "usestate", "usereducer")),
    ("validation", ("validate", "check", "verify", "is"), (), ()),
    ("utility", ("format", "parse", "convert", "transform", "to", "util"), (), ()),
    ("render", ("draw",), (), ()),
    ("constructor", (), (), ()),
    ("accessor", (), ("get_", "set_"), ()),
)


def purposes(name: Column, body: Column) -> Column:
    """All purposes of a function, in order; "business-logic" if there is none."""
    n, b = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    hits = []
    for label, parts, starts, inner in PURPOSES:
        tests = [n.contains(p) for p in parts] + [n.startswith(s) for s in starts] + [b.contains(i) for i in inner]
        if label == "render":
            tests += [n.isin("render", "build")]
        if label == "constructor":
            tests += [n.isin("constructor", "__init__", "init")]
        if label == "accessor":
            tests += [(n.startswith("get") | n.startswith("set")) & (F.length(n) > 3)]
        hits.append(F.when(reduce(lambda x, y: x | y, tests), F.lit(label)))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("business-logic"))).otherwise(found)


def purpose_confidence(found: Column, name: Column, body: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(F.size(found) > 1, "medium").when((F.length(n) > 0) & F.lower(body).contains(F.regexp_replace(n, "_", "")), "high").otherwise("low")


def access_level(name: Column) -> Column:
    return F.when(name.startswith("_"), "protected").when(name.endswith("_"), "private").otherwise("public")


#: Names that are no calls of the project's own functions.
BUILT_IN_CALLS = (
    "console log error warn info setTimeout setInterval clearTimeout clearInterval JSON parseInt parseFloat isNaN Array Object String Number Boolean Math Date RegExp "
    "map filter reduce forEach find some every push pop shift unshift splice slice print debugPrint"
).split()


def calls(body: Column | str) -> Column:
    """Distinct names called in the body, without built-in ones, in order of first call."""
    found = F.array_distinct(F.regexp_extract_all(c(body), F.lit(r"([A-Za-z0-9_]+)\s*\("), F.lit(1)))
    return F.array_except(found, F.array(*(F.lit(x) for x in BUILT_IN_CALLS)))


#: Flags of a body.
FLAGS = {
    "has_console": r"console\.(log|error|warn|info|debug)",
    "has_debugger": r"debugger",
    "has_empty_block": r"\{\s*\}",
    "has_nested_functions": r"function\s+[A-Za-z0-9_]+\s*\(|\([A-Za-z0-9_]+\)\s*=>",
    "has_comments": r"//|/\*",
    "has_todo": r"TODO|FIXME|HACK|XXX",
    "has_hardcoded_values": r"[\"'].*[\"'].*[=:]",
}


def file_type(path: Column) -> Column:
    """Kind of a file by its path: the first test that holds."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    folder = F.lower(F.regexp_replace(path, "/[^/]*$", ""))
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    either = lambda *words: reduce(lambda a, b: a | b, (folder.contains(w) | name.contains(w) for w in words))
    return (
        F.when(ext.isin(".vue", ".jsx", ".tsx"), "component")
        .when(folder.contains("page") | folder.contains("screen") | folder.contains("view"), "page")
        .when(either("service", "api"), "service")
        .when(either("util", "helper"), "utility")
        .when(either("constant", "config"), "config")
        .when(name.endswith(".d.ts") | folder.contains("types") | folder.contains("interfaces"), "type")
        .when(ext.isin(".css", ".scss", ".sass", ".less", ".styl"), "style")
        .when(name.contains(".test.") | name.contains(".spec.") | name.contains("__tests__"), "test")
        .when(either("model", "entity"), "model")
        .when(folder.contains("store") | folder.contains("state") | name.contains("store"), "store")
        .when(name.startswith("use") & ext.isin(".js", ".ts"), "hook")
        .otherwise("module")
    )


#: Purposes of classes, and what their names hold.
CLASS_PURPOSES = (
    ("ui-component", ("component", "view", "page", "screen")),
    ("service", ("service", "handler", "manager")),
    ("data-model", ("model", "entity", "dto", "data")),
    ("utility", ("util", "helper", "tool")),
    ("configuration", ("config", "settings", "options")),
    ("constants", ("constant", "enum")),
)


def class_purpose(name: Column) -> Column:
    """Purpose of a class by its name: the first test that holds, else "class"."""
    n = F.lower(name)
    out = F.when(F.lit(False), "")
    for label, parts in CLASS_PURPOSES:
        out = out.when(reduce(lambda a, b: a | b, (n.contains(p) for p in parts)), label)
    return out.otherwise("class")


# --- imports and paths ----------------------------------------------------------------------

#: Modules that come with the runtime.
BUILT_IN_MODULES = (
    "fs path http https url querystring util events stream buffer crypto os net tls cluster child_process worker_threads vm assert "
    "console timers module process readline repl zlib punycode domain dgram dns"
).split()


def is_external(source: Column) -> Column:
    """Whether an import leaves the project: a built-in module, or neither relative nor absolute."""
    return source.isin(BUILT_IN_MODULES) | ~(source.startswith(".") | source.startswith("/"))


def folder_of(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def resolve_path(from_file: Column, source: Column) -> Column:
    """Path that a relative import means: the importer's folder and the import, ``.`` and ``..`` worked off."""
    parts = F.concat(F.split(folder_of(from_file), "/"), F.split(source, "/"))
    return F.array_join(
        F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
        ),
        "/",
    )


# --- text -----------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.split(F.lower(text), r"\s+"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def keywords(text: Column) -> Column:
    """Runs of at least two Chinese characters, then words of at least three letters, distinct."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fa5}]{2,})"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"([A-Za-z]{3,})"), F.lit(1))))


def token_estimate(text: Column) -> Column:
    """Tokens of a text by a rule of thumb: 1.5 for a Chinese character, a quarter for any other."""
    han = count_of(text, r"[\x{4e00}-\x{9fa5}]")
    return F.ceil(han * 1.5 + (F.length(text) - han) / 4.0).cast("long")


def match_score(a: Column, b: Column) -> Column:
    """1 if equal, the ratio of lengths if one holds the other, else the shared part of their letters."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    letters = lambda t: F.array_distinct(F.filter(F.split(t, ""), lambda s: s != ""))
    contained = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    return F.round(F.when(x == y, F.lit(1.0)).when((x.contains(y) | y.contains(x)) & (F.length(x) > 0) & (F.length(y) > 0), contained).otherwise(jaccard(letters(x), letters(y))), 6)


def snippet(text: Column, part: Column, around: int = 20) -> Column:
    """The first place of *part* with *around* characters on either side, cut ends marked; null if absent."""
    at = F.call_function("instr", text, part)
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + F.length(part) + around, F.length(text) + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, F.lit("...")).otherwise(F.lit("")), F.substring(text, start, end - start), F.when(end <= F.length(text), F.lit("...")).otherwise(F.lit(""))))


#: Traditional characters and their simplified forms.
TRADITIONAL, SIMPLIFIED = "優級測試驗證確認開關點擊輸選擇頁裝載資數據庫網絡電話號碼時間結錯誤訊設檢視圖", "优级测试验证确认开关点击输选择页装载资数据库网络电话号码时间结错误讯设检视图"


def simplified(text: Column) -> Column:
    return F.translate(text, TRADITIONAL, SIMPLIFIED)


def parse_variant_name(name: Column) -> Column:
    """``k=v, k=v`` as a map."""
    return F.transform_values(F.transform_keys(F.str_to_map(name, F.lit(","), F.lit("=")), lambda k, v: F.trim(k)), lambda k, v: F.trim(v))


def parse_steps(text: Column) -> Column:
    """Steps of a cell: split at the first separator present among blank line, line end, pipe and semicolon."""
    pieces = F.when(text.contains("\n\n"), F.split(text, "\n\n")).when(text.contains("\n"), F.split(text, "\n")).when(text.contains("|"), F.split(text, r"\|")).when(text.contains(";"), F.split(text, ";")).otherwise(F.array(text))
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def test_counts(output: Column) -> list[Column]:
    """passed, failed and skipped of a runner's output; 0 if not named."""
    return [F.coalesce(F.regexp_extract(output, rf"(\d+) {w}", 1).try_cast("long"), F.lit(0)).alias(w) for w in ("passed", "failed", "skipped")]


# --- numbers, colours -----------------------------------------------------------------------


def rgb(hexa: Column) -> list[Column]:
    """Red, green and blue of ``#rrggbb``; null if it is none."""
    ok = hexa.rlike(r"^#?[0-9A-Fa-f]{6}\z")
    bare = F.regexp_replace(hexa, "^#", "")
    return [F.when(ok, F.conv(F.substring(bare, i, 2), 16, 10).cast("int")) for i in (1, 3, 5)]


def colour_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two colours, 0 if either cannot be read."""
    return F.coalesce(F.sqrt(sum((F.pow((x - y).cast("double"), F.lit(2.0)) for x, y in zip(rgb(a), rgb(b), strict=True)), F.lit(0.0))), F.lit(0.0))


def grayscale(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def pixel_difference(first: list[Column], second: list[Column]) -> Column:
    """Sum of the absolute differences of the four channels."""
    return reduce(lambda a, b: a + b, (F.abs(x - y) for x, y in zip(first, second, strict=True)))


def half_up(x: Column) -> Column:
    """Round to a whole number, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


# --- scores ---------------------------------------------------------------------------------


def corrected_score(score: Column, deduction: Column) -> Column:
    """A score less deductions, which take at most the floor of 70 % of it."""
    return F.greatest(F.lit(0), half_up(score - F.least(deduction, F.floor(score * 0.7))))


def band(score: Column) -> Column:
    """Band of a score, taken before any floor at 0."""
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def trend(old: Column, new: Column) -> Column:
    return F.when(new == 0, "excellent").when(new < old * 0.5, "improving").when(new < old, "progressing").when(new == old, "stable").otherwise("regressing")


def package_risk(name: Column, category: Column) -> Column:
    """Risk of a dependency: deprecated parts of names, then core frameworks, then by category."""
    deprecated = reduce(lambda a, b: a | b, (name.contains(x) for x in ("request", "material-ui", "redux-thunk", "mobx-react")))
    core = reduce(lambda a, b: a | b, ((name == x) | name.startswith("@" + x) for x in ("react", "react-dom", "vue", "angular", "flutter")))
    low = category.isin("framework", "ui-library", "state-management", "routing", "testing", "utils", "build-tools", "animation")
    return F.when(deprecated, "high").when(core, "low").when(low, "low").otherwise("medium")


def fingerprint(rule: Column, path: Column, message: Column) -> Column:
    """Identity of an issue across scans."""
    return F.md5(F.concat_ws(":", F.coalesce(rule, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(message, F.lit(""))))
