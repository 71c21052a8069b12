"""Line scans: texts to lines, rules to issues, and the line heuristics.

Rules are data: a handful of rows with patterns. They are read once and turned into one pass
over each line, ``filter(array(when(...)))``, instead of a join of lines and rules, which would
evaluate a pattern column for every pair. More than ``MOST_RULES`` rules are taken in blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expressions import count_of, js_pattern, word

MOST_RULES = 200
#: Languages of extensions, and folders that are never scanned.
LANGUAGE_OF = {"js": "javascript", "jsx": "jsx", "ts": "typescript", "tsx": "tsx", "vue": "vue", "dart": "dart"}
EXCLUDED_FOLDERS = ("node_modules", ".git", "dist", "build", "coverage", ".dart_tool", ".idea", ".vscode", "Pods")


#: Files delivered more than once, up to which their list is broadcast: three numbers each.
MOST_REPEATED = 1_000_000
STORED = ("file_id", "repo", "file_path", "lang", "content")


def stored_files(files: DataFrame) -> DataFrame:
    """Files once each: deliveries repeat a file with the same content.

    No text is shuffled: the deliveries are counted on ``file_id`` and the place of the row in the
    stored table alone, and surplus ones are left out by a broadcast of the repeated identifiers,
    whose number is counted first. Beyond ``MOST_REPEATED`` of them, and for tables that are not
    stored, rows are brought together by identifier.
    """
    try:
        placed = files.select(*STORED, F.struct(F.xxhash64("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("row")).alias("_at"))
    except AnalysisException:
        return files.select(*STORED).dropDuplicates(["file_id"])
    repeated = placed.groupBy("file_id").agg(F.min("_at").alias("_first"), F.count("*").alias("n")).where("n > 1").select(F.col("file_id").alias("_id"), "_first")
    if repeated.limit(MOST_REPEATED + 1).count() > MOST_REPEATED:
        return placed.select(*STORED).dropDuplicates(["file_id"])
    once = placed.join(F.broadcast(repeated), F.col("file_id").eqNullSafe(F.col("_id")), "left")
    return once.where("_first is null or _at = _first").select(*STORED)


def scannable(files: DataFrame) -> DataFrame:
    """Files of a scanned language outside excluded folders, with language by extension."""
    ext = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)\z", 1))
    language = reduce(lambda acc, kv: acc.when(ext == kv[0], kv[1]), LANGUAGE_OF.items(), F.when(F.lit(False), ""))
    inside = F.exists(F.split("file_path", "/"), lambda p: p.isin(*EXCLUDED_FOLDERS))
    return files.withColumn("language", language).where(F.col("language").isNotNull() & ~inside)


def lines(files: DataFrame, key: str = "file_id", text: str = "content", *keep: str) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.where(F.col(text).isNotNull()).select(key, *keep, F.posexplode(F.split(text, "\n", -1)).alias("i", "line")).select(key, *keep, (F.col("i") + 1).alias("line_no"), "line")


def _rules(rules: DataFrame) -> list:
    return rules.where("coalesce(enabled, true)").orderBy("ord", "rule_id").collect()  # a table of fixed size


def matches(found: DataFrame, rules: DataFrame, keep: tuple[str, ...], language: str = "lang") -> DataFrame:
    """One issue per line and rule that matches it, however often; column of the first occurrence of the matched text."""
    out = None
    rows = [r for r in _rules(rules) if r.match_pattern]
    for at in range(0, max(1, len(rows)), MOST_RULES):
        tests = []
        for r in rows[at : at + MOST_RULES]:
            pattern = js_pattern(r.match_pattern)
            applies = F.lit(True) if "all" in (r.languages or []) else F.col(language).isin(list(r.languages or []))
            text = F.regexp_substr("line", F.lit(pattern))
            tests.append(F.when(applies & F.col("line").rlike(pattern), F.struct(F.lit(r.rule_id).alias("rule_id"), F.coalesce(F.lit(r.severity), F.lit("warning")).alias("severity"), F.call_function("instr", F.col("line"), text).alias("col_no"))))
        if not tests:
            tests = [F.lit(None).cast("struct<rule_id:string,severity:string,col_no:int>")]
        part = found.select(*keep, "line_no", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("m")).select(*keep, "line_no", "m.rule_id", "m.severity", F.col("m.col_no").alias("col_no"))
        out = part if out is None else out.unionByName(part)
    return out


def file_level(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues of whole files: too many lines (once, at 1:1), and lines that are too long (each, at the limit + 1).

    One pass over the files for each of the two kinds, whatever the number of rules.
    """
    known = _rules(rules)

    def applies(r) -> Column:
        return F.lit(True) if "all" in (r.languages or []) else F.coalesce(F.col("lang").isin(list(r.languages or [])), F.lit(False))

    def found(rows: DataFrame, tests: list[Column]) -> DataFrame:
        hits = F.filter(F.array(*tests, F.lit(None).cast("struct<rule_id:string,col_no:int,code:string>")), lambda x: x.isNotNull())
        return rows.select("file_id", "line_no", F.explode(hits).alias("h")).select("file_id", "line_no", "h.rule_id", "h.col_no", "h.code")

    def hit(r, at: int, code: Column) -> Column:
        return F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(at).alias("col_no"), code.alias("code"))

    size = F.size(F.split("content", "\n", -1))
    whole = found(files.withColumn("line_no", F.lit(1)), [F.when(applies(r) & (size > r.max_lines), hit(r, 1, F.lit(""))) for r in known if r.max_lines])
    long = found(lines(files, "file_id", "content", "lang"), [F.when(applies(r) & (F.length("line") > r.max_length), hit(r, r.max_length + 1, F.substring("line", 1, 50))) for r in known if r.max_length])
    return whole.unionByName(long)


def summary(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Files, files with issues, issues, and issues by severity; unknown severities count as other."""
    known = ("error", "warning", "info")
    counted = issues.agg(
        F.count_distinct("file_id").alias("files_with_issues"), F.count("*").alias("issues"),
        *(F.sum((F.col("severity") == s).cast("long")).alias(s) for s in known),
        F.sum((~F.coalesce(F.col("severity"), F.lit("")).isin(*known)).cast("long")).alias("other"),
    )
    both = counted.unionByName(files.agg(F.count("*").alias("files")), allowMissingColumns=True)
    return both.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("files", "files_with_issues", "issues", *known, "other")))


def todo(rule: Column, severity: Column, message: Column) -> Column:
    return F.format_string("// TODO [%s] [%s]: %s", F.upper(severity), rule, message)


def insert_lines(text: DataFrame, inserts: DataFrame) -> DataFrame:
    """Texts with lines put in before given 1-based lines; places outside the text are rejected.

    ``text``: file_id, line_no, line. ``inserts``: file_id, line_no, line.
    """
    last = text.groupBy("file_id").agg(F.max("line_no").alias("last"))
    fits = inserts.join(last, "file_id").where("line_no between 1 and last").select("file_id", (F.col("line_no") - 0.5).alias("at"), "line")
    both = text.select("file_id", F.col("line_no").cast("double").alias("at"), "line").unionByName(fits)
    return both.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("content"))


# --- detectors over lines --------------------------------------------------------------------

_CODE = "(?i)"
#: Detectors that look at one line: language or None, condition, message code.
#: Objects that are always there.
BUILT_IN_OBJECTS = (
    "console window document navigator history location setTimeout setInterval clearTimeout clearInterval Promise Array Object String Number Boolean Date Math JSON RegExp Error Map Set WeakMap WeakSet "
    "parseInt parseFloat isNaN isFinite decodeURI decodeURIComponent encodeURI encodeURIComponent escape unescape React Component useState useEffect useContext useRef useMemo useCallback useReducer "
    "useLayoutEffect useImperativeHandle BuildContext Widget StatefulWidget StatelessWidget setState initState dispose build InheritedWidget axios fetch lodash _ $ jQuery moment dayjs"
).split()
#: Conditions of lines that may crash or leak, for script languages and for Dart.
CRASH = {
    "AI-CRASH-001": ("script", lambda x: ~x.contains("?.") & x.rlike(r"[A-Za-z0-9_]+\.[A-Za-z0-9_]+[.(]") & ~x.contains("!= null") & ~x.contains("!== null") & ~x.contains("if") & ~F.regexp_extract(x, r"([A-Za-z0-9_]+)\.[A-Za-z0-9_]+", 1).isin(BUILT_IN_OBJECTS)),
    "AI-CRASH-002": ("script", lambda x: x.rlike(r"[A-Za-z0-9_]+\[[A-Za-z0-9_]+\]") & ~x.contains(".length") & ~x.contains(".map") & ~x.contains(".filter")),
    "AI-CRASH-003": ("script", lambda x: x.contains("JSON.parse") & ~x.contains("try")),
    "AI-CRASH-004": ("script", lambda x: x.rlike(r"/\s*[A-Za-z0-9_]+") & ~x.contains("!== 0") & ~x.contains("!= 0")),
    "AI-CRASH-005": ("dart", lambda x: x.contains("!") & x.contains(".") & ~x.contains("?")),
}
LEAK = {
    "AI-MEM-001": ("script", lambda x: x.contains("useEffect") & x.contains("setInterval") | x.contains("addEventListener")),
    "AI-MEM-002": ("script", lambda x: x.contains("useEffect") & ~x.contains("],")),
    "AI-MEM-003": ("script", lambda x: x.contains("useState") & x.contains("[]")),
    "AI-MEM-004": ("dart", lambda x: x.contains("StatefulWidget") & ~x.contains("dispose")),
}
SCRIPTS = ("javascript", "typescript", "jsx", "tsx", "vue")


def flagged(found: DataFrame, detectors: dict, *keep: str) -> DataFrame:
    """One row per line and detector that fires; blank lines and comments have none. Needs ``lang``."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    kinds = {"script": F.col("lang").isin(*SCRIPTS), "dart": F.col("lang") == "dart"}
    tests = F.array(*(F.when(kinds[kind] & test(F.col("text")), F.lit(code)) for code, (kind, test) in detectors.items()))
    code = found.withColumn("text", text).where((F.length("text") > 0) & ~F.col("text").startswith("//") & ~((F.col("lang") != "dart") & F.col("text").startswith("/*")))
    return code.select(*keep, "line_no", F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("code"))


def dead_code(line: Column) -> Column:
    """A return followed by more than ten characters after its semicolon."""
    return line.rlike(word("return") + r"[^;]*;.{11,}")


def infinite_loop(line: Column) -> Column:
    return line.rlike(r"while\s*\(\s*true\s*\)") | line.rlike(r"for\s*\([^;]*;[^;]*;\s*\)")


def empty_catch(line: Column) -> Column:
    return line.rlike(r"catch\s*(\([^)]*\))?\s*\{\s*\}")


def class_naming(line: Column) -> Column:
    """A class whose name begins in lower case."""
    return line.rlike(r"^\s*(export |abstract )*class\s+[a-z]")


def method_naming(line: Column) -> Column:
    """A Dart method whose name begins in upper case."""
    return line.rlike(r"^\s*(void|int|double|String|bool|Future<[A-Za-z<>]+>)\s+[A-Z][A-Za-z0-9_]*\(")


def required_nullable(line: Column) -> Column:
    return line.rlike(r"required\s+[A-Za-z0-9_<>]+\?\s+[a-z]")


def hardcoded(line: Column) -> Column:
    """"colour" for a literal colour, "http" for a plain http address, else null."""
    return F.when(line.rlike(r"Color\(0x[0-9A-Fa-f]{8}\)|#[0-9A-Fa-f]{6}"), "colour").when(line.rlike(r"['\"]http://") & ~line.contains("localhost"), "http")


def optional_chains(line: Column) -> Column:
    """Dotted chains of a line without ``?.``."""
    return F.filter(F.regexp_extract_all(line, F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:\??\.[A-Za-z_][A-Za-z0-9_]*){2,})"), F.lit(1)), lambda x: ~x.contains("?."))


def find_result(line: Column) -> Column:
    """A find() whose result is used without a guard."""
    guarded = line.contains("?.") | line.contains("??") | line.rlike(r"if\s*\(") | line.contains("||") | line.rlike(r"\?[^:]*:") | line.rlike(r"^\s*(const|let|var)\s+[A-Za-z0-9_]+\s*=")
    return line.contains(".find(") & ~guarded


def force_unwrap(line: Column) -> Column:
    return line.rlike(r"[A-Za-z0-9_]!\s*[^=;,)\s]") & ~line.contains("?.") & ~line.contains("??") & ~line.contains("!=")


def unguarded_ends(found: DataFrame) -> DataFrame:
    """``.first``/``.last`` without a guard on the line or an if within the five lines before."""
    use = F.col("line").rlike(r"\.(first|last)(?![A-Za-z0-9_])") & ~F.col("line").rlike(r"isNotEmpty|isEmpty|\.length|OrNull|\?\.")
    guard = F.col("line").rlike(r"if\s*\(.*(isNotEmpty|isEmpty|length|!= null)").cast("int")
    before = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(-5, -1)
    return found.withColumn("guard", F.coalesce(F.max(guard).over(before), F.lit(0))).where(use & (F.col("guard") == 0)).select("file_id", "line_no")


def nesting(found: DataFrame, key: str = "file_id") -> DataFrame:
    """Deepest nesting of braces, at least 0."""
    step = count_of("line", r"\{") - count_of("line", r"\}")
    run = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("depth", F.sum(step).over(run)).groupBy(key).agg(F.greatest(F.max("depth"), F.lit(0)).alias("nesting"))


def duplicates(found: DataFrame, key: str, *by: str) -> DataFrame:
    """Every repeat after the first, with the line of the first."""
    w = Window.partitionBy(*by, key).orderBy("line_no")
    return found.withColumn("nth", F.row_number().over(w)).withColumn("first_line", F.first("line_no").over(w)).where("nth > 1").drop("nth")


#: Named detectors, so that rules can name them.
TEMPLATES = {"empty_catch": empty_catch, "class_naming": class_naming, "method_naming": method_naming, "required_nullable": required_nullable, "dead_code": dead_code, "infinite_loop": infinite_loop, "find_result": find_result, "force_unwrap": force_unwrap}


def detect(template: str, found: DataFrame, *keep: str) -> DataFrame:
    """Lines on which the detector of that name fires."""
    return found.where(TEMPLATES[template](F.col("line"))).select(*keep, "line_no")
