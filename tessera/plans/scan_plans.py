"""Queries that scan source files line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import extract, scan
from tessera.sources.tables import table

FILES = "(SELECT DISTINCT file_id, repo, file_path, lang, content FROM files)"
LINES = f"""(SELECT f.file_id, f.repo, f.file_path, f.lang, i AS line_no, f.l[i] AS line
    FROM (SELECT *, string_split(content, chr(10)) AS l FROM {FILES} WHERE content IS NOT NULL) f, LATERAL (SELECT unnest(generate_series(1, len(f.l))) AS i))"""


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return scan.stored_files(table(spark, folder, "files"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return scan.lines(_files(spark, folder), "file_id", "content", "repo", "file_path", "lang")


def _issues(spark: SparkSession, folder: str) -> DataFrame:
    return scan.matches(_lines(spark, folder), table(spark, folder, "rules"), ("file_id", "file_path"))


_ISSUES = f"""(SELECT l.file_id, l.file_path, l.line_no, r.rule_id, coalesce(r.severity, 'warning') AS severity,
        strpos(l.line, regexp_extract(l.line, replace(r.match_pattern, '(?!readonly)', ''))) AS col_no
    FROM {LINES} l JOIN rules r ON coalesce(r.enabled, true) AND r.match_pattern IS NOT NULL AND (list_contains(r.languages, l.lang) OR list_contains(r.languages, 'all'))
        AND regexp_matches(CASE WHEN contains(r.match_pattern, '(?!readonly)') THEN regexp_replace(l.line, 'private\\sreadonly', '', 'g') ELSE l.line END, replace(r.match_pattern, '(?!readonly)', '')))"""


def rule_scan(spark, folder):
    """Issues of every line and rule."""
    return _issues(spark, folder).select("file_id", "line_no", "rule_id", "severity", "col_no")


def rule_scan_summary(spark, folder):
    """Issues, files and summed columns by rule and severity."""
    return _issues(spark, folder).groupBy("rule_id", "severity").agg(F.count("*").alias("issues"), F.count_distinct("file_id").alias("files"), F.sum("col_no").cast("long").alias("sum_col"))


def scan_summary(spark, folder):
    """One row: files, files with issues, issues by severity."""
    return scan.summary(_issues(spark, folder), _files(spark, folder))


def file_level_rules(spark, folder):
    """Too many lines, too long lines."""
    return scan.file_level(_files(spark, folder).where("content is not null"), table(spark, folder, "rules"))


def rule_languages(spark, folder):
    """Enabled rules by language."""
    return table(spark, folder, "rules").where("coalesce(enabled, true)").select("rule_id", F.explode("languages").alias("language")).groupBy("language").agg(F.count("*").alias("rules"), F.min("rule_id").alias("first_rule"))


def directory_scan(spark, folder):
    """Scanned files by language, outside excluded folders."""
    return scan.scannable(_files(spark, folder)).groupBy("language").agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("characters"))


def file_listing(spark, folder):
    """Paths of scannable files; the content column is not read."""
    return scan.scannable(table(spark, folder, "files").select("file_id", "file_path")).select("file_id", "file_path", "language").distinct()


def file_guards(spark, folder):
    """Each file with its lines and the reason not to scan it, if any."""
    f = table(spark, folder, "files").select("file_id", "content", F.length("content").alias("n")).dropDuplicates(["file_id"])
    lines = F.size(F.split("content", "\n", -1))
    error = F.when(F.col("content").isNull(), "unreadable").when(F.col("n") > 10 * 1024 * 1024, "too large").when(lines > 50_000, "too many lines").otherwise("")
    return f.select("file_id", F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"), error.alias("error"))


def component_folder_skip(spark, folder):
    """Files whose rules are skipped because they lie in a components folder, and those that are scanned."""
    return _files(spark, folder).groupBy(F.when(F.col("file_path").contains("/components/"), "extract only").otherwise("scan").alias("mode")).agg(F.count("*").alias("files"))


def todo_lines(spark, folder):
    """The text that marks each issue for later."""
    i = table(spark, folder, "issues").select("issue_id", "rule_id", "severity", "message").distinct()
    return i.select("issue_id", scan.todo(F.col("rule_id"), F.coalesce("severity", F.lit("info")), F.col("message")).alias("todo"))


def insert_todo(spark, folder):
    """File texts with the marks of error issues put before their lines."""
    text = _lines(spark, folder).select("file_id", "line_no", "line")
    marks = _issues(spark, folder).where("severity = 'error'").select("file_id", "line_no", F.concat(F.lit("// TODO "), F.min("rule_id").over(_by_line())).alias("line")).distinct()
    out = scan.insert_lines(text, marks)
    return out.select("file_id", F.md5("content").alias("digest"), F.length("content").alias("n"))


def _by_line():
    from pyspark.sql.window import Window

    return Window.partitionBy("file_id", "line_no")


def duplicate_imports(spark, folder):
    """Imports repeated within a file, with the line of the first."""
    return scan.duplicates(extract.import_lines(_files(spark, folder)), "source", "file_id").select("file_id", "line_no", "source", "first_line")


def duplicate_lines(spark, folder):
    """Lines of a document that repeat an earlier one."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    return scan.duplicates(scan.lines(docs).where(F.length("line") > 0), "line", "file_id").select("file_id", "line_no", "first_line")


def unused_imports(spark, folder):
    """Imported names that stand nowhere else in their file; import lines are left out of the use."""
    f = _lines(spark, folder).where("lang in ('javascript', 'typescript', 'jsx', 'tsx')")
    pattern = r"^import\s+\{\s*([A-Za-z0-9_]+)\s*\}\s+from"
    names = f.where(F.col("line").rlike(pattern)).select("file_id", "line_no", F.regexp_extract("line", pattern, 1).alias("name"))
    used = f.where(~F.col("line").rlike(r"^\s*import\s")).select("file_id", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9_]+)"), F.lit(1))).alias("name")).distinct()
    return names.join(used, ["file_id", "name"], "left_anti").select("file_id", "line_no", "name")


def nesting_depth(spark, folder):
    """Deepest nesting of braces by file."""
    return scan.nesting(_lines(spark, folder))


def _flags(name, detectors):
    def query(spark, folder):
        return scan.flagged(_lines(spark, folder), detectors, "file_id")

    query.__doc__ = f"Lines that may cause {name}."
    return query


def _lines_where(test, doc):
    def query(spark, folder):
        return _lines(spark, folder).where(test(F.col("line"))).select("file_id", "line_no")

    query.__doc__ = doc
    return query


def hardcoded_values(spark, folder):
    """Lines with a literal colour or a plain http address."""
    return _lines(spark, folder).select("file_id", "line_no", scan.hardcoded(F.col("line")).alias("kind")).where("kind is not null")


def optional_chains(spark, folder):
    """Dotted chains without optional access, in JavaScript and TypeScript."""
    return _lines(spark, folder).where("lang in ('javascript', 'typescript')").select("file_id", "line_no", F.explode(scan.optional_chains(F.col("line"))).alias("chain"))


def unguarded_ends(spark, folder):
    """.first/.last without a guard nearby, in Dart."""
    return scan.unguarded_ends(_lines(spark, folder).where("lang = 'dart'"))


def undefined_calls(spark, folder):
    """Names called in a file that it neither declares nor imports, and that are no keywords or built in."""
    f = _files(spark, folder).where("lang in ('javascript', 'typescript')")
    called = f.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:^|[^.A-Za-z0-9_])([a-z][A-Za-z0-9_]*)\("), F.lit(1)))).alias("name"))
    known = f.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:function\s+|const\s+|let\s+|class\s+|\{\s*)([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("name"))
    return called.where(~F.col("name").isin(*_KEYWORDS)).join(known, ["file_id", "name"], "left_anti")


_KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "constructor", "require", "super", "async", "await")


def complexity(spark, folder):
    """Decisions, lines, nesting, level and score of every function."""
    b = extract.function_bodies(_files(spark, folder)).where("lang in ('javascript', 'typescript', 'jsx', 'tsx', 'dart')")
    n = b.select("file_id", "name", "start", X.cyclomatic("body", "lang").alias("cyclomatic"), (F.col("end") - F.col("start") + 1).cast("long").alias("loc"), F.col("nesting").cast("long").alias("nesting"))
    return n.select("*", X.complexity_level(F.col("cyclomatic"), F.col("loc"), F.col("nesting")).alias("level"), X.quality_score(F.col("cyclomatic"), F.col("loc"), F.col("nesting")).alias("score"))


def function_report(spark, folder):
    """Functions by level of complexity, with mean score."""
    return complexity(spark, folder).groupBy("level").agg(F.count("*").alias("functions"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("cyclomatic").alias("max_cyclomatic"))


def function_purposes(spark, folder):
    """Functions by purpose, confidence and access level."""
    b = extract.function_bodies(_files(spark, folder))
    p = b.select(X.purposes(F.col("name"), F.col("body")).alias("p"), "name", "body")
    return p.select(F.get("p", 0).alias("purpose"), X.purpose_confidence(F.col("p"), F.col("name"), F.col("body")).alias("confidence"), X.access_level(F.col("name")).alias("access")).groupBy("purpose", "confidence", "access").agg(F.count("*").alias("functions"))


def function_flags(spark, folder):
    """Functions on which each flag is set."""
    b = extract.function_bodies(_files(spark, folder))
    return b.agg(F.count("*").alias("functions"), *(F.sum(F.col("body").rlike(p).cast("long")).alias(n) for n, p in X.FLAGS.items()))


def function_calls(spark, folder):
    """Distinct calls by caller."""
    b = extract.function_bodies(_files(spark, folder))
    return b.select("file_id", F.col("name").alias("caller"), "start", F.explode(X.calls("body")).alias("callee")).where("caller <> callee").distinct()


def js_imports(spark, folder):
    """Imports by language and source, external ones marked."""
    i = extract.imports(_files(spark, folder))
    return i.groupBy("lang", "source").agg(F.count("*").alias("imports"), F.max(X.is_external(F.col("source")).cast("int")).alias("external"))


def class_list(spark, folder):
    """Classes by language, purpose and superclass."""
    k = extract.classes(_files(spark, folder))
    return k.groupBy("lang", X.class_purpose(F.col("name")).alias("purpose"), F.coalesce("super_class", F.lit("")).alias("super_class")).agg(F.count("*").alias("classes"))


def file_types(spark, folder):
    """Files by kind."""
    return _files(spark, folder).groupBy(X.file_type(F.col("file_path")).alias("kind")).agg(F.count("*").alias("files"))


def file_tree(spark, folder):
    """Folders and files as a flat tree."""
    return extract.file_tree(_files(spark, folder).select("file_path"))


def tree_metrics(spark, folder):
    """Files and folders by depth."""
    return file_tree(spark, folder).groupBy("depth", "kind").agg(F.count("*").alias("n"))


def resolved_paths(spark, folder):
    """Where relative imports point to."""
    i = extract.imports(_files(spark, folder)).where("source like '.%' and lang <> 'python'")
    return i.select("file_id", "source", X.resolve_path(F.col("file_path"), F.col("source")).alias("target")).distinct()


def import_targets(spark, folder):
    """Imports with the file they mean, if it exists."""
    f = _files(spark, folder)
    r = extract.resolved_imports(extract.imports(f).distinct(), f.select("file_id", "file_path"))
    return r.groupBy("external", F.col("target_id").isNotNull().alias("resolved")).agg(F.count("*").alias("imports"))


QUERIES = {
    f.__name__: f
    for f in (rule_scan, rule_scan_summary, scan_summary, file_level_rules, rule_languages, directory_scan, file_listing, file_guards, component_folder_skip, todo_lines, insert_todo, duplicate_imports, duplicate_lines, unused_imports, nesting_depth, hardcoded_values, optional_chains, unguarded_ends, undefined_calls, complexity, function_report, function_purposes, function_flags, function_calls, js_imports, class_list, file_types, file_tree, tree_metrics, resolved_paths, import_targets)
} | {
    "crash_lines": _flags("a crash", scan.CRASH),
    "leak_lines": _flags("a leak", scan.LEAK),
    "dead_code": _lines_where(scan.dead_code, "Returns with code behind them."),
    "infinite_loops": _lines_where(scan.infinite_loop, "Loops without an end."),
    "empty_catches": _lines_where(scan.empty_catch, "Catch blocks without content."),
    "class_naming": _lines_where(scan.class_naming, "Classes named in lower case."),
    "method_naming": _lines_where(scan.method_naming, "Methods named in upper case."),
    "required_nullable": _lines_where(scan.required_nullable, "Required parameters that may be null."),
    "find_results": _lines_where(scan.find_result, "Results of find() used without a guard."),
    "force_unwraps": _lines_where(scan.force_unwrap, "Forced unwrapping."),
}


def _sql_where(condition: str, columns: str = "file_id, line_no") -> str:
    return f"SELECT {columns} FROM {LINES} WHERE {condition}"


_EXT = "lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))"
_LANG = f"CASE {_EXT} WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'jsx' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'vue' THEN 'vue' WHEN 'dart' THEN 'dart' END"
_INSIDE = "NOT list_has_any(string_split(file_path, '/'), ['node_modules','.git','dist','build','coverage','.dart_tool','.idea','.vscode','Pods'])"
SQL = {
    "rule_scan": f"SELECT file_id, line_no, rule_id, severity, col_no FROM {_ISSUES}",
    "rule_scan_summary": f"SELECT rule_id, severity, count(*) AS issues, count(DISTINCT file_id) AS files, sum(col_no)::BIGINT AS sum_col FROM {_ISSUES} GROUP BY ALL",
    "scan_summary": f"""SELECT (SELECT count(*) FROM {FILES}) AS files, count(DISTINCT file_id) AS files_with_issues, count(*) AS issues, count(*) FILTER (severity = 'error') AS error,
        count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity NOT IN ('error','warning','info')) AS other FROM {_ISSUES}""",
    "file_level_rules": f"""SELECT f.file_id, 1 AS line_no, r.rule_id, 1 AS col_no, '' AS code FROM {FILES} f JOIN rules r ON coalesce(r.enabled, true) AND r.max_lines IS NOT NULL AND list_contains(r.languages, f.lang)
        WHERE len(string_split(f.content, chr(10))) > r.max_lines
        UNION ALL SELECT l.file_id, l.line_no, r.rule_id, r.max_length + 1, substring(l.line, 1, 50) FROM {LINES} l JOIN rules r ON coalesce(r.enabled, true) AND r.max_length IS NOT NULL AND list_contains(r.languages, l.lang) WHERE length(l.line) > r.max_length""",
    "rule_languages": "SELECT language, count(*) AS rules, min(rule_id) AS first_rule FROM (SELECT rule_id, unnest(languages) AS language FROM rules WHERE coalesce(enabled, true)) GROUP BY language",
    "directory_scan": f"SELECT {_LANG} AS language, count(*) AS files, sum(length(content))::BIGINT AS characters FROM {FILES} WHERE {_LANG} IS NOT NULL AND {_INSIDE} GROUP BY 1",
    "file_listing": f"SELECT DISTINCT file_id, file_path, {_LANG} AS language FROM files WHERE {_LANG} IS NOT NULL AND {_INSIDE}",
    "file_guards": f"""SELECT file_id, coalesce(len(string_split(content, chr(10))), 0)::BIGINT AS n_lines, CASE WHEN content IS NULL THEN 'unreadable' WHEN length(content) > 10485760 THEN 'too large' WHEN len(string_split(content, chr(10))) > 50000 THEN 'too many lines' ELSE '' END AS error FROM {FILES}""",
    "component_folder_skip": f"SELECT CASE WHEN contains(file_path, '/components/') THEN 'extract only' ELSE 'scan' END AS mode, count(*) AS files FROM {FILES} GROUP BY 1",
    "todo_lines": "SELECT issue_id, '// TODO [' || upper(coalesce(severity, 'info')) || '] [' || rule_id || ']: ' || message AS todo FROM (SELECT DISTINCT issue_id, rule_id, severity, message FROM issues)",
    "insert_todo": f"""WITH marks AS (SELECT file_id, line_no - 0.5 AS pos, '// TODO ' || min(rule_id) AS line FROM {_ISSUES} WHERE severity = 'error' GROUP BY file_id, line_no),
        both_ AS (SELECT file_id, line_no::DOUBLE AS pos, line FROM {LINES} UNION ALL SELECT * FROM marks), texts AS (SELECT file_id, string_agg(line, chr(10) ORDER BY pos, line) AS content FROM both_ GROUP BY file_id)
        SELECT file_id, md5(content) AS digest, length(content) AS n FROM texts""",
    "duplicate_imports": f"""WITH i AS (SELECT file_id, line_no, regexp_extract(line, '^\\s*import\\s[^''"]*[''"]([^''"]+)[''"]', 1) AS source FROM {LINES} WHERE regexp_matches(line, '^\\s*import\\s[^''"]*[''"]([^''"]+)[''"]')),
        n AS (SELECT *, row_number() OVER w AS nth, first_value(line_no) OVER w AS first_line FROM i WINDOW w AS (PARTITION BY file_id, source ORDER BY line_no)) SELECT file_id, line_no, source, first_line FROM n WHERE nth > 1""",
    "duplicate_lines": """WITH l AS (SELECT doc_id AS file_id, i AS line_no, x[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) d, LATERAL (SELECT unnest(generate_series(1, len(d.x))) AS i)),
        n AS (SELECT *, row_number() OVER w AS nth, first_value(line_no) OVER w AS first_line FROM l WHERE length(line) > 0 WINDOW w AS (PARTITION BY file_id, line ORDER BY line_no)) SELECT file_id, line_no, first_line FROM n WHERE nth > 1""",
    "unused_imports": f"""WITH l AS (SELECT * FROM {LINES} WHERE lang IN ('javascript', 'typescript', 'jsx', 'tsx')), n AS (SELECT file_id, line_no, regexp_extract(line, '^import\\s+\\{{\\s*([A-Za-z0-9_]+)\\s*\\}}\\s+from', 1) AS name FROM l WHERE regexp_matches(line, '^import\\s+\\{{\\s*([A-Za-z0-9_]+)\\s*\\}}\\s+from')),
        u AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(line, '[A-Za-z0-9_]+')) AS name FROM l WHERE NOT regexp_matches(line, '^\\s*import\\s')) SELECT file_id, line_no, name FROM n ANTI JOIN u USING (file_id, name)""",
    "nesting_depth": f"""WITH d AS (SELECT file_id, sum(len(line) - len(replace(line, '{{', '')) - len(line) + len(replace(line, '}}', ''))) OVER (PARTITION BY file_id ORDER BY line_no) AS depth FROM {LINES}) SELECT file_id, greatest(max(depth), 0)::BIGINT AS nesting FROM d GROUP BY file_id""",
    "hardcoded_values": f"""SELECT * FROM (SELECT file_id, line_no, CASE WHEN regexp_matches(line, 'Color\\(0x[0-9A-Fa-f]{{8}}\\)|#[0-9A-Fa-f]{{6}}') THEN 'colour' WHEN regexp_matches(line, '[''"]http://') AND NOT contains(line, 'localhost') THEN 'http' END AS kind FROM {LINES}) WHERE kind IS NOT NULL""",
    "optional_chains": f"""SELECT * FROM (SELECT file_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*(?:\\??\\.[A-Za-z_][A-Za-z0-9_]*){{2,}}')) AS chain FROM {LINES} WHERE lang IN ('javascript', 'typescript')) WHERE NOT contains(chain, '?.')""",
    "unguarded_ends": f"""WITH l AS (SELECT *, regexp_matches(line, 'if\\s*\\(.*(isNotEmpty|isEmpty|length|!= null)')::INT AS g FROM {LINES} WHERE lang = 'dart'), w AS (SELECT *, coalesce(max(g) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS guard FROM l)
        SELECT file_id, line_no FROM w WHERE regexp_matches(line, '\\.(first|last)([^A-Za-z0-9_]|$)') AND NOT regexp_matches(line, 'isNotEmpty|isEmpty|\\.length|OrNull|\\?\\.') AND guard = 0""",
    "complexity": None,
    "file_types": None,
    "file_tree": f"""WITH p AS (SELECT DISTINCT file_path, string_split(file_path, '/') AS x FROM files), n AS (SELECT *, unnest(generate_series(1, len(x))) AS depth FROM p)
        SELECT DISTINCT array_to_string(x[1:depth], '/') AS path, array_to_string(x[1:depth - 1], '/') AS parent, depth::INT AS depth, CASE WHEN depth = len(x) THEN 'file' ELSE 'folder' END AS kind FROM n""",
    "dead_code": _sql_where("regexp_matches(line, '\\breturn\\b[^;]*;.{11,}')"),
    "infinite_loops": _sql_where("regexp_matches(line, 'while\\s*\\(\\s*true\\s*\\)') OR regexp_matches(line, 'for\\s*\\([^;]*;[^;]*;\\s*\\)')"),
    "empty_catches": _sql_where("regexp_matches(line, 'catch\\s*(\\([^)]*\\))?\\s*\\{\\s*\\}')"),
    "class_naming": _sql_where("regexp_matches(line, '^\\s*(export |abstract )*class\\s+[a-z]')"),
    "method_naming": _sql_where("regexp_matches(line, '^\\s*(void|int|double|String|bool|Future<[A-Za-z<>]+>)\\s+[A-Z][A-Za-z0-9_]*\\(')"),
    "required_nullable": _sql_where("regexp_matches(line, 'required\\s+[A-Za-z0-9_<>]+\\?\\s+[a-z]')"),
    "find_results": _sql_where("contains(line, '.find(') AND NOT (contains(line, '?.') OR contains(line, '??') OR regexp_matches(line, 'if\\s*\\(') OR contains(line, '||') OR regexp_matches(line, '\\?[^:]*:') OR regexp_matches(line, '^\\s*(const|let|var)\\s+[A-Za-z0-9_]+\\s*='))"),
    "force_unwraps": _sql_where("regexp_matches(line, '[A-Za-z0-9_]!\\s*[^=;,)\\s]') AND NOT contains(line, '?.') AND NOT contains(line, '??') AND NOT contains(line, '!=')"),
}
_TRIMMED = f"""(SELECT file_id, lang, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS x FROM {LINES})"""


def _flag_sql(rows) -> str:
    return " UNION ALL ".join(
        f"SELECT file_id, line_no, '{code}' AS code FROM {_TRIMMED} WHERE x <> '' AND NOT starts_with(x, '//') AND " + ("lang = 'dart'" if kind == "dart" else "lang IN ('javascript', 'typescript', 'jsx', 'tsx', 'vue') AND NOT starts_with(x, '/*')") + f" AND ({test})"
        for code, kind, test in rows
    )


SQL["crash_lines"] = _flag_sql(
    (
        ("AI-CRASH-001", "script", f"x NOT LIKE '%?.%' AND regexp_matches(x, '\\w+\\.\\w+[.(]') AND x NOT LIKE '%!= null%' AND x NOT LIKE '%!== null%' AND x NOT LIKE '%if%' AND regexp_extract(x, '(\\w+)\\.\\w+', 1) NOT IN ({', '.join(repr(o) for o in scan.BUILT_IN_OBJECTS)})"),
        ("AI-CRASH-002", "script", "regexp_matches(x, '\\w+\\[\\w+\\]') AND x NOT LIKE '%.length%' AND x NOT LIKE '%.map%' AND x NOT LIKE '%.filter%'"),
        ("AI-CRASH-003", "script", "x LIKE '%JSON.parse%' AND x NOT LIKE '%try%'"),
        ("AI-CRASH-004", "script", "regexp_matches(x, '/\\s*\\w+') AND x NOT LIKE '%!== 0%' AND x NOT LIKE '%!= 0%'"),
        ("AI-CRASH-005", "dart", "x LIKE '%!%' AND x LIKE '%.%' AND x NOT LIKE '%?%'"),
    )
)
SQL["leak_lines"] = _flag_sql(
    (
        ("AI-MEM-001", "script", "x LIKE '%useEffect%' AND x LIKE '%setInterval%' OR x LIKE '%addEventListener%'"),
        ("AI-MEM-002", "script", "x LIKE '%useEffect%' AND x NOT LIKE '%],%'"),
        ("AI-MEM-003", "script", "x LIKE '%useState%' AND x LIKE '%[]%'"),
        ("AI-MEM-004", "dart", "x LIKE '%StatefulWidget%' AND x NOT LIKE '%dispose%'"),
    )
)
SQL["tree_metrics"] = f"SELECT depth, kind, count(*) AS n FROM ({SQL['file_tree']}) GROUP BY ALL"
_COUNT = lambda p: f"len(regexp_extract_all(body, '{p}'))"
_BODIES = f"""(WITH l AS (SELECT * FROM {LINES}),
    named AS (SELECT *, CASE WHEN lang IN ('javascript','typescript','jsx','tsx','vue') THEN CASE WHEN regexp_extract(line, '{extract.FUNCTION["javascript"]}', 1) <> '' THEN regexp_extract(line, '{extract.FUNCTION["javascript"]}', 1) ELSE regexp_extract(line, '{extract.FUNCTION["arrow"]}', 1) END
        WHEN lang = 'dart' THEN regexp_extract(line, '{extract.FUNCTION["dart"]}', 1) WHEN lang = 'python' THEN regexp_extract(line, '{extract.FUNCTION["python"]}', 1) END AS name FROM l),
    spans AS (SELECT file_id, lang, name, line_no AS start, coalesce(lead(line_no) OVER (PARTITION BY file_id ORDER BY line_no), 2000000000) AS next FROM named WHERE name <> ''),
    j AS (SELECT s.*, l.line_no, l.line, len(line) - len(replace(line, '{{', '')) AS o, len(line) - len(replace(line, '}}', '')) AS c FROM spans s JOIN l ON l.file_id = s.file_id AND l.line_no >= s.start AND l.line_no < s.next),
    b AS (SELECT *, sum(o - c) OVER w AS depth, max(o) OVER w AS opened FROM j WINDOW w AS (PARTITION BY file_id, start ORDER BY line_no)),
    e AS (SELECT *, min(CASE WHEN depth <= 0 AND opened > 0 AND lang <> 'python' THEN line_no END) OVER (PARTITION BY file_id, start) AS stop FROM b)
    SELECT file_id, lang, name, start, max(line_no) AS "end", string_agg(line, chr(10) ORDER BY line_no) AS body, greatest(max(depth), 0)::BIGINT AS nesting FROM e WHERE stop IS NULL OR line_no <= stop GROUP BY ALL)"""
_DECISION_SQL = " + ".join(_COUNT(p) for p in ("\\bif\\b", "\\belse\\s+if\\b", "\\bfor\\b", "\\bwhile\\b", "\\bswitch\\b", "\\bcase\\b", "\\?\\s*:", "&&", "\\|\\|"))
_COMPLEXITY = f"""(SELECT file_id, name, start, cyclomatic, loc, nesting,
        CASE WHEN cyclomatic > 50 OR loc > 200 OR nesting > 8 THEN 'very-high' WHEN cyclomatic > 20 OR loc > 100 OR nesting > 6 THEN 'high' WHEN cyclomatic > 10 OR loc > 50 OR nesting > 4 THEN 'medium' ELSE 'low' END AS level,
        greatest(0, least(100, 100.0 - greatest(cyclomatic - 10, 0) * 2 - greatest(cyclomatic - 20, 0) * 3 - greatest(loc - 50, 0) * 0.5 - greatest(loc - 100, 0) - greatest(nesting - 4, 0) * 5 - greatest(nesting - 6, 0) * 10))::DOUBLE AS score
    FROM (SELECT file_id, name, start, (1 + {_DECISION_SQL} + CASE WHEN lang = 'dart' THEN {_COUNT("\\bon\\b")} ELSE {_COUNT("\\bcatch\\b")} END)::BIGINT AS cyclomatic, ("end" - start + 1)::BIGINT AS loc, nesting FROM {_BODIES} WHERE lang IN ('javascript','typescript','jsx','tsx','dart')))"""
SQL["complexity"] = f"SELECT * FROM {_COMPLEXITY}"
SQL["function_report"] = f"SELECT level, count(*) AS functions, round(avg(score), 6) AS avg_score, max(cyclomatic) AS max_cyclomatic FROM {_COMPLEXITY} GROUP BY level"
SQL["function_flags"] = f"SELECT count(*) AS functions, " + ", ".join(f"sum(regexp_matches(body, '{p.replace(chr(39), chr(39) * 2)}')::BIGINT)::BIGINT AS {n}" for n, p in X.FLAGS.items()) + f" FROM {_BODIES}"
_BUILT = ", ".join(f"'{b}'" for b in X.BUILT_IN_CALLS)
SQL["function_calls"] = f"SELECT DISTINCT file_id, caller, start, callee FROM (SELECT file_id, name AS caller, start, unnest(regexp_extract_all(body, '([A-Za-z0-9_]+)\\s*\\(', 1)) AS callee FROM {_BODIES}) WHERE caller <> callee AND callee NOT IN ({_BUILT})"
_JS_PATTERNS = [p.replace("'", "''") for p in extract.IMPORTS["javascript"]]
_all = lambda text, ps: " || ".join(f"regexp_extract_all({text}, '{p}', 1)" for p in ps)
_IMPORTS = f"""(SELECT file_id, file_path, lang, unnest(CASE WHEN lang IN ('javascript','typescript','jsx','tsx') THEN {_all("content", _JS_PATTERNS)}
    WHEN lang = 'vue' THEN {_all("regexp_extract(content, '(?s)<script[^>]*>(.*?)</script>', 1)", _JS_PATTERNS)} WHEN lang = 'dart' THEN {_all("content", [extract.IMPORTS["dart"][0].replace("'", "''")])}
    WHEN lang = 'python' THEN {_all("content", extract.IMPORTS["python"])} END) AS source FROM {FILES} WHERE content IS NOT NULL)"""
_EXTERNAL = f"(source IN ({', '.join(repr(m) for m in X.BUILT_IN_MODULES)}) OR NOT (starts_with(source, '.') OR starts_with(source, '/')))"
SQL["js_imports"] = f"SELECT lang, source, count(*) AS imports, max({_EXTERNAL}::INT) AS external FROM {_IMPORTS} GROUP BY lang, source"
_CLASS = extract.CLASS.replace("'", "''")
_CLASSES = f"(SELECT file_id, repo, file_path, lang, line_no, regexp_extract(line, '{_CLASS}', 1) AS name, regexp_extract(line, '{_CLASS}', 2) AS super_class FROM {LINES} WHERE lang IN ('javascript','typescript','jsx','tsx','vue','dart','python') AND regexp_extract(line, '{_CLASS}', 1) <> '')"
SQL["class_list"] = f"""SELECT lang, CASE WHEN regexp_matches(lower(name), 'component|view|page|screen') THEN 'ui-component' WHEN regexp_matches(lower(name), 'service|handler|manager') THEN 'service' WHEN regexp_matches(lower(name), 'model|entity|dto|data') THEN 'data-model'
    WHEN regexp_matches(lower(name), 'util|helper|tool') THEN 'utility' WHEN regexp_matches(lower(name), 'config|settings|options') THEN 'configuration' WHEN regexp_matches(lower(name), 'constant|enum') THEN 'constants' ELSE 'class' END AS purpose, super_class, count(*) AS classes FROM {_CLASSES} GROUP BY ALL"""
SQL["file_types"] = f"""WITH p AS (SELECT lower(list_last(string_split(file_path, '/'))) AS name, lower(regexp_replace(file_path, '/[^/]*$', '')) AS folder FROM {FILES}), q AS (SELECT *, regexp_extract(name, '(\\.[^.]*)$', 1) AS ext FROM p)
    SELECT CASE WHEN ext IN ('.vue', '.jsx', '.tsx') THEN 'component' WHEN regexp_matches(folder, 'page|screen|view') THEN 'page' WHEN regexp_matches(folder, 'service|api') OR regexp_matches(name, 'service|api') THEN 'service' WHEN regexp_matches(folder, 'util|helper') OR regexp_matches(name, 'util|helper') THEN 'utility'
        WHEN regexp_matches(folder, 'constant|config') OR regexp_matches(name, 'constant|config') THEN 'config' WHEN suffix(name, '.d.ts') OR regexp_matches(folder, 'types|interfaces') THEN 'type' WHEN ext IN ('.css', '.scss', '.sass', '.less', '.styl') THEN 'style' WHEN regexp_matches(name, '\\.test\\.|\\.spec\\.|__tests__') THEN 'test'
        WHEN regexp_matches(folder, 'model|entity') OR regexp_matches(name, 'model|entity') THEN 'model' WHEN regexp_matches(folder, 'store|state') OR contains(name, 'store') THEN 'store' WHEN starts_with(name, 'use') AND ext IN ('.js', '.ts') THEN 'hook' ELSE 'module' END AS kind, count(*) AS files FROM q GROUP BY 1"""

_KNOWN_JS = f"(SELECT * FROM {FILES} WHERE lang IN ('javascript', 'typescript') AND content IS NOT NULL)"
SQL["undefined_calls"] = f"""WITH c AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '(?:^|[^.A-Za-z0-9_])([a-z][A-Za-z0-9_]*)\\(', 1)) AS name FROM {_KNOWN_JS}),
    k AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '(?:function\\s+|const\\s+|let\\s+|class\\s+|\\{{\\s*)([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM {_KNOWN_JS})
    SELECT file_id, name FROM c WHERE name NOT IN ({", ".join(f"'{k}'" for k in _KEYWORDS)}) EXCEPT SELECT file_id, name FROM k"""


#: The purposes of functions, said again in SQL: name n and body b in lower case.
_PURPOSE_TESTS = (
    ("create", "regexp_matches(n, 'create|add|insert|post')"),
    ("read", "regexp_matches(n, 'read|get|fetch|find|query|list')"),
    ("update", "regexp_matches(n, 'update|edit|modify|put|patch')"),
    ("delete", "regexp_matches(n, 'delete|remove|destroy')"),
    ("event-handler", "regexp_matches(n, '^(on|handle)') OR b LIKE '%addeventlistener%' OR contains(b, '.on(')"),
    ("lifecycle", "regexp_matches(n, 'init|mount|will|did')"),
    ("hook", "regexp_matches(n, '^use')"),
    ("api-call", "contains(b, 'fetch(') OR contains(b, 'axios.') OR contains(b, 'http.') OR contains(b, '.get(') OR contains(b, '.post(')"),
    ("state-management", "contains(b, 'setstate') OR contains(b, 'dispatch') OR contains(b, 'usestate') OR contains(b, 'usereducer')"),
    ("validation", "regexp_matches(n, 'validate|check|verify|is')"),
    ("utility", "regexp_matches(n, 'format|parse|convert|transform|to|util')"),
    ("render", "n IN ('render', 'build') OR n LIKE '%draw%'"),
    ("constructor", "n IN ('constructor', '__init__', 'init')"),
    ("accessor", "regexp_matches(n, '^(get|set)(_|.)')"),
)


def _purpose_sql() -> str:
    return f"list_filter([{', '.join(f'CASE WHEN {test} THEN {label!r} END' for label, test in _PURPOSE_TESTS)}], lambda x: x IS NOT NULL)"


SQL["function_purposes"] = f"""WITH f AS (SELECT name, lower(name) AS n, lower(body) AS b FROM {_BODIES}), p AS (SELECT *, {_purpose_sql()} AS p FROM f)
    SELECT CASE WHEN len(p) = 0 THEN 'business-logic' ELSE p[1] END AS purpose, CASE WHEN len(p) > 1 THEN 'medium' WHEN length(n) > 0 AND contains(b, replace(n, '_', '')) THEN 'high' ELSE 'low' END AS confidence,
    CASE WHEN starts_with(name, '_') THEN 'protected' WHEN suffix(name, '_') THEN 'private' ELSE 'public' END AS access, count(*) AS functions FROM p GROUP BY ALL"""
_FUNCTIONS = f"""(SELECT *, contains(line, 'async') AS is_async, starts_with(line, 'export') AS exported FROM (SELECT *, CASE WHEN lang IN ('javascript','typescript','jsx','tsx','vue') THEN CASE WHEN regexp_extract(line, '{extract.FUNCTION["javascript"]}', 1) <> '' THEN regexp_extract(line, '{extract.FUNCTION["javascript"]}', 1) ELSE regexp_extract(line, '{extract.FUNCTION["arrow"]}', 1) END
    WHEN lang = 'dart' THEN regexp_extract(line, '{extract.FUNCTION["dart"]}', 1) WHEN lang = 'python' THEN regexp_extract(line, '{extract.FUNCTION["python"]}', 1) END AS name FROM {LINES}) WHERE name <> '')"""
SQL["import_targets"] = f"""WITH RECURSIVE i AS (SELECT DISTINCT file_id, file_path, lang, source, {_EXTERNAL} AS external FROM {_IMPORTS}),
    s AS (SELECT DISTINCT file_path, source, list_filter(string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/') || string_split(source, '/'), lambda x: x NOT IN ('', '.')) AS rest, []::VARCHAR[] AS done FROM i WHERE NOT external
        UNION ALL SELECT file_path, source, rest[2:], CASE WHEN rest[1] = '..' THEN done[:-2] ELSE list_append(done, rest[1]) END FROM s WHERE len(rest) > 0),
    t AS (SELECT file_path, source, array_to_string(done, '/') AS target FROM s WHERE len(rest) = 0),
    c AS (SELECT file_path, source, target || e AS candidate FROM t, (SELECT unnest(['', '.js', '.jsx', '.ts', '.tsx', '.vue', '.dart']) AS e)),
    r AS (SELECT DISTINCT c.file_path, c.source FROM c JOIN files f ON f.file_path = c.candidate)
    SELECT external, r.source IS NOT NULL AS resolved, count(*) AS imports FROM (SELECT DISTINCT file_id, file_path, source, external FROM i) i LEFT JOIN r ON r.file_path = i.file_path AND r.source = i.source AND NOT external GROUP BY ALL"""
SQL["resolved_paths"] = f"""WITH RECURSIVE i AS (SELECT DISTINCT file_id, file_path, source FROM {_IMPORTS} WHERE starts_with(source, '.') AND lang <> 'python'),
    s AS (SELECT *, list_filter(string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/') || string_split(source, '/'), lambda x: x NOT IN ('', '.')) AS rest, []::VARCHAR[] AS done FROM i
        UNION ALL SELECT file_id, file_path, source, rest[2:], CASE WHEN rest[1] = '..' THEN done[:-2] ELSE list_append(done, rest[1]) END FROM s WHERE len(rest) > 0)
    SELECT file_id, source, array_to_string(done, '/') AS target FROM s WHERE len(rest) = 0"""
