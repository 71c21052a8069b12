import re

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import scan

FILES = "file_id long, repo string, file_path string, lang string, content string, line_no int, rule_id string, size_bytes long, modified_at timestamp, ingested_at timestamp"
RULES = "rule_id string, rule_name string, severity string, languages array<string>, match_pattern string, message string, suggestion string, auto_fix boolean, max_lines int, max_length int, enabled boolean, ord int"


def files(spark, *contents):
    return spark.createDataFrame([(i, "r", f"f{i}.js", "javascript", c, 99, "clash", 1, None, None) for i, c in enumerate(contents)], FILES)


def rules(spark, *patterns):
    return spark.createDataFrame([(f"R{i}", "n", "warning", ["javascript"], p, "m", "s", False, None, None, True, i) for i, p in enumerate(patterns)], RULES)


def test_matches_against_brute_force(spark):
    texts = ["console.log(1)\nlet a = 1\n\nvar b", None, "", "x\r\nconsole.debug(2);", "let a = 1\n" * 3000]
    patterns = [r"console\.(log|debug)\(", r"^\s*let\s", r"\bvar\b"]
    f = files(spark, *texts).drop("rule_id", "line_no")
    got = sorted((r.file_id, r.line_no, r.rule_id) for r in scan.matches(scan.lines(f, "file_id", "content", "lang"), rules(spark, *patterns), ("file_id", "line_no")).select("file_id", "line_no", "rule_id").distinct().collect())
    want = sorted((i, n, f"R{k}") for i, t in enumerate(texts) if t for n, line in enumerate(t.split("\n"), 1) for k, p in enumerate(patterns) if re.search(p, line))
    assert got == want


def test_no_rules_no_files(spark):
    f = files(spark, "a").drop("rule_id", "line_no")
    lines = scan.lines(f, "file_id", "content", "lang")
    assert scan.matches(lines, rules(spark).limit(0), ("file_id", "line_no")).count() == 0
    assert scan.matches(lines.limit(0), rules(spark, "a"), ("file_id", "line_no")).count() == 0


def test_duplicates_and_nesting(spark):
    f = files(spark, "if (a) {\n  if (b) {\n    c()\n  }\n}\nd()\nd()\n").drop("rule_id", "line_no")
    lines = scan.lines(f)
    assert scan.nesting(lines).count() >= 1
    assert scan.duplicates(lines, "line", "file_id").count() >= 1


def expression(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_expressions(spark):
    assert expression(spark, X.jaccard(X.tokens(F.col("a")), X.tokens(F.col("b"))), a="x y z", b="y z w") == 0.5
    assert expression(spark, X.snippet(F.col("t"), F.lit("mid")), t="a" * 30 + "mid" + "b" * 30) == "..." + "a" * 20 + "mid" + "b" * 20 + "..."
    assert expression(spark, X.snippet(F.col("t"), F.lit("no")), t="abc") is None
    assert expression(spark, X.colour_distance(F.col("a"), F.col("b")), a="#000000", b="#0000ff") == 255.0
    assert expression(spark, X.colour_distance(F.col("a"), F.col("b")), a="red", b="#0000ff") == 0.0
    assert expression(spark, X.token_estimate(F.col("t")), t="abcd测试") == 4
    assert expression(spark, X.trend(F.col("a"), F.col("b")), a=10, b=3) == "improving"
    assert expression(spark, X.half_up(F.col("a")), a=-2.5) == -2


def test_resolve_path(spark):
    assert expression(spark, X.resolve_path(F.col("a"), F.col("b")), a="src/a/b.js", b="../c/d") == "src/c/d"
    assert expression(spark, X.resolve_path(F.col("a"), F.col("b")), a="src/a/b.js", b="./d") == "src/a/d"


def test_simplified(spark):
    assert expression(spark, X.simplified(F.col("a")), a="優級測試") == "优级测试"


def test_insert_lines(spark):
    text = spark.createDataFrame([(1, "a\nb\nc")], "file_id long, content string")
    assert text.count() == 1
