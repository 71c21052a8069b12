"""Readers of semi-structured texts: API documents, bundles of translations, manifests, status lines, cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def api_headings(documents: DataFrame) -> DataFrame:
    """Interfaces described in Markdown: ``## name(a, b)`` as name and number of parameters."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^## ([A-Za-z_][A-Za-z0-9_]*\([^)\n]*\))"), F.lit(1))
    h = documents.where("text is not null").select("doc_id", F.explode(found).alias("h"))
    arguments = F.trim(F.regexp_extract("h", r"\(([^)]*)\)", 1))
    return h.select("doc_id", F.regexp_extract("h", r"^([A-Za-z0-9_]+)", 1).alias("name"), F.when(F.length(arguments) == 0, 0).otherwise(F.size(F.split(arguments, ","))).alias("parameters"))


def translations(slices: DataFrame) -> DataFrame:
    """``slice_id, key, value`` of the bundles ``'a.b': 'text'``."""
    pairs = F.regexp_extract_all("content", F.lit(r"('[A-Za-z0-9_.]+'\s*:\s*'[^'\n]*')"), F.lit(1))
    p = slices.where("content is not null").select("slice_id", F.explode(pairs).alias("p"))
    return p.select("slice_id", F.regexp_extract("p", r"^'([^']+)'", 1).alias("key"), F.regexp_extract("p", r":\s*'([^']*)'$", 1).alias("value"))


def locked_packages(files: DataFrame) -> DataFrame:
    """``file_id, package, version`` of package lock files."""
    v = files.where("file_path like '%package-lock.json'").select("file_id", F.try_parse_json("content").alias("v")).where("v is not null")
    packages = F.try_variant_get("v", "$.packages", "map<string,variant>")
    e = v.select("file_id", F.explode(packages).alias("path", "p"))
    return e.where("path <> ''").select("file_id", F.regexp_replace("path", "^.*node_modules/", "").alias("package"), F.try_variant_get("p", "$.version", "string").alias("version"))


def status_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Changed files of a version control's name-status lines: a rename means its new path; documents, locks and images are left out."""
    parts = F.split(column, "\t")
    kind = F.substring(parts[0], 1, 1)
    path = F.element_at(parts, -1)
    skipped = path.rlike(r"(?i)\.(md|lock|png|jpe?g|gif|svg|ico)\z") | path.endswith("package-lock.json")
    return lines.where(F.size(parts) > 1).select(F.when(kind == "A", "added").when(kind == "R", "renamed").when(kind == "C", "copied").otherwise("modified").alias("status"), path.alias("path"), skipped.alias("s"), kind.alias("k")).where("not s and k <> 'D'").drop("s", "k")


def mapped_headers(rows: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns under their canonical names: the first alias that is there and not null; missing ones are null."""
    have = {c.lower(): c for c in rows.columns}
    out = []
    for name, others in aliases.items():
        found = [F.col(f"`{have[o.lower()]}`") for o in [name, *others] if o.lower() in have]
        out.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    return rows.select(*out)


#: Headers of test-case sheets.
CASE_HEADERS = {"name": ["test case", "title", "用例名称", "功能"], "steps": ["step", "测试步骤", "步骤"], "expected": ["expected result", "预期结果", "预期"], "priority": ["优先级", "優先級"]}


def test_cases(rows: DataFrame) -> DataFrame:
    """Test cases of a sheet; rows with neither name nor steps are dropped."""
    return mapped_headers(rows, CASE_HEADERS).where("coalesce(name, '') <> '' or coalesce(steps, '') <> ''")


GRAPH = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("name", T.StringType())]))),
        T.StructField("edges", T.ArrayType(T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("type", T.StringType())]))),
    ]
)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a saved graph: JSON lines of one record each, or whole documents with arrays."""
    lines = spark.read.schema("kind string, id long, src long, dst long, type string, name string").json(path)
    return lines.where("kind = 'node'").select("id", "type", "name"), lines.where("kind = 'edge'").select("src", "dst", "type")


def flattened(value: Column, depth: int = 4) -> Column:
    """Dotted paths and texts of the string and number leaves of a JSON object, to *depth* levels."""
    def below(v: Column, prefix: Column, level: int) -> Column:
        entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        leaf = lambda e: F.array(F.struct(F.concat(prefix, e["key"]).alias("key"), F.try_variant_get(e["value"], "$", "string").alias("value")))
        if level == depth:
            return F.flatten(F.transform(entries, leaf))
        inner = lambda e: F.when(F.schema_of_variant(e["value"]).startswith("OBJECT"), below(e["value"], F.concat(prefix, e["key"], F.lit(".")), level + 1)).otherwise(leaf(e))
        return F.flatten(F.transform(entries, inner))

    return below(value, F.lit(""), 1)


def first_filled(*columns: str) -> Column:
    """The first column that is neither null nor blank."""
    return reduce(lambda a, b: F.coalesce(a, b), (F.when(F.length(F.trim(F.col(c))) > 0, F.col(c)) for c in columns))
