"""Entities of source files: imports, functions, classes and their relations as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import is_external, resolve_path, without_extension
from tessera.operators.scan import lines

#: Import patterns by language; the group is the source.
IMPORTS = {
    "javascript": (r"import\s+[^'\"\n;]*?from\s+['\"]([^'\"\n]+)['\"]", r"import\s+['\"]([^'\"\n]+)['\"]", r"require\(\s*['\"]([^'\"\n]+)['\"]\s*\)", r"export\s+[^'\"\n;]*?from\s+['\"]([^'\"\n]+)['\"]"),
    "dart": (r"import\s+['\"]([^'\"\n]+)['\"]",),
    "python": (r"(?m)^from\s+([A-Za-z0-9_.]+)\s+import", r"(?m)^import\s+([A-Za-z0-9_.]+)"),
}
SCRIPT = r"(?s)<script[^>]*>(.*?)</script>"


def _extracted(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns)))


def imports(files: DataFrame) -> DataFrame:
    """``file_id, file_path, lang, source`` of every import; a component file counts its script block only."""
    script = F.regexp_extract("content", SCRIPT, 1)
    js = F.col("lang").isin("javascript", "typescript", "jsx", "tsx")
    found = (
        F.when(js, _extracted(F.col("content"), IMPORTS["javascript"]))
        .when(F.col("lang") == "vue", _extracted(script, IMPORTS["javascript"]))
        .when(F.col("lang") == "dart", _extracted(F.col("content"), IMPORTS["dart"]))
        .when(F.col("lang") == "python", _extracted(F.col("content"), IMPORTS["python"]))
    )
    return files.where(F.col("content").isNotNull()).select("file_id", "file_path", "lang", F.explode(found).alias("source"))


def import_lines(files: DataFrame) -> DataFrame:
    """Imports with their line, one row per line."""
    found = lines(files, "file_id", "content", "lang", "repo")
    pattern = r"^\s*import\s[^'\"]*['\"]([^'\"]+)['\"]"
    return found.where(F.col("line").rlike(pattern)).select("file_id", "repo", "lang", "line_no", "line", F.regexp_extract("line", pattern, 1).alias("source"))


#: Declarations by language; the group is the name.
FUNCTION = {
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][A-Za-z0-9_$]*)\s*[<(]",
    "arrow": r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>",
    "dart": r"^\s*(?:static\s+)?(?:Future<[^(]*>|int|String|double|bool|void|Widget|Map<[^(]*>|List<[^(]*>)\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    "python": r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
}
CLASS = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)(?:\s*(?:extends\s+|\()([A-Za-z_$][A-Za-z0-9_$.]*))?"


def _function_name(line: Column, lang: Column) -> Column:
    """The name that a line declares as a function, empty or null if none."""
    js = lang.isin("javascript", "typescript", "jsx", "tsx", "vue")
    either = lambda *ps: reduce(lambda a, b: F.when(F.length(a) > 0, a).otherwise(b), (F.regexp_extract(line, p, 1) for p in ps))
    return F.when(js, either(FUNCTION["javascript"], FUNCTION["arrow"])).when(lang == "dart", F.regexp_extract(line, FUNCTION["dart"], 1)).when(lang == "python", F.regexp_extract(line, FUNCTION["python"], 1))


def functions(files: DataFrame) -> DataFrame:
    """Functions by declaration line: name, whether async and exported, line, and the line before the next declaration."""
    found = lines(files, "file_id", "content", "repo", "file_path", "lang")
    named = found.withColumn("name", _function_name(F.col("line"), F.col("lang"))).where(F.length("name") > 0)
    return named.select("file_id", "repo", "file_path", "lang", "name", "line_no", F.col("line").contains("async").alias("is_async"), F.col("line").startswith("export").alias("exported"))


def function_bodies(files: DataFrame) -> DataFrame:
    """Functions with end line and body: up to the line on which the braces balance, else to the next declaration.

    The body of a function is the run of lines from its declaration to the first line where the
    running sum of braces returns to zero after it was opened; Python ends at the next
    declaration of the file. Everything is computed within the row of a file: nothing is shuffled.
    """
    text = files.where(F.col("content").isNotNull()).select("file_id", "repo", "lang", F.split("content", "\n", -1).alias("l"))
    declared = F.filter(
        F.transform("l", lambda line, i: F.struct((i + 1).alias("start"), _function_name(line, F.col("lang")).alias("name"), line.contains("async").alias("is_async"), line.startswith("export").alias("exported"))),
        lambda d: F.length(d["name"]) > 0,
    )
    text = text.withColumn("d", declared).where(F.size("d") > 0)
    after = lambda k: F.coalesce(F.get("d", k + 1)["start"], F.size("l") + 1)
    span = F.transform("d", lambda d, k: F.struct(d["name"].alias("name"), d["start"].alias("start"), d["is_async"].alias("is_async"), d["exported"].alias("exported"), F.slice("l", d["start"], after(k) - d["start"]).alias("lines")))
    rows = text.select("file_id", "repo", "lang", F.explode(span).alias("f")).select("file_id", "repo", "lang", "f.*")
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(0).alias("most"), F.lit(False).alias("opened"), F.lit(None).cast("int").alias("end"))

    def onward(s: Column, line: Column) -> Column:
        opens = F.regexp_count(line, F.lit(r"\{"))
        depth, opened = s["depth"] + opens - F.regexp_count(line, F.lit(r"\}")), s["opened"] | (opens > 0)
        ends = (depth <= 0) & opened & (F.col("lang") != "python")
        return F.when(s["end"].isNotNull(), s).otherwise(
            F.struct((s["n"] + 1).alias("n"), depth.alias("depth"), F.greatest(s["most"], depth).alias("most"), opened.alias("opened"), F.when(ends, s["n"] + 1).alias("end"))
        )

    scanned = rows.withColumn("s", F.aggregate("lines", state, onward))
    return scanned.select("file_id", "repo", "lang", "name", "start", "is_async", "exported", (F.col("start") + F.col("s.n") - 1).alias("end"), F.array_join(F.slice("lines", F.lit(1), F.col("s.n")), "\n").alias("body"), F.col("s.most").alias("nesting"))


def classes(files: DataFrame) -> DataFrame:
    """Classes with superclass (null if none) and line."""
    found = lines(files, "file_id", "content", "repo", "file_path", "lang").where(F.col("lang").isin("javascript", "typescript", "jsx", "tsx", "vue", "dart", "python"))
    named = found.withColumn("name", F.regexp_extract("line", CLASS, 1)).where(F.length("name") > 0)
    return named.select("file_id", "repo", "file_path", "lang", "name", F.nullif(F.regexp_extract("line", CLASS, 2), F.lit("")).alias("super_class"), "line_no")


def nodes(files: DataFrame) -> DataFrame:
    """One table of graph nodes: files, functions, classes and imports, with stable identifiers."""
    ident = lambda kind, *parts: F.xxhash64(F.lit(kind), *parts)
    f = files.select(ident("file", "file_path").alias("id"), F.lit("file").alias("type"), F.element_at(F.split("file_path", "/"), -1).alias("name"), "file_id", F.lit(0).alias("line_no"))
    fn = functions(files).select(ident("function", "file_path", "line_no", "name").alias("id"), F.lit("function").alias("type"), "name", "file_id", "line_no")
    cl = classes(files).select(ident("class", "file_path", "line_no", "name").alias("id"), F.lit("class").alias("type"), "name", "file_id", "line_no")
    im = imports(files).select(ident("import", "file_path", "source").alias("id"), F.lit("import").alias("type"), F.col("source").alias("name"), "file_id", F.lit(0).alias("line_no"))
    return f.unionByName(fn).unionByName(cl).unionByName(im).dropDuplicates(["id"])


def contains_edges(all_nodes: DataFrame) -> DataFrame:
    """Edges from files to what they contain."""
    owners = all_nodes.where("type = 'file'").select("file_id", F.col("id").alias("src"))
    return all_nodes.where("type <> 'file'").join(owners, "file_id").select("src", F.col("id").alias("dst"), F.lit("contains").alias("type"), "file_id")


def resolved_imports(found: DataFrame, known: DataFrame, extensions: tuple[str, ...] = (".js", ".jsx", ".ts", ".tsx", ".vue", ".dart")) -> DataFrame:
    """Imports with the file they mean: the path itself, then each extension; the first that exists. Null if none or external."""
    target = resolve_path(F.col("file_path"), F.col("source"))
    wanted = found.withColumn("external", is_external(F.col("source"))).withColumn("target", F.when(~F.col("external"), target))
    candidates = F.array(F.col("target"), *(F.concat(F.col("target"), F.lit(e)) for e in extensions))
    tried = wanted.select("file_id", "source", "external", F.posexplode_outer(F.when(~F.col("external"), candidates)).alias("rank", "candidate"))
    hit = tried.join(known.select(F.col("file_id").alias("target_id"), F.col("file_path").alias("candidate")), "candidate", "left")
    return hit.groupBy("file_id", "source", "external").agg(F.min_by("target_id", F.when(F.col("target_id").isNotNull(), F.col("rank"))).alias("target_id"))


def ranked_calls(made: DataFrame, defined: DataFrame) -> DataFrame:
    """Calls with the function they mean: one in the same file, else the first exported, else the first of that name.

    ``made``: file_id, caller, callee. ``defined``: file_id, name, line_no, exported. Definitions
    are reduced to one row a file and name, and to one a name, before any call meets them, so a
    name that everyone declares and calls multiplies nothing. Calls of unknown names have nulls.
    """
    own = defined.groupBy("file_id", F.col("name").alias("callee")).agg(F.min("line_no").alias("own_line"))
    order = F.struct((~F.coalesce("exported", F.lit(False))).alias("o"), F.col("file_id").alias("f"), F.col("line_no").alias("l"))
    best = defined.groupBy(F.col("name").alias("callee")).agg(F.min(order).alias("best"))
    joined = made.select("file_id", "caller", "callee").distinct().join(own, ["file_id", "callee"], "left").join(best, "callee", "left")
    here = F.col("own_line").isNotNull()
    return joined.select("file_id", "caller", "callee", F.when(here, F.col("file_id")).otherwise(F.col("best.f")).alias("target_file"), F.coalesce("own_line", "best.l").alias("target_line"))


def file_tree(paths: DataFrame) -> DataFrame:
    """All folders and files of the paths: path, parent, depth, kind."""
    parts = F.split("file_path", "/")
    rows = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("path"), F.array_join(F.slice(parts, 1, n - 1), "/").alias("parent"), n.alias("depth"), F.when(n == F.size(parts), "file").otherwise("folder").alias("kind")))).alias("n"))
    return rows.select("n.*").distinct()


def same_stem(found: DataFrame) -> Column:
    """Helper: the path without extension."""
    return without_extension(F.col("file_path"))


def balanced_lines(text: Column, by_braces: Column | None = None) -> Column:
    """How many of an array of lines it takes until the braces that opened first are closed; all if they never are."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(False).alias("done"))

    def onward(s: Column, line: Column) -> Column:
        opens = F.regexp_count(line, F.lit(r"\{"))
        depth, opened = s["depth"] + opens - F.regexp_count(line, F.lit(r"\}")), s["opened"] | (opens > 0)
        return F.when(s["done"], s).otherwise(F.struct((s["n"] + 1).alias("n"), depth.alias("depth"), opened.alias("opened"), ((depth <= 0) & opened & (F.lit(True) if by_braces is None else by_braces)).alias("done")))

    return F.aggregate(text, state, onward)["n"]


#: What counts as a method or a field within the body of a class.
METHOD = r"^\s+(?:@?[A-Za-z_<>\[\], ?]+\s+)?(?:async\s+)?(?:def\s+)?(?!(?:if|for|while|switch|catch|return|function)\b)[A-Za-z_][A-Za-z0-9_]*\([^;]*\)[^;]*[{:]\s*$"
FIELD = r"^\s+(?:this\.[A-Za-z_][A-Za-z0-9_]*\s*=|self\.[A-Za-z_][A-Za-z0-9_]*\s*=|(?:private |public |protected )?(?:readonly |static |final |late )+[A-Za-z_])"


def class_bodies(files: DataFrame) -> DataFrame:
    """Classes with their body and the number of methods and fields in it, all within the row of a file."""
    text = files.where(F.col("content").isNotNull() & F.col("lang").isin("javascript", "typescript", "jsx", "tsx", "vue", "dart", "python")).select("file_id", "repo", "lang", F.split("content", "\n", -1).alias("l"))
    declared = F.filter(F.transform("l", lambda line, i: F.struct((i + 1).alias("start"), F.regexp_extract(line, CLASS, 1).alias("name"))), lambda d: F.length(d["name"]) > 0)
    text = text.withColumn("d", declared).where(F.size("d") > 0)
    after = lambda k: F.coalesce(F.get("d", k + 1)["start"], F.size("l") + 1)
    rows = text.select("file_id", "repo", "lang", F.explode(F.transform("d", lambda d, k: F.struct(d["name"].alias("name"), d["start"].alias("start"), F.slice("l", d["start"], after(k) - d["start"]).alias("lines")))).alias("c")).select("file_id", "repo", "lang", "c.*")
    rows = rows.withColumn("lines", F.slice("lines", F.lit(1), balanced_lines(F.col("lines"), F.col("lang") != "python")))
    inner = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    many = lambda p: F.size(F.filter(inner, lambda x: x.rlike(p)))
    return rows.select("file_id", "repo", "lang", "name", "start", F.array_join("lines", "\n").alias("body"), many(METHOD).alias("methods"), many(FIELD).alias("fields"))
