"""Detectors for Dart that look at more than one line of a file; all within the row of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.extract import balanced_lines

# Objects that must be disposed.
CONTROLLERS = "TextEditingController|AnimationController|PageController|ScrollController|StreamController|GetxController"
LATE = r"^\s*late\s+([A-Za-z0-9_]+)\??\s+([A-Za-z0-9_]+)"
CHAIN = r"[A-Za-z0-9_]+(?:\?\.[A-Za-z0-9_]+|\.[A-Za-z0-9_]+){2,}"
NULLABLE_LIST = r"(?:RxList|List)<[^>]*\?[^>]*>\s+([A-Za-z0-9_]+)\s*[=;]"


def _dart(files: DataFrame) -> DataFrame:
    return files.where((F.col("lang") == "dart") & F.col("content").isNotNull()).select("file_id", "content", F.split("content", "\n", -1).alias("l"))


def _code(line: Column) -> Column:
    """A line without the comment at its end; empty for lines that are comments."""
    return F.when(F.trim(line).startswith("//") | F.trim(line).startswith("*"), "").otherwise(F.trim(F.split(line, "//")[0]))


def _from(found: Column) -> Column:
    """The lines from the first on that fits, up to the end of its braces; null if none fits."""
    at = F.array_position(F.transform("l", found), True)
    rest = F.slice("l", at.cast("int"), F.size("l"))
    return F.when(at > 0, F.array_join(F.slice(rest, F.lit(1), balanced_lines(rest)), "\n"))


def missing_dispose(files: DataFrame) -> DataFrame:
    """``file_id, line_no, name``: controllers of a stateful widget that its dispose method does not dispose."""
    d = _dart(files).where(F.col("content").contains("extends State<") | F.col("content").contains("extends StatefulWidget"))
    d = d.withColumn("dispose", F.coalesce(_from(lambda x: x.contains("void dispose()")), F.lit("")))
    either = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, rf"(?:final|late|var)\s+([A-Za-z0-9_]+)\s*=\s*(?:{CONTROLLERS})", 1), F.lit("")), F.nullif(F.regexp_extract(x, rf"(?:{CONTROLLERS})\s+([A-Za-z0-9_]+)\s*=", 1), F.lit("")))
    named = d.select("file_id", "dispose", F.posexplode(F.transform("l", either)).alias("i", "name")).where("name is not null")
    return named.where(~F.col("dispose").contains(F.concat("name", F.lit(".dispose()"))) & ~F.col("dispose").contains(F.concat("name", F.lit("?.dispose()")))).select("file_id", (F.col("i") + 1).alias("line_no"), "name")


def missing_return(files: DataFrame) -> DataFrame:
    """``file_id, line_no``: build methods whose body returns nothing."""
    d = _dart(files)
    starts = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("i"), (x.contains("Widget build(") | x.contains("Widget build (")).alias("is"))), lambda x: x["is"])
    d = d.select("file_id", "l", F.explode(starts).alias("s")).withColumn("rest", F.slice("l", F.col("s.i") + 1, F.size("l")))
    body = F.array_join(F.slice("rest", F.lit(1), balanced_lines(F.col("rest"))), "\n")
    return d.where(body.contains("{") & ~body.contains("return")).select("file_id", (F.col("s.i") + 1).alias("line_no"))


def nullable_lists(files: DataFrame) -> DataFrame:
    """``file_id, line_no, name``: first or last of a list whose elements may be null, without a guard."""
    d = _dart(files).withColumn("names", F.regexp_extract_all("content", F.lit(NULLABLE_LIST), F.lit(1))).where(F.size("names") > 0)
    found = d.select("file_id", "names", F.posexplode(F.transform("l", _code)).alias("i", "code")).where(F.col("code").rlike(r"\.(?:first|last)\b") & ~F.col("code").rlike(r"\?\.(?:first|last)|(?:first|last)OrNull"))
    used = found.select("file_id", "names", (F.col("i") + 1).alias("line_no"), F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"([A-Za-z0-9_]+)\.(?:first|last)\b"), F.lit(1)))).alias("name"))
    return used.where(F.array_contains("names", F.col("name"))).select("file_id", "line_no", "name")


def property_chains(files: DataFrame) -> DataFrame:
    """``file_id, line_no, chain``: accesses through three or more names, at least one of them unguarded."""
    lines = _dart(files).select("file_id", F.posexplode(F.transform("l", _code)).alias("i", "code"))
    chains = lines.select("file_id", (F.col("i") + 1).alias("line_no"), F.explode(F.regexp_extract_all("code", F.lit(f"({CHAIN})"), F.lit(1))).alias("chain"))
    return chains.where(F.regexp_replace("chain", r"\?\.", "").contains("."))


def late_variables(files: DataFrame) -> DataFrame:
    """``file_id, line_no, name``: uses of late variables that no line before them, after the declaration, assigns."""
    d = _dart(files).withColumn("code", F.transform("l", _code))
    late = F.filter(F.transform("code", lambda x, i: F.struct(i.alias("at"), F.regexp_extract(x, LATE, 2).alias("name"))), lambda x: x["name"] != "")
    d = d.select("file_id", "code", F.explode(late).alias("v")).select("file_id", "code", "v.*")
    word = lambda x: F.rlike(x, F.concat(F.lit(r"(^|[^A-Za-z0-9_])"), F.col("name"), F.lit(r"([^A-Za-z0-9_]|$)")))
    sets = lambda x: F.rlike(x, F.concat(F.lit(r"(^|[^A-Za-z0-9_])"), F.col("name"), F.lit(r"\s*=[^=]")))
    told = F.transform("code", lambda x, i: F.struct(i.alias("i"), (sets(x) & (i > F.col("at"))).alias("set"), (word(x) & ~x.contains("=") & (i > F.col("at"))).alias("used")))
    first = F.coalesce(F.array_min(F.transform(F.filter(told, lambda t: t["set"]), lambda t: t["i"])), F.lit(2_000_000_000))
    uses = d.select("file_id", "name", F.explode(F.filter(told, lambda t: t["used"] & (t["i"] < first))).alias("t"))
    return uses.select("file_id", (F.col("t.i") + 1).alias("line_no"), "name")
