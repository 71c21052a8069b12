"""Grouped aggregates, scores and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import half_up, ratio
from tessera.operators.windows import numbered

SEVERITIES = ("error", "warning", "info")


def once(rows: DataFrame, *key: str) -> DataFrame:
    """Rows delivered more than once, once."""
    return rows.dropDuplicates(list(key))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Issues by severity, by rule and by folder in one pass over grouping sets; ``grouping`` names the set."""
    i = issues.select(F.coalesce("severity", F.lit("medium")).alias("severity"), "rule_id", F.element_at(F.split("file_path", "/"), 1).alias("prefix"))
    cube = i.groupingSets([["severity"], ["rule_id"], ["prefix"]], "severity", "rule_id", "prefix").agg(F.count("*").alias("issues"), F.grouping("severity").alias("a"), F.grouping("rule_id").alias("b"))
    name = F.when(F.col("a") == 0, "severity").when(F.col("b") == 0, "rule").otherwise("prefix")
    return cube.select(name.alias("grouping"), F.coalesce("severity", "rule_id", "prefix").alias("value"), "issues")


def pass_rate(passed: Column, total: Column) -> Column:
    """Share of passes, 0 for none."""
    return ratio(passed, total)


def progress(tasks: DataFrame, status: str = "status") -> DataFrame:
    """One row: counts by status and the percentage completed, halves up."""
    s = F.col(status)
    t = tasks.agg(F.count("*").alias("total"), *(count_if(s == x).alias(x) for x in ("completed", "failed", "in_progress")))
    rest = F.col("total") - F.col("completed") - F.col("failed") - F.col("in_progress")
    return t.select("*", rest.alias("pending"), F.when(F.col("total") > 0, half_up(F.col("completed") * 100 / F.col("total"))).otherwise(F.lit(0)).alias("percentage"))


def histogram(values: DataFrame, column: str, width: float, *by: str) -> DataFrame:
    """Counts by bin of *width*."""
    return values.groupBy(*by, F.floor(F.col(column) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def compare_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Absolute difference by bin of two histograms; a bin that one lacks counts as 0 there."""
    j = a.select("bin", F.col("n").alias("x")).join(b.select("bin", F.col("n").alias("y")), "bin", "full_outer").na.fill(0)
    return j.select("bin", F.abs(F.col("x") - F.col("y")).alias("difference"))


def health(deductions: Column) -> tuple[Column, Column]:
    """Score 100 less deductions, floored at 0, and the band of the score before the floor."""
    raw = F.lit(100) - deductions
    return F.greatest(F.lit(0), raw), F.when(raw >= 80, "excellent").when(raw >= 60, "good").when(raw >= 40, "fair").otherwise("poor")


def age_buckets(rows: DataFrame, at: str, now: str) -> DataFrame:
    """Rows younger than an hour, than a day, and older, at the time *now*."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(at))
    return rows.groupBy(F.when(age < 3600, "hour").when(age < 86400, "day").otherwise("older").alias("bucket")).agg(F.count("*").alias("n"))


def chunks(rows: DataFrame, by: str, order: list[str], most: Column) -> DataFrame:
    """Rows of each group in segments of at most *most*, in order; the order must tell rows apart."""
    return numbered(rows, [by], order, "_n").withColumn("segment", F.floor((F.col("_n") - 1) / most).cast("int")).drop("_n")


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first *n* rows: ordered within partitions first, then merged; no full sort."""
    return rows.orderBy(*order).limit(n)


def classified(message: Column, classes: tuple[tuple[str, tuple[str, ...]], ...], otherwise: str = "unknown") -> Column:
    """The first class one of whose parts occurs in the message."""
    text = F.lower(message)
    out = F.when(F.lit(False), "")
    for label, parts in classes:
        hit = F.lit(False)
        for p in parts:
            hit = hit | text.contains(p)
        out = out.when(hit, label)
    return out.otherwise(otherwise)
