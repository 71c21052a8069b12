"""Writers: graphs, reports, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One JSON line for each node and edge; ``sources.documents.load_graph`` reads it back."""
    n = nodes.select(F.lit("node").alias("kind"), "id", "type", "name")
    e = edges.select(F.lit("edge").alias("kind"), "src", "dst", "type")
    n.unionByName(e, allowMissingColumns=True).write.mode("overwrite").json(path)


def append_changelog(entries: DataFrame, path: str, at: str = "at") -> None:
    """Append to a log of JSON lines, one folder a day."""
    entries.withColumn("date", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(path)


def test_report(cases: DataFrame) -> DataFrame:
    """One row for each suite: cases, passed, failed, skipped, pass rate (0 for none)."""
    s = F.col("status")
    g = cases.groupBy("suite").agg(F.count("*").alias("cases"), *(F.sum((s == x).cast("long")).alias(x) for x in ("passed", "failed", "skipped")))
    return g.withColumn("rate", F.coalesce(F.round(F.try_divide(F.col("passed").cast("double"), F.col("cases").cast("double")), 6), F.lit(0.0)))


def junit(report: DataFrame) -> DataFrame:
    """The report as lines of a JUnit document."""
    return report.select(F.format_string('<testsuite name="%s" tests="%d" failures="%d" skipped="%d"/>', _escaped(F.col("suite")), "cases", "failed", "skipped").alias("text"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def knowledge_record(summary: DataFrame) -> DataFrame:
    """A scan's summary as one record of JSON."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("record"))
