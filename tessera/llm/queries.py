"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import encodings, handwritten, leaks, mixing, secrets, splitting, syntax
from tessera.session import checkpoint
from tessera.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every line on which a secret value begins."""
    return secrets.all_findings(table(spark, folder, "files"), table(spark, folder, "provider_config")).select("place", "rec_id", "line_no").distinct()


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every file with secrets, the secrets masked."""
    return secrets.redacted(table(spark, folder, "files"), "file_id", "content")


def p1_redacted_settings(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every saved provider setting with secrets, the secrets masked."""
    return secrets.redacted_settings(table(spark, folder, "provider_config"))


def p1_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Findings and affected records by place and kind of secret."""
    found = secrets.all_findings(table(spark, folder, "files"), table(spark, folder, "provider_config")).distinct()
    return found.groupBy("place", "kind").agg(F.count("*").alias("findings"), F.count_distinct("rec_id").alias("records"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Slices over the limit of their type."""
    return splitting.oversized(table(spark, folder, "slices"), table(spark, folder, "slice_limits"))


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of those slices."""
    return splitting.split_slices(table(spark, folder, "slices"), table(spark, folder, "slice_limits"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that were not written by hand."""
    return handwritten.judged(table(spark, folder, "files")).where("kind <> ''").select("file_id").distinct()


def p3_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with its kind and the evidence."""
    return handwritten.judged(table(spark, folder, "files"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are not valid in the language of their extension."""
    return syntax.checked(table(spark, folder, "files"), measured=False).where("cost > 0").select("file_id").distinct()


def p5_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Those files with cost, kind and line of the fault, and what the scanner saw there."""
    faults = checkpoint(syntax.checked(table(spark, folder, "files")).where("cost > 0"))  # texts are parsed once
    return syntax.with_evidence(faults, table(spark, folder, "issues")).select("file_id", "repo", "ext", "n_lines", "cost", "kind", "line", "n_issues", "n_behind_end", "n_at_fault")


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of invalid files by repository and language."""
    return syntax.rates(syntax.checked(table(spark, folder, "files"), measured=False))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation items and the documents that contain them."""
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("item_id", "doc_id")


def p6_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Affected documents with the items they contain."""
    return leaks.documents_with_items(leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")))


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    items = table(spark, folder, "eval_items")
    return leaks.leaked_items(leaks.leaks(table(spark, folder, "documents"), items), items)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture in training order."""
    return mixing.in_order(mixing.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets")))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of the sources."""
    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, folder, "documents"), targets), targets)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents decoded with the wrong encoding, wholly or in a passage."""
    return encodings.garbled(table(spark, folder, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Those documents with the text as it was written, where no letter is lost."""
    return encodings.garbled(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_redacted, p1_redacted_settings, p1_kinds, p2_found, p2_pieces, p3_found, p3_kinds, p5_found, p5_faults, p5_rates, p6_found, p6_documents, p6_items, p7_mixture, p7_shares, p8_found, p8_restored)
}

SQL: dict[str, str] = {
    "p2_found": """
        SELECT DISTINCT s.slice_id
        FROM slices s JOIN slice_limits l ON l.slice_type = coalesce(s.slice_type, 'default')
        WHERE length(s.content) > l.max_file_size
    """,
}
