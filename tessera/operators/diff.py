"""Differences of snapshots, lists and line sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``key, status`` of what was added, modified, deleted or left unchanged; values compare null-safe."""
    a = old.select(F.col(key), F.col(value).alias("a"), F.lit(True).alias("in_a"))
    b = new.select(F.col(key), F.col(value).alias("b"), F.lit(True).alias("in_b"))
    j = a.join(b, key, "full_outer")
    return j.select(key, F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("modified").alias("status"))


def compare_fingerprints(old: DataFrame, new: DataFrame, key: str = "fingerprint") -> DataFrame:
    """``fingerprint, state``: new, fixed or recurring."""
    a, b = old.select(key).distinct().withColumn("was", F.lit(1)), new.select(key).distinct().withColumn("now", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.select(key, F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "fixed").otherwise("recurring").alias("state"))


def merge_keep_old(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All old rows, and the new ones whose key no old row has."""
    return old.unionByName(new.join(old.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def tagged_union(**parts: DataFrame) -> DataFrame:
    """Rows of all parts with the name of their part."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def positional_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Lines that differ at the same place: add, delete or modify. Not a longest common subsequence.

    Both sides: key, line_no, line.
    """
    a = old.select(key, "line_no", F.col("line").alias("a"), F.lit(True).alias("in_a"))
    b = new.select(key, "line_no", F.col("line").alias("b"), F.lit(True).alias("in_b"))
    j = a.join(b, [key, "line_no"], "full_outer")
    kind = F.when(F.col("in_a").isNull(), "add").when(F.col("in_b").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "modify")
    return j.select(key, "line_no", kind.alias("kind")).where("kind is not null")


def hunks(changes: DataFrame, key: str, context: int = 3) -> DataFrame:
    """Runs of changes of each key: a run closes after *context* unchanged lines in all, counted from its start.

    ``changes``: key, line_no, kind (null for an unchanged line). The count of unchanged lines is
    cumulative within a run, so runs are found one line after another, a key at a time.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line_no")
        out, start, same, changed, last = [], None, 0, 0, 0
        for n, kind in zip(rows["line_no"], rows["kind"], strict=True):
            if kind is not None and kind == kind:
                start = n if start is None else start
                changed, last = changed + 1, n
            elif start is not None:
                same += 1
                if same >= context:
                    out.append((rows[key].iloc[0], start, last, changed))
                    start, same, changed = None, 0, 0
        if start is not None:
            out.append((rows[key].iloc[0], start, last, changed))
        return pd.DataFrame(out, columns=[key, "start", "end", "changed"])

    kind = dict(changes.dtypes)[key]
    return changes.select(key, "line_no", "kind").groupBy(key).applyInPandas(run, f"{key} {kind}, start int, end int, changed int")


def changed_since(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files to scan again: unknown to the state, or of another time and hash."""
    j = files.join(state.select("file_path", F.col("modified_at").alias("seen_at"), F.col("digest").alias("seen")), "file_path", "left")
    reason = F.when(F.col("seen_at").isNull(), "new").when((F.col("modified_at") != F.col("seen_at")) & ~F.col("digest").eqNullSafe(F.col("seen")), "changed")
    return j.select("file_path", reason.alias("reason")).where("reason is not null")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = before + 1 if x == y else max(row[j], row[j - 1])
            before = keep
    return row[-1]


def with_lcs(rows: DataFrame, a: str, b: str, name: str = "lcs") -> DataFrame:
    """*rows* with the length of the longest common subsequence of two columns; null if either is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[name] = [None if x is None or y is None else lcs_length(x, y) for x, y in zip(batch[a], batch[b], strict=True)]
            batch[name] = batch[name].astype("Int64")
            yield batch

    return rows.mapInPandas(run, f"{rows.schema.simpleString()[7:-1].replace(':', ' ')}, {name} long".replace(",", ", "))


def alternatives(have: Column, options: list[str]) -> Column:
    """The options that are not there yet."""
    return F.array_except(F.array(*(F.lit(o) for o in options)), have)
