"""Mix sources to target shares of tokens, along a curriculum.

Method: time-varying curriculum. Every source has a weight schedule w(t) over the time t in
[0, 1] of the mixture; its integral is the source's share, and at each moment the weights sum
to 1. The cumulative token demand of a source up to time t is therefore W(t) * total; a
document whose tokens begin at c of its source's demand stands at the t with W(t) = c. The
schedule is linear, so W is a parabola and its inverse a square root, all in SQL expressions.
Documents are then sorted by range of that position.

The order of documents within a source is that of a hash. Running token sums are taken in two
steps: sums of hash buckets (``BUCKETS`` for a source, the only figures that are gathered) and
sums within a bucket, so that a source with a third of all documents is not one task.

Shares: the mixture is as large as the caps on repeats allow while every source with documents
has its exact share; a source of the targets without documents leaves its share to the others
in proportion. With a given total, sources that their cap limits are filled up and the others
share the rest in proportion (water filling).

Defined cases: null and empty texts have no tokens and no place; documents whose source is not
listed have no place; spellings of a source that differ in case and separators are one source;
copies of a text under several doc_ids are documents of their own; the last, partial pass over
a source ends at the document boundary nearest to its demand, but no document exceeds its cap.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import checkpoint, spread

#: Hash buckets of a source for running sums.
BUCKETS = 1024
#: Steepest schedule: weight at the start and end differ from the mean by at most this part of it.
STEEPEST = 0.5


def source_name(column: Column) -> Column:
    """A source without differences of case and separators."""
    return F.lower(F.regexp_replace(F.trim(column), r"[\s\-_.]+", "_"))


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mixture", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> tuple[str, str]:
    """Path of the rank file and split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_counts(documents: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document with text and a source."""
    if path is None or pattern is None:
        path, pattern = default_tokenizer()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text").where((F.length("text") > 0) & F.col("source").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoding(path, pattern)
        for batch in batches:
            counts = [len(known.encode_ordinary(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": counts})

    return spread(rows, "doc_id").mapInPandas(run, "doc_id long, source string, n_tokens long").dropDuplicates(["doc_id"])


def demands(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens demanded of each source: available tokens and (share, cap on repeats) by source."""
    open_ = {s: share for s, (share, _) in targets.items() if available.get(s, 0) > 0 and share > 0}
    caps = {s: available[s] * targets[s][1] for s in open_}
    if not open_:
        return {}
    whole = sum(open_.values())
    if total is None:  # the largest mixture with exact shares
        total = min(caps[s] * whole / share for s, share in open_.items())
        return {s: total * share / whole for s, share in open_.items()}
    out: dict[str, float] = {}
    left = float(total)
    while open_:  # fill sources up to their caps, share the rest in proportion
        whole = sum(open_.values())
        full = [s for s, share in open_.items() if caps[s] <= left * share / whole]
        if not full:
            return out | {s: left * share / whole for s, share in open_.items()}
        for s in full:
            out[s] = float(caps[s])
            left -= caps[s]
            del open_[s]
    return out


def slopes(shares: dict[str, float], repeats: dict[str, int]) -> dict[str, float]:
    """Relative slopes of the schedules: scarce, much repeated sources rise towards the end.

    Weighted by the shares the slopes sum to 0, so that the weights sum to 1 at every time.
    """
    mean = sum(shares[s] * repeats[s] for s in shares)
    raw = {s: repeats[s] - mean for s in shares}
    most = max((abs(x) for x in raw.values()), default=0.0)
    return {s: STEEPEST * x / most if most else 0.0 for s, x in raw.items()}


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """``doc_id, copy_no, source, n_tokens, position`` in training order."""
    counted = checkpoint(token_counts(documents, *(tokenizer or (None, None))).where("n_tokens > 0"))  # three numbers a document, read twice
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    wanted = {r.source: (float(r.share), int(r.cap)) for r in targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")).where("source is not null and target_share is not null").toLocalIterator()}
    listed = counted.where(F.col("source").isin(sorted(wanted))).withColumn("bucket", bucket)
    sums = listed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    available = {r.source: int(r.n) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one figure for each listed source
    demand = demands(available, wanted, total)
    spark = documents.sparkSession
    whole = sum(demand.values()) or 1.0
    slope = slopes({s: d / whole for s, d in demand.items()}, {s: wanted[s][1] for s in demand})
    plan = spark.createDataFrame([(s, float(d), float(available[s]), wanted[s][1], slope[s]) for s, d in demand.items()] or [("", 0.0, 1.0, 0, 0.0)], "source string, demand double, available double, cap int, slope double")
    before = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("earlier"))
    within = Window.partitionBy("source", "bucket").orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id")
    placed = (
        listed.withColumn("inner", F.sum("n_tokens").over(within) - F.col("n_tokens"))
        .join(F.broadcast(before), ["source", "bucket"])
        .join(F.broadcast(plan), "source")
        .withColumn("begin", F.col("earlier") + F.col("inner"))
    )
    # copy k of a document begins at k * available + begin; it belongs in if its middle lies before the demand
    copies = F.least(F.col("cap"), F.floor((F.col("demand") - F.col("begin") - F.col("n_tokens") / 2) / F.col("available")).cast("int") + 1)
    at = (F.col("copy_no") * F.col("available") + F.col("begin")) / F.col("demand")
    a = F.col("slope")
    # W(t) = t + a (t^2 - t) = c, hence t
    t = F.when(F.abs(a) < 1e-9, at).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * F.least(at, F.lit(1.0)))) / (2 * a))
    rows = placed.withColumn("copies", copies).where("copies > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy_no")).withColumn("position", t)
    return rows.select("doc_id", F.col("copy_no").cast("int").alias("copy_no"), "source", "n_tokens", F.round("position", 9).alias("position"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixture range-partitioned and sorted by position."""
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "source", "doc_id", "copy_no")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of every source, its documents, tokens and most copies of one document."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), (F.max("copy_no") + 1).cast("int").alias("most_copies"))
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
    return (
        goal.join(used, "source", "left")
        .withColumn("whole", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # one row for each listed source
        .select(
            "source",
            "target_share",
            F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            "max_repeats",
        )
    )
