"""Incremental scans and state that is learnt from streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def incremental_scan(spark: SparkSession, source: str, schema: str, scan: Callable[[DataFrame], DataFrame], state: str, checkpoint: str) -> None:
    """Scan what has arrived in *source* since the last call and bring the issues in *state* up to date.

    A file source stream hands over new parquet files once. Within a batch, files whose hash the
    state knows are skipped; issues of changed files replace the older ones, those of unchanged
    files stay. The state is written as snapshots, ``v=1``, ``v=2``, ..., so a failed batch is
    repeated from the last whole one.
    """

    def batch(files: DataFrame, number: int) -> None:
        latest = files.groupBy("file_path").agg(F.max_by("content", "modified_at").alias("content")).withColumn("digest", F.md5(F.coalesce("content", F.lit(""))))
        before = read_state(spark, state, number)
        if before is None:
            changed, kept = latest, None
        else:
            known = before.select("file_path", F.col("digest").alias("seen")).distinct()
            changed = latest.join(known, "file_path", "left").where("seen is null or seen <> digest").drop("seen")
            kept = before.join(changed.select("file_path"), "file_path", "left_anti")
        found = scan(changed)
        fresh = changed.select("file_path", "digest").join(found, "file_path", "left")
        out = fresh if kept is None else kept.unionByName(fresh)
        out.write.mode("overwrite").parquet(f"{state}/v={number + 1}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, state: str, upto: int | None = None) -> DataFrame | None:
    """The newest snapshot of the state, or the newest numbered at most *upto*; None if there is none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    numbers = [int(s.getPath().getName()[2:]) for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("v=")]
    numbers = [n for n in numbers if upto is None or n <= upto]
    return spark.read.parquet(f"{state}/v={max(numbers)}") if numbers else None


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Events by window and type; rows later than *late* are dropped once their window has been given out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def learnt_triggers(issues: DataFrame) -> DataFrame:
    """Running number of triggers by rule over a stream of issues: one row for each rule in a batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        count += sum(len(b) for b in batches)
        state.update((count,))
        yield pd.DataFrame({"rule_id": [key[0]], "triggers": [count]})

    return issues.groupBy("rule_id").applyInPandasWithState(update, "rule_id string, triggers long", "triggers long", "update", GroupStateTimeout.NoTimeout)
