"""Session helpers: defaults for stand-alone use, sizing of Python stages, checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(cpus: int | None = None, memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus or '*'}]").appName("tessera").config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle)}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def parallelism(spark: SparkSession) -> int:
    """Tasks that a CPU-bound stage should have at least."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-bound Python stage enough tasks.

    A scan of few small files has fewer splits than the cluster has cores; then the rows are
    dealt out anew. A large scan already has more splits than that and is left as it is, so
    that no text is shuffled.
    """
    wanted = parallelism(df.sparkSession)
    if df.rdd.getNumPartitions() >= wanted // 2:
        return df
    return df.repartition(wanted, *keys) if keys else df.repartition(wanted)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder of the session.

    The folder named in ``spark.checkpoint.dir`` is shared by all executors, so the result
    outlives any of them. Only a local session may name none (tests on one machine): then a
    temporary folder is set. Files of checkpoints that nothing refers to any more are cleaned up
    where ``spark.cleaner.referenceTracking.cleanCheckpoints`` says so, as in ``build``.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, shared by all executors, for states and written tables."""
    return f"{_shared(spark)}/{uuid.uuid4().hex}"
