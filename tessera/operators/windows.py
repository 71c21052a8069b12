"""Row numbers and looks at the rows before, for groups of any size.

A window gathers each group in one task. Where the largest group has no more than *most* rows
that is the cheapest way, and Spark's own window is used. Where one key holds more, the rows are
dealt out by range of key and order, numbered within their ranges, and the numbers of the ranges
before are added; looks back are taken within chunks of the numbered group that carry the last
rows of the chunk before. Both ways give the same rows. The order must tell rows apart. Null
keys form one group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tessera.session import checkpoint, parallelism

#: Rows of a group that one task may sort.
MOST = 5_000_000


def largest(rows: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of all; two numbers, counted before the shuffle."""
    r = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.sum("n").alias("of")).first()
    return r.n or 0, r.of or 0


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "n", most: int = MOST) -> DataFrame:
    """*rows* with their number within their group, from 1."""
    size, of = largest(rows, keys)
    if size <= most:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    parts = max(parallelism(rows.sparkSession), 1 + 2 * of // most)
    ranged = checkpoint(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)).cast("long"))
    sizes = ranged.groupBy("_part", *keys).agg(F.count("*").alias("_of"))
    before = F.sum("_of").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(before, F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, (local[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys)), local["_part"] == offsets["_p"])
    return local.join(offsets, same).withColumn(name, F.col(name) + F.col("_before")).select(*rows.columns, name)


def over_previous(rows: DataFrame, keys: list[str], order: list[Column | str], reach: int, columns: dict[str, Callable[[WindowSpec], Column]], most: int = MOST) -> DataFrame:
    """*rows* with columns that look at no more than *reach* rows before their own in its group.

    Each function makes its column from a window that is ordered and partitioned already. To
    look at rows after, give the reverse order.
    """
    size, _ = largest(rows, keys)
    if size <= most:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.select("*", *(f(w).alias(n) for n, f in columns.items()))
    n = numbered(rows, keys, order, "_n", most)
    at = F.floor((F.col("_n") - 1) / most)
    last = (F.col("_n") - 1) % most >= most - reach
    copies = F.array(F.struct(at.alias("chunk"), F.lit(False).alias("lent")), F.struct((at + 1).alias("chunk"), F.lit(True).alias("lent")))
    dealt = n.withColumn("_c", F.explode(F.when(last, copies).otherwise(F.slice(copies, 1, 1))))
    w = Window.partitionBy(*keys, "_c.chunk").orderBy("_n")
    return dealt.select(*rows.columns, "_c", *(f(w).alias(n) for n, f in columns.items())).where("not _c.lent").drop("_c")
