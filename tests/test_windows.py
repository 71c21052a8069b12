import random

from pyspark.sql import functions as F

from tessera.operators import windows as W


def rows(spark):
    rng = random.Random(7)
    keys = [1] * 120 + [2] * 20 + [3] * 3 + [None] * 60
    data = [(k, i, rng.randrange(5), "clash", -1) for i, k in enumerate(keys)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k int, i long, v int, text string, n_ int").repartition(6)


def as_set(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def test_numbers_of_split_groups_equal_those_of_a_window(spark):
    r = rows(spark)
    order = [F.col("v").desc(), "i"]
    plain = W.numbered(r, ["k"], order)
    split = W.numbered(r, ["k"], order, most=7)
    assert split.columns == plain.columns
    assert as_set(split, "k", "i", "n") == as_set(plain, "k", "i", "n")


def test_looks_back_in_split_groups_equal_those_of_a_window(spark):
    r = rows(spark)
    columns = {"before": lambda w: F.lag("v", 2).over(w), "last": lambda w: F.collect_list("v").over(w.rowsBetween(-3, -1))}
    plain = W.over_previous(r, ["k"], ["i"], 3, columns)
    split = W.over_previous(r, ["k"], ["i"], 3, columns, most=7)
    assert split.columns == plain.columns
    assert as_set(split, "k", "i", "before", "last") == as_set(plain, "k", "i", "before", "last")


def test_empty(spark):
    r = rows(spark).limit(0)
    assert W.numbered(r, ["k"], ["i"]).count() == 0 and W.over_previous(r, ["k"], ["i"], 1, {"b": lambda w: F.lag("v").over(w)}).count() == 0
