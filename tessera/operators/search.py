"""Relevance, similarity and top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expressions import jaccard, tokens
from tessera.operators.windows import numbered, over_previous


def similar(queries: DataFrame, corpus: DataFrame, least: float, k: int) -> DataFrame:
    """For each query the *k* most similar texts by shared tokens, above *least*; ties by id.

    ``queries``: query, text. ``corpus``: id, text. Two sets that overlap by at least *least* share
    one of their rarest n - ceil(least * n) + 1 tokens, so only these are joined: the commonest
    tokens, which everything shares, bring nobody together. Candidates are then measured on
    their whole sets. Null texts are left out; an empty text is the set of one empty token.
    """
    texts = corpus.where("text is not null").select("id", tokens(F.col("text")).alias("all"))
    asked = queries.where("text is not null").select("query", tokens(F.col("text")).alias("all"))
    common = texts.select(F.explode("all").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def rarest(rows: DataFrame, key: str) -> DataFrame:
        exploded = rows.select(key, F.size("all").alias("of"), F.explode("all").alias("token")).join(common, "token", "left")
        w = Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "token")
        return exploded.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= F.col("of") - F.ceil(F.col("of") * least) + 1).select(key, "token")

    pairs = rarest(texts, "id").join(rarest(asked, "query"), "token").select("query", "id").distinct()
    both = pairs.join(asked.withColumnRenamed("all", "a"), "query").join(texts.withColumnRenamed("all", "b"), "id")
    scored = both.select("query", "id", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("similarity")).where(F.col("similarity") > least)
    return top_by(scored, "query", k, F.col("similarity").desc(), F.col("id"))


def top_by(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first *k* rows of each key, with their rank. Spark keeps k rows a group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def keyword_share(text: Column, words: list[str]) -> Column:
    """Share of the words that the text contains."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in words)) / float(len(words))


def containing(corpus: DataFrame, words: list[str], k: int = 10) -> DataFrame:
    """The texts that contain most of the words."""
    scored = corpus.select("id", F.round(keyword_share(F.col("text"), words), 6).alias("score")).where("score > 0")
    return scored.orderBy(F.col("score").desc(), "id").limit(k)


def issue_score(severity: Column, recurring: Column, in_file: Column, rule: Column) -> Column:
    """100, 50 or 20 by severity, 30 more for a recurring issue, 20 for a hot file, 50 for security."""
    base = F.when(severity == "error", 100).when(severity == "info", 20).otherwise(50)
    return base + F.when(recurring, 30).otherwise(0) + F.when(in_file > 3, 20).otherwise(0) + F.when(rule.contains("SEC"), 50).otherwise(0)


def relevance(keyword: Column, semantic: Column, quality: Column, history: Column) -> Column:
    """Weighted factors, at most 1."""
    return F.least(F.lit(1.0), keyword * 0.8 + semantic * 1.2 + quality * 0.3 + history * 0.4)


def data_quality(text: Column) -> Column:
    """0.1 for any text, 0.1 for more than 100 letters, 0.05 for lines and for lists; at most 0.3."""
    has = lambda c, w: F.when(c, w).otherwise(0.0)
    return F.least(F.lit(0.3), has(F.length(text) > 0, 0.1) + has(F.length(text) > 100, 0.1) + has(text.contains("\n"), 0.05) + has(text.rlike(r"(?m)^[-*] "), 0.05))


def continuity(rows: DataFrame, key: str, order: list[str], what: str, weight: float = 0.2) -> DataFrame:
    """*weight* for rows whose *what* occurs among the three before it of the same key."""
    before = lambda w: F.collect_list(what).over(w.rowsBetween(-3, -1))
    return over_previous(rows, [key], order, 3, {"continuity": lambda w: F.when(F.array_contains(before(w), F.col(what)), F.lit(weight)).otherwise(F.lit(0.0))})


def retention_score(accesses: Column, age_days: Column) -> Column:
    return accesses * 10 + F.greatest(F.lit(0.0), F.lit(100.0) - age_days)


def leading_share(rows: DataFrame, key: str, order: list[str], share: float) -> DataFrame:
    """The leading ceil(n * share) rows of each key."""
    n = numbered(rows, [key], order, "_n")
    sizes = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_of"))
    return n.join(sizes, n[key].eqNullSafe(sizes["_key"])).where(F.col("_n") <= F.ceil(F.col("_of") * share)).select(*rows.columns)


def matching(requirements: DataFrame, corpus: DataFrame) -> DataFrame:
    """Requirements and the texts that hold one of their keywords as a word, with the number of such keywords.

    Keywords are joined to words, not searched in every text for every requirement.
    ``requirements``: requirement, keywords. ``corpus``: id, words.
    """
    r = requirements.select("requirement", F.explode("keywords").alias("word"))
    c = corpus.select("id", F.explode("words").alias("word"))
    return c.join(r, "word").groupBy("requirement", "id").agg(F.count_distinct("word").alias("hits"))


def cascade(*stages: DataFrame, key: str = "query") -> DataFrame:
    """Rows of the first stage that has any for a key."""
    ranked = reduce(lambda a, b: a.unionByName(b), (s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)))
    first = ranked.groupBy(key).agg(F.min("stage").alias("stage"))
    return ranked.join(first, [key, "stage"])


def pair_similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts by their tokens."""
    return jaccard(tokens(a), tokens(b))
