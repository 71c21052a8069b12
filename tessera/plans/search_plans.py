"""Queries of relevance, similarity and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import search
from tessera.operators.windows import numbered
from tessera.plans.rollup_plans import ISSUES, _issues
from tessera.sources.tables import table

WORDS = ["snapshot", "retry", "schedule", "drawer", "cache"]


def similar_items(spark, folder):
    """For every twentieth item the five items most like it by shared tokens, above 0.3."""
    items = table(spark, folder, "eval_items").select(F.col("item_id").alias("id"), "text").distinct()
    queries = items.where("id % 20 = 0").select(F.col("id").alias("query"), "text")
    return search.similar(queries, items, 0.3, 5)


def keyword_topk(spark, folder):
    """The ten documents that contain most of five words."""
    return search.containing(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text").distinct(), WORDS)


def priority_rank(spark, folder):
    """Issues of each file by priority."""
    i = _issues(spark, folder)
    by_rule = i.groupBy(F.col("file_path").alias("_f"), F.col("rule_id").alias("_r")).agg(F.count("*").alias("_n"))
    by_file = by_rule.groupBy(F.col("_f").alias("_g")).agg(F.sum("_n").alias("in_file"))
    i = i.join(by_rule, i["file_path"].eqNullSafe(by_rule["_f"]) & i["rule_id"].eqNullSafe(by_rule["_r"])).withColumn("again", F.col("_n") > 1)
    i = i.join(by_file, i["file_path"].eqNullSafe(by_file["_g"]))
    i = i.withColumn("score", search.issue_score(F.coalesce("severity", F.lit("")), F.col("again"), F.col("in_file"), F.coalesce("rule_id", F.lit(""))))
    return numbered(i.select("issue_id", "file_path", "score"), ["file_path"], [F.col("score").desc(), "issue_id"], "rank")


def history_continuity(spark, folder):
    """Events whose type occurred among the user's three before."""
    return search.continuity(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "continuity")


def recent_events(spark, folder):
    """The five newest events of each user."""
    e = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return search.top_by(e, "user_id", 5, F.col("ts").desc(), F.col("event_id").desc()).select("user_id", "event_id", "rank")


def retention(spark, folder):
    """The 50 users worth keeping: ten for each event, less a point for each day since the last."""
    u = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.max("ts").alias("last"))
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.col("last").cast("date"))
    return u.select("user_id", "events", search.retention_score(F.col("events"), age).alias("score")).orderBy(F.col("score").desc(), "user_id").limit(50)


def choice_by_type(spark, folder):
    """The user with the largest total of each event type, the smaller id on ties."""
    e = table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.sum(F.col("value").cast("decimal(20,4)")).alias("total"))
    return e.groupBy("event_type").agg(F.max_by("user_id", F.struct("total", -F.col("user_id"))).alias("user_id"))


def leading_lines(spark, folder):
    """The dearer half of each order's lines, rounded up."""
    i = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    kept = search.leading_share(i.withColumn("minus", -F.col("l_extendedprice")), "l_orderkey", ["minus", "l_linenumber", "l_partkey"], 0.5)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 2).alias("price"))


def requirement_hits(spark, folder):
    """Rules whose words occur in the messages of issues, with the number of such words."""
    rules = table(spark, folder, "rules").select(F.col("rule_id").alias("requirement"), X.keywords(F.lower("rule_name")).alias("keywords"))
    texts = _issues(spark, folder).where("message is not null").select("message").distinct().select(F.col("message").alias("id"), X.keywords(F.lower("message")).alias("words"))
    return search.matching(rules, texts).select("requirement", F.col("id").alias("message"), "hits")


def data_quality(spark, folder):
    """Quality of the texts of documents by source."""
    d = table(spark, folder, "documents").select(F.coalesce("source", F.lit("")).alias("source"), search.data_quality(F.coalesce("text", F.lit(""))).alias("q"))
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.round(F.avg(F.round("q", 2)), 6).alias("quality"))


def item_keywords(spark, folder):
    """Keywords of the items."""
    i = table(spark, folder, "eval_items").select("item_id", F.explode(X.keywords(F.col("text"))).alias("keyword"))
    return i.groupBy("item_id").agg(F.count("*").alias("keywords"), F.min("keyword").alias("least"))


def question_kinds(spark, folder):
    """Kind, complexity and estimated tokens of each item's question."""
    low = F.lower("text")
    kind = F.when(low.rlike("option|versus|compare|比较"), "comparison").when(low.rlike("explain|why|为什么"), "explanation").when(low.rlike("how many|which|多少|哪"), "lookup").otherwise("other")
    size = F.when(F.length("text") > 300, "high").when(F.length("text") > 120, "medium").otherwise("low")
    return table(spark, folder, "eval_items").select("item_id", kind.alias("kind"), size.alias("complexity"), X.token_estimate(F.col("text")).alias("tokens"))


def snippets(spark, folder):
    """Places of a word in the documents with 20 characters around."""
    d = table(spark, folder, "documents").where(F.col("text").contains("snapshot"))
    return d.select("doc_id", X.snippet(F.col("text"), F.lit("snapshot")).alias("snippet"))


def relevance_factors(spark, folder):
    """Relevance of parts: keyword match, size, balance of price and availability in weighted factors."""
    p = table(spark, folder, "part")
    k = search.keyword_share(F.coalesce("p_name", F.lit("")), ["steel", "small"])
    return p.select("p_partkey", F.round(search.relevance(k, F.col("p_size") / 50.0, F.lit(0.2), F.lit(0.1)), 6).alias("relevance"))


def ordered_work(spark, folder):
    """Each customer's orders by priority, larger totals first within one."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    order = [F.substring("o_orderpriority", 1, 1), F.col("o_totalprice").desc(), "o_orderkey"]
    return numbered(o, ["o_custkey"], order, "rank").select("o_orderkey", "rank")


QUERIES = {
    f.__name__: f
    for f in (similar_items, keyword_topk, priority_rank, history_continuity, recent_events, retention, choice_by_type, leading_lines, requirement_hits, data_quality, item_keywords, question_kinds, snippets, relevance_factors, ordered_work)
}

_HITS = " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in WORDS)
_KEYWORDS = "list_distinct(list_concat(regexp_extract_all({0}, '[\\x{{4e00}}-\\x{{9fa5}}]{{2,}}'), regexp_extract_all({0}, '[A-Za-z]{{3,}}')))"

SQL = {
    "similar_items": r"""
WITH i AS (SELECT DISTINCT item_id AS id, text FROM eval_items WHERE text IS NOT NULL),
t AS (SELECT id, list_distinct(regexp_split_to_array(lower(text), '\s+')) AS t FROM i),
c AS (SELECT id, len(t) AS nc, unnest(t) AS token FROM t),
p AS (SELECT q.id AS query, c.id, q.nc AS nq, c.nc, count(*) AS n FROM c q JOIN c USING (token) WHERE q.id % 20 = 0 GROUP BY ALL),
s AS (SELECT query, id, round(n / (nq + nc - n), 6) AS similarity FROM p)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s WHERE similarity > 0.3 QUALIFY rank <= 5""",
    "keyword_topk": f"""
SELECT doc_id AS id, round(({_HITS}) / 5.0, 6) AS score FROM (SELECT DISTINCT doc_id, text FROM documents)
WHERE ({_HITS}) > 0 ORDER BY score DESC, id LIMIT 10""",
    "priority_rank": f"""
WITH i AS (SELECT *, count(*) OVER (PARTITION BY file_path) AS f, count(*) OVER (PARTITION BY file_path, rule_id) AS a FROM {ISSUES}),
s AS (SELECT issue_id, file_path, CASE WHEN severity = 'error' THEN 100 WHEN severity = 'info' THEN 20 ELSE 50 END
 + CASE WHEN a > 1 THEN 30 ELSE 0 END + CASE WHEN f > 3 THEN 20 ELSE 0 END + CASE WHEN contains(rule_id, 'SEC') THEN 50 ELSE 0 END AS score FROM i)
SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, issue_id) AS rank FROM s""",
    "history_continuity": """
SELECT event_id, CASE WHEN list_contains(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), event_type)
THEN 0.2 ELSE 0.0 END::DOUBLE AS continuity FROM events""",
    "recent_events": """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 5""",
    "retention": """
SELECT user_id, count(*) AS events, count(*) * 10 + greatest(0.0::DOUBLE, 100.0::DOUBLE - date_diff('day', max(ts)::DATE, DATE '2024-02-01')) AS score
FROM events GROUP BY 1 ORDER BY score DESC, user_id LIMIT 50""",
    "choice_by_type": """
WITH t AS (SELECT event_type, user_id, sum(value::DECIMAL(20,4)) AS total FROM events GROUP BY ALL)
SELECT event_type, user_id FROM t QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY total DESC, user_id) = 1""",
    "leading_lines": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)
SELECT l_orderkey, count(*) AS kept, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS price FROM r WHERE n <= ceil(c * 0.5) GROUP BY 1""",
    "requirement_hits": f"""
WITH r AS (SELECT rule_id AS requirement, unnest({_KEYWORDS.format("lower(rule_name)")}) AS word FROM rules),
m AS (SELECT message, unnest({_KEYWORDS.format("lower(message)")}) AS word FROM (SELECT DISTINCT message FROM issues WHERE message IS NOT NULL))
SELECT requirement, message, count(DISTINCT word) AS hits FROM m JOIN r USING (word) GROUP BY ALL""",
    "data_quality": r"""
WITH t AS (SELECT coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
q AS (SELECT source, round(least(0.3, CASE WHEN length(text) > 0 THEN 0.1 ELSE 0 END + CASE WHEN length(text) > 100 THEN 0.1 ELSE 0 END
 + CASE WHEN contains(text, chr(10)) THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(text, '(?m)^[-*] ') THEN 0.05 ELSE 0 END)::DOUBLE, 2) AS q FROM t)
SELECT source, count(*) AS documents, round(avg(q), 6) AS quality FROM q GROUP BY 1""",
    "item_keywords": f"""
WITH k AS (SELECT item_id, unnest({_KEYWORDS.format("text")}) AS keyword FROM eval_items)
SELECT item_id, count(*) AS keywords, min(keyword) AS least FROM k GROUP BY 1""",
    "question_kinds": r"""
SELECT item_id, CASE WHEN regexp_matches(lower(text), 'option|versus|compare|比较') THEN 'comparison' WHEN regexp_matches(lower(text), 'explain|why|为什么') THEN 'explanation'
 WHEN regexp_matches(lower(text), 'how many|which|多少|哪') THEN 'lookup' ELSE 'other' END AS kind,
CASE WHEN length(text) > 300 THEN 'high' WHEN length(text) > 120 THEN 'medium' ELSE 'low' END AS complexity,
ceil(len(regexp_extract_all(text, '[\x{4e00}-\x{9fa5}]')) * 1.5 + (length(text) - len(regexp_extract_all(text, '[\x{4e00}-\x{9fa5}]'))) / 4.0)::BIGINT AS tokens FROM eval_items""",
    "snippets": """
WITH p AS (SELECT doc_id, text, instr(text, 'snapshot') AS a FROM documents WHERE contains(text, 'snapshot')),
s AS (SELECT doc_id, text, greatest(a - 20, 1) AS b, least(a + 28, length(text) + 1) AS e FROM p)
SELECT doc_id, CASE WHEN b > 1 THEN '...' ELSE '' END || substring(text, b, e - b) || CASE WHEN e <= length(text) THEN '...' ELSE '' END AS snippet FROM s""",
    "relevance_factors": """
SELECT p_partkey, round(least(1.0::DOUBLE, (CAST(contains(lower(p_name), 'steel') AS INT) + CAST(contains(lower(p_name), 'small') AS INT)) / 2.0::DOUBLE * 0.8::DOUBLE
 + p_size / 50.0::DOUBLE * 1.2::DOUBLE + 0.2::DOUBLE * 0.3::DOUBLE + 0.1::DOUBLE * 0.4::DOUBLE), 6) AS relevance FROM part""",
    "ordered_work": """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority[1], o_totalprice DESC, o_orderkey) AS rank FROM orders""",
}
