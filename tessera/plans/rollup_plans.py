"""Queries of counts, scores and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import expressions as X
from tessera.operators import rollup
from tessera.plans.nested_plans import SQL as NESTED
from tessera.plans.scan_plans import _EXTERNAL, _IMPORTS
from tessera.sources.tables import table

ISSUES = "(SELECT DISTINCT issue_id, rule_id, severity, message, line, repo, file_path, lang, auto_fix, scanned_at FROM issues)"
NOW = "2024-02-01 00:00:00"


def _issues(spark, folder):
    return table(spark, folder, "issues").select("issue_id", "rule_id", "severity", "message", "line", "repo", "file_path", "lang", "auto_fix", "scanned_at").distinct()


def issue_rollup(spark, folder):
    """Issues by severity, rule and repository."""
    return rollup.issue_rollup(_issues(spark, folder))


def issues_by_severity(spark, folder):
    """Issues by rule, with one column for each severity."""
    return _issues(spark, folder).groupBy("rule_id").agg(*(rollup.count_if(F.col("severity") == s).alias(s) for s in rollup.SEVERITIES), rollup.count_if(F.col("severity").isNull()).alias("unset"))


def issues_by_file(spark, folder):
    """Issues, rules and lines by file."""
    return _issues(spark, folder).groupBy("file_path").agg(F.count("*").alias("issues"), F.count_distinct("rule_id").alias("rules"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def hot_files(spark, folder):
    """The 20 files with most issues."""
    return rollup.top(issues_by_file(spark, folder).select("file_path", "issues"), 20, F.col("issues").desc(), F.col("file_path"))


def score_correction(spark, folder):
    """A full score by file less 12, 8, 4 or 2 for each issue by severity, at most 70 % of it."""
    d = F.sum(F.when(F.col("severity") == "error", 8).when(F.col("severity") == "info", 2).otherwise(4))
    s = _issues(spark, folder).groupBy("file_path").agg(d.alias("deduction"))
    return s.select("file_path", "deduction", X.corrected_score(F.lit(100), F.col("deduction")).alias("score"))


def dimension_scores(spark, folder):
    """Mean corrected score by language."""
    d = F.sum(F.when(F.col("severity") == "error", 8).when(F.col("severity") == "info", 2).otherwise(4))
    s = _issues(spark, folder).groupBy("lang", "file_path").agg(d.alias("deduction")).select("lang", X.corrected_score(F.lit(100), F.col("deduction")).alias("score"))
    return s.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(X.half_up(F.avg("score")).alias("score"), F.count("*").alias("files"))


def auto_fix_share(spark, folder):
    """Share of issues that can be fixed automatically, by rule."""
    return _issues(spark, folder).groupBy("rule_id").agg(F.count("*").alias("issues"), X.ratio(rollup.count_if(F.col("auto_fix")), F.count("*")).alias("share"))


def language_detection(spark, folder):
    """Languages by repository."""
    f = table(spark, folder, "files").select("file_id", "repo", "lang").distinct()
    return f.groupBy("repo").agg(F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"), F.count("*").alias("files"))


def project_types(spark, folder):
    """Type of each repository by its files: the first marker that holds."""
    f = table(spark, folder, "files").select("repo", "file_path").distinct()
    has = lambda p: F.max(F.col("file_path").rlike(p).cast("int")) == 1
    g = f.groupBy("repo").agg(F.when(has(r"\.dart\z"), "flutter").when(has(r"\.vue\z"), "vue").when(has(r"\.[jt]sx\z"), "react").when(has(r"\.py\z"), "python").otherwise("unknown").alias("type"), F.count("*").alias("files"))
    return g


def architecture_layers(spark, folder):
    """Paths by layer named in them."""
    p = table(spark, folder, "files").select("file_path").distinct()
    layers = ("pages", "modules", "lib", "packages", "app", "src")
    names = F.filter(F.array(*(F.when(F.col("file_path").contains(f"/{n}/"), F.lit(n)) for n in layers)), lambda x: x.isNotNull())
    return p.select(F.explode(names).alias("layer")).groupBy("layer").agg(F.count("*").alias("paths"))


def segment_weights(spark, folder):
    """Weighted size of each repository: size by type and folder, in KB."""
    f = table(spark, folder, "files").select("file_id", "repo", "file_path", F.coalesce("size_bytes", F.lit(5000)).alias("size")).dropDuplicates(["file_id"])
    ext = F.lower(F.regexp_extract("file_path", r"(\.[A-Za-z0-9]+)\z", 1))
    kind = F.when(ext == ".dart", 1.5).when(ext.isin(".jsx", ".tsx"), 1.4).when(ext == ".vue", 1.3).when(ext == ".ts", 1.1).when(ext == ".py", 1.2).otherwise(1.0)
    folder_ = F.lower(F.element_at(F.split("file_path", "/"), -2))
    place = F.when(folder_.contains("controller"), 1.3).when(folder_.contains("service") | folder_.contains("provider"), 1.2).when(folder_.contains("model"), 1.1).when(folder_.contains("view"), 1.0).when(folder_.contains("component"), 1.1).when(folder_.contains("utils"), 0.9).when(folder_.contains("common"), 0.8).otherwise(1.0)
    return f.groupBy("repo").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("size"), F.round(F.sum(F.col("size") * kind * place) / 1024, 4).alias("weight"), rollup.count_if(F.col("size") > 10240).alias("large"))


def segment_counts(spark, folder):
    """Segments of at most 20 parts that each brand needs."""
    return table(spark, folder, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.ceil(F.count("*") / 20).cast("long").alias("segments"))


def segment_chunks(spark, folder):
    """Parts in segments of at most 20 by brand and type."""
    return rollup.chunks(table(spark, folder, "part").select("p_partkey", "p_brand", F.concat_ws("|", "p_brand", "p_type").alias("segment_of")), "segment_of", ["p_partkey"], F.lit(20)).select("p_partkey", "segment")


def dependency_health(spark, folder):
    """Health of each supplier's assortment: extra types of large parts, risky and middling parts."""
    ps = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).distinct()
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("part"), "p_type", "p_size")
    g = ps.join(p, "part").groupBy("supplier").agg(F.count_distinct(F.when(F.col("p_size") > 45, F.col("p_type"))).alias("extra"), rollup.count_if(F.col("p_size") > 48).alias("high"), rollup.count_if(F.col("p_size").between(47, 48)).alias("medium"))
    score, level = rollup.health(F.greatest(F.col("extra") - 1, F.lit(0)) * 5 + F.col("high") * 10 + F.col("medium") * 2)
    return g.select("supplier", "extra", "high", "medium", score.alias("score"), level.alias("level"))


def package_risks(spark, folder):
    """Risk of imported packages."""
    from tessera.operators import extract, scan

    i = extract.imports(scan.stored_files(table(spark, folder, "files")))
    return i.where(X.is_external(F.col("source"))).select("source", X.package_risk(F.col("source"), F.lit("other")).alias("risk")).groupBy("risk").agg(F.count_distinct("source").alias("packages"), F.count("*").alias("imports"))


def endpoint_categories(spark, folder):
    """Saved endpoints by category; categories overlap."""
    e = table(spark, folder, "provider_config").select("config_id", "api_endpoint").where("api_endpoint is not null").distinct()
    tests = {"versioned": r"/v\d+", "api": "/api/", "query": r"\?", "https": "^https:", "account": "//[^/]*@"}
    return e.agg(F.count("*").alias("endpoints"), *(rollup.count_if(F.col("api_endpoint").rlike(p)).alias(n) for n, p in tests.items()))


def https_coverage(spark, folder):
    """Share of https among absolute addresses, by provider."""
    e = table(spark, folder, "provider_config").select("config_id", "provider", "api_endpoint").where("api_endpoint is not null").distinct()
    absolute = F.col("api_endpoint").rlike("^https?://")
    return e.groupBy("provider").agg(rollup.count_if(absolute).alias("absolute"), X.ratio(rollup.count_if(F.col("api_endpoint").startswith("https:")), rollup.count_if(absolute), 2).alias("rate"))


def naming_conventions(spark, folder):
    """Styles of file stems by language, overlapping."""
    stem = F.regexp_extract("file_path", r"([^/.]+)[^/]*\z", 1)
    f = table(spark, folder, "files").select("file_id", "lang", stem.alias("stem")).distinct().where("lang is not null")
    return f.groupBy("lang").agg(rollup.count_if(F.col("stem").contains("_")).alias("snake"), rollup.count_if(F.col("stem").contains("-")).alias("kebab"), rollup.count_if(F.col("stem").rlike("[a-z][A-Z]")).alias("camel"), rollup.count_if(F.col("stem").rlike(r"^[a-z0-9]+\z")).alias("plain"))


def api_health(spark, folder):
    """Configurations with key and address by provider: good, warning or error by coverage."""
    c = table(spark, folder, "provider_config").select("config_id", "provider", F.length(F.trim(F.coalesce("api_key", F.lit("")))).alias("k"), F.length(F.coalesce("api_endpoint", F.lit(""))).alias("e")).distinct()
    cov = X.ratio(rollup.count_if((F.col("k") > 0) & (F.col("e") > 0)), F.count("*"))
    return c.groupBy("provider").agg(F.count("*").alias("configs"), cov.alias("coverage")).withColumn("state", F.when(F.col("coverage") >= 0.8, "good").when(F.col("coverage") >= 0.5, "warning").otherwise("error"))


def restful_level(spark, folder):
    """Score of a year's orders as if they were an interface: kinds, proper ones, codes."""
    o = table(spark, folder, "orders")
    g = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_orderpriority").alias("methods"), F.count_distinct("o_orderstatus").alias("codes"), F.avg((F.col("o_totalprice") > 100000).cast("double")).alias("proper"))
    return g.select("year", (F.least(F.col("methods") * 10, F.lit(40)) + X.half_up(F.col("proper") * 30) + F.least(F.col("codes") * 3, F.lit(20))).cast("long").alias("level"))


def usage_stats(spark, folder):
    """Events, users and values by type."""
    return table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


def tool_usage(spark, folder):
    """Steps of saved plans by type of action."""
    from tessera.operators import nested

    a = nested.plan_tables(table(spark, folder, "test_plans"))["actions"]
    return a.groupBy(F.coalesce("type", F.lit("text")).alias("type")).agg(F.count("*").alias("steps"))


def episode_stats(spark, folder):
    """One row: users as episodes, their steps and duration."""
    e = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("steps"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    return e.agg(F.count("*").alias("episodes"), F.round(F.avg("steps"), 6).alias("steps"), F.coalesce(F.round(F.avg(F.when(F.col("seconds") > 0, F.col("seconds"))), 6), F.lit(0.0)).alias("seconds"))


def plan_progress(spark, folder):
    """Progress of all orders."""
    s = table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("pending").alias("status"))
    return rollup.progress(s)


def error_summary(spark, folder):
    """Issues by level and rule, with those worth a second try."""
    return _issues(spark, folder).groupBy(F.coalesce("severity", F.lit("error")).alias("level"), F.col("rule_id").alias("code")).agg(F.count("*").alias("total"), rollup.count_if(F.col("auto_fix")).alias("retryable"))


def error_classes(spark, folder):
    """Messages by class: the first class that fits."""
    classes = (("syntax", ("syntax", "parser")), ("null", ("null",)), ("length", ("long", "deep")), ("import", ("import",)), ("async", ("async",)))
    return _issues(spark, folder).groupBy(rollup.classified(F.col("message"), classes).alias("class")).agg(F.count("*").alias("issues"))


def cache_age_buckets(spark, folder):
    """Events by age at a fixed time."""
    return rollup.age_buckets(table(spark, folder, "events"), "ts", NOW)


def pass_rate_trend(spark, folder):
    """Share of purchases by day."""
    e = table(spark, folder, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("total"), rollup.count_if(F.col("event_type") == "purchase").alias("passed"))
    return e.select("day", "total", "passed", rollup.pass_rate(F.col("passed"), F.col("total")).alias("rate"))


def test_report_rates(spark, folder):
    """Passed, failed and skipped cases in the test reports, by language."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(*(F.sum(F.regexp_count("text", F.lit(rf"\| {w} \|")).cast("long")).alias(w.lower()) for w in ("PASS", "FAIL", "SKIP")))


def daily_report(spark, folder):
    """Events by day and type."""
    return table(spark, folder, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def histogram_compare(spark, folder):
    """Difference of the quantities of returned and other lines, by bin of 5."""
    li = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity")
    return rollup.compare_histograms(rollup.histogram(li.where("l_returnflag = 'R'"), "l_quantity", 5.0), rollup.histogram(li.where("l_returnflag = 'N'"), "l_quantity", 5.0))


def rule_effectiveness(spark, folder):
    """Effectiveness of each rule over the repositories, and the priority learnt from it."""
    h = _issues(spark, folder).groupBy("rule_id", "repo").agg(F.count("*").alias("triggers"), F.avg((F.coalesce("severity", F.lit("")) == "info").cast("double")).alias("false_rate"))
    e = h.groupBy("rule_id").agg(F.round(F.avg((F.least(F.col("triggers") / 10, F.lit(1.0)) + (1 - F.col("false_rate"))) / 2), 6).alias("effectiveness"))
    return e.withColumn("priority", F.when(F.col("effectiveness") < 0.3, "low").when(F.col("effectiveness") > 0.7, "high").otherwise("medium"))


def component_usage(spark, folder):
    """Parts by use: the ten most used brands, with the share of their parts that is used at all."""
    used = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"))
    p = table(spark, folder, "part").select("p_partkey", "p_brand").join(used, "p_partkey", "left").na.fill(0, ["uses"])
    g = p.groupBy("p_brand").agg(F.sum("uses").alias("uses"), X.ratio(rollup.count_if(F.col("uses") > 0), F.count("*")).alias("rate"))
    return rollup.top(g, 10, F.col("uses").desc(), F.col("p_brand"))


def bdd_modules(spark, folder):
    """Modules of the saved plans: scenarios, highest priority, estimated time at half a minute a step."""
    from tessera.operators import nested

    t = nested.plan_tables(table(spark, folder, "test_plans"))
    steps = t["steps"].groupBy("plan_id", F.element_at(F.split("parent", r"\."), 1).alias("module_no")).agg(F.count("*").alias("steps"))
    scenarios = t["scenarios"].groupBy("plan_id", F.col("parent").alias("module_no")).agg(F.count("*").alias("scenarios"))
    rank = F.when(F.lower("priority").isin("critical", "p0"), 0).when(F.lower("priority").isin("high", "p1"), 1).when(F.lower("priority").isin("medium", "p2"), 2).otherwise(3)
    m = t["modules"].select("plan_id", F.col("label").alias("module_no"), "module", rank.alias("rank"))
    j = m.join(scenarios, ["plan_id", "module_no"], "left").join(steps, ["plan_id", "module_no"], "left").na.fill(0, ["scenarios", "steps"])
    return j.groupBy("module").agg(F.count("*").alias("plans"), F.sum("scenarios").alias("scenarios"), F.min("rank").alias("rank"), F.round(F.sum("steps") * 0.5, 2).alias("time"))


def knowledge_stats(spark, folder):
    """Documents by source with their length."""
    d = table(spark, folder, "documents")
    return d.groupBy(F.lower(F.regexp_replace(F.coalesce("source", F.lit("none")), "-", "_")).alias("source")).agg(F.count("*").alias("documents"), F.round(F.avg(F.coalesce("n_chars", F.lit(0))), 6).alias("mean_chars"))


QUERIES = {
    f.__name__: f
    for f in (issue_rollup, issues_by_severity, issues_by_file, hot_files, score_correction, dimension_scores, auto_fix_share, language_detection, project_types, architecture_layers, segment_weights, segment_counts, segment_chunks, dependency_health, package_risks, endpoint_categories, https_coverage, naming_conventions, api_health, restful_level, usage_stats, tool_usage, episode_stats, plan_progress, error_summary, error_classes, cache_age_buckets, pass_rate_trend, test_report_rates, daily_report, histogram_compare, rule_effectiveness, component_usage, bdd_modules, knowledge_stats)
}
_SCORE = "greatest(0, floor(100 - least(deduction, 70) + 0.5))::BIGINT"
_DEDUCTION = "sum(CASE severity WHEN 'error' THEN 8 WHEN 'info' THEN 2 ELSE 4 END)::BIGINT AS deduction"
_CONFIG = "(SELECT DISTINCT config_id, provider, api_key, api_endpoint FROM provider_config)"
SQL = {
    "issue_rollup": f"SELECT 'severity' AS grouping, coalesce(severity, 'medium') AS value, count(*) AS issues FROM {ISSUES} GROUP BY 2 UNION ALL SELECT 'rule', rule_id, count(*) FROM {ISSUES} GROUP BY 2 UNION ALL SELECT 'prefix', split_part(file_path, '/', 1), count(*) FROM {ISSUES} GROUP BY 2",
    "issues_by_severity": f"SELECT rule_id, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity IS NULL) AS unset FROM {ISSUES} GROUP BY rule_id",
    "issues_by_file": f"SELECT file_path, count(*) AS issues, count(DISTINCT rule_id) AS rules, min(line) AS first_line, max(line) AS last_line FROM {ISSUES} GROUP BY file_path",
    "hot_files": f"SELECT file_path, count(*) AS issues FROM {ISSUES} GROUP BY file_path ORDER BY issues DESC, file_path LIMIT 20",
    "score_correction": f"SELECT *, {_SCORE} AS score FROM (SELECT file_path, {_DEDUCTION} FROM {ISSUES} GROUP BY 1)",
    "dimension_scores": f"SELECT coalesce(lang, '') AS lang, floor(avg({_SCORE}) + 0.5)::BIGINT AS score, count(*) AS files FROM (SELECT lang, file_path, {_DEDUCTION} FROM {ISSUES} GROUP BY 1, 2) GROUP BY 1",
    "auto_fix_share": f"SELECT rule_id, count(*) AS issues, round(count(*) FILTER (auto_fix) / count(*)::DOUBLE, 6) AS share FROM {ISSUES} GROUP BY 1",
    "language_detection": "SELECT repo, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS languages, count(*) AS files FROM (SELECT DISTINCT file_id, repo, lang FROM files) GROUP BY repo",
    "project_types": "SELECT repo, CASE WHEN bool_or(suffix(file_path, '.dart')) THEN 'flutter' WHEN bool_or(suffix(file_path, '.vue')) THEN 'vue' WHEN bool_or(regexp_matches(file_path, '\\.[jt]sx$')) THEN 'react' WHEN bool_or(suffix(file_path, '.py')) THEN 'python' ELSE 'unknown' END AS type, count(*) AS files FROM (SELECT DISTINCT repo, file_path FROM files) GROUP BY repo",
    "architecture_layers": "SELECT layer, count(*) AS paths FROM (SELECT DISTINCT file_path FROM files), (SELECT unnest(['pages','modules','lib','packages','app','src']) AS layer) WHERE contains(file_path, '/' || layer || '/') GROUP BY layer",
    "segment_weights": """WITH f AS (SELECT DISTINCT file_id, repo, file_path, coalesce(size_bytes, 5000) AS size FROM files), w AS (SELECT *, lower(regexp_extract(file_path, '(\\.[A-Za-z0-9]+)$', 1)) AS ext, lower(string_split(file_path, '/')[-2]) AS d FROM f)
        SELECT repo, count(*) AS files, sum(size)::BIGINT AS size, round(sum(size * CASE WHEN ext = '.dart' THEN 1.5::DOUBLE WHEN ext IN ('.jsx', '.tsx') THEN 1.4 WHEN ext = '.vue' THEN 1.3 WHEN ext = '.ts' THEN 1.1 WHEN ext = '.py' THEN 1.2 ELSE 1.0 END
            * CASE WHEN contains(d, 'controller') THEN 1.3::DOUBLE WHEN contains(d, 'service') OR contains(d, 'provider') THEN 1.2 WHEN contains(d, 'model') THEN 1.1 WHEN contains(d, 'view') THEN 1.0 WHEN contains(d, 'component') THEN 1.1 WHEN contains(d, 'utils') THEN 0.9 WHEN contains(d, 'common') THEN 0.8 ELSE 1.0 END) / 1024, 4) AS weight,
            count(*) FILTER (size > 10240) AS large FROM w GROUP BY repo""",
    "segment_counts": "SELECT p_brand, count(*) AS parts, ceil(count(*) / 20.0)::BIGINT AS segments FROM part GROUP BY 1",
    "segment_chunks": "SELECT p_partkey, ((row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1) // 20)::INT AS segment FROM part",
    "dependency_health": """WITH g AS (SELECT l_suppkey AS supplier, count(DISTINCT CASE WHEN p_size > 45 THEN p_type END) AS extra, count(*) FILTER (p_size > 48) AS high, count(*) FILTER (p_size BETWEEN 47 AND 48) AS medium FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1),
        s AS (SELECT *, 100 - (greatest(extra - 1, 0) * 5 + high * 10 + medium * 2) AS raw FROM g) SELECT supplier, extra, high, medium, greatest(0, raw) AS score, CASE WHEN raw >= 80 THEN 'excellent' WHEN raw >= 60 THEN 'good' WHEN raw >= 40 THEN 'fair' ELSE 'poor' END AS level FROM s""",
    "endpoint_categories": f"SELECT count(*) AS endpoints, count(*) FILTER (regexp_matches(api_endpoint, '/v\\d+')) AS versioned, count(*) FILTER (contains(api_endpoint, '/api/')) AS api, count(*) FILTER (contains(api_endpoint, '?')) AS query, count(*) FILTER (starts_with(api_endpoint, 'https:')) AS https, count(*) FILTER (regexp_matches(api_endpoint, '//[^/]*@')) AS account FROM (SELECT DISTINCT config_id, api_endpoint FROM {_CONFIG}) WHERE api_endpoint IS NOT NULL",
    "https_coverage": f"SELECT provider, count(*) FILTER (regexp_matches(api_endpoint, '^https?://')) AS absolute, coalesce(round(count(*) FILTER (starts_with(api_endpoint, 'https:')) / nullif(count(*) FILTER (regexp_matches(api_endpoint, '^https?://')), 0)::DOUBLE, 2), 0) AS rate FROM (SELECT DISTINCT config_id, provider, api_endpoint FROM {_CONFIG}) WHERE api_endpoint IS NOT NULL GROUP BY provider",
    "naming_conventions": "SELECT lang, count(*) FILTER (contains(stem, '_')) AS snake, count(*) FILTER (contains(stem, '-')) AS kebab, count(*) FILTER (regexp_matches(stem, '[a-z][A-Z]')) AS camel, count(*) FILTER (regexp_matches(stem, '^[a-z0-9]+$')) AS plain FROM (SELECT DISTINCT file_id, lang, regexp_extract(file_path, '([^/.]+)[^/]*$', 1) AS stem FROM files WHERE lang IS NOT NULL) GROUP BY lang",
    "api_health": f"""WITH c AS (SELECT provider, count(*) AS configs, round(count(*) FILTER (k > 0 AND e > 0) / count(*)::DOUBLE, 6) AS coverage FROM (SELECT DISTINCT config_id, provider, length(trim(coalesce(api_key, ''), ' ')) AS k, length(coalesce(api_endpoint, '')) AS e FROM {_CONFIG}) GROUP BY provider)
        SELECT *, CASE WHEN coverage >= 0.8 THEN 'good' WHEN coverage >= 0.5 THEN 'warning' ELSE 'error' END AS state FROM c""",
    "restful_level": "SELECT year(o_orderdate)::INT AS year, (least(count(DISTINCT o_orderpriority) * 10, 40) + floor(avg((o_totalprice > 100000)::INT) * 30 + 0.5) + least(count(DISTINCT o_orderstatus) * 3, 20))::BIGINT AS level FROM orders GROUP BY 1",
    "usage_stats": "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1",
    "episode_stats": "SELECT count(*) AS episodes, round(avg(steps), 6) AS steps, coalesce(round(avg(CASE WHEN seconds > 0 THEN seconds END), 6), 0) AS seconds FROM (SELECT user_id, count(*) AS steps, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) AS seconds FROM events GROUP BY 1)",
    "plan_progress": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, 0::BIGINT AS failed, count(*) FILTER (o_orderstatus = 'P') AS in_progress, count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS pending, floor(count(*) FILTER (o_orderstatus = 'F') * 100 / count(*)::DOUBLE + 0.5)::BIGINT AS percentage FROM orders",
    "error_summary": f"SELECT coalesce(severity, 'error') AS level, rule_id AS code, count(*) AS total, count(*) FILTER (auto_fix) AS retryable FROM {ISSUES} GROUP BY 1, 2",
    "error_classes": f"SELECT CASE WHEN regexp_matches(lower(message), 'syntax|parser') THEN 'syntax' WHEN contains(lower(message), 'null') THEN 'null' WHEN regexp_matches(lower(message), 'long|deep') THEN 'length' WHEN contains(lower(message), 'import') THEN 'import' WHEN contains(lower(message), 'async') THEN 'async' ELSE 'unknown' END AS class, count(*) AS issues FROM {ISSUES} GROUP BY 1",
    "cache_age_buckets": f"SELECT CASE WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) < 3600 THEN 'hour' WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(ts)) < 86400 THEN 'day' ELSE 'older' END AS bucket, count(*) AS n FROM events GROUP BY 1",
    "pass_rate_trend": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS passed, round(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY 1",
    "test_report_rates": "SELECT coalesce(lang, '') AS lang, " + ", ".join(f"sum(len(regexp_extract_all(text, '\\| {w} \\|')))::BIGINT AS {w.lower()}" for w in ("PASS", "FAIL", "SKIP")) + " FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "daily_report": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "histogram_compare": "WITH h AS (SELECT l_returnflag AS f, floor(l_quantity / 5)::INT AS bin, count(*) AS n FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY 1, 2) SELECT coalesce(a.bin, b.bin) AS bin, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS difference FROM (SELECT * FROM h WHERE f = 'R') a FULL JOIN (SELECT * FROM h WHERE f = 'N') b ON a.bin = b.bin",
    "rule_effectiveness": f"WITH h AS (SELECT rule_id, repo, count(*) AS triggers, avg((coalesce(severity, '') = 'info')::INT) AS false_rate FROM {ISSUES} GROUP BY 1, 2), e AS (SELECT rule_id, round(avg((least(triggers / 10.0, 1.0)::DOUBLE + (1 - false_rate)) / 2), 6) AS effectiveness FROM h GROUP BY 1) SELECT *, CASE WHEN effectiveness < 0.3 THEN 'low' WHEN effectiveness > 0.7 THEN 'high' ELSE 'medium' END AS priority FROM e",
    "component_usage": "WITH u AS (SELECT l_partkey, count(*) AS uses FROM lineitem GROUP BY 1) SELECT p_brand, sum(coalesce(uses, 0))::BIGINT AS uses, round(count(uses) / count(*)::DOUBLE, 6) AS rate FROM part LEFT JOIN u ON p_partkey = l_partkey GROUP BY 1 ORDER BY uses DESC, p_brand LIMIT 10",
    "knowledge_stats": "SELECT lower(replace(coalesce(source, 'none'), '-', '_')) AS source, count(*) AS documents, round(avg(coalesce(n_chars, 0)), 6) AS mean_chars FROM documents GROUP BY 1",
}

SQL["package_risks"] = f"""SELECT CASE WHEN regexp_matches(source, 'request|material-ui|redux-thunk|mobx-react') THEN 'high' WHEN source IN ('react','react-dom','vue','angular','flutter') OR regexp_matches(source, '^@(react|react-dom|vue|angular|flutter)') THEN 'low' ELSE 'medium' END AS risk,
    count(DISTINCT source) AS packages, count(*) AS imports FROM {_IMPORTS} WHERE {_EXTERNAL} GROUP BY 1"""
SQL["tool_usage"] = f"SELECT coalesce(type, 'text') AS type, count(*) AS steps FROM ({NESTED['p4_actions']}) GROUP BY 1"
SQL["bdd_modules"] = f"""WITH m AS (SELECT plan_id, label, module, CASE WHEN lower(priority) IN ('critical','p0') THEN 0 WHEN lower(priority) IN ('high','p1') THEN 1 WHEN lower(priority) IN ('medium','p2') THEN 2 ELSE 3 END AS rank FROM ({NESTED['p4_modules']})),
    s AS (SELECT plan_id, parent AS label, count(*) AS scenarios FROM ({NESTED['p4_scenarios']}) GROUP BY ALL),
    t AS (SELECT plan_id, string_split(parent, '.')[1] AS label, count(*) AS steps FROM ({NESTED['p4_steps']}) GROUP BY ALL)
    SELECT module, count(*) AS plans, sum(coalesce(scenarios, 0))::BIGINT AS scenarios, min(rank) AS rank, round(sum(coalesce(steps, 0)) * 0.5::DOUBLE, 2) AS time FROM m LEFT JOIN s USING (plan_id, label) LEFT JOIN t USING (plan_id, label) GROUP BY 1"""
