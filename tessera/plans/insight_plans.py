"""Queries that judge code and settings as a whole: classes, widgets, interfaces, requirements, recommendations, saved results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import dart, extract, rollup, scan
from tessera.plans import rollup_plans, source_plans
from tessera.plans.nested_plans import QUERIES as NESTED_QUERIES
from tessera.plans.nested_plans import SQL as NESTED
from tessera.plans.scan_plans import _BODIES, _CLASSES, FILES, LINES
from tessera.session import scratch
from tessera.sources import documents, sinks
from tessera.sources.tables import table

ENDPOINTS = "(SELECT DISTINCT project, provider, trim(api_endpoint) AS url FROM provider_config WHERE trim(api_endpoint) <> '')"


def _files(spark, folder):
    return scan.stored_files(table(spark, folder, "files"))


def _endpoints(spark, folder):
    return table(spark, folder, "provider_config").select("project", "provider", F.trim("api_endpoint").alias("url")).where("url <> ''").distinct()


def common_endpoints(spark, folder):
    """Interfaces by what they are for; one may count in several columns."""
    u = F.lower("url")
    any_of = lambda *parts: rollup.count_if(u.rlike("|".join(parts)))
    return _endpoints(spark, folder).groupBy("provider").agg(any_of("/login", "/auth", "/token").alias("authentication"), any_of("/user").alias("users"), F.count("*").alias("calls"), any_of("/search", "/query").alias("search"), any_of("[?&](page|limit|offset|pagesize)=").alias("pagination"))


def endpoints_with_file(spark, folder):
    """Hosts that code calls or settings name, with the first file, which may be null."""
    host = r"https?://([A-Za-z0-9.-]+)"
    code = _files(spark, folder).where(F.col("content").contains("://")).select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(host), F.lit(1)))).alias("host"), "file_path")
    named = _endpoints(spark, folder).select(F.regexp_extract("url", host, 1).alias("host"), F.lit(None).cast("string").alias("file_path")).where("host <> ''")
    return code.unionByName(named).groupBy("host").agg(F.count("file_path").alias("files"), F.sum(F.col("file_path").isNull().cast("long")).alias("settings"), F.min("file_path").alias("first_file"))


def module_endpoints(spark, folder):
    """Interfaces by each part of a project's name."""
    e = _endpoints(spark, folder).select(F.explode(F.array_distinct(F.split(F.lower("project"), "[-_/ ]"))).alias("module"), "url").where("module <> ''")
    return e.groupBy("module").agg(F.count_distinct("url").alias("endpoints"), F.min("url").alias("first"))


# What a requirement may tell of, the points for each and the most of them.
CONFIDENCE = (("button|dialog|panel|drawer|form|table|list", 10, 30), ("[a-z]+[A-Z][A-Za-z0-9]*", 8, 25), ("press|click|wait|save|enter|select|open", 8, 25), ("page", 5, 10), ("must|should|expected|required", 3, 10))


def requirement_confidence(spark, folder):
    """How much each text tells of elements, fields, steps, pages and checks, in per cent."""
    parts = [F.least(F.regexp_count("text", F.lit(f"({p})")) * points, F.lit(most)) for p, points, most in CONFIDENCE]
    total = sum(parts[1:], parts[0])
    return table(spark, folder, "documents").where(F.length("text") > 0).select("doc_id", total.cast("int").alias("confidence"))


def scenario_time(spark, folder):
    """Minutes of each scenario: half a minute for an action."""
    return NESTED_QUERIES["p4_found"](spark, folder).groupBy("plan_id", "module_no", "scenario_no").agg((F.count("*") * 0.5).alias("minutes"))


def inferred_rules(spark, folder):
    """The five rules whose texts hold most words of each document (a report of the first five)."""
    known = table(spark, folder, "rules").select("rule_id", F.lower(F.concat_ws(" ", "rule_name", "message", "suggestion")).alias("text")).orderBy("rule_id").collect()  # a table of fixed size
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)))
    d = table(spark, folder, "documents").where(F.length("text") > 0).select("doc_id", words.alias("words")).where(F.size("words") > 0)
    held = lambda text: F.size(F.filter("words", lambda w: F.lit(text).contains(w)))
    none = F.array().cast("array<struct<s:int,rule_id:string>>")
    scores = F.concat(none, F.array(*(F.struct((-held(r.text)).alias("s"), F.lit(r.rule_id).alias("rule_id")) for r in known))) if known else none
    best = F.slice(F.array_sort(F.filter(scores, lambda x: x["s"] < 0)), 1, 5)
    return d.select("doc_id", F.explode(best).alias("b")).select("doc_id", "b.rule_id", (-F.col("b.s")).alias("score"))


def recommended_rules(spark, folder):
    """Rules for each repository: those of its languages, then the general ones, each once."""
    f = table(spark, folder, "files").select("repo", F.col("lang").alias("tag")).where("repo is not null and lang is not null").distinct()
    tags = f.unionByName(f.select("repo", F.lit("all").alias("tag")).distinct())
    r = table(spark, folder, "rules").where("coalesce(enabled, true)").select("rule_id", F.explode("languages").alias("tag"))
    return tags.join(r, "tag").groupBy("repo", "rule_id").agg(F.min(F.when(F.col("tag") == "all", 1).otherwise(0)).alias("general"))


def component_classes(spark, folder):
    """Superclasses with the last class of that name, if the project declares one."""
    k = extract.classes(_files(spark, folder))
    last = k.groupBy(F.col("name").alias("super_class")).agg(F.max(F.struct("file_id", "line_no")).alias("last"))
    children = k.where("super_class is not null").groupBy("super_class").agg(F.count("*").alias("children"))
    return children.join(last, "super_class", "left").select("super_class", "children", F.col("last.file_id").alias("file_id"), F.col("last.line_no").alias("line_no"))


def cache_keys(spark, folder):
    """Key under which the parse of a file is kept: path, length, time of change."""
    f = table(spark, folder, "files").select("file_id", "file_path", F.length("content").alias("n"), "modified_at").distinct()
    return f.select("file_id", F.concat_ws(":", "file_path", F.coalesce("n", F.lit(0)).cast("string"), F.unix_seconds(F.col("modified_at").cast("timestamp")).cast("string")).alias("cache_key"))


def qa_report(spark, folder):
    """Issues, score and grade of each repository."""
    i = rollup_plans._issues(spark, folder)
    is_ = lambda s: rollup.count_if(F.col("severity") == s)
    g = i.groupBy("repo").agg(F.count("*").alias("issues"), is_("error").alias("errors"), is_("warning").alias("warnings"), is_("info").alias("infos"), F.count_distinct("file_path").alias("files"))
    lost = F.try_divide((F.col("errors") * 8 + F.col("warnings") * 4 + F.col("infos") * 2).cast("double"), F.col("files").cast("double"))
    score = F.round(F.greatest(F.lit(0.0), 100 - F.coalesce(lost, F.lit(0.0))), 4)
    return g.withColumn("score", score).withColumn("grade", F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("poor"))


def graph_metadata(spark, folder):
    """Files, repositories and languages of the project."""
    f = table(spark, folder, "files").select("file_id", "repo", "lang").distinct()
    return f.agg(F.count("*").alias("files"), F.count_distinct("repo").alias("repos"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"))


def class_metrics(spark, folder):
    """Lines of each class, and whether it can be written out or holds asynchronous work."""
    c = extract.class_bodies(_files(spark, folder))
    return c.select("file_id", "name", "start", (F.length("body") - F.length(F.replace("body", F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.col("body").rlike("toJson|fromJson").alias("serialised"), F.col("body").contains("async").alias("is_async"))


#: Words of class names for the role of a class.
ROLES = (("model", "model|entity|dto"), ("state", "store|state|bloc|provider"), ("service", "service|manager|handler"), ("repository", "repository|source"), ("view", "panel|view|page|widget|screen"))


def _roles(spark, folder):
    role = F.when(F.lit(False), "")
    for label, words in ROLES:
        role = role.when(F.lower("name").rlike(words), label)
    return class_metrics(spark, folder).withColumn("role", role.otherwise("other"))


def role_stats(spark, folder):
    """Classes by role: number, mean lines, classes that can be written out, asynchronous ones."""
    return _roles(spark, folder).groupBy("role").agg(F.count("*").alias("classes"), F.round(F.avg("lines"), 4).alias("mean_lines"), F.max("lines").alias("max_lines"), rollup.count_if(F.col("serialised")).alias("serialised"), rollup.count_if(F.col("is_async")).alias("asynchronous"))


def role_health(spark, folder):
    """Health of the classes of a role: 100 less 10 for each large class and 15 if none is asynchronous."""
    c = _roles(spark, folder).where("role <> 'other'").groupBy("role").agg(rollup.count_if(F.col("lines") > 15).alias("large"), rollup.count_if(F.col("is_async")).alias("asynchronous"))
    s = F.greatest(F.lit(0), 100 - F.col("large") * 10 - F.when(F.col("asynchronous") == 0, 15).otherwise(0))
    return c.select("role", "large", s.cast("long").alias("score"), F.when(s >= 80, "healthy").when(s >= 60, "warning").otherwise("unhealthy").alias("health"))


def uncached_writers(spark, folder):
    """Functions that write or send something in files that never speak of a cache."""
    kept = _files(spark, folder).where(F.col("content").isNotNull()).select("file_id", F.lower("content").contains("cache").alias("cached")).where("cached").select("file_id")
    b = extract.function_bodies(_files(spark, folder)).where(F.lower("name").rlike("^(save|create|update|delete|submit|publish|store|attach)")).select("file_id", "name")
    return b.join(kept, "file_id", "left_anti").groupBy("file_id").agg(F.count("*").alias("writers"), F.min("name").alias("first"))


WIDGET = r"^( *)(?:return |[a-z][A-Za-z]*: )?([A-Z][A-Za-z]+)\("


def _widgets(spark, folder):
    lines = scan.lines(_files(spark, folder).where("lang = 'dart'"))
    return lines.where(F.col("line").rlike(WIDGET)).select("file_id", F.regexp_extract("line", WIDGET, 2).alias("widget"), F.floor(F.length(F.regexp_extract("line", WIDGET, 1)) / 2).cast("int").alias("depth"))


def widget_complexity(spark, folder):
    """Score of the widgets of each file: a tenth of ten for each level and two for each widget."""
    w = _widgets(spark, folder).groupBy("file_id").agg(F.max("depth").alias("depth"), F.count("*").alias("widgets"))
    return w.select("file_id", "depth", "widgets", F.floor((F.col("depth") * 10 + F.col("widgets") * 2) / 10.0 + 0.5).cast("long").alias("score"))


def widget_stats(spark, folder):
    """Widgets by type, with their depths."""
    return _widgets(spark, folder).groupBy("widget").agg(F.count("*").alias("places"), F.max("depth").alias("max_depth"), F.round(F.avg("depth"), 4).alias("mean_depth"))


def reuse_scores(spark, folder):
    """Score of each class by its uses: ten a use, five for each other file, ten for each file after the first."""
    f = _files(spark, folder)
    declared = extract.classes(f).groupBy("name").agg(F.min("file_id").alias("own"))
    used = f.where(F.col("content").isNotNull()).select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"([A-Z][A-Za-z0-9_]*)\("), F.lit(1))).alias("name")).groupBy("file_id", "name").agg(F.count("*").alias("n"))
    u = used.join(declared, "name").groupBy("name").agg(F.sum("n").alias("uses"), F.sum((F.col("file_id") != F.col("own")).cast("long")).alias("others"), F.count("*").alias("files"))
    return u.select("name", "uses", (F.col("uses") * 10 + F.col("others") * 5 + (F.col("files") - 1) * 10).alias("score"))


def business_summary(spark, folder):
    """Functions, asynchronous and exported ones, and mean lines, by language."""
    b = extract.function_bodies(_files(spark, folder))
    return b.groupBy("lang").agg(F.count("*").alias("functions"), rollup.count_if(F.col("is_async")).alias("asynchronous"), rollup.count_if(F.col("exported")).alias("exported"), F.round(F.avg(F.col("end") - F.col("start") + 1), 4).alias("mean_lines"))


def visual_report(spark, folder):
    """Images compared, those that are alike, and the rate, which is null if none was compared."""
    s = source_plans.image_ssim(spark, folder)
    alike = rollup.count_if(F.col("ssim") >= 0)
    return s.agg(F.count("*").alias("compared"), alike.alias("passed"), F.round(F.try_divide(alike.cast("double"), F.count("*").cast("double")), 6).alias("rate"))


def message_scores(spark, folder):
    """How alike the message of an issue and of its rule are, by rule."""
    i = table(spark, folder, "issues").select("rule_id", F.col("message").alias("said")).where("said is not null").distinct()
    r = table(spark, folder, "rules").select("rule_id", "message").where("message is not null")
    return i.join(r, "rule_id").groupBy("rule_id").agg(F.count("*").alias("texts"), F.round(F.max(X.match_score(F.col("said"), F.col("message"))), 4).alias("best"))


def saved_graph(spark, folder):
    """The graph of files, functions and classes, saved and loaded again: nodes and edges by type."""
    n = extract.nodes(_files(spark, folder))
    path = f"{scratch(spark)}/graph"
    sinks.save_graph(n, extract.contains_edges(n), path)
    nodes, edges = documents.load_graph(spark, path)
    return nodes.groupBy(F.concat(F.lit("node "), "type").alias("what")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.concat(F.lit("edge "), "type").alias("what")).agg(F.count("*").alias("n")))


def change_log(spark, folder):
    """Issues appended to a log by day, and read back: entries by day."""
    path = f"{scratch(spark)}/log"
    sinks.append_changelog(rollup_plans._issues(spark, folder).where("scanned_at is not null").select("issue_id", "rule_id", "scanned_at"), path, "scanned_at")
    return spark.read.schema("issue_id long, rule_id string, date string").json(path).groupBy("date").agg(F.count("*").alias("entries"), F.count_distinct("rule_id").alias("rules"))


def _detector(run, doc):
    def query(spark, folder):
        return run(_files(spark, folder))

    query.__doc__ = doc
    return query


QUERIES = {
    f.__name__: f
    for f in (common_endpoints, endpoints_with_file, module_endpoints, requirement_confidence, scenario_time, inferred_rules, recommended_rules, component_classes, cache_keys, qa_report, graph_metadata, class_metrics, role_stats, role_health, uncached_writers, widget_complexity, widget_stats, reuse_scores, business_summary, visual_report, message_scores, saved_graph, change_log)
} | {
    "missing_dispose": _detector(dart.missing_dispose, "Controllers that no dispose method disposes."),
    "missing_return": _detector(dart.missing_return, "Build methods that return nothing."),
    "nullable_lists": _detector(dart.nullable_lists, "First or last of lists whose elements may be null."),
    "property_chains": _detector(dart.property_chains, "Long accesses without a guard."),
    "late_variables": _detector(dart.late_variables, "Late variables used before they are set."),
}

_CLASS_BODIES = f"""(WITH l AS (SELECT * FROM {LINES} WHERE lang IN ('javascript','typescript','jsx','tsx','vue','dart','python')), n AS (SELECT file_id, lang, name, line_no AS start, coalesce(lead(line_no) OVER (PARTITION BY file_id ORDER BY line_no), 2000000000) AS next FROM {_CLASSES}),
    j AS (SELECT n.*, l.line_no, l.line, len(line) - len(replace(line, '{{', '')) AS o, len(line) - len(replace(line, '}}', '')) AS c FROM n JOIN l ON l.file_id = n.file_id AND l.line_no >= start AND l.line_no < next),
    b AS (SELECT *, sum(o - c) OVER w AS depth, max(o) OVER w AS opened FROM j WINDOW w AS (PARTITION BY file_id, start ORDER BY line_no)),
    e AS (SELECT *, min(CASE WHEN depth <= 0 AND opened > 0 AND lang <> 'python' THEN line_no END) OVER (PARTITION BY file_id, start) AS stop FROM b)
    SELECT file_id, lang, name, start, count(*) AS lines, string_agg(line, chr(10) ORDER BY line_no) AS body FROM e WHERE stop IS NULL OR line_no <= stop GROUP BY ALL)"""
_METRICS = f"(SELECT file_id, name, start, lines, regexp_matches(body, 'toJson|fromJson') AS serialised, contains(body, 'async') AS is_async FROM {_CLASS_BODIES})"
_ROLED = f"(SELECT *, CASE WHEN regexp_matches(lower(name), 'model|entity|dto') THEN 'model' WHEN regexp_matches(lower(name), 'store|state|bloc|provider') THEN 'state' WHEN regexp_matches(lower(name), 'service|manager|handler') THEN 'service' WHEN regexp_matches(lower(name), 'repository|source') THEN 'repository' WHEN regexp_matches(lower(name), 'panel|view|page|widget|screen') THEN 'view' ELSE 'other' END AS role FROM {_METRICS})"
_WIDGETS = "(SELECT file_id, regexp_extract(line, '^( *)(?:return |[a-z][A-Za-z]*: )?([A-Z][A-Za-z]+)\\(', 2) AS widget, (length(regexp_extract(line, '^( *)', 1)) // 2)::INT AS depth FROM " + LINES + " WHERE lang = 'dart' AND regexp_matches(line, '^( *)(?:return |[a-z][A-Za-z]*: )?([A-Z][A-Za-z]+)\\('))"
_DISTINCT_ISSUES = rollup_plans.ISSUES
_NODES = f"""(SELECT DISTINCT 'file' AS type, file_path, 0 AS line_no, '' AS name FROM {FILES} UNION ALL SELECT DISTINCT 'function', file_path, line_no, name FROM {{functions}} UNION ALL SELECT DISTINCT 'class', file_path, line_no, name FROM {_CLASSES} UNION ALL SELECT DISTINCT 'import', file_path, 0, source FROM {{imports}})"""


def _nodes_sql() -> str:
    from tessera.plans.scan_plans import _FUNCTIONS, _IMPORTS

    return _NODES.format(functions=_FUNCTIONS, imports=_IMPORTS)


_MATCH = """CASE WHEN a = b THEN 1 WHEN (contains(a, b) OR contains(b, a)) AND a <> '' AND b <> '' THEN least(length(a), length(b)) / greatest(length(a), length(b))::DOUBLE
    ELSE len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(list_concat(string_split(a, ''), string_split(b, ''))))::DOUBLE END"""
SQL = {
    "common_endpoints": f"""SELECT provider, sum(regexp_matches(lower(url), '/login|/auth|/token')::INT)::BIGINT AS authentication, sum(contains(lower(url), '/user')::INT)::BIGINT AS users, count(*) AS calls, sum(regexp_matches(lower(url), '/search|/query')::INT)::BIGINT AS search,
        sum(regexp_matches(lower(url), '[?&](page|limit|offset|pagesize)=')::INT)::BIGINT AS pagination FROM {ENDPOINTS} GROUP BY 1""",
    "endpoints_with_file": f"""WITH c AS (SELECT DISTINCT file_path, unnest(regexp_extract_all(content, 'https?://([A-Za-z0-9.-]+)', 1)) AS host FROM {FILES}), n AS (SELECT regexp_extract(url, 'https?://([A-Za-z0-9.-]+)', 1) AS host FROM {ENDPOINTS})
        SELECT host, count(file_path) AS files, sum((file_path IS NULL)::INT)::BIGINT AS settings, min(file_path) AS first_file FROM (SELECT host, file_path FROM c UNION ALL SELECT host, NULL FROM n WHERE host <> '') GROUP BY 1""",
    "module_endpoints": f"SELECT module, count(DISTINCT url) AS endpoints, min(url) AS first FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(project), '[-_/ ]'))) AS module, url FROM {ENDPOINTS}) WHERE module <> '' GROUP BY 1",
    "requirement_confidence": "SELECT doc_id, (" + " + ".join(f"least(len(regexp_extract_all(text, '{p}')) * {n}, {most})" for p, n, most in CONFIDENCE) + ")::INT AS confidence FROM documents WHERE text <> ''",
    "inferred_rules": """WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM documents WHERE text <> ''), r AS (SELECT rule_id, lower(concat_ws(' ', rule_name, message, suggestion)) AS t FROM rules),
        s AS (SELECT doc_id, rule_id, count(*) AS score FROM d JOIN r ON contains(t, w) GROUP BY 1, 2) SELECT doc_id, rule_id, score::INT AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, rule_id) <= 5""",
    "recommended_rules": """WITH f AS (SELECT DISTINCT repo, lang AS tag FROM files WHERE repo IS NOT NULL AND lang IS NOT NULL), t AS (SELECT * FROM f UNION SELECT repo, 'all' FROM f), r AS (SELECT rule_id, unnest(languages) AS tag FROM rules WHERE coalesce(enabled, true))
        SELECT repo, rule_id, min((tag = 'all')::INT) AS general FROM t JOIN r USING (tag) GROUP BY 1, 2""",
    "component_classes": f"""WITH k AS (SELECT * FROM {_CLASSES}), l AS (SELECT name, file_id, line_no FROM k QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_id DESC, line_no DESC) = 1), c AS (SELECT super_class, count(*) AS children FROM k WHERE super_class <> '' GROUP BY 1)
        SELECT super_class, children, file_id, line_no FROM c LEFT JOIN l ON l.name = c.super_class""",
    "cache_keys": "SELECT DISTINCT file_id, concat_ws(':', file_path, coalesce(length(content), 0), floor(epoch(modified_at))::BIGINT) AS cache_key FROM files",
    "qa_report": f"""WITH g AS (SELECT repo, count(*) AS issues, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(DISTINCT file_path) AS files FROM {_DISTINCT_ISSUES} GROUP BY 1),
        s AS (SELECT *, round(greatest(0, 100 - (errors * 8 + warnings * 4 + infos * 2) / files::DOUBLE), 4) AS score FROM g) SELECT *, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS grade FROM s""",
    "graph_metadata": "SELECT count(*) AS files, count(DISTINCT repo) AS repos, (SELECT string_agg(lang, ',' ORDER BY lang) FROM (SELECT DISTINCT lang FROM files WHERE lang IS NOT NULL)) AS languages FROM (SELECT DISTINCT file_id, repo, lang FROM files)",
    "class_metrics": f"SELECT * FROM {_METRICS}",
    "role_stats": f"SELECT role, count(*) AS classes, round(avg(lines), 4) AS mean_lines, max(lines) AS max_lines, count(*) FILTER (serialised) AS serialised, count(*) FILTER (is_async) AS asynchronous FROM {_ROLED} GROUP BY 1",
    "role_health": f"""WITH c AS (SELECT role, count(*) FILTER (lines > 15) AS large, count(*) FILTER (is_async) AS a FROM {_ROLED} WHERE role <> 'other' GROUP BY 1), s AS (SELECT role, large, greatest(0, 100 - large * 10 - CASE WHEN a = 0 THEN 15 ELSE 0 END)::BIGINT AS score FROM c)
        SELECT *, CASE WHEN score >= 80 THEN 'healthy' WHEN score >= 60 THEN 'warning' ELSE 'unhealthy' END AS health FROM s""",
    "uncached_writers": f"SELECT file_id, count(*) AS writers, min(name) AS first FROM {_BODIES} WHERE regexp_matches(lower(name), '^(save|create|update|delete|submit|publish|store|attach)') AND file_id NOT IN (SELECT file_id FROM files WHERE contains(lower(content), 'cache')) GROUP BY 1",
    "widget_complexity": f"SELECT file_id, max(depth) AS depth, count(*) AS widgets, floor((max(depth) * 10 + count(*) * 2) / 10.0 + 0.5)::BIGINT AS score FROM {_WIDGETS} GROUP BY 1",
    "widget_stats": f"SELECT widget, count(*) AS places, max(depth) AS max_depth, round(avg(depth), 4) AS mean_depth FROM {_WIDGETS} GROUP BY 1",
    "reuse_scores": f"""WITH d AS (SELECT name, min(file_id) AS own FROM {_CLASSES} GROUP BY 1), u AS (SELECT file_id, name, count(*) AS n FROM (SELECT file_id, unnest(regexp_extract_all(content, '([A-Z][A-Za-z0-9_]*)\\(', 1)) AS name FROM {FILES}) GROUP BY 1, 2)
        SELECT name, sum(n)::BIGINT AS uses, (sum(n) * 10 + sum((file_id <> own)::INT) * 5 + (count(*) - 1) * 10)::BIGINT AS score FROM u JOIN d USING (name) GROUP BY 1""",
    "visual_report": f"SELECT count(*) AS compared, count(*) FILTER (ssim >= 0) AS passed, round(count(*) FILTER (ssim >= 0) / nullif(count(*), 0)::DOUBLE, 6) AS rate FROM ({source_plans.SQL['image_ssim']})",
    "message_scores": f"""WITH p AS (SELECT DISTINCT i.rule_id, i.message AS said, r.message FROM issues i JOIN rules r USING (rule_id) WHERE i.message IS NOT NULL AND r.message IS NOT NULL), q AS (SELECT rule_id, lower(trim(said)) AS a, lower(trim(message)) AS b FROM p)
        SELECT rule_id, count(*) AS texts, round(max(round({_MATCH}, 6)), 4) AS best FROM q GROUP BY 1""",
    "saved_graph": f"""WITH n AS MATERIALIZED (SELECT * FROM {_nodes_sql()}) SELECT 'node ' || type AS what, count(*) AS n FROM n GROUP BY 1 UNION ALL SELECT 'edge contains', count(*) FROM n JOIN (SELECT DISTINCT file_id, file_path FROM files) USING (file_path) WHERE type <> 'file'""",
    "change_log": f"SELECT strftime(scanned_at, '%Y-%m-%d') AS date, count(*) AS entries, count(DISTINCT rule_id) AS rules FROM {_DISTINCT_ISSUES} WHERE scanned_at IS NOT NULL GROUP BY 1",
}
SQL["business_summary"] = f"""SELECT lang, count(*) AS functions, count(*) FILTER (contains(string_split(body, chr(10))[1], 'async')) AS asynchronous, count(*) FILTER (starts_with(body, 'export')) AS exported, round(avg("end" - start + 1), 4) AS mean_lines FROM {_BODIES} GROUP BY 1"""
if "p4_found" in NESTED:
    SQL["scenario_time"] = f"SELECT plan_id, module_no, scenario_no, count(*) * 0.5::DOUBLE AS minutes FROM ({NESTED['p4_found']}) GROUP BY 1, 2, 3"
_CODE = f"(SELECT file_id, line_no, trim(string_split(line, '//')[1]) AS code FROM {LINES} WHERE lang = 'dart' AND NOT starts_with(trim(line), '//') AND NOT starts_with(trim(line), '*'))"
SQL["property_chains"] = f"SELECT file_id, line_no, chain FROM (SELECT file_id, line_no, unnest(regexp_extract_all(code, '\\w+(?:\\?\\.\\w+|\\.\\w+){{2,}}')) AS chain FROM {_CODE}) WHERE contains(replace(chain, '?.', ''), '.')"
