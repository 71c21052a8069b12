"""Queries of filters, states, contracts, sessions and links between texts and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.functions import repair
from tessera.operators import extract, filters, scan, search
from tessera.operators.filters import Field
from tessera.operators.windows import over_previous
from tessera.plans.scan_plans import _CLASSES, _EXTERNAL, _FUNCTIONS, _IMPORTS, FILES
from tessera.plans.scan_plans import SQL as SCAN
from tessera.sources import documents as D
from tessera.sources.tables import table


def _files(spark, folder):
    return scan.stored_files(table(spark, folder, "files"))


def config_search(spark, folder):
    """Settings of one provider whose project matches a pattern."""
    c = filters.equal_to(table(spark, folder, "provider_config"), provider="custom")
    return filters.key_like(c, "project", "ADMIN|mobile").select("config_id", "project").distinct()


def translation_search(spark, folder):
    """Translations of some keys that speak of a word."""
    t = D.translations(table(spark, folder, "slices"))
    return filters.texts_like(t, ["panel.", ".locale"], "The").select("slice_id", "key", "value").distinct()


def runnable_orders(spark, folder):
    """Open orders of customers whose order before was filled, or who had none."""
    o = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    needs = over_previous(o, ["o_custkey"], ["id"], 1, {"need": lambda w: F.lag("id").over(w)}).select("id", "need")
    return filters.runnable(o.select("id", "status"), needs)


def class_patterns(spark, folder):
    """Classes whose names or methods speak of a design pattern, by pattern."""
    f = _files(spark, folder)
    methods = extract.functions(f).groupBy("file_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set(F.lower("name")))).alias("methods"))
    k = extract.classes(f).select("file_id", F.lower("name").alias("name")).join(methods, "file_id", "left").withColumn("methods", F.coalesce("methods", F.lit("")))
    m = F.col("methods")
    tests = {"singleton": m.contains("instance"), "factory": m.rlike("create|factory"), "observer": m.rlike("subscribe|notify|observe"), "strategy": F.col("name").contains("strategy"), "adapter": F.col("name").contains("adapter")}
    found = F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())
    return k.select(F.explode(found).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("classes"))


def sessions(spark, folder):
    """Sessions of users: pauses of six hours end them."""
    return filters.sessions(table(spark, folder, "events"), "6 hours")


def pauses(spark, folder):
    """Seconds to the next event of the user, summed by type."""
    p = filters.seconds_to_next(table(spark, folder, "events"), "user_id", "ts", "event_id", "event_type")
    return p.groupBy("event_type").agg(F.count("seconds").alias("pauses"), F.round(F.avg("seconds"), 2).alias("seconds"))


def test_outputs(spark, folder):
    """Passed, failed and skipped tests that documents report."""
    t = table(spark, folder, "documents").where("text is not null").select("doc_id", *X.test_counts(F.col("text")))
    return t.where("passed + failed + skipped > 0")


def step_counts(spark, folder):
    """Steps of each document read as a cell of steps."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.size(X.parse_steps(F.col("text"))).alias("steps"))


#: Categories of packages, first match counts.
CATEGORIES = [("framework", "^(?:react|vue|flutter|angular)"), ("state-management", "redux|mobx|pinia|provider"), ("routing", "router"), ("testing", "test|jest|mocha"), ("utils", "lodash|util|uuid"), ("date", "moment|dayjs|date-fns|luxon")]


def package_categories(spark, folder):
    """Imported packages by category."""
    i = extract.imports(_files(spark, folder)).where(X.is_external(F.col("source")))
    return i.groupBy(filters.first_category(F.col("source"), CATEGORIES).alias("category")).agg(F.count_distinct("source").alias("packages"), F.count("*").alias("imports"))


def duplicate_libraries(spark, folder):
    """Categories that a repository covers by more than one package."""
    f = _files(spark, folder)
    i = extract.imports(f).where(X.is_external(F.col("source"))).join(f.select("file_id", "repo"), "file_id")
    g = i.groupBy(F.coalesce("repo", F.lit("")).alias("repo"), filters.first_category(F.col("source"), CATEGORIES).alias("category")).agg(F.count_distinct("source").alias("packages"))
    return g.where("packages > 1")


def segment_dependencies(spark, folder):
    """Folders of sources that import from each other, the importer's first."""
    i = extract.imports(_files(spark, folder)).where("source like '.%' and lang <> 'python'")
    top = lambda p: F.array_join(F.slice(F.split(p, "/"), 1, 2), "/")
    s = i.select(top(F.col("file_path")).alias("segment"), top(X.resolve_path(F.col("file_path"), F.col("source"))).alias("needs"))
    return s.where("segment <> needs").groupBy("segment", "needs").agg(F.count("*").alias("imports"))


def document_files(spark, folder):
    """Files that documents name: by their path, else by their stem."""
    words = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_/.-]+)"), F.lit(1)))).alias("word"))
    f = _files(spark, folder).select("file_id", "file_path", F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\..*$", "").alias("stem"))
    by_path = words.join(f, words["word"] == f["file_path"]).select("doc_id", "file_id")
    by_stem = words.join(f, words["word"] == f["stem"]).where(F.length("stem") >= 6).select("doc_id", "file_id")
    return search.cascade(by_path, by_stem, key="doc_id").select("doc_id", "file_id", "stage").distinct()


def test_pages(spark, folder):
    """Share of sources of each language with a test of their name."""
    f = _files(spark, folder).select("file_id", "lang", F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\..*$", "").alias("stem"))
    tests = f.where(F.col("stem").rlike("_test$|_spec$")).select(F.regexp_replace("stem", "_(?:test|spec)$", "").alias("stem")).distinct().withColumn("tested", F.lit(1))
    pages = f.where(~F.col("stem").rlike("_test$|_spec$")).join(tests, "stem", "left")
    return pages.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("files"), F.count("tested").alias("tested"), X.ratio(F.count("tested"), F.count("*")).alias("rate"))


def learned_priority(spark, folder):
    """Priority of rules from the share of the busiest rule's triggers: below 0.3 low, above 0.7 high."""
    n = table(spark, folder, "issues").where("rule_id is not null").groupBy("rule_id").agg(F.count("*").alias("triggers"))
    most = n.agg(F.max("triggers")).first()[0] or 1  # one number
    share = F.round(F.col("triggers") / F.lit(most), 6)
    return n.select("rule_id", share.alias("share"), F.when(share < 0.3, "low").when(share > 0.7, "high").otherwise("medium").alias("priority"))


CONTRACT = [Field("project", required=True), Field("provider", required=True), Field("api_endpoint", required=True, test=lambda c: c.rlike("^https?://[^/]+")), Field("model_name", test=lambda c: F.length(c) >= 3), Field("config_id", required=True, cast="long")]


def contract_faults(spark, folder):
    """Saved settings that break their contract, with all faults."""
    return filters.violations(table(spark, folder, "provider_config"), "config_id", CONTRACT).distinct()


def repaired_records(spark, folder):
    """Saved plans that are no valid JSON, mended where possible."""
    return repair.with_repair(table(spark, folder, "test_plans"), "plan_id", "record_json").where("state <> 'valid'").distinct()


QUERIES = {
    f.__name__: f
    for f in (config_search, translation_search, runnable_orders, class_patterns, sessions, pauses, test_outputs, step_counts, package_categories, duplicate_libraries, segment_dependencies, document_files, test_pages, learned_priority, contract_faults, repaired_records)
}

_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(source, '{p}') THEN '{n}'" for n, p in CATEGORIES) + " ELSE 'other' END"
_PACKAGES = f"(SELECT * FROM {_IMPORTS} WHERE {_EXTERNAL})"
_STEM = r"regexp_replace(list_last(string_split(file_path, '/')), '\..*$', '')"
_TEST_WORD = lambda w: rf"coalesce(TRY_CAST(regexp_extract(text, '(\d+) {w}', 1) AS BIGINT), 0)"
_TOP = "array_to_string(string_split({0}, '/')[:2], '/')"

SQL = {
    "config_search": "SELECT DISTINCT config_id, project FROM provider_config WHERE provider = 'custom' AND regexp_matches(project, '(?i)ADMIN|mobile')",
    "translation_search": r"""
WITH p AS (SELECT slice_id, unnest(regexp_extract_all(content, '(''[A-Za-z0-9_.]+''\s*:\s*''[^''\n]*'')', 1)) AS p FROM slices),
t AS (SELECT slice_id, regexp_extract(p, '^''([^'']+)''', 1) AS key, regexp_extract(p, ':\s*''([^'']*)''$', 1) AS value FROM p)
SELECT DISTINCT slice_id, key, value FROM t WHERE (starts_with(key, 'panel.') OR suffix(key, 'panel.') OR starts_with(key, '.locale') OR suffix(key, '.locale')) AND (contains(lower(key), 'the') OR contains(lower(value), 'the'))""",
    "runnable_orders": """
WITH w AS (SELECT o_orderkey AS id, o_orderstatus AS s, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT id FROM w WHERE s <> 'F' AND coalesce(before, 'F') = 'F'""",
    "class_patterns": f"""
WITH m AS (SELECT file_id, string_agg(DISTINCT lower(name), ' ') AS m FROM {_FUNCTIONS} GROUP BY 1),
k AS (SELECT lower(name) AS n, coalesce(m, '') AS m FROM {_CLASSES} c LEFT JOIN m ON m.file_id = c.file_id),
p AS (SELECT unnest([CASE WHEN contains(m, 'instance') THEN 'singleton' END, CASE WHEN regexp_matches(m, 'create|factory') THEN 'factory' END, CASE WHEN regexp_matches(m, 'subscribe|notify|observe') THEN 'observer' END,
 CASE WHEN contains(n, 'strategy') THEN 'strategy' END, CASE WHEN contains(n, 'adapter') THEN 'adapter' END]) AS pattern FROM k)
SELECT pattern, count(*) AS classes FROM p WHERE pattern IS NOT NULL GROUP BY 1""",
    "sessions": """
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e)
SELECT user_id, min(ts) AS begin, max(ts) AS finish, count(*) AS events FROM s GROUP BY user_id, n""",
    "pauses": """
WITH p AS (SELECT event_type, (epoch_ms(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_ms(ts)) / 1000 AS seconds FROM events)
SELECT event_type, count(seconds) AS pauses, round(avg(seconds), 2) AS seconds FROM p GROUP BY 1""",
    "test_outputs": f"""
SELECT * FROM (SELECT doc_id, {_TEST_WORD("passed")} AS passed, {_TEST_WORD("failed")} AS failed, {_TEST_WORD("skipped")} AS skipped FROM documents WHERE text IS NOT NULL) WHERE passed + failed + skipped > 0""",
    "step_counts": """
SELECT doc_id, len(list_filter(CASE WHEN contains(text, chr(10) || chr(10)) THEN string_split(text, chr(10) || chr(10)) WHEN contains(text, chr(10)) THEN string_split(text, chr(10))
 WHEN contains(text, '|') THEN string_split(text, '|') WHEN contains(text, ';') THEN string_split(text, ';') ELSE [text] END, lambda x: length(trim(x, ' ')) > 0)) AS steps FROM documents WHERE text IS NOT NULL""",
    "package_categories": f"SELECT {_CATEGORY} AS category, count(DISTINCT source) AS packages, count(*) AS imports FROM {_PACKAGES} GROUP BY 1",
    "duplicate_libraries": f"SELECT coalesce(f.repo, '') AS repo, {_CATEGORY} AS category, count(DISTINCT source) AS packages FROM {_PACKAGES} i JOIN {FILES} f ON f.file_id = i.file_id GROUP BY 1, 2 HAVING packages > 1",
    "segment_dependencies": f"""
WITH r AS ({SCAN["resolved_paths"]}), i AS (SELECT file_id, file_path, source FROM {_IMPORTS} WHERE starts_with(source, '.') AND lang <> 'python'),
s AS (SELECT {_TOP.format("file_path")} AS segment, {_TOP.format("target")} AS needs FROM i JOIN r USING (file_id, source))
SELECT segment, needs, count(*) AS imports FROM s WHERE segment <> needs GROUP BY ALL""",
    "document_files": f"""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9_/.-]+)', 1)) AS word FROM documents),
f AS (SELECT file_id, file_path, {_STEM} AS stem FROM {FILES}),
a AS (SELECT DISTINCT doc_id, file_id, 0 AS stage FROM w JOIN f ON word = file_path), b AS (SELECT DISTINCT doc_id, file_id, 1 AS stage FROM w JOIN f ON word = stem AND length(stem) >= 6)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""",
    "test_pages": f"""
WITH f AS (SELECT file_id, lang, {_STEM} AS stem FROM {FILES}), t AS (SELECT DISTINCT regexp_replace(stem, '_(?:test|spec)$', '') AS stem FROM f WHERE regexp_matches(stem, '_test$|_spec$'))
SELECT coalesce(lang, '') AS lang, count(*) AS files, count(t.stem) AS tested, round(count(t.stem) / count(*), 6) AS rate FROM f LEFT JOIN t ON t.stem = f.stem WHERE NOT regexp_matches(f.stem, '_test$|_spec$') GROUP BY 1""",
    "learned_priority": """
WITH n AS (SELECT rule_id, count(*) AS triggers FROM issues WHERE rule_id IS NOT NULL GROUP BY 1), s AS (SELECT rule_id, round(triggers / max(triggers) OVER (), 6) AS share FROM n)
SELECT rule_id, share, CASE WHEN share < 0.3 THEN 'low' WHEN share > 0.7 THEN 'high' ELSE 'medium' END AS priority FROM s""",
    "contract_faults": """
WITH f AS (SELECT config_id, unnest([CASE WHEN project IS NULL THEN {'field': 'project', 'error': 'missing'} END, CASE WHEN provider IS NULL THEN {'field': 'provider', 'error': 'missing'} END,
 CASE WHEN api_endpoint IS NULL THEN {'field': 'api_endpoint', 'error': 'missing'} WHEN NOT regexp_matches(api_endpoint, '^https?://[^/]+') THEN {'field': 'api_endpoint', 'error': 'value'} END,
 CASE WHEN length(model_name) < 3 THEN {'field': 'model_name', 'error': 'value'} END, CASE WHEN config_id IS NULL THEN {'field': 'config_id', 'error': 'missing'} END]) AS f FROM provider_config)
SELECT DISTINCT config_id, f.field AS field, f.error AS error FROM f WHERE f IS NOT NULL""",
}
