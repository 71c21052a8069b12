"""Queries of differences, merges and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import diff
from tessera.plans.rollup_plans import ISSUES, _issues
from tessera.sources.tables import table

#: Where two snapshots of a table part.
SPLIT = "2025-07-01 00:00:00"
OPTIONS = ["javascript", "typescript", "dart", "python", "css"]


def _configs(spark, folder):
    c = table(spark, folder, "provider_config").select("config_id", "project", "provider", "model_name", "saved_at").distinct()
    return c.where("saved_at is not null").withColumn("key", F.concat_ws("/", F.coalesce("project", F.lit("")), F.coalesce("provider", F.lit(""))))


def _latest(rows):
    return rows.groupBy("key").agg(F.max_by(F.coalesce("model_name", F.lit("")), F.struct("saved_at", "config_id")).alias("model"))


def config_diff(spark, folder):
    """How the model set for a project's provider differs between the middle of 2025 and today."""
    c = _configs(spark, folder)
    return diff.snapshot_diff(_latest(c.where(F.col("saved_at") < SPLIT)), _latest(c), "key", "model")


def issue_states(spark, folder):
    """New, fixed and recurring issues between two spans of scans."""
    i = _issues(spark, folder).withColumn("fingerprint", X.fingerprint(F.col("rule_id"), F.col("file_path"), F.col("message")))
    return diff.compare_fingerprints(i.where(F.col("scanned_at") < SPLIT), i.where(F.col("scanned_at") >= SPLIT))


def issue_trend(spark, folder):
    """Trend of the number of issues by repository."""
    i = _issues(spark, folder).groupBy(F.coalesce("repo", F.lit("")).alias("repo"))
    g = i.agg(F.sum((F.coalesce(F.col("scanned_at") < SPLIT, F.lit(False))).cast("long")).alias("old"), F.sum(F.coalesce(F.col("scanned_at") >= SPLIT, F.lit(False)).cast("long")).alias("new"))
    return g.select("repo", "old", "new", X.trend(F.col("old"), F.col("new")).alias("trend"))


def account_union(spark, folder):
    """Accounts of customers and suppliers in one list, summed by nation."""
    c = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return diff.tagged_union(customer=c, supplier=s).groupBy("source", "nation").agg(F.count("*").alias("accounts"), F.round(F.sum(F.col("balance").cast("decimal(18,2)")).cast("double"), 2).alias("balance"))


def config_merge(spark, folder):
    """Settings of the middle of 2025, and later ones of projects' providers that had none."""
    c = _configs(spark, folder)
    return diff.merge_keep_old(_latest(c.where(F.col("saved_at") < SPLIT)), _latest(c.where(F.col("saved_at") >= SPLIT)), ["key"])


def rule_dedupe(spark, folder):
    """The first rule of each severity and pattern."""
    r = table(spark, folder, "rules").select(F.concat_ws("/", F.coalesce("severity", F.lit("")), F.coalesce("match_pattern", F.lit(""))).alias("key"), "rule_id", "ord")
    return diff.first_by(r, "key", "ord").select("key", "rule_id")


def evicted_files(spark, folder):
    """Paths with issues whose file is gone, with the number of issues."""
    gone = _issues(spark, folder).join(table(spark, folder, "files").select("file_path").distinct(), "file_path", "left_anti")
    return gone.groupBy("file_path").agg(F.count("*").alias("issues"))


def _slice_pairs(spark, folder):
    s = table(spark, folder, "slices").where("content is not null and repo is not null and file_path is not null and seq is not null")
    s = s.select("repo", "file_path", "seq", "slice_id", "content").groupBy("repo", "file_path", "seq").agg(F.min_by("content", "slice_id").alias("content"))
    lines = s.select(F.concat_ws("/", "repo", "file_path").alias("path"), "seq", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    old = lines.select(F.concat_ws("#", "path", F.col("seq") + 1).alias("pair"), "line_no", "line")
    new = lines.select(F.concat_ws("#", "path", "seq").alias("pair"), "line_no", "line")
    both = old.select("pair").distinct().join(new.select("pair").distinct(), "pair")
    return old.join(both, "pair", "left_semi"), new.join(both, "pair", "left_semi")


def slice_changes(spark, folder):
    """Lines by which a slice differs from the one before it at the same place, counted by kind."""
    d = diff.positional_diff(*_slice_pairs(spark, folder), "pair")
    return d.groupBy("pair").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(f"{k}_lines") for k in ("add", "delete", "modify")))


def slice_hunks(spark, folder):
    """Runs of changed lines between a slice and the one before it."""
    return diff.hunks(diff.positional_diff(*_slice_pairs(spark, folder), "pair"), "pair")


def files_to_scan(spark, folder):
    """Files delivered since the middle of 2025 that are new or changed against what was there."""
    f = table(spark, folder, "files").where("file_path is not null and content is not null").select("repo", "file_path", "content", "modified_at", "file_id")
    f = f.select(F.concat_ws("/", F.coalesce("repo", F.lit("")), "file_path").alias("file_path"), F.md5("content").alias("digest"), "modified_at", "file_id")
    last = lambda rows: rows.groupBy("file_path").agg(F.max_by(F.struct("digest", "modified_at"), F.struct("modified_at", "file_id")).alias("l")).select("file_path", "l.*")
    return diff.changed_since(last(f.where(F.col("modified_at") >= SPLIT)), last(f.where(F.col("modified_at") < SPLIT)))


def missing_languages(spark, folder):
    """Of five languages those that a repository has no file of."""
    g = table(spark, folder, "files").groupBy(F.coalesce("repo", F.lit("")).alias("repo")).agg(F.collect_set("lang").alias("have"))
    return g.select("repo", F.explode(diff.alternatives(F.col("have"), OPTIONS)).alias("lang"))


def message_lcs(spark, folder):
    """Length of the longest common subsequence of a rule's name and message."""
    return diff.with_lcs(table(spark, folder, "rules").select("rule_id", "rule_name", "message"), "rule_name", "message").select("rule_id", "lcs")


QUERIES = {
    f.__name__: f
    for f in (config_diff, issue_states, issue_trend, account_union, config_merge, rule_dedupe, evicted_files, slice_changes, slice_hunks, files_to_scan, missing_languages, message_lcs)
}

_CONFIGS = "(SELECT DISTINCT config_id, model_name, saved_at, coalesce(project, '') || '/' || coalesce(provider, '') AS key FROM provider_config WHERE saved_at IS NOT NULL)"
_LATEST = f"SELECT key, coalesce(model_name, '') AS model FROM {_CONFIGS} WHERE {{0}} QUALIFY row_number() OVER (PARTITION BY key ORDER BY saved_at DESC, config_id DESC) = 1"
_BEFORE = _LATEST.format(f"saved_at < TIMESTAMP '{SPLIT}'")
_AFTER = _LATEST.format(f"saved_at >= TIMESTAMP '{SPLIT}'")
_PRINTS = f"SELECT DISTINCT md5(coalesce(rule_id, '') || ':' || coalesce(file_path, '') || ':' || coalesce(message, '')) AS fingerprint FROM {ISSUES} WHERE scanned_at"
_FILES = "(SELECT coalesce(repo, '') || '/' || file_path AS file_path, md5(content) AS digest, modified_at, file_id FROM files WHERE file_path IS NOT NULL AND content IS NOT NULL)"
_LAST = f"SELECT * FROM {_FILES} WHERE modified_at {{0}} TIMESTAMP '{SPLIT}' QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY modified_at DESC, file_id DESC) = 1"

SQL = {
    "config_diff": f"""
WITH a AS ({_BEFORE}), b AS ({_LATEST.format("true")})
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'deleted' WHEN a.model = b.model THEN 'unchanged' ELSE 'modified' END AS status
FROM a FULL JOIN b ON a.key = b.key""",
    "issue_states": f"""
WITH a AS ({_PRINTS} < TIMESTAMP '{SPLIT}'), b AS ({_PRINTS} >= TIMESTAMP '{SPLIT}')
SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN a.fingerprint IS NULL THEN 'new' WHEN b.fingerprint IS NULL THEN 'fixed' ELSE 'recurring' END AS state
FROM a FULL JOIN b ON a.fingerprint = b.fingerprint""",
    "issue_trend": f"""
WITH c AS (SELECT coalesce(repo, '') AS repo, count(*) FILTER (scanned_at < TIMESTAMP '{SPLIT}') AS old, count(*) FILTER (scanned_at >= TIMESTAMP '{SPLIT}') AS new FROM {ISSUES} GROUP BY 1)
SELECT *, CASE WHEN new = 0 THEN 'excellent' WHEN new < old * 0.5 THEN 'improving' WHEN new < old THEN 'progressing' WHEN new = old THEN 'stable' ELSE 'regressing' END AS trend FROM c""",
    "account_union": """
WITH u AS (SELECT 'customer' AS source, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier)
SELECT source, nation, count(*) AS accounts, round(sum(balance::DECIMAL(18,2))::DOUBLE, 2) AS balance FROM u GROUP BY ALL""",
    "config_merge": f"""
WITH a AS ({_BEFORE}), b AS ({_AFTER}) SELECT key, model FROM a UNION ALL SELECT key, model FROM b WHERE key NOT IN (SELECT key FROM a)""",
    "rule_dedupe": """
SELECT coalesce(severity, '') || '/' || coalesce(match_pattern, '') AS key, rule_id FROM rules QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1""",
    "evicted_files": f"""
SELECT file_path, count(*) AS issues FROM {ISSUES} i WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.file_path = i.file_path) GROUP BY 1""",
    "slice_changes": r"""
WITH s AS (SELECT repo || '/' || file_path AS path, seq, content FROM slices WHERE content IS NOT NULL AND repo IS NOT NULL AND file_path IS NOT NULL AND seq IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY repo, file_path, seq ORDER BY slice_id) = 1),
l AS (SELECT path, seq, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM s),
p AS (SELECT path || '#' || seq AS pair, a.path, a.seq FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.path = a.path AND b.seq = a.seq - 1)),
a AS (SELECT pair, n, line FROM p JOIN l ON l.path = p.path AND l.seq = p.seq - 1), b AS (SELECT pair, n, line FROM p JOIN l ON l.path = p.path AND l.seq = p.seq),
d AS (SELECT coalesce(a.pair, b.pair) AS pair, CASE WHEN a.pair IS NULL THEN 'add' WHEN b.pair IS NULL THEN 'delete' WHEN a.line <> b.line THEN 'modify' END AS kind FROM a FULL JOIN b ON a.pair = b.pair AND a.n = b.n)
SELECT pair, count(*) FILTER (kind = 'add') AS add_lines, count(*) FILTER (kind = 'delete') AS delete_lines, count(*) FILTER (kind = 'modify') AS modify_lines FROM d WHERE kind IS NOT NULL GROUP BY 1""",
    "files_to_scan": f"""
WITH a AS ({_LAST.format("<")}), b AS ({_LAST.format(">=")})
SELECT b.file_path, CASE WHEN a.file_path IS NULL THEN 'new' ELSE 'changed' END AS reason FROM b LEFT JOIN a ON a.file_path = b.file_path WHERE a.file_path IS NULL OR (a.modified_at <> b.modified_at AND a.digest <> b.digest)""",
    "missing_languages": f"""
WITH r AS (SELECT DISTINCT coalesce(repo, '') AS repo FROM files), o AS (SELECT unnest({OPTIONS}) AS lang)
SELECT repo, lang FROM r, o WHERE NOT EXISTS (SELECT 1 FROM files f WHERE coalesce(f.repo, '') = r.repo AND f.lang = o.lang)""",
}
