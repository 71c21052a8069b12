"""Queries over graphs with any number of edges out of a vertex: imports that texts tell of, suppliers that follow each other."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expressions import calls
from tessera.operators import extract, graph, scan
from tessera.plans.scan_plans import _BODIES, _BUILT, _FUNCTIONS, _IMPORTS
from tessera.session import checkpoint
from tessera.sources.tables import table

#: "a imports b and is imported by it", as review notes tell of a circular import: an edge each way.
TOLD = r"(src/[A-Za-z0-9_/.]+) imports (src/[A-Za-z0-9_/.]+) and is imported by it"
MENTIONS = f"""(WITH t AS (SELECT unnest(regexp_extract_all(text, '{TOLD}')) AS m FROM documents), p AS (SELECT regexp_extract(m, '{TOLD}', 1) AS a, regexp_extract(m, '{TOLD}', 2) AS b FROM t)
    SELECT a AS src, b AS dst FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b)"""
SUPPLY = """(WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
    f AS (SELECT src, dst, min(l_orderkey) AS first FROM p WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2)
    SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY first, dst) AS k FROM f) WHERE k <= 2)"""
REACH = "WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {edges}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"
COMPONENTS = "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS (SELECT id, greatest(id, (SELECT max(a.dst) FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src = id)) AS component FROM v)"


def _mentions(spark, folder):
    found = F.regexp_extract_all("text", F.lit(f"({TOLD})"), F.lit(1))
    m = table(spark, folder, "documents").where(F.col("text").contains(" imports ")).select(F.explode(found).alias("m"))
    p = m.select(F.regexp_extract("m", TOLD, 1).alias("a"), F.regexp_extract("m", TOLD, 2).alias("b")).where("a <> b")
    return p.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*").distinct()


def _supply(spark, folder):
    """Each supplier with the first two others that follow it within an order."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")  # lines of one order
    p = li.select("l_orderkey", F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(order).alias("dst")).where("dst is not null and src <> dst")
    first = p.groupBy("src", "dst").agg(F.min("l_orderkey").alias("first"))
    least = F.slice(F.sort_array(F.collect_list(F.struct("first", "dst"))), 1, 2)  # at most as many as there are suppliers
    return first.groupBy("src").agg(least.alias("n")).select("src", F.explode("n").alias("n")).select("src", F.col("n.dst").alias("dst"))


def mentioned_imports(spark, folder):
    """The import graph that the documents tell of."""
    return _mentions(spark, folder)


def importers(spark, folder):
    """Files that import each file, and that it imports."""
    return graph.degrees(_mentions(spark, folder)).select("id", "fan_in", "fan_out")


def import_cycles(spark, folder):
    """Circular imports: components of more than one file, with their size; any number of imports a file."""
    c = graph.strong_components(_mentions(spark, folder))
    return c.groupBy("component").agg(F.count("*").alias("files"), F.min("id").alias("first")).where("files > 1")


def supplier_components(spark, folder):
    """Strongly connected components of the suppliers."""
    return graph.strong_components(_supply(spark, folder))


def longest_chains(spark, folder):
    """Longest chain of components that ends in each component of suppliers."""
    e = checkpoint(_supply(spark, folder))  # lines of orders are sorted once
    c = graph.strong_components(e)
    return graph.longest_depths(c, graph.condensed(e, c))


def function_context(spark, folder):
    """Direct and transitive callers and callees of every supplier."""
    e = checkpoint(_supply(spark, folder))
    d = graph.degrees(e)
    callees = graph.reach(e).select("id", F.col("reached").alias("all_callees"))
    callers = graph.reach(graph.reversed_edges(e)).select("id", F.col("reached").alias("all_callers"))
    return d.join(callees, "id", "left").join(callers, "id", "left").select("id", "fan_in", "fan_out", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("all_callers", "all_callees")))


def flow_stats(spark, folder):
    """Flows from supplier to supplier: number, mean and greatest depth, deep ones."""
    r = graph.reach(_supply(spark, folder), over=3).where("others > 0")
    flows = F.sum("others")
    return r.agg(F.coalesce(flows, F.lit(0)).alias("flows"), F.round(F.sum("total") / flows, 6).alias("mean_depth"), F.max("depth").cast("int").alias("max_depth"), F.sum("over").alias("deep"))


def call_chains(spark, folder):
    """Suppliers at the end of the longest least walks from each supplier, and that depth."""
    r = graph.reach(_supply(spark, folder)).where("others > 0")
    return r.select(F.col("id").alias("src"), F.col("depth").cast("int").alias("depth"), "end")


def critical_chains(spark, folder):
    """The five suppliers with the deepest flows (a report of the first five)."""
    return call_chains(spark, folder).orderBy(F.col("depth").desc(), "src").limit(5)


def _stored(spark, folder):
    return scan.stored_files(table(spark, folder, "files"))


def import_edges(spark, folder):
    """Imports of files, each target once, external ones kept."""
    i = extract.imports(_stored(spark, folder))
    return i.groupBy("file_id", "source").agg(F.count("*").alias("imports"))


def import_counts(spark, folder):
    """Import statements and different targets by file."""
    return import_edges(spark, folder).groupBy("file_id").agg(F.sum("imports").alias("imports"), F.count("*").alias("targets"))


RECENT = "2024-01-20 00:00:00"


def changed_dependencies(spark, folder):
    """What recently changed files import, with the number of such files and whether one is of the same stem."""
    f = table(spark, folder, "files").select("file_id", "modified_at", F.regexp_extract("file_path", r"([^/]+?)\.[^./]*$", 1).alias("stem")).distinct()
    changed = f.where(F.col("modified_at") >= F.lit(RECENT).cast("timestamp_ntz"))
    i = import_edges(spark, folder).join(changed.select("file_id").distinct(), "file_id", "left_semi")
    stems = changed.select(F.col("stem").alias("target")).distinct()
    named = i.withColumn("target", F.regexp_extract("source", r"([^/]+)$", 1)).join(stems, "target", "left_anti")
    return named.groupBy("source").agg(F.count_distinct("file_id").alias("files"))


def call_partition(spark, folder):
    """Calls of each file: to functions that the project declares, asynchronous ones among them, and to others."""
    f = _stored(spark, folder)
    made = extract.function_bodies(f).select("file_id", F.col("name").alias("caller"), F.explode(calls("body")).alias("callee")).where("caller <> callee").select("file_id", "callee").distinct()
    known = extract.functions(f).groupBy(F.col("name").alias("callee")).agg(F.max("is_async").alias("is_async"))
    j = made.join(known, "callee", "left")
    pick = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("callee")))), ",")
    inside = F.col("is_async").isNotNull()
    return j.groupBy("file_id").agg(pick(inside).alias("internal"), pick(~inside).alias("external"), pick(inside & F.col("is_async")).alias("asynchronous"))


QUERIES = {
    f.__name__: f
    for f in (mentioned_imports, importers, import_cycles, supplier_components, longest_chains, function_context, flow_stats, call_chains, critical_chains, import_edges, import_counts, changed_dependencies, call_partition)
}

_SUPPLY_REACH = REACH.format(edges=SUPPLY)
_DEPTHS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {SUPPLY}), d(src, dst, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT d.src, e.dst, d.depth + 1 FROM d JOIN e ON d.dst = e.src WHERE d.depth < 40),
    b AS (SELECT src, dst, min(depth) AS depth FROM d WHERE src <> dst GROUP BY 1, 2)"""
_CHAINS = f"{_DEPTHS}, c AS (SELECT src, max(depth) AS depth FROM b GROUP BY 1), l AS (SELECT c.src, c.depth, min(b.dst) AS \"end\" FROM c JOIN b USING (src, depth) GROUP BY 1, 2)"
SQL = {
    "mentioned_imports": f"SELECT src, dst FROM {MENTIONS}",
    "importers": f"WITH e AS (SELECT * FROM {MENTIONS}) SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1",
    "import_cycles": f"{REACH.format(edges=MENTIONS)}, {COMPONENTS} SELECT component, count(*) AS files, min(id) AS first FROM c GROUP BY 1 HAVING count(*) > 1",
    "supplier_components": f"{_SUPPLY_REACH}, {COMPONENTS} SELECT id, component FROM c",
    "longest_chains": f"""{_SUPPLY_REACH}, {COMPONENTS}, g AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN c a ON e.src = a.id JOIN c b ON e.dst = b.id WHERE a.component <> b.component),
        w(id, depth) AS (SELECT component, 0 FROM c UNION SELECT g.dst, w.depth + 1 FROM w JOIN g ON w.id = g.src) SELECT id, max(depth) AS depth FROM w GROUP BY 1""",
    "function_context": f"""{_SUPPLY_REACH}, {COMPONENTS} SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS fan_in, (SELECT count(*) FROM e WHERE src = id) AS fan_out,
        (SELECT count(*) FROM r WHERE dst = id) AS all_callers, (SELECT count(*) FROM r WHERE src = id) AS all_callees FROM c""",
    "import_edges": f"SELECT file_id, source, count(*) AS imports FROM {_IMPORTS} GROUP BY 1, 2",
    "import_counts": f"SELECT file_id, count(*) AS imports, count(DISTINCT source) AS targets FROM {_IMPORTS} GROUP BY 1",
    "changed_dependencies": f"""WITH h AS (SELECT DISTINCT file_id, file_path, regexp_extract(file_path, '([^/]+?)\\.[^./]*$', 1) AS stem FROM files WHERE modified_at >= TIMESTAMP '{RECENT}')
        SELECT source, count(DISTINCT file_id) AS files FROM {_IMPORTS} WHERE file_id IN (SELECT file_id FROM h) AND regexp_extract(source, '([^/]+)$', 1) NOT IN (SELECT stem FROM h) GROUP BY 1""",
    "call_partition": f"""WITH k AS (SELECT name AS callee, max(is_async::INT) = 1 AS is_async FROM {_FUNCTIONS} GROUP BY 1),
        m AS (SELECT DISTINCT file_id, callee FROM (SELECT file_id, name AS caller, unnest(regexp_extract_all(body, '([A-Za-z0-9_]+)\\s*\\(', 1)) AS callee FROM {_BODIES}) WHERE caller <> callee AND callee NOT IN ({_BUILT}))
        SELECT file_id, coalesce(string_agg(callee, ',' ORDER BY callee) FILTER (is_async IS NOT NULL), '') AS internal, coalesce(string_agg(callee, ',' ORDER BY callee) FILTER (is_async IS NULL), '') AS external,
            coalesce(string_agg(callee, ',' ORDER BY callee) FILTER (is_async), '') AS asynchronous FROM m LEFT JOIN k USING (callee) GROUP BY 1""",
    "flow_stats": f"{_DEPTHS} SELECT count(*) AS flows, round(avg(depth), 6) AS mean_depth, max(depth) AS max_depth, sum((depth > 3)::INT)::BIGINT AS deep FROM b",
    "call_chains": f'{_CHAINS} SELECT src, depth, "end" FROM l',
    "critical_chains": f'{_CHAINS} SELECT src, depth, "end" FROM l ORDER BY depth DESC, src LIMIT 5',
}
