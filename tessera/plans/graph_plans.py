"""Queries over graphs: the graph of parts that follow each other in orders, trade between nations, containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import extract, graph, scan
from tessera.plans.scan_plans import _BODIES, _BUILT, _CLASSES, _FUNCTIONS, _IMPORTS, FILES
from tessera.sources.tables import table

NEXT = """(WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
    r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY l_orderkey, l_linenumber, dst) AS k FROM p WHERE dst IS NOT NULL AND src <> dst) SELECT src, dst FROM r WHERE k = 1)"""


def _next(spark, folder):
    return graph.next_part_edges(table(spark, folder, "lineitem"))


def next_part_graph(spark, folder):
    """The edges."""
    return _next(spark, folder)


def fan_in_out(spark, folder):
    """Degrees, instability and role of every part."""
    return graph.roles(graph.degrees(_next(spark, folder)))


def role_counts(spark, folder):
    """Parts by role, with mean instability."""
    return fan_in_out(spark, folder).groupBy("role").agg(F.count("*").alias("parts"), F.round(F.avg("instability"), 6).alias("instability"))


def entry_points(spark, folder):
    """Parts that no other part leads to, or that are cheap enough to count as exported."""
    known = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") < 950).alias("exported"))
    return graph.entry_points(known, _next(spark, folder))


def dependency_depth(spark, folder):
    """Least depth of parts below the entries, up to 12."""
    e = _next(spark, folder)
    start = graph.roles(graph.degrees(e)).where("role = 'entry'").select(F.col("id").alias("origin"))
    return graph.distances(e, start, 12).groupBy("id").agg(F.min("depth").alias("depth"))


def dependency_layers(spark, folder):
    """Parts by depth."""
    return graph.layers(dependency_depth(spark, folder))


def reachability(spark, folder):
    """Parts reached from each part within 8 steps."""
    e = _next(spark, folder)
    start = e.select(F.col("src").alias("origin"))
    return graph.distances(e, start, 8).groupBy("origin").agg(F.count("*").alias("reached"), F.max("depth").alias("depth"))


def dependency_tree(spark, folder):
    """Parents within the tree below each part, to depth 6."""
    e = _next(spark, folder)
    p = graph.simple_paths(e, e.select(F.col("src").alias("origin")), 6)
    return p.where(F.size("path") > 1).select("origin", F.element_at("path", -1).alias("id"), F.element_at("path", -2).alias("parent"), (F.size("path") - 1).alias("depth"))


def transitive_callees(spark, folder):
    """Number of parts that each part leads to, directly or not, over walks of up to 16 steps."""
    return graph.closure(_next(spark, folder), 4).where("depth <= 16").groupBy("src").agg(F.count("*").alias("callees"), F.max("depth").alias("depth"))


def transitive_callers(spark, folder):
    """Number of parts that lead to each part over walks of up to 16 steps."""
    return graph.closure(_next(spark, folder), 4).where("depth <= 16").groupBy("dst").agg(F.count("*").alias("callers"), F.max("depth").alias("depth"))


def short_cycles(spark, folder):
    """Parts on cycles of up to 16 steps, with the length."""
    return graph.closure(_next(spark, folder), 4).where("src = dst and depth <= 16").select(F.col("src").alias("id"), F.col("depth").alias("length"))


def all_callees(spark, folder):
    """Number of parts that each part leads to over walks of any length."""
    return graph.callees(_next(spark, folder))


def all_callers(spark, folder):
    """Number of parts that lead to each part over walks of any length."""
    return graph.callers(_next(spark, folder))


def all_cycles(spark, folder):
    """Cycles of any length, named by their smallest part."""
    return graph.cycles(_next(spark, folder))


def shortest_path(spark, folder):
    """Undirected distances from part 1, up to 10 steps."""
    return graph.undirected_distance(_next(spark, folder), 1, 10).select("id", "depth")


def call_chain(spark, folder):
    """Each part with the part it leads to, as a sorted list."""
    e = _next(spark, folder)
    return e.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("callees"))


def chain_position(spark, folder):
    """Mean distance of each part from the entries that reach it within 12 steps, and how many do."""
    e = _next(spark, folder)
    start = graph.roles(graph.degrees(e)).where("role = 'entry'").select(F.col("id").alias("origin"))
    return graph.distances(e, start, 12).groupBy("id").agg(F.round(F.avg("depth"), 6).alias("position"), F.count("*").alias("entries"))


def critical_paths(spark, folder):
    """Longest walks of more than 3 parts from the entries (up to 12), with their summed complexity."""
    e = _next(spark, folder)
    start = graph.roles(graph.degrees(e)).where("role = 'entry'").select(F.col("id").alias("origin"))
    w = graph.walk(e, start, 12)
    size = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("c"))
    s = w.join(size, "id", "left").groupBy("origin").agg(F.count("*").alias("length"), F.sum(F.coalesce("c", F.lit(1))).cast("long").alias("complexity"))
    return s.where("length > 3")


def _trade(spark, folder):
    n = lambda who, key: table(spark, folder, who).select(f"{who[0]}_{key}key", f"{who[0]}_nationkey")
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = li.join(n("supplier", "supp"), li["l_suppkey"] == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(n("customer", "cust"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


TRADE = """(SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def _strong(spark, folder):
    """Trade of more than the mean volume between different nations."""
    t = _trade(spark, folder).where("src <> dst")
    mean = t.agg(F.avg("n")).first()[0] or 0.0
    return t.where(F.col("n") > F.lit(mean)).select("src", "dst")


STRONG = f"(SELECT src, dst FROM {TRADE} WHERE src <> dst AND n > (SELECT avg(n) FROM {TRADE} WHERE src <> dst))"


def bidirectional_dependency(spark, folder):
    """Pairs of nations with strong trade both ways."""
    return graph.mutual(_strong(spark, folder))


def module_cohesion(spark, folder):
    """Cohesion, coupling and balance of regions as modules of nations."""
    raw = _trade(spark, folder).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("imports"))
    m = graph.module_metrics(table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("module")), _strong(spark, folder), raw)
    return m.select("module", "files", "internal", "external", "imports", *(F.round(c, 6).alias(c) for c in ("cohesion", "coupling", "balance")))


_COHESION = f"""(WITH s AS {STRONG}, m AS (SELECT n_nationkey AS id, n_regionkey AS module FROM nation), sz AS (SELECT module, count(*) AS files FROM m GROUP BY 1),
    l AS (SELECT a.module, sum((a.module = b.module)::INT) AS internal, sum((a.module <> b.module)::INT) AS external FROM s JOIN m a ON s.src = a.id JOIN m b ON s.dst = b.id GROUP BY 1),
    t AS (SELECT module, sum(imports) AS imports FROM (SELECT src AS id, count(*) AS imports FROM {TRADE} GROUP BY 1) JOIN m USING (id) GROUP BY 1)
    SELECT module, files, coalesce(internal, 0)::BIGINT AS internal, coalesce(external, 0)::BIGINT AS external, coalesce(imports, 0)::BIGINT AS imports,
        CASE WHEN files > 1 THEN coalesce(internal, 0) / (files * (files - 1))::DOUBLE ELSE 0 END AS cohesion, CASE WHEN imports > 0 THEN coalesce(external, 0) / imports::DOUBLE ELSE 0 END AS coupling
    FROM sz LEFT JOIN l USING (module) LEFT JOIN t USING (module))"""
_BALANCE = "greatest(0, 1 - (abs(cohesion - 1) + abs(coupling)) / 2)"


def modularity_score(spark, folder):
    """The overall score of the regions."""
    raw = _trade(spark, folder).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("imports"))
    return graph.modularity(graph.module_metrics(table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("module")), _strong(spark, folder), raw))


def containment_tree(spark, folder):
    """Region - nation - customer as a tree with depth."""
    r = table(spark, folder, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("").alias("parent"), F.lit(0).alias("depth"))
    n = table(spark, folder, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.lit(1).alias("depth"))
    c = table(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.lit(2).alias("depth"))
    return r.unionByName(n).unionByName(c)


def tree_widths(spark, folder):
    """Children by parent and depth."""
    return containment_tree(spark, folder).groupBy("parent", "depth").agg(F.count("*").alias("children"))


def path_complexity(spark, folder):
    """Summed quantity of the lines of each order."""
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    li = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.sum("l_quantity"), 2).alias("complexity"), F.count("*").alias("steps"))
    return o.join(li, "id", "left").select("id", F.coalesce("complexity", F.lit(0.0)).alias("complexity"), F.coalesce("steps", F.lit(0)).alias("steps"))


def ranked_lookup(spark, folder):
    """For each part: the line of the supplier with the lowest key that sells it most, then the cheapest, then the first."""
    li = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("price"))
    order = F.struct((-F.col("n")).alias("a"), F.col("price").alias("b"), F.col("l_suppkey").alias("c"))
    return li.groupBy("l_partkey").agg(F.min_by("l_suppkey", order).alias("supplier"), F.max("n").alias("lines"))


def call_resolution(spark, folder):
    """Calls of functions that the project declares, with the declaration they mean."""
    f = scan.stored_files(table(spark, folder, "files"))
    bodies = extract.function_bodies(f)
    from tessera.functions.expressions import calls

    made = bodies.select("file_id", F.col("name").alias("caller"), F.explode(calls("body")).alias("callee")).where("caller <> callee").distinct()
    declared = extract.functions(f)
    return extract.ranked_calls(made.join(declared.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi"), declared)


def graph_nodes(spark, folder):
    """Nodes of the code graph by type."""
    return extract.nodes(scan.stored_files(table(spark, folder, "files"))).groupBy("type").agg(F.count("*").alias("nodes"))


def graph_edges(spark, folder):
    """Contained nodes by file."""
    n = extract.nodes(scan.stored_files(table(spark, folder, "files")))
    return extract.contains_edges(n).groupBy("file_id").agg(F.count("*").alias("contained"))


def class_parents(spark, folder):
    """Superclasses with the number of classes that extend them and of classes of that name."""
    k = extract.classes(scan.stored_files(table(spark, folder, "files")))
    children = k.where("super_class is not null").groupBy(F.col("super_class").alias("name")).agg(F.count("*").alias("children"))
    return children.join(k.groupBy("name").agg(F.count("*").alias("declared")), "name", "left").select("name", "children", F.coalesce("declared", F.lit(0)).alias("declared"))


def function_lookup(spark, folder):
    """Files in which each exported function name is declared, most first."""
    fn = extract.functions(scan.stored_files(table(spark, folder, "files"))).where("exported")
    return fn.groupBy("name").agg(F.count_distinct("file_id").alias("files"), F.min("file_path").alias("first_path"))


def dot_export(spark, folder):
    """Edges of strong trade as DOT lines."""
    e = _strong(spark, folder).withColumn("type", F.lit("trade"))
    n = graph.vertices(e).withColumn("type", F.lit("file"))
    return graph.dot(n, e).select("text")


QUERIES = {
    f.__name__: f
    for f in (next_part_graph, fan_in_out, role_counts, entry_points, dependency_depth, dependency_layers, reachability, dependency_tree, transitive_callees, transitive_callers, short_cycles, all_callees, all_callers, all_cycles, shortest_path, call_chain, chain_position, critical_paths, bidirectional_dependency, module_cohesion, modularity_score, containment_tree, tree_widths, path_complexity, ranked_lookup, call_resolution, graph_nodes, graph_edges, class_parents, function_lookup, dot_export)
}

_DEGREES = f"""(WITH e AS {NEXT}, o AS (SELECT src AS id, count(*) AS fan_out FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS fan_in FROM e GROUP BY 1)
    SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, round(coalesce(fan_out, 0) / (coalesce(fan_in, 0) + coalesce(fan_out, 0))::DOUBLE, 6) AS instability,
        CASE WHEN coalesce(fan_in, 0) = 0 THEN 'entry' WHEN coalesce(fan_out, 0) = 0 THEN 'leaf' ELSE 'intermediate' END AS role FROM o FULL JOIN i USING (id))"""


def _search(start: str, most: int, edges: str = NEXT) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {edges}), d(origin, id, depth) AS (SELECT origin, origin, 0 FROM ({start}) UNION SELECT d.origin, e.dst, d.depth + 1 FROM d JOIN e ON d.id = e.src WHERE d.depth < {most}),
        b AS (SELECT origin, id, min(depth) AS depth FROM d GROUP BY 1, 2)"""


_ENTRIES = f"SELECT id AS origin FROM {_DEGREES} WHERE role = 'entry'"
_CLOSURE = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {NEXT}), d(src, dst, depth) AS (SELECT src, dst, 1 FROM e UNION SELECT d.src, e.dst, d.depth + 1 FROM d JOIN e ON d.dst = e.src WHERE d.depth < 16),
    c AS (SELECT src, dst, min(depth) AS depth FROM d GROUP BY 1, 2)"""
_WALK = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {NEXT}), w(origin, path) AS (SELECT origin, [origin] FROM ({_ENTRIES}) UNION ALL SELECT origin, list_append(path, dst) FROM w JOIN e ON path[-1] = e.src WHERE NOT list_contains(path, dst) AND len(path) <= 12),
    l AS (SELECT origin, max_by(path, len(path)) AS path FROM w GROUP BY 1)"""
_TREE = """(SELECT 'r' || r_regionkey AS id, '' AS parent, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2 FROM customer)"""
SQL = {
    "next_part_graph": f"SELECT src, dst FROM {NEXT}",
    "fan_in_out": f"SELECT * FROM {_DEGREES}",
    "role_counts": f"SELECT role, count(*) AS parts, round(avg(instability), 6) AS instability FROM {_DEGREES} GROUP BY role",
    "entry_points": f"SELECT p_partkey AS id, CASE WHEN p_retailprice < 950 THEN 'exported' ELSE 'no-callers' END AS reason FROM part WHERE p_retailprice < 950 OR p_partkey NOT IN (SELECT dst FROM {NEXT})",
    "dependency_depth": f"{_search(_ENTRIES, 12)} SELECT id, min(depth) AS depth FROM b GROUP BY id",
    "dependency_layers": f"{_search(_ENTRIES, 12)} SELECT depth, count(*) AS vertices FROM (SELECT id, min(depth) AS depth FROM b GROUP BY id) GROUP BY depth",
    "reachability": f"{_search(f'SELECT src AS origin FROM e', 8)} SELECT origin, count(*) AS reached, max(depth) AS depth FROM b GROUP BY origin",
    "dependency_tree": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {NEXT}), p(origin, path) AS (SELECT src, [src] FROM e UNION ALL SELECT origin, list_append(path, dst) FROM p JOIN e ON path[-1] = e.src WHERE NOT list_contains(path, dst) AND len(path) <= 6)
        SELECT origin, path[-1] AS id, path[-2] AS parent, len(path) - 1 AS depth FROM p WHERE len(path) > 1""",
    "transitive_callees": f"{_CLOSURE} SELECT src, count(*) AS callees, max(depth) AS depth FROM c GROUP BY src",
    "transitive_callers": f"{_CLOSURE} SELECT dst, count(*) AS callers, max(depth) AS depth FROM c GROUP BY dst",
    "short_cycles": f"{_CLOSURE} SELECT src AS id, depth AS length FROM c WHERE src = dst",
    "shortest_path": f"{_search('SELECT 1 AS origin', 10, f'(SELECT src, dst FROM {NEXT} UNION SELECT dst, src FROM {NEXT})')} SELECT id, depth FROM b",
    "call_chain": f"SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS callees FROM {NEXT} GROUP BY src",
    "chain_position": f"{_search(_ENTRIES, 12)} SELECT id, round(avg(depth), 6) AS position, count(*) AS entries FROM b GROUP BY id",
    "critical_paths": f"{_WALK} SELECT origin, len(path) AS length, (SELECT sum(coalesce(p_size, 1)) FROM (SELECT unnest(l.path) AS id) LEFT JOIN part ON p_partkey = id)::BIGINT AS complexity FROM l WHERE len(path) > 3",
    "bidirectional_dependency": f"SELECT a.src, a.dst FROM {STRONG} a JOIN {STRONG} b ON a.src = b.dst AND a.dst = b.src",
    "module_cohesion": f"SELECT module, files, internal, external, imports, round(cohesion, 6) AS cohesion, round(coupling, 6) AS coupling, round({_BALANCE}, 6) AS balance FROM {_COHESION}",
    "modularity_score": f"SELECT round((avg(cohesion) + (1 - avg(coupling)) + avg({_BALANCE})) / 3, 6) AS modularity, count(*) AS modules FROM {_COHESION}",
    "containment_tree": f"SELECT * FROM {_TREE}",
    "tree_widths": f"SELECT parent, depth, count(*) AS children FROM {_TREE} GROUP BY ALL",
    "path_complexity": "SELECT o_orderkey AS id, coalesce(c, 0) AS complexity, coalesce(s, 0) AS steps FROM orders LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 2) AS c, count(*) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
    "ranked_lookup": "WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS n, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, price, l_suppkey) AS k FROM g) SELECT l_partkey, l_suppkey AS supplier, n AS lines FROM r WHERE k = 1",
    "dot_export": f"""WITH s AS {STRONG} SELECT 'digraph G {{' AS text UNION ALL SELECT '}}' UNION ALL SELECT '  "' || id || '" [shape=box];' FROM (SELECT src AS id FROM s UNION SELECT dst FROM s) UNION ALL SELECT '  "' || src || '" -> "' || dst || '" [style=solid];' FROM s""",
}

SQL["class_parents"] = f"""WITH c AS (SELECT super_class AS name, count(*) AS children FROM {_CLASSES} WHERE super_class <> '' GROUP BY 1), d AS (SELECT name, count(*) AS declared FROM {_CLASSES} GROUP BY 1)
    SELECT name, children, coalesce(declared, 0) AS declared FROM c LEFT JOIN d USING (name)"""
SQL["function_lookup"] = f"SELECT name, count(DISTINCT file_id) AS files, min(file_path) AS first_path FROM {_FUNCTIONS} WHERE exported GROUP BY 1"
_GRAPH = f"""(SELECT DISTINCT 'file' AS type, file_path, 0 AS line_no, '' AS name FROM {FILES} UNION ALL SELECT DISTINCT 'function', file_path, line_no, name FROM {_FUNCTIONS}
    UNION ALL SELECT DISTINCT 'class', file_path, line_no, name FROM {_CLASSES} UNION ALL SELECT DISTINCT 'import', file_path, 0, source FROM {_IMPORTS})"""
SQL["graph_nodes"] = f"SELECT type, count(*) AS nodes FROM {_GRAPH} GROUP BY 1"
SQL["graph_edges"] = f"SELECT file_id, count(*) AS contained FROM {_GRAPH} n JOIN (SELECT DISTINCT file_id, file_path FROM files) f USING (file_path) WHERE type <> 'file' GROUP BY 1"
SQL["call_resolution"] = f"""WITH d AS (SELECT file_id, name, line_no, exported FROM {_FUNCTIONS}),
    m AS (SELECT DISTINCT file_id, name AS caller, unnest(regexp_extract_all(body, '([A-Za-z0-9_]+)\\s*\\(', 1)) AS callee FROM {_BODIES}),
    j AS (SELECT m.file_id, caller, callee, d.file_id AS target_file, d.line_no AS target_line, CASE WHEN d.file_id = m.file_id THEN 0 WHEN exported THEN 1 ELSE 2 END AS how
        FROM m JOIN d ON d.name = m.callee WHERE caller <> callee AND callee NOT IN ({_BUILT}))
    SELECT file_id, caller, callee, target_file, target_line FROM j QUALIFY row_number() OVER (PARTITION BY file_id, caller, callee ORDER BY how, target_file, target_line) = 1"""
