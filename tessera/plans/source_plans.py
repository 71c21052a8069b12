"""Queries of semi-structured sources, images and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import visual
from tessera.session import scratch
from tessera.sources import documents as D
from tessera.sources import sinks
from tessera.sources.tables import table
from tessera.streaming import incremental

#: Pixels of an image: four components of a vector each, as bytes.
BYTE = "cast(greatest(0, least(255, floor(cast(e as double) * 256 + 128))) as int)"


def api_headings(spark, folder):
    """Interfaces described in documents, by name."""
    return D.api_headings(table(spark, folder, "documents")).groupBy("name").agg(F.count("*").alias("places"), F.max("parameters").alias("parameters"))


def translation_keys(spark, folder):
    """Keys of the bundles of translations: places and different texts."""
    return D.translations(table(spark, folder, "slices")).groupBy("key").agg(F.count("*").alias("places"), F.count_distinct("value").alias("texts"))


def locked_packages(spark, folder):
    """Packages of the lock files."""
    return D.locked_packages(table(spark, folder, "files"))


def event_properties(spark, folder):
    """Properties of events as dotted keys."""
    p = table(spark, folder, "events").select(F.explode(D.flattened(F.try_parse_json("props"))).alias("p"))
    return p.groupBy("p.key").agg(F.count("*").alias("places"), F.count_distinct("p.value").alias("texts"), F.max(F.col("p.value").cast("int")).alias("largest"))


def config_headers(spark, folder):
    """Settings under canonical headers, whatever the file calls them."""
    rows = D.mapped_headers(table(spark, folder, "provider_config"), {"name": ["project"], "endpoint": ["url", "api_endpoint"], "model": ["model_name"]})
    return rows.groupBy(*(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "model"))).agg(F.count("endpoint").alias("endpoints"))


def _pixels(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    e = e.select("vec_id", F.expr("i div 4").alias("p"), (F.col("i") % 4).alias("c"), F.expr(BYTE).alias("b"))
    p = e.groupBy("vec_id", "p").agg(*(F.max(F.when(F.col("c") == i, F.col("b"))).alias(n) for i, n in enumerate("rgba")))
    return p.select("vec_id", F.expr("p % 4").alias("x"), F.expr("p div 4").alias("y"), *"rgba")


def image_ssim(spark, folder):
    """Structural similarity of each image to the one before it."""
    g = visual.gray(_pixels(spark, folder)).select("vec_id", "x", "y", "gray")
    before = g.select((F.col("vec_id") + 1).alias("vec_id"), "x", "y", F.col("gray").alias("before"))
    return g.join(before, ["vec_id", "x", "y"]).groupBy("vec_id").agg(F.round(visual.ssim(F.col("gray"), F.col("before")), 4).alias("ssim"))


def image_pixels(spark, folder):
    """Pixels by which each image differs from the one before it."""
    p = _pixels(spark, folder)
    return visual.pixel_match(p, p.withColumn("vec_id", F.col("vec_id") + 1), ["vec_id"], 0.1)


def image_histogram(spark, folder):
    """Colour histogram of all images."""
    return visual.colour_histogram(_pixels(spark, folder))


def css_colours(spark, folder):
    """First and last colour of each file, their distance and the gray of the first."""
    f = table(spark, folder, "files").select("file_id", F.regexp_extract_all("content", F.lit(r"(#[0-9A-Fa-f]{6})(?:[^0-9A-Za-z]|$)"), F.lit(1)).alias("c")).where("size(c) > 0")
    f = f.select("file_id", F.element_at("c", 1).alias("first"), F.element_at("c", -1).alias("last"))
    return f.select("file_id", F.round(X.colour_distance(F.col("first"), F.col("last")), 4).alias("distance"), F.round(X.grayscale(*X.rgb(F.col("first"))), 4).alias("gray"))


def priority_report(spark, folder):
    """Orders as a report of suites: lines of a JUnit document."""
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    cases = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("suite"), status.alias("status"))
    return sinks.junit(sinks.test_report(cases))


def streamed_triggers(spark, folder):
    """Issues by rule, learnt from a stream of the table; equal to a batch count."""
    t = table(spark, folder, "issues")
    at = scratch(spark)
    stream = spark.readStream.schema(t.schema).parquet(f"{folder}/issues.parquet*").select(F.coalesce("rule_id", F.lit("")).alias("rule_id"))
    counts = stream.groupBy("rule_id").agg(F.count("*").alias("triggers"))

    def keep(rows, number):
        rows.write.mode("overwrite").parquet(f"{at}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


def windowed_events(spark, folder):
    """Events by day and type, as the stream of the same name gives them."""
    return incremental.windowed_counts(table(spark, folder, "events")).select(F.col("window.start").alias("day"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (api_headings, translation_keys, locked_packages, event_properties, config_headers, image_ssim, image_pixels, image_histogram, css_colours, priority_report, streamed_triggers, windowed_events)
}

_PIXELS = """(WITH c AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
b AS (SELECT vec_id, i // 4 AS p, i % 4 AS c, greatest(0, least(255, floor(e::DOUBLE * 256 + 128)))::INT AS b FROM c)
SELECT vec_id, p % 4 AS x, p // 4 AS y, max(b) FILTER (c = 0) AS r, max(b) FILTER (c = 1) AS g, max(b) FILTER (c = 2) AS b, max(b) FILTER (c = 3) AS a FROM b GROUP BY vec_id, p)"""

SQL = {
    "api_headings": r"""
WITH h AS (SELECT unnest(regexp_extract_all(text, '(?m)^## ([A-Za-z_][A-Za-z0-9_]*\([^)\n]*\))', 1)) AS h FROM documents),
p AS (SELECT regexp_extract(h, '^([A-Za-z0-9_]+)', 1) AS name, trim(regexp_extract(h, '\(([^)]*)\)', 1)) AS a FROM h)
SELECT name, count(*) AS places, max(CASE WHEN a = '' THEN 0 ELSE len(string_split(a, ',')) END) AS parameters FROM p GROUP BY 1""",
    "translation_keys": r"""
WITH p AS (SELECT unnest(regexp_extract_all(content, '(''[A-Za-z0-9_.]+''\s*:\s*''[^''\n]*'')', 1)) AS p FROM slices)
SELECT regexp_extract(p, '^''([^'']+)''', 1) AS key, count(*) AS places, count(DISTINCT regexp_extract(p, ':\s*''([^'']*)''$', 1)) AS texts FROM p GROUP BY 1""",
    "locked_packages": """
WITH v AS (SELECT file_id, unnest(map_entries(TRY_CAST(TRY_CAST(content AS JSON)->'packages' AS MAP(VARCHAR, JSON)))) AS e FROM files WHERE file_path LIKE '%package-lock.json')
SELECT file_id, regexp_replace(e.key, '^.*node_modules/', '') AS package, e.value->>'version' AS version FROM v WHERE e.key <> ''""",
    "event_properties": """
WITH k AS (SELECT props, unnest(json_keys(props)) AS key FROM events)
SELECT key, count(*) AS places, count(DISTINCT props->>('$.' || key)) AS texts, max((props->>('$.' || key))::INT) AS largest FROM k GROUP BY 1""",
    "config_headers": """
SELECT coalesce(project, '') AS name, coalesce(model_name, '') AS model, count(api_endpoint) AS endpoints FROM provider_config GROUP BY 1, 2""",
    "image_ssim": f"""
WITH g AS (SELECT vec_id, x, y, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS v FROM {_PIXELS}),
s AS (SELECT a.vec_id, avg(a.v) AS mx, avg(b.v) AS my, var_pop(a.v) AS vx, var_pop(b.v) AS vy, covar_pop(a.v, b.v) AS c FROM g a JOIN g b ON b.vec_id = a.vec_id - 1 AND a.x = b.x AND a.y = b.y GROUP BY 1)
SELECT vec_id, round(((2 * mx * my + 6.5025::DOUBLE) * (2 * c + 58.5225::DOUBLE)) / ((mx * mx + my * my + 6.5025::DOUBLE) * (vx + vy + 58.5225::DOUBLE)), 4) AS ssim FROM s""",
    "image_pixels": f"""
WITH p AS (SELECT * FROM {_PIXELS}),
d AS (SELECT m.vec_id, abs(m.r - n.r) + abs(m.g - n.g) + abs(m.b - n.b) + abs(m.a - n.a) AS d FROM p m JOIN p n ON n.vec_id = m.vec_id - 1 AND m.x = n.x AND m.y = n.y)
SELECT vec_id, count(*) AS pixels, count(*) FILTER (d > 76.5) AS different, max(d) AS largest, sum(d)::BIGINT AS total FROM d GROUP BY 1""",
    "image_histogram": f"""
SELECT channel, bin, count(*) AS n FROM (SELECT unnest(['red', 'green', 'blue']) AS channel, unnest([r, g, b]) AS bin FROM {_PIXELS}) GROUP BY ALL""",
    "css_colours": r"""
WITH c AS (SELECT file_id, regexp_extract_all(content, '(#[0-9A-Fa-f]{6})(?:[^0-9A-Za-z]|$)', 1) AS c FROM files),
p AS (SELECT file_id, c[1] AS a, c[len(c)] AS b FROM c WHERE len(c) > 0),
n AS (SELECT file_id, [('0x' || a[2:3])::INT, ('0x' || a[4:5])::INT, ('0x' || a[6:7])::INT] AS a, [('0x' || b[2:3])::INT, ('0x' || b[4:5])::INT, ('0x' || b[6:7])::INT] AS b FROM p)
SELECT file_id, round(sqrt(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2)::DOUBLE), 4) AS distance, round(0.299::DOUBLE * a[1] + 0.587::DOUBLE * a[2] + 0.114::DOUBLE * a[3], 4) AS gray FROM n""",
    "priority_report": """
SELECT format('<testsuite name="{}" tests="{}" failures="{}" skipped="{}"/>', o_orderpriority, count(*), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus NOT IN ('F', 'O'))) AS text FROM orders GROUP BY o_orderpriority""",
    "streamed_triggers": "SELECT coalesce(rule_id, '') AS rule_id, count(*) AS triggers FROM issues GROUP BY 1",
    "windowed_events": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
