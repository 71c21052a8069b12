"""Dependencies declared in the manifests of eight ecosystems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Manifest files, and the shape of a dependency in those that are read line by line.
_PAIR = r"^\s{2,}\"?([A-Za-z0-9_.@/-]+)\"?:\s*['\"]?([\^~>=<]*\d[A-Za-z0-9.+-]*|any)['\"]?\s*$"
LINES = {
    "pubspec.yaml": ("dart", _PAIR),
    "requirements.txt": ("python", r"^\s*([A-Za-z0-9_.-]+)\s*(?:[=<>!~]=?\s*([A-Za-z0-9.*]+))?"),
    "go.mod": ("go", r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+(v\S+)"),
    "Cargo.toml": ("rust", r"^\s*([A-Za-z0-9_-]+)\s*=\s*(?:\{\s*version\s*=\s*)?\"([\^~>=<]*\d[^\"]*)\""),
    "Gemfile": ("ruby", r"^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?"),
    "build.gradle": ("java", r"^\s*(?:implementation|api|compile|testImplementation)\s*\(?['\"]([^:'\"]+:[^:'\"]+):([^'\"]+)['\"]"),
}
JSON = {"package.json": ("node", ("dependencies", "devDependencies")), "composer.json": ("php", ("require", "require-dev"))}


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dependencies(files: DataFrame) -> DataFrame:
    """``file_id, ecosystem, package, version``; a version that is not given is empty. Unreadable manifests have none."""
    f = files.where("content is not null and file_path is not null").select("file_id", _name(F.col("file_path")).alias("manifest"), "content").where(F.col("manifest").isin(*LINES, *JSON))
    out = None
    by_line = f.where(F.col("manifest").isin(*LINES)).select("file_id", "manifest", F.explode(F.split("content", "\n")).alias("line"))
    for name, (ecosystem, pattern) in LINES.items():
        part = by_line.where((F.col("manifest") == name) & F.col("line").rlike(pattern) & ~F.col("line").rlike(r"^\s*(?:#|//|-|module |go )"))
        part = part.select("file_id", F.lit(ecosystem).alias("ecosystem"), F.regexp_extract("line", pattern, 1).alias("package"), F.regexp_extract("line", pattern, 2).alias("version"))
        out = part if out is None else out.unionByName(part)
    parsed = f.where(F.col("manifest").isin(*JSON)).select("file_id", "manifest", F.try_parse_json("content").alias("v"))
    for name, (ecosystem, fields) in JSON.items():
        for field in fields:
            e = parsed.where(F.col("manifest") == name).select("file_id", F.explode(F.try_variant_get("v", f"$['{field}']", "map<string,string>")).alias("package", "version"))
            out = out.unionByName(e.select("file_id", F.lit(ecosystem).alias("ecosystem"), "package", F.coalesce("version", F.lit("")).alias("version")))
    return out.distinct()
