"""Source trees as frames: scan, decode, module and service of each file, constants, settings, snippets.

One ``binaryFile`` scan reads every file once. Paths are relative to the root with forward slashes; directories that hold no
sources are skipped by relative path, so a tree may lie anywhere.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

IGNORED = (".git", ".idea", "target", "build", "node_modules", ".mvn")
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle")
CONFIG_FILES = ("application.yml", "application.yaml", "application.properties", "bootstrap.yml", "bootstrap.yaml", "bootstrap.properties")
LIBRARY_LIMIT = 2 * 1024 * 1024


def _decode(data: bytes | None) -> str | None:
    if data is None:
        return None
    for name in ("utf-8", "gbk"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="ignore")


def decoded(content: Column | str) -> Column:
    """Bytes as text: UTF-8, else GBK, else UTF-8 without what cannot be read."""
    def run(column: pd.Series) -> pd.Series:
        return column.map(_decode)

    return F.pandas_udf(run, StringType())(content)


def language_of(path: Column) -> Column:
    """java, config, mybatis_xml, sql, html or markdown by a relative path; null for other files."""
    name = F.substring_index(path, "/", -1)
    rooted = F.concat(F.lit("/"), path)
    return (
        F.when(path.endswith(".java") & rooted.contains("/src/"), "java")
        .when(name.isin(*CONFIG_FILES), "config")
        .when(path.endswith(".xml") & rooted.rlike("/mappers?/"), "mybatis_xml")
        .when(path.endswith(".sql"), "sql")
        .when(path.endswith(".html") & rooted.contains("/templates/"), "html")
        .when(path.endswith(".md") & path.startswith("library/"), "markdown")
    )


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, size_bytes, modified_at, content_hash, text, module_name, service_name) of the sources below a root.

    Library documents over 2 MiB are left out. A missing root raises; an empty tree gives no rows.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape("/" + base.lstrip("/")) + "/", "")
    files = raw.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    kept = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(d) for d in IGNORED])))
    roots = kept.where(F.substring_index("path", "/", -1).isin(*BUILD_FILES)).select(F.regexp_replace("path", "/?[^/]+$", "").alias("dir")).distinct()
    sources = kept.withColumn("language", language_of(F.col("path"))).where("language is not null").where((F.col("language") != "markdown") | (F.col("size_bytes") <= LIBRARY_LIMIT))
    texts = sources.select("path", "language", "size_bytes", "modified_at", F.sha2("content", 256).alias("content_hash"), decoded("content").alias("text"))
    return with_services(with_modules(texts, roots))


def with_modules(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The files with module_name: the nearest directory above with a build file, else the part before ``src``, else null.

    Each path is exploded to its ancestors and joined to the roots by equality, the deepest match wins; library documents
    belong to the module ``library``.
    """
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    ancestors = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    nearest = ancestors.where("dir <> ''").join(roots, "dir").groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    second = F.when(F.get(parts, F.lit(1)) == "src", F.get(parts, F.lit(0)))
    name = F.when(F.col("language") == "markdown", "library").otherwise(F.coalesce(F.substring_index("dir", "/", -1), second))
    return files.join(nearest, "path", "left").withColumn("module_name", name).drop("dir")


def with_services(files: DataFrame) -> DataFrame:
    """The files with service_name: spring.application.name of their module's settings, in fixed order of the files, else the module."""
    order = F.array_position(F.array(*[F.lit(n) for n in CONFIG_FILES]), F.substring_index("path", "/", -1))
    flat = F.regexp_extract("text", r"(?m)^\s*spring\.application\.name\s*[=:]\s*[\"']?([^\s\"'#]+)", 1)
    nested = F.regexp_extract("text", r"(?m)^spring:\s*\n(?:[ \t]+.*\n|\s*\n)*?[ \t]+application:\s*\n[ \t]+name:\s*[\"']?([^\s\"'#]+)", 1)
    named = files.where("language = 'config'").select("module_name", order.alias("o"), F.when(flat != "", flat).otherwise(nested).alias("service")).where("service <> ''")
    chosen = named.groupBy("module_name").agg(F.min_by("service", "o").alias("service"))
    return files.join(chosen, "module_name", "left").withColumn("service_name", F.when(F.col("language") != "markdown", F.coalesce("service", "module_name"))).drop("service")


def masked_settings(path: str, text: str | None) -> dict[str, str]:
    """The settings of one properties or YAML file by dotted key, secrets masked; ``!error`` if it cannot be parsed."""
    import json

    import yaml

    from codeloom.functions.text import SECRET_KEY

    values: dict[str, str] = {}

    def flatten(data: object, prefix: str) -> None:
        if isinstance(data, dict):
            for key, value in data.items():
                flatten(value, f"{prefix}.{key}" if prefix else str(key))
        else:
            values[prefix] = data if isinstance(data, str) else json.dumps(data, ensure_ascii=False, default=str)

    try:
        if path.endswith(".properties"):
            for line in (text or "").splitlines():
                key, sign, value = line.strip().partition("=")
                if sign and not key.startswith("#"):
                    values[key.strip()] = value.strip()
        else:
            for document in yaml.safe_load_all(text or ""):
                flatten(document or {}, "")
    except yaml.YAMLError as error:
        values = {"!error": str(error).splitlines()[0]}
    return {k: "<redacted>" if re.search(SECRET_KEY, k) else v for k, v in values.items() if k}


def settings(files: DataFrame) -> DataFrame:
    """(path, key, value) of properties and YAML files, keys of nested maps joined by dots, secrets masked; lists as JSON.

    Files that cannot be parsed give one row with key ``!error``.
    """
    def parse(batches):
        for batch in batches:
            rows = [(path, k, v) for path, text in zip(batch["path"], batch["text"]) for k, v in masked_settings(path, text).items()]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return files.where("language = 'config'").select("path", "text").mapInPandas(parse, "path string, key string, value string")


def resources(values: DataFrame) -> DataFrame:
    """(path, resource_type, normalized_name) that settings name: database, redis, rabbitmq and kafka, with default ports."""
    from codeloom.functions.text import jdbc_target

    wanted = {
        "url": ["spring.datasource.url", "spring.datasource.druid.url"], "redis": ["spring.data.redis.host", "spring.redis.host"], "redis_port": ["spring.data.redis.port", "spring.redis.port"],
        "redis_db": ["spring.data.redis.database", "spring.redis.database"], "rabbit": ["spring.rabbitmq.host"], "rabbit_port": ["spring.rabbitmq.port"], "kafka": ["spring.kafka.bootstrap-servers"],
    }
    picked = {n: F.coalesce(*[F.max(F.when(F.col("key") == k, F.col("value"))) for k in keys]).alias(n) for n, keys in wanted.items()}
    per = values.where(F.col("key").isin([k for keys in wanted.values() for k in keys])).groupBy("path").agg(*picked.values())
    made = F.array(
        F.struct(F.lit("database").alias("t"), jdbc_target(F.col("url")).alias("n")),
        F.struct(F.lit("redis").alias("t"), F.concat(F.lit("redis://"), "redis", F.lit(":"), F.coalesce("redis_port", F.lit("6379")), F.lit("/"), F.coalesce("redis_db", F.lit("0"))).alias("n")),
        F.struct(F.lit("rabbitmq").alias("t"), F.concat(F.lit("rabbitmq://"), "rabbit", F.lit(":"), F.coalesce("rabbit_port", F.lit("5672"))).alias("n")),
        F.struct(F.lit("kafka").alias("t"), F.concat(F.lit("kafka://"), "kafka").alias("n")),
    )
    return per.select("path", F.explode(made).alias("r")).where("r.n is not null").select("path", F.col("r.t").alias("resource_type"), F.col("r.n").alias("normalized_name"))


def constants(files: DataFrame) -> DataFrame:
    """(alias, value) of ``static final String`` constants: package.Class.NAME, Class.NAME, and NAME where it has one value."""
    java = files.where("language = 'java'")
    package = F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    owner = F.regexp_replace(F.substring_index("path", "/", -1), r"\.java$", "")
    pairs = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(r'\bstatic\s+final\s+String\s+([A-Za-z_]\w*)\s*=\s*"([^"\n]*)"'), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "value"))])
    found = java.select(package.alias("package"), owner.alias("owner"), F.explode(pairs).alias("c")).select("package", "owner", "c.name", "c.value")
    single = found.groupBy("name").agg(F.min("value").alias("value"), F.countDistinct("value").alias("n")).where("n = 1").select(F.col("name").alias("alias"), "value")
    dotted = found.select(F.explode(F.array(F.concat_ws(".", F.nullif("package", F.lit("")), "owner", "name"), F.concat_ws(".", "owner", "name"))).alias("alias"), "value")
    return dotted.unionByName(single).distinct()


def hints(text: str) -> dict[str, list[str]]:
    """Query hints of a library document: ``key => a, b`` and the like; ``not x`` stays one phrase."""
    out: dict[str, list[str]] = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:[-*]\s+)?([^:：=>≈#`|\-][^:：=>≈]*?)\s*(?:=>|->|≈|：|:(?!//))\s*(\S.*)$", line)
        if m:
            words = re.findall(r"not\s+[^\s,，、/]+|[^\s,，、/]+", m[2])
            out.setdefault(m[1].strip(), []).extend(w for w in words if w not in out.get(m[1].strip(), []))
    return out


def snippets(files: DataFrame, evidence: DataFrame, pad: int = 3, most_lines: int = 60, most_files: int = 6) -> DataFrame:
    """(path, start_line, end_line, content): lines around the first evidence of each of the first files.

    ``evidence``: file_path, start_line, end_line, position. Null lines count as the first; windows end with the file.
    """
    first = evidence.where("file_path is not null").groupBy("file_path").agg(F.min_by(F.struct("start_line", "end_line"), "position").alias("e"), F.min("position").alias("position")).orderBy("position", "file_path").limit(most_files)
    lines = files.select(F.col("path").alias("file_path"), F.split(F.regexp_replace("text", "\r\n", "\n"), "\n").alias("lines"))
    start = F.greatest(F.lit(1), F.coalesce("e.start_line", F.lit(1)) - pad)
    end = F.least(F.size("lines"), F.coalesce("e.end_line", "e.start_line", F.lit(1)) + pad, start + most_lines - 1)
    return lines.join(first, "file_path").select(F.col("file_path").alias("path"), start.alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", start, F.greatest(end - start + 1, F.lit(0))), "\n").alias("content"))
