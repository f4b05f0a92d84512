"""From a source tree to tables: scan, extract, normalise, identify, resolve, merge, describe, and embed the chunks without vectors.

One scan and one extraction pass; everything after it is joins. ``refine`` gives the tables of a full build; with a stored
snapshot, ``refresh`` extracts the new and changed files only and takes the rest over, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.functions import text as tx
from codeloom.operators import artifacts, ranking, store, vector
from codeloom.session import cut
from codeloom.sources import extract, workspace


def scanned(spark: SparkSession, root: str, project: str) -> DataFrame:
    files = workspace.scan(spark, root)
    file_id = F.concat(F.lit("file-row:"), tx.digest(F.concat_ws(":", F.lit(project), "path")))
    return files.select(file_id.alias("id"), F.lit(project).alias("project_id"), "path", "language", "module_name", "service_name", "size_bytes", "modified_at", "content_hash", "text")


def tables(facts: DataFrame, project: str) -> dict[str, DataFrame]:
    """symbols, edges, refs, chunks and errors with ids; the first of equal facts by path and line counts."""
    own = ["file", "package", "import", "class", "interface", "enum", "annotation", "method", "constructor", "field", "parameter", "route", "annotation_usage", "bean"]
    named = (F.col("kind") != "annotation_usage") & F.col("qualified_name").startswith(F.concat("kind", F.lit(":")))
    key = F.when(named, F.col("qualified_name")).otherwise(F.concat_ws(":", "kind", "qualified_name"))
    shared = ~F.col("kind").isin(*own)
    symbol_id = F.when(shared, F.concat("kind", F.lit(":"), tx.digest(F.concat_ws(":", F.lit(project), key)))).otherwise(tx.symbol_id(F.lit(project), F.col("path"), F.col("kind"), F.col("qualified_name"), F.col("start_line")))
    found = facts.where("record = 'symbol'").withColumn("key", key).withColumn("id", symbol_id)
    symbols = store.first_wins(found.select("id", F.lit(project).alias("project_id"), "path", "key", "kind", "name", "qualified_name", "signature", "start_line", "end_line", "metadata"), ["id"], ["path", "start_line", "metadata"])
    keys = found.groupBy("path", "key").agg(F.min("id").alias("id"))
    anywhere = found.groupBy("key").agg(F.min("id").alias("any_id"))
    service = F.when(F.col("source").startswith("service:"), F.concat(F.lit("service:"), tx.digest(F.concat_ws(":", F.lit(project), "source"))))

    def ends(rows: DataFrame, column: str) -> DataFrame:
        mine = keys.select("path", F.col("key").alias(column), F.col("id").alias(f"{column}_here"))
        other = anywhere.select(F.col("key").alias(column), F.col("any_id").alias(f"{column}_any"))
        return rows.join(mine, ["path", column], "left").join(other, column, "left").withColumn(f"{column}_id", F.coalesce(f"{column}_here", f"{column}_any")).drop(f"{column}_here", f"{column}_any")

    edges = ends(ends(facts.where("record = 'edge'").select("path", "source", "target", "kind", F.col("start_line").alias("line"), "metadata"), "source"), "target")
    edges = edges.withColumn("source_id", F.coalesce("source_id", service)).where("source_id is not null and target_id is not null")
    edges = store.first_wins(edges.select("source_id", "target_id", "kind", "line", "path", "metadata"), ["source_id", "target_id", "kind", "line"], ["path", "metadata"])
    refs = ends(facts.where("record = 'ref'").select("path", "source", F.col("kind").alias("reference_kind"), F.col("name").alias("reference_name"), "start_line"), "source")
    refs = refs.select(tx.digest(F.concat_ws(":", "path", "source", "reference_kind", "reference_name", "start_line")).alias("ref_id"), F.lit(project).alias("project_id"), "source_id", "reference_kind", "reference_name", F.col("start_line").alias("line")).distinct()
    chunks = facts.where("record = 'chunk'").select(
        F.concat(F.lit("chunk:"), tx.digest(F.concat_ws(":", F.lit(project), "path", "kind", "name", "start_line", "content"))).alias("id"), "path", F.col("kind").alias("chunk_type"), F.col("name").alias("title"),
        "content", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"), F.lit("active").alias("status"), "metadata",
    ).dropDuplicates(["id"])
    return {"symbols": symbols, "edges": edges, "refs": refs, "chunks": chunks, "errors": facts.where("record = 'error'").select("path", F.col("content").alias("error"))}


def normalised(facts: DataFrame) -> DataFrame:
    """The facts with table edges of an entity pointed to the table its annotation names, by ``store.retarget_entities``."""
    value = lambda name: F.get_json_object("metadata", f"$.{name}")
    named = facts.where("record = 'edge'").select(F.col("source").alias("source_key"), F.col("target").alias("target_key"), "kind", value("entity").alias("entity"), value("confidence").cast("double").alias("confidence"))
    contracts = facts.where("record = 'symbol' and kind = 'data_contract'").select(F.col("name").alias("entity"), value("table").alias("table_name"))
    moved = store.retarget_entities(named.where("entity is not null").distinct(), contracts).where("normalized_from is not null")
    moved = moved.select(F.lit("edge").alias("record"), "kind", F.col("source_key").alias("source"), F.col("normalized_from").alias("target"), F.col("entity").alias("_entity"), F.col("target_key").alias("_target"), "confidence")
    told = F.to_json(F.struct("confidence", F.col("_entity").alias("entity"), F.lit("@TableName").alias("normalized_by"), F.col("target").alias("normalized_from")))
    joined = facts.withColumn("_entity", value("entity")).withColumn("_was", value("confidence").cast("double")).join(
        moved.groupBy("record", "kind", "source", "target", "_entity", "_target").agg(F.max("confidence").alias("_confidence")), ["record", "kind", "source", "target", "_entity"], "left"
    ).withColumn("confidence", F.greatest("_was", "_confidence"))
    hit = F.col("_target").isNotNull()
    return joined.withColumn("metadata", F.when(hit, told).otherwise(F.col("metadata"))).withColumn("target", F.coalesce("_target", "target")).select(*facts.columns)


def described(symbols: DataFrame, edges: DataFrame, files: DataFrame, project: str) -> DataFrame:
    """Chunks of the typed artifacts, and of the summarised kinds by file."""
    marks = edges.where("kind = 'annotated_by'").join(symbols.select(F.col("id").alias("target_id"), "name"), "target_id")
    marks = marks.groupBy(F.col("source_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_set("name"))).alias("annotations"))
    numbered = edges.withColumn("id", tx.digest(F.concat_ws(":", "source_id", "target_id", "kind", F.coalesce(F.col("line").cast("string"), F.lit("")))))
    typed = artifacts.artifact_chunks(symbols.join(marks, "id", "left"), numbered).join(symbols.select(F.col("id").alias("symbol_id"), "path", "name", "start_line", "end_line"), "symbol_id")
    typed = typed.select("path", "chunk_type", F.col("name").alias("title"), "content", "start_line", "end_line", "symbol_id", F.to_json(F.struct("symbol_id")).alias("metadata"))
    modules = files.select("path", "module_name", "service_name")
    groups = ranking.summaries(symbols.where(F.col("kind").isin(*artifacts.SUMMARISED)).join(modules.drop("service_name"), "path", "left")).join(modules.drop("module_name"), "path", "left")
    kind = F.concat("kind", F.lit("_summary"))
    line = lambda word, c: F.concat(F.lit(f"{word}: "), F.nullif(F.col(c), F.lit("")))
    content = F.concat_ws("\n", F.concat(F.lit("Artifact type: "), kind), line("Symbol kind summarized", "kind"), line("Source file", "path"), line("Module", "module_name"), line("Service", "service_name"), line("Symbols", "names"), line("Qualified symbols", "qualified_names"))
    told = groups.select(
        "path", F.concat(F.lit("artifact_"), kind).alias("chunk_type"), F.concat(kind, F.lit(": "), "path").alias("title"), content.alias("content"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"),
        F.lit("").alias("symbol_id"), F.to_json(F.struct("symbol_count")).alias("metadata"),
    )
    chunk_id = F.concat(F.lit("chunk:"), tx.digest(F.concat_ws(":", F.lit(project), "path", "chunk_type", "symbol_id", "content")))
    return typed.unionByName(told).select(chunk_id.alias("id"), "path", "chunk_type", "title", "content", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"), F.lit("active").alias("status"), "metadata")


def refine(spark: SparkSession, root: str, project: str, model: str = "hash", dim: int = 1024, provider: Callable[[list[str]], list[list[float]]] | None = None) -> dict[str, DataFrame]:
    """All tables of a tree: files, facts, symbols, edges (resolved references at 0.85 included), refs left, chunks, embeddings, errors."""
    files = cut(scanned(spark, root, project))
    return _built(files, cut(extract.facts(files)), project, None, model, dim, provider)


def _built(files: DataFrame, facts: DataFrame, project: str, vectors: DataFrame | None, model: str, dim: int, provider: Callable | None) -> dict[str, DataFrame]:
    named = extract.resource_facts(files, workspace.resources(workspace.settings(files)))
    told = extract.resolved_publishes(facts, cut(workspace.constants(files))).unionByName(named.select(*extract.COLUMNS))
    out = {"files": files, "facts": facts, **tables(cut(normalised(told)), project)}
    solved = store.resolved(out["refs"], out["symbols"])
    linked = out["refs"].join(solved.select("ref_id", "target_id"), "ref_id").where("source_id is not null").select("source_id", "target_id", F.col("reference_kind").alias("kind"), "line", F.lit("resolver").alias("path"), F.lit('{"confidence": 0.85}').alias("metadata"))
    out["edges"] = cut(store.merge(out["edges"], store.first_wins(linked, ["source_id", "target_id", "kind", "line"], ["path"]), ["source_id", "target_id", "kind", "line"], update=False))
    out["refs"] = out["refs"].join(solved.select("ref_id"), "ref_id", "left_anti")
    out["symbols"] = cut(out["symbols"])
    out["chunks"] = cut(out["chunks"].unionByName(described(out["symbols"], out["edges"], files, project)))
    out["embeddings"] = cut(_vectors(out["chunks"], vectors, model, dim, provider))
    return out


def _vectors(chunks: DataFrame, stored: DataFrame | None, model: str, dim: int, provider: Callable | None) -> DataFrame:
    """One row per chunk: the stored vectors that still hold, and new ones for the chunks without."""
    own = [F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dim"), F.lit("active").alias("status")]
    new = lambda rows: embedded(rows, dim, provider).select(F.col("id").alias("chunk_id"), "content_hash", *own, "embedding")
    if stored is None:
        return new(chunks)
    held = stored.where((F.col("embedding_model") == model) & (F.col("embedding_dim") == dim) & (F.col("status") == "active"))
    kept = held.join(chunks.select(F.col("id").alias("chunk_id"), "content_hash"), ["chunk_id", "content_hash"], "left_semi")
    return kept.unionByName(new(store.without_embedding(chunks, stored, model, dim)))


def refresh(spark: SparkSession, root: str, project: str, stored: dict[str, DataFrame], model: str = "hash", dim: int = 1024, provider: Callable[[list[str]], list[list[float]]] | None = None) -> dict[str, DataFrame]:
    """As ``refine``, with the facts of unchanged files and the vectors of unchanged chunks taken from a stored build; files no
    longer there drop out."""
    files = cut(scanned(spark, root, project))
    same = files.join(stored["files"].select("path", "content_hash", "language", "service_name"), ["path", "content_hash"], "left_semi")
    fresh = extract.facts(files.join(same.select("path"), "path", "left_anti").select(*files.columns))
    kept = stored["facts"].join(same.select("path"), "path", "left_semi").select(*extract.COLUMNS)
    return _built(files, cut(kept.unionByName(fresh)), project, stored.get("embeddings"), model, dim, provider)


def embedded(chunks: DataFrame, dim: int = 1024, provider: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 256) -> DataFrame:
    """(id, content_hash, embedding): vectors of chunks by a provider in batches, or hash embeddings without one.

    A provider that returns another number of vectors, or vectors of another length, fails the task.
    """
    if provider is None:
        def one(text: str) -> list[float]:
            row = [0.0] * dim
            for bucket, weight in vector.embed_query(text or "", dim).items():
                row[bucket] = weight
            return row

        provider = lambda texts: [one(t) for t in texts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                rows = provider(part["content"].tolist())
                if len(rows) != len(part) or any(len(r) != dim for r in rows):
                    raise ValueError("the provider returned vectors of another number or length")
                yield pd.DataFrame({"id": part["id"], "content_hash": part["content_hash"], "embedding": list(rows)})

    return chunks.select("id", "content_hash", "content").mapInPandas(run, "id string, content_hash string, embedding array<float>")
