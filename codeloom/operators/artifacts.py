"""Text chunks for symbols: one per artifact with its nearest edges, and summaries by kind and file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.operators.graph import top_edges

#: Kinds that are artifacts of their own name, and those under another one.
DIRECT = ("bean", "cache_key", "class", "config", "constructor", "data_contract", "db_column", "db_table", "enum", "interface", "mapper", "mq_exchange", "mq_queue", "mq_tag", "mq_topic", "oauth_provider", "permission_rule", "remote_service", "resource", "service", "sql_statement")
STRUCTURAL = ("file", "import", "package")
SUMMARISED = ("annotation_usage", "field", "method", "parameter")
JOB_MARKS = ("XxlJob", "Scheduled")


def artifact_type(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols with ``artifact_type``: methods only if annotated or routed, annotation usages only for jobs; others by kind.

    Kinds that are only structure or only summarised have none; unknown kinds keep their name.
    """
    routed = edges.where("kind = 'maps_route'").select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct().withColumn("routed", F.lit(True))
    marked = F.coalesce(F.size(F.from_json("annotations", "array<string>")) > 0, F.lit(False))
    job = F.col("name").rlike("^@(?:" + "|".join(JOB_MARKS) + r")\b")
    kind = (
        F.when(F.col("kind").isin(*STRUCTURAL), None).when(F.col("kind") == "route", "api_route").when(F.col("kind").isin(*DIRECT), F.col("kind"))
        .when(F.col("kind") == "method", F.when(marked | F.coalesce("routed", F.lit(False)), "method")).when(F.col("kind") == "annotation_usage", F.when(job, "job"))
        .when(F.col("kind").isin(*SUMMARISED), None).otherwise(F.col("kind"))
    )
    return symbols.join(routed, "id", "left").withColumn("artifact_type", kind).drop("routed").where("artifact_type is not null")


def artifact_chunks(symbols: DataFrame, edges: DataFrame, outgoing: int = 16, incoming: int = 8) -> DataFrame:
    """(symbol_id, chunk_type, content) of every artifact: its names and its first outgoing and incoming edges in order."""
    typed = artifact_type(symbols, edges)
    ends = symbols.select(F.col("id").alias("other_id"), F.concat_ws(" ", "kind", "name").alias("other"))

    def lines(end: str, other: str, most: int, word: str) -> DataFrame:
        kept = edges.where(~F.col("kind").isin("annotated_by", "annotates", "contains"))
        few = top_edges(kept, end, other, most).select(F.col(end).alias("id"), F.col(other).alias("other_id"), "kind", "n").join(ends, "other_id")
        text = F.concat(F.lit(f"- {word} "), "kind", F.lit(": "), "other")
        return few.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda s: s["t"]), "\n").alias(word))  # at most ``most``

    joined = typed.join(lines("source_id", "target_id", outgoing, "outgoing"), "id", "left").join(lines("target_id", "source_id", incoming, "incoming"), "id", "left")
    content = F.concat_ws("\n", F.concat(F.lit("Artifact type: "), "artifact_type"), F.concat(F.lit("Name: "), "name"), F.concat(F.lit("Qualified name: "), "qualified_name"), "outgoing", "incoming")
    return joined.select(F.col("id").alias("symbol_id"), F.concat(F.lit("artifact_"), "artifact_type").alias("chunk_type"), content.alias("content"))
