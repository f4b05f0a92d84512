"""Queries of the training-data problems tagged llm, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import docpairs, messages as chat, mixing, neighbours, packing, pairs, pii, split, tokens
from codeloom.llm.sql import ORACLE  # noqa: F401
from codeloom.session import cut, read_table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(thread_db_id, reason) of the threads without a sound conversation."""
    return chat.conversations(read_table(spark, sf_dir, "rag_threads"), read_table(spark, sf_dir, "rag_messages"))[1]


def p7_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of the sound threads in order, with speaker, reply link and the root of the link tree."""
    return chat.conversations(read_table(spark, sf_dir, "rag_threads"), read_table(spark, sf_dir, "rag_messages"))[0]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(response_id, defect) of the defective answers."""
    return pairs.defects(pairs.answer_pairs(read_table(spark, sf_dir, "rag_threads"), read_table(spark, sf_dir, "rag_messages")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): pairs of cosine 0.85 or more of which one is among the 5 most similar of the other."""
    return neighbours.similar_pairs(read_table(spark, sf_dir, "chunk_embeddings"), neighbours.Settings(k=5, min_cosine=0.85))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar vectors of every usable vector, however similar."""
    near = neighbours.nearest(read_table(spark, sf_dir, "chunk_embeddings"), neighbours.Settings(k=5, recall=0.93))
    return near.withColumn("cosine", near["cosine"].cast("float"))


def p2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of ``p2_found`` with bins so small that groups are cut into cells, blocks and shares of queries."""
    return neighbours.similar_pairs(read_table(spark, sf_dir, "chunk_embeddings"), neighbours.Settings(k=5, min_cosine=0.85, bin_rows=100))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id) of the active chunks that had to be cut."""
    return split.pieces(read_table(spark, sf_dir, "code_chunks")).where("piece = 1").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all oversized active chunks with their own start lines."""
    return split.pieces(read_table(spark, sf_dir, "code_chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol_id) of the functions whose own docstring tells something."""
    return docpairs.pairs(read_table(spark, sf_dir, "symbols")).where("symbol_id = described_by").select("symbol_id")


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures with descriptions, also those taken over from a declaration elsewhere."""
    return docpairs.pairs(read_table(spark, sf_dir, "symbols"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or the parts of one that exceeds it, in a container of each capacity."""
    return packing.containers(tokens.with_tokens(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "pack_capacities"))


def p8_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by plain harmonic classes, for comparison."""
    return packing.harmonic(tokens.with_tokens(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "pack_capacities"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected texts with the number of their copies."""
    return mixing.mixed(tokens.with_tokens(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.mixed(tokens.with_tokens(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "mix_targets"))[1]


#: The key of placeholders and surrogates in these queries; a real run passes its own secret.
PII_KEY = b"codeloom-example-key"


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start_pos, pii_type) of every occurrence of personal information."""
    return pii.entities(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "name_lexicon")).select("doc_id", "start_pos", "pii_type")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal information replaced by typed placeholders."""
    return pii.redacted(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "name_lexicon"), PII_KEY)


def p10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct entities with their keyed, type-consistent surrogates."""
    return pii.surrogates(pii.entities(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "name_lexicon")), PII_KEY).drop("attempt")


def p10_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal information replaced by surrogates."""
    return pii.rewritten(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "name_lexicon"), PII_KEY)


def p10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, unsound): documents whose rewritten or redacted text is null where the given one is not, or the other way round."""
    given = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").isNull().alias("was_null"), F.length("text").alias("n"))
    new = p10_rewritten(spark, sf_dir).select("doc_id", "text", "replaced")
    unsound = F.col("text").isNull() != F.col("was_null")
    same_empty = (F.col("n") == 0) & (F.length("text") != 0)
    return given.join(new, "doc_id").select("doc_id", F.coalesce(unsound | F.coalesce(same_empty, F.lit(False)), F.lit(True)).alias("unsound"))


def p7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(thread_db_id, position, id, speaker) of the messages of the sound threads."""
    return p7_conversations(spark, sf_dir).select("thread_db_id", "position", "id", "speaker")


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, content, within): each chunk's text as its pieces without their overlaps give it again, and whether all are under the limit."""
    new = F.expr("substring(content, overlap_chars + 1)")
    parts = p3_pieces(spark, sf_dir).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece", new.alias("part")))).alias("p"), F.min(F.col("tokens") <= F.col("limit")).alias("within"))
    return parts.select("chunk_id", F.md5(F.array_join(F.transform("p", lambda x: x["part"]), "").cast("binary")).alias("content"), "within")


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capacity_id, texts, overfull, split_needlessly): the texts placed, the containers over capacity, the texts under it that are split."""
    placed = cut(p8_containers(spark, sf_dir))
    room = read_table(spark, sf_dir, "pack_capacities").select("capacity_id", "max_tokens")
    full = placed.groupBy("capacity_id", "container").agg(F.sum("tokens").alias("t")).join(room, "capacity_id").groupBy("capacity_id").agg(F.sum((F.col("t") > F.col("max_tokens")).cast("long")).alias("overfull"))
    texts = placed.groupBy("capacity_id", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("parts")).join(room, "capacity_id")
    each = texts.groupBy("capacity_id").agg(F.count("*").alias("texts"), F.sum(((F.col("t") <= F.col("max_tokens")) & (F.col("parts") > 1)).cast("long")).alias("split_needlessly"))
    return each.join(full, "capacity_id").select("capacity_id", "texts", "overfull", "split_needlessly")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, max_repeats, over_cap, far_off): by wanted source that has texts, those repeated too often, and whether its share is off by over 0.02."""
    mixture, report = mixing.mixed(tokens.with_tokens(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "mix_targets"))
    over = mixture.join(report.select("source", F.col("max_repeats").alias("most")), "source").groupBy("source").agg(F.sum((F.col("copies") > F.col("most")).cast("long")).alias("over_cap"))
    held = report.where("available_tokens > 0")
    total = held.agg(F.sum("target_share").alias("whole"))
    return held.join(over, "source").crossJoin(total).select("source", F.col("max_repeats").cast("long").alias("max_repeats"), "over_cap", (F.abs(F.col("actual_share") - F.col("target_share") / F.col("whole")) > 0.02).alias("far_off"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p2_cells": p2_cells,
    "p3_found": p3_found, "p3_pieces": p3_pieces,
    "p6_found": p6_found, "p6_pairs": p6_pairs,
    "p7_found": p7_found, "p7_conversations": p7_conversations,
    "p8_containers": p8_containers, "p8_harmonic": p8_harmonic,
    "p9_mixture": p9_mixture, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_redacted": p10_redacted, "p10_surrogates": p10_surrogates, "p10_rewritten": p10_rewritten, "p10_counts": p10_counts,
    "p7_order": p7_order, "p3_rejoined": p3_rejoined, "p8_checks": p8_checks, "p9_checks": p9_checks,
}
