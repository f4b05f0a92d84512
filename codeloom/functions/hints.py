"""Query hints, expansions and small pieces of text that retrieval works with."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import text as tx

#: What a question is searched with besides its own words, by a word in it.
EXPANSIONS = {
    "接口": ("api", "endpoint", "route", "controller", "mapping", "RestController", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping"),
    "路由": ("route", "endpoint", "mapping", "controller"),
    "http": ("api", "endpoint", "route", "controller", "mapping"),
    "api": ("endpoint", "route", "controller", "mapping"),
    "endpoint": ("api", "route", "controller", "mapping"),
}
#: Words that make a question one about HTTP interfaces.
HTTP_WORDS = ("接口", "路由", "http", "api", "endpoint", "route", "controller", "mapping")
#: Chunk types of the library.
KNOWLEDGE = ("project_knowledge", "project_knowledge_parent")


def expanded_query(question: str, hints: dict[str, list[str]] | None = None) -> str:
    """The question with what hints (as spelled) and the fixed expansions (letter case aside) add for words in it."""
    low = question.lower()
    terms = [question]
    for word, values in (hints or {}).items():
        if word and word in question:
            terms += values
    for word, values in EXPANSIONS.items():
        if word in low:
            terms += values
    return " ".join(dict.fromkeys(t.strip() for t in terms if t and t.strip()))


def is_http_question(question: str) -> bool:
    low = question.lower()
    return any(word in low for word in HTTP_WORDS)


def weight_terms(keyword: str, values: list[str]) -> list[str]:
    """The keyword, each whole value and its parts between commas, slashes and blanks, once each."""
    terms = [keyword]
    for value in values:
        whole = value.strip()
        terms += [whole, *(p.strip() for p in re.split(r"[,，、/\s]+", whole))]
    return list(dict.fromkeys(t for t in terms if t))


def term_weights(question: str, hints: dict[str, list[str]]) -> dict[str, int]:
    """Weights of the terms of the hints whose keyword the question holds: the keyword's length, kept within 2 and 8; the greatest counts."""
    low, weights = question.lower(), {}
    for keyword, values in hints.items():
        keyword = keyword.strip()
        if keyword and keyword.lower() in low:
            for term in weight_terms(keyword, values):
                weights[term.lower()] = max(weights.get(term.lower(), 1), max(2, min(len(keyword), 8)))
    return weights


def hint_weights(questions: DataFrame, hints: DataFrame) -> DataFrame:
    """(question_id, term, weight): ``term_weights`` for a table of questions (question_id, question).

    ``hints`` (keyword, value) is a table of fixed size; its keywords are matched inside the questions by one expression
    over an array of them, so questions are neither joined nor shuffled before the aggregation by (question, term).
    """
    listed = hints.where("trim(keyword) <> ''").groupBy(F.trim("keyword").alias("keyword")).agg(F.collect_set("value").alias("values")).limit(10_001).collect()
    if len(listed) > 10_000:
        raise ValueError("more than 10,000 hint keywords")
    made = [(r["keyword"].lower(), sorted({t.lower() for t in weight_terms(r["keyword"], r["values"])}), max(2, min(len(r["keyword"]), 8))) for r in listed]
    if not made:
        return questions.select("question_id", F.lit("").alias("term"), F.lit(0).alias("weight")).where("false")
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(t) for t in ts]).alias("terms"), F.lit(w).alias("w")) for k, ts, w in made])
    hit = questions.select("question_id", F.explode(F.filter(table, lambda h: F.contains(F.lower("question"), h["k"]))).alias("h"))
    return hit.select("question_id", F.explode("h.terms").alias("term"), F.col("h.w").alias("w")).groupBy("question_id", "term").agg(F.max("w").alias("weight"))


def related_service(kind: Column, name: Column, qualified_name: Column, metadata: Column) -> Column:
    """The service a symbol stands for: from its metadata, else what follows ``kind:`` in its qualified name, else its name."""
    after = F.when(F.startswith(qualified_name, F.concat(kind, F.lit(":"))), F.expr("substring(qualified_name, length(kind) + 2)"))
    return F.coalesce(tx.metadata_string(metadata, "service"), after, name)


#: A string given to a name: ``name = value;`` on one line.
ASSIGNMENT = r"\b([A-Za-z_]\w*)\s*=\s*([^=;\n][^;\n]*);"


def assignments(bodies: DataFrame, key: str) -> DataFrame:
    """(KEY, name, value): what a body gives to local names; a name with several values has several rows."""
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(ASSIGNMENT), F.lit(1)).alias("name"), F.regexp_extract_all("content", F.lit(ASSIGNMENT), F.lit(2)).alias("value"))
    return bodies.select(key, F.explode(pairs).alias("a")).select(key, "a.name", F.trim("a.value").alias("value")).where("value <> ''").distinct()


def string_value(expressions: DataFrame, constants: DataFrame, key: str) -> DataFrame:
    """(KEY, expression, value): string expressions as far as literals, constants and ``+`` tell them, else as they stand.

    ``expressions`` (KEY, expression) may use constants (alias, value) by any alias. Parts between plus signs are looked up
    one by one by an equi-join and put together in order; a part that is neither stays as its text.
    """
    known = constants.groupBy("alias").agg(F.min("value").alias("constant"))
    parts = expressions.select(key, "expression").distinct().select(key, "expression", F.posexplode(F.split("expression", r"\s*\+\s*")).alias("n", "part"))
    bare = F.trim("part")
    literal = F.when(bare.rlike(r'^".*"$'), F.expr("substring(trim(part), 2, length(trim(part)) - 2)"))
    told = parts.join(known, bare == F.col("alias"), "left").select(key, "expression", "n", F.coalesce(literal, "constant", bare).alias("v"))
    return told.groupBy(key, "expression").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda s: s["v"]), "").alias("value"))


def destination(value: Column) -> Column:
    """struct(topic, tag) of ``topic:tag``; a URL or a value without a colon is all topic."""
    split = value.contains(":") & ~value.contains("://")
    tag = F.nullif(F.trim(F.expr("substring(value, locate(':', value) + 1)")), F.lit(""))
    return F.struct(F.when(split, F.trim(F.substring_index(value, ":", 1))).otherwise(value).alias("topic"), F.when(split, tag).alias("tag"))


#: Sending calls: the sender, and its first argument up to a comma or the closing bracket.
SEND = r"\b([A-Za-z_]\w*)\.(?:send|syncSend|asyncSend|sendOneWay|convertAndSend|sendMessageInTransaction)\s*\(\s*([^,()\n]+)"


def published(bodies: DataFrame, constants: DataFrame, key: str = "symbol_id") -> DataFrame:
    """(KEY, line, sender, raw, topic, tag): what bodies send, the destination resolved by local assignments and constants.

    ``line`` counts the body's lines from 0. A name with several assignments gives a row for each distinct value.
    """
    lines = bodies.where(F.col(key).isNotNull()).select(key, F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("line", "t"))
    sent = lines.select(key, "line", F.regexp_extract("t", SEND, 1).alias("sender"), F.trim(F.regexp_extract("t", SEND, 2)).alias("raw")).where("sender <> ''")
    local = assignments(bodies, key).select(key, F.col("name").alias("raw"), F.col("value").alias("given"))
    meant = sent.join(local, [key, "raw"], "left").withColumn("expression", F.coalesce("given", "raw"))
    values = string_value(meant.select(key, "expression"), constants, key)
    return meant.join(values, [key, "expression"]).select(key, F.col("line").cast("long").alias("line"), "sender", "raw", destination(F.col("value")).alias("d")).select(key, "line", "sender", "raw", "d.topic", "d.tag").distinct()


def json_safe(value: object) -> object:
    """The value if JSON can hold it, else its text."""
    try:
        json.dumps(value)
    except (TypeError, ValueError):
        return str(value)
    return value


def strings(value: object) -> list[str]:
    """The non-blank items of a list as trimmed strings; of anything else none."""
    return [str(v).strip() for v in value if str(v).strip()] if isinstance(value, list) else []


def string(value: object) -> str | None:
    return value.strip() if isinstance(value, str) and value.strip() else None
