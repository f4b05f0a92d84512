"""Execution traces: what a question names, what it calls over two hops, which SQL and tables that touches, and what bodies say.

Everything joins on ids; bodies are split into lines in the JVM. Frames as in ``graph``; bodies are chunks with ``symbol_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.operators.ranking import first_terms
from codeloom.session import cut

#: Terms that entry points are looked for by at most.
MOST_ENTRY_TERMS = 20

CONTROL = r"\b(?:if|else|for|while|switch|catch|return|continue|break|throw)\b"
MESSAGE = r"\b[A-Za-z_]\w*\.(?:send|syncSend|asyncSend|sendOneWay|convertAndSend|sendMessageInTransaction)\s*\("
CALL = r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\("
GENERIC_CALLS = ("get", "set", "add", "put", "size", "equals", "toString", "println", "of", "isEmpty", "stream", "map", "filter", "collect")


def entry_points(symbols: DataFrame, terms: list[str]) -> DataFrame:
    """(id, tier) of what a question may mean, only the best tier that has any: 0 jobs annotated with the term, 1 methods,
    constructors and routes of exactly that name, 2 those whose qualified name holds it. Terms beyond
    ``MOST_ENTRY_TERMS`` are left out with a warning."""
    lowered = [t.lower() for t in first_terms(terms, MOST_ENTRY_TERMS)]
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    job = (F.col("kind") == "annotation_usage") & any_of([F.lower("name") == f"@xxljob {t}" for t in lowered])
    callable_ = F.col("kind").isin("method", "constructor", "route")
    exact = callable_ & F.lower("name").isin(lowered)
    part = callable_ & any_of([F.lower("qualified_name").contains(t) for t in lowered])
    tier = F.when(job, 0).when(exact, 1).when(part, 2)
    found = symbols.select("id", tier.alias("tier")).where("tier is not null")
    best = found.agg(F.min("tier").alias("best"))
    return found.join(best, F.col("tier") == F.col("best"), "left_semi")


def execution_trace(symbols: DataFrame, edges: DataFrame, terms: list[str], hops: int = 2, bodies: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """(evidence_type, symbol_id, hop): the methods a question names, those called from them in up to ``hops`` steps, each at
    its first, the SQL statements these and their callees map to, and the targets of read, write and publish edges of all.

    Statements come from ``maps_to_sql`` edges and from calls on mappers, told from ``bodies`` and unresolved ``refs``. Where
    symbols and edges have paths, publish edges of a service count for the method whose lines they are in.
    """
    calls = edges.where("kind = 'calls'").select("source_id", "target_id").dropna().distinct()
    reached = cut(entry_points(symbols, terms).select("id", F.lit(0).alias("hop")))
    frontier = reached.select("id")
    step = lambda from_: calls.join(from_.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    for hop in range(1, hops + 1):
        new = cut(step(frontier).join(reached, "id", "left_anti"))
        reached, frontier = reached.unionByName(new.withColumn("hop", F.lit(hop))), new
    last = step(frontier).join(reached, "id", "left_anti").withColumn("hop", F.lit(hops + 1))
    maps = edges.where("kind = 'maps_to_sql'").select(F.col("source_id").alias("id"), "target_id")
    statements = maps.join(reached.unionByName(last), "id").select(F.col("target_id").alias("id"), "hop")
    for called in [f(x) for f, x in ((body_calls, bodies), (ref_calls, refs)) if x is not None]:
        statements = statements.unionByName(mapper_statements(symbols, cut(called.join(reached, "id"))))
    statements = cut(statements.groupBy("id").agg(F.min("hop").alias("hop")).join(reached, "id", "left_anti"))
    every = reached.unionByName(statements)
    methods = every.join(symbols.select("id"), "id", "left_semi")
    touching = edges.where(F.col("kind").isin("reads_table", "writes_table", "publishes", "references", "instantiates"))
    touched = touching.select(F.col("source_id").alias("id"), "kind", "target_id").join(every, "id").select("kind", "target_id", "hop")
    if {"path", "line"} <= set(edges.columns) and {"path", "start_line", "end_line"} <= set(symbols.columns):
        held = symbols.select("id", "path", "start_line", "end_line").join(reached, "id").drop("id")
        sent = edges.where("kind = 'publishes'").select("path", "line", "kind", "target_id")
        touched = touched.unionByName(sent.join(held, "path").where("line between start_line and end_line").select("kind", "target_id", "hop"))
    return methods.select(F.lit("execution_method").alias("evidence_type"), F.col("id").alias("symbol_id"), "hop").unionByName(
        touched.groupBy(F.concat(F.lit("execution_"), "kind").alias("evidence_type"), F.col("target_id").alias("symbol_id")).agg(F.min("hop").alias("hop"))
    )


def body_calls(bodies: DataFrame) -> DataFrame:
    """(id, receiver, method): what the body of each symbol calls on something, without everyday calls."""
    pair = F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(CALL), F.lit(1)).alias("receiver"), F.regexp_extract_all("content", F.lit(CALL), F.lit(2)).alias("method")))
    return bodies.where("symbol_id is not null").select(F.col("symbol_id").alias("id"), pair.alias("c")).select("id", "c.receiver", "c.method").where(~F.col("method").isin(*GENERIC_CALLS)).distinct()


def ref_calls(refs: DataFrame) -> DataFrame:
    """The same from call references that are not resolved."""
    parts = F.split("reference_name", r"\.")
    dotted = refs.where("reference_kind = 'calls' and contains(reference_name, '.')")
    return dotted.select(F.col("source_id").alias("id"), F.element_at(parts, -2).alias("receiver"), F.element_at(parts, -1).alias("method")).where(~F.col("method").isin(*GENERIC_CALLS)).distinct()


def mapper_statements(symbols: DataFrame, called: DataFrame) -> DataFrame:
    """(id, hop) of the SQL statements that calls (receiver, method, hop) mean: of a receiver ending in "mapper" those whose
    qualified name ends with ``mapper#method``; if no receiver does, those of the method's name. One step after the caller."""
    mapper = F.lower("receiver").endswith("mapper")
    any_mapper = called.agg(F.coalesce(F.max(mapper), F.lit(False)).alias("any_mapper"))
    statements = symbols.where("kind = 'sql_statement'").select(F.col("id").alias("statement"), F.col("name").alias("method"), F.lower("qualified_name").alias("q"))
    meant = F.when(mapper, F.col("q").endswith(F.concat(F.lower("receiver"), F.lit("#"), F.lower("method")))).otherwise(~F.col("any_mapper"))
    return called.join(statements, "method").crossJoin(any_mapper).where(meant).select(F.col("statement").alias("id"), (F.col("hop") + 1).alias("hop"))


def body_details(bodies: DataFrame, most: int = 220) -> DataFrame:
    """(symbol_id, line, detail) of the first telling lines of each body: control before message before call."""
    lines = bodies.where("symbol_id is not null").select("symbol_id", F.posexplode(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n")).alias("line", "t"))
    kind = F.when(F.col("t").rlike(CONTROL), "control").when(F.col("t").rlike(MESSAGE), "message").when(F.col("t").rlike(CALL), "call")
    told = lines.select("symbol_id", "line", kind.alias("detail")).where("detail is not null")
    first = Window.partitionBy("symbol_id").orderBy("line", "detail")
    return told.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")


def called_names(content: Column) -> Column:
    """Distinct method names that a body calls on something, without everyday ones, in order."""
    return F.array_except(F.regexp_extract_all(content, F.lit(CALL), F.lit(2)), F.array(*[F.lit(n) for n in GENERIC_CALLS]))


def block_ends(bodies: DataFrame) -> DataFrame:
    """(id, first_line, last_line) of the first block of each body: from the line of its first brace to where all are closed.

    Lines count from 1; a body whose braces never close ends with its last line; one without a brace has no row.
    """
    lines = bodies.select("id", F.posexplode(F.split("content", "\n")).alias("line", "t"))
    count = lambda c: F.length("t") - F.length(F.replace("t", F.lit(c), F.lit("")))
    so_far = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = lines.select("id", (F.col("line") + 1).alias("line"), F.sum(count("{") - count("}")).over(so_far).alias("depth"), F.sum(count("{")).over(so_far).alias("opened")).where("opened > 0")
    return depth.groupBy("id").agg(F.min("line").alias("first_line"), F.coalesce(F.min(F.when(F.col("depth") <= 0, F.col("line"))), F.max("line")).alias("last_line"))


def as_evidence(rows: DataFrame, evidence_type: Column, source: str) -> DataFrame:
    """Symbol rows with path as evidence of the fixed nine fields."""
    return rows.select(
        evidence_type.alias("evidence_type"), F.lit(source).alias("source"), F.col("path").alias("file_path"), "start_line", "end_line", F.col("qualified_name").alias("symbol"), F.lit(1.0).alias("score"),
        F.concat_ws("; ", F.concat(F.lit("artifact="), "name"), F.concat(F.lit("kind="), "kind"), F.concat(F.lit("module="), "module_name")).alias("content_excerpt"),
        F.to_json(F.struct(F.col("id").alias("symbol_id"), "kind", "module_name")).alias("metadata"),
    )
