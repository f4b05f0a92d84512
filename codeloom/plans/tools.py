"""The retrieval tools that a plan's steps name, each from a step and the evidence so far to more evidence.

Evidence is a frame of fixed columns (``EVIDENCE``). Limits are the tools' feature: what a question is answered from is a ranked,
short list, taken by TakeOrdered over all rows, never a sample. Frontiers stay distributed as in ``graph``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions import hints as hint
from codeloom.functions import text as tx
from codeloom.operators import graph, ranking, trace, vector
from codeloom.plans import planner
from codeloom.plans.planner import Plan, Step
from codeloom.session import cut
from codeloom.sources import workspace

EVIDENCE = ["evidence_type", "source", "file_path", "start_line", "end_line", "symbol", "score", "content_excerpt", "metadata"]
SCHEMA = "evidence_type string, source string, file_path string, start_line int, end_line int, symbol string, score double, content_excerpt string, metadata string, position int"
#: Terms of a question that a search looks for at most, as the planner puts the most telling first.
MOST_TERMS, MOST_TARGETS = 10, 8
#: Edges of one hop of a relation search at most, and edges that a source reading follows.
MOST_EDGES, MOST_RELATED = 80, 80
#: Order of evidence in traces and readings; others come after all of these.
TRACE_ORDER = {
    "target_relation:writes_table": 0, "edge:writes_table": 0, "target_relation:defines_contract": 1, "edge:defines_contract": 1, "target_match": 2, "table_usage": 3,
}
READ_KINDS = ("calls", "implements", "extends", "injects", "references", "contains")


@dataclass(frozen=True)
class Workbench:
    """What tools work on: the latest symbols, edges and files of a project, and where they are at hand vectors, texts and hints.

    ``vectors``: embedding with chunk_id, chunk_type, title, content, file_path, start_line, end_line, symbol; ``embed`` turns a
    question into a vector; ``texts``: path, text of the source files.
    """

    symbols: DataFrame
    edges: DataFrame
    files: DataFrame
    vectors: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    texts: DataFrame | None = None
    bodies: DataFrame | None = None
    hints: dict[str, list[str]] = field(default_factory=dict)
    top_k: int = 8
    depth: int = 2


def priority(evidence_type: Column, order: dict[str, int] = TRACE_ORDER, other: int = 99) -> Column:
    """The place of an evidence type in an order, ``other`` for one that is not in it."""
    table = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return F.coalesce(F.try_element_at(table, evidence_type), F.lit(other))


def positioned(evidence: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """The first ``limit`` rows with their ``position`` from 1; a limited frame is small enough for one window."""
    best = evidence.orderBy(*order).limit(limit) if limit else evidence
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("int")).select(*EVIDENCE, "position")


def question_terms(bench: Workbench, question: str) -> list[str]:
    """The search terms of one question on the driver."""
    found = bench.symbols.sparkSession.range(1).select(tx.query_terms(F.lit(question)).alias("t")).first()["t"]
    return [t for t in found if t.strip()]


def in_module(module: str, *more: str) -> Column:
    """Whether a row's module, service, path or further columns hold a name, letter case aside."""
    return graph.contains_any(["module_name", "service_name", "path", *more], [module])


def with_files(bench: Workbench) -> DataFrame:
    return bench.symbols.join(bench.files.select(F.col("id").alias("file_id"), "path", "module_name", "service_name"), "file_id")


def search_rows(bench: Workbench, question: str, kinds: list[str] = (), module: str | None = None, path_contains: str | None = None) -> DataFrame:
    """Symbols with their file's path that hold one of the first ``MOST_TERMS`` terms, within kinds, module and path."""
    rows = with_files(bench)
    if kinds:
        rows = rows.where(F.col("kind").isin(list(kinds)))
    if module:
        rows = rows.where(in_module(module))
    if path_contains:
        rows = rows.where(F.col("path").ilike(f"%{path_contains}%"))
    terms = question_terms(bench, question)[:MOST_TERMS]
    return rows.where(graph.contains_any(["name", "qualified_name", "annotations", "metadata", "path"], terms)) if terms else rows


def artifact_search(bench: Workbench, step: Step, evidence: DataFrame | None = None) -> DataFrame:
    """Symbols that a question, its hints and expansions name: by path, kind and qualified name; HTTP questions by ``http_rank``.

    A module without hits gives a marker instead.
    """
    question = hint.expanded_query(step.query, bench.hints)
    http = hint.is_http_question(question)
    module = _module(bench, step)
    rows = search_rows(bench, question, hint.strings(step.filters.get("kinds")), module, hint.string(step.filters.get("path_contains")))
    limit = ranking.limit_rule(bench.top_k, 20 if http else 4)
    first = cut(rows.orderBy("path", "kind", "qualified_name", "id").limit(limit))
    order = [F.col("file_path"), F.col("kind"), F.col("symbol"), F.col("id")]
    if http:
        order = [ranking.http_rank(F.col("kind"), F.col("file_path"), F.col("symbol")), F.lower("file_path"), F.col("start_line"), F.col("symbol"), F.col("id")]
    found = trace.as_evidence(first, F.concat(F.lit("artifact_"), "kind"), "artifact_search")
    keyed = found.withColumns({"kind": F.get_json_object("metadata", "$.kind"), "id": F.get_json_object("metadata", "$.symbol_id")})
    if module and first.isEmpty():
        mark = bench.files.where(in_module(module)).limit(1).select(F.lit("module_scope_empty").alias("evidence_type"), F.lit("artifact_search").alias("source"), F.lit(module).alias("symbol"))
        return _complete(mark.withColumn("position", F.lit(1)))
    return positioned(keyed, order)


def _complete(rows: DataFrame) -> DataFrame:
    """Rows with the columns of evidence that they lack as nulls."""
    types = dict(c.strip().split(" ") for c in SCHEMA.split(","))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in [*EVIDENCE, "position"]])


def _module(bench: Workbench, step: Step) -> str | None:
    named = hint.string(step.filters.get("module"))
    if named is None:
        return None
    best = ranking.resolve_module(bench.files, [named]).first()
    return best["module"] if best else named


def symbol_ids(evidence: DataFrame) -> DataFrame:
    """(id) of the symbols that evidence is about."""
    ids = F.from_json("metadata", "symbol_id string, source_id string, target_id string")
    return evidence.select(F.explode(F.array(ids["symbol_id"], ids["source_id"], ids["target_id"])).alias("id")).dropna().distinct()


def relation_search(bench: Workbench, step: Step, evidence: DataFrame | None = None) -> DataFrame:
    """Edges around the symbols of the evidence so far, else around what the question names, over up to four hops.

    Each hop takes the first ``MOST_EDGES`` edges by kind and id that touch the frontier, so a node with many edges bounds a
    hop and not the tool.
    """
    base = evidence if evidence is not None and not symbol_ids(evidence).isEmpty() else artifact_search(bench, step)
    kinds = hint.strings(step.filters.get("edge_kinds"))
    edges = bench.edges.where(F.col("kind").isin(kinds)) if kinds else bench.edges
    frontier, seen, all_ = symbol_ids(base), None, None
    for hop in range(1, max(1, min(bench.depth, 4)) + 1):
        touching = graph.trace(edges, frontier.withColumn("kind", F.lit("")), "both").orderBy("kind", "id").limit(MOST_EDGES).withColumn("hop", F.lit(hop))
        new = cut(touching if seen is None else touching.join(seen.select("id"), "id", "left_anti"))
        seen = new if seen is None else cut(seen.unionByName(new))
        ends = new.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        frontier = cut(ends.join(frontier, "id", "left_anti"))
        if frontier.isEmpty():
            break
    found = edge_evidence(bench, seen, "edge", "relation_search")
    return positioned(found, [F.col("hop"), F.col("kind"), F.col("edge_id")])


def edge_evidence(bench: Workbench, edges: DataFrame, prefix: str, source: str) -> DataFrame:
    """Edges as evidence: both ends' names, at the place of the source; further columns of the edges kept."""
    full = graph.with_ends(edges, bench.symbols).join(bench.files.select(F.col("id").alias("source_file_id"), "path"), "source_file_id")
    return full.select(
        F.concat(F.lit(f"{prefix}:"), "kind").alias("evidence_type"), F.lit(source).alias("source"), F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"),
        F.concat_ws(" -> ", "source_name", "target_name").alias("symbol"), F.coalesce("confidence", F.lit(1.0)).alias("score"),
        F.concat_ws(" ", "source_name", "kind", "target_name").alias("content_excerpt"), F.to_json(F.struct("source_id", "target_id", "kind")).alias("metadata"),
        *[F.col(c) for c in ("kind", "hop") if c in edges.columns], F.col("id").alias("edge_id"),
    )


def aggregate_query(bench: Workbench, step: Step, evidence: DataFrame | None = None) -> DataFrame:
    """Symbols of a dimension ranked for the question with its hints' weights and exclusions; see ``ranking.aggregated``."""
    group, _ = planner.group_for(hint.string(step.filters.get("group_by")), step.query)
    dimension = ranking.DIMENSIONS[group]
    rows, module, inside = with_files(bench), _module(bench, step), hint.string(step.filters.get("path_contains"))
    if module:
        rows = rows.where(in_module(module, "qualified_name"))
    elif inside:
        rows = rows.where(F.col("path").ilike(f"%{inside}%"))
    terms = ranking.prioritised(question_terms(bench, hint.expanded_query(step.query, bench.hints)))
    negative = bench.symbols.sparkSession.range(1).select(tx.negative_terms(F.lit(step.query)).alias("t")).first()["t"]
    best = ranking.aggregated(rows, dimension, terms, negative, hint.term_weights(step.query, bench.hints), ranking.limit_rule(bench.top_k, 4))
    return _complete(best.select(
        F.lit(f"aggregate:{group}").alias("evidence_type"), F.lit("aggregate_query").alias("source"), F.col("path").alias("file_path"), "start_line", F.col("start_line").alias("end_line"), F.col("label").alias("symbol"),
        F.col("score").cast("double").alias("score"), F.to_json(F.struct(F.col("id").alias("symbol_id"), "priority")).alias("metadata"), F.col("position"),
    ))


def target_trace(bench: Workbench, step: Step, evidence: DataFrame | None = None) -> DataFrame:
    """What an explicit target is and its relations in the asked direction, by ``TRACE_ORDER``, path, line and symbol."""
    explicit = [*hint.strings(step.filters.get("targets")), *filter(None, [hint.string(step.filters.get("target"))])]
    terms = planner.targets_in(step.query, explicit)[:MOST_TARGETS]
    if not terms:
        return _complete(evidence) if evidence is not None else bench.symbols.sparkSession.createDataFrame([], SCHEMA)
    limit = ranking.limit_rule(bench.top_k, 6)
    found = graph.targets(bench.symbols, bench.files, terms)
    kind = hint.string(step.filters.get("target_kind"))
    found = cut((found.where(F.col("kind") == kind) if kind else found).orderBy("priority", "path", "qualified_name", "id").limit(limit))
    kinds = hint.strings(step.filters.get("edge_kinds"))
    direction = step.filters.get("direction") if step.filters.get("direction") in ("incoming", "outgoing") else "both"
    near = graph.trace(bench.edges, found, direction, kinds or None)
    ranked = edge_evidence(bench, near, "target_relation", "target_trace")
    best = relation_order(ranked).limit(limit)
    modules = found.join(bench.files.select(F.col("id").alias("file_id"), "module_name"), "file_id")
    matches = trace.as_evidence(modules, F.lit("target_match"), "target_trace")
    both = matches.unionByName(best.select(*EVIDENCE)).dropDuplicates(["evidence_type", "file_path", "start_line", "symbol"])
    return positioned(both, [priority(F.col("evidence_type")), F.coalesce("file_path", F.lit("")), F.coalesce("start_line", F.lit(0)), F.coalesce("symbol", F.lit(""))])


def relation_order(evidence: DataFrame) -> DataFrame:
    """Edge evidence by its type's priority, path and line, then symbol and edge."""
    return evidence.orderBy(priority(F.col("evidence_type")), "file_path", F.coalesce("start_line", F.lit(0)), "symbol", "edge_id")


def execution_trace(bench: Workbench, step: Step, evidence: DataFrame | None = None) -> DataFrame:
    """The methods, statements and tables that a question's target runs through, ordered by hop, downstream rank and name."""
    explicit = [*hint.strings(step.filters.get("targets")), *filter(None, [hint.string(step.filters.get("target"))])]
    terms = planner.targets_in(step.query, explicit) or question_terms(bench, step.query)
    hops = cut(trace.execution_trace(bench.symbols, bench.edges, terms, bodies=bench.bodies))
    rows = hops.join(bench.symbols.select(F.col("id").alias("symbol_id"), "kind", "name", "qualified_name", "file_id", "start_line", "end_line"), "symbol_id").join(bench.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    made = rows.select(
        "evidence_type", F.lit("execution_trace").alias("source"), F.col("path").alias("file_path"), "start_line", "end_line", F.col("qualified_name").alias("symbol"), F.lit(1.0).alias("score"),
        F.concat_ws(" ", "kind", "name").alias("content_excerpt"), F.to_json(F.struct("symbol_id", "hop")).alias("metadata"), "hop",
    )
    return positioned(made, [F.col("hop"), F.col("evidence_type"), F.col("symbol"), F.col("file_path"), F.col("start_line")], ranking.limit_rule(bench.top_k, 6))


def vector_search(bench: Workbench, step: Step, evidence: DataFrame | None = None) -> DataFrame:
    """The chunks nearest to the question's vector, within the chunk types a filter names."""
    if bench.vectors is None or bench.embed is None:
        raise ValueError("vector_search needs vectors and an embedder")
    types = vector.chunk_types(hint.strings(step.filters.get("chunk_types")))
    rows = bench.vectors.where(F.col("chunk_type").isin(types)) if types else bench.vectors
    near = cut(vector.topk(rows, "chunk_id", "embedding", bench.embed(step.query), bench.top_k))
    told = near.join(rows.drop("embedding"), "chunk_id")
    made = told.select(
        F.concat(F.lit("vector_chunk:"), "chunk_type").alias("evidence_type"), F.lit("vector").alias("source"), "file_path", "start_line", "end_line", F.coalesce("symbol", "title").alias("symbol"), "score",
        F.col("content").alias("content_excerpt"), F.to_json(F.struct("chunk_id", "chunk_type", "title")).alias("metadata"), "chunk_id",
    )
    return positioned(made, [F.desc("score"), F.col("chunk_id")])


def read_scope(evidence: DataFrame) -> DataFrame:
    """(scope): hard if any evidence is, else soft if any is, else unscoped."""
    top = F.max(F.when(F.col("scope") == "hard", 2).when(F.col("scope") == "soft", 1).otherwise(0))
    return evidence.agg(F.coalesce(top, F.lit(0)).alias("n")).select(F.element_at(F.array(F.lit("unscoped"), F.lit("soft"), F.lit("hard")), F.col("n") + 1).alias("scope"))


def related(bench: Workbench, evidence: DataFrame) -> DataFrame:
    """The evidence with what its symbols are related to by ``READ_KINDS``, the first ``MOST_RELATED`` by kind and id after it."""
    seeds = symbol_ids(evidence)
    near = graph.direction_of(seeds, bench.edges.where(F.col("kind").isin(*READ_KINDS))).orderBy("kind", "id").limit(MOST_RELATED)
    other = F.when(F.col("direction") == "outgoing", F.col("target_id")).otherwise(F.col("source_id"))
    rows = near.select(other.alias("id"), F.col("kind").alias("edge_kind"), "direction").join(with_files(bench), "id")
    more = trace.as_evidence(rows, F.concat_ws(":", F.lit("source_relation"), "direction", "edge_kind"), "source_read")
    last = evidence.agg(F.coalesce(F.max("position"), F.lit(0)).alias("last"))
    ranked = more.withColumn("n", F.row_number().over(Window.orderBy("file_path", "start_line", "symbol", "evidence_type"))).crossJoin(last)  # at most MOST_RELATED rows
    return ranking.first_evidence([_complete(evidence), _complete(ranked.withColumn("position", F.col("last") + F.col("n")))])


def source_read(bench: Workbench, step: Step, evidence: DataFrame | None = None) -> DataFrame:
    """Lines of the files that the evidence and its relations point to, with the evidence's scope in the metadata."""
    empty = bench.symbols.sparkSession.createDataFrame([], SCHEMA)
    if bench.texts is None or evidence is None:
        return empty
    scope = read_scope(evidence if "scope" in evidence.columns else evidence.withColumn("scope", F.lit(None).cast("string")))
    found = workspace.snippets(bench.texts, cut(related(bench, evidence)))
    made = found.crossJoin(scope).select(  # one row of scope
        F.lit("source_snippet").alias("evidence_type"), F.lit("source_read").alias("source"), F.col("path").alias("file_path"), "start_line", "end_line", F.lit(None).cast("string").alias("symbol"), F.lit(1.0).alias("score"),
        F.col("content").alias("content_excerpt"), F.to_json(F.struct(F.lit("source_read").alias("source"), F.col("scope").alias("evidence_scope"))).alias("metadata"),
    )
    return positioned(made, [F.col("file_path"), F.col("start_line")])


TOOLS = {
    "artifact_search": artifact_search, "relation_search": relation_search, "aggregate_query": aggregate_query, "target_trace": target_trace, "execution_trace": execution_trace,
    "vector_search": vector_search, "source_read": source_read,
}
#: Tools that read tables of relations; whether one of them ran is part of an answer.
RELATIONAL = ("artifact_search", "relation_search", "aggregate_query")


def require(name: str):
    """A tool by name; an unknown name is an error."""
    if name not in TOOLS:
        raise KeyError(f"no tool named {name}")
    return TOOLS[name]


def used_relational(used: list[str]) -> bool:
    return bool(set(RELATIONAL) & set(used))


def registry(bench: Workbench) -> dict[str, planner.Tool]:
    """The tools as a plan's execution calls them; vector search only where there are vectors, source reading where there are texts."""
    names = [n for n in TOOLS if (n != "vector_search" or (bench.vectors is not None and bench.embed is not None)) and (n != "source_read" or bench.texts is not None)]
    return {n: (lambda step, found, tool=require(n): tool(bench, step, found)) for n in names}


def ask_evidence(bench: Workbench, question: str, ask_planner: Callable[[str], str | dict] | None = None, resolution: dict | None = None) -> tuple[DataFrame | None, list[str], Plan]:
    """(evidence, warnings, plan) of a question: planned, every step run once, the first of equal evidence kept."""
    plan = planner.plan_for(question, ask_planner, bench.texts is not None, resolution)
    evidence, warnings = planner.executed(plan, registry(bench))
    return evidence, warnings, plan


def module_of(evidence: DataFrame) -> str | None:
    """The module that evidence points to: of the first row outside the library that has one, else its path's root."""
    path = F.regexp_replace(F.coalesce("file_path", F.lit("")), r"\\", "/")
    library = (path == "library") | path.startswith("library/") | F.coalesce(F.get_json_object("metadata", "$.chunk_type").isin(*hint.KNOWLEDGE), F.lit(False))
    named = F.coalesce(F.nullif(F.get_json_object("metadata", "$.module_name"), F.lit("")), F.when(path.contains("/"), F.substring_index(path, "/", 1)))
    first = evidence.select("position", named.alias("module"), library.alias("library")).where("not library and module is not null").orderBy("position", "module").first()
    return first["module"] if first else None


def downstream_rank(candidates: DataFrame, sources: DataFrame, calls: DataFrame) -> DataFrame:
    """Candidate methods with ``rank`` for what the source methods call: (id, rank, call_order).

    ``candidates`` and ``sources``: id, name, qualified_name, path; ``calls``: receiver, method, n (order of the call). 0: the
    class is the receiver's; 1: the qualified name holds the receiver's class; 9: a source method itself; 2: of a source's
    file; 3: of a source's class; 6: else. The receiver's class is its name with a capital. Calls are joined by method name.
    """
    owner = F.expr("substring(qualified_name, 1, length(qualified_name) - length(substring_index(qualified_name, '.', -1)) - 1)")
    cls = F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)"))
    asked = calls.groupBy("method", cls.alias("cls")).agg(F.min("n").alias("n"))
    hit = candidates.select("id", F.col("name").alias("method"), "qualified_name", owner.alias("owner")).join(asked, "method")
    by_call = hit.groupBy("id").agg(
        F.min(F.when(F.col("owner").endswith(F.concat(F.lit("."), "cls")), 0).when(F.contains("qualified_name", "cls"), 1)).alias("receiver_rank"), F.min("n").alias("call_order")
    )
    flag = lambda c: F.lit(True).alias(c)
    out = candidates.withColumn("owner", owner).join(by_call, "id", "left")
    out = out.join(sources.select("id", flag("is_source")).distinct(), "id", "left").join(sources.select("path", flag("same_file")).distinct(), "path", "left").join(sources.select(owner.alias("owner"), flag("same_class")).distinct(), "owner", "left")
    rank = F.coalesce("receiver_rank", F.when(F.col("is_source"), 9).when(F.col("same_file"), 2).when(F.col("same_class"), 3).otherwise(6))
    return out.select("id", rank.alias("rank"), "call_order")


def same_class_names(sources: DataFrame, calls: DataFrame, most: int = 80) -> DataFrame:
    """(qualified_name) that unqualified calls of the sources may mean: each source's class with its own first ``most`` call names."""
    owner = F.expr("substring(qualified_name, 1, length(qualified_name) - length(substring_index(qualified_name, '.', -1)) - 1)")
    few = calls.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("n", "method"))).where(F.col("_r") <= most)
    return sources.select("id", owner.alias("owner")).join(few.select("id", "method"), "id").select(F.concat_ws(".", "owner", "method").alias("qualified_name")).distinct()


def rows_by_ids(rows: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of given ids, with ``place`` in the order of the ids; ids without a row are left out, of repeated ids the first counts."""
    order = {v: i for i, v in reversed(list(enumerate(ids)))}
    table = rows.sparkSession.createDataFrame([(k, v) for k, v in order.items()], "id string, place long")
    return rows.join(table, "id")
