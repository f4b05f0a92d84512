"""Graph reads over a symbol (vertex) table and an edge table: search, neighbours, impact, k-hop expansion, target traces.

Frames are plain DataFrames: symbols need id, kind, name, qualified_name, file_id; edges need id, source_id, target_id, kind,
line. Frontiers stay distributed; a loop sends only an emptiness test to the driver. Nulls in a compared column match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.operators import store
from codeloom.operators.ranking import first_terms
from codeloom.session import cut

#: Terms that targets are looked for by at most; more are reported by a warning.
MOST_TARGETS = 8


def latest(rows: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """One row per key, the one with the greatest ``order`` (nulls first); all columns kept, unread ones pruned at the scan."""
    return store.last_wins(rows.where(F.col(key).isNotNull()), [key], [order])


def contains_any(columns: list[str], terms: list[str]) -> Column:
    """Any of the columns holds any of the terms, letter case aside; ``%`` and ``_`` in a term are wildcards."""
    tests = [F.col(c).ilike(f"%{t}%") for t in terms for c in columns]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def search(symbols: DataFrame, term: str, limit: int = 100) -> DataFrame:
    """Symbols whose name or qualified name holds the term, by kind, qualified name and id, at most ``limit``."""
    return symbols.where(contains_any(["name", "qualified_name"], [term])).orderBy("kind", "qualified_name", "id").limit(limit)


def named(symbols: DataFrame, term: str) -> DataFrame:
    """Symbols that a query names: the exact name (case matters) or the term inside the qualified name (case aside)."""
    return symbols.where((F.col("name") == term) | F.col("qualified_name").ilike(f"%{term}%"))


def callers(symbols: DataFrame, edges: DataFrame, term: str, distinct: bool = False) -> DataFrame:
    """In-neighbours of the named symbols over every edge kind, once per edge, or once each if ``distinct``."""
    targets = named(symbols, term).select(F.col("id").alias("target_id"))
    found = edges.join(targets, "target_id", "left_semi").select(F.col("source_id").alias("id")).join(symbols, "id")
    return found.dropDuplicates(["id"]) if distinct else found


def callees(symbols: DataFrame, edges: DataFrame, term: str, distinct: bool = False) -> DataFrame:
    """Out-neighbours, as ``callers``."""
    sources = named(symbols, term).select(F.col("id").alias("source_id"))
    found = edges.join(sources, "source_id", "left_semi").select(F.col("target_id").alias("id")).join(symbols, "id")
    return found.dropDuplicates(["id"]) if distinct else found


def impact(symbols: DataFrame, edges: DataFrame, term: str, depth: int = 2) -> DataFrame:
    """(id, depth): symbols from which a named one is reached against the edges in up to ``depth`` steps, least step first.

    Depth 0 is empty. A named symbol appears only if it reaches one itself. Ids already found are not followed again, so
    cycles end; every step is one equi-join of the edges with the new frontier.
    """
    links = edges.select("source_id", "target_id").dropna().distinct()
    frontier = named(symbols, term).select(F.col("id").alias("target_id")).distinct()
    found = links.select(F.col("source_id").alias("id"), F.lit(0).alias("depth")).where("false")
    for step in range(1, depth + 1):
        reached = links.join(frontier, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
        fresh = reached.join(found, "id", "left_anti").withColumn("depth", F.lit(step))
        found = cut(found.unionByName(fresh))
        frontier = found.where(F.col("depth") == step).select(F.col("id").alias("target_id"))
        if frontier.isEmpty():
            break
    return found.join(symbols.select("id"), "id", "left_semi")


def expand(edges: DataFrame, seeds: DataFrame, hops: int, kinds: list[str] | None = None) -> DataFrame:
    """(edge_id, hop): edges met within ``hops`` undirected steps of the seeds (``id``), each at its first hop."""
    links = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    ends = links.select(F.col("id").alias("edge_id"), F.explode(F.array(F.struct(F.col("source_id").alias("at"), F.col("target_id").alias("to")), F.struct(F.col("target_id").alias("at"), F.col("source_id").alias("to")))).alias("e")).select("edge_id", "e.*")
    frontier = seeds.select(F.col("id").alias("at")).distinct()
    seen_nodes, seen = frontier, None
    for hop in range(1, hops + 1):
        met = ends.join(frontier, "at", "left_semi").select("edge_id", "to")
        new = met.select("edge_id").distinct().withColumn("hop", F.lit(hop))
        seen = cut(new if seen is None else seen.unionByName(new.join(seen, "edge_id", "left_anti")))
        frontier = cut(met.select(F.col("to").alias("at")).dropna().distinct().join(seen_nodes, "at", "left_anti"))
        seen_nodes = seen_nodes.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def with_ends(edges: DataFrame, symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Edges joined with both symbols, and with the files of both if given; columns prefixed source_ and target_."""
    def side(name: str) -> DataFrame:
        return symbols.select(F.col("id").alias(f"{name}_id"), F.col("kind").alias(f"{name}_kind"), F.col("qualified_name").alias(f"{name}_name"), F.col("file_id").alias(f"{name}_file_id"))

    out = edges.join(side("source"), "source_id").join(side("target"), "target_id")
    if files is not None:
        for name in ("source", "target"):
            out = out.join(files.select(F.col("id").alias(f"{name}_file_id"), F.col("path").alias(f"{name}_path")), f"{name}_file_id")
    return out


def target_rank(symbols: DataFrame, terms: list[str], table_kinds: tuple[str, ...] = ("db_table", "data_contract")) -> Column:
    """0 for an exact table, 1 for another exact name, 2 for a name or path that holds a term, else 5."""
    lowered = [t.lower() for t in terms]
    exact = F.lower("name").isin(lowered) | F.lower("qualified_name").isin(lowered)
    partial = reduce(lambda a, b: a | b, [F.lower(F.concat_ws(" ", "name", "qualified_name", "path")).contains(t) for t in lowered], F.lit(False))
    return F.when(exact & F.col("kind").isin(*table_kinds), 0).when(exact, 1).when(partial, 2).otherwise(5)


def targets(symbols: DataFrame, files: DataFrame, terms: list[str]) -> DataFrame:
    """The symbols that the first ``MOST_TARGETS`` terms may mean, with ``priority`` (see target_rank) and the path of their file."""
    terms = first_terms(terms, MOST_TARGETS)
    rows = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.where(contains_any(["name", "qualified_name", "path"], terms)).withColumn("priority", target_rank(rows, terms))


def trace(edges: DataFrame, found: DataFrame, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """Edges into (incoming), out of (outgoing) or touching (both) the found symbols, columns not excepted; each once."""
    ids = found.where(F.col("kind") != "db_column").select("id").distinct()
    links = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    incoming = links.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    outgoing = links.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    if direction == "incoming":
        return incoming
    return outgoing if direction == "outgoing" else incoming.unionByName(outgoing).dropDuplicates(["id"])


def direction_of(found: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that touch the found symbols with ``direction``: outgoing if the source is among them, else incoming."""
    ids = found.select("id").distinct()
    out = edges.join(ids.select(F.col("id").alias("source_id"), F.lit(True).alias("from_here")), "source_id", "left")
    both = out.join(ids.select(F.col("id").alias("target_id"), F.lit(True).alias("to_here")), "target_id", "left")
    return both.where("from_here or to_here").withColumn("direction", F.when(F.col("from_here"), "outgoing").otherwise("incoming")).drop("from_here", "to_here")


def top_edges(edges: DataFrame, end: str, other: str, most: int, salts: int = 32) -> DataFrame:
    """The first ``most`` edges of each node at ``end`` by kind, line, other end and id; a hot node is ranked in two steps."""
    order = [F.col("kind"), F.col("line").asc_nulls_first(), F.col(other), F.col("id")]
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    few = salted.withColumn("n", F.row_number().over(Window.partitionBy(end, "_salt").orderBy(*order))).where(F.col("n") <= most)
    return few.withColumn("n", F.row_number().over(Window.partitionBy(end).orderBy(*order))).where(F.col("n") <= most).drop("_salt")
