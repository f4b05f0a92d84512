"""Keyed maintenance of snapshot tables: upserts, first and last wins, deletions, change plans, run metrics.

A table format with MERGE is not assumed: each function returns the next snapshot as a frame. Keys compare null-safely, so
rows whose key holds nulls are deduplicated like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def _pick(rows: DataFrame, keys: list[str], order: list[str], by) -> DataFrame:
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*[by(F.col(c), at).alias(c) for c in rows.columns if c not in keys])


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the greatest by ``order``; partial aggregation, so a frequent key is combined before the shuffle.

    Each column is an aggregate of its own, so those that nobody reads are pruned down to the scan. All of them meet the same
    rows in the same sequence and compare the same order, so that on ties they still come from one row.
    """
    return _pick(rows, keys, order, F.max_by)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the least by ``order``, as ``last_wins``."""
    return _pick(rows, keys, order, F.min_by)


def merge(stored: DataFrame, incoming: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """Stored rows with the incoming ones upserted by key, or with only the new keys inserted if not ``update``."""
    if update:
        kept = stored.join(incoming, null_safe(stored, incoming, keys), "left_anti")
        return kept.unionByName(incoming)
    return stored.unionByName(incoming.join(stored, null_safe(incoming, stored, keys), "left_anti"))


def missing(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key is not current: what a run deletes. With nothing current that is every row."""
    return stored.join(current.select(*keys).distinct(), keys, "left_anti")


def present(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(current.select(*keys).distinct(), keys, "left_semi")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """The children whose parent is left (ON DELETE CASCADE)."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def change_plan(scanned: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The scanned keys with ``change``: new, changed (hash differs or the stored row holds an error) or unchanged."""
    old = stored.select(*keys, F.lower("content_hash").alias("old_hash"), F.col("error").alias("old_error"), F.lit(True).alias("known"))
    joined = scanned.select(*keys, F.lower("content_hash").alias("new_hash")).join(old, keys, "left")
    same = F.col("new_hash").eqNullSafe(F.col("old_hash")) & F.col("old_error").isNull()
    return joined.select(*keys, F.when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("change"))


def without_embedding(chunks: DataFrame, embeddings: DataFrame, model: str, dim: int) -> DataFrame:
    """Active chunks that have no active embedding of the model, dimension and their content."""
    have = embeddings.where((F.col("embedding_model") == model) & (F.col("embedding_dim") == dim) & (F.col("status") == "active")).select(F.col("chunk_id").alias("id"), "content_hash").distinct()
    return chunks.where(F.col("status") == "active").join(have, ["id", "content_hash"], "left_anti")


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects of scalars as one, the new values winning; null or unreadable ones count as empty."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    both = F.map_from_entries(F.concat(F.map_entries(F.map_filter(parse(old), lambda k, _: ~F.map_contains_key(parse(new), k))), F.map_entries(parse(new))))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both))))


def retarget_entities(edges: DataFrame, contracts: DataFrame, kinds: tuple[str, ...] = ("reads_table", "writes_table")) -> DataFrame:
    """Table edges whose entity is known point to its table, with confidence at least 0.86 and their old target kept.

    ``edges``: source_key, target_key, kind, entity, confidence; ``contracts``: entity, table_name (of several the greatest).
    """
    known = contracts.dropna().groupBy("entity").agg(F.max("table_name").alias("table_name"))
    hit = F.col("table_name").isNotNull() & F.col("kind").isin(*kinds)
    return edges.join(known, "entity", "left").select(
        "source_key", "kind", "entity",
        F.when(hit, F.concat(F.lit("db_table:"), "table_name")).otherwise(F.col("target_key")).alias("target_key"),
        F.when(hit, F.greatest("confidence", F.lit(0.86))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.col("target_key")).alias("normalized_from"),
    )


def resolved(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with the symbol they mean, confidence 0.85; the others are left out.

    ``refs``: ref_id, project_id, reference_kind, reference_name. Calls ``owner.method`` go to the first method of that name
    whose owner ends with the given text, by (qualified_name, id); other calls to the only method of their name.
    ``instantiates`` goes to the only constructor of the class, else like a type: to the type of that qualified name (the
    greatest id), else to the only type of that last segment. All joins are equalities on (project, last segment);
    names are reduced to distinct ones and methods to one an owner before, so a popular name is no hot key.
    """
    tail = lambda c: F.substring_index(c, ".", -1)
    head = lambda c: F.expr(f"substring({c}, 1, length({c}) - length(substring_index({c}, '.', -1)) - 1)")
    names = symbols.select("id", "project_id", "kind", "name", "qualified_name").dropna(subset=["id", "project_id", "name", "qualified_name"])
    refs = refs.withColumn("last", tail(F.col("reference_name")))
    methods = names.where("kind = 'method'").select("project_id", F.col("name").alias("last"), "id", "qualified_name", head("qualified_name").alias("owner"))
    only_method = methods.groupBy("project_id", "last").agg(F.count("*").alias("n"), F.min("id").alias("only_id")).where("n = 1").drop("n")
    calls = refs.where("reference_kind = 'calls'")
    dotted = calls.where("contains(reference_name, '.')").select("project_id", "reference_name", "last").distinct().withColumn("receiver", head("reference_name"))
    owners = methods.groupBy("project_id", "last", "owner").agg(F.min(F.struct("qualified_name", "id")).alias("method"))
    by_owner = (
        dotted.join(owners, ["project_id", "last"]).where(F.col("owner").endswith(F.col("receiver")))
        .groupBy("project_id", "reference_name").agg(F.min("method")["id"].alias("owner_id"))
    )
    called = calls.join(by_owner, ["project_id", "reference_name"], "left").join(only_method, ["project_id", "last"], "left").select("ref_id", F.coalesce("owner_id", "only_id").alias("target_id"))
    constructors = names.where("kind = 'constructor'").select("project_id", F.col("name").alias("reference_name"), "id").groupBy("project_id", "reference_name").agg(F.count("*").alias("n"), F.min("id").alias("only_id")).where("n = 1").drop("n")
    types = names.where(F.col("kind").isin("class", "interface", "enum", "annotation"))
    exact = types.groupBy("project_id", F.col("qualified_name").alias("reference_name")).agg(F.max("id").alias("exact_id"))
    only_type = types.groupBy("project_id", F.col("name").alias("last")).agg(F.count("*").alias("n"), F.min("id").alias("type_id")).where("n = 1").drop("n")
    typed = refs.where(F.col("reference_kind").isin("instantiates", "injects", "extends", "implements", "references"))
    told = (
        typed.join(constructors, ["project_id", "reference_name"], "left").join(exact, ["project_id", "reference_name"], "left").join(only_type, ["project_id", "last"], "left")
        .select("ref_id", F.coalesce(F.when(F.col("reference_kind") == "instantiates", F.col("only_id")), "exact_id", "type_id").alias("target_id"))
    )
    return called.unionByName(told).where("target_id is not null").withColumn("confidence", F.lit(0.85))


def counts(tables: dict[str, DataFrame], key: str = "project_id") -> DataFrame:
    """(key, NAME...): rows per key of each table, 0 where a table has none; null keys are left out."""
    parts = [rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).withColumn("of", F.lit(name)) for name, rows in tables.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("of") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables])


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the greatest id of each project."""
    return last_wins(runs, ["project_id"], ["id"])


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def clear_outputs(edges: DataFrame, chunks: DataFrame, symbols: DataFrame, changed: DataFrame, by: tuple[str, ...] = ("refinement",)) -> tuple[DataFrame, DataFrame]:
    """(edges, chunks) without what a refinement made from the changed files (``file_id``): edges it resolved that start at their symbols, and their chunks.

    Rows with null keys stay. ``changed`` may hold every file; with none nothing is cleared.
    """
    gone = changed.select("file_id").dropna().distinct()
    starts = symbols.join(gone, "file_id", "left_semi").select(F.col("id").alias("source_id")).distinct()
    made = F.coalesce(F.col("resolved_by").isin(*by), F.lit(False))
    kept = edges.where(~made).unionByName(edges.where(made).join(starts, "source_id", "left_anti").select(*edges.columns))
    return kept, chunks.join(gone, "file_id", "left_anti").select(*chunks.columns)


def embedding_id(chunk_id: Column, model: Column, dim: Column) -> Column:
    """The id of a chunk's vector of a model and dimension: the same each time it is written."""
    return F.substring(F.sha2(F.concat_ws("\x1f", chunk_id, model, dim.cast("string")), 256), 1, 32)


def upsert_embeddings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored vectors with the fresh ones (chunk_id, embedding_model, embedding_dim, ...) written over those of their id."""
    keyed = fresh.withColumn("id", embedding_id(F.col("chunk_id"), F.col("embedding_model"), F.col("embedding_dim"))).select(*stored.columns)
    return merge(stored, keyed, ["id"])


def typed_chunks(chunks: DataFrame, template: str, prefix: str = "artifact_") -> DataFrame:
    """The chunks whose type begins with a prefix and that were made by a template."""
    return chunks.where(F.col("chunk_type").startswith(prefix) & (F.col("template_version") == template))


def without_typed(chunks: DataFrame, template: str, prefix: str = "artifact_") -> DataFrame:
    """What is left when those are deleted; rows with a null type or template stay."""
    return chunks.where(~F.coalesce(F.col("chunk_type").startswith(prefix) & (F.col("template_version") == template), F.lit(False)))


def upsert_files(stored: DataFrame, scanned: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(next files, KEYS and id of the scanned ones): scanned rows over stored ones of their key, which keep their id; errors are cleared.

    A new row's id is a hash of its key.
    """
    ids = stored.select(*keys, F.col("id").alias("known_id"))
    named = scanned.join(ids, keys, "left").withColumn("id", F.coalesce("known_id", F.substring(F.sha2(F.concat_ws("\x1f", *keys), 256), 1, 32))).drop("known_id")
    rows = named.withColumn("error", F.lit(None).cast("string")).select(*stored.columns)
    return merge(stored, rows, keys), named.select(*keys, "id")


def cut_short(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(id) of methods stored with one line although their source line opens a brace and does not close it.

    ``symbols`` with path, start_line and end_line; ``texts``: path, text. Only files of such methods are split into lines.
    """
    short = symbols.where(F.col("kind").isin("method", "constructor") & (F.col("end_line") <= F.col("start_line"))).select("id", "path", "start_line")
    lines = texts.join(short.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    opens = F.col("line").contains("{") & ~F.col("line").contains("}")
    return lines.where(opens).select("path", (F.col("n") + 1).alias("start_line")).join(short, ["path", "start_line"]).select("id")
