"""Queries of the graph and store operators over the tables of a data folder, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.operators import graph, store
from codeloom.session import read_table

TERM, EXACT = "cancelInvoice", "invoice"
TRACE_TERMS = ["InvoiceService", "releaseCart"]
KHOP_KINDS = ["calls", "injects", "references"]


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, d, n) for n in names]


def _symbols(spark, d) -> DataFrame:
    return graph.latest(read_table(spark, d, "symbols"))


def _files(spark, d) -> DataFrame:
    return store.last_wins(read_table(spark, d, "files"), ["id"], ["indexed_at", "content_hash"])


def symbol_search(spark, d):
    return graph.search(_symbols(spark, d), EXACT).select("id", "kind", "name", "qualified_name")


def symbols_of_kind(spark, d):
    return _symbols(spark, d).where("kind = 'interface'").orderBy("name", "id").select("id", "name", "qualified_name")


def files_by_path(spark, d):
    return _files(spark, d).orderBy("path", "id").select("id", "project_id", "path", "language", "size_bytes")


def symbols_with_files(spark, d):
    return _symbols(spark, d).join(_files(spark, d).select(F.col("id").alias("file_id"), "path", "module_name"), "file_id").select("id", "kind", "path", "module_name")


def status_counts(spark, d):
    files, symbols, edges, chunks = _t(spark, d, "files", "symbols", "edges", "code_chunks")
    return store.counts({"files": files, "symbols": symbols, "edges": edges, "chunks": chunks})


def config_by_service(spark, d):
    """Names of configuration symbols with the sorted distinct services that hold them."""
    rows = _symbols(spark, d).where("kind = 'config'").join(_files(spark, d).select(F.col("id").alias("file_id"), "service_name", F.col("language").alias("resource_type")), "file_id")
    service = F.nullif(F.trim("service_name"), F.lit(""))
    return rows.groupBy("resource_type", "name").agg(F.array_join(F.array_sort(F.collect_set(service)), ",").alias("services"), F.count("*").alias("n"))


def callers(spark, d):
    return graph.callers(_symbols(spark, d), read_table(spark, d, "edges"), TERM).select("id", "kind", "qualified_name")


def callers_distinct(spark, d):
    return graph.callers(_symbols(spark, d), read_table(spark, d, "edges"), TERM, distinct=True).select("id", "kind", "qualified_name")


def callees(spark, d):
    return graph.callees(_symbols(spark, d), read_table(spark, d, "edges"), TERM).select("id", "kind", "qualified_name")


def _impact(depth):
    return lambda spark, d: graph.impact(_symbols(spark, d), read_table(spark, d, "edges"), TERM, depth).withColumn("depth", F.col("depth").cast("long"))


def relation_khop(spark, d):
    seeds = graph.named(_symbols(spark, d), TERM).select("id")
    return graph.expand(read_table(spark, d, "edges"), seeds, 3, KHOP_KINDS).withColumn("hop", F.col("hop").cast("long"))


def target_resolve(spark, d):
    return graph.targets(_symbols(spark, d), _files(spark, d), TRACE_TERMS).select("id", "kind", "path", F.col("priority").cast("long").alias("priority"))


def _trace(direction):
    def query(spark, d):
        found = graph.targets(_symbols(spark, d), _files(spark, d), TRACE_TERMS)
        return graph.trace(read_table(spark, d, "edges"), found, direction).select("id", "source_id", "target_id", "kind")
    return query


def source_expansion(spark, d):
    found = graph.named(_symbols(spark, d), TERM)
    return graph.direction_of(found, read_table(spark, d, "edges").where(F.col("kind").isin("calls", "implements", "extends", "injects", "references", "contains"))).select("id", "kind", "direction")


def edge_ends(spark, d):
    return graph.with_ends(read_table(spark, d, "edges"), _symbols(spark, d)).select("id", "kind", "source_kind", "source_name", "target_kind", "target_name")


def edge_paths(spark, d):
    return graph.with_ends(read_table(spark, d, "edges"), _symbols(spark, d), _files(spark, d)).select("id", "kind", "source_path", "target_path")


def top_outgoing(spark, d):
    return graph.top_edges(read_table(spark, d, "edges"), "source_id", "target_id", 16).select("source_id", "id", F.col("n").cast("long").alias("n"))


def top_incoming(spark, d):
    return graph.top_edges(read_table(spark, d, "edges"), "target_id", "source_id", 8).select("target_id", "id", F.col("n").cast("long").alias("n"))


def keyed_merge(spark, d):
    """Chunks split in stored and incoming by age, merged by id: the incoming win."""
    chunks = read_table(spark, d, "code_chunks").select("id", "content_hash", "status", "updated_at", "template_version")
    stored = store.last_wins(chunks.where("updated_at < '2025-07-01'"), ["id"], ["updated_at", "content_hash", "status"])
    incoming = store.last_wins(chunks.where("updated_at >= '2025-07-01'"), ["id"], ["updated_at", "content_hash", "status"])
    return store.merge(stored, incoming, ["id"]).select("id", "content_hash", "status")


def insert_ignore(spark, d):
    """Edges inserted by their natural key with nulls compared, existing ones kept."""
    edges = read_table(spark, d, "edges").select("id", "project_id", "source_id", "target_id", "kind", "line", "column_no")
    key = ["project_id", "source_id", "target_id", "kind", "line", "column_no"]
    half = F.col("created_at") < "2025-07-01"
    stamped = read_table(spark, d, "edges")
    stored = store.first_wins(stamped.where(half).select(*edges.columns), key, ["id"])
    incoming = store.last_wins(stamped.where(~half).select(*edges.columns), key, ["id"])
    return store.merge(stored, incoming, key, update=False).select("id", "source_id", "target_id", "kind")


def facts_first_wins(spark, d):
    return store.first_wins(read_table(spark, d, "edges").select("source_id", "target_id", "kind", "line", "id", "confidence"), ["source_id", "target_id", "kind", "line"], ["id"]).select("id", "confidence")


def files_deleted(spark, d):
    files, scans = _t(spark, d, "files", "file_scans")
    return store.missing(files, scans, ["project_id", "path"]).select("project_id", "path").distinct()


def files_kept(spark, d):
    files, scans = _t(spark, d, "files", "file_scans")
    return store.present(files, scans, ["project_id", "path"]).select("project_id", "path").distinct()


def symbols_left(spark, d):
    """Symbols that survive when the files that were not scanned are deleted."""
    files, scans = _t(spark, d, "files", "file_scans")
    left = store.present(files, scans, ["project_id", "path"])
    return store.cascade(_symbols(spark, d), left, "file_id").select("id", "file_id")


def change_plan(spark, d):
    files, scans = _t(spark, d, "files", "file_scans")
    key = ["project_id", "path"]
    now = store.last_wins(scans.select(*key, "scanned_at", F.lower("content_hash").alias("content_hash")), key, ["scanned_at", "content_hash"])
    old = store.last_wins(files.select(*key, "indexed_at", F.lower("content_hash").alias("content_hash"), "error"), key, ["indexed_at", "content_hash", "error"])
    return store.change_plan(now, old, key)


def missing_embeddings(spark, d):
    chunks, vectors = _t(spark, d, "code_chunks", "chunk_embeddings")
    return store.without_embedding(chunks, vectors, "tolvane-embed-64", 64).select("id", "content_hash").distinct()


def metadata_merge(spark, d):
    events = read_table(spark, d, "events")
    return events.select("event_id", store.merged_json(F.col("props"), F.concat(F.lit('{"seen":"'), F.col("event_type"), F.lit('"}'))).alias("merged"))


def entity_tables(spark, d):
    """Edges to entities retargeted to tables: suppliers of parts as entities, brands as tables."""
    lineitem, part = _t(spark, d, "lineitem", "part")
    edges = lineitem.select(
        F.concat(F.lit("order:"), F.col("l_orderkey")).alias("source_key"), F.concat(F.lit("entity:"), F.col("l_partkey")).alias("target_key"),
        F.when(F.col("l_returnflag") == "R", "writes_table").when(F.col("l_returnflag") == "A", "reads_table").otherwise("calls").alias("kind"),
        F.col("l_partkey").alias("entity"), (F.lit(0.7) + F.col("l_discount")).alias("confidence"),
    )
    contracts = part.where("p_size > 25").select(F.col("p_partkey").alias("entity"), F.lower("p_brand").alias("table_name"))
    out = store.retarget_entities(edges, contracts)
    return out.groupBy("kind", "target_key").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"), F.count("normalized_from").alias("normalized"))


def resolve_references(spark, d):
    """The edges of resolvable kinds as references by the name of their target, resolved again."""
    symbols, edges = _symbols(spark, d), read_table(spark, d, "edges")
    ends = symbols.select(F.col("id").alias("target_id"), "name", "qualified_name")
    refs = edges.where(F.col("kind").isin("calls", "instantiates", "injects", "extends", "implements", "references")).join(ends, "target_id").select(
        F.col("id").alias("ref_id"), "project_id", F.col("kind").alias("reference_kind"),
        F.when(F.col("id") % 3 == 0, F.col("qualified_name")).when(F.col("kind") != "calls", F.col("name")).otherwise(F.expr("substring_index(qualified_name, '.', -2)")).alias("reference_name"),
    )
    return store.resolved(refs, symbols)


def latest_runs(spark, d):
    return store.latest_run(read_table(spark, d, "index_runs")).select("project_id", "id", "status", "files_indexed")


def run_metrics(spark, d):
    runs = read_table(spark, d, "index_runs")
    return runs.groupBy("project_id", "status").agg(F.count("*").alias("runs"), F.sum("files_indexed").alias("files_indexed"), F.sum(F.size(F.from_json("errors", "array<string>"))).cast("long").alias("errors"))


QUERIES = {
    "symbol_search": symbol_search, "symbols_of_kind": symbols_of_kind, "files_by_path": files_by_path, "symbols_with_files": symbols_with_files,
    "status_counts": status_counts, "config_by_service": config_by_service, "callers": callers, "callers_distinct": callers_distinct, "callees": callees,
    "impact_depth_0": _impact(0), "impact_depth_1": _impact(1), "impact_depth_2": _impact(2), "impact_depth_3": _impact(3),
    "relation_khop": relation_khop, "target_resolve": target_resolve, "target_trace_in": _trace("incoming"), "target_trace_out": _trace("outgoing"),
    "target_trace_both": _trace("both"), "source_expansion": source_expansion, "edge_ends": edge_ends, "edge_paths": edge_paths,
    "top_outgoing": top_outgoing, "top_incoming": top_incoming, "keyed_merge": keyed_merge, "insert_ignore": insert_ignore,
    "facts_first_wins": facts_first_wins, "files_deleted": files_deleted, "files_kept": files_kept, "symbols_left": symbols_left,
    "change_plan": change_plan, "missing_embeddings": missing_embeddings, "metadata_merge": metadata_merge, "entity_tables": entity_tables,
    "resolve_references": resolve_references, "latest_runs": latest_runs, "run_metrics": run_metrics,
}

_S = "s as (select * from symbols qualify row_number() over (partition by id order by updated_at desc nulls last) = 1)"
_F = "f as (select * from files qualify row_number() over (partition by id order by indexed_at desc nulls last, content_hash desc nulls last) = 1)"
_NAMED = f"name = '{TERM}' or qualified_name ilike '%{TERM}%'"
_HIT = " or ".join(f"{c} ilike '%{t}%'" for t in TRACE_TERMS for c in ("name", "qualified_name", "path"))
_LOW = ", ".join(f"'{t.lower()}'" for t in TRACE_TERMS)
_FOUND = f"{_S}, {_F}, found as (select s.id, s.kind, f.path, s.name, s.qualified_name from s join f on f.id = s.file_id where {_HIT})"
_REACH = f"""recursive {_S}, l as (select distinct source_id, target_id from edges),
  walk(id, depth) as (
    select distinct l.source_id, 1 from l join s on s.id = l.target_id where {_NAMED.replace('name =', 's.name =').replace('qualified_name', 's.qualified_name')}
    union select l.source_id, w.depth + 1 from walk w join l on l.target_id = w.id where w.depth < DEPTH)"""


def _impact_sql(depth: int) -> str:
    if not depth:
        return "select id, cast(0 as bigint) as depth from symbols where false"
    return f"with {_REACH.replace('DEPTH', str(depth))} select id, cast(min(depth) as bigint) as depth from walk where id in (select id from s) group by id"


ORACLE = {
    "symbol_search": f"with {_S} select id, kind, name, qualified_name from s where name ilike '%{EXACT}%' or qualified_name ilike '%{EXACT}%' order by kind, qualified_name, id limit 100",
    "symbols_of_kind": f"with {_S} select id, name, qualified_name from s where kind = 'interface'",
    "files_by_path": f"with {_F} select id, project_id, path, language, size_bytes from f",
    "symbols_with_files": f"with {_S}, {_F} select s.id, s.kind, f.path, f.module_name from s join f on f.id = s.file_id",
    "status_counts": """select project_id, count(*) filter (t = 'f') as files, count(*) filter (t = 's') as symbols, count(*) filter (t = 'e') as edges, count(*) filter (t = 'c') as chunks
      from (select project_id, 'f' as t from files union all select project_id, 's' from symbols union all select project_id, 'e' from edges union all select project_id, 'c' from code_chunks)
      where project_id is not null group by 1""",
    "config_by_service": f"""with {_S}, {_F} select f.language as resource_type, s.name, coalesce(array_to_string(list_sort(list(distinct nullif(trim(f.service_name), '')) filter (nullif(trim(f.service_name), '') is not null)), ','), '') as services, count(*) as n
      from s join f on f.id = s.file_id where s.kind = 'config' group by all""",
    "callers": f"with {_S}, t as (select id from s where {_NAMED}) select s.id, s.kind, s.qualified_name from edges e join s on s.id = e.source_id where e.target_id in (select id from t)",
    "callers_distinct": f"with {_S}, t as (select id from s where {_NAMED}) select distinct s.id, s.kind, s.qualified_name from edges e join s on s.id = e.source_id where e.target_id in (select id from t)",
    "callees": f"with {_S}, t as (select id from s where {_NAMED}) select s.id, s.kind, s.qualified_name from edges e join s on s.id = e.target_id where e.source_id in (select id from t)",
    **{f"impact_depth_{n}": _impact_sql(n) for n in range(4)},
    "relation_khop": f"""with recursive {_S}, l as (select id, source_id, target_id from edges where kind in ({', '.join(repr(k) for k in KHOP_KINDS)})),
      both_ways as (select id, source_id as a, target_id as b from l union all select id, target_id, source_id from l),
      nodes(a, depth) as (select distinct id, 0 from s where {_NAMED} union select w.b, n.depth + 1 from nodes n join both_ways w on w.a = n.a where n.depth < 2),
      least_node as (select a, min(depth) as depth from nodes group by 1)
      select w.id as edge_id, cast(min(n.depth) + 1 as bigint) as hop from both_ways w join least_node n on n.a = w.a group by 1""",
    "target_resolve": f"""with {_FOUND} select id, kind, path, cast(case when lower(name) in ({_LOW}) or lower(qualified_name) in ({_LOW}) then case when kind in ('db_table', 'data_contract') then 0 else 1 end else 2 end as bigint) as priority from found""",
    "target_trace_in": f"with {_FOUND} select id, source_id, target_id, kind from edges where target_id in (select id from found)",
    "target_trace_out": f"with {_FOUND} select id, source_id, target_id, kind from edges where source_id in (select id from found)",
    "target_trace_both": f"with {_FOUND} select id, source_id, target_id, kind from edges where source_id in (select id from found) or target_id in (select id from found)",
    "source_expansion": f"""with {_S}, t as (select id from s where {_NAMED}) select id, kind, case when source_id in (select id from t) then 'outgoing' else 'incoming' end as direction from edges
      where kind in ('calls', 'implements', 'extends', 'injects', 'references', 'contains') and (source_id in (select id from t) or target_id in (select id from t))""",
    "edge_ends": f"with {_S} select e.id, e.kind, a.kind as source_kind, a.qualified_name as source_name, b.kind as target_kind, b.qualified_name as target_name from edges e join s a on a.id = e.source_id join s b on b.id = e.target_id",
    "edge_paths": f"with {_S}, {_F} select e.id, e.kind, x.path as source_path, y.path as target_path from edges e join s a on a.id = e.source_id join s b on b.id = e.target_id join f x on x.id = a.file_id join f y on y.id = b.file_id",
    "top_outgoing": "select source_id, id, n from (select *, row_number() over (partition by source_id order by kind, line nulls first, target_id, id) as n from edges) where n <= 16",
    "top_incoming": "select target_id, id, n from (select *, row_number() over (partition by target_id order by kind, line nulls first, source_id, id) as n from edges) where n <= 8",
    "keyed_merge": """with c as (select id, content_hash, status, updated_at, updated_at >= '2025-07-01' as late from code_chunks)
      select id, content_hash, status from c where updated_at is not null qualify row_number() over (partition by id order by late desc, updated_at desc, content_hash desc, status desc) = 1""",
    "insert_ignore": """with e as (select *, created_at >= '2025-07-01' as late from edges)
      select id, source_id, target_id, kind from e where created_at is not null
      qualify row_number() over (partition by project_id, source_id, target_id, kind, line, column_no order by late, case when late then -id else id end) = 1""",
    "facts_first_wins": "select id, confidence from edges qualify row_number() over (partition by source_id, target_id, kind, line order by id) = 1",
    "files_deleted": "select distinct project_id, path from files f where not exists (select 1 from file_scans s where s.project_id = f.project_id and s.path = f.path)",
    "files_kept": "select distinct project_id, path from files f where exists (select 1 from file_scans s where s.project_id = f.project_id and s.path = f.path)",
    "symbols_left": f"with {_S} select id, file_id from s where file_id in (select id from files f where exists (select 1 from file_scans c where c.project_id = f.project_id and c.path = f.path))",
    "change_plan": """with n as (select project_id, path, lower(content_hash) as h from file_scans qualify row_number() over (partition by project_id, path order by scanned_at desc nulls last, h desc nulls last) = 1),
      o as (select project_id, path, lower(content_hash) as h, error from files qualify row_number() over (partition by project_id, path order by indexed_at desc nulls last, h desc nulls last, error desc nulls last) = 1)
      select n.project_id, n.path, case when o.path is null then 'new' when n.h is not distinct from o.h and o.error is null then 'unchanged' else 'changed' end as change
      from n left join o on o.project_id = n.project_id and o.path = n.path""",
    "missing_embeddings": """select distinct id, content_hash from code_chunks c where status = 'active' and not exists (
      select 1 from chunk_embeddings e where e.chunk_id = c.id and e.content_hash = c.content_hash and e.embedding_model = 'tolvane-embed-64' and e.embedding_dim = 64 and e.status = 'active')""",
    "metadata_merge": """select event_id, '{"k":"' || json_extract_string(props, '$.k') || '","seen":"' || event_type || '"}' as merged from events""",
    "entity_tables": """with e as (select l_partkey, case l_returnflag when 'R' then 'writes_table' when 'A' then 'reads_table' else 'calls' end as kind, 0.7 + l_discount as c, p_partkey is not null and l_returnflag in ('R', 'A') as hit, p_brand
        from lineitem left join (select * from part where p_size > 25) on p_partkey = l_partkey)
      select kind, case when hit then 'db_table:' || lower(p_brand) else 'entity:' || l_partkey end as target_key, count(*) as n,
        round(sum(case when hit then greatest(c, 0.86) else c end), 4) as confidence, count(*) filter (hit) as normalized from e group by 1, 2""",
    "resolve_references": f"""with {_S}, r as (
        select e.id as ref_id, e.project_id, e.kind, case when e.id % 3 = 0 then t.qualified_name when e.kind <> 'calls' then t.name else array_to_string(string_split(t.qualified_name, '.')[-2:], '.') end as ref
        from edges e join s t on t.id = e.target_id where e.kind in ('calls', 'instantiates', 'injects', 'extends', 'implements', 'references')),
      q as (select *, string_split(ref, '.')[-1] as last, case when contains(ref, '.') then ref[:length(ref) - length(string_split(ref, '.')[-1]) - 1] end as receiver from r),
      m as (select project_id, name, id, qualified_name, qualified_name[:length(qualified_name) - length(string_split(qualified_name, '.')[-1]) - 1] as owner from s where kind = 'method'),
      m1 as (select project_id, name, min(id) as id from m group by 1, 2 having count(*) = 1),
      o as (select q.ref_id, arg_min(m.id, (m.qualified_name, m.id)) as id from q join m on m.project_id = q.project_id and m.name = q.last where q.kind = 'calls' and q.receiver is not null and ends_with(m.owner, q.receiver) group by 1),
      k1 as (select project_id, name, min(id) as id from s where kind = 'constructor' group by 1, 2 having count(*) = 1),
      ty as (select * from s where kind in ('class', 'interface', 'enum', 'annotation')),
      x as (select project_id, qualified_name, max(id) as id from ty group by 1, 2), t1 as (select project_id, name, min(id) as id from ty group by 1, 2 having count(*) = 1)
      select q.ref_id, case when q.kind = 'calls' then coalesce(o.id, m1.id) else coalesce(case when q.kind = 'instantiates' then k1.id end, x.id, t1.id) end as target_id, cast(0.85 as double) as confidence
      from q left join o on o.ref_id = q.ref_id left join m1 on m1.project_id = q.project_id and m1.name = q.last left join k1 on k1.project_id = q.project_id and k1.name = q.ref
      left join x on x.project_id = q.project_id and x.qualified_name = q.ref left join t1 on t1.project_id = q.project_id and t1.name = q.last
      where (case when q.kind = 'calls' then coalesce(o.id, m1.id) else coalesce(case when q.kind = 'instantiates' then k1.id end, x.id, t1.id) end) is not null""",
    "latest_runs": "select project_id, id, status, files_indexed from index_runs qualify row_number() over (partition by project_id order by id desc) = 1",
    "run_metrics": "select project_id, status, count(*) as runs, cast(sum(files_indexed) as bigint) as files_indexed, cast(sum(json_array_length(errors)) as bigint) as errors from index_runs group by 1, 2",
}
