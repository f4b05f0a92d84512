"""Queries of the retrieval tools and what they are built from, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.functions import hints as hint
from codeloom.operators import graph, store, vector
from codeloom.plans import tools
from codeloom.plans.planner import Step
from codeloom.session import read_table

QUESTION, HTTP_QUESTION, MODULE = "cancelInvoice", "invoice endpoint", "billing-core"
HINTS = [("发票", "invoice, voucher"), ("cart", "CartService、cart/basket"), ("retry", "retryPolicy not batch"), ("table", "db_table")]
QUERY_VECTOR = [((i * 37) % 11 - 5) / 5.0 for i in range(64)]


def _symbols(spark, d) -> DataFrame:
    return graph.latest(read_table(spark, d, "symbols"))


def _files(spark, d) -> DataFrame:
    return store.last_wins(read_table(spark, d, "files"), ["id"], ["indexed_at", "content_hash"])


def _bench(spark, d, **more) -> tools.Workbench:
    return tools.Workbench(_symbols(spark, d), read_table(spark, d, "edges"), _files(spark, d), **more)


def _told(evidence: DataFrame) -> DataFrame:
    return evidence.select("evidence_type", "file_path", "start_line", "symbol", F.col("position").cast("long").alias("position"))


def tool_artifacts(spark, d):
    return _told(tools.artifact_search(_bench(spark, d), Step("artifact_search", QUESTION)))


def tool_artifacts_http(spark, d):
    return _told(tools.artifact_search(_bench(spark, d), Step("artifact_search", HTTP_QUESTION)))


def tool_artifacts_scoped(spark, d):
    step = Step("artifact_search", "service", {"kinds": ["class", "interface"], "module": MODULE, "path_contains": "Service"})
    return _told(tools.artifact_search(_bench(spark, d), step))


def tool_relations(spark, d):
    return _told(tools.relation_search(_bench(spark, d), Step("relation_search", QUESTION, {"edge_kinds": ["calls", "contains"]})))


def tool_target_trace(spark, d):
    return _told(tools.target_trace(_bench(spark, d), Step("target_trace", "who calls InvoiceService", {"direction": "incoming", "edge_kinds": ["calls", "injects"]})))


def tool_execution(spark, d):
    return _told(tools.execution_trace(_bench(spark, d), Step("execution_trace", "cancelInvoice", {"target": "cancelInvoice"})))


def tool_vectors(spark, d):
    rows = read_table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), "embedding", F.when(F.col("label") % 2 == 0, "artifact_class").otherwise("project_knowledge").alias("chunk_type"), F.col("label").cast("string").alias("title"),
        F.lit("c").alias("content"), F.lit("p").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("symbol"),
    )
    bench = _bench(spark, d, vectors=rows, embed=lambda q: QUERY_VECTOR, top_k=20)
    return tools.vector_search(bench, Step("vector_search", "q", {"chunk_types": ["class"]})).select("evidence_type", "symbol", "score", F.col("position").cast("long").alias("position"))


def _texts(spark, d) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null and rel_path is not null").groupBy(F.col("rel_path").alias("path")).agg(F.max_by("text", "doc_id").alias("text"))


def tool_source_read(spark, d):
    """Lines around line 5 of the first six files by path that have a text, with the evidence's scope."""
    texts = _texts(spark, d)
    order = texts.select(F.col("path").alias("file_path"), F.lit(5).alias("start_line"), F.lit(6).alias("end_line"), F.lit("{}").alias("metadata"), F.lit("soft").alias("scope"))
    found = order.orderBy("file_path").limit(9)
    evidence = tools._complete(found.withColumn("position", F.dense_rank().over(tools.Window.orderBy("file_path")))).withColumn("scope", F.lit("soft"))
    out = tools.source_read(_bench(spark, d, texts=texts), Step("source_read", "q"), evidence)
    return out.select("file_path", "start_line", "end_line", F.md5("content_excerpt").alias("digest"), "metadata")


def _bodies(spark, d) -> DataFrame:
    return graph.latest(read_table(spark, d, "code_chunks")).where("status = 'active' and language = 'java' and symbol_id is not null")


def downstream_rank(spark, d):
    """How methods rank as what the methods named like the question call."""
    rows = tools.with_files(_bench(spark, d)).where("kind = 'method'")
    sources = rows.where(F.col("name") == QUESTION)
    calls = _bodies(spark, d).select(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\("), F.lit(1)).alias("r"), F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\("), F.lit(2)).alias("m"))
    each = calls.select(F.posexplode(F.arrays_zip("r", "m")).alias("n", "c")).select(F.col("c.r").alias("receiver"), F.col("c.m").alias("method"), "n")
    return tools.downstream_rank(rows, sources, each).select("id", F.col("rank").cast("long").alias("rank"), F.col("call_order").cast("long").alias("call_order"))


def same_class_names(spark, d):
    rows = _symbols(spark, d).where("kind = 'method'")
    calls = _bodies(spark, d).select(F.col("symbol_id").alias("id"), F.posexplode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([a-z]\w*)\s*\("), F.lit(1)))).alias("n", "method"))
    return tools.same_class_names(rows, calls)


def relation_order(spark, d):
    """Edges by the priority of their kind in a trace, path and line: the first two hundred."""
    bench = _bench(spark, d)
    found = tools.edge_evidence(bench, bench.edges, "edge", "relation_search")
    return tools.relation_order(found).limit(200).select("edge_id", "evidence_type", "file_path", tools.priority(F.col("evidence_type")).cast("long").alias("priority"))


def rows_by_ids(spark, d):
    """The classes named in a given order of their names' digests."""
    ids = [r["id"] for r in _symbols(spark, d).where("kind = 'interface'").orderBy(F.md5("id")).select("id").limit(25).collect()]
    return tools.rows_by_ids(_symbols(spark, d), [*ids, *ids[:3], "none"]).select("id", "qualified_name", "place")


def hint_weights(spark, d):
    questions = read_table(spark, d, "rag_messages").where("content is not null").select(F.col("id").alias("question_id"), F.col("content").alias("question"))
    return hint.hint_weights(questions, spark.createDataFrame(HINTS, "keyword string, value string")).withColumn("weight", F.col("weight").cast("long"))


def related_services(spark, d):
    return _symbols(spark, d).select("id", hint.related_service(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("metadata")).alias("service"))


def local_assignments(spark, d):
    return hint.assignments(_bodies(spark, d), "symbol_id")


def published_messages(spark, d):
    """What method bodies send, with destinations from local assignments and literals."""
    constants = spark.createDataFrame([("Topics.A", "a")], "alias string, value string")
    return hint.published(_bodies(spark, d), constants)


def module_scope(spark, d):
    rows = tools.with_files(_bench(spark, d))
    return rows.where(tools.in_module(MODULE, "qualified_name")).groupBy("kind").agg(F.count("*").alias("n"))


def path_prefix(spark, d):
    return _files(spark, d).where(F.col("path").startswith("library/")).select("id", "path")


def one_liners(spark, d):
    """Symbols that end where they begin."""
    return _symbols(spark, d).where("end_line <= start_line").select("id", "start_line", "end_line")


def typed_chunks(spark, d):
    return store.typed_chunks(graph.latest(read_table(spark, d, "code_chunks")), "chunk-v1").groupBy("chunk_type").agg(F.count("*").alias("n"))


def typed_chunks_deleted(spark, d):
    return store.without_typed(graph.latest(read_table(spark, d, "code_chunks")), "chunk-v1").groupBy("chunk_type").agg(F.count("*").alias("n"))


def embeddings_upserted(spark, d):
    """Vectors of the older half of a year with those of the newer half written over them by chunk, model and dimension."""
    rows = store.last_wins(read_table(spark, d, "chunk_embeddings").where("status = 'active'"), ["chunk_id", "embedding_model", "embedding_dim"], ["created_at", "content_hash"]).select("chunk_id", "embedding_model", "embedding_dim", "content_hash", "created_at")
    old = rows.where("created_at < '2025-07-01'").withColumn("content_hash", F.lit("old"))
    keyed = store.upsert_embeddings(rows.limit(0).withColumn("id", F.lit("")), old)
    return store.upsert_embeddings(keyed, rows.where("chunk_id < 'c' or created_at >= '2025-07-01'")).groupBy("embedding_model").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum((F.col("content_hash") == "old").cast("long")).alias("old"))


def outputs_cleared(spark, d):
    """Edges and chunks left when what came from library and batch files is cleared."""
    files = _files(spark, d)
    changed = files.where("path like 'library/%' or module_name like '%batch%'").select(F.col("id").alias("file_id"))
    edges, chunks = store.clear_outputs(read_table(spark, d, "edges"), graph.latest(read_table(spark, d, "code_chunks")), _symbols(spark, d), changed, ("name", "receiver", "import", "tree"))
    return edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.concat(F.lit("edge:"), "kind").alias("what"), "n").unionByName(chunks.groupBy("chunk_type").agg(F.count("*").alias("n")).select(F.concat(F.lit("chunk:"), "chunk_type").alias("what"), "n"))


def files_upserted(spark, d):
    """The stored files with the scanned ones written over them: how many rows, known ids, errors and changed hashes."""
    key = ["project_id", "path"]
    stored = store.last_wins(read_table(spark, d, "files").dropna(subset=key), key, ["indexed_at", "content_hash", "id"]).select("id", *key, "content_hash", "error")
    scans = store.last_wins(read_table(spark, d, "file_scans").dropna(subset=key).select(*key, "scanned_at", F.lower("content_hash").alias("content_hash")), key, ["scanned_at", "content_hash"]).select(*key, "content_hash")
    rows, _ = store.upsert_files(stored, scans, key)
    return rows.groupBy("project_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count("error").alias("errors"))


QUERIES = {
    q.__name__: q
    for q in (
        tool_artifacts, tool_artifacts_http, tool_artifacts_scoped, tool_relations, tool_target_trace, tool_execution, tool_vectors, tool_source_read, downstream_rank, same_class_names, relation_order,
        rows_by_ids, hint_weights, related_services, local_assignments, published_messages, module_scope, path_prefix, one_liners, typed_chunks, typed_chunks_deleted, embeddings_upserted, outputs_cleared, files_upserted,
    )
}

_S = "s as (select * from symbols where id is not null qualify row_number() over (partition by id order by updated_at desc nulls last) = 1)"
_F = "f as (select * from files qualify row_number() over (partition by id order by indexed_at desc nulls last, content_hash desc nulls last) = 1)"
_R = f"{_S}, {_F}, r as (select s.*, f.path, f.module_name, f.service_name from s join f on f.id = s.file_id)"
_C = "c as (select * from code_chunks where id is not null qualify row_number() over (partition by id order by updated_at desc nulls last) = 1)"
_B = f"{_C}, b as (select * from c where status = 'active' and language = 'java' and symbol_id is not null)"


def _holds(terms: list[str], columns: tuple[str, ...] = ("name", "qualified_name", "annotations", "metadata", "path")) -> str:
    return "(" + " or ".join(f"coalesce({c} ilike '%{t}%', false)" for t in terms for c in columns) + ")"


_ASK = ["cancelInvoice", "cancel", "Invoice"]
_FIRST = f"a as (select * from r where {_holds(_ASK)} order by path, kind, qualified_name, id limit 32)"
_RANK = """case when kind = 'route' then 0 when contains(lower(path), '/controller/') or lower(qualified_name) like '%controller' then 1 when contains(lower(path), '/web/') then 2
  when contains(lower(path), '/feign/') or contains(lower(qualified_name), 'feign') then 3 when contains(lower(path), 'application') or contains(lower(path), '/config/') then 8 else 5 end"""
_TOLD = "'artifact_' || kind as evidence_type, path as file_path, start_line, qualified_name as symbol"
_OWNER = "regexp_replace(qualified_name, '(^|\\.)[^.]*$', '')"
_HOP = "select e.* from edges e where e.kind in ('calls', 'contains') and (e.source_id in (select id from {0}) or e.target_id in (select id from {0})) order by e.kind, e.id limit 80"
_EDGE = """select 'PREFIX:' || e.kind as evidence_type, f.path as file_path, e.line as start_line, concat_ws(' -> ', s.qualified_name, t.qualified_name) as symbol, e.kind, e.id, e.hop
  from FROM e join s on s.id = e.source_id join s t on t.id = e.target_id join f on f.id = s.file_id"""
_HINT_ROWS = ", ".join(
    f"('{k.lower()}', '{t.lower()}', {max(2, min(len(k), 8))})" for k, v in HINTS for t in dict.fromkeys(x.lower() for x in hint.weight_terms(k, [v]))
)
_CALL = r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*\("

ORACLE = {
    "tool_artifacts": f"with {_R}, {_FIRST} select {_TOLD}, row_number() over (order by path, kind, qualified_name, id) as position from a",
    "tool_artifacts_http": f"""with {_R}, a as (select * from r where {_holds(["invoice", "endpoint", "api", "route", "controller", "mapping"])} order by path, kind, qualified_name, id limit 160)
      select {_TOLD}, row_number() over (order by {_RANK}, lower(path), start_line, qualified_name, id) as position from a""",
    "tool_artifacts_scoped": f"""with {_R}, a as (select * from r where kind in ('class', 'interface') and (module_name ilike '%{MODULE}%' or service_name ilike '%{MODULE}%' or path ilike '%{MODULE}%')
        and path ilike '%Service%' and {_holds(["service"])} order by path, kind, qualified_name, id limit 32)
      select {_TOLD}, row_number() over (order by path, kind, qualified_name, id) as position from a""",
    "tool_relations": f"""with {_R}, {_FIRST}, h1 as ({_HOP.format("a")}), n1 as (select id from (select source_id as id from h1 union select target_id from h1) where id not in (select id from a)),
      t2 as ({_HOP.format("n1")}), h2 as (select * from t2 where id not in (select id from h1)), x as (select *, 1 as hop from h1 union all select *, 2 from h2),
      g as ({_EDGE.replace("PREFIX", "edge").replace("FROM", "x")})
      select evidence_type, file_path, start_line, symbol, row_number() over (order by hop, kind, id) as position from g""",
    "tool_target_trace": f"""with {_R}, k as (select *, case when lower(name) = 'invoiceservice' or lower(qualified_name) = 'invoiceservice' then case when kind in ('db_table', 'data_contract') then 0 else 1 end else 2 end as priority
        from r where {_holds(["InvoiceService"], ("name", "qualified_name", "path"))}),
      a as (select * from k order by priority, path, qualified_name, id limit 48),
      x as (select *, 0 as hop from edges where kind in ('calls', 'injects') and target_id in (select id from a where kind <> 'db_column')),
      g as ({_EDGE.replace("PREFIX", "target_relation").replace("FROM", "x")}), h as (select * from g order by file_path, coalesce(start_line, 0), symbol, id limit 48),
      u as (select distinct evidence_type, file_path, start_line, symbol from (select evidence_type, file_path, start_line, symbol from h union all select 'target_match', path, start_line, qualified_name from a))
      select *, row_number() over (order by case evidence_type when 'target_match' then 2 else 99 end, file_path, coalesce(start_line, 0), symbol) as position from u""",
    "tool_execution": f"""with recursive {_R}, k as (select id, case when kind in ('method', 'constructor', 'route') and lower(name) = 'cancelinvoice' then 1
        when kind in ('method', 'constructor', 'route') and contains(lower(qualified_name), 'cancelinvoice') then 2 end as tier from s), e0 as (select * from k where tier = (select min(tier) from k)),
      calls as (select distinct source_id, target_id from edges where kind = 'calls'),
      walk(id, hop) as (select id, 0 from e0 union select c.target_id, w.hop + 1 from walk w join calls c on c.source_id = w.id where w.hop < 2),
      h as (select id, min(hop) as hop from walk group by 1),
      x as (select 'execution_method' as evidence_type, id, hop from h
        union all select 'execution_' || e.kind, e.target_id, min(h.hop) from edges e join h on h.id = e.source_id where e.kind in ('reads_table', 'writes_table', 'publishes', 'references', 'instantiates') group by e.kind, e.target_id),
      y as (select x.evidence_type, r.path as file_path, r.start_line, r.qualified_name as symbol, x.hop from x join r on r.id = x.id order by hop, evidence_type, symbol, file_path, start_line limit 48)
      select evidence_type, file_path, start_line, symbol, row_number() over (order by hop, evidence_type, symbol, file_path, start_line) as position from y""",
    "tool_vectors": f"""with v as (select cast(vec_id as varchar) as chunk_id, cast(label as varchar) as symbol, round(coalesce(list_cosine_similarity(embedding::double[], {QUERY_VECTOR}::double[]), 0), 6) as score from embeddings where label % 2 = 0)
      select 'vector_chunk:artifact_class' as evidence_type, symbol, score, row_number() over (order by score desc, chunk_id) as position from v order by score desc, chunk_id limit 20""",
    "tool_source_read": """with t as (select rel_path as path, arg_max(text, doc_id) as text from documents where text is not null and rel_path is not null group by 1 order by 1 limit 6),
      l as (select path, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as lines from t),
      w as (select path, lines, 2 as a, least(len(lines), 9) as z from l)
      select path as file_path, a as start_line, z as end_line, md5(array_to_string(list_slice(lines, a, z), chr(10))) as digest, '{"source":"source_read","evidence_scope":"soft"}' as metadata from w""",
    "downstream_rank": rf"""with {_R}, {_B}, m as (select *, {_OWNER} as owner from r where kind = 'method'), src as (select * from m where name = '{QUESTION}'),
      l as (select unnest(regexp_extract_all(content, '{_CALL}', 1)) as receiver, unnest(regexp_extract_all(content, '{_CALL}', 2)) as method, generate_subscripts(regexp_extract_all(content, '{_CALL}', 2), 1) - 1 as n from b),
      q as (select method, upper(receiver[1]) || receiver[2:] as cls, min(n) as n from l group by 1, 2),
      h as (select m.id, min(case when ends_with(m.owner, '.' || q.cls) then 0 when contains(m.qualified_name, q.cls) then 1 end) as rr, min(q.n) as call_order from m join q on q.method = m.name group by 1)
      select m.id, cast(coalesce(h.rr, case when m.id in (select id from src) then 9 when m.path in (select path from src) then 2 when m.owner in (select owner from src) then 3 else 6 end) as bigint) as rank, cast(h.call_order as bigint) as call_order
      from m left join h on h.id = m.id""",
    "same_class_names": rf"""with {_S}, {_B}, m as (select id, {_OWNER} as owner from s where kind = 'method'),
      l as (select symbol_id as id, id as chunk, unnest(regexp_extract_all(content, '\b([a-z]\w*)\s*\(', 1)) as method, generate_subscripts(regexp_extract_all(content, '\b([a-z]\w*)\s*\(', 1), 1) as n from b),
      d as (select id, chunk, method, min(n) as n from l group by 1, 2, 3), o as (select id, chunk, method, row_number() over (partition by id, chunk order by n) as n from d),
      k as (select id, method from o qualify row_number() over (partition by id order by n, method) <= 80)
      select distinct m.owner || '.' || k.method as qualified_name from m join k on k.id = m.id""",
    "relation_order": f"""with {_R}, x as (select *, 0 as hop from edges), g as ({_EDGE.replace("PREFIX", "edge").replace("FROM", "x")})
      select id as edge_id, evidence_type, file_path, cast(case evidence_type when 'edge:writes_table' then 0 when 'edge:defines_contract' then 1 else 99 end as bigint) as priority
      from g order by priority, file_path, coalesce(start_line, 0), symbol, id limit 200""",
    "rows_by_ids": f"with {_S} select id, qualified_name, row_number() over (order by md5(id)) - 1 as place from s where kind = 'interface' order by md5(id) limit 25",
    "hint_weights": f"""with h(k, term, w) as (values {_HINT_ROWS}), q as (select id as question_id, lower(content) as question from rag_messages where content is not null)
      select question_id, term, cast(max(w) as bigint) as weight from q join h on contains(q.question, h.k) group by 1, 2""",
    "related_services": f"""with {_S}, k as (select id, kind, name, qualified_name, case when json_valid(metadata) then json_extract(metadata, '$.service') end as j from s)
      select id, coalesce(case when json_type(j) = 'VARCHAR' and trim(j ->> '$') <> '' then j ->> '$' end, case when starts_with(qualified_name, kind || ':') then substr(qualified_name, length(kind) + 2) end, name) as service from k""",
    "local_assignments": rf"""with {_B}, l as (select symbol_id, unnest(regexp_extract_all(content, '{hint.ASSIGNMENT}', 1)) as name, trim(unnest(regexp_extract_all(content, '{hint.ASSIGNMENT}', 2))) as value from b)
      select distinct symbol_id, name, value from l where value <> ''""",
    "published_messages": rf"""with {_B}, l as (select symbol_id, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) as t, generate_subscripts(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 as line from b),
      p as (select symbol_id, line, regexp_extract(t, '{hint.SEND}', 1) as sender, trim(regexp_extract(t, '{hint.SEND}', 2)) as raw from l),
      a as (select distinct symbol_id, unnest(regexp_extract_all(content, '{hint.ASSIGNMENT}', 1)) as name, trim(unnest(regexp_extract_all(content, '{hint.ASSIGNMENT}', 2))) as value from b),
      v as (select p.*, array_to_string(list_transform(regexp_split_to_array(coalesce(nullif(a.value, ''), p.raw), '\s*\+\s*'), lambda x: regexp_replace(trim(x), '^"(.*)"$', '\1')), '') as value
        from p left join a on a.symbol_id = p.symbol_id and a.name = p.raw where p.sender <> '')
      select distinct symbol_id, line, sender, raw, case when contains(value, ':') and not contains(value, '://') then trim(split_part(value, ':', 1)) else value end as topic,
        case when contains(value, ':') and not contains(value, '://') then nullif(trim(substr(value, strpos(value, ':') + 1)), '') end as tag from v""",
    "module_scope": f"with {_R} select kind, count(*) as n from r where module_name ilike '%{MODULE}%' or service_name ilike '%{MODULE}%' or path ilike '%{MODULE}%' or qualified_name ilike '%{MODULE}%' group by 1",
    "path_prefix": f"with {_F} select id, path from f where path like 'library/%'",
    "one_liners": f"with {_S} select id, start_line, end_line from s where end_line <= start_line",
    "typed_chunks": f"with {_C} select chunk_type, count(*) as n from c where starts_with(chunk_type, 'artifact_') and template_version = 'chunk-v1' group by 1",
    "typed_chunks_deleted": f"with {_C} select chunk_type, count(*) as n from c where not coalesce(starts_with(chunk_type, 'artifact_') and template_version = 'chunk-v1', false) group by 1",
    "embeddings_upserted": """with v as (select chunk_id, embedding_model, embedding_dim, created_at from chunk_embeddings where status = 'active'
        qualify row_number() over (partition by chunk_id, embedding_model, embedding_dim order by created_at desc nulls last, content_hash desc nulls last) = 1)
      select embedding_model, count(*) as n, count(*) as ids, cast(sum(case when chunk_id < 'c' or created_at >= '2025-07-01' then 0 else 1 end) as bigint) as old
      from v where created_at < '2025-07-01' or chunk_id < 'c' or created_at >= '2025-07-01' group by 1""",
    "outputs_cleared": f"""with {_S}, {_F}, {_C}, x as (select id from f where path like 'library/%' or module_name like '%batch%')
      select 'edge:' || kind as what, count(*) as n from edges where not coalesce(resolved_by in ('name', 'receiver', 'import', 'tree'), false) or source_id is null or source_id not in (select id from s where file_id in (select id from x)) group by 1
      union all select 'chunk:' || chunk_type, count(*) from c where file_id is null or file_id not in (select id from x) group by 1""",
    "files_upserted": """with o as (select * from files where project_id is not null and path is not null qualify row_number() over (partition by project_id, path order by indexed_at desc nulls last, content_hash desc nulls last, id desc) = 1),
      n as (select distinct project_id, path from file_scans where project_id is not null and path is not null),
      u as (select o.project_id, o.id, case when n.path is null then o.error end as error from o left join n using (project_id, path)
        union all select n.project_id, n.project_id || n.path, null from n anti join o using (project_id, path))
      select project_id, count(*) as n, count(distinct id) as ids, count(error) as errors from u group by 1""",
}
