"""Queries of ranking, aggregation, windows and chat over the tables of a data folder, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codeloom.functions import text as tx
from codeloom.operators import graph, ranking, store
from codeloom.session import read_table

TERMS = ["invoice", "cancelinvoice", "service"]
NEGATIVE = ["batch"]
HINTS = {"releasecart": 6, "cart": 2}
MODULE_TERMS = ["billing", "core", "depot-admin"]


def _rows(spark, d) -> DataFrame:
    symbols = graph.latest(read_table(spark, d, "symbols"))
    files = store.last_wins(read_table(spark, d, "files"), ["id"], ["indexed_at", "content_hash"])
    return symbols.join(files.select(F.col("id").alias("file_id"), "path", "module_name", "service_name"), "file_id")


def _aggregate(name, terms, negative=(), weights=None, limit=200):
    def query(spark, d):
        out = ranking.aggregated(_rows(spark, d), ranking.DIMENSIONS[name], terms, list(negative), weights, limit)
        return out.select("id", "label", "path", *[F.col(c).cast("long").alias(c) for c in ("negative", "priority", "score", "position")])
    return query


def aggregate_counts(spark, d):
    """Symbols by dimension: how many a dimension covers and how many distinct labels they have."""
    rows = _rows(spark, d)
    parts = [rows.where(F.col("kind").isin(*x.kinds)).select(F.lit(x.group_by).alias("group_by"), ranking.label(x).alias("label")) for x in ranking.DIMENSIONS.values() if not x.annotations]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("group_by").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


def http_ranked(spark, d):
    rows = _rows(spark, d).where("kind in ('class', 'interface', 'config')")
    rank = ranking.http_rank(F.col("kind"), F.col("path"), F.col("qualified_name")).cast("long").alias("rank")
    return rows.select("id", rank, "path").orderBy("rank", F.lower("path"), "id").limit(200)


def module_scores(spark, d):
    return ranking.module_scores(read_table(spark, d, "files"), MODULE_TERMS).withColumn("score", F.col("score").cast("long"))


def module_resolve(spark, d):
    return ranking.resolve_module(read_table(spark, d, "files"), MODULE_TERMS).withColumn("score", F.col("score").cast("long"))


def module_fallback(spark, d):
    """A module without hits: other services whose symbols its own call, and what those services configure."""
    rows, edges = _rows(spark, d), read_table(spark, d, "edges").where("kind = 'calls'")
    side = lambda n: rows.select(F.col("id").alias(f"{n}_id"), F.col("service_name").alias(f"{n}_service"), F.col("module_name").alias(f"{n}_module"), F.col("path").alias(f"{n}_path"))
    calls = edges.join(side("source"), "source_id").join(side("target"), "target_id").where("source_module = 'billing-core'")
    related = calls.select(F.col("target_service").alias("service"), F.col("source_path").alias("path"), "line").where("service is not null")
    tables = rows.where("kind = 'config'").select(F.col("service_name").alias("service"), F.col("name").alias("table_name"), "path", F.col("start_line").alias("line"))
    return ranking.module_fallback(read_table(spark, d, "files"), "billing-core", related, tables)


def evidence_merged(spark, d):
    """Evidence from chunks and from symbols, the first of equal ones."""
    chunks = read_table(spark, d, "code_chunks").select(F.col("chunk_type").alias("evidence_type"), F.col("file_id").alias("file_path"), "start_line", F.col("symbol_id").alias("symbol"), F.col("id").alias("position"))
    symbols = read_table(spark, d, "symbols").select(F.concat(F.lit("artifact_"), "kind").alias("evidence_type"), F.col("file_id").alias("file_path"), "start_line", F.col("id").alias("symbol"), F.col("id").alias("position"))
    return ranking.first_evidence([chunks, symbols]).select(*ranking.EVIDENCE, F.col("step").cast("long").alias("step"), "position")


def first_per_file(spark, d):
    rows = read_table(spark, d, "code_chunks").where("status = 'active'").select(F.col("file_id").alias("file_path"), F.col("id").alias("position"))
    return ranking.first_per_file(rows, 50)


def _messages(spark, d) -> DataFrame:
    return read_table(spark, d, "rag_messages").where("created_at is not null")


def history_tail(spark, d):
    out = ranking.history_tail(_messages(spark, d), ["thread_db_id"], ["created_at", "id"], 6, 300)
    return out.select("thread_db_id", "id", F.length("content").cast("long").alias("n"))


def last_questions(spark, d):
    rows = _messages(spark, d).where("lower(trim(role)) in ('user', 'human')")
    return rows.groupBy("thread_db_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


def thread_listing(spark, d):
    threads, messages = read_table(spark, d, "rag_threads"), read_table(spark, d, "rag_messages")
    counted = messages.groupBy(F.col("thread_db_id").alias("id")).agg(F.count("*").alias("messages"), F.max("created_at").alias("last_at"))
    return threads.join(counted, "id", "left").select("id", "project_id", "user_id", F.coalesce("messages", F.lit(0)).alias("messages"), F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at")).orderBy(F.desc("last_at"), F.desc("id"))


def summary_chunks(spark, d):
    return ranking.summaries(_rows(spark, d).where("kind in ('class', 'interface', 'method', 'config')"))


def chunk_overlap(spark, d):
    """Each chunk of a file with the last tokens of the one before and the first of the one after."""
    chunks = graph.latest(read_table(spark, d, "code_chunks")).where("status = 'active' and start_line is not null")
    place = Window.partitionBy("file_id").orderBy("start_line", "id")
    return chunks.select("id", F.coalesce(F.lag(tx.tail_tokens(F.col("content"), 12)).over(place), F.lit("")).alias("before"), F.coalesce(F.lead(tx.head_tokens(F.col("content"), 12)).over(place), F.lit("")).alias("after"))


def unique_names(spark, d):
    """Names that only one symbol of a project's methods has, with its qualified name."""
    rows = graph.latest(read_table(spark, d, "symbols")).where("kind = 'method'")
    return rows.groupBy("project_id", "name").agg(F.count("*").alias("n"), F.min("qualified_name").alias("qualified_name")).where("n = 1").drop("n")


def adjacency(spark, d):
    edges = read_table(spark, d, "edges")
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


QUERIES = {
    "aggregate_class": _aggregate("class", TERMS, NEGATIVE), "aggregate_method": _aggregate("method", TERMS), "aggregate_strong_hint": _aggregate("method", TERMS, (), HINTS),
    "aggregate_artifact": _aggregate("artifact", ["ledger", "config"], ["refund"]), "aggregate_module": _aggregate("module", ["depot-admin", "parcel"]),
    "aggregate_counts": aggregate_counts, "http_ranked": http_ranked, "module_scores": module_scores, "module_resolve": module_resolve, "module_fallback": module_fallback,
    "evidence_merged": evidence_merged, "first_per_file": first_per_file, "history_tail": history_tail, "last_questions": last_questions, "thread_listing": thread_listing,
    "summary_chunks": summary_chunks, "chunk_overlap": chunk_overlap, "unique_names": unique_names, "adjacency": adjacency,
}

_R = """s as (select * from symbols qualify row_number() over (partition by id order by updated_at desc nulls last) = 1),
  f as (select * from files qualify row_number() over (partition by id order by indexed_at desc nulls last, content_hash desc nulls last) = 1),
  r as (select s.*, f.path, f.module_name, f.service_name from s join f on f.id = s.file_id)"""
_TOK = r"'[\x{4e00}-\x{9fff}]|[A-Za-z0-9_./:\-]+'"


def _meta(path: str) -> str:
    return f"case when json_valid(metadata) and json_type(metadata, '$.{path}') = 'VARCHAR' and trim(json_extract_string(metadata, '$.{path}')) <> '' then json_extract_string(metadata, '$.{path}') end"


def _label_sql(x: ranking.Dimension) -> str:
    found = [_meta(p) for p in x.labels]
    if x.group_by == "module":
        found += ["nullif(module_name, '')", "nullif(service_name, '')", "nullif(string_split(path, '/')[1], '')"]
    found.append(r"case when starts_with(trim(name), '@') and contains(trim(name), ' ') then trim(regexp_replace(trim(name), '^\S+\s+', '')) else trim(name) end")
    return f"coalesce({', '.join(found)})"


def _agg_sql(name: str, terms: list[str], negative: list[str] = (), weights: dict | None = None, limit: int = 200) -> str:
    x, weights = ranking.DIMENSIONS[name], weights or {}
    primary = lambda t: f"(l = '{t}' or ends_with(l, '_{t}') or ends_with(l, '-{t}'))"
    any_of = lambda parts: "(" + (" or ".join(parts) or "false") + ")"
    plain = r"regexp_replace(lower(hay), '[^a-z0-9\x{3400}-\x{9fff}]+', '', 'g')"
    score = " + ".join(
        f"{weights.get(t, 1)} * case when l = '{t}' then 100 when ends_with(l, '_{t}') or ends_with(l, '-{t}') then 80 when contains(l, '{t}') then {50 + min(len(t), 20)} when contains(hay, '{t}') then {20 + min(len(t), 20)} else 0 end" for t in terms)
    bad = any_of([f"contains({plain}, '{ranking._plain(t)}')" for t in negative])
    strong = [t for t, w in weights.items() if w >= 4 and len(t) >= 4]
    keep = f"where {any_of([primary(t) for t in strong])}" if strong else ""
    order = "negative, priority, score desc, path, name, id"
    return f"""with {_R}, a as (select *, {_label_sql(x)} as label from r where kind in ({', '.join(repr(k) for k in x.kinds)})),
      b as (select *, lower(label) as l, lower(concat_ws(' ', '{name}', label, nullif(name, ''), nullif(qualified_name, ''), nullif(kind, ''), nullif(signature, ''), nullif(path, ''), nullif(module_name, ''), nullif(service_name, ''), nullif(metadata, ''))) as hay from a),
      c as (select id, label, path, start_line, name, l, case when {bad} then 1 else 0 end as negative,
        case when {any_of([primary(t) for t in terms])} then 0 when {any_of([f"contains(l, '{t}')" for t in terms])} then 1 when {any_of([f"contains(hay, '{t}')" for t in terms])} then 2 else 5 end as priority, {score} as score from b),
      e as (select * from c {keep}), g as (select * from e qualify row_number() over (partition by label, path, start_line order by {order}) = 1)
      select id, label, path, cast(negative as bigint) as negative, cast(priority as bigint) as priority, cast(score as bigint) as score, row_number() over (order by {order}) as position from g order by position limit {limit}"""


_SCORE = " + ".join(f"case when m = '{t}' then 100 when starts_with(m, '{t}') then 60 when contains('-' || m || '-', '-{t}-') then 50 when contains(m, '{t}') then 30 else 0 end" for t in MODULE_TERMS)
_MODULES = f"""n as (select distinct unnest([service_name, module_name, string_split(path, '/')[1]]) as module from files), q as (select module, lower(module) as m from n where module <> ''),
  scored as (select module, {_SCORE} as s, m from q), told as (select module, cast(s + case when contains(m, '-service') or contains(m, '_service') then 5 else 0 end as bigint) as score from scored where s > 0)"""


def _firsts(column: str, most: int, name: str) -> str:
    return f"{name} as (select kind, path, string_agg({column}, ',' order by n) as {name} from (select *, row_number() over (partition by kind, path order by sl nulls first, sid) as n from (select kind, path, {column}, arg_min(start_line, (start_line, id)) as sl, arg_min(id, (start_line, id)) as sid from k group by 1, 2, 3)) where n <= {most} group by 1, 2)"


ORACLE = {
    "aggregate_class": _agg_sql("class", TERMS, NEGATIVE), "aggregate_method": _agg_sql("method", TERMS), "aggregate_strong_hint": _agg_sql("method", TERMS, (), HINTS),
    "aggregate_artifact": _agg_sql("artifact", ["ledger", "config"], ["refund"]),
    "aggregate_module": _agg_sql("module", ["depot-admin", "parcel"]),
    "aggregate_counts": f"with {_R} select group_by, count(*) as n, count(distinct label) as labels from (" + " union all ".join(
        f"select '{x.group_by}' as group_by, {_label_sql(x)} as label from r where kind in ({', '.join(repr(k) for k in x.kinds)})" for x in ranking.DIMENSIONS.values() if not x.annotations) + ") group by 1",
    "http_ranked": f"""with {_R}, k as (select id, path, lower(path) as p, lower(qualified_name) as q from r where kind in ('class', 'interface', 'config'))
      select id, cast(case when contains(p, '/controller/') or ends_with(q, 'controller') then 1 when contains(p, '/web/') then 2 when contains(p, '/feign/') or contains(q, 'feign') then 3 when contains(p, 'application') or contains(p, '/config/') then 8 else 5 end as bigint) as rank, path
      from k order by 2, p, id limit 200""",
    "module_scores": f"with {_MODULES} select module, score from told",
    "module_resolve": f"with {_MODULES} select module, score from told order by score desc, module limit 1",
    "module_fallback": f"""with {_R}, c as (select b.service_name as service, a.path, e.line from edges e join r a on a.id = e.source_id join r b on b.id = e.target_id where e.kind = 'calls' and a.module_name = 'billing-core' and b.service_name is not null),
      k as (select service, min((path, line)) as p from c group by 1 order by 1 limit 3),
      t as (select service_name as service, name, path, start_line as line from r where kind = 'config' qualify row_number() over (partition by service_name order by name, path, start_line) <= 20)
      select 'module_scope_empty' as evidence_type, 'billing-core' as name, cast(null as varchar) as path, cast(null as int) as line
      union all select 'module_related_service', service, p[1], p[2] from k
      union all select 'related_service_table', t.name, t.path, t.line from t join k on k.service = t.service""",
    "evidence_merged": """with a as (select chunk_type as evidence_type, file_id as file_path, start_line, symbol_id as symbol, 0 as step, id as position from code_chunks
        union all select 'artifact_' || kind, file_id, start_line, id, 1, id from symbols)
      select evidence_type, file_path, start_line, symbol, cast(step as bigint) as step, position from a qualify row_number() over (partition by evidence_type, file_path, start_line, symbol order by step, position) = 1""",
    "first_per_file": "select file_id as file_path, min(id) as position from code_chunks where status = 'active' and file_id is not null group by 1 order by 2, 1 limit 50",
    "history_tail": r"""with a as (select *, row_number() over (partition by thread_db_id order by created_at desc, id desc) as n from rag_messages where created_at is not null),
      b as (select *, regexp_replace(content, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as c from a where n <= 6 and regexp_replace(role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') <> ''),
      u as (select *, coalesce(sum(length(c)) over (partition by thread_db_id order by n rows between unbounded preceding and 1 preceding), 0) as used from b where c <> ''),
      k as (select thread_db_id, id, length(regexp_replace(substring(c, 1, 300 - cast(used as int)), '[\s\p{Z}]+$', '')) as n from u where used < 300)
      select thread_db_id, id, cast(n as bigint) as n from k where n > 0""",
    "last_questions": "select thread_db_id, id from rag_messages where created_at is not null and lower(trim(role)) in ('user', 'human') qualify row_number() over (partition by thread_db_id order by created_at desc, id desc) = 1",
    "thread_listing": """select t.id, t.project_id, t.user_id, coalesce(m.n, 0) as messages, strftime(m.last_at, '%Y-%m-%d %H:%M:%S') as last_at from rag_threads t
      left join (select thread_db_id, count(*) as n, max(created_at) as last_at from rag_messages group by 1) m on m.thread_db_id = t.id""",
    "summary_chunks": f"""with {_R}, k as (select * from r where kind in ('class', 'interface', 'method', 'config')), {_firsts('name', 240, 'names')}, {_firsts('qualified_name', 80, 'qualified_names')}
      select kind, path, count(*) as symbol_count, min(module_name) as module_name, any_value(names) as names, any_value(qualified_names) as qualified_names from k join names using (kind, path) join qualified_names using (kind, path) group by 1, 2""",
    "chunk_overlap": f"""with c as (select * from code_chunks qualify row_number() over (partition by id order by updated_at desc nulls last) = 1),
      k as (select id, file_id, start_line, regexp_extract_all(content, {_TOK}) as t from c where status = 'active' and start_line is not null)
      select id, coalesce(lag(array_to_string(t[greatest(len(t) - 11, 1):], ' ')) over w, '') as before, coalesce(lead(array_to_string(t[1:12], ' ')) over w, '') as after from k window w as (partition by file_id order by start_line, id)""",
    "unique_names": f"with {_R} select project_id, name, min(qualified_name) as qualified_name from s where kind = 'method' group by 1, 2 having count(*) = 1",
    "adjacency": "select id, cast(sum(o) as bigint) as outgoing, cast(sum(i) as bigint) as incoming from (select source_id as id, 1 as o, 0 as i from edges union all select target_id, 0, 1 from edges) group by 1",
}
