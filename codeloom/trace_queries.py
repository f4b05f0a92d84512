"""Queries of execution traces over the tables of a data folder, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import graph, store, trace
from codeloom.session import read_table

TERMS = ["cancelinvoice", "RebateJob"]


def _chunks(spark, d):
    return graph.latest(read_table(spark, d, "code_chunks")).where("status = 'active' and language = 'java'")


def entry_points(spark, d):
    return trace.entry_points(graph.latest(read_table(spark, d, "symbols")), TERMS).select("id", F.col("tier").cast("long").alias("tier"))


def execution_trace(spark, d):
    out = trace.execution_trace(graph.latest(read_table(spark, d, "symbols")), read_table(spark, d, "edges"), TERMS, bodies=_chunks(spark, d))
    return out.withColumn("hop", F.col("hop").cast("long"))


def body_details(spark, d):
    return trace.body_details(_chunks(spark, d)).groupBy("symbol_id", "detail").agg(F.count("*").alias("n"))


def called_names(spark, d):
    return _chunks(spark, d).select("id", F.explode(trace.called_names(F.col("content"))).alias("name"))


def block_ends(spark, d):
    return trace.block_ends(_chunks(spark, d)).select("id", F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"))


def symbol_evidence(spark, d):
    files = store.last_wins(read_table(spark, d, "files"), ["id"], ["indexed_at", "content_hash"]).select(F.col("id").alias("file_id"), "path", "module_name")
    rows = graph.latest(read_table(spark, d, "symbols")).where("kind in ('class', 'interface')").join(files, "file_id")
    return trace.as_evidence(rows, F.concat(F.lit("artifact_"), "kind"), "artifact_search").select("evidence_type", "file_path", "start_line", "symbol", "content_excerpt")


QUERIES = {"entry_points": entry_points, "execution_trace": execution_trace, "body_details": body_details, "called_names": called_names, "block_ends": block_ends, "symbol_evidence": symbol_evidence}
_S = "s as (select * from symbols qualify row_number() over (partition by id order by updated_at desc nulls last) = 1)"
_C = "c as (select * from (select * from code_chunks qualify row_number() over (partition by id order by updated_at desc nulls last) = 1) where status = 'active' and language = 'java')"
_LOW = ", ".join(f"'{t.lower()}'" for t in TERMS)
_PART = " or ".join(f"contains(lower(qualified_name), '{t.lower()}')" for t in TERMS)
_JOB = ", ".join(f"'@xxljob {t.lower()}'" for t in TERMS)
_E = f"""{_S}, k as (select id, case when kind = 'annotation_usage' and lower(name) in ({_JOB}) then 0 when kind in ('method', 'constructor', 'route') and lower(name) in ({_LOW}) then 1
  when kind in ('method', 'constructor', 'route') and ({_PART}) then 2 end as tier from s), e0 as (select * from k where tier = (select min(tier) from k))"""
ORACLE = {
    "entry_points": f"with {_E} select id, cast(tier as bigint) as tier from e0",
    "execution_trace": f"""with recursive {_E}, calls as (select distinct source_id, target_id from edges where kind = 'calls'),
      walk(id, hop) as (select id, 0 from e0 union select c.target_id, w.hop + 1 from walk w join calls c on c.source_id = w.id where w.hop < 2),
      r as (select id, min(hop) as hop from walk group by 1)
      select 'execution_method' as evidence_type, id as symbol_id, cast(hop as bigint) as hop from r where id in (select id from s)
      union all select 'execution_' || e.kind, e.target_id, cast(min(r.hop) as bigint) from edges e join r on r.id = e.source_id where e.kind in ('reads_table', 'writes_table', 'publishes', 'references', 'instantiates') group by e.kind, e.target_id""",
    "body_details": rf"""with {_C}, l as (select symbol_id, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) as t, generate_subscripts(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), 1) as line from c where symbol_id is not null),
      k as (select symbol_id, line, case when regexp_matches(t, '{trace.CONTROL}') then 'control' when regexp_matches(t, '{trace.MESSAGE}') then 'message' when regexp_matches(t, '{trace.CALL}') then 'call' end as detail from l),
      f as (select * from k where detail is not null qualify row_number() over (partition by symbol_id order by line, detail) <= 220) select symbol_id, detail, count(*) as n from f group by 1, 2""",
    "called_names": f"with {_C}, n as (select distinct id, unnest(regexp_extract_all(content, '{trace.CALL}', 2)) as name from c) select id, name from n where name not in ({', '.join(repr(n) for n in trace.GENERIC_CALLS)})",
    "block_ends": f"""with {_C}, l as (select id, unnest(string_split(content, chr(10))) as t, generate_subscripts(string_split(content, chr(10)), 1) as line from c),
      k as (select id, line, length(t) - length(replace(t, '{{', '')) as o, length(t) - length(replace(t, '}}', '')) as x from l),
      w as (select id, line, sum(o - x) over q as depth, sum(o) over q as opened from k window q as (partition by id order by line))
      select id, cast(min(line) as bigint) as first_line, cast(coalesce(min(line) filter (depth <= 0), max(line)) as bigint) as last_line from w where opened > 0 group by 1""",
    "symbol_evidence": f"""with {_S}, f as (select * from files qualify row_number() over (partition by id order by indexed_at desc nulls last, content_hash desc nulls last) = 1)
      select 'artifact_' || s.kind as evidence_type, f.path as file_path, s.start_line, s.qualified_name as symbol, concat_ws('; ', 'artifact=' || s.name, 'kind=' || s.kind, 'module=' || f.module_name) as content_excerpt
      from s join f on f.id = s.file_id where s.kind in ('class', 'interface')""",
}
