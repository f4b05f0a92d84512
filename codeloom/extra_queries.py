"""Queries of artifact chunks and of the streaming aggregations in batch form, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import artifacts, graph
from codeloom.session import read_table
from codeloom.streaming import events as ev


def artifact_types(spark, d):
    symbols, edges = graph.latest(read_table(spark, d, "symbols")), read_table(spark, d, "edges")
    return artifacts.artifact_type(symbols, edges).select("id", "artifact_type")


def artifact_chunks(spark, d):
    symbols, edges = graph.latest(read_table(spark, d, "symbols")), read_table(spark, d, "edges")
    return artifacts.artifact_chunks(symbols, edges).select("symbol_id", "chunk_type", F.md5("content").alias("digest"))


def events_windowed(spark, d):
    out = ev.windowed(read_table(spark, d, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("value", 4).alias("value"))


def events_sessions(spark, d):
    out = ev.sessions(read_table(spark, d, "events"))
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


QUERIES = {"artifact_types": artifact_types, "artifact_chunks": artifact_chunks, "events_windowed": events_windowed, "events_sessions": events_sessions}
_S = "s as (select * from symbols qualify row_number() over (partition by id order by updated_at desc nulls last) = 1)"
_TYPES = f"""{_S}, m as (select unnest([source_id, target_id]) as id from edges where kind = 'maps_route'),
  t as (select s.*, case when kind in ('file', 'import', 'package') then null when kind = 'route' then 'api_route' when kind in ({', '.join(repr(k) for k in artifacts.DIRECT)}) then kind
    when kind = 'method' then case when coalesce(case when json_valid(annotations) then json_array_length(annotations) end, 0) > 0 or id in (select id from m) then 'method' end
    when kind = 'annotation_usage' then case when regexp_matches(name, '^@(?:XxlJob|Scheduled)\\b') then 'job' end when kind in ('field', 'parameter') then null else kind end as artifact_type from s)"""


def _lines(end: str, other: str, most: int, word: str) -> str:
    return f"""{word} as (select {end} as id, string_agg('- {word} ' || e.kind || ': ' || o.kind || ' ' || o.name, chr(10) order by n) as {word}_lines from (
      select *, row_number() over (partition by {end} order by kind, line nulls first, {other}, id) as n from edges where kind not in ('annotated_by', 'annotates', 'contains')) e join s o on o.id = e.{other} where n <= {most} group by 1)"""


ORACLE = {
    "artifact_types": f"with {_TYPES} select id, artifact_type from t where artifact_type is not null",
    "artifact_chunks": f"""with {_TYPES}, {_lines('source_id', 'target_id', 16, 'outgoing')}, {_lines('target_id', 'source_id', 8, 'incoming')}
      select t.id as symbol_id, 'artifact_' || artifact_type as chunk_type, md5(concat_ws(chr(10), 'Artifact type: ' || artifact_type, 'Name: ' || name, 'Qualified name: ' || qualified_name, outgoing_lines, incoming_lines)) as digest
      from t left join outgoing on outgoing.id = t.id left join incoming on incoming.id = t.id where artifact_type is not null""",
    "events_windowed": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
    "events_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as fresh from events),
      k as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n from k group by user_id, session""",
}
