"""Queries of the planning rules, chat snapshots and text parts over the tables of a data folder, and the SQL they are compared with."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codeloom.functions import hints as hint
from codeloom.functions import text as tx
from codeloom.operators import chat, graph
from codeloom.plans import planner
from codeloom.session import read_table

AT = datetime(2026, 1, 1)


def _questions(spark, d) -> DataFrame:
    return read_table(spark, d, "rag_messages").where("content is not null").select("id", "content")


def _told(function, kind: str):
    """A column of a planning rule over texts, in Arrow batches."""

    @F.pandas_udf(kind)
    def apply(texts: pd.Series) -> pd.Series:
        return pd.Series([function(t) for t in texts], dtype=object)

    return apply


def question_intents(spark, d):
    return _questions(spark, d).select("id", _told(planner.infer_intent, "string")("content").alias("intent")).where("intent is not null")


def planning_questions(spark, d):
    return _questions(spark, d).where(_told(planner.is_planning, "boolean")("content")).select("id")


def http_questions(spark, d):
    return _questions(spark, d).where(_told(hint.is_http_question, "boolean")("content")).select("id")


def question_targets(spark, d):
    return _questions(spark, d).select("id", F.explode(_told(planner.targets_in, "array<string>")("content")).alias("target"))


def question_tools(spark, d):
    """The tools of each question's plan without a planner or sources, in order."""
    tools = lambda q: ",".join(s.tool for s in planner.plan_for(q, sources=False).steps)
    return _questions(spark, d).groupBy(_told(tools, "string")("content").alias("tools")).agg(F.count("*").alias("n"))


def _thread(spark, d) -> tuple[DataFrame, str, str, str]:
    threads = read_table(spark, d, "rag_threads")
    row = threads.where("user_id is not null and thread_id is not null and project_id is not null").orderBy("id").select("project_id", "thread_id", "user_id").first()
    return threads, row["project_id"], row["thread_id"], row["user_id"]


def chat_renamed(spark, d):
    threads, project, thread, user = _thread(spark, d)
    return chat.rename(threads, project, thread, "new", AT, user).select("id", "title", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


def chat_deleted(spark, d):
    threads, project, thread, user = _thread(spark, d)
    left, messages = chat.delete(threads, read_table(spark, d, "rag_messages"), project, thread, user)
    return left.select(F.lit("thread").alias("what"), "id").unionByName(messages.select(F.lit("message").alias("what"), "id"))


def chat_ensured(spark, d):
    """The threads with one that is there already and one that is not ensured: one more row."""
    threads, project, thread, user = _thread(spark, d)
    both = chat.ensure(chat.ensure(threads, project, thread, AT, user), project, "a thread of its own", AT, user)
    return both.groupBy("project_id", "user_id").agg(F.count("*").alias("n"))


def chat_history(spark, d):
    threads, project, thread, user = _thread(spark, d)
    return chat.history(threads, read_table(spark, d, "rag_messages"), project, thread, user).select("id", "role")


def chat_listed(spark, d):
    threads, project, _, user = _thread(spark, d)
    return chat.listed(threads, project, user).select("id", "title")


def mapping_methods(spark, d):
    """HTTP method and path of a mapping annotation written from each symbol: by its kind, with a path of its name."""
    rows = graph.latest(read_table(spark, d, "symbols"))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in {"class": "Get", "method": "Post", "field": "Put", "config": "Delete", "enum": "Patch"}.items() for x in pair]), F.col("kind"))
    name = F.concat(F.coalesce(kind, F.lit("Request")), F.lit("Mapping"))
    text = F.concat(F.lit("@"), name, F.lit('(value = "/'), "name", F.lit('"'), F.when(F.col("kind") == "package", ", method = RequestMethod.HEAD").otherwise(""), F.lit(")"))
    return rows.select("id", tx.http_method(name, text).alias("method"), tx.annotation_path(text).alias("path"))


def statement_texts(spark, d):
    """Statement texts of mapper documents wrapped in tags: tags stripped, whether they are dynamic, tables created."""
    rows = read_table(spark, d, "documents").where("text is not null and lower(trim(source)) = 'mapper_sql'")
    text = F.concat(F.lit("<select>"), F.when(F.col("doc_id") % 2 == 0, "<if test='a'>").otherwise(""), "text", F.lit(" create table if not exists `t_"), "doc_id", F.lit("` (a int)</select>"))
    return rows.select("doc_id", F.md5(tx.strip_tags(text)).alias("digest"), tx.is_dynamic_sql(text).alias("dynamic"), F.array_join(tx.created_tables(text), ",").alias("tables"))


def destinations(spark, d):
    """Topic and tag of a destination written from each edge: kind and line, with a tag, as a URL, or bare."""
    value = F.when(F.col("id") % 3 == 0, F.concat("kind", F.lit(":"), F.col("line").cast("string"))).when(F.col("id") % 3 == 1, F.concat(F.lit("kafka://"), "kind")).otherwise(F.col("kind"))
    return read_table(spark, d, "edges").select("id", tx.topic_and_tag(value).alias("t")).select("id", "t.topic", "t.tag")


QUERIES = {
    q.__name__: q
    for q in (
        question_intents, planning_questions, http_questions, question_targets, question_tools, chat_renamed, chat_deleted, chat_ensured, chat_history, chat_listed, mapping_methods, statement_texts, destinations,
    )
}


def _any(terms, column: str = "q") -> str:
    return "(" + " or ".join(f"contains({column}, '{t}')" for t in terms) + ")"


_Q = "m as (select id, content, lower(content) as q from rag_messages where content is not null)"
_PLANNING = f"({_any(planner.PLANNING)} or ({_any(planner.ACTIONS)} and {_any(planner.SCOPES)}))"
_INTENT = f"case when {_PLANNING} then 'task_planning' " + " ".join(f"when {_any(i.terms)} then '{i.name}'" for i in planner.INTENTS) + " end"
_T = "t as (select id, project_id, thread_id, user_id from rag_threads where user_id is not null and thread_id is not null and project_id is not null order by id limit 1)"
_IS = "r.project_id = t.project_id and r.thread_id = t.thread_id and r.user_id = t.user_id"
_S = "s as (select * from symbols where id is not null qualify row_number() over (partition by id order by updated_at desc nulls last) = 1)"

ORACLE = {
    "question_intents": f"with {_Q}, i as (select id, {_INTENT} as intent from m) select id, intent from i where intent is not null",
    "planning_questions": f"with {_Q} select id from m where {_PLANNING}",
    "http_questions": f"with {_Q} select id from m where {_any(hint.HTTP_WORDS)}",
    "question_targets": rf"""with {_Q}, k as (select id, list_distinct(list_transform(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_./:\-]*'), lambda x: trim(x, '.:/-'))) as ts from m), u as (select id, unnest(ts) as target from k)
      select id, target from u where length(target) >= 3 and lower(target) not in ({', '.join(repr(g) for g in sorted(planner.GENERIC))})
        and (regexp_matches(target, '[_.:/\-]') or regexp_matches(target, '[a-z][A-Z]') or {' or '.join(f"ends_with(target, '{x}')" for x in planner.CLASS_SUFFIXES)})""",
    "chat_renamed": f"with {_T} select r.id, case when {_IS} then 'new' else r.title end as title, strftime(case when {_IS} then timestamp '2026-01-01' else r.updated_at end, '%Y-%m-%d') as day from rag_threads r, t",
    "chat_deleted": f"""with {_T}, l as (select r.id from rag_threads r, t where not coalesce({_IS}, false))
      select 'thread' as what, id from l union all select 'message', id from rag_messages where thread_db_id in (select id from l)""",
    "chat_ensured": f"with {_T}, l as (select project_id, user_id from rag_threads union all select project_id, user_id from t) select project_id, user_id, count(*) as n from l group by 1, 2",
    "chat_history": f"with {_T} select id, role from rag_messages where thread_db_id in (select r.id from rag_threads r, t where {_IS})",
    "chat_listed": "with " + _T + " select r.id, r.title from rag_threads r, t where r.project_id = t.project_id and r.user_id = t.user_id",
    "mapping_methods": f"""with {_S} select id, case kind when 'class' then 'GET' when 'method' then 'POST' when 'field' then 'PUT' when 'config' then 'DELETE' when 'enum' then 'PATCH' when 'package' then 'HEAD' else 'ANY' end as method,
      regexp_extract('"/' || name || '"', '"([^"]*)"', 1) as path from s""",
    "statement_texts": """select doc_id, md5(regexp_replace('<select>' || case when doc_id % 2 = 0 then '<if test=''a''>' else '' end || text || ' create table if not exists `t_' || doc_id || '` (a int)</select>', '<[^>]+>', ' ', 'g')) as digest,
      doc_id % 2 = 0 or regexp_matches(text, '<if|<foreach|<choose|<where|<set') as dynamic,
      array_to_string(list_append(regexp_extract_all(text, '(?i)\\bcreate\\s+table\\s+(?:if\\s+not\\s+exists\\s+)?`?([A-Za-z_][\\w.]*)`?', 1), 't_' || doc_id), ',') as tables
      from documents where text is not null and lower(trim(source)) = 'mapper_sql'""",
    "destinations": "select id, case when id % 3 = 1 then 'kafka://' || kind when id % 3 = 0 and line is null then null else kind end as topic, case when id % 3 = 0 then cast(line as varchar) end as tag from edges",
}
