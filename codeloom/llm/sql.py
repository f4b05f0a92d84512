"""The SQL that the llm queries are compared with, where SQL can express them."""

BLANK = r"'^[\s\p{Z}\x1c-\x1f\x85\x{180e}\x{200b}-\x{200d}\x{2060}\x{feff}]*$'"
ENDS = r"'^[\s\p{Z}\x{180e}\x{200b}-\x{200d}\x{2060}\x{feff}]+|[\s\p{Z}\x{180e}\x{200b}-\x{200d}\x{2060}\x{feff}]+$'"

MERGED = f"""
told as (
  select thread_db_id, min(id) as id, content, created_at,
    case lower(regexp_replace(role, {ENDS}, '', 'g'))
      when 'user' then 'user' when 'human' then 'user' when 'assistant' then 'assistant' when 'ai' then 'assistant'
      when 'bot' then 'assistant' when 'system' then 'system' when 'tool' then 'tool' end as speaker,
    content is null or regexp_matches(content, {BLANK}) as blank
  from rag_messages where thread_db_id is not null group by thread_db_id, role, content, created_at)
"""

FAULTS = f"""
{MERGED},
facts as (
  select thread_db_id, bool_or(created_at is null or speaker is null) as bad,
    arg_min(speaker, (created_at, id)) filter (speaker in ('user', 'assistant') and created_at is not null) as opener
  from told where not blank group by all),
turns as (
  select thread_db_id, speaker, lead(speaker) over (partition by thread_db_id order by created_at, id) as follower
  from told where not blank and created_at is not null and speaker in ('user', 'assistant')),
open_ends as (select distinct thread_db_id from turns where speaker = 'user' and coalesce(follower, 'user') = 'user'),
faults as (
  select t.id as thread_db_id,
    case when f.thread_db_id is null then 'empty' when f.bad or f.opener <> 'user' then 'broken'
         when o.thread_db_id is not null then 'no_reply' end as reason
  from (select distinct id from rag_threads where id is not null) t
  left join facts f on f.thread_db_id = t.id left join open_ends o on o.thread_db_id = t.id)
"""

SIZED = r"""
told as (
  select id, content, updated_at, case when json_valid(metadata) then json_extract_string(metadata, '$.max_tokens') end as raw
  from code_chunks where status = 'active' and id is not null and content is not null),
sized as (select id, content, updated_at, case when regexp_matches(raw, '^\s*\+?\d{1,9}(\.\d*)?\s*$') and try_cast(trim(raw) as double) >= 1
    then cast(floor(try_cast(trim(raw) as double)) as int) else 800 end as max_tokens,
    len(regexp_extract_all(content, '[\x{4e00}-\x{9fff}]|[A-Za-z0-9_./:\-]+')) as tokens from told)"""

PAIRS = """
      with fine as (
        select distinct id, project_id, embedding_model, embedding::double[] as v from chunk_embeddings
        where status = 'active' and id is not null and project_id is not null and embedding_model is not null and len(embedding) = 64
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
      near as (
        select a.id, b.id as near, list_cosine_similarity(a.v, b.v) as c from fine a
        join fine b on a.project_id = b.project_id and a.embedding_model = b.embedding_model and a.id <> b.id),
      best as (select * from near qualify row_number() over (partition by id order by c desc, near) <= 5)
      select distinct least(id, near) as id_a, greatest(id, near) as id_b from best where c >= 0.85"""

ORACLE = {
    "p2_found": PAIRS,
    "p2_cells": PAIRS,
    "p3_found": f"with {SIZED} select distinct id as chunk_id from sized where tokens > max_tokens",
    "p7_order": f"""with {FAULTS}
      select thread_db_id, row_number() over (partition by thread_db_id order by created_at, id) - 1 as position, id, speaker
      from told where not blank and created_at is not null and speaker is not null
        and thread_db_id in (select id from rag_threads) and thread_db_id not in (select thread_db_id from faults where reason is not null)""",
    "p3_rejoined": f"""with {SIZED}
      select id as chunk_id, md5(arg_max(content, (updated_at, content))) as content, true as within from sized where tokens > max_tokens group by id""",
    "p8_checks": "select capacity_id, (select count(*) from documents where text <> '') as texts, 0 as overfull, 0 as split_needlessly from pack_capacities",
    "p9_checks": """select source, cast(max_repeats as bigint) as max_repeats, 0 as over_cap, false as far_off from mix_targets
      where source in (select regexp_replace(lower(trim(source)), '[- ]+', '_', 'g') from documents where text <> '')""",
    "p10_counts": "select doc_id, false as unsound from documents",
    "p7_found": f"with {FAULTS} select thread_db_id, reason from faults where reason is not null",
}
