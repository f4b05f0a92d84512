"""Queries of the text and vector functions over the tables of a data folder, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codeloom.functions import text as tx
from codeloom.operators import vector
from codeloom.operators.graph import latest
from codeloom.session import read_table

QUESTION = "why is the invoice batch retried? 退款失败"
QUERY_VECTOR = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
DIM = 256


def _docs(spark, d) -> DataFrame:
    return read_table(spark, d, "documents")


def camel_snake(spark, d):
    return latest(read_table(spark, d, "symbols")).select("id", tx.camel_to_snake(F.col("name")).alias("snake"), tx.entity_table(F.concat("name", F.lit("Entity"))).alias("table_name"))


def stable_ids(spark, d):
    rows = latest(read_table(spark, d, "symbols"))
    return rows.select("id", tx.symbol_id(F.col("project_id"), F.col("file_id"), F.col("kind"), F.col("qualified_name"), F.col("start_line")).alias("made"))


def sql_tables(spark, d):
    rows = _docs(spark, d).where("lower(trim(source)) = 'mapper_sql'").select("doc_id", *[tx.tables_in(F.col("text"), op).alias(op) for op in ("select", "insert", "update", "delete")])
    return rows.select("doc_id", *[F.array_join(op, ",").alias(op) for op in ("select", "insert", "update", "delete")]).withColumnsRenamed({"select": "reads", "insert": "inserts", "update": "updates", "delete": "deletes"})


def redact_text(spark, d):
    made = F.concat_ws(" ", F.lit("url?token="), F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(tx.redact(F.regexp_replace(F.col("text"), r"timeout: ", "client_secret: "))).alias("digest"), F.length(tx.redact(made)).cast("long").alias("n"))


def redact_settings(spark, d):
    pairs = F.create_map(F.concat(F.col("event_type"), F.lit(".token")), F.col("props"), F.concat(F.col("event_type"), F.lit(".name")), F.col("props"))
    return read_table(spark, d, "events").select("event_id", tx.redact_map(pairs).alias("m")).select("event_id", F.explode("m").alias("key", "value"))


def jdbc_targets(spark, d):
    found = F.explode(F.regexp_extract_all("text", F.lit(r"jdbc:[^\s\"']+"), F.lit(0)))
    return _docs(spark, d).select(found.alias("url")).groupBy("url").agg(F.count("*").alias("n")).select(tx.jdbc_target(F.col("url")).alias("target"), "n", "url")


def routes_joined(spark, d):
    rows = latest(read_table(spark, d, "symbols")).where("kind = 'method'")
    prefix = F.concat(F.lit("/"), F.element_at(F.split("qualified_name", r"\."), -2), F.lit("/"))
    return rows.select("id", tx.join_route(prefix, F.concat(F.lit("//"), F.col("name"))).alias("route"))


def token_stats(spark, d):
    return _docs(spark, d).select("doc_id", tx.token_count(F.col("text")).cast("long").alias("tokens"), tx.head_tokens(F.col("text"), 5).alias("head"), tx.tail_tokens(F.col("text"), 5).alias("tail"))


def embed_tokens(spark, d):
    return _docs(spark, d).select(F.explode(tx.embed_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def hash_buckets(spark, d):
    return vector.hash_buckets(_docs(spark, d), "doc_id", "text", DIM).select("doc_id", F.col("bucket").cast("long").alias("bucket"), "value")


def hash_topk(spark, d):
    return vector.hash_topk(_docs(spark, d), "doc_id", "text", QUESTION, 20, DIM)


def vector_topk(spark, d):
    rows = read_table(spark, d, "chunk_embeddings").where("status = 'active' and embedding_model = 'tolvane-embed-64'").select("id", "embedding").dropDuplicates(["id"])
    return vector.topk(rows, "id", "embedding", QUERY_VECTOR, 20)


def vector_topk_joined(spark, d):
    """The nearest vectors with their chunks and, where there is one, the symbol's name."""
    best = vector_topk(spark, d)
    ids = read_table(spark, d, "chunk_embeddings").select("id", "chunk_id").distinct()
    chunks = latest(read_table(spark, d, "code_chunks")).select(F.col("id").alias("chunk_id"), "title", "symbol_id")
    symbols = latest(read_table(spark, d, "symbols")).select(F.col("id").alias("symbol_id"), "qualified_name")
    return best.join(ids, "id").join(chunks, "chunk_id").join(symbols, "symbol_id", "left").select("id", "score", "title", "qualified_name")


def vector_topk_typed(spark, d):
    rows = read_table(spark, d, "embeddings").where(F.col("label").isin(1, 3, 5))
    return vector.topk(rows, "vec_id", "embedding", QUERY_VECTOR, 50)


def vector_text(spark, d):
    rows = read_table(spark, d, "embeddings").select("vec_id", "embedding", vector.to_text(F.col("embedding")).alias("t"))
    same = F.forall(F.zip_with("embedding", vector.from_text(F.col("t")), lambda a, b: F.abs(a - b) <= 1e-7), lambda x: x)
    return rows.select("vec_id", F.md5("t").alias("digest"), F.size(vector.from_text(F.col("t"))).cast("long").alias("dim"), same.alias("same"))


def query_terms(spark, d):
    questions = read_table(spark, d, "rag_messages").where("content is not null")
    return questions.select("id", F.array_join(tx.query_terms(F.col("content")), "|").alias("terms"))


def negative_terms(spark, d):
    texts = _docs(spark, d).where("text is not null")
    return texts.select("doc_id", F.array_join(tx.negative_terms(F.col("text")), "|").alias("terms")).where("terms <> ''")


def login_providers(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    with_context = lines.withColumn("t", F.concat(F.col("t"), F.when(F.col("line") % 7 == 0, " oauth gitee").when(F.col("line") % 5 == 0, " redirect_uri weixin").otherwise("")))
    return with_context.select("doc_id", F.col("line").cast("long").alias("line"), tx.provider(F.col("t")).alias("provider")).where("provider is not null")


def metadata_label(spark, d):
    return read_table(spark, d, "code_chunks").select("id", tx.metadata_string(F.col("metadata"), "qualified_name").alias("label")).where("label is not null").distinct()


def line_numbers(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", tx.line_of(F.col("text"), "return").cast("long").alias("line"))


def line_windows(spark, d, pad: int = 2, most: int = 8):
    """Lines around each chunk's position in its own content: from two before the third line, at most eight."""
    chunks = latest(read_table(spark, d, "code_chunks"))
    lines = chunks.select("id", F.posexplode(F.split("content", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)
    return lines.where(F.col("i").between(max(1, 3 - pad), max(1, 3 - pad) + most - 1)).groupBy("id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), "\n")).alias("digest"))


def markdown_headings(spark, d):
    """Headings outside fenced blocks with level and line, by document."""
    lines = _docs(spark, d).where("lower(trim(source)) in ('library', 'changelog')").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("line", "t"))
    fenced = F.sum(F.col("t").rlike("^\\s*```").cast("int")).over(Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2
    heads = lines.withColumn("fenced", fenced).where("fenced = 0").select("doc_id", F.col("line").cast("long").alias("line"), F.length(F.regexp_extract("t", "^(#{1,6})[ \t]+\\S", 1)).cast("long").alias("level"), F.trim(F.regexp_replace("t", "^#{1,6}[ \t]+", "")).alias("title"))
    return heads.where("level > 0")


def sentence_counts(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(tx.sentences(F.regexp_replace("text", tx.SPACE, " "))).cast("long").alias("n"))


QUERIES = {
    "camel_snake": camel_snake, "stable_ids": stable_ids, "sql_tables": sql_tables, "redact_text": redact_text, "redact_settings": redact_settings,
    "jdbc_targets": jdbc_targets, "routes_joined": routes_joined, "token_stats": token_stats, "embed_tokens": embed_tokens, "hash_buckets": hash_buckets,
    "hash_topk": hash_topk, "vector_topk": vector_topk, "vector_topk_joined": vector_topk_joined, "vector_topk_typed": vector_topk_typed, "vector_text": vector_text,
    "query_terms": query_terms, "negative_terms": negative_terms, "login_providers": login_providers, "metadata_label": metadata_label,
    "line_numbers": line_numbers, "line_windows": line_windows, "markdown_headings": markdown_headings, "sentence_counts": sentence_counts,
}

_S = "s as (select * from symbols qualify row_number() over (partition by id order by updated_at desc nulls last) = 1)"
_CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
_TOK = r"'[\x{4e00}-\x{9fff}]|[A-Za-z0-9_./:\-]+'"
_SNAKE = "lower(regexp_replace(regexp_replace({0}, '([^\\n])([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'))"
_LIT = "[" + ", ".join(f"{x:.8f}" for x in QUERY_VECTOR) + "]::double[]"
_COS = f"""round(case when v is null or len(v) <> 64 or len(list_filter(v, lambda x: x is null or isnan(x))) > 0 or len(list_filter(v, lambda x: x <> 0)) = 0 then 0 else list_cosine_similarity(v, {_LIT}) end, 6)"""
_EMB = rf"""
runs as (select doc_id, unnest(regexp_extract_all(lower(text), '[{_CJK}]+|(?:[a-z0-9_\-./:]|[^\x00-\x7f{_CJK}\PL]|[^\x00-\x7f{_CJK}\PN])+')) as run from documents where text is not null),
toks as (
  select doc_id, run as token from runs where not regexp_matches(run, '^[{_CJK}]')
  union all select doc_id, unnest(string_split(run, '')) from runs where regexp_matches(run, '^[{_CJK}]')
  union all select doc_id, unnest(list_transform(range(1, length(run)), lambda i: run[i:i + 1])) from runs where regexp_matches(run, '^[{_CJK}]') and length(run) > 1)"""
_BUCKETS = f"""{_EMB}, hashed as (select doc_id, sha256(token) as h from toks),
buckets as (select doc_id, cast(('0x' || h[1:8])::bigint % {DIM} as bigint) as bucket, cast(sum(case when ('0x' || h[9:10])::bigint % 2 = 0 then 1 else -1 end) as double) as value from hashed group by 1, 2 having value <> 0)"""


def _keep_first(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def _of(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(text, '(?i)\\b{pattern}\\s+`?([A-Za-z_][\\w.]*)`?', 1), lambda x: regexp_replace(x, '^[^.]*\\.', ''))"


_READS = f"list_filter(list_concat({_of('from')}, {_of('join')}), lambda x: lower(x) <> 'select')"
ORACLE = {
    "sentence_counts": r"""select doc_id, len(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?;]) +', '\1' || chr(10), 'g'), '([。！？；])', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> '')) as n
      from documents where text is not null""",
    "camel_snake": f"with {_S} select id, {_SNAKE.format('name')} as snake, {_SNAKE.format('name')} as table_name from s",
    "stable_ids": f"with {_S} select id, kind || ':' || sha256(concat_ws(':', project_id, file_id, kind, qualified_name, start_line))[1:32] as made from s",
    "sql_tables": f"""select doc_id, array_to_string({_keep_first(_READS)}, ',') as reads, array_to_string({_keep_first(_of('insert' + chr(92) + 's+into'))}, ',') as inserts,
      array_to_string({_keep_first(_of('update'))}, ',') as updates, array_to_string({_keep_first(_of('delete' + chr(92) + 's+from'))}, ',') as deletes from documents where lower(trim(source)) = 'mapper_sql'""",
    "redact_settings": "select event_id, unnest([event_type || '.token', event_type || '.name']) as key, unnest(['<redacted>', props]) as value from events",
    "jdbc_targets": r"""select regexp_replace(regexp_replace(url, '^jdbc:', ''), '[?;#].*$', '') as target, count(*) as n, url from (select unnest(regexp_extract_all(text, 'jdbc:[^\s"'']+')) as url from documents) group by all""",
    "routes_joined": f"with {_S} select id, '/' || string_split(qualified_name, '.')[-2] || '/' || name as route from s where kind = 'method'",
    "token_stats": f"""with t as (select doc_id, regexp_extract_all(text, {_TOK}) as k from documents) select doc_id, len(k) as tokens, array_to_string(k[1:5], ' ') as head, array_to_string(k[greatest(len(k) - 4, 1):], ' ') as tail from t""",
    "embed_tokens": f"with {_EMB} select token, count(*) as n from toks group by 1",
    "hash_buckets": f"with {_BUCKETS} select doc_id, bucket, value from buckets",
    "hash_topk": f"""with {_BUCKETS}, q(bucket, weight) as (values {', '.join(f'({b}, {w:.12f})' for b, w in vector.embed_query(QUESTION, DIM).items())})
      select doc_id, round(sum(value * coalesce(weight, 0)) / sqrt(sum(value * value)), 6) as score from buckets left join q using (bucket) group by 1 order by score desc, doc_id limit 20""",
    "vector_topk": f"with e as (select distinct on (id) id, embedding::double[] as v from chunk_embeddings where status = 'active' and embedding_model = 'tolvane-embed-64') select id, {_COS} as score from e order by score desc, id limit 20",
    "vector_topk_joined": f"""with {_S}, e as (select distinct on (id) id, chunk_id, embedding::double[] as v from chunk_embeddings where status = 'active' and embedding_model = 'tolvane-embed-64'),
      b as (select id, chunk_id, {_COS} as score from e order by score desc, id limit 20), c as (select * from code_chunks qualify row_number() over (partition by id order by updated_at desc) = 1)
      select b.id, b.score, c.title, s.qualified_name from b join c on c.id = b.chunk_id left join s on s.id = c.symbol_id""",
    "vector_topk_typed": f"with e as (select vec_id, embedding::double[] as v from embeddings where label in (1, 3, 5)) select vec_id, {_COS} as score from e order by score desc, vec_id limit 50",
    "redact_text": r"""with r as (select doc_id, regexp_replace(text, 'timeout: ', 'client_secret: ', 'g') as a, 'url?token= ' || text as b from documents),
      k as (select doc_id, regexp_replace(a, '(password|passwd|pwd|secret|token|access[_-]?key)=([^&\s]+)', '\1=<redacted>', 'gi') as a, regexp_replace(b, '(password|passwd|pwd|secret|token|access[_-]?key)=([^&\s]+)', '\1=<redacted>', 'gi') as b from r),
      m as (select doc_id, regexp_replace(a, '(client_secret:\s*)(\S+)', '\1=<redacted>', 'gi') as a, regexp_replace(b, '(client_secret:\s*)(\S+)', '\1=<redacted>', 'gi') as b from k),
      n as (select doc_id, regexp_replace(a, '(client\.secret[=:]\s*)(\S+)', '\1=<redacted>', 'gi') as a, regexp_replace(b, '(client\.secret[=:]\s*)(\S+)', '\1=<redacted>', 'gi') as b from m)
      select doc_id, md5(a) as digest, length(b) as n from n""",
    "negative_terms": r"""with k as (select doc_id, list_concat(list_transform(regexp_extract_all(text, '(?i)\bnot\s+([A-Za-z0-9_-]+)', 1), lambda t: lower(t)), regexp_extract_all(text, '不是\s*([A-Za-z0-9_\-\x{4e00}-\x{9fff}]+)', 1)) as k from documents where text is not null)
      select doc_id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '|') as terms from k where len(k) > 0""",
    "vector_text": "select vec_id, md5('[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::double)), ',') || ']') as digest, len(embedding) as dim, true as same from embeddings",
    "login_providers": """with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents),
      c as (select doc_id, line, lower(t || case when line % 7 = 0 then ' oauth gitee' when line % 5 = 0 then ' redirect_uri weixin' else '' end) as t from l),
      p as (select doc_id, line, case when contains(t, 'gitee') then 'Gitee' when contains(t, 'github.com') then 'GitHub' when contains(t, 'weibo') then 'Weibo' when contains(t, 'graph.qq.com') or contains(t, 'connect.qq.com') then 'QQ' when contains(t, 'wechat') or contains(t, 'weixin') then 'WeChat' end as provider
        from c where regexp_matches(t, 'oauth|authorize|access_token|response_type=code|redirect_uri|social|third-party|third party|第三方登录|/api/v5/user') and not contains(t, '@email') and not regexp_matches(t, '\\b[\\w.\\-]+@qq\\.com\\b'))
      select doc_id, cast(line as bigint) as line, provider from p where provider is not null""",
    "metadata_label": "select distinct id, json_extract_string(metadata, '$.qualified_name') as label from code_chunks where json_valid(metadata) and json_type(metadata, '$.qualified_name') = 'VARCHAR' and trim(json_extract_string(metadata, '$.qualified_name')) <> ''",
    "line_numbers": "select doc_id, case when contains(text, 'return') then cast(len(string_split(string_split(text, 'return')[1], chr(10))) as bigint) else 1 end as line from documents where text is not null",
    "line_windows": """with c as (select * from code_chunks qualify row_number() over (partition by id order by updated_at desc nulls last) = 1), l as (select id, string_split(content, chr(10)) as k from c where content is not null)
      select id, cast(least(len(k), 8) as bigint) as n, md5(array_to_string(k[1:8], chr(10))) as digest from l""",
    "markdown_headings": r"""with l as (select doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as t, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 as line from documents where lower(trim(source)) in ('library', 'changelog')),
      f as (select *, sum(case when regexp_matches(t, '^\s*```') then 1 else 0 end) over (partition by doc_id order by line) % 2 as fenced from l)
      select doc_id, cast(line as bigint) as line, length(regexp_extract(t, '^(#{1,6})[ \t]+\S', 1)) as level, trim(regexp_replace(t, '^#{1,6}[ \t]+', '')) as title from f where fenced = 0 and regexp_matches(t, '^#{1,6}[ \t]+\S')""",
    "query_terms": rf"""with q as (select id, content, regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_./:\-]*') as raw from rag_messages where content is not null),
      n as (select *, list_filter(list_transform(raw, lambda t: regexp_replace(t, '^[.,;:()\[\]{{}}<>"'']+|[.,;:()\[\]{{}}<>"'']+$', '', 'g')), lambda t: t <> '') as ids from q),
      g as (select *, flatten(list_transform(ids, lambda t: list_concat([t], list_filter(string_split(regexp_replace(regexp_replace(t, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '), lambda p: length(p) >= 3 and not regexp_matches(p, '^[0-9]+$'))))) as named,
        flatten(list_transform(list_filter(regexp_extract_all(content, '[{_CJK}]+'), lambda r: length(r) > 1), lambda r: flatten(list_transform(range(2, least(length(r), 4) + 1), lambda n: list_transform(range(1, length(r) - n + 2), lambda i: r[i:i + n - 1]))))) as grams,
        list_filter(list_transform(regexp_split_to_array(content, '\s+'), lambda t: regexp_replace(t, '^[.,;:()\[\]{{}}<>"'']+|[.,;:()\[\]{{}}<>"'']+$', '', 'g')), lambda t: t <> '') as words from n),
      w as (select id, list_concat(named, grams, words) as k from g)
      select id, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '|') as terms from w""",
}
