"""Queries that run the extractors over the texts of a data folder, and what SQL can say about the same facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.operators import graph, ranking, store
from codeloom.plans import refine
from codeloom.session import cut, read_table
from codeloom.sources import extract, workspace


def _files(spark, d, source: str, language: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where(F.regexp_replace(F.lower(F.trim("source")), "[- ]", "_") == source)
    return rows.select(F.concat(F.lit(f"{source}/"), "doc_id", F.lit(f".{language}")).alias("path"), F.lit(language).alias("language"), "text", F.lit("tolvane").alias("service_name"), F.col("doc_id"))


def java_symbols(spark, d):
    return extract.facts(_files(spark, d, "java_source", "java")).where("record = 'symbol'").select("path", "kind", "name", "qualified_name", "start_line", "end_line")


def java_methods(spark, d):
    """Methods by file: names that a class body declares with a modifier."""
    rows = extract.facts(_files(spark, d, "java_source", "java")).where("record = 'symbol' and kind = 'method'")
    return rows.groupBy("path").agg(F.count("*").alias("n"))


def java_packages(spark, d):
    return extract.facts(_files(spark, d, "java_source", "java")).where("record = 'symbol' and kind = 'package'").select("path", "qualified_name")


def java_references(spark, d):
    return extract.facts(_files(spark, d, "java_source", "java")).where("record = 'ref'").groupBy("kind", "name").agg(F.count("*").alias("n"))


def java_edges(spark, d):
    return extract.facts(_files(spark, d, "java_source", "java")).where("record = 'edge'").groupBy("path", "kind").agg(F.count("*").alias("n"))


def markdown_chunks(spark, d):
    return extract.facts(_files(spark, d, "library", "markdown")).where("record = 'chunk'").select("path", "kind", "name", "start_line", "end_line", F.length("content").cast("long").alias("n"))


def config_settings(spark, d):
    files = read_table(spark, d, "documents").where("lower(trim(source)) = 'config'").select(F.concat(F.lit("c/"), "doc_id", F.lit("/application.yml")).alias("path"), F.lit("config").alias("language"), "text")
    return workspace.settings(files)


JAVA = """package gen;

@Service
@TableName("t_{low}")
public class {name} extends Base implements Api {{
    @Value("${{oauth.client.id}}") private String id;
    @Autowired private Helper helper;
    private Long {field}Count;

    @GetMapping("/{name}")
    @PreAuthorize("can:{name}")
    public Reply get(Query query) {{
        String topic = "{name}-local";
        kafkaTemplate.send("{name}-topic", query);
        kafkaTemplate.send(topic, query);
        kafkaTemplate.send(Topics.{up}, query);
        rabbitTemplate.convertAndSend("{name}", "rk", query);
        rocketMQTemplate.syncSend("{name}:tag", query);
        stringRedisTemplate.opsForValue().set("{name}:k", query);
        stringRedisTemplate.opsForValue().get("{name}:g");
        return helper.run(new Order(query));
    }}

    @XxlJob("{name}Job")
    @KafkaListener(topics = "{name}-in")
    @Cacheable("{name}-cache")
    public void on(String message) {{ }}
}}
"""
CONSTANTS = """package gen;
public class Topics {{
    public static final String {up} = "{name}-const";
}}
"""
MAPPER = """<?xml version="1.0"?>
<mapper namespace="gen.{name}">
  <select id="find">select a from t_{low} x join u_{low} y on x.id = y.id</select>
  <insert id="add">insert into t_{low} (a) values (1)</insert>
  <update id="set"><if test="a">update shop.v_{low} set a = 1</if></update>
</mapper>
"""
SETTINGS = """spring:
  application:
    name: svc-{low}
  datasource:
    url: jdbc:mysql://db.example:3306/{low}?useSSL=false
    password: hidden
  redis:
    host: cache.example
  kafka:
    bootstrap-servers: "k1:9092"
"""


def _generated(spark, d, template: str, language: str, name: str) -> DataFrame:
    """A source file for every class of the symbols, written from its name; the path begins with the symbol's id."""
    classes = graph.latest(read_table(spark, d, "symbols")).where("kind = 'class'").select("id", "name")
    text = F.lit(template.replace("{{", "\x01").replace("}}", "\x02"))
    low, camel = F.lower("name"), F.concat(F.lower(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    for key, value in (("{name}", F.col("name")), ("{low}", low), ("{up}", F.upper("name")), ("{field}", camel)):
        text = F.replace(text, F.lit(key), value)
    text = F.replace(F.replace(text, F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))
    return classes.select(F.concat("id", F.lit(f"/{name}")).alias("path"), F.lit(language).alias("language"), text.alias("text"), F.lit("gen").alias("service_name"), "id", "name")


SYMBOLS = ("route", "mq_topic", "mq_tag", "mq_exchange", "cache_key", "permission_rule", "db_table", "db_column", "data_contract", "oauth_provider", "service", "bean", "class", "method", "field", "parameter")
EDGES = ("publishes", "consumes", "reads_cache", "writes_cache", "requires_permission", "defines_contract", "uses_oauth_provider", "maps_route")


def generated_symbols(spark, d):
    rows = extract.facts(_generated(spark, d, JAVA, "java", "A.java"))
    return rows.where(F.col("kind").isin(*SYMBOLS) & (F.col("record") == "symbol")).select("path", "kind", "name").distinct()


def generated_edges(spark, d):
    rows = extract.facts(_generated(spark, d, JAVA, "java", "A.java"))
    return rows.where(F.col("kind").isin(*EDGES) & (F.col("record") == "edge")).select("path", "kind", "source", "target").distinct()


def generated_refs(spark, d):
    return extract.facts(_generated(spark, d, JAVA, "java", "A.java")).where("record = 'ref'").select("path", "kind", "name").distinct()


def generated_chunks(spark, d):
    return extract.facts(_generated(spark, d, JAVA, "java", "A.java")).where("record = 'chunk'").groupBy("path", "kind").agg(F.count("*").alias("n"))


def generated_constants(spark, d):
    return workspace.constants(_generated(spark, d, CONSTANTS, "java", "Topics.java"))


def generated_publishes(spark, d):
    """What constants of other files tell of destinations, with the edges to them."""
    constants = workspace.constants(_generated(spark, d, CONSTANTS, "java", "Topics.java"))
    rows = extract.facts(_generated(spark, d, JAVA, "java", "A.java"))
    own = rows.where("record = 'publish'")
    return extract.resolved_publishes(own, constants).where("record = 'edge'").select("path", "kind", "source", "target")


def generated_statements(spark, d):
    rows = extract.facts(_generated(spark, d, MAPPER, "mybatis_xml", "m.xml"))
    return rows.where("record = 'edge' and kind <> 'contains'").select("path", "kind", "source", "target")


def generated_settings(spark, d):
    return workspace.settings(_generated(spark, d, SETTINGS, "config", "application.yml"))


def generated_resources(spark, d):
    files = _generated(spark, d, SETTINGS, "config", "application.yml")
    made = extract.resource_facts(files, workspace.resources(workspace.settings(files)))
    return made.where("record = 'edge'").select("path", "kind", "source", "target")


def generated_services(spark, d):
    """The service that the settings of each module name."""
    files = _generated(spark, d, SETTINGS, "config", "application.yml").select("path", "language", "text", F.col("id").alias("module_name"))
    return workspace.with_services(files).select("path", "service_name")


def file_modules(spark, d):
    """Files by the module whose directory is nearest above them; directories with sources count as such."""
    files = store.last_wins(read_table(spark, d, "files"), ["id"], ["indexed_at", "content_hash"]).select("id", "path", "language").where("path is not null")
    roots = files.where("path like '%/src/%'").select(F.substring_index("path", "/", 1).alias("dir")).distinct()
    return workspace.with_modules(files.select("path", "language").distinct(), roots).select("path", "language", "module_name")


def _aggregated(spark, d, group: str) -> DataFrame:
    """The symbols of the generated sources ranked by an annotated dimension."""
    files = _generated(spark, d, JAVA, "java", "A.java")
    symbols = extract.facts(files).where("record = 'symbol'")
    rows = symbols.select(F.concat_ws("#", "path", "kind", "qualified_name").alias("id"), "kind", "name", "qualified_name", "signature", "path", F.lit("gen").alias("module_name"), F.lit("gen").alias("service_name"), "metadata", "start_line")
    best = ranking.aggregated(rows, ranking.DIMENSIONS[group], ["invoice"], limit=1_000_000)
    return best.select("label", "path", F.col("priority").cast("long").alias("priority"))


def generated_apis(spark, d):
    return _aggregated(spark, d, "api")


def generated_jobs(spark, d):
    return _aggregated(spark, d, "job")


def generated_controllers(spark, d):
    return _aggregated(spark, d, "controller")


def generated_routes(spark, d):
    """The routes of the generated sources with method and path."""
    rows = extract.facts(_generated(spark, d, JAVA, "java", "A.java")).where("record = 'symbol' and kind = 'route'")
    told = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return rows.select("path", told("http_method"), F.get_json_object("metadata", "$.path").alias("route"), told("handler"))


def generated_tables(spark, d):
    """The tables of a build over the generated mappers: how many symbols, edges and chunks of each kind, and none that dangles."""
    files = _generated(spark, d, MAPPER, "mybatis_xml", "m.xml")
    out = refine.tables(cut(extract.facts(files)), "p")
    ends = out["symbols"].select("id")
    whole = out["edges"].join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    count = lambda rows, what, kind: rows.groupBy(kind).agg(F.count("*").alias("n")).select(F.concat(F.lit(f"{what}:"), kind).alias("what"), "n")
    return count(out["symbols"], "symbol", "kind").unionByName(count(whole, "edge", "kind")).unionByName(count(out["chunks"], "chunk", "chunk_type"))


QUERIES = {
    **{q.__name__: q for q in (generated_apis, generated_jobs, generated_controllers, generated_routes, generated_tables)},
    **{q.__name__: q for q in (generated_symbols, generated_edges, generated_refs, generated_chunks, generated_constants, generated_publishes, generated_statements, generated_settings, generated_resources, generated_services, file_modules)},
    "java_symbols": java_symbols, "java_methods": java_methods, "java_packages": java_packages, "java_references": java_references, "java_edges": java_edges,
    "markdown_chunks": markdown_chunks, "config_settings": config_settings,
}
_J = "j as (select 'java_source/' || doc_id || '.java' as path, text from documents where regexp_replace(lower(trim(source)), '[- ]', '_', 'g') = 'java_source' and text is not null)"
_G = "g as (select id, name, lower(name) as low, lower(name[1]) || name[2:] as camel from (select * from symbols where id is not null qualify row_number() over (partition by id order by updated_at desc nulls last) = 1) where kind = 'class')"


def _each(columns: str, rows: list[tuple[str, ...]], path: str, names: str) -> str:
    """A row for each class and entry; entries are SQL expressions over id, name, low and camel."""
    parts = " union ".join(f"select id || '/{path}', {', '.join(row)} from g" for row in rows)
    return f"with {_G}, r({columns}) as ({parts}) select {names} from r"


_SYMBOLS = [
    ("'route'", "'GET /' || name"), *(("'mq_topic'", f"name || '-{t}'") for t in ("topic", "local", "in")), ("'mq_topic'", "name"), ("'mq_tag'", "'tag'"), ("'mq_exchange'", "name || ':rk'"),
    ("'cache_key'", "name || ':k'"), ("'cache_key'", "name || ':g'"), ("'cache_key'", "name || '-cache'"), ("'permission_rule'", "'can:' || name"), ("'db_table'", "'t_' || low"), ("'data_contract'", "name"),
    ("'db_column'", "'id'"), ("'db_column'", "'helper'"), ("'db_column'", "regexp_replace(regexp_replace(camel || 'Count', '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g').lower()"),
    ("'oauth_provider'", "'OAuth2'"), ("'service'", "'gen'"), ("'bean'", "camel"), ("'class'", "name"), ("'method'", "'get'"), ("'method'", "'on'"), ("'field'", "'id'"), ("'field'", "'helper'"), ("'field'", "camel || 'Count'"),
    ("'parameter'", "'query'"), ("'parameter'", "'message'"),
]
_SERVICE = "'service:gen'"
_EDGES = [
    *(("'publishes'", _SERVICE, f"'mq_topic:' || name || '-{t}'") for t in ("topic", "local")), ("'publishes'", _SERVICE, "'mq_topic:' || name"), ("'publishes'", _SERVICE, "'mq_exchange:' || name || ':rk'"),
    ("'consumes'", _SERVICE, "'mq_topic:' || name || '-in'"), ("'reads_cache'", _SERVICE, "'cache_key:' || name || '-cache'"), ("'reads_cache'", _SERVICE, "'cache_key:' || name || ':g'"), ("'writes_cache'", _SERVICE, "'cache_key:' || name || ':k'"),
    ("'requires_permission'", "'method:gen.' || name || '.get'", "'permission_rule:can:' || name"), ("'defines_contract'", "'data_contract:gen.' || name", "'db_table:t_' || low"), ("'uses_oauth_provider'", _SERVICE, "'oauth_provider:OAuth2'"),
    ("'maps_route'", "'route:GET /' || name", "'method:gen.' || name || '.get'"),
]
_REFS = [("'extends'", "'Base'"), ("'implements'", "'Api'"), ("'injects'", "'Helper'"), ("'references'", "'Reply'"), ("'instantiates'", "'Order'"), ("'calls'", "'Helper.run'"), *(("'calls'", f"'{r}.{m}'") for r, m in (
    ("kafkaTemplate", "send"), ("rabbitTemplate", "convertAndSend"), ("rocketMQTemplate", "syncSend"), ("stringRedisTemplate", "opsForValue")))]
_STATEMENTS = [
    *(("'maps_to_sql'", f"'method:gen.' || name || '.{m}'", f"'sql_statement:gen.' || name || '#{m}'") for m in ("find", "add", "set")), ("'reads_table'", "'sql_statement:gen.' || name || '#find'", "'db_table:t_' || low"),
    ("'reads_table'", "'sql_statement:gen.' || name || '#find'", "'db_table:u_' || low"), ("'writes_table'", "'sql_statement:gen.' || name || '#add'", "'db_table:t_' || low"), ("'writes_table'", "'sql_statement:gen.' || name || '#set'", "'db_table:v_' || low"),
]
_SETTINGS = [
    ("'spring.application.name'", "'svc-' || low"), ("'spring.datasource.url'", "'jdbc:mysql://db.example:3306/' || low || '?useSSL=false'"), ("'spring.datasource.password'", "'<redacted>'"), ("'spring.redis.host'", "'cache.example'"),
    ("'spring.kafka.bootstrap-servers'", "'k1:9092'"),
]
_RESOURCES = [("'uses_resource'", _SERVICE, f"'resource:{t}:' || {v}") for t, v in (("database", "'mysql://db.example:3306/' || low"), ("redis", "'redis://cache.example:6379/0'"), ("kafka", "'kafka://k1:9092'"))]
ORACLE = {
    "generated_apis": _each("path, label, name", [("'/' || name", "name")], "A.java", "label, path, cast(case when contains(lower(name), 'invoice') then 1 else 5 end as bigint) as priority"),
    "generated_jobs": _each("path, label", [("name || 'Job'",)], "A.java", "label, path, cast(case when contains(lower(label), 'invoice') then 1 else 5 end as bigint) as priority"),
    "generated_controllers": _each("path, label", [("'/' || name",)], "A.java", "label, path, cast(case when contains(lower(label), 'invoice') then 1 else 5 end as bigint) as priority"),
    "generated_routes": _each("path, http_method, route, handler", [("'GET'", "'/' || name", "'gen.' || name || '.get'")], "A.java", "path, http_method, route, handler"),
    "generated_tables": f"""with {_G}, n as (select count(distinct name) as c from g), t as (select count(distinct t) as c from (select unnest(['t_' || low, 'u_' || low, 'v_' || low]) as t from g)), k as (select count(distinct name || '/' || low) as c, count(*) as f from g)
      select 'symbol:mapper' as what, c as n from n union all select 'symbol:sql_statement', 3 * c from n union all select 'symbol:db_table', c from t union all select 'symbol:service', 1
      union all select 'edge:reads_table', 2 * c from n union all select 'edge:writes_table', 2 * c from n union all select 'chunk:mybatis_sql', 3 * f from k""",
    "generated_symbols": _each("path, kind, name", _SYMBOLS, "A.java", "distinct path, kind, name"),
    "generated_edges": _each("path, kind, source, target", _EDGES, "A.java", "path, kind, source, target"),
    "generated_refs": _each("path, kind, name", _REFS, "A.java", "path, kind, name"),
    "generated_chunks": _each("path, kind, n", [("'db_table_summary'", "1"), ("'mq_flow'", "5"), ("'redis_cache_flow'", "3"), ("'permission_rule'", "1"), ("'third_party_login'", "1")], "A.java", "path, kind, n"),
    "generated_constants": f"""with {_G} select distinct unnest([upper(name), 'Topics.' || upper(name), 'gen.Topics.' || upper(name)]) as alias, name || '-const' as value from g where upper(name) in (select upper(name) from g group by 1 having count(distinct name) = 1)""",
    "generated_publishes": _each("path, kind, source, target", [("'publishes'", _SERVICE, "'mq_topic:' || name || '-const'")], "A.java", "path, kind, source, target"),
    "generated_statements": _each("path, kind, source, target", _STATEMENTS, "m.xml", "path, kind, source, target"),
    "generated_settings": _each("path, key, value", _SETTINGS, "application.yml", "path, key, value"),
    "generated_resources": _each("path, kind, source, target", _RESOURCES, "application.yml", "path, kind, source, target"),
    "generated_services": _each("path, service_name", [("'svc-' || low",)], "application.yml", "path, service_name"),
    "file_modules": """with f as (select distinct path, language from (select * from files qualify row_number() over (partition by id order by indexed_at desc nulls last, content_hash desc nulls last) = 1) where path is not null),
      r as (select distinct split_part(path, '/', 1) as dir from f where path like '%/src/%')
      select path, language, case when language = 'markdown' then 'library' when contains(path, '/') and split_part(path, '/', 1) in (select dir from r) then split_part(path, '/', 1)
        when split_part(path, '/', 2) = 'src' then split_part(path, '/', 1) end as module_name from f""",
    "java_packages": rf"with {_J} select path, regexp_extract(text, '(?m)^\s*package\s+([\w.]+)\s*;', 1) as qualified_name from j where regexp_matches(text, '(?m)^\s*package\s+[\w.]+\s*;')",
    "java_methods": rf"""with {_J}, n as (select path, len(regexp_extract_all(regexp_replace(text, '//[^\n]*', '', 'g'), '(?m)^    (?:public|private|protected) [\w<>, ]+ \w+\([^)]*\) *\{{')) as n from j) select path, n from n where n > 0""",
}
