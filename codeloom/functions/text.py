"""Scalar text functions as Column expressions: names, SQL and configuration texts, tokens, terms, redaction, ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff"
#: Runs of CJK characters, or of letters, digits and ``_ - . / :`` other than CJK ones.
RUNS = rf"[{CJK}]+|[\p{{L}}\p{{N}}_\-./:&&[^{CJK}]]+"
CHUNK_TOKEN = r"[一-鿿]|[A-Za-z0-9_./:\-]+"
IDENTIFIER_RUN = r"[A-Za-z_][A-Za-z0-9_./:\-]*"
SECRET_KEY = r"(?i)password|passwd|pwd|secret|token|access-key"


def digest(text: Column, length: int = 32) -> Column:
    """The first characters of the SHA-256 of a text in hex."""
    return F.substring(F.sha2(text, 256), 1, length)


def symbol_id(project: Column, path: Column, kind: Column, name: Column, line: Column) -> Column:
    """kind, colon, digest of project, path, kind, qualified name and line joined by colons."""
    return F.concat(kind, F.lit(":"), digest(F.concat_ws(":", project, path, kind, name, line.cast("string"))))


def route_id(project: Column, method: Column, path: Column, handler: Column) -> Column:
    return F.concat(F.lit("route:"), digest(F.concat_ws(":", project, F.upper(method), path, handler)))


def camel_to_snake(name: Column) -> Column:
    """HTTPServerError to http_server_error: an underscore before each capital that begins a word, then lower case."""
    split = F.regexp_replace(name, r"([^\n])([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(split, r"([a-z0-9])([A-Z])", "$1_$2"))


def entity_table(entity: Column) -> Column:
    """The table that an entity class is stored in by convention: its name without a closing Entity, in snake case."""
    return camel_to_snake(F.regexp_replace(entity, "Entity$", ""))


def clean_table(name: Column) -> Column:
    """A table name without back quotes and without what stands before its first dot."""
    bare = F.regexp_replace(name, "^`+|`+$", "")
    return F.regexp_replace(bare, r"^[^.]*\.", "")


def tables_in(sql: Column, operation: str) -> Column:
    """Distinct tables that a statement of the operation (select, insert, update, delete) reads or writes, in order.

    For select the tables after FROM come before those after JOIN; the word select itself is no table. Null gives null.
    """
    name = r"\s+`?([A-Za-z_][\w.]*)`?"
    found = {
        "select": F.concat(F.regexp_extract_all(sql, F.lit(rf"(?i)\bfrom{name}"), F.lit(1)), F.regexp_extract_all(sql, F.lit(rf"(?i)\bjoin{name}"), F.lit(1))),
        "insert": F.regexp_extract_all(sql, F.lit(rf"(?i)\binsert\s+into{name}"), F.lit(1)),
        "update": F.regexp_extract_all(sql, F.lit(rf"(?i)\bupdate{name}"), F.lit(1)),
        "delete": F.regexp_extract_all(sql, F.lit(rf"(?i)\bdelete\s+from{name}"), F.lit(1)),
    }[operation]
    names = F.transform(found, clean_table)
    return F.array_distinct(F.filter(names, lambda n: (n != "") & (F.lower(n) != "select") if operation == "select" else n != ""))


def created_tables(sql: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(sql, F.lit(r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?`?([A-Za-z_][\w.]*)`?"), F.lit(1)))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def is_dynamic_sql(text: Column) -> Column:
    return text.rlike("<if|<foreach|<choose|<where|<set")


def redact(text: Column) -> Column:
    """Values of secrets in ``key=value`` and client secrets masked; the key stays, followed by ``=<redacted>``."""
    masked = F.regexp_replace(text, r"(?i)(password|passwd|pwd|secret|token|access[_-]?key)=([^&\s]+)", "$1=<redacted>")
    masked = F.regexp_replace(masked, r"(?i)(client_secret:\s*)(\S+)", "$1=<redacted>")
    return F.regexp_replace(masked, r"(?i)(client\.secret[=:]\s*)(\S+)", "$1=<redacted>")


def redact_map(values: Column) -> Column:
    """A map of settings with the values of secret keys masked."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit("<redacted>")).otherwise(v))


def jdbc_target(url: Column) -> Column:
    """scheme://host:port/path of a JDBC URL, without prefix and query."""
    return F.regexp_replace(F.regexp_replace(url, "^jdbc:", ""), r"[?;#].*$", "")


def join_route(prefix: Column, path: Column) -> Column:
    """Two route parts as one path: single slashes, one in front, none at the end; ``/`` if both are empty."""
    both = F.concat_ws("/", F.coalesce(prefix, F.lit("")), F.coalesce(path, F.lit("")))
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(both, "/+", "/"), "^/|/$", ""))


def annotation_path(text: Column) -> Column:
    """The first double-quoted string of an annotation, empty if there is none."""
    return F.regexp_extract(text, '"([^"]*)"', 1)


def http_method(annotation: Column, text: Column) -> Column:
    """The HTTP method of a mapping annotation; RequestMapping names it as RequestMethod.X or stands for ANY."""
    named = F.upper(F.regexp_extract(annotation, "^(Get|Post|Put|Delete|Patch)Mapping$", 1))
    asked = F.regexp_extract(text, r"RequestMethod\.([A-Z]+)", 1)
    return F.when(named != "", named).when(asked != "", asked).otherwise(F.lit("ANY"))


def topic_and_tag(text: Column) -> Column:
    """A message destination as struct(topic, tag): split at the first colon unless that begins ``://``."""
    at = F.instr(text, ":")
    whole = (at == 0) | (F.instr(text, "://") == at)
    return F.struct(F.when(whole, text).otherwise(F.substring_index(text, ":", 1)).alias("topic"), F.when(~whole, F.regexp_replace(text, "^[^:]*:", "")).alias("tag"))


def line_of(text: Column, needle: str) -> Column:
    """The line, from 1, of the first occurrence of a string; 1 if it does not occur."""
    at = F.instr(text, needle)
    return F.when(at > 0, F.regexp_count(F.substring_index(text, needle, 1), F.lit("\n")) + 1).otherwise(F.lit(1))


def token_count(text: Column) -> Column:
    """Single Han characters and identifier runs."""
    return F.regexp_count(text, F.lit(CHUNK_TOKEN))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK_TOKEN), F.lit(0))


def tail_tokens(text: Column, n: int) -> Column:
    """The last ``n`` tokens joined by blanks."""
    all_ = tokens(text)
    return F.array_join(F.slice(all_, F.greatest(F.size(all_) - n + 1, F.lit(1)), n), " ")


def head_tokens(text: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def embed_tokens(text: Column) -> Column:
    """Tokens for hashing: CJK runs as single characters and then pairs, other runs as they are; in lower case, in order."""
    def parts(run: Column) -> Column:
        chars = F.filter(F.split(run, ""), lambda c: c != "")
        pairs = F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, 2))).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(chars, pairs)).otherwise(F.array(run))

    return F.flatten(F.transform(F.regexp_extract_all(F.lower(text), F.lit(RUNS), F.lit(0)), parts))


def bucket_and_sign(token: Column, dim: int) -> Column:
    """struct(bucket, sign) of a token: its SHA-256's first four bytes modulo ``dim``, and the parity of the fifth."""
    hashed = F.sha2(token, 256)
    bucket = F.pmod(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    even = F.pmod(F.conv(F.substring(hashed, 9, 2), 16, 10).cast("int"), F.lit(2)) == 0
    return F.struct(bucket.alias("bucket"), F.when(even, 1.0).otherwise(-1.0).alias("sign"))


def cjk_ngrams(text: Column) -> Column:
    """All substrings of 2 to 4 characters of each CJK run of two or more, run by run, shorter ones first."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0)), lambda r: F.length(r) > 1)
    grams = lambda r: F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.length(r), F.lit(4))), lambda n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, n))))
    return F.flatten(F.transform(runs, grams))


def query_terms(text: Column) -> Column:
    """Search terms of a question in order, each once: identifiers with their parts, CJK n-grams, then blank-separated words."""
    strip = lambda c: F.regexp_replace(c, r"^[.,;:()\[\]{}<>\"']+|[.,;:()\[\]{}<>\"']+$", "")
    idents = F.filter(F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER_RUN), F.lit(0)), strip), lambda t: t != "")
    spaced = lambda t: F.regexp_replace(F.regexp_replace(t, "[^A-Za-z0-9]+", " "), "(?<=[a-z0-9])(?=[A-Z])", " ")
    parts = lambda t: F.filter(F.split(spaced(t), " "), lambda p: (F.length(p) >= 3) & ~p.rlike("^[0-9]+$"))
    named = F.flatten(F.transform(idents, lambda t: F.concat(F.array(t), parts(t))))
    words = F.filter(F.transform(F.split(text, r"\s+"), strip), lambda t: t != "")
    return F.array_distinct(F.concat(named, cjk_ngrams(text), words))


def negative_terms(text: Column) -> Column:
    """What a question excludes by ``not X`` or its Chinese form."""
    return F.array_distinct(F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bnot\s+([A-Za-z0-9_-]+)"), F.lit(1)), F.lower),
        F.regexp_extract_all(text, F.lit(r"不是\s*([A-Za-z0-9_\-一-鿿]+)"), F.lit(1)),
    ))


#: White space that ends a sentence or a line, without the vertical tab, as RE2 counts it.
SPACE = r"[\t\n\f\r ]+"


def sentences(text: Column) -> Column:
    """Sentences, ended by a mark and white space, or by a CJK mark; without blanks around them, Unicode's included."""
    bare = lambda s: F.regexp_replace(s, r"^[\p{Zs}\t\n\f\r]+|[\p{Zs}\t\n\f\r]+\z", "")
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?;]){SPACE}|(?<=[。！？；])"), bare), lambda s: s != "")


#: What makes a text one about logins, what makes it one about mail, and by what a provider is told, in order.
LOGIN_CONTEXT = "oauth|authorize|access_token|response_type=code|redirect_uri|social|third-party|third party|第三方登录|/api/v5/user"
MAIL_CONTEXT = r"@email|\b[\w.\-]+@qq\.com\b"
PROVIDERS = (("gitee", "Gitee"), ("github.com", "GitHub"), ("weibo", "Weibo"), ("graph.qq.com", "QQ"), ("connect.qq.com", "QQ"), ("wechat", "WeChat"), ("weixin", "WeChat"))


def provider(text: Column) -> Column:
    """The login provider that a text is about, null without login context or in an e-mail context."""
    low = F.lower(text)
    found = F.coalesce(*[F.when(low.contains(hint), F.lit(name)) for hint, name in PROVIDERS])
    return F.when(low.rlike(LOGIN_CONTEXT) & ~low.rlike(MAIL_CONTEXT), found)


def provider_of(text: str) -> str | None:
    """``provider`` of one text at hand, for the extractors."""
    low = text.lower()
    if not re.search(LOGIN_CONTEXT, low) or re.search(MAIL_CONTEXT, low):
        return None
    return next((name for hint, name in PROVIDERS if hint in low), None)


def metadata_string(json: Column, path: str) -> Column:
    """A non-empty string at a dotted path of a JSON text; null for other types, empty strings and unreadable texts."""
    value = F.try_variant_get(F.try_parse_json(json), "$." + path, "string")
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(json), "$." + path, "variant"))
    return F.when((kind == "STRING") & (F.trim(value) != ""), value)
