"""Facts from source files: symbols, edges, unresolved references and text chunks, one pass over each file.

``facts`` maps a frame of files (path, language, text, module_name, service_name) to one row per fact. A file that cannot be
read gives an ``error`` row and does not fail the task. Java is read by its brackets: comments and strings are blanked out,
braces are matched over the whole text, and a declaration belongs to the innermost type that encloses it, so nested types
and bodies without braces need no special case.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codeloom.functions.annotations import primary, split_top, values_of
from codeloom.functions.hints import string_value
from codeloom.functions.text import provider_of
from codeloom.sources.workspace import masked_settings

COLUMNS = ["path", "record", "kind", "name", "qualified_name", "start_line", "end_line", "source", "target", "signature", "content", "metadata"]
SCHEMA = "path string, record string, kind string, name string, qualified_name string, start_line int, end_line int, source string, target string, signature string, content string, metadata string"
COMPONENTS = {"Component", "Service", "Repository", "Controller", "RestController", "Configuration"}
ROUTES = {"RequestMapping": "ANY", "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
CONTROL = {"if", "for", "while", "switch", "catch", "return", "new", "else", "throw", "synchronized", "try", "do", "super", "this", "assert"}
LISTENERS = {"RabbitListener": ("mq_queue", "queues"), "KafkaListener": ("mq_topic", "topics"), "RocketMQMessageListener": ("mq_topic", "topic")}
SENDERS = re.compile(r"\b(\w*(?:rabbit|kafka|rocketMQ|rocketMq)\w*)\.(convertAndSend|send|syncSend|asyncSend|sendOneWay)\s*\(", re.I)
CACHES = {"Cacheable": "reads_cache", "CachePut": "writes_cache", "CacheEvict": "evicts_cache"}
GUARDS = ("PreAuthorize", "PostAuthorize", "Secured", "RolesAllowed", "RequiresPermissions")


def blanked(text: str) -> str:
    """The text with comments, strings and character literals as blanks, line breaks kept, so that offsets stay."""
    wipe = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r'//[^\n]*|/\*.*?\*/|"""(?:.|\n)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', wipe, text, flags=re.S)


def brackets(code: str, pair: str = "{}") -> dict[int, int]:
    """Offset of each opening bracket to that of its closing one; unclosed ones end with the text."""
    stack, match = [], {}
    for m in re.finditer(r"[{}]" if pair == "{}" else r"[()]", code):
        if m[0] == pair[0]:
            stack.append(m.start())
        elif stack:
            match[stack.pop()] = m.start()
    return match | {at: len(code) for at in stack}


def plain_type(text: str) -> str:
    """A type without final, annotations and generics."""
    bare = re.sub(r"@\w+(?:\([^)]*\))?|\bfinal\b", " ", text)
    while "<" in bare and (shorter := re.sub(r"<[^<>]*>", "", bare)) != bare:
        bare = shorter
    words = bare.replace("[]", "").replace("...", "").split()
    return words[-1] if words else ""


class Facts:
    """Collects the rows of one file."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.rows = path, text, []
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def line(self, offset: int) -> int:
        return bisect_right(self.breaks, offset - 1) + 1

    def add(self, record: str, kind: str, name: str = "", qualified: str = "", start: int | None = None, end: int | None = None, source: str = "", target: str = "", signature: str = "", content: str = "", **metadata) -> None:
        told = json.dumps({k: v for k, v in sorted(metadata.items()) if v is not None}, ensure_ascii=False, sort_keys=True)
        self.rows.append((self.path, record, kind, name, qualified, start, end, source, target, signature, content, told))

    def symbol(self, kind: str, name: str, qualified: str, start: int, end: int | None = None, owner: str | None = None, signature: str = "", **metadata) -> str:
        self.add("symbol", kind, name, qualified, start, end or start, signature=signature, **metadata)
        if owner:
            self.edge("contains", owner, f"{kind}:{qualified}", start)
        return f"{kind}:{qualified}"

    def edge(self, kind: str, source: str, target: str, line: int | None = None, confidence: float = 1.0, **metadata) -> None:
        self.add("edge", kind, source=source, target=target, start=line, confidence=confidence, **metadata)

    def ref(self, kind: str, source: str, name: str, line: int) -> None:
        self.add("ref", kind, name=name, source=source, start=line)

    def chunk(self, kind: str, title: str, content: str, start: int | None = None, end: int | None = None, **metadata) -> None:
        self.add("chunk", kind, title, start=start, end=end, content=content, **metadata)


_TYPE = re.compile(r"(?<![\w.])(@interface|class|interface|enum|record)\s+([A-Za-z_]\w*)([^{};]*)\{")
_CALLABLE = re.compile(r"(?<![\w.])(?:([A-Za-z_][\w.]*(?:\s*<[^;{}()=]*>)?(?:\[\])*)\s+)?([A-Za-z_]\w*)\s*\(")
_FIELD = re.compile(r"(?:^|(?<=[;{}\n]))[ \t]*((?:(?:private|protected|public|static|final|volatile|transient)\s+)*)([A-Z][\w.]*(?:<[^;{}()=]*>)?(?:\[\])*)\s+([a-zA-Z_]\w*)\s*(=[^;]*)?;", re.M)
_ANNOTATION = re.compile(r"@([A-Za-z_][\w.]*)")


def java_facts(path: str, text: str, service: str | None) -> Facts:
    """Types, members, annotations, routes, beans, inheritance, calls and the messaging, cache, guard and table facts."""
    facts, code = Facts(path, text), blanked(text)
    braces, rounds = brackets(code), brackets(code, "()")
    file_id = facts.symbol("file", path.rsplit("/", 1)[-1], path, 1, len(facts.breaks) + 1)
    package = m[1] if (m := re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", code)) else ""
    if package:
        facts.symbol("package", package.rsplit(".", 1)[-1], package, facts.line(m.start(1)), owner=file_id)
    for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", code):
        facts.symbol("import", m[1].rsplit(".", 1)[-1], m[1], facts.line(m.start(1)), owner=file_id)

    annotations: list[tuple[int, int, str, dict]] = []  # start, end, name, values
    for m in _ANNOTATION.finditer(code):
        if m[1] == "interface":
            continue
        opening = re.match(r"\s*\(", code[m.end() :])
        end = m.end()
        values: dict = {}
        if opening:
            at = m.end() + opening.end() - 1
            end = rounds.get(at, len(code)) + 1
            values = values_of(text[at + 1 : end - 1])
        annotations.append((m.start(), end, m[1].rsplit(".", 1)[-1], values))

    def marks_before(start: int) -> list[tuple[int, int, str, dict]]:
        """Annotations directly before a declaration, only modifiers and white space between."""
        found, at = [], start
        for a in reversed([a for a in annotations if a[1] <= start]):
            if re.fullmatch(r"(?:\s|public|private|protected|static|final|abstract|default|synchronized|native|strictfp|sealed|non-sealed|<[^<>]*>)*", code[a[1] : at]):
                found.append(a)
                at = a[0]
            else:
                break
        return found[::-1]

    types = []  # start, end, qualified, id, simple name, fields
    for m in _TYPE.finditer(code):
        opening = m.end() - 1
        owner = next((t for t in reversed(types) if t[0] < m.start() < t[1]), None)
        qualified = f"{owner[2]}.{m[2]}" if owner else f"{package}.{m[2]}" if package else m[2]
        kind = {"@interface": "annotation", "record": "class"}.get(m[1], m[1])
        end = braces.get(opening, len(code))
        marks = marks_before(m.start())
        names = [a[2] for a in marks]
        symbol = facts.symbol(kind, m[2], qualified, facts.line(m.start(1)), facts.line(end), owner[3] if owner else file_id, " ".join(text[m.start() : opening].split()), annotations=names)
        types.append((opening, end, qualified, symbol, m[2], {}, marks))
        tail = m[3]
        if x := re.search(r"\bextends\s+([^{]+?)(?=\bimplements\b|\bpermits\b|$)", tail, re.S):
            for part in split_top(x[1]):
                facts.ref("extends", symbol, plain_type(part), facts.line(m.start(1)))
        if x := re.search(r"\bimplements\s+([^{]+?)(?=\bpermits\b|$)", tail, re.S):
            for part in split_top(x[1]):
                facts.ref("implements", symbol, plain_type(part), facts.line(m.start(1)))
        if COMPONENTS & set(names):
            facts.symbol("bean", m[2][:1].lower() + m[2][1:], qualified, facts.line(m.start(1)), owner=symbol, bean=m[2][:1].lower() + m[2][1:])
        _usages(facts, marks, symbol, qualified)
        _type_semantics(facts, text, code, m, marks, qualified, symbol, end, service)

    def owner_of(offset: int):
        return next((t for t in reversed(types) if t[0] < offset < t[1]), None)

    members = []  # body start, body end, id, owner
    for m in _CALLABLE.finditer(code):
        owner = owner_of(m.start(2))
        if owner is None or m[2] in CONTROL or (m[1] or "").split(" ")[0] in CONTROL or code[: m.start(2)].rstrip().endswith(("@", ".")):
            continue
        opening = m.end() - 1
        close = rounds.get(opening, len(code))
        after = re.match(r"\s*(?:throws\s+[\w.,\s]+?)?\s*([{;]|default\b)", code[close + 1 :])
        constructor = m[2] == owner[4] and not (m[1] or "").strip() or m[2] == owner[4] and m[1] in ("public", "protected", "private")
        if not after or (not constructor and (not m[1] or m[1] in ("return", "throw", "new", "else"))):
            continue
        if any(b < m.start(2) < e for b, e, *_ in members):
            continue
        body = close + 1 + after.start(1) if after[1] == "{" else None
        end = braces.get(body, len(code)) if body is not None else close
        kind = "constructor" if constructor else "method"
        name = "<init>" if constructor else m[2]
        qualified = f"{owner[2]}.{name}"
        start = m.start(1) if m[1] else m.start(2)
        line_start = code.rfind("\n", 0, start) + 1
        marks = marks_before(start)
        symbol = facts.symbol(kind, m[2], qualified, facts.line(m.start(2)), facts.line(end), owner[3], " ".join(text[line_start : close + 1].split()), annotations=[a[2] for a in marks], overload=",".join(plain_type(" ".join(p.split()[:-1])) for p in split_top(text[opening + 1 : close])))
        members.append((body if body is not None else close, end, symbol, owner))
        for p in split_top(text[opening + 1 : close]):
            words = re.sub(r"@\w+(?:\([^)]*\))?", "", p).split()
            if len(words) >= 2:
                kind_of = plain_type(" ".join(words[:-1]))
                facts.symbol("parameter", words[-1], f"{qualified}.{words[-1]}", facts.line(m.start(2)), owner=symbol, type=kind_of)
                if constructor and kind_of[:1].isupper():
                    facts.ref("injects", owner[3], kind_of, facts.line(m.start(2)))
        if not constructor and m[1] and plain_type(m[1])[:1].isupper():
            facts.ref("references", symbol, plain_type(m[1]), facts.line(m.start(2)))
        _usages(facts, marks, symbol, qualified)
        _routes(facts, marks, owner, symbol, qualified)
        if any(a[2] == "Bean" for a in marks):
            facts.symbol("bean", m[2], qualified, facts.line(m.start(2)), owner=symbol, bean=m[2])
        _member_semantics(facts, marks, symbol, service)
    bare = list(code)
    for start, end, *_ in annotations:
        bare[start:end] = [c if c == "\n" else " " for c in code[start:end]]
    for m in _FIELD.finditer("".join(bare)):
        owner = owner_of(m.start(3))
        if owner is None or any(b < m.start(3) < e for b, e, *_ in members):
            continue
        marks = marks_before(m.start(1) if m[1] else m.start(2))
        symbol = facts.symbol("field", m[3], f"{owner[2]}.{m[3]}", facts.line(m.start(3)), owner=owner[3], type=plain_type(m[2]), annotations=[a[2] for a in marks])
        owner[5][m[3]] = plain_type(m[2])
        if {"Autowired", "Resource", "Inject"} & {a[2] for a in marks}:
            facts.ref("injects", owner[3], plain_type(m[2]), facts.line(m.start(3)))
        _usages(facts, marks, symbol, f"{owner[2]}.{m[3]}")
    for body, end, symbol, owner in members:
        inside = code[body:end]
        for m in re.finditer(r"\b([a-zA-Z_]\w*)\s*\.\s*([a-zA-Z_]\w*)\s*\(", inside):
            receiver = owner[5].get(m[1], m[1])
            facts.ref("calls", symbol, f"{receiver}.{m[2]}" if receiver != "this" else m[2], facts.line(body + m.start()))
        for m in re.finditer(r"\bnew\s+([A-Z]\w*)\s*(?:<[^<>()]*>)?\s*\(", inside):
            facts.ref("instantiates", symbol, m[1], facts.line(body + m.start()))
        for m in SENDERS.finditer(inside):
            at = body + m.end() - 1
            arguments = split_top(text[at + 1 : rounds.get(at, at)])
            if arguments and service:
                _sent(facts, m[1].lower(), m[2], arguments, text[body:end], service, facts.line(at))
    if service:
        for m in REDIS.finditer(text):
            kind = "writes_cache" if ".set(" in m[0] else "reads_cache"
            _cached(facts, m[1], kind, f"service:{service}", facts.line(m.start()), service)
    _value_logins(facts, text, service)
    _logins(facts, text, service)
    return facts


#: A key given to a Redis template as a literal.
REDIS = re.compile(r'\b\w*[rR]edisTemplate\.[\w().]+\(\s*"([^"\n]+)"')
_LOCAL_STRING = r"\b{}\s*=\s*([^=;\n][^;\n]*);"


def _sent(facts: Facts, sender: str, method: str, arguments: list[str], body: str, service: str, line: int) -> None:
    """A message sent: to an exchange with its routing key, else to a topic; what local assignments say of the destination is
    put in, and what only constants of other files tell is left to ``resolved_publishes`` as a ``publish`` row."""
    def meant(expression: str) -> list[str]:
        given = re.findall(_LOCAL_STRING.format(re.escape(expression)), body) if re.fullmatch(r"[A-Za-z_]\w*", expression) else []
        return list(dict.fromkeys(g.strip() for g in given)) or [expression]

    exchange = "rabbit" in sender and method == "convertAndSend" and len(arguments) >= 3
    tagged = "rocket" in sender
    for first in meant(arguments[0].strip()):
        for second in meant(arguments[1].strip()) if exchange else [""]:
            parts = [first, second] if exchange else [first]
            told = [re.fullmatch(r'"([^"]+)"', p) for p in parts]
            if all(told):
                _published(facts, ":".join(t[1] for t in told), service, line, tagged, exchange)
            else:
                facts.add("publish", "mq_exchange" if exchange else "mq_topic", name=" + \":\" + ".join(parts), source=f"service:{service}", start=line, tagged=tagged or None)


def _cached(facts: Facts, key: str, kind: str, source: str, line: int, service: str | None) -> None:
    facts.symbol("cache_key", key, f"cache_key:{key}", line, cache_key=key)
    facts.edge(kind, source, f"cache_key:{key}", line)
    facts.chunk("redis_cache_flow", key, f"Cache: {key}\nAccess: {kind}\nService: {service or ''}\nSource: {facts.path}:{line}", line, line, cache_key=key)


def _logs_in(facts: Facts, provider: str, service: str | None, line: int, title: str, lines: list[str], **metadata) -> None:
    facts.symbol("oauth_provider", provider, f"oauth_provider:{provider}", line, provider=provider)
    facts.edge("uses_oauth_provider", f"service:{service or 'unknown-service'}", f"oauth_provider:{provider}", line, **metadata)
    text = [f"Service: {service or ''}", f"Provider: {provider}", f"Source: {facts.path}:{line}", *lines]
    facts.chunk("third_party_login", title, _masked("\n".join(text)), line, line, provider=provider)


def _logins(facts: Facts, text: str, service: str | None) -> None:
    """Lines about a login at a provider; a QQ link that leads nowhere is none."""
    for number, line in enumerate(text.splitlines(), 1):
        found = provider_of(line)
        if found and not (found == "QQ" and 'href="#"' in line and "oauth" not in line.lower()):
            _logs_in(facts, found, service, number, f"Third-party login {found}", [f"Evidence: {line.strip()}"], evidence=_masked(line.strip())[:300])


def _value_logins(facts: Facts, text: str, service: str | None) -> None:
    for m in re.finditer(r'@Value\(\s*"\$\{([^}:]+)(?::[^}]*)?\}"\s*\)', text):
        if "oauth" in m[1].lower():
            _logs_in(facts, provider_of(m[1]) or "OAuth2", service, facts.line(m.start()), f"OAuth config {m[1]}", [f"Config key: {m[1]}"], config_key=m[1])


def config_facts(path: str, text: str, service: str | None) -> Facts:
    """The settings file itself with a chunk of its masked settings, and the login providers that its keys name."""
    facts, values = Facts(path, text), masked_settings(path, text)
    if "!error" in values:
        raise ValueError(values["!error"])
    last = len(text.splitlines()) or 1
    facts.symbol("config", path.rsplit("/", 1)[-1], f"config:{path}", 1, last, service=service)
    facts.chunk("spring_config", f"Spring config {path}", "\n".join([f"Service: {service or ''}", f"Config file: {path}", "Properties:", *(f"{k}={v}" for k, v in sorted(values.items()))]), 1, last, keys=sorted(values))
    for key, value in values.items():
        if any(w in key.lower() for w in ("oauth", "client.id", "redirect_uri")):
            last_part = key.rsplit(".", 1)[-1]
            line = next((i for i, row in enumerate(text.splitlines(), 1) if key in row or re.match(rf"\s*{re.escape(last_part)}\s*:", row)), 1)
            _logs_in(facts, provider_of(f"{key} {value}") or "OAuth2", service, line, f"OAuth config {key}", [f"Config key: {key}"], config_key=key)
    return facts


def html_facts(path: str, text: str, service: str | None) -> Facts:
    facts = Facts(path, text)
    _logins(facts, text, service)
    return facts


def _usages(facts: Facts, marks: list, target: str, qualified: str) -> None:
    for i, (start, _, name, values) in enumerate(marks):
        main = primary(values)
        symbol = facts.symbol("annotation_usage", f"@{name} {main}" if main else f"@{name}", f"annotation_usage:{name}:{main or ''}:{qualified}:{i}", facts.line(start), annotation=name, values=values, target_qualified_name=qualified, target_symbol_id=target)
        facts.edge("annotated_by", target, symbol, facts.line(start))
        facts.edge("annotates", symbol, target, facts.line(start))


def _paths(values: dict) -> list[str]:
    found = values.get("value", values.get("path", ""))
    return [p for p in (found if isinstance(found, list) else [found]) if isinstance(p, str)] or [""]


def _routes(facts: Facts, marks: list, owner: tuple, symbol: str, qualified: str) -> None:
    prefixes = next((_paths(a[3]) for a in owner[6] if a[2] == "RequestMapping"), [""])
    for start, _, name, values in marks:
        if name not in ROUTES:
            continue
        method = ROUTES[name]
        if name == "RequestMapping" and (m := re.search(r"RequestMethod\.([A-Z]+)", str(values.get("method", "")))):
            method = m[1]
        for prefix in prefixes:
            for path in _paths(values):
                route = "/" + "/".join(p for p in f"{prefix}/{path}".split("/") if p)
                target = facts.symbol("route", f"{method} {route}", f"{method} {route}", facts.line(start), owner=symbol, http_method=method, path=route, handler=qualified)
                facts.edge("maps_route", target, symbol, facts.line(start))


def _published(facts: Facts, destination: str, service: str, line: int, tagged: bool, exchange: bool = False) -> None:
    kind = "mq_exchange" if exchange else "mq_topic"
    topic, sign, tag = destination.partition(":")
    name = topic if tagged else destination
    facts.symbol(kind, name, f"{kind}:{name}", line, topic=name)
    facts.edge("publishes", f"service:{service}", f"{kind}:{name}", line)
    facts.chunk("mq_flow", name, f"Message: {name}\nDirection: publishes\nService: {service}\nSource: {facts.path}:{line}", line, line, destination=destination)
    if tagged and sign:
        facts.symbol("mq_tag", tag, f"mq_tag:{topic}:{tag}", line, topic=topic, tag=tag)


def snake(name: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"(.)([A-Z][a-z]+)", r"\1_\2", name)).lower()


def _type_semantics(facts: Facts, text: str, code: str, m: re.Match, marks: list, qualified: str, symbol: str, end: int, service: str | None) -> None:
    line = facts.line(m.start(1))
    for start, _, name, values in marks:
        if name == "TableName" and (table := primary(values)):
            facts.symbol("db_table", table, f"db_table:{table}", line, table=table)
            facts.symbol("data_contract", m[2], f"data_contract:{qualified}", line, table=table)
            facts.edge("defines_contract", f"data_contract:{qualified}", f"db_table:{table}", line)
            columns = []
            for f in re.finditer(r"\bprivate\s+([\w<>?, ]+?)\s+([A-Za-z_]\w*)\s*(?:=[^;]*)?;", code[m.end() : end]):
                column = snake(f[2])
                columns.append(column)
                facts.symbol("db_column", column, f"db_column:{table}.{column}", facts.line(m.end() + f.start()), column=column, table=table)
                facts.edge("maps_field", f"field:{qualified}.{f[2]}", f"db_column:{table}.{column}", facts.line(m.end() + f.start()))
            facts.chunk("db_table_summary", table, f"Table: {table}\nEntity: {qualified}\nColumns: {', '.join(columns)}", line, facts.line(end), table=table)
        elif name == "FeignClient" and service and (remote := values.get("name") or primary(values)):
            facts.symbol("remote_service", str(remote), f"remote_service:{remote}", line, service=remote)
            facts.edge("calls_remote_service", f"service:{service}", f"remote_service:{remote}", line)
        elif name in LISTENERS:
            _listens(facts, name, values, line, service)
    if x := re.search(r"\b(BaseMapper|ServiceImpl)\s*<([^<>]*)>", m[3]):
        entity = x[2].split(",")[-1].strip()
        table = snake(re.sub("Entity$", "", entity))
        facts.symbol("mapper", m[2], f"mapper:{qualified}", line, entity=entity)
        for kind in ("reads_table", "writes_table"):
            facts.edge(kind, f"mapper:{qualified}", f"db_table:{table}", line, 0.72, entity=entity)


def _listens(facts: Facts, name: str, values: dict, line: int, service: str | None) -> None:
    kind, key = LISTENERS[name]
    found = values.get(key, values.get("value"))
    for destination in found if isinstance(found, list) else [found]:
        if isinstance(destination, str) and destination and service:
            facts.symbol(kind, destination, f"{kind}:{destination}", line)
            facts.edge("consumes", f"service:{service}", f"{kind}:{destination}", line)
            facts.chunk("mq_flow", destination, f"Message: {destination}\nDirection: consumes\nService: {service}\nSource: {facts.path}:{line}", line, line, destination=destination)


def _member_semantics(facts: Facts, marks: list, symbol: str, service: str | None) -> None:
    for start, _, name, values in marks:
        line = facts.line(start)
        if name in LISTENERS:
            _listens(facts, name, values, line, service)
        elif name in CACHES and (key := primary(values) or (values.get("cacheNames") if isinstance(values.get("cacheNames"), str) else None)):
            _cached(facts, key, CACHES[name], f"service:{service}" if service else symbol, line, service)
        elif name in GUARDS and (rule := primary(values)):
            facts.symbol("permission_rule", rule, f"permission_rule:{rule}", line, permission=rule, rule_kind=name)
            facts.edge("requires_permission", symbol, f"permission_rule:{rule}", line)
            facts.chunk("permission_rule", rule, f"Permission: {rule}\nMember: {symbol}", line, line)


def tables_of(sql: str, operation: str) -> list[str]:
    patterns = {"select": (r"\bfrom{}", r"\bjoin{}"), "insert": (r"\binsert\s+into{}",), "update": (r"\bupdate{}",), "delete": (r"\bdelete\s+from{}",)}[operation]
    found = [t.split(".", 1)[-1] for p in patterns for t in re.findall(p.format(r"\s+`?([A-Za-z_][\w.]*)`?"), sql, re.I)]
    return list(dict.fromkeys(t for t in found if t.lower() != "select"))


def mybatis_facts(path: str, text: str) -> Facts:
    """Statements of a mapper file, the tables they read and write, and a chunk each."""
    facts = Facts(path, text)
    space = m[1] if (m := re.search(r'<mapper\s[^>]*namespace="([^"]+)"', text)) else path
    facts.symbol("mapper", space.rsplit(".", 1)[-1], f"mapper:{space}", 1)
    for m in re.finditer(r"<(select|insert|update|delete)\b([^>]*)>(.*?)</\1>", text, re.I | re.S):
        name = x[1] if (x := re.search(r'\bid="([^"]+)"', m[2])) else None
        if name is None:
            continue
        operation, line, end = m[1].lower(), facts.line(m.start()), facts.line(m.end())
        plain = " ".join(re.sub(r"<[^>]+>", " ", m[3]).split())
        qualified = f"{space}#{name}"
        facts.symbol("sql_statement", name, qualified, line, end, operation=operation, id=name, dynamic=bool(re.search("<if|<foreach|<choose|<where|<set", m[3])))
        facts.edge("maps_to_sql", f"method:{space}.{name}", f"sql_statement:{qualified}", line)
        for table in tables_of(plain, operation):
            facts.symbol("db_table", table, f"db_table:{table}", line, table=table)
            facts.edge("reads_table" if operation == "select" else "writes_table", f"sql_statement:{qualified}", f"db_table:{table}", line, 0.92)
        facts.chunk("mybatis_sql", qualified, plain, line, end, operation=operation)
    return facts


def ddl_facts(path: str, text: str) -> Facts:
    facts = Facts(path, text)
    names = []
    for m in re.finditer(r"\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?`?([A-Za-z_][\w.]*)`?", text, re.I):
        names.append(m[1])
        facts.symbol("db_table", m[1], f"db_table:{m[1]}", facts.line(m.start()), table=m[1])
    if names:
        facts.chunk("db_table_summary", path, "Tables: " + ", ".join(dict.fromkeys(names)), 1, len(facts.breaks) + 1)
    return facts


TOKEN = re.compile(r"[一-鿿]|[A-Za-z0-9_./:\-]+")


def packed(blocks: list[tuple[int, int, str]], target: int, most: int) -> list[tuple[int, int, str]]:
    """Blocks (first line, last line, text) joined to pieces of about ``target`` and at most ``most`` tokens; a larger block
    is cut at sentences, a larger sentence at tokens."""
    pieces: list[tuple[int, int, str]] = []
    held: list[tuple[int, int, str]] = []
    size = 0

    def close() -> None:
        nonlocal held, size
        if held:
            pieces.append((held[0][0], held[-1][1], "\n\n".join(b[2] for b in held)))
        held, size = [], 0

    for first, last, text in blocks:
        n = len(TOKEN.findall(text))
        if n > most:
            close()
            part = ""
            for sentence in [s for s in re.split(r"(?<=[.!?;。！？；])\s*", text) if s.strip()]:
                while len(found := list(TOKEN.finditer(sentence))) > most:
                    if part:
                        pieces.append((first, last, part))
                        part = ""
                    pieces.append((first, last, sentence[: found[most].start()].strip()))
                    sentence = sentence[found[most].start() :]
                if part and len(TOKEN.findall(part)) + len(TOKEN.findall(sentence)) > most:
                    pieces.append((first, last, part))
                    part = ""
                part = f"{part} {sentence}".strip()
            if part:
                pieces.append((first, last, part))
            continue
        if held and size + n > most:
            close()
        held.append((first, last, text))
        size += n
        if size >= target:
            close()
    close()
    return pieces


def markdown_facts(path: str, text: str, target: int = 600, most: int = 800, overlap: int = 120) -> Facts:
    """A parent chunk for each section under a heading and its children with what stands before and after them.

    Text before the first heading is dropped; a document without headings is one section named by its file. Headings inside
    fenced blocks are text. Secrets are masked.
    """
    facts = Facts(path, text)
    sections: list[tuple[list[str], int, list[tuple[int, str]]]] = []
    stack: list[tuple[int, str]] = []
    fenced = False
    lines = text.splitlines()
    for number, line in enumerate(lines, 1):
        if re.match(r"\s*(?:```|~~~)", line):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.*\S)", line)
        if m:
            stack = [h for h in stack if h[0] < len(m[1])] + [(len(m[1]), m[2])]
            sections.append(([h[1] for h in stack], number, []))
        elif sections:
            sections[-1][2].append((number, line))
    if not sections and lines:
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        sections = [([stem], 1, list(enumerate(lines, 1)))]
    for heading, start, body in sections:
        blocks: list[tuple[int, int, str]] = []
        held: list[tuple[int, str]] = []
        inside = False
        for number, line in [*body, (0, "")]:
            inside ^= bool(re.match(r"\s*(?:```|~~~)", line))
            if line.strip() or inside and number:
                held.append((number, line))
            elif held:
                blocks.append((held[0][0], held[-1][0], "\n".join(t for _, t in held).strip()))
                held = []
        if not blocks:
            continue
        title = " > ".join(heading)
        parent = "doc:" + sha256(f"{path}:{title}:{start}".encode()).hexdigest()[:32]
        pieces = packed(blocks, target, most)
        facts.chunk("project_knowledge_parent", title, _masked(f"Heading: {title}\nContent:\n" + "\n\n".join(b[2] for b in blocks)), start, blocks[-1][1], parent_doc_id=parent, children=len(pieces))
        for i, (first, last, piece) in enumerate(pieces):
            parts = [f"Source: {path}", f"Heading: {title}"]
            if i:
                parts += ["Context before:", " ".join(TOKEN.findall(pieces[i - 1][2])[-overlap:])]
            parts += ["Content:", piece]
            if i + 1 < len(pieces):
                parts += ["Context after:", " ".join(TOKEN.findall(pieces[i + 1][2])[:overlap])]
            facts.chunk("project_knowledge", title, _masked("\n".join(parts)), first, last, parent_doc_id=parent, chunk_index=i)
    return facts


def _masked(text: str) -> str:
    text = re.sub(r"(?i)(password|passwd|pwd|secret|token|access[_-]?key)=([^&\s]+)", r"\1=<redacted>", text)
    return re.sub(r"(?i)(client_secret:\s*|client\.secret[=:]\s*)(\S+)", r"\1=<redacted>", text)


def file_facts(path: str, language: str, text: str | None, service: str | None) -> list[tuple]:
    """All rows of one file; an ``error`` row where its text is missing, protected or cannot be read."""
    try:
        if text is None:
            raise ValueError("no text")
        if "\x00" in text:
            raise ValueError("binary or protected file")
        readers = {
            "java": lambda: java_facts(path, text, service), "mybatis_xml": lambda: mybatis_facts(path, text), "sql": lambda: ddl_facts(path, text), "markdown": lambda: markdown_facts(path, text),
            "config": lambda: config_facts(path, text, service), "html": lambda: html_facts(path, text, service),
        }
        if language in readers:
            found = readers[language]()
            if language != "markdown":
                named = service or "unknown-service"
                found.symbol("service", named, f"service:{named}", 1, service=named)
            return found.rows
        return []
    except Exception as error:  # noqa: BLE001
        return [(path, "error", language, None, None, None, None, None, None, None, f"{type(error).__name__}: {error}"[:500], None)]


def facts(files: DataFrame) -> DataFrame:
    """Every fact of every file (see SCHEMA); ``files``: path, language, text, service_name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for f in batch[["path", "language", "text", "service_name"]].itertuples(index=False) for r in file_facts(f[0], f[1], f[2], f[3])]
            out = pd.DataFrame(rows, columns=COLUMNS)
            for column in ("start_line", "end_line"):
                out[column] = out[column].astype("Int32")
            yield out

    return files.select("path", "language", "text", "service_name").mapInPandas(run, SCHEMA)


def resolved_publishes(facts: DataFrame, constants: DataFrame) -> DataFrame:
    """The facts with every ``publish`` row turned into its destination's symbol and edge, as constants (alias, value) tell it.

    An expression that they do not tell stays as it is written, as the name of a destination.
    """
    rows = facts.where("record = 'publish'")
    values = string_value(rows.select("path", F.col("name").alias("expression")), constants, "path")
    told = rows.withColumnRenamed("name", "expression").join(values, ["path", "expression"])
    tagged = F.coalesce(F.get_json_object("metadata", "$.tagged") == "true", F.lit(False)) & (F.col("kind") == "mq_topic")
    name = F.when(tagged, F.substring_index("value", ":", 1)).otherwise(F.col("value"))
    none = F.lit(None).cast("string")
    base = told.select("path", "kind", "start_line", "source", name.alias("name"), F.concat_ws(":", "kind", name).alias("key"))
    symbols = base.select("path", F.lit("symbol").alias("record"), "kind", "name", F.col("key").alias("qualified_name"), "start_line", F.col("start_line").alias("end_line"), F.lit("").alias("source"), F.lit("").alias("target"), F.lit("").alias("signature"), F.lit("").alias("content"), F.to_json(F.struct(F.col("name").alias("topic"))).alias("metadata"))
    edges = base.select("path", F.lit("edge").alias("record"), F.lit("publishes").alias("kind"), F.lit("").alias("name"), F.lit("").alias("qualified_name"), "start_line", none.cast("int").alias("end_line"), "source", F.col("key").alias("target"), F.lit("").alias("signature"), F.lit("").alias("content"), F.lit('{"confidence": 1.0}').alias("metadata"))
    return facts.where("record <> 'publish'").select(*COLUMNS).unionByName(symbols.select(*COLUMNS)).unionByName(edges.select(*COLUMNS))


def resource_facts(files: DataFrame, resources: DataFrame) -> DataFrame:
    """Resource symbols and ``uses_resource`` edges of the services whose settings name them.

    ``files``: path, service_name; ``resources``: path, resource_type, normalized_name.
    """
    rows = resources.join(files.select("path", F.coalesce("service_name", F.lit("unknown-service")).alias("service")), "path")
    key = F.concat_ws(":", F.lit("resource"), "resource_type", "normalized_name")
    blank, one = F.lit(""), F.lit(1)
    symbols = rows.select("path", F.lit("symbol").alias("record"), F.lit("resource").alias("kind"), F.col("normalized_name").alias("name"), key.alias("qualified_name"), one.alias("start_line"), one.alias("end_line"), blank.alias("source"), blank.alias("target"), blank.alias("signature"), blank.alias("content"), F.to_json(F.struct("resource_type")).alias("metadata"))
    edges = rows.select("path", F.lit("edge").alias("record"), F.lit("uses_resource").alias("kind"), blank.alias("name"), blank.alias("qualified_name"), one.alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.concat(F.lit("service:"), "service").alias("source"), key.alias("target"), blank.alias("signature"), blank.alias("content"), F.lit('{"confidence": 1.0}').alias("metadata"))
    return symbols.unionByName(edges)
