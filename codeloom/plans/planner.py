"""Retrieval plans for questions: intents, steps, defaults and constraints as pure functions, and their execution.

A planner is any callable from a question to a JSON-like payload; without one the rules alone decide. Steps become frames of
one evidence schema through a registry of tools, and only the final, limited rows are for the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from codeloom.operators.ranking import dimension_of, first_evidence


@dataclass(frozen=True)
class Intent:
    name: str
    tool: str
    filters: dict = field(default_factory=dict)
    terms: tuple[str, ...] = ()


#: Intents in order of precedence with their tool, default filters and the terms that show them.
INTENTS = [
    Intent("persistence_location", "aggregate_query", {"group_by": "table_name"}, ("入库", "存入", "存到", "存储", "保存", "写入", "落库", "持久化", "插入", "新增", "persist", "persistence", "save", "insert", "write", "store", "storage", "repository", "dao")),
    Intent("table_usage", "aggregate_query", {"group_by": "table_name"}, ("表", "数据库", "数据表", "用到了哪些表", "table", "mapper", "entity", "sql", "db_table")),
    Intent("api_entrypoint", "artifact_search", {"kinds": ["route", "class", "method"]}, ("接口", "路由", "入口", "api", "endpoint", "route", "controller", "mapping")),
    Intent("execution_flow", "artifact_search", {}, ("流程", "链路", "怎么执行", "怎么处理", "调用链", "flow", "process", "execution", "call chain")),
    Intent("task_planning", "artifact_search", {}, ("帮我规划", "实现方案", "改造方案", "修改方案", "需要改哪些", "影响范围", "基于现有", "基于已有", "怎么改", "如何改", "加字段", "新增字段", "新增功能", "修改功能", "plan", "implement", "change", "modify", "refactor", "implementation plan", "impact scope", "add field", "add column")),
]
BY_NAME = {i.name: i for i in INTENTS}
#: What a planning question says, alone or as an action on a scope.
PLANNING = ("帮我规划", "规划一下", "实现方案", "改造方案", "修改方案", "需要改哪些", "影响范围", "基于现有", "基于已有", "怎么改", "如何改", "怎么实现", "如何实现", "plan", "implementation plan", "impact scope")
ACTIONS = ("新增", "修改", "改造", "实现", "接入", "调整", "扩展", "加字段", "新增字段", "加列", "新增列", "建表", "新增表", "add", "change", "modify", "implement", "refactor", "extend")
SCOPES = ("任务", "需求", "功能", "字段", "表", "接口", "方法", "类", "调用链", "现有逻辑", "project", "feature", "field", "table", "api", "method", "class")
#: What asks for the steps of an execution, and how entry points are named.
TRACING = ("执行详细步骤", "详细步骤", "执行步骤", "执行流程", "详细流程", "详细过程", "执行过程", "怎么执行", "如何执行", "调用了什么", "查了什么表", "插入了什么", "写入了什么", "return", "continue", "execution flow", "execution steps", "call flow")
ENTRY_SUFFIXES = ("Handler", "Job", "Listener", "Task")
PERSISTING_EDGES = ["writes_table", "defines_contract"]
GENERIC = frozenset(("api", "class", "config", "controller", "dao", "data", "database", "entity", "feign", "from", "interface", "java", "mapper", "method", "route", "service", "table", "where"))
CLASS_SUFFIXES = ("Entity", "Service", "ServiceImpl", "Dao", "Mapper")
TOOL_ORDER = ["artifact_search", "relation_search", "vector_search", "aggregate_query", "target_trace", "execution_trace", "source_read"]
JOBS = ("job", "定时任务", "任务", "scheduled", "xxl")


@dataclass(frozen=True)
class Step:
    tool: str
    query: str
    filters: dict = field(default_factory=dict)
    reason: str = ""


@dataclass(frozen=True)
class Plan:
    goal: str
    intent: str
    steps: tuple[Step, ...] = ()
    hard_targets: tuple[str, ...] = ()


def parse_payload(text: str) -> dict:
    """The JSON object of a planner's answer, also inside a fenced block; anything else is an error."""
    bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)
    payload = json.loads(bare)
    if not isinstance(payload, dict):
        raise ValueError("a plan must be a JSON object")
    return payload


def _text(value: object, default: str = "") -> str:
    return value.strip() if isinstance(value, str) and value.strip() else default


def is_planning(question: str) -> bool:
    low = question.lower()
    return any(t in low for t in PLANNING) or any(t in low for t in ACTIONS) and any(t in low for t in SCOPES)


def infer_intent(question: str, explicit: str | None = None, group_by: str | None = None) -> str | None:
    """An explicit known intent, else tables for group_by table_name, else planning, else the first whose terms occur."""
    named = (explicit or "").strip().lower()
    if named in BY_NAME:
        return named
    if (group_by or "").strip().lower() == "table_name":
        return "table_usage"
    if is_planning(question):
        return "task_planning"
    low = question.lower()
    return next((i.name for i in INTENTS if any(t in low for t in i.terms)), None)


def looks_like_target(token: str) -> bool:
    """Whether a token names something in code: it has symbols, inner capitals or a class suffix, and is no generic word."""
    if len(token) < 3 or token.lower() in GENERIC:
        return False
    return any(c in token for c in "_.:/-") or bool(re.search(r"[a-z][A-Z]", token)) or token.endswith(CLASS_SUFFIXES)


def targets_in(question: str, explicit: list[str] = ()) -> list[str]:
    """Explicit targets first, then the question's tokens that look like one, each once."""
    tokens = [t.strip(".:/-") for t in re.findall(r"[A-Za-z_][A-Za-z0-9_./:\-]*", question)]
    return list(dict.fromkeys([*[t for t in explicit if t], *[t for t in tokens if looks_like_target(t)]]))


def normalised(payload: dict, question: str) -> Plan:
    """A plan from a planner's payload, whatever is missing or of a wrong type replaced."""
    understanding = payload.get("question_understanding") if isinstance(payload.get("question_understanding"), dict) else {}
    body = payload.get("retrieval_plan") if isinstance(payload.get("retrieval_plan"), dict) else {}
    raw = body.get("steps") if isinstance(body.get("steps"), list) else []
    steps = tuple(
        Step(_text(s.get("tool_name")), _text(s.get("query"), question), dict(s["filters"]) if isinstance(s.get("filters"), dict) else {}, _text(s.get("reason")))
        for s in raw if isinstance(s, dict)
    )
    return Plan(_text(body.get("task_goal"), _text(understanding.get("task_goal"), question)), _text(understanding.get("intent"), "unknown"), steps)


def has(plan: Plan, tool: str) -> bool:
    return any(s.tool == tool for s in plan.steps)


def with_intent_defaults(plan: Plan) -> Plan:
    """Default filters for steps that use their intent's tool; a persistence question about a target becomes a trace."""
    def one(step: Step) -> Step:
        known = plan.intent if plan.intent in BY_NAME else None
        intent = infer_intent(step.query, _text(step.filters.get("intent")) or known, step.filters.get("group_by"))
        if intent is None or BY_NAME[intent].tool != step.tool:
            return step
        filters = {**BY_NAME[intent].filters, **step.filters, "intent": intent}
        target = next(iter(targets_in(step.query)), None)
        if intent == "persistence_location" and target:
            return replace(step, tool="target_trace", filters={**filters, "target": target, "direction": "incoming", "edge_kinds": PERSISTING_EDGES})
        return replace(step, filters=filters)

    return replace(plan, steps=tuple(one(s) for s in plan.steps))


def asks_for_steps(question: str) -> bool:
    low = question.lower()
    return any(t in low for t in TRACING) or any(t.endswith(ENTRY_SUFFIXES) for t in re.findall(r"[A-Za-z_]\w+", question) if not t.islower() and re.search(r"[a-z][A-Z]", t) and any(w in low for w in ("step", "flow", "步骤", "流程")))


def with_trace_defaults(plan: Plan, question: str, sources: bool) -> Plan:
    """Questions about execution steps trace first and do not read sources by themselves."""
    if not sources or not asks_for_steps(question):
        return plan
    steps = [s for s in plan.steps if s.tool != "source_read"]
    if not has(plan, "execution_trace"):
        steps.insert(0, Step("execution_trace", question, {"intent": "execution_flow"}, "steps, branches, calls and persistence"))
    return replace(plan, steps=tuple(steps), intent="execution_flow" if plan.intent in ("unknown", "") else plan.intent)


def with_job_defaults(plan: Plan, question: str) -> Plan:
    """Which job persists something: rules from the library, then jobs aggregated; no traces."""
    low = question.lower()
    if not (any(j in low for j in JOBS) and any(t in low for t in BY_NAME["persistence_location"].terms)):
        return plan
    steps = [s for s in plan.steps if s.tool not in ("target_trace", "source_read", "execution_trace")]
    wanted = {"intent": "persistence_location", "group_by": "job"}
    if any(s.tool == "aggregate_query" for s in steps):
        steps = [replace(s, filters={**s.filters, **wanted}) if s.tool == "aggregate_query" else s for s in steps]
    else:
        steps.insert(0, Step("aggregate_query", question, wanted, "scheduled entry points that persist data"))
    if not any(s.tool == "vector_search" for s in steps):
        steps.insert(0, Step("vector_search", question, {"intent": "business_rule_lookup"}, "rules of the library"))
    return replace(plan, steps=tuple(steps), intent="persistence_location")


def with_planning_defaults(plan: Plan, question: str, sources: bool) -> Plan:
    """Planning questions use every kind of search once, in the known order, sources last and only if they may be read."""
    if plan.intent != "task_planning":
        return plan
    steps = list(plan.steps)
    for tool in ("artifact_search", "relation_search", "vector_search", "aggregate_query", "source_read"):
        if not any(s.tool == tool for s in steps) and (sources or tool != "source_read"):
            steps.append(Step(tool, question, {"intent": "task_planning", **({"group_by": "table_name"} if tool == "aggregate_query" else {})}))
    rank = lambda s: (s.tool == "source_read", TOOL_ORDER.index(s.tool) if s.tool in TOOL_ORDER else len(TOOL_ORDER))
    kept = [s for s in steps if sources or s.tool != "source_read"]
    return replace(plan, steps=tuple(sorted(kept, key=rank)))


def with_constraints(plan: Plan, resolution: dict | None) -> Plan:
    """Targets of a follow-up bind the traces of a plan; other resolutions only add soft terms."""
    if not resolution:
        return plan
    targets = [t for t in resolution.get("targets", []) if isinstance(t, str) and t.strip()]
    if resolution.get("kind") != "object_followup" or not targets:
        return plan
    bind = lambda s: replace(s, filters={**s.filters, "target": targets[0], "targets": targets}) if s.tool in ("target_trace", "execution_trace") else s
    return replace(plan, steps=tuple(bind(s) for s in plan.steps), hard_targets=tuple(targets))


def plan_for(question: str, planner: Callable[[str], str | dict] | None = None, sources: bool = True, resolution: dict | None = None) -> Plan:
    """The plan for a question, from a planner's answer if there is one, with every default applied in order."""
    answer = planner(question) if planner else {}
    payload = parse_payload(answer) if isinstance(answer, str) else answer
    plan = normalised(payload, question)
    if is_planning(question):
        plan = replace(plan, intent="task_planning")
    if not plan.steps and not planner:
        intent = infer_intent(question) or "unknown"
        tool = BY_NAME[intent].tool if intent in BY_NAME else "artifact_search"
        plan = replace(plan, intent=intent, steps=(Step(tool, question), Step("vector_search", question)))
    plan = with_intent_defaults(plan)
    plan = with_trace_defaults(plan, question, sources)
    plan = with_job_defaults(plan, question)
    plan = with_planning_defaults(plan, question, sources)
    return with_constraints(plan, resolution)


def signature(step: Step) -> str:
    """What makes two steps the same: tool and filters, of an aggregation only its group, module and path; not the text."""
    filters = {k: step.filters.get(k) for k in ("group_by", "module", "path_contains")} if step.tool == "aggregate_query" else step.filters
    return json.dumps([step.tool, filters], ensure_ascii=False, sort_keys=True, default=str)


Tool = Callable[[Step, DataFrame | None], DataFrame]


def executed(plan: Plan, tools: dict[str, Tool]) -> tuple[DataFrame | None, list[str]]:
    """(evidence, warnings): every distinct step once and in order, first evidence wins.

    ``source_read`` runs once, with the evidence found so far, and only if there is any; unknown tools warn. With hard
    targets the evidence of traces is marked hard, other evidence soft.
    """
    from pyspark.sql import functions as F

    parts, warnings, seen = [], [], set()
    for step in plan.steps:
        if not step.tool or signature(step) in seen:
            continue
        seen.add(signature(step))
        if step.tool not in tools:
            warnings.append(f"unknown tool {step.tool}")
            continue
        if step.tool == "source_read":
            if any(s == "source_read" for s, _ in parts) or not parts:
                continue
        found = tools[step.tool](step, first_evidence([p for _, p in parts]) if parts else None)
        scope = ("hard" if step.tool in ("target_trace", "execution_trace") else "soft") if plan.hard_targets else None
        parts.append((step.tool, found.withColumn("scope", F.lit(scope).cast("string"))))
    return (first_evidence([p for _, p in parts]) if parts else None), warnings


def group_for(group_by: str | None, question: str) -> tuple[str, str | None]:
    """(dimension, warning) of an aggregation: by name or alias; artifacts for an unknown one; tables if the intent says so."""
    if group_by:
        found = dimension_of(group_by)
        return (found.group_by, None) if found else ("artifact", f"unknown group {group_by}")
    return ("table", None) if infer_intent(question) in ("table_usage", "persistence_location") else ("artifact", None)


def clamps(top_k: int | None, depth: int | None) -> tuple[int, int]:
    """top_k within 1 and 50 (8 if absent), depth within 0 and 3 (2 if absent)."""
    return max(1, min(8 if top_k is None else top_k, 50)), max(0, min(2 if depth is None else depth, 3))


def expanded(question: str, rewrite: str | None = None, terms: list[str] = ()) -> list[str]:
    return list(dict.fromkeys(t.strip() for t in [question, rewrite or "", *terms] if t and t.strip()))


def prompt(question: str, evidence: list[dict], snippets: list[dict], history: list[dict], most: int = 60) -> str:
    """The text for an answering model: numbered evidence, snippets, history and the question."""
    lines = [f"{i}. [{e.get('evidence_type')}] {e.get('symbol') or ''} {e.get('file_path') or ''}:{e.get('start_line') or ''}".rstrip(": ") for i, e in enumerate(evidence[:most], 1)]
    parts = ["Evidence:", *lines] if lines else ["Evidence: none"]
    for s in snippets:
        parts += [f"Source {s['path']}:{s['start_line']}-{s['end_line']}", s["content"][:2500]]
    parts += [f"{h['role']}: {h['content'][:1000]}" for h in history[-6:]]
    return "\n".join([*parts, f"Question: {question}"])
