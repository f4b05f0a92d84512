"""What a question means in its conversation, which project it is about, and the settings of retrieval."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, functions as F

MODES = ("new_topic", "object_followup", "topic_followup", "clarification")


def history_text(messages: list[dict], most: int = 6, characters: int = 1000) -> str:
    """The last messages as ``role: content`` lines; blank ones are left out, long ones end in three dots."""
    lines = []
    for m in messages[-most:]:
        role, content = str(m.get("role") or "").strip(), str(m.get("content") or "").strip()
        if role and content:
            lines.append(f"{role}: {content if len(content) <= characters else content[: characters - 3] + '...'}")
    return "\n".join(lines) or "No prior conversation."


def parsed(answer: str) -> dict:
    """The JSON object of a model's answer, also inside a fence; anything else is an error."""
    payload = json.loads(re.sub(r"\A\s*```[^\n]*\n?|\n?```\s*\Z", "", answer))
    if not isinstance(payload, dict):
        raise ValueError("a resolution must be a JSON object")
    return payload


def _named(value: object) -> dict | None:
    if not isinstance(value, dict) or not isinstance(value.get("name"), str) or not value["name"].strip():
        return None
    confidence = value.get("confidence")
    return {
        "name": value["name"].strip(), "type": str(value.get("type") or "unknown"), "source": str(value.get("source") or "none"),
        "confidence": float(confidence) if isinstance(confidence, (int, float)) and not isinstance(confidence, bool) else 0.0,
    }


def normalised(payload: dict, question: str) -> dict:
    """(kind, question, targets, target_facts, terms, ...) of a resolver's payload, whatever is missing or of a wrong type replaced.

    Only a follow-up on an object keeps its targets as hard ones; those of other kinds become soft terms.
    """
    kind = payload.get("context_mode") if payload.get("context_mode") in MODES else "new_topic"
    listed = payload.get("resolved_targets") if isinstance(payload.get("resolved_targets"), list) else []
    facts = [t for t in map(_named, listed) if t] or [t for t in [_named(payload.get("resolved_target"))] if t]
    names = list(dict.fromkeys(t["name"] for t in facts))
    hard = payload.get("hard_constraints") if isinstance(payload.get("hard_constraints"), dict) else {}
    bound = [str(t).strip() for t in hard.get("targets") or [] if str(t).strip()] if isinstance(hard.get("targets"), list) else []
    rewritten = payload.get("rewritten_question")
    is_object = kind == "object_followup"
    return {
        "kind": kind, "question": rewritten.strip() if isinstance(rewritten, str) and rewritten.strip() else question, "targets": (bound or names) if is_object else [],
        "terms": [] if is_object else names, "target_facts": facts, "is_follow_up": bool(payload.get("is_follow_up")), "needs_clarification": bool(payload.get("needs_clarification")),
        "tools": [str(t).strip() for t in payload.get("preferred_tools") or [] if str(t).strip()] if isinstance(payload.get("preferred_tools"), list) else [],
    }


def resolved(question: str, history: list[dict], ask: Callable[[str], str] | None) -> dict:
    """What the question stands for: itself without a history or a model to ask, else as the model resolves it."""
    question = question.strip()
    if not history or ask is None:
        return normalised({}, question)
    return normalised(parsed(ask(f"Current question:\n{question}\n\nRecent conversation:\n{history_text(history)}")), question)


def project_of(projects: DataFrame, project_id: str | None = None, root_path: str | None = None) -> str:
    """The project's id: the given one if it exists, else that of the root path, a hash of the path where none is stored."""
    if project_id is not None:
        if not project_id.strip():
            raise ValueError("the project id is empty")
        if projects.where(F.col("id") == project_id.strip()).isEmpty():
            raise ValueError(f"no project {project_id}")
        return project_id.strip()
    if root_path is None or not root_path.strip():
        raise ValueError("a project id or a path is needed")
    path = root_path.strip().rstrip("/") or "/"
    row = projects.where(F.col("root_path") == path).orderBy("id").first()
    if row is not None:
        return row["id"]
    return projects.sparkSession.range(1).select(F.sha2(F.lit(path), 256).alias("h")).first()["h"][:32]


@dataclass(frozen=True)
class Retrieval:
    """Settings of retrieval and their defaults."""

    top_k: int = 8
    depth: int = 2
    max_top_k: int = 50
    max_depth: int = 3
    source_files: int = 6
    source_lines: int = 60
    line_padding: int = 3
    evidence_in_prompt: int = 60


def settings(raw: dict | None) -> Retrieval:
    """Settings from a mapping: numbers and numeric strings are taken, unknown keys and other values are not; negative ones are errors."""
    out = Retrieval()
    for f in fields(Retrieval):
        value = (raw or {}).get(f.name)
        if isinstance(value, str) and re.fullmatch(r"\s*-?\d+\s*", value):
            value = int(value)
        if isinstance(value, int) and not isinstance(value, bool):
            if value < 0:
                raise ValueError(f"{f.name} is negative")
            out = replace(out, **{f.name: value})
    return out
