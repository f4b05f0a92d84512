import pytest

from codeloom.plans import planner as pl


def tools(plan):
    return [s.tool for s in plan.steps]


def test_intents_in_order():
    assert pl.infer_intent("订单保存到哪张表") == "persistence_location" and pl.infer_intent("which table") == "table_usage"
    assert pl.infer_intent("x", "API_ENTRYPOINT") == "api_entrypoint" and pl.infer_intent("x", None, "table_name") == "table_usage"
    assert pl.infer_intent("hm") is None and pl.infer_intent("add a field to the api") == "task_planning"


def test_targets():
    assert pl.targets_in("where is oms_order written by OrderService from table") == ["oms_order", "OrderService"]
    assert pl.targets_in("x", ["T", ""]) == ["T"] and not pl.looks_like_target("service")


def test_persistence_about_a_target_becomes_a_trace():
    plan = pl.plan_for("where is oms_order saved", lambda q: {"retrieval_plan": {"steps": [{"tool_name": "aggregate_query"}]}})
    assert tools(plan) == ["target_trace"] and plan.steps[0].filters["target"] == "oms_order" and plan.steps[0].filters["edge_kinds"] == pl.PERSISTING_EDGES


def test_traces_jobs_and_planning():
    trace = pl.plan_for("OrderJob 的执行流程", lambda q: {"retrieval_plan": {"steps": [{"tool_name": "source_read"}]}})
    assert tools(trace)[0] == "execution_trace" and "source_read" not in tools(trace)
    job = pl.plan_for("哪个定时任务写入库存", lambda q: {"retrieval_plan": {"steps": [{"tool_name": "target_trace"}]}})
    assert tools(job) == ["vector_search", "aggregate_query"] and job.steps[1].filters["group_by"] == "job"
    assert tools(pl.plan_for("帮我规划 加字段"))[-1] == "source_read" and "source_read" not in tools(pl.plan_for("帮我规划 加字段", sources=False))


@pytest.mark.parametrize("payload", [{}, {"retrieval_plan": 3}, {"retrieval_plan": {"steps": ["x", None, {"tool_name": 5, "filters": []}]}}, '```json\n{"a": 1}\n```'])
def test_odd_payloads(payload):
    assert isinstance(pl.plan_for("hm", lambda q: payload), pl.Plan)


def test_payload_must_be_an_object():
    with pytest.raises(ValueError):
        pl.parse_payload("[1]")


def test_constraints_and_signatures():
    plan = pl.Plan("g", "unknown", (pl.Step("target_trace", "q"), pl.Step("aggregate_query", "q", {"group_by": "table", "x": 1})))
    bound = pl.with_constraints(plan, {"kind": "object_followup", "targets": ["A"]})
    assert bound.hard_targets == ("A",) and bound.steps[0].filters["target"] == "A" and pl.with_constraints(plan, {"kind": "new", "targets": ["A"]}) == plan
    assert pl.signature(plan.steps[1]) == pl.signature(pl.Step("aggregate_query", "other", {"group_by": "table", "x": 2}))


def test_execution(spark):
    schema = "evidence_type string, file_path string, start_line int, symbol string, position long"
    calls = []

    def tool(name, rows):
        def run(step, evidence):
            calls.append((name, evidence is not None))
            return spark.createDataFrame(rows, schema)
        return run

    plan = pl.Plan("g", "x", (pl.Step("source_read", "q"), pl.Step("artifact_search", "q"), pl.Step("artifact_search", "again"), pl.Step("nope", "q"), pl.Step("target_trace", "q"), pl.Step("source_read", "q", {"n": 1})), ("T",))
    found, warnings = pl.executed(plan, {"artifact_search": tool("a", [("t", "f", None, "s", 0)]), "target_trace": tool("t", [("t", "f", None, "s", 0), ("u", "g", 1, "s", 1)]), "source_read": tool("s", [("v", "f", 1, None, 0)])})
    assert warnings == ["unknown tool nope"] and calls == [("a", False), ("t", True), ("s", True)]
    assert {(r.evidence_type, r.scope) for r in found.collect()} == {("t", "soft"), ("u", "hard"), ("v", "soft")}
    assert pl.executed(pl.Plan("g", "x"), {}) == (None, [])


def test_small_rules():
    assert pl.clamps(None, None) == (8, 2) and pl.clamps(99, 9) == (50, 3) and pl.clamps(0, -1) == (1, 0)
    assert pl.group_for("jobs", "") == ("job", None) and pl.group_for("zzz", "")[0] == "artifact" and pl.group_for(None, "which table")[0] == "table"
    assert pl.expanded(" q ", "q", ["r", ""]) == ["q", "r"] and "1. [t] s f:3" in pl.prompt("q", [{"evidence_type": "t", "symbol": "s", "file_path": "f", "start_line": 3}], [], [])
