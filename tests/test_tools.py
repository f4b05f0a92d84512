from datetime import datetime as D

import pytest

from codeloom import __main__ as cli
from codeloom.functions import hints as hint
from codeloom.operators import store
from codeloom.plans import resolve, tools
from codeloom.plans.planner import Step

SYMBOL = "id string, project_id string, file_id string, kind string, name string, qualified_name string, annotations string, metadata string, signature string, start_line int, end_line int"
EDGE = "id long, source_id string, target_id string, kind string, line int, confidence double"


def bench(spark, **more):
    symbols = [
        ("s1", "p", "f1", "class", "CartService", "a.CartService", "[]", "{}", None, 3, 90), ("s2", "p", "f1", "method", "mergeCart", "a.CartService.mergeCart", None, None, "void mergeCart()", 10, 20),
        ("s3", "p", "f2", "method", "save", "b.Repo.save", '["Transactional"]', '{"x": 1}', "void save()", 5, 5), ("s4", "p", "f2", "db_table", "t_cart", "db_table:t_cart", None, None, None, 1, 1), ("s5", "p", "none", "class", "Lost", "Lost", None, None, None, 1, 1),
    ]
    edges = [(1, "s1", "s2", "contains", 10, 1.0), (2, "s2", "s3", "calls", 12, None), (3, "s3", "s4", "writes_table", None, 0.9), (4, "s2", "gone", "calls", 13, 1.0), (5, None, "s2", "calls", 1, 1.0)]
    files = [("f1", "core/src/a/CartService.java", "core", None), ("f2", "store/src/b/Repo.java", None, "store")]
    texts = [("core/src/a/CartService.java", "\n".join(f"line {i}" for i in range(1, 40))), ("store/src/b/Repo.java", "one\r\ntwo {")]
    return tools.Workbench(
        spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(edges, EDGE), spark.createDataFrame(files, "id string, path string, module_name string, service_name string"), texts=spark.createDataFrame(texts, "path string, text string"), **more,
    )


def seen(evidence):
    return [(r.evidence_type, r.symbol) for r in evidence.orderBy("position").collect()]


def test_artifacts_by_terms_kinds_module_and_hints(spark):
    b = bench(spark, hints={"篮": ["CartService"]})
    assert seen(tools.artifact_search(b, Step("artifact_search", "mergeCart"))) == [("artifact_class", "a.CartService"), ("artifact_method", "a.CartService.mergeCart"), ("artifact_db_table", "db_table:t_cart")]
    assert seen(tools.artifact_search(b, Step("artifact_search", "cart", {"kinds": ["method"], "module": "core"}))) == [("artifact_method", "a.CartService.mergeCart")]
    assert ("artifact_class", "a.CartService") in seen(tools.artifact_search(b, Step("artifact_search", "篮")))
    assert seen(tools.artifact_search(b, Step("artifact_search", "nothing_here", {"module": "core"}))) == [("module_scope_empty", "core")]


def test_relations_targets_and_sources(spark):
    b = bench(spark)
    near = tools.relation_search(b, Step("relation_search", "CartService"))
    assert seen(near) == [("edge:calls", "a.CartService.mergeCart -> b.Repo.save"), ("edge:contains", "a.CartService -> a.CartService.mergeCart"), ("edge:writes_table", "b.Repo.save -> db_table:t_cart")]
    found = tools.target_trace(b, Step("target_trace", "what writes t_cart", {"target": "t_cart", "direction": "incoming"}))
    assert seen(found)[0] == ("target_relation:writes_table", "b.Repo.save -> db_table:t_cart") and ("target_match", "db_table:t_cart") in seen(found)
    assert tools.target_trace(b, Step("target_trace", "what is this")).count() == 0
    read = tools.source_read(b, Step("source_read", "q"), found.withColumn("scope", tools.F.lit("hard"))).collect()
    texts = {r.file_path: r.content_excerpt for r in read}
    assert set(texts) == {"store/src/b/Repo.java", "core/src/a/CartService.java"} and all('"hard"' in r.metadata for r in read)
    assert texts["store/src/b/Repo.java"].startswith("one\ntwo") and texts["core/src/a/CartService.java"].startswith("line ")


def test_questions_end_to_end(spark):
    evidence, warnings, plan = tools.ask_evidence(bench(spark), "Which class is CartService?")
    assert warnings == ["unknown tool vector_search"] and evidence.count() >= 1 and tools.used_relational([s.tool for s in plan.steps])
    with pytest.raises(KeyError):
        tools.require("none")
    assert set(tools.registry(bench(spark))) == set(tools.TOOLS) - {"vector_search"}
    assert tools.module_of(tools.artifact_search(bench(spark), Step("artifact_search", "save"))) == "store"


def test_hints_weights_and_expansion(spark):
    hints = {"cart": ["CartService, basket"], "x": ["y"], "retry": ["a/b"]}
    assert hint.term_weights("which CART?", hints) == {"cart": 4, "cartservice, basket": 4, "cartservice": 4, "basket": 4}
    assert hint.expanded_query("api of cart", hints) == "api of cart CartService, basket endpoint route controller mapping"
    questions = spark.createDataFrame([(1, "which CART?"), (2, None), (3, "")], "question_id long, question string")
    table = spark.createDataFrame([(k, v) for k, vs in hints.items() for v in vs] + [(" ", "z"), (None, "z")], "keyword string, value string")
    got = {(r.question_id, r.term): r.weight for r in hint.hint_weights(questions, table).collect()}
    assert got == {(1, t): w for t, w in hint.term_weights("which CART?", hints).items()}
    assert hint.hint_weights(questions, table.limit(0)).count() == 0 and hint.is_http_question("路由") and not hint.is_http_question("cart")
    assert hint.json_safe({1, 2}) != {1, 2} and hint.json_safe([1]) == [1] and hint.strings([" a ", "", 3]) == ["a", "3"] and hint.string(" ") is None


def test_published_destinations(spark):
    body = 'String t = "orders";\nString t = Topics.B;\nkafka.send(t, x);\nmq.syncSend("a:b", y);\nmq.send(Other.C, z);'
    rows = spark.createDataFrame([("s", body), (None, body), ("e", None), ("f", "")], "symbol_id string, content string")
    constants = spark.createDataFrame([("Topics.B", "bee"), ("B", "bee")], "alias string, value string")
    got = {(r.line, r.raw, r.topic, r.tag) for r in hint.published(rows, constants).collect()}
    assert got == {(2, "t", "orders", None), (2, "t", "bee", None), (3, '"a:b"', "a", "b"), (4, "Other.C", "Other.C", None)}


def test_downstream_rank_and_named_rows(spark):
    methods = spark.createDataFrame([("1", "run", "a.Helper.run", "p1"), ("2", "run", "a.MyHelperX.run", "p2"), ("3", "go", "a.Src.go", "p3"), ("4", "other", "z.Z.other", "p3"), ("5", "o", "a.Src.o", "p9"), ("6", "o", "q.Q.o", "p8")], "id string, name string, qualified_name string, path string")
    calls = spark.createDataFrame([("helper", "run", 4), (None, "x", 1)], "receiver string, method string, n int")
    got = {r.id: (r.rank, r.call_order) for r in tools.downstream_rank(methods, methods.where("id = '3'"), calls).collect()}
    assert got == {"1": (0, 4), "2": (1, 4), "3": (9, None), "4": (2, None), "5": (3, None), "6": (6, None)}
    assert [(r.id, r.place) for r in tools.rows_by_ids(methods, ["4", "none", "1", "4"]).orderBy("place").collect()] == [("4", 0), ("1", 2)]


def test_outputs_vectors_files_and_short_methods(spark):
    b = bench(spark)
    edges = b.edges.withColumn("resolved_by", tools.F.when(tools.F.col("id") == 1, "tree").otherwise("refinement"))
    chunks = spark.createDataFrame([("c1", "f1", "artifact_class", "v1"), ("c2", "f2", "mq_flow", "v1"), ("c3", None, None, None)], "id string, file_id string, chunk_type string, template_version string")
    kept, left = store.clear_outputs(edges, chunks, b.symbols, spark.createDataFrame([("f1",), (None,)], "file_id string"))
    assert {r.id for r in kept.collect()} == {1, 3, 5} and {r.id for r in left.collect()} == {"c2", "c3"}
    assert [r.id for r in store.typed_chunks(chunks, "v1").collect()] == ["c1"] and store.without_typed(chunks, "v1").count() == 2
    fresh = spark.createDataFrame([("c1", "m", 2, "h1")], "chunk_id string, embedding_model string, embedding_dim int, content_hash string")
    once = store.upsert_embeddings(fresh.withColumn("id", tools.F.lit("")).limit(0), fresh)
    again = store.upsert_embeddings(once, fresh.withColumn("content_hash", tools.F.lit("h2")))
    assert [r.content_hash for r in again.collect()] == ["h2"] and once.first().id == again.first().id
    stored = spark.createDataFrame([("i1", "p", "a", "bad"), ("i2", "p", "b", "bad")], "id string, project_id string, path string, error string")
    rows, ids = store.upsert_files(stored, spark.createDataFrame([("p", "a"), ("p", "c")], "project_id string, path string"), ["project_id", "path"])
    assert {(r.path, r.error) for r in rows.collect()} == {("a", None), ("b", "bad"), ("c", None)} and {r.path: r.id for r in ids.collect()}["a"] == "i1"
    short = b.symbols.join(b.files.select(tools.F.col("id").alias("file_id"), "path"), "file_id").where("kind = 'method'").withColumn("start_line", tools.F.when(tools.F.col("id") == "s3", 2).otherwise(tools.F.col("start_line"))).withColumn("end_line", tools.F.col("start_line"))
    assert [r.id for r in store.cut_short(short, b.texts).collect()] == ["s3"]


def test_resolutions_projects_and_settings(spark):
    assert resolve.resolved(" q ", [], None)["question"] == "q"
    answer = '```json\n{"context_mode": "object_followup", "resolved_target": {"name": "CartService", "confidence": 1}, "rewritten_question": "What calls CartService?"}\n```'
    got = resolve.resolved("and who calls it?", [{"role": "user", "content": "x" * 2000}, {"role": "", "content": "y"}], lambda prompt: answer)
    assert got["targets"] == ["CartService"] and got["question"] == "What calls CartService?" and got["terms"] == []
    soft = resolve.normalised({"context_mode": "topic_followup", "resolved_targets": [{"name": "A"}, {"name": ""}, 3]}, "q")
    assert soft["targets"] == [] and soft["terms"] == ["A"] and resolve.normalised({"context_mode": 5}, "q")["kind"] == "new_topic"
    assert resolve.history_text([{"role": "user", "content": "x" * 2000}]).endswith("...") and resolve.history_text([]) == "No prior conversation."
    with pytest.raises(ValueError):
        resolve.parsed("[1]")
    projects = spark.createDataFrame([("p1", "/a/b")], "id string, root_path string")
    assert resolve.project_of(projects, "p1") == resolve.project_of(projects, None, "/a/b/") == "p1" and len(resolve.project_of(projects, None, "/new")) == 32
    for bad in ((" ", None), ("none", None), (None, None)):
        with pytest.raises(ValueError):
            resolve.project_of(projects, *bad)
    assert resolve.settings({"top_k": "12", "depth": None, "x": 1}).top_k == 12 and resolve.settings(None) == resolve.Retrieval()
    with pytest.raises(ValueError):
        resolve.settings({"depth": -1})


def test_command_line(capsys):
    assert cli.main(["list"]) == 0 and "p4_found" in capsys.readouterr().out
    assert cli.main(["run", "no_such_query", "x"]) == 2


def test_provider_retries_orders_and_gives_up():
    from codeloom.plans.provider import ProviderError, dependable

    failures, pauses = {"b": 2}, []

    def call(texts):
        if failures.get(texts[0], 0) > 0:
            failures[texts[0]] -= 1
            raise OSError("busy")
        return [(i, [float(ord(t))]) for i, t in reversed(list(enumerate(texts)))]

    assert dependable(call, 1, batch=1, sleep=pauses.append)(list("abc")) == [[97.0], [98.0], [99.0]] and pauses == [1.0, 2.0]
    assert dependable(call, 1, batch=2)(["a", "c", "d"]) == [[97.0], [99.0], [100.0]] and dependable(call, 1)([]) == []
    for bad in (lambda t: [(0, [1.0, 2.0])], lambda t: [(5, [1.0])], lambda t: 1 / 0):
        with pytest.raises(ProviderError):
            dependable(bad, 1, retries=1, sleep=pauses.append)(["x"])
    with pytest.raises(ValueError):
        dependable(call, 1, batch=0)
