from datetime import datetime as D

import pytest

from codeloom.operators import chat
from codeloom.plans import refine

A = "package a;\n@Service\npublic class OrderService {\n    private OrderDao dao;\n    public void save(Order o) {\n        dao.insertOne(o);\n    }\n}\n"
DAO = "package a;\ninterface OrderDao extends BaseMapper<OrderEntity> {\n    int insertOne(Order o);\n}\n"
ENTITY = 'package a;\n@TableName("oms_order")\nclass OrderEntity {\n    private Long id;\n}\n'


def put(root, path, text):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


def content(tables):
    return {n: {tuple(r) for r in tables[n].select(*[c for c in sorted(tables[n].columns) if c not in ("modified_at",)]).collect()} for n in ("symbols", "edges", "refs", "chunks", "errors")}


def test_full_and_refreshed_builds_agree(spark, tmp_path):
    put(tmp_path, "m/pom.xml", "<p/>")
    for name, text in (("OrderService", A), ("OrderDao", DAO), ("OrderEntity", ENTITY)):
        put(tmp_path, f"m/src/main/java/a/{name}.java", text)
    put(tmp_path, "library/x.md", "# T\ntoken=abc")
    first = refine.refine(spark, str(tmp_path), "project:1")
    names = {r.id: r.qualified_name for r in first["symbols"].collect()}
    edges = {(names.get(r.source_id), r.kind, names.get(r.target_id)) for r in first["edges"].collect()}
    assert ("a.OrderService.save", "calls", "a.OrderDao.insertOne") in edges and ("data_contract:a.OrderEntity", "defines_contract", "db_table:oms_order") in edges
    assert not any("abc" in r.content for r in first["chunks"].collect())
    put(tmp_path, "m/src/main/java/a/OrderDao.java", DAO.replace("insertOne", "insertAll"))
    (tmp_path / "m/src/main/java/a/OrderEntity.java").unlink()
    assert content(refine.refresh(spark, str(tmp_path), "project:1", first)) == content(refine.refine(spark, str(tmp_path), "project:1"))


def test_builds_normalise_describe_and_embed(spark, tmp_path):
    put(tmp_path, "m/pom.xml", "<p/>")
    for name, text in (("OrderService", A), ("OrderDao", DAO), ("OrderEntity", ENTITY)):
        put(tmp_path, f"m/src/main/java/a/{name}.java", text)
    first = refine.refine(spark, str(tmp_path), "project:1", dim=16)
    names = {r.id: r.qualified_name for r in first["symbols"].collect()}
    moved = [(r.kind, names[r.target_id], r.metadata) for r in first["edges"].collect() if r.kind in ("reads_table", "writes_table")]
    assert {m[:2] for m in moved} == {("reads_table", "db_table:oms_order"), ("writes_table", "db_table:oms_order")} and all('"confidence":0.86' in m[2] and "db_table:order" in m[2] for m in moved)
    chunks = first["chunks"].collect()
    kinds = {r.chunk_type for r in chunks}
    assert {"artifact_class", "artifact_db_table", "artifact_mapper", "artifact_method_summary", "artifact_field_summary"} <= kinds and len({r.id for r in chunks}) == len(chunks)
    assert sorted(r.chunk_id for r in first["embeddings"].collect()) == sorted(r.id for r in chunks)
    put(tmp_path, "m/src/main/java/a/OrderService.java", A.replace("save", "store"))
    asked = spark.sparkContext.accumulator(0)

    def provider(texts):
        asked.add(len(texts))
        return [[1.0] * 16 for _ in texts]

    again = refine.refresh(spark, str(tmp_path), "project:1", first, dim=16, provider=provider)
    ids, old = {r.id for r in again["chunks"].collect()}, {r.id for r in chunks}
    assert {r.chunk_id for r in again["embeddings"].collect()} == ids and asked.value == len(ids - old) and 0 < len(ids - old) < len(ids)


def test_embeddings(spark):
    chunks = spark.createDataFrame([("1", "h", "order 订单"), ("2", "h", "")], "id string, content_hash string, content string")
    got = {r.id: r.embedding for r in refine.embedded(chunks, 16).collect()}
    assert abs(sum(x * x for x in got["1"]) - 1) < 1e-6 and not any(got["2"])
    with pytest.raises(Exception):
        refine.embedded(chunks, 16, lambda texts: [[1.0]]).collect()


def test_chat_snapshots(spark):
    at = D(2025, 1, 1)
    threads = spark.createDataFrame([], "id long, project_id string, user_id string, thread_id string, title string, created_at timestamp, updated_at timestamp")
    threads = chat.ensure(chat.create(threads, "p", "t", "x", at), "p", "t", at)
    with pytest.raises(ValueError):
        chat.create(threads, "p", "t", None, at)
    threads = chat.rename(chat.create(threads, "p", "u", None, at), "p", "u", "named", D(2025, 1, 2))
    assert [r.title for r in chat.listed(threads, "p").collect()] == ["named", "x"] and chat.listed(threads, "p", "other").count() == 0
    ids = {r.thread_id: r.id for r in threads.collect()}
    messages = spark.createDataFrame([(2, ids["t"], "user", "b", at), (1, ids["t"], "user", "a", at), (3, ids["u"], "user", "c", at)], "id long, thread_db_id long, role string, content string, created_at timestamp")
    assert [r.content for r in chat.history(threads, messages, "p", "t").collect()] == ["a", "b"]
    left, kept = chat.delete(threads, messages, "p", "t")
    assert left.count() == 1 and [r.content for r in kept.collect()] == ["c"]
