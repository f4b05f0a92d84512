import math

import pytest
from pyspark.sql import functions as F

from codeloom.functions import annotations, text as tx
from codeloom.operators import graph, ranking, store, vector


def one(spark, expression, **columns):
    names = list(columns)
    schema = ", ".join(f"{n} {'string' if isinstance(v, (str, type(None))) else 'array<float>' if isinstance(v, list) else 'int'}" for n, v in columns.items())
    return spark.createDataFrame([tuple(columns[n] for n in names)], schema).select(expression.alias("x")).first().x


@pytest.mark.parametrize("name, snake", [("oauthClientID", "oauth_client_id"), ("HTTPServerError", "http_server_error"), ("order", "order"), ("", ""), (None, None)])
def test_camel_to_snake(spark, name, snake):
    assert one(spark, tx.camel_to_snake(F.col("t")), t=name) == snake


def test_tables_of_statements(spark):
    sql = "INSERT INTO `shop.orders` (a) VALUES (1) ON DUPLICATE KEY UPDATE a = 2"
    assert one(spark, tx.tables_in(F.col("t"), "insert"), t=sql) == ["orders"]
    assert one(spark, tx.tables_in(F.col("t"), "select"), t="select * from a join b on 1 join a from (select 1)") == ["a", "b"]
    assert one(spark, tx.tables_in(F.col("t"), "delete"), t="") == []


def test_redaction_keeps_the_key(spark):
    assert one(spark, tx.redact(F.col("t")), t="x?password=abc&y=1 client_secret: zzz") == "x?password=<redacted>&y=1 client_secret: =<redacted>"


def test_routes_and_destinations(spark):
    assert one(spark, tx.join_route(F.col("a"), F.col("b")), a="/api/", b="//list/") == "/api/list"
    assert one(spark, tx.join_route(F.col("a"), F.col("b")), a=None, b="") == "/"
    assert tuple(one(spark, tx.topic_and_tag(F.col("t")), t="orders:paid")) == ("orders", "paid")
    assert tuple(one(spark, tx.topic_and_tag(F.col("t")), t="amqp://host:1")) == ("amqp://host:1", None)


def test_embed_tokens_split_scripts(spark):
    assert one(spark, tx.embed_tokens(F.col("t")), t="Ab退款c-1 x") == ["ab", "退", "款", "退款", "c-1", "x"]
    assert one(spark, tx.embed_tokens(F.col("t")), t="") == []


def test_cosine_is_zero_where_undefined(spark):
    for a, b, value in [([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([math.nan, 1.0], [1.0, 0.0], 0.0), ([], [], 0.0)]:
        assert one(spark, vector.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(value)
    nulls = spark.createDataFrame([(None, [1.0])], "a array<float>, b array<float>")
    assert nulls.select(vector.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_blank_questions_and_types(spark):
    with pytest.raises(ValueError):
        vector.hash_topk(spark.createDataFrame([(1, "a")], "id int, t string"), "id", "t", " ", 3)
    assert vector.chunk_types(["method", "artifact_method", " ", None, "class"]) == ["artifact_method", "artifact_class"]


def test_vector_text_round_trip(spark):
    assert one(spark, vector.from_text(vector.to_text(F.col("v"))), v=[0.5, -0.25]) == [0.5, -0.25]


def test_merges_with_null_keys(spark):
    schema = "k string, line int, v string"
    old = spark.createDataFrame([("a", 1, "old"), ("b", None, "old")], schema)
    new = spark.createDataFrame([("b", None, "new"), ("c", 2, "new")], schema)
    assert {tuple(r) for r in store.merge(old, new, ["k", "line"]).collect()} == {("a", 1, "old"), ("b", None, "new"), ("c", 2, "new")}
    assert {tuple(r) for r in store.merge(old, new, ["k", "line"], update=False).collect()} == {("a", 1, "old"), ("b", None, "old"), ("c", 2, "new")}
    assert store.missing(old, new.limit(0), ["k"]).count() == 2


def test_first_and_last_wins(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y")], "k string, n int, v string")
    assert store.last_wins(rows, ["k"], ["n", "v"]).collect()[0].v == "y"
    assert store.first_wins(rows, ["k"], ["n"]).collect()[0].v == "x"
    assert store.last_wins(rows.limit(0), ["k"], ["n"]).count() == 0


def test_merged_json_new_keys_win(spark):
    assert one(spark, store.merged_json(F.col("a"), F.col("b")), a='{"x":"1","y":"2"}', b='{"y":"3"}') == '{"x":"1","y":"3"}'
    assert one(spark, store.merged_json(F.col("a"), F.col("b")), a=None, b="broken") == "{}"


def cycle(spark):
    symbols = spark.createDataFrame([(i, "method", i, f"p.{i}", "f") for i in "abcd"], "id string, kind string, name string, qualified_name string, file_id string")
    edges = spark.createDataFrame([(1, "a", "b", "calls", 1), (2, "b", "c", "calls", None), (3, "c", "a", "calls", 3), (4, "d", "a", "contains", 1), (5, "d", "a", "contains", 1), (6, None, "a", "calls", 1)], "id long, source_id string, target_id string, kind string, line int")
    return symbols, edges


def test_callers_keep_duplicates(spark):
    symbols, edges = cycle(spark)
    assert sorted(r.id for r in graph.callers(symbols, edges, "a").collect()) == ["c", "d", "d"]
    assert sorted(r.id for r in graph.callers(symbols, edges, "a", distinct=True).collect()) == ["c", "d"]
    assert sorted(r.id for r in graph.callees(symbols, edges, "p.d").collect()) == ["a", "a"]


def test_impact_and_expansion_end_on_cycles(spark):
    symbols, edges = cycle(spark)
    assert graph.impact(symbols, edges, "a", 0).count() == 0
    got = {r.id: r.depth for r in graph.impact(symbols, edges, "a", 9).collect()}
    assert got == {"c": 1, "d": 1, "b": 2, "a": 3}
    seeds = symbols.where("id = 'd'").select("id")
    assert {r.edge_id: r.hop for r in graph.expand(edges, seeds, 2).collect()} == {4: 1, 5: 1, 1: 2, 3: 2, 6: 2}


def test_top_edges_of_a_hot_node(spark):
    edges = spark.createDataFrame([(i, "hot", f"t{i:02}", "calls", None if i == 7 else i) for i in range(40)], "id long, source_id string, target_id string, kind string, line int")
    got = [r.id for r in graph.top_edges(edges, "source_id", "target_id", 5).orderBy("n").collect()]
    assert got == [7, 0, 1, 2, 3]


def test_resolution_rules(spark):
    symbols = spark.createDataFrame([
        ("1", "p", "class", "UserService", "x.UserService"), ("2", "p", "method", "save", "x.UserService.save"), ("3", "p", "method", "save", "y.Other.save"), ("4", "p", "method", "only", "y.Other.only"),
        ("5", "p", "class", "Dup", "a.Dup"), ("6", "p", "class", "Dup", "b.Dup"), ("7", "q", "class", "UserService", "x.UserService"), (None, "p", "class", "N", "N"),
    ], "id string, project_id string, kind string, name string, qualified_name string")
    refs = spark.createDataFrame([
        ("r1", "p", "calls", "Service.save"), ("r2", "p", "calls", "save"), ("r3", "p", "calls", "z.only"), ("r4", "p", "injects", "Dup"), ("r5", "p", "extends", "b.Dup"), ("r6", "p", "instantiates", "UserService"), ("r7", "p", "maps", "Dup"), ("r8", "p", "calls", None),
    ], "ref_id string, project_id string, reference_kind string, reference_name string")
    assert {r.ref_id: r.target_id for r in store.resolved(refs, symbols).collect()} == {"r1": "2", "r3": "4", "r5": "6", "r6": "1"}


def test_every_symbol_kind_has_a_dimension():
    kinds = {k for d in ranking.DIMENSIONS.values() for k in d.kinds}
    assert {"class", "interface", "enum", "method", "constructor", "field", "parameter", "route", "annotation_usage", "bean", "config", "resource", "file", "package", "import", "db_table"} <= kinds
    assert len(ranking.DIMENSIONS) == 35 and ranking.dimension_of(" DB-Table ").group_by == "table"
    assert ranking.dimension_of("定时任务").group_by == "job" and ranking.dimension_of("nonsense") is None


def test_prioritised_terms():
    assert ranking.prioritised(["ab", "order", "x_y", "order-service", "订单", "order"]) == ["order-service", "x_y", "order", "ab", "订单"]
    assert [ranking.limit_rule(k, 8) for k in (0, 1, 1000)] == [1, 8, 200]


def test_history_budget_cuts_the_oldest_kept(spark):
    rows = spark.createDataFrame([(1, i, "user", c) for i, c in enumerate(["aaaa", "  ", "bbbb", None, "cccc"])], "t int, n int, role string, content string")
    got = {r.n: r.content for r in ranking.history_tail(rows, ["t"], ["n"], 5, 6).collect()}
    assert got == {4: "cccc", 2: "bb"}


def test_annotation_values():
    assert annotations.values_of('value = {"/a", "/b"}, method = RequestMethod.GET, name = "x,\\"y"') == {"value": ["/a", "/b"], "method": "RequestMethod.GET", "name": 'x,"y'}
    assert annotations.values_of('"k", cond()') == {"value": "k", "value_1": "cond()"}
    assert annotations.primary({"a": ["z"]}) == "z" and annotations.primary({}) is None


def test_sentences_are_bare_of_blanks_and_keep_their_digits(spark):
    assert one(spark, tx.sentences(F.col("t")), t="0 rows. Row 1 is 1.\nOk 2") == ["0 rows.", "Row 1 is 1.", "Ok 2"]
    assert one(spark, tx.sentences(F.col("t")), t="　好。  再见！\n ") == ["好。", "再见！"]


def test_sentence_counts_agree_with_their_sql_on_odd_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from codeloom import text_queries

    odd = ["\n", " ", "", None, " ", "　", "\x0b", "​", " ", "a.\x0bb", "a.  ", "　。 a", "a. b", "1", "0", "x. 1", "a! 。b; c?d", "a.\r\n\tb", "。。 。", " .\n", "ja.\x85nein", "a。 "]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(text_queries.sentence_counts(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(text_queries.ORACLE["sentence_counts"]).fetchall())
