from codeloom.operators import trace


def tables(spark):
    symbols = spark.createDataFrame([
        ("m1", "method", "run", "p.A.run"), ("m2", "method", "save", "p.B.save"), ("m3", "method", "deep", "p.C.deep"), ("m4", "method", "deeper", "p.C.deeper"), ("t", "db_table", "t", "t"), ("j", "annotation_usage", "@XxlJob nightly", "x"), ("r", "method", "rerun", "p.A.rerun"),
    ], "id string, kind string, name string, qualified_name string")
    edges = spark.createDataFrame([("m1", "m2", "calls"), ("m2", "m3", "calls"), ("m3", "m4", "calls"), ("m3", "m1", "calls"), ("m2", "t", "writes_table"), ("m4", "t", "reads_table"), (None, "m1", "calls"), ("m1", "m2", "calls")], "source_id string, target_id string, kind string")
    return symbols, edges


def test_only_the_best_tier_counts(spark):
    symbols, _ = tables(spark)
    assert {r.id for r in trace.entry_points(symbols, ["RUN"]).collect()} == {"m1"}
    assert {r.id for r in trace.entry_points(symbols, ["a.r"]).collect()} == {"m1", "r"}
    assert {r.id for r in trace.entry_points(symbols, ["nightly", "run"]).collect()} == {"j"}
    assert trace.entry_points(symbols, []).count() == trace.entry_points(symbols.limit(0), ["run"]).count() == 0


def test_two_hops_and_tables(spark):
    got = {tuple(r) for r in trace.execution_trace(*tables(spark), ["run"]).collect()}
    assert got == {("execution_method", "m1", 0), ("execution_method", "m2", 1), ("execution_method", "m3", 2), ("execution_writes_table", "t", 1)}


def test_bodies(spark):
    body = "void a() {\r\n  if (x) { b.go(); }\n  bus.send(t);\n  c.run();\n}\nvoid z() { }"
    rows = spark.createDataFrame([("1", "s", body), ("2", "s2", "no block"), ("3", "s3", "{ open"), ("4", None, body), ("5", "s5", None)], "id string, symbol_id string, content string")
    assert [(r.line, r.detail) for r in trace.body_details(rows.where("id = '1'")).orderBy("line").collect()] == [(1, "control"), (2, "message"), (3, "call")]
    assert {r.id: (r.first_line, r.last_line) for r in trace.block_ends(rows).collect()} == {"1": (1, 5), "3": (1, 1), "4": (1, 5)}


def test_statements_tables_and_messages_of_a_refined_tree(spark, tmp_path):
    from codeloom.plans import refine

    service = 'package a;\n@Service\npublic class PayService {\n    private PayMapper payMapper;\n    private RocketMQTemplate rocketMQTemplate;\n    public void run(Pay p) {\n        payMapper.saveAll(p);\n        payMapper.purge(p);\n        rocketMQTemplate.syncSend("paid:new", p);\n    }\n    public void idle() {\n        rocketMQTemplate.syncSend("idle:x", 1);\n    }\n}\n'
    xml = '<mapper namespace="a.PayMapper"><insert id="saveAll">insert into pay_row values (1)</insert>\n<delete id="purge">delete from pay_old</delete>\n<select id="other">select 1 from pay_other</select></mapper>\n'
    put = {"m/pom.xml": "<p/>", "m/src/main/java/a/PayService.java": service, "m/src/main/java/a/PayMapper.java": "package a;\npublic interface PayMapper {\n    int saveAll(Pay p);\n}\n", "m/src/main/resources/mapper/PayMapper.xml": xml}
    for path, text in put.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    built = refine.refine(spark, str(tmp_path), "p")
    names = {r.id: r.qualified_name for r in built["symbols"].collect()}
    got = {(r.evidence_type, names[r.symbol_id], r.hop) for r in trace.execution_trace(built["symbols"], built["edges"], ["run"], hops=0, refs=built["refs"]).collect()}
    assert {("execution_method", "a.PayMapper#saveAll", 1), ("execution_method", "a.PayMapper#purge", 1), ("execution_writes_table", "db_table:pay_row", 1), ("execution_writes_table", "db_table:pay_old", 1)} <= got
    assert {n for e, n, _ in got if e == "execution_publishes"} == {"mq_topic:paid"} and not any("other" in n for _, n, _ in got)


def test_mapper_calls_in_bodies(spark):
    symbols = spark.createDataFrame([("m", "method", "run", "a.A.run"), ("s1", "sql_statement", "load", "x.PayMapper#load"), ("s2", "sql_statement", "load", "x.Other#load")], "id string, kind string, name string, qualified_name string")
    edges = spark.createDataFrame([("s1", "t", "reads_table")], "source_id string, target_id string, kind string")
    bodies = lambda text: spark.createDataFrame([("m", text)], "symbol_id string, content string")
    got = lambda text: {tuple(r) for r in trace.execution_trace(symbols, edges, ["run"], bodies=bodies(text)).collect()}
    assert got("{ payMapper.load(1); }") == {("execution_method", "m", 0), ("execution_method", "s1", 1), ("execution_reads_table", "t", 1)}
    assert ("execution_method", "s2", 1) in got("{ dao.load(1); }") and got("{ dao.get(1); }") == {("execution_method", "m", 0)}
