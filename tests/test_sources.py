import json

from codeloom.sources import extract, workspace

JAVA = '''package com.shop.order;

import java.util.List;
import static com.shop.Names.TOPIC;

/** class Fake { } in a comment */
@RestController
@RequestMapping("/orders")
public class OrderController extends BaseController implements Api, Closeable {
    private static final String KEY = "order:{";
    @Autowired
    private OrderService service;

    public OrderController(OrderService service) { this.service = service; }

    @GetMapping({"/list", "/all"})
    public List<Order> list(@RequestParam String name, int size) {
        if (size > 0) {
            service.find(name);
        }
        return new Page(name).items();
    }

    @RequestMapping(value = "/save", method = RequestMethod.POST)
    @PreAuthorize("hasRole('ADMIN')")
    Order save(Order order);

    class Inner {
        void act() { }
    }
}
'''
ENTITY = '''package com.shop;
@TableName("oms_order")
public class OrderEntity {
    private Long id;
    private String orderSn = "x";
}
interface OrderDao extends BaseMapper<OrderEntity> { }
'''


def rows(text, language="java", service="shop"):
    return [dict(zip(extract.COLUMNS, r)) for r in extract.file_facts("a/F." + language, language, text, service)]


def names(found, record, kind):
    return [r["qualified_name"] or r["name"] for r in found if r["record"] == record and r["kind"] == kind]


def test_java_structure_routes_and_references():
    found = rows(JAVA)
    assert names(found, "symbol", "class") == ["com.shop.order.OrderController", "com.shop.order.OrderController.Inner"]
    assert names(found, "symbol", "method") == ["com.shop.order.OrderController.list", "com.shop.order.OrderController.save", "com.shop.order.OrderController.Inner.act"]
    assert names(found, "symbol", "constructor") == ["com.shop.order.OrderController.<init>"]
    assert set(names(found, "symbol", "route")) == {"GET /orders/list", "GET /orders/all", "POST /orders/save"}
    refs = {(r["kind"], r["name"]) for r in found if r["record"] == "ref"}
    assert {("extends", "BaseController"), ("implements", "Api"), ("implements", "Closeable"), ("injects", "OrderService"), ("calls", "OrderService.find"), ("instantiates", "Page"), ("references", "List")} <= refs
    lists = next(r for r in found if r["kind"] == "method" and r["name"] == "list")
    assert (lists["start_line"], lists["end_line"]) == (17, 22)
    save = next(r for r in found if r["kind"] == "method" and r["name"] == "save")
    assert save["start_line"] == save["end_line"] == 26
    assert names(found, "symbol", "permission_rule") == ["permission_rule:hasRole('ADMIN')"]


def test_entities_and_mappers():
    found = rows(ENTITY)
    assert names(found, "symbol", "db_column") == ["db_column:oms_order.id", "db_column:oms_order.order_sn"]
    assert {(r["kind"], r["target"]) for r in found if r["record"] == "edge" and "reads" in r["kind"] or r["kind"] == "writes_table"} == {("reads_table", "db_table:order"), ("writes_table", "db_table:order")}


def test_messages_and_caches():
    text = 'class A { @KafkaListener(topics = {"t1", "t2"}) void on() { } @Cacheable("c") void q() { rocketMQTemplate.syncSend("order-topic:paid", x); } }'
    found = rows(text)
    assert {"mq_topic:t1", "mq_topic:t2", "mq_topic:order-topic"} == set(names(found, "symbol", "mq_topic")) and names(found, "symbol", "mq_tag") == ["mq_tag:order-topic:paid"]
    assert names(found, "symbol", "cache_key") == ["cache_key:c"]


def test_mybatis_statements():
    text = '<mapper namespace="a.Dao">\n<select id="q">select * from `s.t1` join t2 <if test="x">where 1</if></select>\n<insert id="w">insert into t3 values (1)</insert></mapper>'
    found = rows(text, "mybatis_xml")
    assert [(r["kind"], r["target"]) for r in found if r["record"] == "edge" and "table" in r["kind"]] == [("reads_table", "db_table:t1"), ("reads_table", "db_table:t2"), ("writes_table", "db_table:t3")]
    assert json.loads(next(r for r in found if r["kind"] == "sql_statement")["metadata"])["dynamic"] is True


def test_markdown_sections_and_children():
    facts = extract.markdown_facts("library/x.md", "lost\n# A\none two three\n\nfour five six\n```\n# no heading\n```\n## B\nseven password=abc", 5, 6, 2)
    parents = [r for r in facts.rows if r[2] == "project_knowledge_parent"]
    assert [r[3] for r in parents] == ["A", "A > B"] and "abc" not in parents[1][10]
    children = [r for r in facts.rows if r[2] == "project_knowledge" and r[3] == "A"]
    assert len(children) == 2 and "Context before:\ntwo three" in children[1][10]


def test_odd_files_give_rows_not_failures():
    assert rows(None)[0]["record"] == "error" and rows("\x00\x01")[0]["record"] == "error"
    assert [r["kind"] for r in rows("")] == ["file", "service"]
    assert [r["name"] for r in rows("", service=None) if r["kind"] == "service"] == ["unknown-service"]
    assert rows("class A { void b() { " + "x();" * 20000)[0]["kind"] == "file"


def test_workspace_scan(spark, tmp_path):
    def put(path, data):
        target = tmp_path / "root" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("order-service/pom.xml", "<p/>")
    put("order-service/src/main/java/a/A.java", 'package a;\nclass A { static final String T = "topic"; }'.encode())
    put("order-service/src/main/java/a/B.java", "// 退款".encode("gbk"))
    put("order-service/src/main/resources/application.yml", "spring:\n  application:\n    name: orders\n  datasource:\n    url: jdbc:mysql://10.0.0.1:3306/biz?x=1\n    password: secret\n  redis:\n    host: 10.0.0.2\n")
    put("order-service/target/classes/src/main/java/a/A.java", "class A {}")
    put("src/main/java/C.java", "class C {}")
    put("library/notes.md", "# N\nbody")
    files = workspace.scan(spark, str(tmp_path / "root"))
    got = {r.path: r for r in files.collect()}
    assert set(got) == {"order-service/src/main/java/a/A.java", "order-service/src/main/java/a/B.java", "order-service/src/main/resources/application.yml", "src/main/java/C.java", "library/notes.md"}
    assert got["order-service/src/main/java/a/A.java"].service_name == "orders" and got["library/notes.md"].module_name == "library"
    assert got["order-service/src/main/java/a/B.java"].text == "// 退款"
    values = {r.key: r.value for r in workspace.settings(files).collect()}
    assert values["spring.datasource.password"] == "<redacted>"
    assert {(r.resource_type, r.normalized_name) for r in workspace.resources(workspace.settings(files)).collect()} == {("database", "mysql://10.0.0.1:3306/biz"), ("redis", "redis://10.0.0.2:6379/0")}
    assert {r.alias for r in workspace.constants(files).collect()} == {"a.A.T", "A.T", "T"}
    assert extract.facts(files).where("record = 'error'").count() == 0


def test_hints():
    assert workspace.hints("- job => xxlJob, not batch\n订单：order、orders\n") == {"job": ["xxlJob", "not batch"], "订单": ["order", "orders"]}


def test_settings_logins_and_pages():
    yml = "spring:\n  oauth:\n    gitee:\n      authorize-url: https://gitee.com/oauth/authorize\n      client-secret: abc\n"
    found = rows(yml, "config")
    assert names(found, "symbol", "config") == ["config:a/F.config"] and set(names(found, "symbol", "oauth_provider")) >= {"oauth_provider:Gitee"}
    assert "abc" not in "".join(r["content"] for r in found) and {r["target"] for r in found if r["kind"] == "uses_oauth_provider"} >= {"oauth_provider:Gitee"}
    page = rows('<a href="https://github.com/login/oauth/authorize">x</a>\n<a href="#">social weixin</a>\n<p>plain</p>', "html")
    assert [(r["name"], r["start_line"]) for r in page if r["record"] == "symbol" and r["kind"] == "oauth_provider"] == [("GitHub", 1), ("WeChat", 2)]
    assert rows("a: [1", "config")[0]["record"] == "error" and rows("x" * 5000 + "\x00")[0]["record"] == "error"


def test_destinations_from_constants_of_other_files(spark):
    text = 'package a;\nclass S { void m() { rabbitTemplate.convertAndSend("ex", Keys.RK, x); rocketMQTemplate.syncSend(Keys.T + ":go", y); kafkaTemplate.send(unknown, z); } }'
    facts = spark.createDataFrame([extract_row for extract_row in extract.file_facts("a/S.java", "java", text, "shop")], extract.SCHEMA)
    constants = spark.createDataFrame([("Keys.RK", "rk"), ("Keys.T", "topic"), ("RK", "rk")], "alias string, value string")
    out = extract.resolved_publishes(facts, constants).where("kind = 'publishes'")
    assert {r.target for r in out.collect()} == {"mq_exchange:ex:rk", "mq_topic:topic", "mq_topic:unknown"}
