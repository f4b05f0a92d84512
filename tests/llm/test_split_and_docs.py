from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codeloom.llm import docpairs, split

CHUNK = "id string, content string, status string, metadata string, start_line int, updated_at timestamp"
T = datetime(2025, 1, 1)


def count(text):
    return len(split._TOKEN.findall(text))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1_. \n退款。;}#`", max_size=300), st.integers(1, 12), st.integers(0, 9))
def test_pieces_hold_the_limit_and_join_to_the_text(text, limit, overlap):
    pieces = split.cuts(text, limit, overlap)
    if count(text) > limit:
        assert all(count(text[a:b]) <= limit for a, b, _ in pieces)
        assert "".join(text[n:b] for _, b, n in pieces) == text
        assert all(n < b for _, b, n in pieces)
        assert all(count(text[a:n]) <= min(overlap, limit // 2) for a, _, n in pieces)


def test_strong_boundaries_go_first():
    text = "one two three.\n\nfour five six. seven eight\nnine ten"
    assert [text[n:b] for _, b, n in split.cuts(text, 5, 0)][0] == "one two three.\n\n"
    heading = "aaaa bbbb cccc dddd\n# n e f g h i"
    assert [heading[n:b] for _, b, n in split.cuts(heading, 6, 0)][0] == "aaaa bbbb cccc dddd\n"
    assert len(split.cuts("退" * 50_000, 800, 120)) < 90


@pytest.mark.parametrize("metadata, limit", [
    ('{"max_tokens": 3}', 3), ('{"max_tokens": "4"}', 4), ('{"max_tokens": null}', 800), ("{}", 800), ("", 800), (None, 800), ('{"max_tokens": 3', 800),
    ('{"max_tokens": "many"}', 800), ('{"max_tokens": [3]}', 800), ('{"max_tokens": 0}', 800), ('{"max_tokens": 5.0}', 5), ("null", 800), ("[1]", 800),
])
def test_limits(spark, metadata, limit):
    row = spark.createDataFrame([(metadata,)], "m string").select(split.number_in(F.col("m"), "max_tokens", 800, 1).alias("x")).first()
    assert row.x == limit


def test_pieces_of_a_table(spark):
    rows = [
        ("a", "x y\r\nz w\nv u", "active", '{"max_tokens": 2, "overlap_tokens": 1}', 10, T), ("a", "x y\r\nz w\nv u", "active", '{"max_tokens": 2, "overlap_tokens": 1}', 10, T),
        ("b", "x y z", "stale", '{"max_tokens": 1}', 1, T), ("c", "x y z", "active", '{"max_tokens": 2}', None, T), ("d", "x", "active", '{"max_tokens": 1}', 1, T), ("e", None, "active", None, 1, T), (None, "x y", "active", '{"max_tokens": 1}', 1, T),
        ("f", "", "active", '{"max_tokens": 1}', 1, None),
    ]
    frame = spark.createDataFrame(rows, CHUNK).selectExpr("*", "'q' as piece", "'q' as pieces", "'q' as chunk_id", "1 as limit")
    got = [tuple(r) for r in split.pieces(frame).orderBy("chunk_id", "piece").select("chunk_id", "piece", "start_line", "tokens").collect()]
    assert {g[0] for g in got} == {"a", "c"} and all(g[3] <= 2 for g in got)
    assert [g[2] for g in got if g[0] == "a"] == [10, 10, 11, 11, 12] and {g[2] for g in got if g[0] == "c"} == {None}
    assert split.pieces(frame.limit(0)).count() == 0


DOCS = [
    ("getCart", "Gets the cart.", False), ("getCart", "/** {@inheritDoc} */", False), ("x", None, False), ("x", "", False), ("x", "   ", False), ("x", "/***/", False), ("x", "// TODO: later", False),
    ("x", "@param a the a\n@return b", False), ("x", "Licensed under the Apache License, Version 2.0.", False), ("x", "// return repo.find(a);", False), ("x", "Auto-generated", False), ("x", "无", False),
    ("Cart", "Creates a new Cart.", False), ("x", "@author me\n@since 1", False), ("x", "Generated by the tool on 2025-01-02.", False), ("isOpen", "Is open.", False),
    ("x", "Idempotent.", True), ("x", "幂等。", True), ("getCart", "Gets the cart from the archive.", True), ("x", "TODO: rename. Never throws; failures end up in a.b.", True), ("x", "/**\n * {@inheritDoc}\n * Not thread-safe.\n */", True),
    ("x", "@param a the a\n\nBlocks until done.", True), ("x", "<p>Liefert nie null.</p>\n@see Y", True), ("getCart", "word " * 20000 + "locks", True),
]


@pytest.mark.parametrize("name, doc, told", DOCS)
def test_docstrings(spark, name, doc, told):
    row = spark.createDataFrame([(name, doc)], "n string, d string").select(docpairs.is_informative(F.col("d"), F.col("n")).alias("x")).first()
    assert row.x is told


def test_declarations_document_definitions(spark):
    schema = "id string, project_id string, file_id string, kind string, name string, qualified_name string, signature string, docstring string, updated_at timestamp"
    rows = [
        ("d", "p", "f1", "method", "run", "a.B.run", "void run(final List<String> x, int y);", "Blocks until done.", T), ("i", "p", "f2", "method", "run", "a.B.run", "public void run(List<Long> z, int w) {", "", T),
        ("o", "p", "f2", "method", "run", "a.B.run", "public void run(int w)", None, T), ("q", "q", "f2", "method", "run", "a.B.run", "void run(List x, int y)", None, T),
        ("s", "p", "f1", "class", "B", "a.B", "class B", "Blocks.", T), ("n", "p", "f1", "method", "n", None, "void n()", "Never throws.", T), ("b", "p", "f1", "method", "b", "a.B.b", " ", "Never throws.", T), (None, "p", "f", "method", "z", "z", "z()", "Never throws.", T),
        ("d", "p", "f1", "method", "run", "a.B.run", "void run(final List<String> x, int y);", "Blocks until done.", None),
    ]
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "1 as overload", "1 as documented", "1 as r")
    assert {(r.symbol_id, r.described_by) for r in docpairs.pairs(frame).collect()} == {("d", "d"), ("i", "d"), ("n", "n")}
    assert docpairs.pairs(frame.limit(0)).count() == 0


def test_the_joined_table_decides_which_functions_are_documented(spark):
    schema = "id string, project_id string, file_id string, kind string, name string, qualified_name string, signature string, docstring string, updated_at timestamp"
    rows = [
        ("a", "p", "f1", "method", "run", "a.B.run", "void run(int y);", "TODO", T), ("b", "p", "f2", "method", "run", "a.B.run", "public void run(final int w) {", "Blocks until done.", T),
        ("c", "p", "f3", "method", "run", "a.B.run", "void run(int q)", None, T), ("d", "p", "f3", "method", "run", "a.B.run", "void run(long q)", "TODO", T),
    ]
    got = {r.symbol_id: (r.described_by, r.told) for r in docpairs.joined(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("b", True), "b": ("b", True), "c": ("b", True), "d": ("d", False)}
