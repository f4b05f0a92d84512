import random
from collections import defaultdict

import pytest

from codeloom.operators import hierarchy

LINKS = "kind string, parent string, child string"


def frame(spark, rows):
    return spark.createDataFrame(rows, LINKS)


def brute(rows):
    kids = defaultdict(set)
    for k, p, c in rows:
        if k and p and c:
            kids[k, p].add(c)
    nodes = {(k, n) for k, p, c in rows if k and p and c for n in (p, c)}

    def reach(k, n):
        seen, todo = set(), [n]
        while todo:
            for c in kids[k, todo.pop()]:
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    below = {x: reach(*x) for x in nodes}
    on = {(k, n) for k, n in nodes if n in below[k, n]}
    under = {(k, c) for k, n in on for c in below[k, n]} - on
    return {(k, n, "on_cycle") for k, n in on} | {(k, n, "below_cycle") for k, n in under}, below, on | under


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_standing_and_descendants_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(26)]
    standing, below, bad = brute(rows)
    links = frame(spark, rows)
    assert {tuple(r) for r in hierarchy.loop_standing(links).collect()} == standing
    expected = {(k, n, c) for (k, n), cs in below.items() for c in cs if (k, c) not in bad}
    got = hierarchy.descendants(links).collect()
    assert {tuple(r)[:3] for r in got} == expected and len(got) == len(expected)


def test_two_loops_with_a_bridge(spark):
    rows = [("a", "1", "2"), ("a", "2", "1"), ("a", "2", "b"), ("a", "b", "3"), ("a", "3", "4"), ("a", "4", "3"), ("a", "4", "z"), ("a", "top", "1")]
    got = {r.node_id: r.standing for r in hierarchy.loop_standing(frame(spark, rows)).collect()}
    assert got == {"1": "on_cycle", "2": "on_cycle", "b": "below_cycle", "3": "on_cycle", "4": "on_cycle", "z": "below_cycle"}


def test_paths_of_a_long_chain_and_a_node_with_two_parents(spark):
    rows = [("a", f"{i:03}", f"{i + 1:03}") for i in range(70)] + [("a", "x", "t"), ("a", "y", "t")]
    got = {r.node_id: r for r in hierarchy.tree_summary(frame(spark, rows)).collect()}
    assert got["070"].depth == 70 and got["070"].root_id == "000" and got["070"].path == "/".join(f"{i:03}" for i in range(71))
    assert got["000"].descendants == 70 and got["t"].path == "x/t" and got["y"].descendants == 1


def test_nulls_repeats_self_links_and_extra_columns(spark):
    rows = [("a", "p", "c", 1), ("a", "p", "c", 2), ("a", None, "c", 3), ("a", "p", None, 4), (None, "p", "c", 5), ("a", "s", "s", 6), ("a", "s", "u", 7)]
    links = spark.createDataFrame(rows, LINKS + ", depth int").withColumnRenamed("depth", "root_id")
    got = {r.node_id: (r.standing, r.depth, r.descendants) for r in hierarchy.tree_summary(links).collect()}
    assert got == {"p": ("tree", 0, 1), "c": ("tree", 1, 0), "s": ("on_cycle", None, None), "u": ("below_cycle", None, None)}


def test_empty_input(spark):
    empty = frame(spark, [])
    assert hierarchy.loop_standing(empty).count() == hierarchy.descendants(empty).count() == hierarchy.tree_summary(empty).count() == 0


def test_links_of_edges_take_direction_by_kind(spark):
    edges = spark.createDataFrame([("contains", "f", "c"), ("extends", "sub", "base"), ("calls", "x", "y"), ("contains", None, "q")], "kind string, source_id string, target_id string")
    got = {tuple(r) for r in hierarchy.links_of(edges, {"contains": True, "extends": False}).collect()}
    assert got == {("contains", "f", "c"), ("extends", "base", "sub")}


def test_one_long_loop_with_chords_and_a_tail(spark):
    n = 20_000
    rows = [("a", f"{i}", f"{(i + 1) % n}") for i in range(n)] + [("a", f"{i}", f"{(i * 7 + 3) % n}") for i in range(0, n, 500)] + [("a", "5", "t0"), ("a", "t0", "t1"), ("a", "top", "0")]
    got = {r.node_id: r.standing for r in hierarchy.loop_standing(frame(spark, rows)).collect()}
    assert got == {f"{i}": "on_cycle" for i in range(n)} | {"t0": "below_cycle", "t1": "below_cycle"}


def test_loops_in_a_chain_with_bridges_of_several_nodes(spark):
    rows = []
    for i in range(6):
        rows += [("a", f"x{i}", f"y{i}"), ("a", f"y{i}", f"x{i}"), ("a", f"y{i}", f"b{i}"), ("a", f"b{i}", f"c{i}"), ("a", f"c{i}", f"x{i + 1}")]
    rows += [("a", "x6", "x6")]
    assert {tuple(r) for r in hierarchy.loop_standing(frame(spark, rows)).collect()} == brute(rows)[0]
