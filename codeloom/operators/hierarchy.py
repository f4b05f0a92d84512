"""Parent-child links to full hierarchies by pointer doubling.

Input of every function is a frame with the columns ``kind``, ``parent``, ``child``; further columns are ignored. Rows
with a null in any of the three, and repeated links, count as absent and as one. Node ids are compared as they are.

How it scales: a jump frame holds, for each node, its ancestors exactly ``2**k`` links above. A round joins the frame
with itself, so that nodes with a shorter ancestry drop out, and after as many rounds as the depth has binary digits
only nodes on or below a loop remain. Each round is one shuffled equi-join on the node id; nothing is collected but
counts. A node with many children is no hot key for the upward joins' output (each child has its own row), and the hot
side of the join is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.session import cut

SEPARATOR = "/"


def links_of(edges: DataFrame, child_is_target: dict[str, bool]) -> DataFrame:
    """Distinct (kind, parent, child) of an edge table: by kind, the child is the target (True) or the source (False)."""
    down = F.lit(False)
    for kind, is_target in child_is_target.items():
        if is_target:
            down = down | (F.col("kind") == kind)
    return (
        edges.where(F.col("kind").isin(list(child_is_target)))
        .where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
        .select(
            F.col("kind"),
            F.when(down, F.col("source_id")).otherwise(F.col("target_id")).alias("parent"),
            F.when(down, F.col("target_id")).otherwise(F.col("source_id")).alias("child"),
        )
        .distinct()
    )


def _clean(links: DataFrame) -> DataFrame:
    return links.select("kind", "parent", "child").dropna().distinct()


def _endless(links: DataFrame, max_rounds: int) -> DataFrame:
    """Jump pairs (kind, node, far) of the nodes from which links can be followed upwards without end.

    The nodes left after a round are exactly those with a walk of ``2**k`` links. Once each of them has a parent that is
    left too, none can end, so the loop stops there, even where loops are long.
    """
    jump = links.select("kind", F.col("child").alias("node"), F.col("parent").alias("far"))
    for _ in range(max_rounds):
        step = jump.select("kind", F.col("node").alias("far"), F.col("far").alias("further"))
        jump = cut(jump.join(step, ["kind", "far"]).select("kind", "node", F.col("further").alias("far")).distinct())
        alive = jump.select("kind", "node").distinct()
        if alive.isEmpty():
            break
        held = links.join(alive.withColumnRenamed("node", "parent"), ["kind", "parent"], "left_semi")
        loose = alive.join(held.withColumnRenamed("child", "node"), ["kind", "node"], "left_anti")
        if loose.isEmpty():
            break
    else:
        raise ValueError(f"no end after {max_rounds} rounds: more than 2**{max_rounds} links deep")
    return jump


def _least_reaching(nodes: DataFrame, links: DataFrame, group: list[str], max_rounds: int) -> DataFrame:
    """(GROUP..., node, label): the least ``rank`` of the nodes that reach each node along the links, its own included.

    ``nodes`` (GROUP..., node, rank), ``links`` (GROUP..., parent, child). A round takes the least label of the parents and
    then that of the labelled node itself: who reaches that one reaches this one too, so the distance that a label covers
    grows by a factor each round. Ranks are hashes, so that no order of ids makes labels travel one link a round. One row a
    node in every round, however many nodes reach it.
    """
    own = F.struct("rank", "node")
    state = nodes.select(*group, "node", own.alias("label"))
    for _ in range(max_rounds):
        handed = links.join(state.select(*group, F.col("node").alias("parent"), "label"), [*group, "parent"]).select(*group, F.col("child").alias("node"), "label", F.lit(None).alias("old"))
        near = state.select(*group, "node", "label", F.col("label").alias("old")).unionByName(handed).groupBy(*group, "node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        far = near.select(*group, F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = near.withColumn("at", F.col("label.node")).join(far, [*group, "at"], "left")
        state = cut(jumped.select(*group, "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        if state.where("label.rank <> old.rank or label.node <> old.node").isEmpty():
            return state.drop("old")
    raise ValueError(f"labels still move after {max_rounds} rounds")


def _chained(core: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """Runs of nodes with one link in and one out: (kind, node, top, head), and (kind, node) of those that make up a whole loop.

    ``top`` is the node above the run, ``head`` the run's first node; found by pointer doubling. After round k only nodes more
    than ``2**k`` links below their top are open. Where a round settles none, no run is that long and the rest are loops.
    """
    ins = core.groupBy("kind", F.col("child").alias("node")).agg(F.count("*").alias("n_in"), F.min("parent").alias("top"))
    outs = core.groupBy("kind", F.col("parent").alias("node")).agg(F.count("*").alias("n_out"))
    single = cut(ins.join(outs, ["kind", "node"]).where("n_in = 1 and n_out = 1 and node <> top").select("kind", "node", "top"))
    inner = single.select("kind", F.col("node").alias("top"), F.lit(True).alias("inside"))
    rows = cut(single.join(inner, ["kind", "top"], "left").select("kind", "node", "top", F.col("node").alias("head"), F.col("inside").isNull().alias("done")))
    open_ = rows.where("not done").count()
    for _ in range(max_rounds):
        if not open_:
            break
        above = rows.select("kind", F.col("node").alias("top"), F.col("top").alias("top2"), F.col("head").alias("head2"), F.col("done").alias("done2"))
        moved = rows.where("not done").join(above, ["kind", "top"]).select("kind", "node", F.col("top2").alias("top"), F.col("head2").alias("head"), F.col("done2").alias("done"))
        rows = cut(rows.where("done").unionByName(moved))
        left = rows.where("not done").count()
        if left == open_:
            break
        open_ = left
    return rows.where("done").drop("done"), rows.where("not done").select("kind", "node")


def _looped(core: DataFrame, max_rounds: int) -> DataFrame:
    """(kind, node): the nodes on loops, among links of which each has endless walks in both directions.

    Runs of nodes with one link in and one out are contracted to single links first, so that long loops become short. What
    is left is coloured by the least node that reaches it; what reaches that node again within its colour is on a loop with
    it. Both are told by ``_least_reaching``, first along the links and then, within a colour, against them. What is found is
    taken out, the rest is trimmed to endless walks again and coloured anew, so a chain of loops takes a pass for each of its
    loops at most and most are found in the first. Every frame holds a row a node or link; no closure is made.
    """
    found = core.where("false").select("kind", F.col("parent").alias("node"))
    for _ in range(max_rounds * max_rounds):
        if core.isEmpty():
            return found
        runs, whole = _chained(core, max_rounds)
        ends = runs.select("kind", F.col("node").alias("parent"), "top", "head")
        inside = runs.select("kind", F.col("node").alias("child")).unionByName(whole.select("kind", F.col("node").alias("child")))
        links = cut(
            core.join(inside, ["kind", "child"], "left_anti").join(ends, ["kind", "parent"], "left")
            .select("kind", F.coalesce("top", "parent").alias("parent"), "child", "head")
        )
        short = links.select("kind", "parent", "child").distinct()
        nodes = cut(short.select("kind", F.explode(F.array("parent", "child")).alias("node")).distinct().withColumn("rank", F.xxhash64("kind", "node")))
        color = _least_reaching(nodes, short, ["kind"], max_rounds**2).select("kind", "node", F.col("label.node").alias("color"))
        up, down = color.select("kind", F.col("node").alias("parent"), "color"), color.select("kind", F.col("node").alias("child"), F.col("color").alias("color2"))
        within = cut(short.join(up, ["kind", "parent"]).join(down, ["kind", "child"]).where("color = color2").select("kind", "color", F.col("child").alias("parent"), F.col("parent").alias("child")))
        inner = within.select("kind", "color", F.explode(F.array("parent", "child")).alias("node")).distinct()
        back = _least_reaching(inner.withColumn("rank", F.xxhash64("kind", "node")), within, ["kind", "color"], max_rounds**2)
        strong = cut(back.where("label.node = color").select("kind", "node", "color"))
        at = lambda name: strong.select("kind", F.col("node").alias(name), F.col("color").alias(f"{name}_color"))
        closed = cut(links.join(at("parent"), ["kind", "parent"]).join(at("child"), ["kind", "child"]).where("parent_color = child_color").select("kind", "parent", "child", "head"))
        on_runs = runs.join(closed.select("kind", "head").dropna().distinct(), ["kind", "head"], "left_semi").select("kind", "node")
        now = cut(closed.select("kind", F.explode(F.array("parent", "child")).alias("node")).unionByName(on_runs).unionByName(whole).distinct())
        found = cut(found.unionByName(now))
        gone = color.where("node = color").select("kind", "node").unionByName(now).distinct()
        rest = core.join(gone.withColumnRenamed("node", "child"), ["kind", "child"], "left_anti").join(gone.withColumnRenamed("node", "parent"), ["kind", "parent"], "left_anti")
        core = _two_way(cut(rest), max_rounds)
    raise ValueError("loops are chained too deeply")


def _upward(links: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with endless walks upwards, the links between them)."""
    up = cut(_endless(links, max_rounds).select("kind", "node").distinct())
    return up, cut(
        links.join(up.withColumnRenamed("node", "child"), ["kind", "child"], "left_semi")
        .join(up.withColumnRenamed("node", "parent"), ["kind", "parent"], "left_semi")
    )


def _turned(links: DataFrame) -> DataFrame:
    return links.select("kind", F.col("child").alias("parent"), F.col("parent").alias("child"))


def _two_way(links: DataFrame, max_rounds: int) -> DataFrame:
    """The links between nodes that have endless walks both upwards and downwards: those on loops and between loops."""
    return links if links.isEmpty() else _turned(_upward(_turned(_upward(links, max_rounds)[1]), max_rounds)[1])


def loop_standing(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(kind, node_id, standing): ``on_cycle`` for nodes that reach themselves, ``below_cycle`` for those below one.

    Nodes on no loop and below none have no row; an empty input gives no row; a link to itself is a loop. A node between
    two loops is told from one on a loop by labels that travel among the nodes with endless walks both upwards and
    downwards (see ``_looped``): a row for each of their links in every round, also where a loop is long.
    """
    return _standing(cut(_clean(links)), max_rounds)


def _standing(links: DataFrame, max_rounds: int) -> DataFrame:
    up, inner = _upward(links, max_rounds)
    core = _turned(_upward(_turned(inner), max_rounds)[1])
    on = _looped(core, max_rounds).withColumn("looped", F.lit(True))
    return up.join(on, ["kind", "node"], "left").select(
        "kind",
        F.col("node").alias("node_id"),
        F.when(F.col("looped"), F.lit("on_cycle")).otherwise(F.lit("below_cycle")).alias("standing"),
    )


def paths(links: DataFrame, standing: DataFrame | None = None, max_rounds: int = 40) -> DataFrame:
    """(kind, node_id, root_id, depth, path) of every node that is neither on nor below a loop.

    A node with several parents takes the one with the least id for its path (all of its ancestors still hold it among
    their descendants). A root has depth 0 and its own id as path; segments are joined with ``/``. Pointers double: after
    round k a row knows the path to its ancestor ``2**k`` links above, or to its root; a row at its root stops moving.
    """
    return _paths(*_prepared(links, standing, max_rounds), max_rounds)


def _prepared(links: DataFrame, standing: DataFrame | None, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    links = cut(_clean(links))
    return links, _standing(links, max_rounds) if standing is None else standing


def _paths(links: DataFrame, standing: DataFrame, max_rounds: int) -> DataFrame:
    bad = standing.select("kind", F.col("node_id").alias("child"))
    fine = links.join(bad, ["kind", "child"], "left_anti")
    parent = fine.groupBy("kind", "child").agg(F.min("parent").alias("parent"))
    roots = (
        links.select("kind", F.col("parent").alias("child"))
        .distinct()
        .join(links.select("kind", "child").distinct(), ["kind", "child"], "left_anti")
    )
    rows = cut(
        parent.select(
            "kind", F.col("child").alias("node_id"), F.col("parent").alias("top"), F.lit(1).alias("depth"),
            F.concat_ws(SEPARATOR, "parent", "child").alias("path"), F.lit(False).alias("done"),
        ).unionByName(
            roots.select(
                "kind", F.col("child").alias("node_id"), F.col("child").alias("top"), F.lit(0).alias("depth"),
                F.col("child").alias("path"), F.lit(True).alias("done"),
            )
        )
    )
    for _ in range(max_rounds):
        moving = rows.where(~F.col("done"))
        if moving.isEmpty():
            break
        above = rows.select(
            "kind", F.col("node_id").alias("top"), F.col("top").alias("top2"), F.col("depth").alias("depth2"),
            F.col("path").alias("path2"), F.col("done").alias("done2"),
        )
        moved = moving.join(above, ["kind", "top"]).select(
            "kind", "node_id", F.col("top2").alias("top"), (F.col("depth") + F.col("depth2")).alias("depth"),
            F.concat(F.col("path2"), F.expr("substring(path, length(top) + 1)")).alias("path"), F.col("done2").alias("done"),
        )
        rows = cut(moved.unionByName(rows.where(F.col("done"))))
    return rows.select("kind", "node_id", F.col("top").alias("root_id"), "depth", "path")


def descendants(links: DataFrame, standing: DataFrame | None = None, max_rounds: int = 40) -> DataFrame:
    """(kind, ancestor_id, descendant_id, distance): every pair above one another among nodes off loops.

    ``distance`` is the least number of links between the two. Rows, not arrays, so that no node's descendants must fit
    into one task. Distances double each round; the frame is as large as the result itself.
    """
    return _descendants(*_prepared(links, standing, max_rounds), max_rounds)


def _descendants(links: DataFrame, standing: DataFrame, max_rounds: int) -> DataFrame:
    bad = standing.select("kind", F.col("node_id").alias("child"))
    base = links.join(bad, ["kind", "child"], "left_anti").select(
        "kind", F.col("parent").alias("up"), F.col("child").alias("down"), F.lit(1).alias("distance")
    )
    pairs, reach = cut(base), 1
    for _ in range(max_rounds):
        far = pairs.where(F.col("distance") * 2 > reach) if reach > 1 else pairs
        right = pairs.select("kind", F.col("up").alias("mid"), F.col("down").alias("low"), F.col("distance").alias("d2"))
        left = far.select("kind", "up", F.col("down").alias("mid"), F.col("distance").alias("d1"))
        new = left.join(right, ["kind", "mid"]).select("kind", "up", F.col("low").alias("down"), (F.col("d1") + F.col("d2")).alias("distance"))
        fresh = new.where(F.col("distance") > reach)
        if fresh.isEmpty():
            break
        pairs = cut(pairs.unionByName(new).groupBy("kind", "up", "down").agg(F.min("distance").alias("distance")))
        reach *= 2
    return pairs.select("kind", F.col("up").alias("ancestor_id"), F.col("down").alias("descendant_id"), "distance")


def tree_summary(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """One row per node of each kind: path, depth, root, number of descendants and standing (``tree`` off loops).

    Nodes on or below a loop have null path, depth, root and descendants.
    """
    links = cut(_clean(links))
    standing = cut(_standing(links, max_rounds))
    walked = _paths(links, standing, max_rounds)
    below = _descendants(links, standing, max_rounds).groupBy("kind", F.col("ancestor_id").alias("node_id")).agg(F.count("*").alias("descendants"))
    nodes = links.select("kind", F.explode(F.array("parent", "child")).alias("node_id")).distinct()
    return (
        nodes.join(walked, ["kind", "node_id"], "left")
        .join(below, ["kind", "node_id"], "left")
        .join(standing, ["kind", "node_id"], "left")
        .select(
            "kind", "node_id", "root_id", F.col("depth").cast("long").alias("depth"), "path",
            F.when(F.col("standing").isNull(), F.coalesce("descendants", F.lit(0))).cast("long").alias("descendants"),
            F.coalesce("standing", F.lit("tree")).alias("standing"),
        )
    )
