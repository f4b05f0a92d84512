"""The k most similar vectors of every vector within its project and model, by hierarchical k-means trees.

Equal vectors are searched once: one representative per distinct vector, its copies come back in afterwards. A group of
representatives that fits a bin is searched in one task. A larger one is cut first: a k-means level fitted on a bounded
sample of the group gives its cells; vectors go to the cell they are nearest to and, as queries, to further cells. How many is
measured for each large group: sampled vectors are compared with the whole group, and the cells that hold their true neighbours
are counted. Cells beyond twice the bin size are cut into blocks, each searched by all the cell's queries, in shares
of bounded size. Within a bin a two-level
tree is searched best bin first: a priority queue per query holds the open branches and leaves by distance, kept for all
queries at once as one matrix. The number of leaves to visit is widened until, on sampled queries, the wanted share of the
true neighbours is found. With ``min_cosine`` leaves that cannot hold one as similar are skipped, which loses nothing.

No group or cell is ever sent to the driver, and no side is broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codeloom.session import cut

GROUP = ["project_id", "embedding_model"]


@dataclass(frozen=True)
class Settings:
    """``bin_rows``: vectors searched in one task. ``leaf_rows``: aimed size of a leaf. ``fit_rows``: sample bound of one
    k-means fit in a bin. ``cell_fit_rows``: sample of a large group for each of its cells, at most ``max_cells``.
    ``cells_visited``: cells a vector is sent to as a query at least, its own included. ``recall``: share of true neighbours that
    sampled queries (``probes``) must find before widening stops; in a group cut into cells, choosing cells and searching
    them may each lose half of the rest. ``cell_probes``: sampled queries of a large group; ``cell_truths``: true neighbours
    its cells are chosen by at least, if fewer reach ``min_cosine`` the most similar of the others too.
    ``queries_per_bin``: a cell's queries are split into shares of at most so many times ``bin_rows``, each searched in a task of its own."""

    k: int = 5
    dim: int = 64
    min_cosine: float | None = None
    bin_rows: int = 30_000
    leaf_rows: int = 160
    fit_rows: int = 8_192
    cell_fit_rows: int = 64
    max_cells: int = 1_024
    cells_visited: int = 4
    recall: float = 0.99
    probes: int = 384
    cell_probes: int = 1_024
    cell_truths: int = 200
    queries_per_bin: int = 4
    salts: int = 64


def usable(embeddings: DataFrame, dim: int) -> DataFrame:
    """Active rows with an id, a project, a model and ``dim`` finite numbers that are not all zero."""
    vector = F.col("embedding")
    fine = (
        (F.col("status") == "active")
        & (F.size(vector) == dim)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    return embeddings.where(fine).dropna(subset=["id", *GROUP]).select(
        "id", *GROUP, "embedding", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2")
    )


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column as unit rows in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    rows = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, count: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """``count`` unit centroids (float32) of unit rows; empty ones are moved to rows that fit their centroid worst."""
    rng = np.random.default_rng(seed)
    rows = rows.astype(np.float32, copy=False)
    count = min(count, len(rows))
    centres = rows[rng.choice(len(rows), count, replace=False)].copy()
    for _ in range(rounds):
        similar = rows @ centres.T
        nearest = similar.argmax(axis=1)
        order = np.argsort(nearest, kind="stable")
        sizes = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(centres)
        filled = np.flatnonzero(sizes)
        sums[filled] = np.add.reduceat(rows[order], np.r_[0, np.cumsum(sizes)[:-1]][filled], axis=0)
        empty = np.flatnonzero(sizes == 0)
        if len(empty):
            sums[empty] = rows[np.argsort(similar.max(axis=1))[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


class Tree:
    """A two-level k-means tree over the unit rows of one bin."""

    def __init__(self, rows: np.ndarray, settings: Settings):
        self.rows, n = rows.astype(np.float32), len(rows)
        leaves = max(1, round(n / settings.leaf_rows))
        branches = max(1, int(round(leaves**0.5)))
        sample = self.rows if n <= settings.fit_rows else self.rows[np.random.default_rng(3).choice(n, settings.fit_rows, replace=False)]
        self.branches = spherical_kmeans(sample, branches)
        home = (sample @ self.branches.T).argmax(axis=1)
        centres, parents = [], []
        for b in range(len(self.branches)):
            own = sample[home == b]
            below = spherical_kmeans(own, max(1, round(leaves * len(own) / len(sample)))) if len(own) else self.branches[b : b + 1]
            centres.append(below)
            parents += [b] * len(below)
        self.leaves, self.parents = np.concatenate(centres), np.array(parents)
        self.children = [np.flatnonzero(self.parents == b) for b in range(len(self.branches))]
        branch = (self.rows @ self.branches.T).argmax(axis=1)
        leaf = np.empty(n, dtype=np.int64)
        for b, kids in enumerate(self.children):
            own = np.flatnonzero(branch == b)
            leaf[own] = kids[(self.rows[own] @ self.leaves[kids].T).argmax(axis=1)]
        order = np.argsort(leaf, kind="stable")
        bounds = np.searchsorted(leaf[order], np.arange(len(self.leaves) + 1))
        self.members = [order[a:b] for a, b in zip(bounds, bounds[1:])]
        self.radius = np.array([
            np.arccos(np.clip((self.rows[m] @ self.leaves[i]).min(), -1, 1)) if len(m) else -np.inf for i, m in enumerate(self.members)
        ])

    def visits(self, queries: np.ndarray, most: int, min_cosine: float | None) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, query numbers) in rounds: each query's next best leaf, until it has been to ``most`` leaves.

        The priority queue of a query is its row of ``waiting``: distances of branches not yet opened and of the leaves of
        opened ones. A round takes the least of each; a branch is replaced by its leaves, a leaf is visited.
        """
        n, b = len(queries), len(self.branches)
        waiting = np.full((n, b + len(self.leaves)), np.inf, dtype=np.float32)
        waiting[:, :b] = 1 - queries @ self.branches.T
        left, active = np.full(n, most), np.arange(n)
        limit = np.arccos(min_cosine) + 1e-3 if min_cosine is not None else None
        while len(active):
            best = waiting[active].argmin(axis=1)
            value = waiting[active, best]
            live = np.isfinite(value)
            active, best = active[live], best[live]
            waiting[active, best] = np.inf
            order = np.argsort(best, kind="stable")
            cuts = np.flatnonzero(np.diff(best[order], prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(order)]):
                node, who = best[order[a]], active[order[a:z]]
                if node < b:
                    kids = self.children[node]
                    distance = 1 - queries[who] @ self.leaves[kids].T
                    if limit is not None:
                        angle = np.arccos(np.clip(1 - distance, -1, 1))
                        distance = np.where(angle - self.radius[kids] > limit, np.inf, distance)
                    waiting[np.ix_(who, b + kids)] = distance
                else:
                    left[who] -= 1
                    yield node - b, who
            active = active[left[active] > 0]

    def search(self, queries: np.ndarray, own: np.ndarray, settings: Settings, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, cosine) of the k best rows of each query found in ``most`` leaves; ``own``: a query's own row or -1."""
        k, floor = settings.k, (settings.min_cosine - 1e-4) if settings.min_cosine is not None else None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        narrow = queries.astype(np.float32)
        for leaf, who in self.visits(narrow, most, settings.min_cosine):
            members = self.members[leaf]
            if not len(members):
                continue
            similar = narrow[who] @ self.rows[members].T
            similar[members[None, :] == own[who][:, None]] = -2
            if floor is not None:
                at, to = np.nonzero(similar >= floor)
            elif len(members) <= k:
                at, to = np.nonzero(similar > -2)
            else:
                top = np.argpartition(-similar, k, axis=1)[:, : k + 1]
                at, to = np.repeat(np.arange(len(who)), top.shape[1]), top.ravel()
                keep = similar[at, to] > -2
                at, to = at[keep], to[keep]
            found.append((who[at], members[to], similar[at, to]))
        if not found:
            return np.array([], int), np.array([], int), np.array([])
        query, row, rough = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((row, -rough, query))
        query, row = query[order], row[order]
        keep = rank_within(query) < k + 8
        return query[keep], row[keep], rough[order][keep]


def rank_within(sorted_keys: np.ndarray) -> np.ndarray:
    """The position of each element within its run of equal keys."""
    starts = np.flatnonzero(np.diff(sorted_keys, prepend=sorted_keys[0] - 1)) if len(sorted_keys) else np.array([], int)
    return np.arange(len(sorted_keys)) - np.repeat(starts, np.diff(np.r_[starts, len(sorted_keys)]))


def best_of(query: np.ndarray, row: np.ndarray, exact: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best by exact cosine, rows in ascending order breaking ties, at or above ``min_cosine``."""
    if settings.min_cosine is not None:
        keep = exact >= settings.min_cosine
        query, row, exact = query[keep], row[keep], exact[keep]
    order = np.lexsort((row, -exact, query))
    query, row, exact = query[order], row[order], exact[order]
    keep = rank_within(query) < settings.k
    return query[keep], row[keep], exact[keep]


def calibrated(tree: Tree, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, settings: Settings, recall: float) -> int:
    """Leaves to visit: doubled until sampled queries find the wanted share of their true neighbours, then once more."""
    n = len(queries)
    probes = np.random.default_rng(11).choice(n, min(settings.probes, n), replace=False)
    similar = queries[probes] @ rows.T
    mine = np.flatnonzero(own[probes] >= 0)
    similar[mine, own[probes[mine]]] = -2
    top = np.argsort(-similar, axis=1)[:, : settings.k]
    truth = {(i, j) for i, js in enumerate(top) for j in js if similar[i, j] > -2 and (settings.min_cosine is None or similar[i, j] >= settings.min_cosine)}
    most = 2
    while most < len(tree.leaves) and truth:
        query, row, _ = tree.search(queries[probes], own[probes], settings, most)
        query, row, _ = best_of(query, row, np.einsum("ij,ij->i", queries[probes[query]], rows[row]), settings)
        if len(truth & set(zip(query.tolist(), row.tolist()))) >= recall * len(truth):
            break
        most *= 2
    return min(2 * most, len(tree.leaves))


def halved(recall: float) -> float:
    """The recall of each of two steps that lose half of what may be lost."""
    return (1 + recall) / 2


LINK = "project_id string, embedding_model string, id string, near string, cosine double"


def _search_bin(table: pa.Table, settings: Settings) -> pa.Table:
    """Links of one bin: rows that ``asks`` are queries, those with ``is_data`` are searched."""
    ids = np.array(table["id"].to_pylist(), dtype=object)
    data = np.array(table["is_data"].to_pylist(), dtype=bool)
    order = np.argsort(ids, kind="stable")
    asks = np.array(table["asks"].to_pylist(), dtype=bool)[order]
    rows, ids, data = matrix(table["embedding"], settings.dim)[order], ids[order], data[order]
    places, askers = np.flatnonzero(data), np.flatnonzero(asks)
    query, row, exact = np.array([], int), np.array([], int), np.array([])
    if len(places) and len(askers):
        base = rows[places]
        own = np.full(len(rows), -1)
        own[places] = np.arange(len(places))
        tree = Tree(base, settings)
        recall = settings.recall if data.all() and asks.all() else halved(settings.recall)  # other bins are of a large group
        most = calibrated(tree, base, rows[askers], own[askers], settings, recall)
        query, row, _ = tree.search(rows[askers], own[askers], settings, most)
        query = askers[query]
        query, row, exact = best_of(query, row, np.einsum("ij,ij->i", rows[query], base[row]), settings)
    project, model = table["project_id"][0].as_py(), table["embedding_model"][0].as_py()
    return pa.table({
        "project_id": pa.array([project] * len(query), pa.string()), "embedding_model": pa.array([model] * len(query), pa.string()),
        "id": pa.array(list(ids[query]), pa.string()), "near": pa.array(list(ids[places[row]]) if len(row) else [], pa.string()), "cosine": pa.array(exact, pa.float64()),
    })


def _cells_needed(sharded: DataFrame, spread: DataFrame, settings: Settings) -> DataFrame:
    """(project_id, embedding_model, width): the cells a query of a large group must go to.

    The probes of a group are compared with all of it, shard by shard. A true neighbour is found from the rank on that its
    cell has among the cells of the probe; ``width`` is the least with which the wanted share of them is found.
    """

    def exact(rows: pa.Table, tree: pa.Table) -> pa.Table:
        ids, probe_ids = np.array(rows["id"].to_pylist(), dtype=object), np.array(tree["probe_ids"][0].as_py(), dtype=object)
        centres = np.array(tree["centres"][0].as_py(), dtype=np.float32).reshape(-1, settings.dim)
        probes = np.array(tree["probes"][0].as_py(), dtype=np.float64).reshape(-1, settings.dim)
        base = matrix(rows["embedding"], settings.dim)
        home = (base.astype(np.float32) @ centres.T).argmax(axis=1)
        place = np.argsort(np.argsort(-(probes.astype(np.float32) @ centres.T), axis=1), axis=1)
        who, near, cosine = [np.array([], int)], [np.array([], int)], [np.array([])]
        for a in range(0, len(probes), 128):
            similar = probes[a : a + 128] @ base.T
            similar[probe_ids[a : a + 128, None] == ids[None, :]] = -2
            top = np.argpartition(-similar, min(settings.k, len(base)) - 1, axis=1)[:, : settings.k]
            at, to = np.repeat(np.arange(len(top)), top.shape[1]), top.ravel()
            real = similar[at, to] > -2
            who, near, cosine = who + [at[real] + a], near + [to[real]], cosine + [similar[at, to][real]]
        who, near, cosine = np.concatenate(who), np.concatenate(near), np.concatenate(cosine)
        return pa.table({
            **{c: pa.array([rows[c][0].as_py()] * len(who), pa.string()) for c in GROUP}, "probe": pa.array(list(probe_ids[who]), pa.string()),
            "cosine": pa.array(cosine, pa.float64()), "needed": pa.array((place[who, home[near]] + 1).astype(np.int32)),
        })

    def least(truths: pa.Table) -> pa.Table:
        cosine, needed = truths["cosine"].to_numpy(), truths["needed"].to_numpy()
        needed = needed[np.argsort(-cosine, kind="stable")]
        if settings.min_cosine is not None:
            needed = needed[: max(int((cosine >= settings.min_cosine).sum()), settings.cell_truths)]
        width = np.sort(needed)[int(np.ceil(halved(settings.recall) * len(needed))) - 1]
        return pa.table({**{c: truths[c].slice(0, 1) for c in GROUP}, "width": pa.array([int(width)], pa.int32())})

    found = (
        sharded.groupBy(*GROUP, "shard").cogroup(spread.groupBy(*GROUP, "shard"))
        .applyInArrow(exact, "project_id string, embedding_model string, probe string, cosine double, needed int")
    )
    best = Window.partitionBy(*GROUP, "probe").orderBy(F.desc("cosine"), "needed")
    truths = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= settings.k).select(*GROUP, "cosine", "needed")
    return cut(truths.groupBy(*GROUP).applyInArrow(least, "project_id string, embedding_model string, width int"))


def _binned(distinct: DataFrame, settings: Settings) -> DataFrame:
    """The representatives with the bins (cell, block) they are searched in and ask in."""
    sizes = distinct.groupBy(*GROUP).agg(F.count("*").alias("n"))
    sized = distinct.join(sizes, GROUP)
    whole = sized.where(F.col("n") <= settings.bin_rows).select(*GROUP, "id", "embedding", F.lit(0).alias("cell"), F.lit(0).alias("block"), F.lit(0).alias("asker"), F.lit(True).alias("is_data"), F.lit(True).alias("asks"))
    if sizes.where(F.col("n") > settings.bin_rows).isEmpty():
        return whole
    large = sized.where(F.col("n") > settings.bin_rows).withColumn("cells", F.least(F.ceil(2 * F.col("n") / settings.bin_rows), F.lit(settings.max_cells)).cast("int"))
    drawn = lambda label, wanted: F.pmod(F.xxhash64("id", F.lit(label)), F.lit(1_000_000)) < 1_000_000.0 * wanted / F.col("n")
    picked = large.withColumn("fits", drawn("fit", settings.cell_fit_rows * F.col("cells"))).withColumn("probes", drawn("probe", F.lit(settings.cell_probes)))

    def fit(table: pa.Table) -> pa.Table:
        rows, fits, probes = matrix(table["embedding"], settings.dim), np.array(table["fits"].to_pylist(), dtype=bool), np.array(table["probes"].to_pylist(), dtype=bool)
        centres = spherical_kmeans(rows[fits] if fits.any() else rows, table["cells"][0].as_py())
        return pa.table({
            **{c: table[c].slice(0, 1) for c in GROUP}, "centres": pa.array([centres.ravel().tolist()], pa.list_(pa.float32())),
            "probe_ids": pa.array([np.array(table["id"].to_pylist(), dtype=object)[probes].tolist()], pa.list_(pa.string())), "probes": pa.array([rows[probes].ravel().tolist()], pa.list_(pa.float64())),
        })

    trees = cut(
        picked.where("fits or probes").select(*GROUP, "id", "embedding", "cells", "fits", "probes").groupBy(*GROUP)
        .applyInArrow(fit, "project_id string, embedding_model string, centres array<float>, probe_ids array<string>, probes array<double>")
    )
    shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.greatest(F.ceil(F.col("n") / (4 * settings.bin_rows)), F.lit(1)))
    sharded = large.select(*GROUP, "id", "embedding", shard.alias("shard"))
    shards = large.select(*GROUP, shard.alias("shard")).distinct()
    widths = _cells_needed(sharded, trees.join(shards, GROUP), settings)
    spread = trees.select(*GROUP, "centres").join(widths, GROUP, "left").join(shards, GROUP)

    def route(rows: pa.Table, tree: pa.Table) -> pa.Table:
        centres = np.array(tree["centres"][0].as_py(), dtype=np.float32).reshape(-1, settings.dim)
        near = matrix(rows["embedding"], settings.dim).astype(np.float32) @ centres.T
        width = min(max(settings.cells_visited, tree["width"][0].as_py() or 0), near.shape[1])
        best = np.argsort(-near, axis=1)[:, :width]
        take = pa.array(np.repeat(np.arange(len(best)), width))
        return pa.table({
            **{c: rows[c].take(take) for c in (*GROUP, "id", "embedding")},
            "cell": pa.array(best.ravel().astype(np.int32)), "is_data": pa.array(np.tile(np.arange(width) == 0, len(best))),
        })

    routed = cut(
        sharded.groupBy(*GROUP, "shard").cogroup(spread.groupBy(*GROUP, "shard"))
        .applyInArrow(route, "project_id string, embedding_model string, id string, embedding array<float>, cell int, is_data boolean")
    )
    held = routed.groupBy(*GROUP, "cell").agg(
        F.greatest(F.ceil(F.count(F.when(F.col("is_data"), True)) / (2 * settings.bin_rows)), F.lit(1)).cast("int").alias("blocks"),
        F.ceil(F.count("*") / (settings.queries_per_bin * settings.bin_rows)).cast("int").alias("askers"),
    )
    place = lambda label, of: F.pmod(F.xxhash64("id", F.lit(label)), F.col(of)).cast("int")
    spots = F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda a: F.struct(b.alias("block"), a.alias("asker")))))
    mine = lambda p: (p["asker"] == F.col("own_asker"))
    stored = lambda p: F.col("is_data") & (p["block"] == F.col("own_block"))
    cells = routed.join(held, [*GROUP, "cell"]).withColumn("own_block", place("block", "blocks")).withColumn("own_asker", place("asker", "askers"))
    cells = cells.withColumn("p", F.explode(F.filter(spots, lambda p: mine(p) | stored(p))))
    return whole.unionByName(cells.select(*GROUP, "id", "embedding", "cell", F.col("p.block").alias("block"), F.col("p.asker").alias("asker"), stored(F.col("p")).alias("is_data"), mine(F.col("p")).alias("asks")))


def nearest(embeddings: DataFrame, settings: Settings) -> DataFrame:
    """(project_id, embedding_model, id, near, cosine, rank): the k most similar other ids of every usable vector's id.

    Rows of one id that carry the same vector count once. Equal cosines are ranked by id. Of more than k copies of a vector
    those with the least ids stand for all, as they are the ones ranked first. A group with one vector gives no row.
    """
    rows = usable(embeddings, settings.dim)
    key = [*GROUP, "h1", "h2"]
    distinct = cut(rows.groupBy(*key).agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("embedding").alias("embedding")))
    links = cut(
        _binned(distinct.select(*GROUP, "id", "embedding"), settings)
        .groupBy(*GROUP, "cell", "block", "asker")
        .applyInArrow(lambda table: _search_bin(table, settings), LINK)
    )
    copied = distinct.where(F.col("id") != F.col("last")).select(*key, F.col("id").alias("first_id"))
    members = rows.select(*key, "id").join(copied, key).select(*GROUP, "first_id", "id").distinct()
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(settings.salts)))
    least = F.row_number().over(Window.partitionBy(*GROUP, "first_id", "salt").orderBy("id"))
    again = F.row_number().over(Window.partitionBy(*GROUP, "first_id").orderBy("id"))
    heads = cut(salted.withColumn("r", least).where(F.col("r") <= settings.k + 1).withColumn("r", again).where(F.col("r") <= settings.k + 1).select(*GROUP, "first_id", F.col("id").alias("head")))
    near_all = links.join(heads.withColumnRenamed("first_id", "near"), [*GROUP, "near"], "left").withColumn("near", F.coalesce("head", "near")).drop("head")
    asking = near_all.join(members.withColumnRenamed("id", "member").withColumnRenamed("first_id", "id"), [*GROUP, "id"], "left").withColumn("id", F.coalesce("member", "id")).drop("member")
    among = members.join(heads, [*GROUP, "first_id"]).where("id <> head").select(*GROUP, "id", F.col("head").alias("near"), F.lit(1.0).alias("cosine"))
    best = Window.partitionBy(*GROUP, "id").orderBy(F.desc("cosine"), "near")
    return asking.unionByName(among).distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= settings.k)


def similar_pairs(embeddings: DataFrame, settings: Settings) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the k most similar of the other."""
    near = nearest(embeddings, settings)
    return near.select(F.least("id", "near").alias("id_a"), F.greatest("id", "near").alias("id_b")).distinct()
