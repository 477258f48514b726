"""Near-duplicate vectors by NN-descent, with exact link counts.

Equal vectors are one node with a weight. Each node starts with the nearest of its block in several
orders by random hyperplanes; then every round joins the neighbours of one node with each other
(neighbours of neighbours) and keeps the ``K`` nearest of each. Rounds go on until an audit on
``AUDIT`` nodes and half as many that have a link, compared with all nodes, finds the wanted share of their
links in the graph. Where ``ROUNDS`` rounds do not reach it, lists and blocks are enlarged to twice their
length before every further one, with new orders, however often that takes.

Edges at the threshold or above give the components. A full list whose worst entry is still a link is
saturated: its node may have more links than its list holds. Links within a component need no list:
its blocks are compared as matrices and only counts leave the task. Links between saturated nodes of
different components are found from blocks as well: components are joined where a pair of blocks has a
link. Two blocks whose centres and radii settle all their angles at once are not compared.

Cosines are in double precision. Null and empty vectors, vectors with null or non-finite components and
zero vectors link with nothing, as do vectors of different lengths. Rows that repeat a vec_id are
separate rows. An empty table gives an empty result. Only vec_id and embedding are read, so further columns may
have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import components, partitions, written

K = 10
TREES, PLANES, LEAF = 8, 24, 64
#: Rounds before lists are enlarged.
ROUNDS = 3
AUDIT, WANTED = 1024, 0.995
#: Vectors in a block of a component, and centres of blocks in a tile.
BLOCK, TILE = 512, 1024
#: Angles this close to the threshold are never settled by bounds.
SLACK = 1e-6


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def readable(vectors: DataFrame) -> DataFrame:
    """vec_id, row and v: the components as doubles, null where the vector links with nothing; written."""

    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column(1):
                x = None if not value.is_valid else value.as_py()
                if not x or any(c is None for c in x):
                    out.append(None)
                    continue
                x = np.array(x, "<f8")
                scale = np.abs(x).max()
                ok = np.isfinite(scale) and scale > 0
                out.append((x / scale).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "v"])

    source = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return written(source.mapInArrow(run, "vec_id long, v binary").withColumn("row", F.monotonically_increasing_id()), "vectors")


def ordered(nodes: DataFrame, turn: int = 0) -> DataFrame:
    """Every node once for each tree with the side of each of its hyperplanes as a number to sort by; other planes each ``turn``."""

    def run(batches):
        for batch in batches:
            for length in sorted({len(v) for v in batch.column(1).to_pylist()}):
                own = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(v) == length]
                x = unit([v for _, v in own])
                for tree in range(TREES):
                    planes = np.random.default_rng([tree, length, turn] if turn else [tree, length]).normal(size=(x.shape[1], PLANES))
                    sides = (x @ planes > 0) @ (1 << np.arange(PLANES)[::-1])
                    n = len(own)
                    columns = [pa.array([tree] * n, pa.int32()), pa.array([length] * n, pa.int32()), pa.array(sides), pa.array([i for i, _ in own]), pa.array([v for _, v in own], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "length", "sides", "id", "v"])

    return nodes.select("id", "v").mapInArrow(run, "tree int, length int, sides long, id long, v binary")


def nearest_in(ids: np.ndarray, sims: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(u, v, sim) of the ``k`` nearest others of each row, those above ``floor`` only."""
    n = len(ids)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    sims = sims.copy()
    np.fill_diagonal(sims, -2)
    k = min(k, n - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(n), k)
    best = best.reshape(-1)
    value = sims[rows, best]
    if floor is not None:
        keep = value > floor[rows]
        rows, best, value = rows[keep], best[keep], value[keep]
    return ids[rows], ids[best], value


def first_lists(nodes: DataFrame, k: int = K, leaf: int = LEAF, turn: int = 0) -> DataFrame:
    """(u, v, sim) from blocks of ``leaf`` neighbours in each order, each block half overlapping the next."""

    def block(held):
        ids = np.array([i for i, _ in held], np.int64)
        x = unit([v for _, v in held])
        u, v, s = nearest_in(ids, x @ x.T, k)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], names=["u", "v", "sim"])

    def run(batches):
        at, held, new = None, [], 0
        for batch in batches:
            for tree, length, id, v in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4))):
                if (tree, length) != at:
                    if new and len(held) > 1:
                        yield block(held)
                    at, held, new = (tree, length), [], 0
                held.append((id, v))
                new += 1
                if len(held) == leaf:
                    yield block(held)
                    held, new = held[leaf // 2 :], 0
        if new and len(held) > 1:
            yield block(held)

    order = ["tree", "length", "sides", "id"]
    dealt = ordered(nodes, turn).repartitionByRange(partitions(nodes.sparkSession), *order)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, "u long, v long, sim double")


def nearest_lists(edges: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` nearest of each node, from edges that may repeat."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    return once.withColumn("place", place).where(F.col("place") <= k).drop("place")


def descent(graph: DataFrame, nodes: DataFrame, k: int = K) -> DataFrame:
    """One round: the members around each node (its list, itself, the nearest that list it) are joined with each other."""
    back = graph.select(F.col("v").alias("w"), F.col("u").alias("x"), "sim")
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.col("sim").desc(), "x"))
    back = back.withColumn("place", place).where(F.col("place") <= 2 * k).select("w", "x")
    around = graph.select(F.col("u").alias("w"), F.col("v").alias("x")).unionByName(back).unionByName(nodes.select(F.col("id").alias("w"), F.col("id").alias("x"))).distinct()
    floors = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("floor"))
    known = nodes.select("id", "v").join(floors, nodes.id == floors.u, "left").select(F.col("id").alias("x"), "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    members = around.join(known, "x").groupBy("w").agg(F.collect_list(F.struct("x", "v", "floor")).alias("members"))

    def run(batches):
        for batch in batches:
            found = [[], [], []]
            for members in batch.column(0):
                members = [m for m in members.as_py()]
                length = len(members[0]["v"])
                members = [m for m in members if len(m["v"]) == length]
                x = unit([m["v"] for m in members])
                ids, floor = np.array([m["x"] for m in members], np.int64), np.array([m["floor"] for m in members])
                for out, part in zip(found, nearest_in(ids, x @ x.T, k, floor)):
                    out.append(part)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], names=["u", "v", "sim"])

    # at most 3 k + 1 members each
    better = members.select("members").mapInArrow(run, "u long, v long, sim double")
    return nearest_lists(graph.unionByName(better), k)


def saturated(graph: DataFrame, threshold: float, k: int = K) -> DataFrame:
    """id of the nodes whose list is full of links."""
    lists = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("worst"))
    return lists.where((F.col("n") >= k) & (F.col("worst") >= threshold)).select(F.col("u").alias("id"))


def audit(graph: DataFrame, nodes: DataFrame, threshold: float, state: DataFrame | None = None, k: int = K) -> float:
    """Share of the true links of the audited nodes that the graph has, or for saturated nodes the components of ``state``."""
    linked = graph.where(F.col("sim") >= threshold).select(F.col("u").alias("id")).distinct()
    drawn = [F.xxhash64("id", F.lit("audit")), F.col("id")]
    queries = {}
    for among, n in ((nodes, AUDIT), (nodes.join(linked, "id", "left_semi"), AUDIT // 2)):
        queries |= {q.id: bytes(q.v) for q in among.select("id", "v").orderBy(*drawn).limit(n).collect()}
    groups = {}
    for id, v in queries.items():
        groups.setdefault(len(v), []).append((id, v))
    held = {n: (np.array([i for i, _ in own], np.int64), unit([v for _, v in own])) for n, own in groups.items()}

    def run(batches):
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for length in sorted({len(v) for v in raw} & set(held)):
                own = [(i, v) for i, v in zip(ids, raw) if len(v) == length]
                mine = np.array([i for i, _ in own], np.int64)
                q, y = np.nonzero(held[length][1] @ unit([v for _, v in own]).T >= threshold)
                a, b = held[length][0][q], mine[y]
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["q", "y"])

    true = nodes.select("id", "v").mapInArrow(run, "q long, y long")
    have = graph.select(F.col("u").alias("q"), F.col("v").alias("y")).unionByName(graph.select(F.col("v").alias("q"), F.col("u").alias("y"))).distinct()
    found = true.join(have.withColumn("hit", F.lit(1)), ["q", "y"], "left")
    if state is not None:
        full = state.join(saturated(graph, threshold, k), "id").select(F.col("id").alias("q"), F.col("component_id").alias("own"))
        other = state.select(F.col("id").alias("y"), F.col("component_id").alias("other"))
        same = F.when(F.col("own") == F.col("other"), 1)
        found = found.join(full, "q", "left").join(other, "y", "left").withColumn("hit", F.coalesce("hit", same))
    found = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit")).first()
    return found.hit / found.n if found.n else 1.0


def linked_components(graph: DataFrame, nodes: DataFrame, threshold: float, k: int = K) -> DataFrame:
    """id and component_id by the links of the graph and those between saturated nodes; written."""
    edges = graph.where(F.col("sim") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
    state = written(components(nodes.select("id"), edges), "components")
    members = state.join(saturated(graph, threshold, k), "id").join(nodes, "id").select(F.col("component_id").alias("root"), "id", "w", "v")
    across = written(links_across(members, threshold), "across")
    if not across.take(1):
        return state
    roots = across.select("a").union(across.select("b")).distinct().withColumnRenamed("a", "id")
    joined = components(roots, across).select(F.col("id").alias("root"), F.col("component_id").alias("least"))
    state = state.join(joined, state.component_id == joined.root, "left")
    return written(state.select("id", F.coalesce("least", "component_id").alias("component_id")), "components")


def grouped_graph(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The neighbour graph, and the components of its nodes."""
    step, k, leaf = 0, K, LEAF
    graph = written(nearest_lists(first_lists(nodes, k, leaf), k), "graph")
    while True:
        graph = written(descent(graph, nodes, k), "graph")
        state = linked_components(graph, nodes, threshold, k)
        if audit(graph, nodes, threshold, state, k) >= WANTED:
            return graph, state
        step += 1
        if step >= ROUNDS:
            k, leaf = 2 * k, 2 * leaf
            graph = written(nearest_lists(graph.unionByName(first_lists(nodes, k, leaf, step)), k), "graph")


def neighbour_graph(nodes: DataFrame, threshold: float) -> DataFrame:
    return grouped_graph(nodes, threshold)[0]


def blocks_of(members: DataFrame) -> DataFrame:
    """root, block, ids, weights, vs, size (total weight), centre and radius of blocks of at most BLOCK nodes of one component."""
    place = F.row_number().over(Window.partitionBy("root", "part").orderBy("id")) - 1
    parts = members.withColumn("part", F.shiftright("id", 33))
    blocks = parts.withColumn("block", F.concat_ws("-", "part", F.floor(place / BLOCK)))
    gathered = blocks.groupBy("root", "block").agg(F.collect_list(F.struct("id", "w", "v")).alias("m"))

    def run(batches):
        for batch in batches:
            for root, block, members in zip(*(batch.column(k).to_pylist() for k in range(3))):
                members.sort(key=lambda m: m["id"])
                x = unit([m["v"] for m in members])
                centre = x.mean(axis=0)
                norm = np.sqrt(centre @ centre)
                centre = centre / norm if norm > 1e-9 else x[0]
                radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
                columns = [[root], [block], [[m["id"] for m in members]], [[m["w"] for m in members]], [x.astype("<f8").tobytes()], [int(sum(m["w"] for m in members))], [centre.astype("<f8").tobytes()], [radius]]
                kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["root", "block", "ids", "ws", "vs", "size", "centre", "radius"])

    return gathered.select("root", "block", "m").mapInArrow(run, "root long, block string, ids array<long>, ws array<long>, vs binary, size long, centre binary, radius double")


def links_across(members: DataFrame, threshold: float) -> DataFrame:
    """a and b: components (by root) of which some ``members`` are linked; all pairs of their blocks are settled or compared."""
    blocks = written(blocks_of(members), "blocks")
    tiles = -(-blocks.count() // TILE)
    limit = math.acos(threshold)
    slim = blocks.select("root", "block", F.length("centre").alias("length"), "centre", "radius")
    slim = slim.withColumn("tile", F.pmod(F.xxhash64("root", "block"), F.lit(max(tiles, 1))))
    tiled = written(slim.groupBy("length", "tile").agg(F.collect_list(F.struct("root", "block", "centre", "radius")).alias("m")), "tiles")
    heads = tiled.select("length", "tile")
    pairs = heads.join(heads.select("length", F.col("tile").alias("o_tile")), "length").where("tile <= o_tile")
    pairs = pairs.join(tiled, ["length", "tile"]).join(tiled.select("length", F.col("tile").alias("o_tile"), F.col("m").alias("o_m")), ["length", "o_tile"])

    def settle(batches):
        for batch in batches:
            for own, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (c, r, root), (o_c, o_r, o_root) = ((unit([m["centre"] for m in t]), np.array([m["radius"] for m in t]), np.array([m["root"] for m in t], np.int64)) for t in (own, other))
                angle = np.arccos(np.clip(c @ o_c.T, -1, 1))
                reach = r[:, None] + o_r
                near = (angle - reach <= limit + SLACK) & (root[:, None] != o_root)
                whole = near & (angle + reach < limit - SLACK)
                known = np.unique(np.stack([root[np.nonzero(whole)[0]], o_root[np.nonzero(whole)[1]]], axis=1), axis=0)
                i, j = np.nonzero(near & ~whole)
                columns = [root[i], [own[k]["block"] for k in i], o_root[j], [other[k]["block"] for k in j]]
                columns = [np.concatenate([known[:, 0], columns[0]]), [None] * len(known) + columns[1], np.concatenate([known[:, 1], columns[2]]), [None] * len(known) + columns[3]]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["root", "block", "o_root", "o_block"])

    pairs = written(pairs.select("m", "o_m").mapInArrow(settle, "root long, block string, o_root long, o_block string"), "pairs")
    known = pairs.where("block IS NULL").select(F.col("root").alias("a"), F.col("o_root").alias("b"))
    right = blocks.select(F.col("root").alias("o_root"), F.col("block").alias("o_block"), F.size("ids").alias("o_n"), F.col("vs").alias("o_vs"))
    compared = pairs.where("block IS NOT NULL").join(blocks.select("root", "block", F.size("ids").alias("n"), "vs"), ["root", "block"]).join(right, ["o_root", "o_block"])

    def compare(batches):
        for batch in batches:
            found = [[], []]
            for a, b, n, vs, o_n, o_vs in zip(*(batch.column(k).to_pylist() for k in range(6))):
                x, y = np.frombuffer(vs, "<f8").reshape(n, -1), np.frombuffer(o_vs, "<f8").reshape(o_n, -1)
                if (x @ y.T >= threshold).any():
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])

    linked = compared.select("root", "o_root", "n", "vs", "o_n", "o_vs").mapInArrow(compare, "a long, b long")
    return known.unionByName(linked).distinct()


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """id and linked: total weight of the nodes of its component (itself included) at the threshold or above."""
    blocks = written(blocks_of(members), "blocks")
    limit = math.acos(threshold)
    slim = blocks.select("root", "block", "size", "centre", "radius")
    other = slim.select("root", *(F.col(c).alias(f"o_{c}") for c in ("block", "size", "centre", "radius")))

    def settle(batches):
        for batch in batches:
            sizes = np.array([len(c) for c in batch.column(4).to_pylist()])
            for size in np.unique(sizes):  # vectors of one component have one length
                part = batch.filter(pa.array(sizes == size))
                c, o = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<f8").reshape(part.num_rows, -1) for k in (4, 5))
                angle = np.arccos(np.clip((c * o).sum(axis=1), -1, 1))
                reach = part.column(6).to_numpy() + part.column(7).to_numpy()
                kind = np.where(angle + reach < limit - SLACK, 1, np.where(angle - reach > limit + SLACK, -1, 0))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(4)] + [pa.array(kind.astype(np.int32))], names=["root", "block", "o_block", "o_size", "kind"])

    pairs = slim.join(other, "root").select("root", "block", "o_block", "o_size", "centre", "o_centre", "radius", "o_radius")
    pairs = written(pairs.mapInArrow(settle, "root long, block string, o_block string, o_size long, kind int").where("kind >= 0"), "pairs")
    whole = pairs.where("kind = 1").groupBy("root", "block").agg(F.sum("o_size").alias("linked"))
    whole = blocks.join(whole, ["root", "block"]).select(F.explode("ids").alias("id"), "linked")
    right = blocks.select("root", F.col("block").alias("o_block"), F.col("ws").alias("o_ws"), F.col("vs").alias("o_vs"))
    compared = pairs.where("kind = 0").join(blocks.select("root", "block", "ids", "vs"), ["root", "block"]).join(right, ["root", "o_block"])

    def compare(batches):
        for batch in batches:
            for ids, vs, ws, other in zip(*(batch.column(k).to_pylist() for k in range(4))):
                x, y = np.frombuffer(vs, "<f8").reshape(len(ids), -1), np.frombuffer(other, "<f8").reshape(len(ws), -1)
                linked = (x @ y.T >= threshold) @ np.array(ws, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(linked)], names=["id", "linked"])

    counted = compared.select("ids", "vs", "o_ws", "o_vs").mapInArrow(compare, "id long, linked long")
    return whole.unionByName(counted).groupBy("id").agg(F.sum("linked").alias("linked"))


def vector_groups(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    rows = readable(vectors)
    nodes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("row").alias("id"), F.count("*").alias("w"))
    nodes = written(nodes, "nodes")
    _, state = grouped_graph(nodes, threshold)
    several = state.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = state.join(several, "component_id").join(nodes, "id").select(F.col("component_id").alias("root"), "id", "w", "v")
    counts = link_counts(members, threshold)
    named = nodes.join(state, "id").join(counts, "id", "left").select("v", F.col("component_id").alias("root"), (F.coalesce("linked", "w") - 1).alias("n_links"))
    placed = rows.join(named, "v", "left")
    placed = written(placed.select("vec_id", F.coalesce("root", "row").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "placed")
    least = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return placed.join(least, "root").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
