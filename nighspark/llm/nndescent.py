"""Near-duplicate vectors through a neighbour graph refined by NN-descent, linked at a cosine threshold.

Vectors are compared within their label only. Equal vectors are one node. The first lists of k neighbours come from
blocks of nodes that fall on the same side of random hyperplanes; then, round by round, every node introduces the nodes
of its list and those that list it to each other, and each keeps its k best, until few lists change; after the first
round only nodes with a new neighbour on either side do so. A node whose list
is saturated (even its last neighbour is within the threshold) needs a longer one: its list is enlarged to all nodes
of such clusters in its label. The nodes of a cluster (those that chains of links reach) are dealt into groups of a
bounded number, each with a centre and the largest angle from it; two groups whose centres are further apart than both
angles and the threshold's cannot link, and all others are compared tile by tile. Links found so join clusters.
Recall is audited on a bounded set of queries against all nodes, as the mean over those that have links; low recall
starts new rounds, and where it stays low all nodes of a label are compared. All cosines are worked out in double precision.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and those without label, link with
nothing and stand for themselves; vectors of different length do not link; repeated ids are nodes by their vector; equal
similarities in a list go to the larger node; an empty table gives no rows; vectors of any length are taken whole; other
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nighspark.llm.common import components, drop_written, joined_by, written

K, TABLES, BLOCK, TILE = 10, 6, 32, 512
ROUNDS, CHANGED, AUDIT_QUERIES, AUDIT_RECALL, RETRIES = 5, 0.002, 128, 0.98, 2
#: Members of a node's introduction handled together; more are split by hash.
MEMBERS = 96
_LIST = "node long, nbrs array<long>, sims array<double>"


def valid(vector: str, label: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    """Unit rows, in doubles, of a column of equally long vectors."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _lists(node: np.ndarray, sims: np.ndarray, k: int, floor: np.ndarray | None = None):
    """Rows (node, nbrs, sims) with the k nearest others of each row of the similarity matrix, above floor."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(node) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(node) - 1 else np.argsort(-sims, axis=1)[:, :k]
    got = np.take_along_axis(sims, best, 1)
    keep = got > -2 if floor is None else got > floor[:, None]
    return node[best], got, keep


def _rows(node: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, keep: np.ndarray):
    size = keep.sum(1)
    some = size > 0
    offsets = pa.array(np.concatenate(([0], np.cumsum(size[some]))), pa.int32())
    return [pa.array(node[some]), pa.ListArray.from_arrays(offsets, pa.array(nbrs[keep])), pa.ListArray.from_arrays(offsets, pa.array(sims[keep]))]


def _best(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, k: int):
    """The k best distinct neighbours of each node, by node and falling similarity."""
    at = np.lexsort((-sim, nbr, node))
    node, nbr, sim = node[at], nbr[at], sim[at]
    one = np.concatenate(([True], (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])))[: len(node)]
    node, nbr, sim = node[one], nbr[one], sim[one]
    at = np.lexsort((-nbr, -sim, node))
    node, nbr, sim = node[at], nbr[at], sim[at]
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))[: len(node)]
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    return node[rank < k], nbr[rank < k], sim[rank < k]


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """One list of the k best distinct neighbours for each node."""

    def listed(node, nbr, sim):
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))[: len(node)]
        offsets = pa.array(np.append(first, len(node)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(node[first]), pa.ListArray.from_arrays(offsets, pa.array(nbr)), pa.ListArray.from_arrays(offsets, pa.array(sim))], names=["node", "nbrs", "sims"])

    def run(batches):
        held = None
        for batch in batches:
            node, nbrs, sims = batch.columns
            flat = (np.repeat(node.to_numpy(), np.diff(nbrs.offsets.to_numpy())), nbrs.flatten().to_numpy(), sims.flatten().to_numpy())
            flat = _best(*(flat if held is None else map(np.concatenate, zip(held, flat))), k)
            if len(flat[0]):
                # the last node may go on in the next batch
                last = int(np.searchsorted(flat[0], flat[0][-1]))
                yield listed(*(x[:last] for x in flat))
                held = [x[last:] for x in flat]
        if held is not None:
            yield listed(*held)

    return lists.select("node", "nbrs", "sims").repartition("node").sortWithinPartitions("node").mapInArrow(run, _LIST)


def _block_lists(nodes: DataFrame, seed: int, k: int, tables: int, block: int) -> DataFrame:
    """First lists from blocks of hyperplane codes; codes have a bit for each halving of the label down to `block`."""
    sizes = nodes.groupBy("part").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / block))).cast("int").alias("depth"))
    placed = nodes.join(sizes, "part")

    def codes(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, depth = batch.column(2), np.minimum(batch.column(3).to_numpy(), 60)
            dims = np.diff(vectors.offsets.to_numpy())
            key = np.zeros((batch.num_rows, tables), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix(vectors.take(pa.array(at)))
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, d]).standard_normal((d, max(1, int(depth.max()))))
                    bits = (x @ planes > 0) @ (1 << np.arange(planes.shape[1], dtype=np.int64))
                    key[at, t] = bits & ((1 << depth[at].astype(np.int64)) - 1)
            offsets = pa.array(np.arange(0, key.size + 1, tables), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors, pa.ListArray.from_arrays(offsets, pa.array(key.ravel()))], names=["node", "part", "v", "codes"])

    kind = nodes.schema["v"].dataType.simpleString()
    coded = placed.select("node", "part", "v", "depth").mapInArrow(codes, f"node long, part long, v {kind}, codes array<long>")
    each = coded.select("node", "part", "v", F.posexplode("codes").alias("t", "code")).withColumn("key", F.xxhash64("part", "t", "code"))
    # a block that came out too large is dealt into several by hash: any of them fills its nodes' lists
    large = each.groupBy("key").agg(F.ceil(F.count("*") / (2 * block)).alias("parts"))
    each = each.join(large, "key").withColumn("sub", F.pmod(F.xxhash64("node", "t"), "parts"))

    def lists(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        if len(node) < 2:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())), pa.array([], pa.list_(pa.float64()))], names=["node", "nbrs", "sims"])
        x = _matrix(table["v"])
        return pa.table(_rows(node, *_lists(node, x @ x.T, k)), names=["node", "nbrs", "sims"])

    return each.select("key", "sub", "node", "v").groupBy("key", "sub").applyInArrow(lists, _LIST)


def _introduced(graph: DataFrame, nodes: DataFrame, k: int, turn: int, active: DataFrame | None) -> DataFrame:
    """Better neighbours found among the neighbours (both ways) of each (active) node: lists of what beats a node's last one.

    The neighbours of a node that very many list are dealt into parts by a hash that each turn changes.
    """
    edge = graph.select("node", F.explode("nbrs").alias("nbr"))
    meets = edge.select(F.col("node").alias("at"), F.col("nbr").alias("node")).unionAll(edge.select(F.col("nbr").alias("at"), "node")).distinct()
    if active is not None:
        meets = meets.join(active, "at", "left_semi")
    floor = F.when(F.size("sims") >= k, F.element_at("sims", -1)).otherwise(F.lit(-2.0))
    known = nodes.join(graph.select("node", floor.alias("floor")), "node", "left").select("node", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    degree = meets.groupBy("at").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    meets = meets.join(degree, "at").withColumn("sub", F.pmod(F.xxhash64("node", "at", F.lit(turn)), "parts")).join(known, "node")

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            at, sub = held["at"].to_numpy(), held["sub"].to_numpy()
            edges = np.flatnonzero((at[1:] != at[:-1]) | (sub[1:] != sub[:-1])) + 1
            if len(edges):
                yield from groups(held.slice(0, int(edges[-1])), np.concatenate(([0], edges)))
                held = held.slice(int(edges[-1]))
        if held is not None and len(held):
            yield from groups(held, np.array([0, len(held)]))

    def groups(table, bounds):
        node, floor, x = table["node"].to_numpy(), table["floor"].to_numpy(), _matrix(table["v"])
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a > 1:
                out.append((node[a:b], *_lists(node[a:b], x[a:b] @ x[a:b].T, k, floor[a:b])))
            if len(out) >= 2000:
                yield joined(out)
                out = []
        if out:
            yield joined(out)

    def joined(out):
        cols = [_rows(*o) for o in out]
        arrays = [pa.concat_arrays([c[i] for c in cols]) for i in range(3)]
        return pa.RecordBatch.from_arrays(arrays, names=["node", "nbrs", "sims"])

    ordered = meets.select("at", "sub", "node", "floor", "v").repartition("at", "sub").sortWithinPartitions("at", "sub")
    return ordered.mapInArrow(run, _LIST)


def _found(nodes: DataFrame, k: int, tables: int, block: int, rounds: int, seed: int, old: DataFrame | None) -> DataFrame:
    lists = _block_lists(nodes, seed, k, tables, block)
    graph, active = written(_merged(lists if old is None else lists.unionByName(old), k), "graph"), None
    n = graph.count()
    for turn in range(rounds):
        new = written(_introduced(graph, nodes, k, seed * 1000 + turn, active), "met")
        fresh = written(_merged(graph.unionByName(new), k), "graph")
        added = fresh.select("node", F.explode("nbrs").alias("b")).join(graph.select("node", F.explode("nbrs").alias("b")), ["node", "b"], "left_anti")
        added = written(added, "added")
        drop_written(graph, new)
        graph = fresh
        if added.count() <= CHANGED * n * k:
            break
        active = added.select(F.col("node").alias("at")).unionAll(added.select(F.col("b").alias("at"))).distinct()
    return graph


def _tiled(rows: DataFrame, by: str, size: int) -> DataFrame:
    """rows dealt by hash of g into blocks b of about `size` within `by`; each comes once for every pair (i, j) of blocks."""
    blocks = rows.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    own = rows.join(blocks, by).withColumn("b", F.pmod(F.xxhash64("g"), "blocks").cast("int"))
    each = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("blocks", "o")


def _close_groups(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a <= b: the pairs of groups of a label that may hold a link; members: g, part, v."""

    def centre(table: pa.Table) -> pa.Table:
        x = _matrix(table["v"])
        mid = x.sum(0)
        mid = x[0] if np.sqrt(mid @ mid) < 1e-9 else mid / np.sqrt(mid @ mid)
        radius = np.arccos(np.clip(x @ mid, -1, 1)).max()
        return pa.table([table["part"].slice(0, 1), table["g"].slice(0, 1), pa.array([mid.tolist()]), pa.array([radius])], names=["part", "g", "v", "radius"])

    centres = written(members.groupBy("part", "g").applyInArrow(centre, "part long, g long, v array<double>, radius double"), "centres")

    def close(table: pa.Table) -> pa.Table:
        g, b, radius, x = table["g"].to_numpy(), table["b"].to_numpy(), table["radius"].to_numpy(), _matrix(table["v"])
        left, right = (np.flatnonzero(b == table[c][0].as_py()) for c in "ij")
        # the slack is far above the rounding of an arc cosine
        bound = np.arccos(threshold) + radius[left][:, None] + radius[right] + 1e-6
        p, q = np.nonzero(np.arccos(np.clip(x[left] @ x[right].T, -1, 1)) <= bound)
        u, v = g[left[p]], g[right[q]]
        return pa.table([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    return _tiled(centres, "part", TILE).groupBy("part", "i", "j").applyInArrow(close, "a long, b long").distinct()


def _tile_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """Exact links among nodes (node, part, c, root, v, weight), which are compared within their part.

    Rows (node, null, n) are the weight of a node's links, rows (root, other, 0) links between nodes of different roots.
    """
    blocks = nodes.groupBy("part", "c").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    dealt = nodes.join(blocks, ["part", "c"]).withColumn("g", F.xxhash64("part", "c", F.pmod(F.xxhash64("node"), "blocks")))
    dealt = written(dealt.select("g", "part", "node", "root", "v", "weight"), "dealt")
    pairs = written(_close_groups(dealt, threshold), "pairs").select("a", "b", F.xxhash64("a", "b").alias("tile"))
    sides = pairs.select("tile", F.col("a").alias("g"), F.lit(True).alias("first")).unionAll(pairs.where("a <> b").select("tile", "b", F.lit(False)))

    def links(table: pa.Table) -> pa.Table:
        node, root, w, x = table["node"].to_numpy(), table["root"].to_numpy(), table["weight"].to_numpy(), _matrix(table["v"])
        first = table["first"].to_numpy()
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        own = not len(right)
        near = x[left] @ x[left if own else right].T >= threshold
        if own:
            np.fill_diagonal(near, False)
            right, which, n = left, node[left], near @ w[left]
        else:
            which, n = np.concatenate([node[left], node[right]]), np.concatenate([near @ w[right], near.T @ w[left]])
        p, q = np.nonzero(near & (root[left][:, None] != root[right]))
        ends = np.unique(np.sort(np.stack([root[left[p]], root[right[q]]], 1), axis=1), axis=0)
        other = pa.concat_arrays([pa.nulls(len(which), pa.int64()), pa.array(ends[:, 1])])
        return pa.table([pa.array(np.concatenate([which, ends[:, 0]])), other, pa.array(np.concatenate([n, np.zeros(len(ends), np.int64)]))], names=["node", "other", "n"])

    tiles = dealt.join(sides, "g").select("tile", "first", "node", "root", "v", "weight")
    return tiles.groupBy("tile").applyInArrow(links, "node long, other long, n long").groupBy("node", "other").agg(F.sum("n").alias("n"))


def _audit(nodes: DataFrame, counted: DataFrame, threshold: float) -> float:
    """Mean over a bounded number of query nodes of the share of a node's true links that were counted, against all nodes."""
    total = nodes.count()
    share = min(1.0, 20 * AUDIT_QUERIES / max(1, total))
    picked = nodes.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))
    linked = picked.join(counted.where("n > 0"), "node").orderBy(F.xxhash64("node")).limit(AUDIT_QUERIES // 2)
    plain = picked.join(counted.where("n > 0"), "node", "left_anti").withColumn("n", F.lit(0).cast("long")).orderBy(F.xxhash64("node")).limit(AUDIT_QUERIES // 2)
    queries = linked.unionByName(plain).select("node", "part", "v", "n").collect()
    if not queries:
        return 1.0
    plainly = [(q["node"], q["part"], _matrix(pa.array([q["v"]], pa.list_(pa.float64())))[0], q["n"]) for q in queries]
    shared = nodes.sparkSession.sparkContext.broadcast([q[:3] for q in plainly])

    def run(batches):
        truth: dict[int, int] = {}
        for batch in batches:
            node, part, weight = (batch.column(i).to_numpy() for i in (0, 1, 3))
            for q, p, v in shared.value:
                at = np.flatnonzero((part == p) & (node != q))
                if len(at):
                    x = _matrix(batch.column(2).take(pa.array(at)))
                    truth[q] = truth.get(q, 0) + int(weight[at][x @ v >= threshold].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(truth), pa.int64()), pa.array(list(truth.values()), pa.int64())], names=["node", "n"])

    rows = nodes.select("node", "part", "v", "weight").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()
    truth, got = {r["node"]: r["n"] for r in rows}, {q[0]: q[3] for q in plainly}
    shares = [min(got[q], n) / n for q, n in truth.items() if n]
    return sum(shares) / len(shares) if shares else 1.0


def _counts(tiled: DataFrame) -> DataFrame:
    return tiled.where("other is null").select("node", "n")


def linked_vectors(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, k: int = K, tables: int = TABLES, block: int = BLOCK, rounds: int = ROUNDS
) -> DataFrame:
    """id_col, n_links, component_id, kept for every row of df."""
    part = F.xxhash64(F.col(label), F.size(vector))
    base = df.select(F.col(id_col).alias("id"), F.when(valid(vector, label), F.xxhash64(label, vector)).alias("node"), part.alias("part"), F.col(vector).alias("v"))
    nodes = base.where("node is not null").groupBy("node").agg(F.first("part").alias("part"), F.first("v").alias("v"), F.count("*").alias("weight"), F.min("id").alias("low"))
    nodes = written(nodes, "nodes")
    graph, seed = None, 1
    for attempt in range(RETRIES + 1):
        graph = _found(nodes, k, tables, block, rounds, seed + attempt, graph)
        flat = graph.select("node", F.size("nbrs").alias("size"), F.explode(F.arrays_zip("nbrs", "sims")).alias("z")).where(F.col("z.sims") >= threshold)
        near = flat.select(F.least("node", "z.nbrs").alias("a"), F.greatest("node", "z.nbrs").alias("b")).distinct()
        near = written(near, "near")
        reached = written(components(near), "reached")
        full = flat.groupBy("node").agg(F.count("*").alias("links")).where(F.col("links") >= k).select("node")
        clusters = full.join(reached.withColumnRenamed("id", "node"), "node").select("component").distinct()
        saturated = reached.join(clusters, "component", "left_semi").select(F.col("id").alias("node"), F.col("component").alias("c"))
        members = written(saturated.join(nodes, "node").select("node", "part", "c", F.col("c").alias("root"), "v", "weight"), "members")
        tiled = written(_tile_links(members, threshold), "tiled")
        pairs = near.unionAll(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        plain = pairs.join(nodes.select(F.col("node").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("n")).withColumnRenamed("a", "node")
        counted = written(plain.join(members.select("node"), "node", "left_anti").unionByName(_counts(tiled)), "counted")
        if _audit(nodes, counted, threshold) >= AUDIT_RECALL:
            break
    else:
        # the lists stay too poor: every node against all of its label
        whole = nodes.join(reached.withColumnRenamed("id", "node"), "node", "left")
        tiled = written(_tile_links(whole.select("node", "part", F.lit(0).alias("c"), F.coalesce("component", "node").alias("root"), "v", "weight"), threshold), "tiled")
        counted = _counts(tiled)
    joined = components(tiled.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("root"), F.col("component").alias("joined"))
    roots = nodes.select("node", "weight", "low").join(reached.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("component", "node"))
    roots = roots.join(joined, "root", "left").withColumn("root", F.coalesce("joined", "root"))
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    of = roots.join(lows, "root").join(counted, "node", "left").select("node", "component_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = base.select("id", "node").join(of, "node", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
