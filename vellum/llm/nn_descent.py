"""Embedding near-dedup by NN-descent.

Equal vectors are one node (its weight counts them). The neighbour graph starts
from blocks of random-hyperplane orders, compared inside, and is refined by
joining neighbours of neighbours: every node is a centre where its forward and
reverse neighbours meet, are compared with one another, and improve each other's
lists. Rounds stop when lists hardly improve. Edges at or above the threshold are
kept; their components are the groups.

A list of K neighbours is saturated when all of them are linked: the node may
have more links than K. Such nodes are searched again for neighbours outside
their component (a list that holds none of the own component cannot be filled by
it), links found join components, and this goes on until no list has a link that
leaves its component. Then lists are enlarged to all members of the component,
compared in blocks, exactly and in double precision, and only counts leave a block.

Recall is audited: the links of a sample of SAMPLE nodes (smallest hashes of
their ids) are found by brute force against all nodes. While the mean share found
of a sampled node's links is below ``recall``, more orders are added and the graph
is refined again; if MAX_ORDERS do not reach it, the job fails.

Nulls: vectors that are null, empty, zero, or hold a null or non-finite
component link with nothing: n_links 0, component_id their own id, kept. Vectors
of different lengths don't link. Null ids: their vectors take part, and a
component's id is the smallest id that is not null. Rows with the same id are
vectors of their own. An empty table gives an empty result. Only the two named
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import stored
from vellum.llm.graph import components

THRESHOLD = 0.95
K = 10
ORDERS = 8
MAX_ORDERS = 16 * ORDERS
BITS = 24
BLOCK = 512
#: Vectors of one group of an order, about; more bits name a group as vectors grow in number.
GROUP = 4096
#: Members compared at a centre at once, and vectors of a part of a component.
CENTRE, PART = 64, 1024
SAMPLE = 512
MAX_ROUNDS = 4
#: Bits of a code left out by turns where one member of a component stands for all with the same bits.
COARSER = (0, 8, 16)
LEAST_GAIN = 0.001

LIST = "node long, ids binary, sims binary"


def nodes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(node, vec, wide, weight): distinct valid vectors, as bytes of doubles or
    floats. The node is a hash of the vector."""
    kind = vectors.schema[vector_col].dataType.elementType
    wide = not isinstance(kind, (T.FloatType, T.ByteType, T.ShortType))
    dtype = np.dtype("<f8" if wide else "<f4")

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1).to_pylist()
            out = []
            for r in rows:
                v = None if not r or any(x is None for x in r) else np.asarray(r, np.float64)
                out.append(None if v is None or not np.isfinite(v).all() or not v.any() else v.astype(dtype).tobytes())
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["vec_id", "vec"])

    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return named.mapInArrow(run, "vec_id long, vec binary").withColumn("node", F.xxhash64("vec"))


def matrix(vecs: list[bytes], wide: bool) -> np.ndarray:
    """Unit vectors in double precision, one a row."""
    m = np.frombuffer(b"".join(vecs), "<f8" if wide else "<f4").astype(np.float64).reshape(len(vecs), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow in the squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def top(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k most similar (ties: smaller id)."""
    return np.lexsort((ids, -sims))[:k]


def _lists(rows) -> pa.RecordBatch:
    node, ids, sims = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(ids, pa.binary()), pa.array(sims, pa.binary())],
                                      names=["node", "ids", "sims"])


def ordered_blocks(points: DataFrame, wide: bool, n: int, seeds: range) -> DataFrame:
    """LIST rows of the K nearest inside each block of each order. Points with a
    ``component`` look for neighbours outside it only; in an order one member of
    a component stands for those with the same leading bits, so that large
    components leave room for others in a block."""
    outside = "component" in points.columns
    group_bits = max(0, int(np.log2(max(n, 1) / GROUP)))

    def codes(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            node, vec, own = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vec):
                by_size.setdefault(len(v), []).append(i)
            for size, at in by_size.items():
                m = matrix([vec[i] for i in at], wide)
                for s in seeds:
                    if (s, size) not in planes:
                        planes[s, size] = np.random.default_rng([s, size]).standard_normal((m.shape[1], BITS))
                    code = (m @ planes[s, size] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), s, np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(code >> (BITS - group_bits)),
                         pa.array(code >> (COARSER[s % len(COARSER)] if outside else 0)), pa.array(own[at]), pa.array(node[at]),
                         pa.array([vec[i] for i in at], pa.binary())],
                        names=["seed", "size", "grp", "code", "own", "node", "vec"])

    def compare(batches):
        key, cell, ids, owns, vecs = None, None, [], [], []

        def block():
            m = matrix(vecs, wide)
            s = m @ m.T
            a, c = np.array(ids, np.int64), np.array(owns, np.int64)
            s[c[:, None] == c] = -2
            out = []
            k = min(K, len(a) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.empty((len(a), 0), int)
            for i in range(len(a)) if k else ():
                b = best[i][s[i, best[i]] > -2]
                if len(b):
                    out.append((int(a[i]), a[b].tobytes(), s[i, b].tobytes()))
            return _lists(out)

        for batch in batches:
            for seed, size, grp, code, own, node, vec in zip(*(c.to_pylist() for c in batch.columns)):
                if (seed, size, grp) != key:
                    if len(ids) > 1:
                        yield block()
                    key, cell, ids, owns, vecs = (seed, size, grp), None, [], [], []
                if outside and (code, own) == cell:
                    continue
                cell = code, own
                ids.append(node)
                owns.append(own)
                vecs.append(vec)
                if len(ids) == BLOCK:
                    yield block()
                    # neighbours across the cut meet in the next block
                    ids, owns, vecs = ids[BLOCK // 2:], owns[BLOCK // 2:], vecs[BLOCK // 2:]
        if len(ids) > 1:
            yield block()

    own = "component" if outside else "node"
    rows = points.select("node", "vec", F.col(own).alias("own")).mapInArrow(codes, "seed int, size int, grp long, code long, own long, node long, vec binary")
    rows = rows.repartition("seed", "size", "grp").sortWithinPartitions("seed", "size", "grp", "code", "own", "node")
    return rows.mapInArrow(compare, LIST)


def merged(lists: DataFrame) -> DataFrame:
    """One list of the K best for each node."""
    def run(batches):
        node, ids, sims = None, [], []

        def best():
            i, s = np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(sims), np.float64)
            i, first = np.unique(i, return_index=True)
            s = s[first]
            keep = top(i, s, K)
            return node, i[keep].tobytes(), s[keep].tobytes()

        for batch in batches:
            out = []
            for n, i, s in zip(*(c.to_pylist() for c in batch.columns)):
                if n != node:
                    if ids:
                        out.append(best())
                    node, ids, sims = n, [], []
                ids.append(i)
                sims.append(s)
            yield _lists(out)
        if ids:
            yield _lists([best()])

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, LIST)


def edges(graph: DataFrame) -> DataFrame:
    """(u, v, sim, worst) of all lists; worst is the smallest similarity of a full list, else -2."""
    def run(batches):
        for batch in batches:
            cols = []
            for n, i, s in zip(*(c.to_pylist() for c in batch.columns)):
                i, s = np.frombuffer(i, np.int64), np.frombuffer(s, np.float64)
                cols.append((np.full(len(i), n), i, s, np.full(len(i), s.min() if len(s) == K else -2.0)))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols)], names=["u", "v", "sim", "worst"])

    return graph.mapInArrow(run, "u long, v long, sim double, worst double")


def joined_neighbours(graph: DataFrame, points: DataFrame, wide: bool, inside: DataFrame | None = None) -> DataFrame:
    """One round: LIST rows of the pairs that meet at a centre and improve a list.
    Points with a ``component`` meet through the lists ``inside`` too, and pair
    with members of other components only."""
    out = edges(graph)
    worst = out.select("u", "worst").distinct()
    out = out if inside is None else out.union(edges(inside))
    meet = out.select(F.col("u").alias("centre"), F.col("v").alias("member")).union(out.select("v", "u")).distinct()
    degree = meet.groupBy("centre").agg(F.ceil(F.count("*") / CENTRE).cast("int").alias("parts"))
    meet = meet.join(degree, "centre").withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")))
    own = "component" if "component" in points.columns else "node"
    about = points.select(F.col("node").alias("member"), F.col(own).alias("own"), "vec").join(worst.withColumnRenamed("u", "member"), "member", "left")
    rows = meet.select("centre", "part", "member").join(about, "member").select(
        "centre", "part", "member", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "own", "vec")

    def run(batches):
        key, members = None, []

        def compare():
            ids = np.array([m[0] for m in members], np.int64)
            limit = np.array([m[1] for m in members])
            own = np.array([m[2] for m in members], np.int64)
            m = matrix([m[3] for m in members], wide)
            s = m @ m.T
            s[own[:, None] == own] = -3
            better = s > limit[:, None]
            return [(int(ids[i]), ids[better[i]].tobytes(), s[i, better[i]].tobytes()) for i in np.flatnonzero(better.any(axis=1))]

        for batch in batches:
            found = []
            for c, p, m, w, o, v in zip(*(c.to_pylist() for c in batch.columns)):
                if (c, p) != key:
                    if len(members) > 1:
                        found.extend(compare())
                    key, members = (c, p), []
                members.append((m, w, o, v))
            yield _lists(found)
        yield _lists(compare() if len(members) > 1 else [])

    return rows.repartition("centre", "part").sortWithinPartitions("centre", "part").mapInArrow(run, LIST)


def refine(graph: DataFrame, points: DataFrame, wide: bool, inside: DataFrame | None = None) -> DataFrame:
    """Rounds of NN-descent until the sum of similarities hardly grows."""
    def total(g):
        return edges(g).agg(F.sum("sim")).first()[0] or 0.0

    graph = stored(graph)
    before = total(graph)
    for _ in range(MAX_ROUNDS):
        graph = stored(merged(graph.union(joined_neighbours(graph, points, wide, inside))))
        after = total(graph)
        if after - before <= LEAST_GAIN * abs(after):
            break
        before = after
    return graph


def linked_groups(graph: DataFrame, points: DataFrame, wide: bool, threshold: float, orders: int) -> DataFrame:
    """(node, component) of the links in the lists and of those that saturated
    lists have no room for. A link that no list holds joins two saturated nodes;
    each pass joins every component that has such a link, so passes are few."""
    links = edges(graph).where(F.col("sim") >= threshold).select("u", "v")
    full = edges(graph).where(F.col("worst") >= threshold).select(F.col("u").alias("node")).distinct()
    searched = stored(points.select("node", "vec").join(full, "node"))
    n = searched.count()
    inside = stored(graph.join(full, "node", "left_semi"))
    while True:
        groups = stored(components(links))
        own = stored(searched.join(groups, "node"))
        if own.select("component").distinct().limit(2).count() < 2:
            return groups
        lists = refine(merged(ordered_blocks(own, wide, n, range(orders))), own, wide, inside)
        more = stored(edges(lists).where(F.col("sim") >= threshold).select("u", "v"))
        if more.isEmpty():
            return groups
        links = groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)


def link_counts(points: DataFrame, groups: DataFrame, wide: bool, threshold: float) -> DataFrame:
    """(node, links): vectors linked with each node of a component, found by
    comparing its members in blocks of PART; copies of a node count each."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    placed = groups.join(sizes, "component").join(points, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    left = placed.select("component", F.col("part").cast("int").alias("i"), every, "node", "weight", "vec").select(
        "component", "i", F.col("other").alias("j"), F.lit(0).alias("side"), "node", "weight", "vec")
    right = placed.where("parts > 1").select("component", every, F.col("part").cast("int").alias("j"), "node", "weight", "vec").select(
        "component", F.col("other").alias("i"), "j", F.lit(1).alias("side"), "node", "weight", "vec").where("i <> j")

    def run(batches):
        key, sides = None, ([], [])

        def count():
            if not sides[0]:
                return []
            own = key[1] == key[2]
            other = sides[0] if own else sides[1]
            if not other:
                return []
            a, b = matrix([x[2] for x in sides[0]], wide), matrix([x[2] for x in other], wide)
            hit = a @ b.T >= threshold
            if own:
                np.fill_diagonal(hit, False)
            links = hit @ np.array([x[1] for x in other], np.int64)
            return [(x[0], int(n)) for x, n in zip(sides[0], links)]

        def table(rows):
            rows = np.array(rows, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["node", "links"])

        for batch in batches:
            out = []
            for c, i, j, side, node, weight, vec in zip(*(c.to_pylist() for c in batch.columns)):
                if (c, i, j) != key:
                    out.extend(count() if key else [])
                    key, sides = (c, i, j), ([], [])
                sides[side].append((node, weight, vec))
            yield table(out)
        yield table(count() if key else [])

    rows = left.union(right).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "side")
    return rows.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def audit(points: DataFrame, groups: DataFrame, wide: bool, threshold: float) -> tuple[int, float]:
    """Links of the sample by brute force: how many sampled nodes have any, and
    the mean share of a node's links that are inside its component."""
    picked = points.select("node", "vec").orderBy(F.md5(F.col("node").cast("string")), "node").limit(SAMPLE).collect()
    if not picked:
        return 0, 1.0
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["vec"]) for r in picked}:
        same = [r for r in picked if len(r["vec"]) == size]
        by_size[size] = np.array([r["node"] for r in same], np.int64), matrix([bytes(r["vec"]) for r in same], wide)

    def run(batches):
        for batch in batches:
            node, vec = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            pairs = [np.empty((0, 2), np.int64)]
            for size, (ids, q) in by_size.items():
                at = [i for i, v in enumerate(vec) if len(v) == size]
                if at:
                    a, b = np.nonzero(q @ matrix([vec[i] for i in at], wide).T >= threshold)
                    pairs.append(np.stack([ids[a], node[at][b]], axis=1))
            p = np.concatenate(pairs)
            p = p[p[:, 0] != p[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["u", "v"])

    true = points.select("node", "vec").mapInArrow(run, "u long, v long")
    a = groups.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    b = groups.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    each = true.join(a, "u", "left").join(b, "v", "left").groupBy("u").agg(
        F.avg(F.when(F.col("cu") == F.col("cv"), 1.0).otherwise(0.0)).alias("share"))
    row = each.agg(F.count("*"), F.avg("share")).first()
    return int(row[0]), 1.0 if row[1] is None else float(row[1])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    kind = vectors.schema[vector_col].dataType.elementType
    wide = not isinstance(kind, (T.FloatType, T.ByteType, T.ShortType))
    rows = stored(nodes(vectors, id_col, vector_col))
    points = stored(rows.where("vec is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("weight")))
    n = points.count()

    orders = ORDERS
    graph = refine(merged(ordered_blocks(points, wide, n, range(orders))), points, wide)
    while True:
        groups = linked_groups(graph, points, wide, threshold, orders)
        sampled, share = audit(points, groups, wide, threshold)
        if share >= recall:
            break
        if orders >= MAX_ORDERS:
            raise RuntimeError(f"recall {share:.4f} over {sampled} sampled vectors with links is below {recall} after {orders} orders")
        more = ordered_blocks(points, wide, n, range(orders, 2 * orders))
        graph, orders = refine(merged(graph.union(more)), points, wide), 2 * orders

    counts = link_counts(points, groups, wide, threshold)
    about = points.select("node", "weight").join(groups, "node", "left").join(counts, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    smallest = rows.where("vec is not null").join(about, "node").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    about = about.join(smallest, "component").select("node", "n_links", "component_id")
    result = rows.select("vec_id", "node", F.col("vec").isNotNull().alias("valid")).join(about, "node", "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return result.select("vec_id", F.when(F.col("valid"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
                         component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
