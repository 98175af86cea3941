"""Exact top-k inner-product search with paged M-trees.

Vectors become integers floor(scale * x). Each goes to the nearest of PIVOTS
sampled routing objects; the vectors of a routing object, split into parts of bounded
size, form one M-tree, stored as pages: a node has a routing object, a covering radius
and its distance to its parent's routing object; a leaf has its entries in order of
their distance to its routing object.

The order of Euclidean distance bounds the inner product: q.x = (|q|^2 + |x|^2 -
d(q,x)^2) / 2, and d(q,x) >= d(q,c) - radius for a node with routing object c. Before
d(q,c) is computed at all, the stored parent distance bounds it: d(q,c) >= |d(q,p) -
d(c,p)|. Leaf entries are skipped in the same way, as a range of stored distances.

Search runs in two steps. Each query searches its home tree best-first and so gets a
k-th best score; then it goes to every other tree whose bound reaches that score
(the directory has one row per routing object), and the results are merged. A
task reads the pages of one tree once and streams the queries past it, a batch at
a time: each query takes its pages in order of their bounds, in steps that double, and
stops at the first page below its k-th best score. Nothing is cut: results are exact.

Nulls: vectors that are null or hold a null or non-finite component take no part;
an empty vector does, among empty ones. Vectors of different lengths don't meet. A
null id is no query; as a candidate it comes after all others of its score. Every row
but the query's own is a candidate: rows with the same id are queries and
candidates of their own, and rows that are equal throughout give equal results (each
sees the others). Of equal vectors only the k + 1 smallest ids can be results, so only
they are kept. An empty table, or one without queries, gives no rows. A component of
2^14 or more in size (at scale 1024) is refused with an error. Only the two named columns are
read, so others may have any name.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import stored
from vellum.llm.lattice import integer_vectors

SCALE, TOP, EVERY = 1024, 10, 100
LIMIT = 1 << 24
#: Routing objects of the directory at most; a tree's vectors take about TREE_BYTES at most.
PIVOTS, TREE_BYTES = 1024, 32 << 20
#: Children of an inner node, entries of a leaf.
FAN, PAGE = 16, 128
#: Queries searched together, and queries of a task (a tree is read once for each such lane).
BATCH, LANE = 512, 1 << 20

NODE = "pivot int, part int, node int, parent int, radius double, away double, norm double, centre binary, ids array<long>, copies binary, vecs binary, distances binary"


def _type(most: int) -> str:
    return "<i2" if most < 1 << 15 else "<i4"


def _exact(width: int, most: int):
    """Number type in which inner products are exact."""
    return np.float64 if width * most * most < 1 << 51 else np.int64


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64) - c.astype(np.float64)
    return np.sqrt((d * d).sum(axis=-1))


def build(x: np.ndarray) -> list[tuple[int, int, np.ndarray, float, float, np.ndarray | None, np.ndarray | None]]:
    """Nodes of an M-tree over the rows of x: (node, parent, routing object, radius,
    distance to the parent's, entries, their distances); inner nodes have no
    entries. A parent comes before its children, siblings stand together."""
    out, numbers = [], 0
    waiting = [(np.arange(len(x)), -1, None)]
    while waiting:
        later = []
        for rows, parent, above in waiting:
            centre = x[rows[_distances(x[rows], x[rows].mean(axis=0)).argmin()]]
            d = _distances(x[rows], centre)
            away = 0.0 if above is None else float(_distances(centre, above))
            node, numbers = numbers, numbers + 1
            if len(rows) <= PAGE:
                order = np.argsort(d, kind="stable")
                out.append((node, parent, centre, float(d.max()), away, rows[order], d[order]))
                continue
            out.append((node, parent, centre, float(d.max()), away, None, None))
            nearest, own = d, np.zeros(len(rows), np.int64)  # routing objects far from one another
            for f in range(1, FAN):
                e = _distances(x[rows], x[rows[nearest.argmax()]])
                own[e < nearest] = f
                nearest = np.minimum(nearest, e)
            if np.bincount(own).max() > len(rows) * 0.9:  # hardly apart: equal parts along the distance
                own = np.argsort(np.argsort(d, kind="stable")) * FAN // len(rows)
            later += [(rows[own == f], node, centre) for f in range(FAN) if (own == f).any()]
        waiting = later
    return out


class Tree:
    """A tree in memory, from its pages."""

    def __init__(self, pages: list[dict], kind: str, width: int):
        pages = sorted(pages, key=lambda p: p["node"])
        self.parent = np.array([p["parent"] for p in pages])
        self.radius, self.away, self.norm = (np.array([p[c] for p in pages]) for c in ("radius", "away", "norm"))
        centre = np.array([np.frombuffer(p["centre"], kind) for p in pages]).reshape(len(pages), width)
        most = max(1, int(np.sqrt(self.norm.max())) + 1)
        self.number = _exact(width, most)
        self.centre, self.most = centre.astype(self.number), most
        self.level = np.zeros(len(pages), int)
        for i, p in enumerate(self.parent):
            self.level[i] = 0 if p < 0 else self.level[p] + 1
        self.leaves = [i for i, p in enumerate(pages) if p["vecs"] is not None]
        ids = [v for i in self.leaves for v in pages[i]["ids"]]
        self.ids = sorted(set(ids), key=lambda v: (v is None, v or 0))
        rank = {v: r for r, v in enumerate(self.ids)}
        self.entry, self.first, self.vecs, self.distances = {}, {}, {}, {}
        for i in self.leaves:
            p = pages[i]
            self.entry[i] = np.array([rank[v] for v in p["ids"]], np.int64)
            self.vecs[i] = np.frombuffer(p["vecs"], kind).reshape(len(p["ids"]), width).astype(self.number)
            self.distances[i] = np.frombuffer(p["distances"], np.float64)
            for at, (v, n) in enumerate(zip(p["ids"], np.frombuffer(p["copies"], np.int32))):
                if n == 0:  # of rows equal throughout, a query leaves out the first
                    self.first[v, self.vecs[i][at].tobytes()] = i, at

    def search(self, ids: list, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ranks of ids) of the k best candidates of each query, those below ``least`` (not a number: none)
        left out; and how many products were computed. Places without a candidate have rank -1."""
        low = -np.inf if self.number is np.float64 else np.iinfo(np.int64).min + 1
        q = queries.astype(self.number)
        own = [self.first.get((v, row.tobytes())) for v, row in zip(ids, q)]
        thr = np.where(np.isnan(least), -np.inf, least)
        floor = np.array([low if np.isnan(v) else int(v) for v in least], self.number)
        best, rank, computed = np.full((len(q), k), low, self.number), np.full((len(q), k), -1, np.int64), 0
        q2 = (q * q).sum(axis=1).astype(np.float64)

        def bound(distance, nodes, rows):
            total = q2[rows][:, None] + self.norm[nodes]
            gap = np.maximum(distance - self.radius[nodes], 0)
            return (total - gap * gap) / 2 + 1e-9 * total + 1e-6

        # levels: distances only where the parent's, and the stored one between them, do not rule a node out
        upper = np.full((len(q), len(self.parent)), -np.inf)
        far = np.full(upper.shape, np.inf)
        every = np.arange(len(q))
        for level in range(self.level.max() + 1):
            nodes = np.flatnonzero(self.level == level)
            if level:
                to_parent = far[:, self.parent[nodes]]
                known = np.isfinite(to_parent)
                possible = known & (bound(np.abs(np.where(known, to_parent, 0) - self.away[nodes]), nodes, every) >= thr[:, None])
            else:
                possible = np.ones((len(q), len(nodes)), bool)
            some, rows = np.flatnonzero(possible.any(axis=0)), np.flatnonzero(possible.any(axis=1))
            if not len(some):
                break
            nodes, possible = nodes[some], possible[np.ix_(rows, some)]
            c = self.centre[nodes]
            d2 = q2[rows][:, None] + (c * c).sum(axis=1).astype(np.float64) - 2.0 * (q[rows] @ c.T).astype(np.float64)
            d = np.sqrt(np.maximum(d2, 0))
            computed += int(possible.sum())
            b = np.where(possible, bound(d, nodes, rows), -np.inf)
            keep = b >= thr[rows][:, None]
            upper[np.ix_(rows, nodes)] = np.where(keep, b, -np.inf)
            far[np.ix_(rows, nodes)] = np.where(keep, d, np.inf)

        # leaves, each query's in order of its bounds, in steps that double
        leaves = np.array(self.leaves)
        order = np.argsort(-upper[:, leaves], axis=1, kind="stable")
        sorted_bound = np.take_along_axis(upper[:, leaves], order, axis=1)
        done, step = 0, 1
        while done < len(leaves):
            now = slice(done, min(len(leaves), done + step))
            wanted = (sorted_bound[:, now] >= thr[:, None]) & (sorted_bound[:, now] > -np.inf)
            if not wanted.any():
                break
            r, c = np.nonzero(wanted)
            leaf = leaves[order[r, now.start + c]]
            by = np.argsort(leaf, kind="stable")
            for rows in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                i, rows = int(leaf[rows[0]]), r[rows]
                d = far[rows, i]
                reach = np.sqrt(np.maximum(q2[rows] + self.norm[i] - 2 * thr[rows], 0)) * (1 + 1e-9) + 1e-3
                a, z = np.searchsorted(self.distances[i], [(d - reach).min(), (d + reach).max()], side="left")
                if z <= a:
                    continue
                s = q[rows] @ self.vecs[i][a:z].T
                computed += s.size
                for n, row in enumerate(rows):
                    if own[row] and own[row][0] == i and a <= own[row][1] < z:
                        s[n, own[row][1] - a] = low
                limit = np.maximum(floor[rows], best[rows, -1])
                hit = np.flatnonzero(((s >= limit[:, None]) & (s > low)).any(axis=1))
                if not len(hit):
                    continue
                rows, s = rows[hit], s[hit]
                s = np.where(s >= floor[rows][:, None], s, low)
                scores = np.concatenate([best[rows], s], axis=1)
                names = np.concatenate([rank[rows], np.broadcast_to(self.entry[i][a:z], s.shape)], axis=1)
                names = np.where(scores > low, names, -1)
                top = np.lexsort((names, -scores), axis=1)[:, :k]
                best[rows], rank[rows] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(names, top, axis=1)
                thr[rows] = np.maximum(thr[rows], np.where(rank[rows, -1] >= 0, best[rows, -1].astype(np.float64), -np.inf))
            done, step = now.stop, 2 * step
        return best, rank, computed


def _packed(points: DataFrame, most: int, routes: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(vec_id, pivot, away, norm, vec): the nearest routing object, the distance
    to it, the squared norm, and the vector as bytes. Lengths without a
    routing object have one of their own, zero, numbered -1 - length."""
    kind = _type(most)

    def run(batches):
        for batch in batches:
            size = batch.column(1).value_lengths().to_numpy()
            flat, begin = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)))
            pivot, away, norm, vecs = np.empty(len(size), np.int32), np.empty(len(size)), np.empty(len(size)), [b""] * len(size)
            for width in np.unique(size).tolist():
                at = np.flatnonzero(size == width)
                x = flat[(begin[at][:, None] + np.arange(width))].reshape(len(at), width)
                number = _exact(width, most)
                y = x.astype(number)
                numbers, r = routes.get(width, (np.array([-1 - width]), np.zeros((1, width), np.int64)))
                r = r.astype(number)
                own = (y * y).sum(axis=1)
                d2 = own[:, None] - 2 * (y @ r.T) + (r * r).sum(axis=1)
                best = d2.argmin(axis=1)
                pivot[at], norm[at] = numbers[best], own
                away[at] = np.sqrt(np.maximum(d2[np.arange(len(at)), best], 0).astype(np.float64))
                raw = x.astype(kind)
                for i, row in zip(at.tolist(), raw):
                    vecs[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pivot), pa.array(away), pa.array(norm), pa.array(vecs, pa.binary())],
                                             names=["vec_id", "pivot", "away", "norm", "vec"])

    return points.mapInArrow(run, "vec_id long, pivot int, away double, norm double, vec binary")


def pages(placed: DataFrame, kind: str) -> DataFrame:
    """NODE rows of the tree of each (pivot, part)."""
    size = np.dtype(kind).itemsize

    def run(batches):
        key, ids, vecs = None, [], []

        def nodes():
            width = len(vecs[0]) // size
            x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), width).astype(np.int64)
            norm = (x * x).sum(axis=1)
            copies, last = np.zeros(len(ids), np.int32), None
            for i, this in enumerate(zip(ids, vecs)):
                copies[i] = copies[i - 1] + 1 if this == last else 0
                last = this
            rows, below = [], {}
            for node, parent, centre, radius, away, entries, distances in build(x):
                if entries is not None:
                    below[node] = int(norm[entries].max())
                rows.append([*key, node, parent, radius * (1 + 1e-12), away, 0.0, centre.astype(kind).tobytes(), *(
                    (None,) * 4 if entries is None else ([ids[i] for i in entries], copies[entries].tobytes(), x[entries].astype(kind).tobytes(), distances.tobytes()))])
            for r in reversed(rows):  # children come after their parents
                r[6] = float(below[r[2]])
                below[r[3]] = max(below.get(r[3], 0), below[r[2]])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

        for batch in batches:
            for pivot, part, vec, vec_id in zip(*(c.to_pylist() for c in batch.columns)):
                if (pivot, part) != key:
                    if key:
                        yield nodes()
                    key, ids, vecs = (pivot, part), [], []
                ids.append(vec_id)
                vecs.append(vec)
        if key:
            yield nodes()

    rows = placed.select("pivot", "part", "vec", "vec_id").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "vec", "vec_id")
    return rows.mapInArrow(run, NODE)


NAMES = [c.split()[0] for c in NODE.split(", ")]
TYPES = [pa.int32()] * 4 + [pa.float64()] * 3 + [pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
QUERY = "pivot int, part int, vec_id long, vec binary, least double"
FOUND = "query_id long, query binary, vec_id long, score long"


def searched(tree: DataFrame, routes: DataFrame, kind: str, k: int, lanes: int) -> DataFrame:
    """FOUND rows of the queries in ``routes`` (QUERY) in the trees they are sent to."""
    size = np.dtype(kind).itemsize
    lane = F.pmod(F.xxhash64("vec", "vec_id"), F.lit(lanes)).cast("int")
    routes = routes.withColumn("lane", lane)
    wanted = routes.select("pivot", "part", "lane").distinct()
    left = tree.join(wanted, ["pivot", "part"]).select("pivot", "part", "lane", F.lit(0).alias("kind"), *NAMES[2:], *(
        F.lit(None).cast(t).alias(c) for c, t in (("vec_id", "long"), ("vec", "binary"), ("least", "double"))))
    right = routes.select("pivot", "part", "lane", F.lit(1).alias("kind"), *(
        F.lit(None).cast(t).alias(c) for c, t in (f.split(" ", 1) for f in NODE.split(", ")[2:])), "vec_id", "vec", "least")

    def run(batches):
        key, read, tree, waiting = None, [], None, []

        def answers():
            ids, vecs, least = zip(*waiting)
            width = len(vecs[0]) // size
            q = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), width).astype(np.int64)
            scores, rank, _ = tree.search(list(ids), q, np.array([np.nan if v is None else v for v in least]), k)
            r, c = np.nonzero(rank >= 0)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in r], pa.int64()), pa.array([vecs[i] for i in r], pa.binary()),
                 pa.array([tree.ids[i] for i in rank[r, c]], pa.int64()), pa.array(scores[r, c].astype(np.int64))], names=[f.split()[0] for f in FOUND.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["pivot"], row["part"], row["lane"]) != key:
                    if waiting:
                        yield answers()
                    key, read, tree, waiting = (row["pivot"], row["part"], row["lane"]), [], None, []
                if row["kind"] == 0:
                    read.append(row)
                    continue
                if tree is None:
                    tree, read = Tree(read, kind, len(row["vec"]) // size), []
                waiting.append((row["vec_id"], row["vec"], row["least"]))
                if len(waiting) == BATCH:
                    yield answers()
                    waiting = []
        if waiting:
            yield answers()

    rows = left.unionByName(right).repartition("pivot", "part", "lane").sortWithinPartitions("pivot", "part", "lane", "kind")
    return rows.mapInArrow(run, FOUND)


def _others(queries: DataFrame, directory: list, kind: str) -> DataFrame:
    """QUERY rows for all trees but the home tree whose bound reaches a query's least score."""
    size = np.dtype(kind).itemsize
    by_width: dict[int, list] = {}
    for r in directory:
        by_width.setdefault(r[1].shape[0], []).append(r)

    def run(batches):
        for batch in batches:
            vecs, out = batch.column(1).to_pylist(), []
            home, own, least = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            width = np.array([len(v) // size for v in vecs])
            for w in np.unique(width).tolist():
                at, trees = np.flatnonzero(width == w), by_width[w]
                q = np.frombuffer(b"".join(vecs[i] for i in at), kind).reshape(len(at), w).astype(np.float64)
                c = np.array([r[1] for r in trees], np.float64).reshape(len(trees), w)
                q2 = (q * q).sum(axis=1)[:, None]
                d = np.sqrt(np.maximum(q2 + (c * c).sum(axis=1) - 2 * (q @ c.T), 0))
                total = q2 + np.array([r[3] for r in trees])
                gap = np.maximum(d - np.array([r[2] for r in trees]), 0)
                reaches = ~((total - gap * gap) / 2 + 1e-9 * total + 1e-6 < least[at][:, None])
                for t, (pivot, _, _, _, parts) in enumerate(trees):
                    rows = at[reaches[:, t]]
                    for part in range(parts):
                        go = rows[(home[rows] != pivot) | (own[rows] != part)]
                        out.append((go, np.full(len(go), pivot, np.int32), np.full(len(go), part, np.int32)))
            go, pivot, part = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32))
            for lo in range(0, len(go), 65536):
                some = pa.array(go[lo:lo + 65536])
                yield pa.RecordBatch.from_arrays([pa.array(pivot[lo:lo + 65536]), pa.array(part[lo:lo + 65536]), batch.column(0).take(some),
                                                  batch.column(1).take(some), batch.column(2).take(some)], names=["pivot", "part", "vec_id", "vec", "least"])

    return queries.select("vec_id", "vec", "least", "pivot", "part").mapInArrow(run, QUERY)


def top_products(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, k: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of
    each row whose id is divisible by ``every``."""
    points = integer_vectors(vectors, id_col, vector_col, scale, LIMIT)
    n, most = points.agg(F.count("*"), F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()
    most = max(1, most or 0)
    kind = _type(most)
    sample = points.select("x").orderBy(F.md5(F.concat_ws(",", F.col("x").cast("array<string>")))).limit(min(PIVOTS, ceil(sqrt(n) / 4))).collect() if n else []
    routes: dict[int, list] = {}
    for x in sorted({tuple(r["x"]) for r in sample}):
        routes.setdefault(len(x), []).append((sum(map(len, routes.values())), x))
    routing = {w: (np.array([i for i, _ in r], np.int32), np.array([x for _, x in r], np.int64).reshape(len(r), w)) for w, r in routes.items()}

    packed = stored(_packed(points, most, routing))
    copies = Window.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last())
    distinct = packed.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    about = packed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm"),
                                        F.max(F.octet_length("vec")).alias("bytes")).collect()
    directory = []
    known = {i: x for r in routing.values() for i, x in zip(*r)}
    for r in about:
        centre = known.get(r["pivot"], np.zeros(-1 - r["pivot"], np.int64) if r["pivot"] < 0 else None)
        directory.append((r["pivot"], centre, r["radius"] * (1 + 1e-12), r["norm"], ceil(r["n"] * (r["bytes"] + 8) / TREE_BYTES)))
    shares = F.create_map(*[F.lit(v) for r in directory for v in (r[0], r[4])]) if directory else F.create_map(F.lit(0), F.lit(1))
    part = F.pmod(F.xxhash64("vec"), shares[F.col("pivot")].cast("long")).cast("int")
    tree = stored(pages(distinct.withColumn("part", part), kind))

    asked = packed.where(F.col("vec_id") % every == 0).groupBy("vec_id", "vec").agg(F.first("pivot").alias("pivot"), F.count("*").alias("times"))
    asked = stored(asked.withColumn("part", part))
    lanes = max(1, ceil(asked.count() / LANE))
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    home = stored(searched(tree, asked.select("pivot", "part", "vec_id", "vec", F.lit(None).cast("double").alias("least")), kind, k, lanes))
    kth = home.groupBy("query_id", "query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    scored = asked.join(kth.select(F.col("query_id").alias("vec_id"), F.col("query").alias("vec"), F.col("least").cast("double").alias("least")), ["vec_id", "vec"], "left")
    rest = searched(tree, _others(scored, directory, kind), kind, k, lanes)
    ranked = home.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # rows that are equal throughout ask the same
    again = asked.where("times > 1").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), "times")
    ranked = ranked.join(again, ["query_id", "query"], "left")
    copies = F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", copies.alias("copy")).drop("copy")
