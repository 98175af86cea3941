"""Centroid clustering (k-means rounds) over space-filling-curve zone maps.

Vectors become integers floor(scale * x). They are sorted along a Hilbert curve
through the leading axes of a bounded sample and cut into blocks of consecutive
vectors, each stored with its zone map: the smallest and largest value of every
component. A round decides for a whole block which centroids can be nearest to
anything inside its box:

* the least distance of a centroid to the box is no more than the smallest of
  all largest distances (box distance bounds), and
* the centroid nearest to the middle of the box is not nearer at every corner
  (the box doesn't lie on one side of the plane between the two).

The vectors of a block are compared with its candidate centroids only, exactly in
integers. Tasks add up their vectors for each centroid before anything is
shuffled; the centroids (k rows) are all that reaches the driver.

Which vectors are kept: exactly ``width`` components, none null or non-finite;
others (null and empty ones included) give no row. Rows with the same id are
vectors of their own, and equal vectors count each time. A null id takes part
but starts no centroid; equal ids start in order of their components. Fewer vectors
with ids than k give as many centroids, and none at all (or an empty table) an empty
result. Ties go to the smaller number. A component of 2^17 or more in size (at scale
256) is refused with an error, as its distances leave the range of long. Only the two
named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stored
from vellum.llm.lattice import integer_vectors

WIDTH, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of a block, and of the sample that the curve's axes are fitted on.
BLOCK, SAMPLE = 256, 4096
#: The curve runs through AXES axes with BITS bits each.
AXES, BITS = 8, 7
LIMIT = 1 << 25


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of unsigned integers below 2^bits along the Hilbert
    curve (Skilling's transposed form, for all rows at once)."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(n):
            flip = (x[i] & np.uint64(q)) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    tail = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        tail = np.where((x[n - 1] & np.uint64(q)) != 0, tail ^ np.uint64(q - 1), tail)
        q >>= 1
    x ^= tail
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << np.uint64(1) | (x[i] >> np.uint64(b)) & np.uint64(1)
    return out


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Curve:
    """Axes and grid of the Hilbert curve, from a sample."""

    def __init__(self, sample: np.ndarray):
        self.centre = sample.mean(axis=0)
        spread = np.linalg.eigh(np.cov((sample - self.centre).T.reshape(sample.shape[1], -1), bias=True).reshape(sample.shape[1], -1))
        self.axes = spread[1][:, ::-1][:, :AXES]
        seen = (sample - self.centre) @ self.axes
        self.low, self.high = seen.min(axis=0), seen.max(axis=0)

    def key(self, x: np.ndarray) -> np.ndarray:
        at = ((x - self.centre) @ self.axes - self.low) / np.maximum(self.high - self.low, 1e-9)
        cell = np.clip(at * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert(cell.astype(np.uint64), BITS).astype(np.int64)


BLOCKS = "ids array<long>, n int, low binary, high binary, x binary"


def zone_maps(points: DataFrame, width: int) -> DataFrame:
    """BLOCKS rows: runs of at most BLOCK vectors in Hilbert order with their boxes."""
    picked = points.orderBy(F.md5(F.concat_ws(",", F.col("x").cast("array<string>"))), "vec_id").limit(SAMPLE).collect()
    curve = Curve(np.array([r["x"] for r in picked], np.float64).reshape(-1, width)) if picked else None

    def keys(batches):
        for batch in batches:
            x = _rows(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([pa.array(curve.key(x)), *batch.columns], names=["place", "vec_id", "x"])

    def cut(batches):
        ids, xs, n = [], [], 0

        def block(take):
            nonlocal ids, xs, n
            i, x = [v for part in ids for v in part], np.concatenate(xs)
            here, rest = x[:take], x[take:]
            kind = "<i2" if np.abs(here).max() < 1 << 15 else "<i4"
            row = (i[:take], take, here.min(axis=0).astype(np.int64).tobytes(), here.max(axis=0).astype(np.int64).tobytes(), here.astype(kind).tobytes())
            ids, xs, n = ([i[take:]], [rest], len(rest)) if len(rest) else ([], [], 0)
            return row

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.int32()),
                                               *(pa.array([r[c] for r in rows], pa.binary()) for c in (2, 3, 4))], names=["ids", "n", "low", "high", "x"])

        for batch in batches:
            done = []
            x = _rows(batch.column(1), width)
            for lo in range(0, len(x), BLOCK):
                ids.append(batch.column(0).slice(lo, BLOCK).to_pylist())
                xs.append(x[lo:lo + BLOCK])
                n += len(xs[-1])
                while n >= BLOCK:
                    done.append(block(BLOCK))
            if done:
                yield table(done)
        if n:
            yield table([block(n)])

    if curve is None:
        return points.sparkSession.createDataFrame([], BLOCKS)
    placed = points.mapInArrow(keys, "place long, vec_id long, x array<long>")
    # the id parts vectors of one place, so that no range needs to hold a crowded one
    ranged = placed.withColumn("salt", F.xxhash64("vec_id")).repartitionByRange("place", "salt").sortWithinPartitions("place", "salt")
    return ranged.select("vec_id", "x").mapInArrow(cut, BLOCKS)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest (ties: smallest number) to a
    point of the box; all arithmetic in integers."""
    near = np.clip(centroids, low, high) - centroids
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    left = np.flatnonzero((near * near).sum(axis=1) <= (far * far).sum(axis=1).min())
    if len(left) < 2:
        return left
    c = centroids[left]
    middle = 2 * c - (low + high)
    j = (middle * middle).sum(axis=1).argmin()  # the one nearest to the middle of the box
    d, norm = c - c[j], (c * c).sum(axis=1)
    # c_j is nearer than c_i at every corner where 2 x d_i < |c_i|^2 - |c_j|^2 for all x of the box
    keep = 2 * (np.where(d > 0, high, low) * d).sum(axis=1) >= norm - norm[j]
    return left[keep]


def assign(row_x: bytes, n: int, low: bytes, high: bytes, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(vectors, nearest centroids, squared distances, candidates) of a block."""
    width = centroids.shape[1]
    x = np.frombuffer(row_x, f"<i{len(row_x) // (n * width)}").reshape(n, width)
    some = candidates(np.frombuffer(low, np.int64), np.frombuffer(high, np.int64), centroids)
    c = centroids[some]
    most = max(int(np.abs(c).max()), int(np.abs(x).max()), 1)
    kind = np.float64 if 4 * width * most * most < 1 << 53 else np.int64  # both exact
    a, b = x.astype(kind), c.astype(kind)
    d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    best = d.argmin(axis=1)
    return x, some[best], d[np.arange(n), best].astype(np.int64), len(some)


def sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of each centroid's vectors: k * width numbers at most."""
    k, width = centroids.shape

    def run(batches):
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for n, low, high, raw in zip(*(c.to_pylist() for c in batch.columns)):
                x, own, _, _ = assign(raw, n, low, high, centroids)
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.diff(own[order], prepend=-1))
                total[own[order][first]] += np.add.reduceat(x[order].astype(np.int64), first)
                count += np.bincount(own, minlength=k)
        full = np.flatnonzero(count)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(count[full]), pa.array(total[full].tolist(), pa.list_(pa.int64()))],
                                             names=["cluster", "n", "total"])

    parts = blocks.select("n", "low", "high", "x").mapInArrow(run, "cluster long, n long, total array<long>")
    each = parts.select("cluster", "n", F.posexplode("total").alias("i", "s")).groupBy("cluster", "i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(19,0)")).alias("s"))
    out: dict = {}
    for r in each.orderBy("cluster", "i").collect():
        out.setdefault(r["cluster"], (int(r["n"]), []))[1].append(int(r["s"]))
    return out


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, scale: int = SCALE,
             k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and
    compared: the centroids that the vector's block was compared with."""
    points = integer_vectors(vectors, id_col, vector_col, scale, LIMIT).where(F.size("x") == width)
    blocks = stored(zone_maps(points, width))
    first = points.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "x").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, compared int"
    if not first:
        nothing = points.sparkSession.createDataFrame([], schema)
        return nothing.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"),
                              F.lit("").alias("centroid_sha256"), "compared")
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, total) in sums(blocks, centroids).items():
            moved[c] = [s // n for s in total]
        centroids = moved

    def run(batches):
        for batch in batches:
            ids, own, distance, compared = [], [], [], []
            for i, n, low, high, raw in zip(*(c.to_pylist() for c in batch.columns)):
                _, o, d, m = assign(raw, n, low, high, centroids)
                ids += i
                own.append(o)
                distance.append(d)
                compared.append(np.full(n, m))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(own), pa.int32()), pa.array(np.concatenate(distance)),
                                                  pa.array(np.concatenate(compared), pa.int32())], names=["vec_id", "cluster", "distance", "compared"])

    nearest = stored(blocks.mapInArrow(run, schema))
    inertia = {r["cluster"]: int(r["s"]) for r in nearest.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    about = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c in range(len(centroids))]
    about = points.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return nearest.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
