"""Centroid clustering over zone maps: vectors in Hilbert order are cut into blocks with min/max boxes.

The distance of a centroid to a box bounds its distance to every vector inside
from both sides. A centroid whose lower bound exceeds the smallest upper bound
cannot be nearest to any of them, so a block compares its vectors with the
remaining candidates only, exactly and in integers; a block with one candidate
joins it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.vectors import finite, floor_means, matrix, squared_distances, whole
from trailmark.storage import discard, materialise

BLOCK = 256
BITS = 2  # bits of each component in the curve; with 64 components that is 2^128 cells


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of components below 2^bits) on the Hilbert curve, as rows of big-endian bytes.

    The transform of Skilling (2004), one step for all rows at once: undo the
    rotations from the highest bit down, Gray-code the axes, interleave the bits.
    """
    axes = cells.T.astype(np.int64).copy()
    dims = len(axes)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(dims):
            flip = (axes[i] & step) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(flip, low, swap)
            if i:
                axes[i] ^= swap
        step >>= 1
    for i in range(1, dims):
        axes[i] ^= axes[i - 1]
    last = np.zeros(axes.shape[1], np.int64)
    step = 1 << (bits - 1)
    while step > 1:
        last ^= np.where((axes[-1] & step) != 0, step - 1, 0)
        step >>= 1
    axes ^= last
    planes = [(axes >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)


def candidates(low: np.ndarray, high: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Numbers of the points that may be nearest to a vector of the box, ascending; ties are kept."""
    outside = np.maximum(low - points, 0) + np.maximum(points - high, 0)
    across = np.maximum(np.abs(points - low), np.abs(points - high))
    return np.flatnonzero((outside**2).sum(1) <= (across**2).sum(1).min())


def _zone_blocks(rows: DataFrame, dims: int, block: int) -> DataFrame:
    """One row per block: ids, vectors, box and sum; rows (id, v) in Hilbert order, equal vectors dealt by a hash."""
    v = F.col("v")
    ends = rows.agg(*(f(v[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    if ends["lo0"] is None:
        low, high = np.zeros(dims, np.int64), np.ones(dims, np.int64)
    else:
        low, high = (np.array([ends[f"{n}{i}"] for i in range(dims)], np.int64) for n in ("lo", "hi"))
    widest = np.argsort(low - high, kind="stable")  # the curve turns on its first axes first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = matrix(batch.column("v"), dims)
            cells = (data - low) * (1 << BITS) // (high - low + 1)
            keys = hilbert_keys(cells[:, widest], BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=["id", "v", "salt", "curve"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            data = matrix(batch.column("v"), dims)
            cuts = list(range(0, len(data), block))
            ids = pa.ListArray.from_arrays(pa.array([*cuts, len(data)], pa.int32()), batch.column("id"))
            cells = [data[c : c + block] for c in cuts]
            pieces = [[c.astype(np.int32).tobytes() for c in cells]]
            pieces += [[f(c).tobytes() for c in cells] for f in (lambda c: c.min(0), lambda c: c.max(0), lambda c: c.sum(0))]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(p, pa.binary()) for p in pieces)], names=["ids", "data", "low", "high", "total"])

    kind = rows.schema["id"].dataType
    plain = T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.LongType())), T.StructField("salt", T.LongType()), T.StructField("curve", T.BinaryType())])
    packed = T.StructType([T.StructField("ids", T.ArrayType(kind)), *(T.StructField(n, T.BinaryType()) for n in ("data", "low", "high", "total"))])
    salted = rows.select("id", "v", F.xxhash64("id", F.monotonically_increasing_id()).alias("salt"))
    ordered = salted.mapInArrow(place, plain).repartitionByRange("curve", "salt").sortWithinPartitions("curve", "salt")
    return ordered.mapInArrow(pack, packed)


def _boxes(batch: pa.RecordBatch, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, vectors, sum and candidates of every block of a batch."""
    dims = points.shape[1]
    for i in range(batch.num_rows):
        data, low, high, total = (batch.column(n)[i].as_py() for n in ("data", "low", "high", "total"))
        near = candidates(np.frombuffer(low, np.int64), np.frombuffer(high, np.int64), points)
        yield i, np.frombuffer(data, np.int32).reshape(-1, dims).astype(np.int64), np.frombuffer(total, np.int64), near


def _member_sums(blocks: DataFrame, points: np.ndarray) -> DataFrame:
    """Sum and number of the vectors nearest to each point: one row per point and component from each task."""
    count, dims = points.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, members = np.zeros((count, dims), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            for _, data, total, near in _boxes(batch, points):
                if len(near) == 1:
                    totals[near[0]] += total
                    members[near[0]] += len(data)
                    continue
                nearest = squared_distances(data, points[near]).argmin(1)
                for place in np.unique(nearest):
                    mine = data[nearest == place]
                    totals[near[place]] += mine.sum(0)
                    members[near[place]] += len(mine)
        number, dim = (a.ravel() for a in np.indices((count, dims)))
        arrays = [number.astype(np.int32), dim.astype(np.int32), totals.ravel(), np.repeat(members, dims)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["number", "dim", "total", "members"])

    return blocks.select("data", "low", "high", "total").mapInArrow(run, "number int, dim int, total long, members long")


def _assigned(blocks: DataFrame, points: np.ndarray) -> DataFrame:
    """id, cluster and distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, _, near in _boxes(batch, points):
                away = squared_distances(data, points[near])
                nearest = away.argmin(1)
                arrays = [pa.array(near[nearest].astype(np.int32)), pa.array(away[np.arange(len(data)), nearest])]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, *arrays], names=["id", "cluster", "distance"])

    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return blocks.mapInArrow(run, schema)


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64,
    centroids: int = 16, rounds: int = 3, block: int = BLOCK,
) -> DataFrame:
    """Lloyd rounds in integers: nearest centroid of every vector after ``rounds`` moves of the centroids.

    Vectors of another length than ``dims``, null ones and those with a null or
    non-finite component are left out. Components become floor(scale * x), held
    within 2^26 of zero. The first centroids are the vectors with the smallest
    sha256 of ``1:<id>``, a null id counting as empty, equal ids in the order
    of their components; fewer vectors than ``centroids`` make fewer
    centroids. Ties go to the smaller number. Repeated rows are separate
    vectors; an empty table gives an empty result; other columns are ignored.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256. The vectors are sorted along the curve once, every round is
    one pass over the stored blocks without a shuffle of vectors, and the driver
    holds the centroids and one sum per centroid and component.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    kept = vectors.filter(finite(vector) & (F.size(vector) == dims)).select(F.col(id_col).alias("id"), whole(vector, scale).alias("v"))
    first = kept.select("v", F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("sha"))
    points = np.array([r["v"] for r in first.orderBy("sha", "v").limit(centroids).collect()], np.int64).reshape(-1, dims)
    blocks = materialise(_zone_blocks(kept, dims, block), "zones")
    for _ in range(rounds if len(points) else 0):
        points = floor_means(_member_sums(blocks, points), ["number", "dim"], points)
    told = materialise(_assigned(blocks, points), "assigned")
    discard(blocks)
    digests = [(i, hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest()) for i, p in enumerate(points)]
    inertia = {r["cluster"]: r["inertia"] for r in told.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()}
    known = [v for v in inertia.values() if v is not None]
    total = sum(known) if len(known) == len(inertia) and sum(known) < 1 << 63 else None
    # one row per centroid
    facts = spark.createDataFrame([(i, inertia.get(i), total, d) for i, d in digests], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = told.join(F.broadcast(facts), "cluster")
    return joined.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
