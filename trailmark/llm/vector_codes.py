"""Vector codes: every part of a vector becomes the number of its nearest codebook entry, found through a GNAT.

A node of the tree holds a few split entries. Every other entry below it belongs
to the nearest split, and the node keeps the range of distances from each split
to the entries of each subtree. By the triangle inequality the distances of a
query to the splits exclude subtrees that hold nothing as near as the best entry
so far. Distances are rounded outwards and only a strictly larger bound excludes,
so that ties survive; what remains is compared in integers, the lower number first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.vectors import finite, floor_means, matrix, squared_distances, whole
from trailmark.storage import discard, materialise

ARITY = 4


def _root_below(squares: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), -np.inf), -np.inf))


def _root_above(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf), np.inf)


@dataclass
class Node:
    """Split entries, and per split and subtree the nearest and furthest distance to its entries."""

    splits: np.ndarray
    nearest: np.ndarray
    furthest: np.ndarray
    children: list["Node"] = field(default_factory=list)


def build(entries: np.ndarray, members: Sequence[int] | None = None, arity: int = ARITY) -> Node:
    """The tree over ``entries`` (rows): splits are picked furthest first, the others go to their nearest split."""
    members = np.arange(len(entries)) if members is None else np.asarray(members)
    away = squared_distances(entries[members], entries[members])
    picked = [0]
    while len(picked) < min(arity, len(members)):
        spread = away[:, picked].min(1)
        spread[picked] = -1
        picked.append(int(spread.argmax()))
    rest = np.setdiff1d(np.arange(len(members)), picked)
    home = away[np.ix_(rest, picked)].argmin(1)
    groups = [rest[home == j] for j in range(len(picked))]
    groups = [g for g in groups if len(g)]
    near = np.array([[_root_below(away[p, g]).min() for g in groups] for p in picked]).reshape(len(picked), -1)
    far = np.array([[_root_above(away[p, g]).max() for g in groups] for p in picked]).reshape(len(picked), -1)
    return Node(members[picked], near, far, [build(entries, members[g], arity) for g in groups])


def nearest_entries(tree: Node, entries: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Entry number, squared distance, and the number of distances computed, for all queries at once."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    number = np.full(len(queries), len(entries), np.int64)
    computed = 0

    def visit(node: Node, rows: np.ndarray) -> None:
        nonlocal computed
        squares = squared_distances(queries[rows], entries[node.splits])
        computed += squares.size
        for j, entry in enumerate(node.splits):
            closer = (squares[:, j] < best[rows]) | ((squares[:, j] == best[rows]) & (entry < number[rows]))
            best[rows[closer]], number[rows[closer]] = squares[closer, j], entry
        if not node.children:
            return
        below, above = _root_below(squares), _root_above(squares)
        for j, child in enumerate(node.children):
            reach = _root_above(best[rows])
            least = np.maximum(np.nextafter(below - node.furthest[:, j], -np.inf), np.nextafter(node.nearest[:, j] - above, -np.inf)).max(1)
            left = rows[least <= reach]
            if len(left):
                visit(child, left)

    if len(queries):
        visit(tree, np.arange(len(queries)))
    return number, best, computed


def _part_sums(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """Sum and number of the parts nearest to every entry: one row per component of the codebooks from each task."""
    parts, count, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build(book) for book in books]
        totals, members = np.zeros(books.shape, np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            data = matrix(batch.column("v"), parts * width)
            for p in range(parts):
                mine = data[:, p * width : (p + 1) * width]
                number, _, _ = nearest_entries(trees[p], books[p], mine)
                np.add.at(totals[p], number, mine)
                members[p] += np.bincount(number, minlength=count)
        part, entry, place = (a.ravel().astype(np.int32) for a in np.indices(books.shape))
        arrays = [part, entry, place, totals.ravel(), np.repeat(members.ravel(), width)]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["part", "entry", "place", "total", "members"])

    return stored.select("v").mapInArrow(run, "part int, entry int, place int, total long, members long")


def _coded(stored: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code and error of every vector."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build(book) for book in books]
        for batch in batches:
            data = matrix(batch.column("v"), parts * width)
            found = [nearest_entries(trees[p], books[p], data[:, p * width : (p + 1) * width]) for p in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = np.sum([f[1] for f in found], axis=0, dtype=np.int64)
            arrays = [batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "label", "code", "error"])

    kinds = [T.StructField(n, stored.schema[n].dataType) for n in ("id", "label")]
    return stored.select("id", "label", "v").mapInArrow(run, T.StructType([*kinds, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def usual_length(vectors: DataFrame, vector_col: str, parts: int) -> int:
    """The most frequent length that ``parts`` divide, of two the larger; 0 without such a vector."""
    length = F.size(vector_col)
    seen = vectors.filter(finite(F.col(vector_col)) & (length > 0) & (length % parts == 0)).groupBy(length.alias("n")).count()
    row = seen.orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 0


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096,
) -> DataFrame:
    """Product codes of all vectors, with codebooks moved ``rounds`` times over all of them.

    Null vectors and those with null or non-finite components are left out, and
    so are vectors of another length than the most frequent one that ``parts``
    divide. Components become floor(scale * x), held within 2^26 of zero. The
    codebooks start at the smallest ids (null last, equal ids in the order of
    their components); fewer vectors than ``entries`` make fewer entries. Repeated
    rows are separate vectors; an empty table gives an empty result; other
    columns are ignored.

    Returns vec_id, code (two hex digits per part), error, label_error (errors
    summed over equal labels, nulls together) and codebooks_sha256. Every round is
    one pass over the stored vectors; the driver holds the codebooks and one sum
    per component. Sums per label are combined before their shuffle and joined back
    by broadcast only if Spark finds their stored table small.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code has two hex digits: 1 to 256 entries, and at least one part")
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    dims = usual_length(vectors, vector_col, parts)
    rows = vectors.filter(finite(vector) & (F.size(vector) == dims) & (F.lit(dims) > 0))
    stored = materialise(rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole(vector, scale).alias("v")), "vectors")
    first = stored.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    if not first:
        kinds = [T.StructField("vec_id", stored.schema["id"].dataType), T.StructField("code", T.StringType())]
        return spark.createDataFrame([], T.StructType([*kinds, T.StructField("error", T.LongType()), T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())]))
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = floor_means(_part_sums(stored, books), ["part", "entry", "place"], books)
    coded = materialise(_coded(stored, books), "codes")
    discard(stored)
    labels = materialise(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "labels")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = coded.alias("c").join(labels.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return joined.select(F.col("c.id").alias("vec_id"), "c.code", "c.error", "l.label_error", F.lit(digest).alias("codebooks_sha256"))
