"""Block matrix work: dense blocks as table rows, and top-K of a product formed block by block.

Blocks are stored as the bytes of a row-major float64 array, so each one is a
single binary cell. What a task holds is stated at each function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
USERS_PER_SHARD = 20_000


def to_bytes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array, dtype=np.float64).tobytes()


def from_bytes(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(-1, columns)


def each_row(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Row by row: a result is passed on before the next is made, so that a task holds one, not those of its batch."""
    return (row for batch in batches for row in batch.itertuples())


def dense_blocks(entries: DataFrame, n: int, block: int, diagonal: float = 0.0) -> DataFrame:
    """Blocks (bi, bj, data) of an n x n matrix from entries (i, j, w); ``diagonal`` is added on the diagonal.

    The last blocks are padded with an identity, which leaves an inverse of the
    rest unchanged. A block gathers at most ``block`` squared entries.
    """
    spark = entries.sparkSession
    count = -(-n // block)
    every = spark.range(count * count).select(
        (F.col("id") / count).cast("long").alias("bi"), (F.col("id") % count).alias("bj"),
        F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(0.0).alias("w"),
    )
    placed = entries.select(
        (F.col("i") / block).cast("long").alias("bi"), (F.col("j") / block).cast("long").alias("bj"),
        F.col("i").cast("long"), F.col("j").cast("long"), F.col("w").cast("double"),
    ).unionByName(every)

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(key[0]), int(key[1])
        matrix = np.zeros((block, block))
        real = rows[rows["i"] >= 0]
        np.add.at(matrix, (real["i"].to_numpy() - bi * block, real["j"].to_numpy() - bj * block), real["w"].to_numpy())
        if bi == bj:
            used = min(block, n - bi * block)
            spots = np.arange(block)
            matrix[spots, spots] += np.where(spots < used, diagonal, 1.0)
        return pd.DataFrame({"bi": [bi], "bj": [bj], "data": [to_bytes(matrix)]})

    return placed.groupBy("bi", "bj").applyInPandas(fill, "bi long, bj long, data binary")


def map_blocks(frame: DataFrame, combine: Callable[[pd.Series], bytes]) -> DataFrame:
    """Replace each row's blocks by one result block; rows stay where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [combine(row) for _, row in batch.iterrows()]
            yield pd.DataFrame({"bi": batch["bi"], "bj": batch["bj"], "data": data})

    return frame.mapInPandas(run, "bi long, bj long, data binary")


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` largest finite scores per row, ties to the smaller column."""
    if scores.shape[1] > k:
        limit = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        mask = (scores >= limit[:, None]) & np.isfinite(scores)
    else:
        mask = np.isfinite(scores)
    rows, columns = np.nonzero(mask)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    starts = np.searchsorted(rows, np.arange(scores.shape[0]))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], columns[keep]


def blocked_top_k(
    left: DataFrame, right: DataFrame, product: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, int], np.ndarray],
    blocks: int, block: int, n: int, k: int, shards: int,
) -> DataFrame:
    """Top ``k`` unseen columns per user of a user-by-item product.

    ``left`` has rows (user, i, ...) with ``i`` = -1 or an item number; rows
    flagged ``seen`` = 1 name items to leave out. ``right`` has (bj, ...) rows of
    each column block, such as the factors of its items. A task holds one user
    shard and all rows of one column block and returns k candidates per user;
    the caller merges them.
    """
    shard = F.pmod(F.xxhash64("user"), F.lit(shards))
    column_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("bj")
    shard_list = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    users = left.withColumn("shard", shard).select("*", column_blocks).groupBy("shard", "bj")
    items = right.select("*", shard_list).groupBy("shard", "bj")

    def score(key: tuple, own: pd.DataFrame, panel: pd.DataFrame) -> pd.DataFrame:
        if own.empty or panel.empty:
            return pd.DataFrame({"user": np.empty(0, object), "item": np.empty(0, np.int64), "score": np.empty(0)})
        first = int(key[1]) * block
        names, number = np.unique(own["user"].to_numpy(dtype=object).astype(str), return_inverse=True)
        scores = product(own, panel, number, len(names))[:, : max(0, min(block, n - first))].copy()
        items_of = own["i"].to_numpy()
        inside = (own["seen"].to_numpy() == 1) & (items_of >= first) & (items_of < first + scores.shape[1])
        scores[number[inside], items_of[inside] - first] = -np.inf
        rows, columns = best_of(scores, k)
        return pd.DataFrame({"user": names[rows].astype(object), "item": columns + first, "score": scores[rows, columns]})

    return users.cogroup(items).applyInPandas(score, "user string, item long, score double")


def multiply_rows(starts: np.ndarray, columns: np.ndarray, entries: np.ndarray, dense: np.ndarray, slab: int = 1 << 22) -> np.ndarray:
    """Compressed rows times a dense matrix; at most about ``slab`` numbers are gathered at once."""
    result = np.zeros((len(starts) - 1, dense.shape[1]))
    filled = np.flatnonzero(np.diff(starts))
    if len(entries) * 8 > result.shape[0] * dense.shape[0]:  # an eighth filled: cheaper as a dense product
        whole = np.zeros((len(starts) - 1, dense.shape[0]))
        whole[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), columns] = entries
        return whole @ dense
    while len(filled):
        first = starts[filled[0]]
        some = filled[: max(1, int(np.searchsorted(starts[filled + 1] - first, slab // dense.shape[1], "right")))]
        last = starts[some[-1] + 1]
        gathered = entries[first:last, None] * dense[columns[first:last]]
        result[some] = np.add.reduceat(gathered, starts[some] - first, axis=0)
        filled = filled[len(some) :]
    return result


def fold_scores(
    batches: Iterator[pa.RecordBatch], width: int, rows: int, n: int, k: int, watch: Callable[[int], None] | None = None
) -> Iterator[pa.RecordBatch]:
    """Best ``k`` unseen items per user of X W, for rows sorted by (shard, bj, bi, kind).

    Of each (shard, column block) the rows come by row block: first the users'
    items in it (number of the user in the shard, i), then the weights of that block,
    ``rows`` x ``width``. Block -1 holds one row of weights that all users get.
    Only the sums of the shard's users for one column block, the items of one
    row block and one batch are held, however many items there are. ``watch``
    gets the bytes held after each weight block.
    """
    at, sums, used, extra, mine, users, items = None, np.zeros((0, width)), 0, 0.0, [], [], []

    def flush() -> pa.RecordBatch:
        shard, bj = at
        first = bj * width
        scores = (sums[:used] + extra)[:, : max(0, min(width, n - first))]
        for number, i in mine:
            scores[number, i - first] = -np.inf
        user, column = best_of(scores, k)
        arrays = [pa.array(np.full(len(user), shard)), pa.array(user.astype(np.int64)), pa.array((column + first).astype(np.int64)), pa.array(scores[user, column])]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "number", "item", "score"])

    for batch in batches:
        shards, columns, kinds = (batch.column(c).to_numpy() for c in ("shard", "bj", "kind"))
        numbers, entries = batch.column("number").to_numpy(zero_copy_only=False), batch.column("i").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(columns) != 0) | (np.diff(kinds) != 0) | (kinds[1:] == 1)) + 1).tolist(), len(shards)] if len(shards) else [0]
        for start, stop in zip(cuts, cuts[1:]):
            if at != (shards[start], columns[start]):
                if at is not None:
                    yield flush()
                at, used, extra, mine, users, items = (int(shards[start]), int(columns[start])), 0, 0.0, [], [], []
                sums[:] = 0.0
            if kinds[start] == 0:
                number, i = numbers[start:stop].astype(np.int64), entries[start:stop].astype(np.int64)
                users.append(number)
                items.append(i)
                if number.max() >= len(sums):
                    sums = np.concatenate([sums, np.zeros((max(int(number.max()) + 1 - len(sums), len(sums)), width))])
                used = max(used, int(number.max()) + 1)
                inside = (i >= at[1] * width) & (i < (at[1] + 1) * width)
                if inside.any():
                    mine.append((number[inside], i[inside]))
                continue
            bi, weights = int(batch.column("bi")[start].as_py()), from_bytes(batch.column("data")[start].as_py(), width)
            if bi < 0:
                extra = weights[0]
            elif users:
                number, i = np.concatenate(users), np.concatenate(items) - bi * rows
                order = np.argsort(number, kind="stable")
                number, i = number[order], i[order]
                head = np.flatnonzero(np.diff(number, prepend=-1))
                sums[number[head]] += multiply_rows(np.append(head, len(number)), i, np.ones(len(i)), weights)
            if watch:
                watch(sums.nbytes + weights.nbytes + sum(u.nbytes for u in users) * 2)
            users, items = [], []
    if at is not None:
        yield flush()


def folded_top_k(left: DataFrame, right: DataFrame, shards: int, columns: range, width: int, rows: int, n: int, k: int) -> DataFrame:
    """Top ``k`` unseen items (shard, number, item, score) per user of a sparse user matrix times block weights.

    ``left`` has rows (shard, number, i): an item of the user of that number in
    the shard. ``right`` has the blocks (bi, bj, data) of the column blocks
    ``columns``, of ``rows`` x ``width``. Users go to every column block and blocks
    to every shard; a task takes them in order of the row block and adds up, so
    that its memory does not depend on the number of items.
    """
    every = lambda numbers, name: F.explode(F.sequence(F.lit(numbers[0]).cast("long"), F.lit(numbers[-1]).cast("long"))).alias(name)
    nothing = F.lit(0).cast("long")
    entries = left.select("shard", every(columns, "bj"), (F.col("i") / rows).cast("long").alias("bi"), F.lit(0).alias("kind"), "number", "i", F.lit(None).cast("binary").alias("data"))
    weights = right.select(every(range(shards), "shard"), "bj", "bi", F.lit(1).alias("kind"), nothing.alias("number"), nothing.alias("i"), "data")
    ordered = entries.unionByName(weights).repartition("shard", "bj").sortWithinPartitions("shard", "bj", "bi", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold_scores(batches, width, rows, n, k)

    return ordered.mapInArrow(run, "shard long, number long, item long, score double")
