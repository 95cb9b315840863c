"""Embeddings trained on the pairwise ranking loss, by descent over strata of user and item blocks.

Users and items are dealt into the same number of blocks. In stratum s user
block b meets item block b + s, so that the cells of a stratum share neither users
nor items: all its tasks move their factors at the same time without touching
those of another. A pass over all strata visits every interaction once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.models.blocked import from_bytes, to_bytes
from trailmark.models.common import ITEM, USER, pairs_of
from trailmark.models.latent import LatentModel
from trailmark.operators.encoding import encode_ids
from trailmark.storage import discard, materialise

BLOCK_ROWS = 65_536  # users or items of a block
CELL_PAIRS = 4_000_000  # interactions of a cell, on average
BATCH = 2_048
REDRAWS = 32
FACTORS = "side string, block long, factors binary, squares binary"


def unseen_draws(of_user: np.ndarray, of_item: np.ndarray, users: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """For each of ``users`` an item below ``count`` that the sorted pairs do not have, -1 if none turned up in REDRAWS draws."""
    known, base = of_user.astype(np.int64) * count + of_item, users.astype(np.int64) * count
    seen = lambda code: known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code
    drawn = rng.integers(0, count, len(users))
    for _ in range(REDRAWS):
        again = np.flatnonzero(seen(base + drawn))
        if not len(again):
            return drawn
        drawn[again] = rng.integers(0, count, len(again))
    return np.where(seen(base + drawn), -1, drawn)


def climb(target: np.ndarray, squares: np.ndarray, rows: np.ndarray, slopes: np.ndarray, rate: float) -> None:
    """Add the slopes of each row, scaled by the squares of all its sums so far, in place."""
    by_row = np.argsort(rows, kind="stable")
    unique, starts = np.unique(rows[by_row], return_index=True)
    total = np.add.reduceat(slopes[by_row], starts)
    squares[unique] += total**2
    target[unique] += rate * total / np.sqrt(squares[unique] + 1e-8)


def descend(
    users: np.ndarray, user_squares: np.ndarray, items: np.ndarray, item_squares: np.ndarray, pairs: tuple[np.ndarray, np.ndarray],
    rng: np.random.Generator, rate: float, decay: float,
) -> None:
    """One visit of a cell: every interaction against an item of the block that its user has not seen, in place.

    ``pairs`` (user rows, item rows) is sorted. The last user column is 1 and
    stays, which makes the last item column a bias. Steps are scaled by the
    squares so far (adaptive gradients). An interaction whose user has seen nearly all
    of the block may find no such item in its redraws and is passed over in this visit.
    """
    of_user, of_item = pairs
    other = unseen_draws(of_user, of_item, of_user, len(items), rng)
    order = rng.permutation(len(of_user))
    order = order[other[order] >= 0]

    for start in range(0, len(order), BATCH):
        some = order[start : start + BATCH]
        u, i, j = of_user[some], of_item[some], other[some]
        own, difference = users[u], items[i] - items[j]
        pull = (1 / (1 + np.exp((own * difference).sum(1))))[:, None]
        toward = pull * difference - decay * own
        toward[:, -1] = 0.0
        slopes = np.concatenate([pull * own - decay * items[i], -pull * own - decay * items[j]])
        climb(users, user_squares, u, toward, rate)
        climb(items, item_squares, np.concatenate([i, j]), slopes, rate)


def block_count(sizes: dict[str, int], pairs: int) -> int:
    """Blocks a side so that neither a block nor an average cell is large."""
    return max(1, math.ceil(max(sizes.values()) / BLOCK_ROWS), math.ceil(math.sqrt(pairs / CELL_PAIRS)))


def cells_of(pairs: DataFrame, blocks: int) -> DataFrame:
    """Interactions (user_index, item_index) packed by cell: (ub, ib, u, i) with sorted rows within the blocks, stored."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "i"])
        return pd.DataFrame({"ub": [int(key[0])], "ib": [int(key[1])], "u": [rows["u"].to_numpy(np.int32).tobytes()], "i": [rows["i"].to_numpy(np.int32).tobytes()]})

    deal = lambda c, block, row: (F.pmod(F.col(c), F.lit(blocks)).cast("long").alias(block), F.floor(F.col(c) / blocks).cast("int").alias(row))
    dealt = pairs.select(*deal("user_index", "ub", "u"), *deal("item_index", "ib", "i"))
    return materialise(dealt.groupBy("ub", "ib").applyInPandas(pack, "ub long, ib long, u binary, i binary"), "cells")


def by_cell(batches: Iterator[pd.DataFrame], move: Callable[[tuple], list[tuple]]) -> Iterator[pd.DataFrame]:
    """What ``move`` makes of each cell, passed on before the next is moved: a task holds the moved blocks of one cell beside its batch."""
    for batch in batches:
        for r in batch.itertuples():
            yield pd.DataFrame(move(r), columns=["side", "block", "factors", "squares"])


def first_factors(spark: SparkSession, sizes: dict[str, int], blocks: int, width: int, seed: int, biased: bool) -> DataFrame:
    """Small random factors per block and zero squares; with ``biased`` the last column is 1 for users and 0 for items."""

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block in batch["id"]:
                for number, side in enumerate(("user", "item")):
                    start = np.random.default_rng([seed, number, block]).normal(0, 0.1, (len(range(block, sizes[side], blocks)), width))
                    if biased:
                        start[:, -1] = 1.0 if side == "user" else 0.0
                    out.append((side, block, to_bytes(start), to_bytes(np.zeros_like(start))))
            yield pd.DataFrame(out, columns=["side", "block", "factors", "squares"])

    return materialise(spark.range(blocks).mapInPandas(begin, FACTORS), "factors")


def meet(factors: DataFrame, cells: DataFrame, blocks: int, stratum: int) -> DataFrame:
    """The block pairs of a stratum with their cells: (ub, ib, users, user_squares, items, item_squares, u, i)."""

    def side_of(name: str, block: str) -> DataFrame:
        return factors.filter(F.col("side") == name).select(F.col("block").alias(block), F.col("factors").alias(f"{name}s"), F.col("squares").alias(f"{name}_squares"))

    left = side_of("user", "ub").withColumn("ib", F.pmod(F.col("ub") + stratum, F.lit(blocks)))
    return left.join(side_of("item", "ib"), "ib").join(cells, ["ub", "ib"], "left")


def named_factors(factors: DataFrame, users: DataFrame, items: DataFrame, blocks: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables (user_id, factors) and (item_id, idx, factors)."""

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                data = from_bytes(r.factors, width)
                yield pd.DataFrame({"idx": r.block + blocks * np.arange(len(data)), "factors": list(data)})

    table = lambda name: factors.filter(F.col("side") == name).mapInPandas(rows_of, "idx long, factors array<double>")
    user_factors = table("user").join(users.withColumnRenamed("id", USER), "idx").select(USER, "factors")
    item_factors = table("item").join(items.withColumnRenamed("id", ITEM), "idx").select(ITEM, "idx", "factors")
    return materialise(user_factors, "user-factors"), materialise(item_factors, "item-factors")


def fit_pairwise(
    train: DataFrame, rank: int = 32, epochs: int = 15, rate: float = 0.1, decay: float = 0.01, blocks: int = 0, seed: int = 42
) -> LatentModel:
    """Factors of users and items and item biases that rank seen items of (user_id, item_id) above unseen ones.

    ``blocks`` is the number of blocks a side (0: by size). Draws depend on seed, epoch and
    cell, and cells are sorted, so the result is the same on any layout. Every
    stratum stores the moved factors and deletes those before; a task holds two factor blocks and one cell.
    """
    encoded, users, items = encode_ids(pairs_of(train), USER, ITEM)
    pairs = materialise(encoded.select("user_index", "item_index"), "pairs")
    sizes = {"user": users.count(), "item": items.count()}
    blocks, width = blocks or block_count(sizes, pairs.count()), rank + 1
    cells = cells_of(pairs, blocks)
    factors = first_factors(pairs.sparkSession, sizes, blocks, width, seed, biased=True)

    def visit(epoch: int) -> Callable:
        def move(r: tuple) -> list[tuple]:
            sides = [from_bytes(data, width).copy() for data in (r.users, r.user_squares, r.items, r.item_squares)]
            if r.u is not None and len(sides[2]):
                rng = np.random.default_rng([seed, 2 + epoch, r.ub, r.ib])
                descend(*sides, (np.frombuffer(r.u, np.int32), np.frombuffer(r.i, np.int32)), rng, rate, decay)
            return [("user", r.ub, *(to_bytes(s) for s in sides[:2])), ("item", r.ib, *(to_bytes(s) for s in sides[2:]))]

        return lambda batches: by_cell(batches, move)

    for epoch in range(epochs):
        for stratum in range(blocks):
            factors = materialise(meet(factors, cells, blocks, stratum).mapInPandas(visit(epoch), FACTORS), "factors", replaces=factors)
    discard(cells)
    tables = named_factors(factors, users, items, blocks, width)
    return LatentModel(*tables, materialise(pairs_of(train), "history"), width, sizes["item"])


def pairwise_loss(model: LatentModel, triplets: DataFrame) -> float | None:
    """Mean of log(1 + exp(score of the negative - score of the positive)) over (user_id, positive, negative); null without any."""
    item = lambda c: model.item_factors.select(F.col(ITEM).alias(c), F.col("factors").alias(f"_{c}"))
    joined = triplets.join(model.user_factors, USER).join(item("positive"), "positive").join(item("negative"), "negative")
    products = F.zip_with("factors", F.zip_with("_positive", "_negative", lambda a, b: a - b), lambda a, b: (a * b).cast("double"))
    margin = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    return joined.agg(F.avg(F.log1p(F.exp(-margin)))).first()[0]
