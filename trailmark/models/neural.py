"""Neural collaborative filtering: a product branch and a perceptron branch trained together with their embeddings.

Embeddings move by strata of user and item blocks as in the pairwise model. The
network is small: every cell of a stratum starts from the same copy, and the moved
copies are averaged by their number of rows before the next stratum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.models.blocked import BLOCK, from_bytes, to_bytes
from trailmark.models.common import ITEM, USER, pairs_of
from trailmark.models.latent import PAIRS_AT_ONCE, LatentModel, _recommend
from trailmark.models.pairwise import FACTORS, block_count, by_cell, cells_of, climb, first_factors, meet, named_factors, unseen_draws
from trailmark.operators.encoding import encode_ids
from trailmark.storage import discard, materialise

BATCH = 1_024
GROUPS = 16  # partial averages that reach the driver after a stratum


def shapes(rank: int, layers: Sequence[int]) -> list[tuple[int, ...]]:
    """Weights and biases of the perceptron layers, then of the output over both branches."""
    sizes = [2 * rank, *layers]
    found = [shape for a, b in zip(sizes, sizes[1:]) for shape in ((a, b), (b,))]
    return [*found, (rank + sizes[-1],), (1,)]


def unpacked(flat: np.ndarray, rank: int, layers: Sequence[int]) -> list[np.ndarray]:
    parts, at = [], 0
    for shape in shapes(rank, layers):
        size = int(np.prod(shape))
        parts.append(flat[at : at + size].reshape(shape))
        at += size
    return parts


def first_network(rank: int, layers: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng([seed, 7])
    parts = [rng.normal(0, np.sqrt(2.0 / shape[0]), shape) if len(shape) == 2 else np.zeros(shape) for shape in shapes(rank, layers)]
    parts[-2][:] = rng.normal(0, 0.3, parts[-2].shape)
    parts[-2][:rank] = 1.0  # the product branch starts as a plain dot product
    return np.concatenate([p.ravel() for p in parts])


def losses(flat: np.ndarray, rank: int, layers: Sequence[int], users: np.ndarray, items: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Summed log-loss of rows of user and item embeddings, and its slopes by network, users and items.

    The first ``rank`` columns of an embedding belong to the product branch, the others to the perceptron.
    """
    parts = unpacked(flat, rank, layers)
    signals = [np.hstack([users[:, rank:], items[:, rank:]])]
    for k in range(len(layers)):
        signals.append(np.maximum(signals[-1] @ parts[2 * k] + parts[2 * k + 1], 0.0))
    both = np.hstack([users[:, :rank] * items[:, :rank], signals[-1]])
    score = both @ parts[-2] + parts[-1][0]
    loss = float(np.logaddexp(0.0, np.where(labels > 0, -score, score)).sum())
    error = 1 / (1 + np.exp(-np.clip(score, -500, 500))) - labels
    slopes: list[np.ndarray] = [both.T @ error, np.array([error.sum()])]
    back = error[:, None] * parts[-2]
    product, signal = back[:, :rank], back[:, rank:]
    for k in range(len(layers) - 1, -1, -1):
        signal = signal * (signals[k + 1] > 0)
        slopes = [signals[k].T @ signal, signal.sum(0), *slopes]
        signal = signal @ parts[2 * k].T
    by_user = np.hstack([product * items[:, :rank], signal[:, :rank]])
    by_item = np.hstack([product * users[:, :rank], signal[:, rank:]])
    return loss, np.concatenate([s.ravel() for s in slopes]), by_user, by_item


@dataclass
class NeuralModel:
    factors: LatentModel
    network: np.ndarray
    rank: int
    layers: tuple[int, ...]


def fit_neural(
    train: DataFrame, rank: int = 16, layers: Sequence[int] = (128, 64, 32), epochs: int = 15, negatives: int = 4, rate: float = 0.05,
    decay: float = 0.001, blocks: int = 0, seed: int = 42,
) -> NeuralModel:
    """Embeddings and network that tell seen pairs of (user_id, item_id) from ``negatives`` drawn unseen ones each.

    All draws depend on seed, epoch and cell, and cells are sorted, so the result
    is the same on any layout. A task holds two embedding blocks, one cell and the network;
    the driver gets a few partial averages of the network per stratum.
    """
    encoded, users, items = encode_ids(pairs_of(train), USER, ITEM)
    pairs = materialise(encoded.select("user_index", "item_index"), "pairs")
    sizes = {"user": users.count(), "item": items.count()}
    blocks, width, layers = blocks or block_count(sizes, pairs.count()), 2 * rank, tuple(layers)
    cells = cells_of(pairs, blocks)
    factors = first_factors(pairs.sparkSession, sizes, blocks, width, seed, biased=False)
    network = first_network(rank, layers, seed)
    squares = np.zeros_like(network)

    def visit(epoch: int, network: np.ndarray, squares: np.ndarray) -> Callable:
        def train_cell(own: list[np.ndarray], of_user: np.ndarray, of_item: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, int]:
            flat, sums = network.copy(), squares.copy()
            drawn_for = np.repeat(of_user, negatives)
            drawn = unseen_draws(of_user, of_item, drawn_for, len(own[2]), rng)
            u = np.concatenate([of_user, drawn_for[drawn >= 0]])
            i = np.concatenate([of_item, drawn[drawn >= 0]])
            labels = np.concatenate([np.ones(len(of_user)), np.zeros(len(u) - len(of_user))])
            order = rng.permutation(len(u))
            for start in range(0, len(u), BATCH):
                some = order[start : start + BATCH]
                rows = own[0][u[some]], own[2][i[some]]
                _, slope, by_user, by_item = losses(flat, rank, layers, *rows, labels[some])
                slope /= len(some)
                sums += slope**2
                flat -= 0.2 * rate * slope / np.sqrt(sums + 1e-8)
                climb(own[0], own[1], u[some], -by_user - decay * rows[0], rate)
                climb(own[2], own[3], i[some], -by_item - decay * rows[1], rate)
            return flat, sums, len(u)

        def move(r: tuple) -> list[tuple]:
            own, told = [from_bytes(data, width).copy() for data in (r.users, r.user_squares, r.items, r.item_squares)], []
            if r.u is not None and len(own[2]):
                rng = np.random.default_rng([seed, 2 + epoch, r.ub, r.ib])
                flat, sums, rows = train_cell(own, np.frombuffer(r.u, np.int32), np.frombuffer(r.i, np.int32), rng)
                told.append((f"network {rows}", r.ub, to_bytes(flat), to_bytes(sums)))
            return [*told, ("user", r.ub, *(to_bytes(s) for s in own[:2])), ("item", r.ib, *(to_bytes(s) for s in own[2:]))]

        return lambda batches: by_cell(batches, move)

    def partial(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        counts = rows["side"].str.split(" ").str[1].astype(np.int64).to_numpy()
        mean = [to_bytes(sum(n * np.frombuffer(data) for n, data in zip(counts, rows[c])) / counts.sum()) for c in ("factors", "squares")]
        return pd.DataFrame({"group": [int(key[0])], "rows": [int(counts.sum())], "factors": mean[:1], "squares": mean[1:]})

    for epoch in range(epochs):
        for stratum in range(blocks):
            moved = meet(factors, cells, blocks, stratum).mapInPandas(visit(epoch, network, squares), FACTORS)
            factors = materialise(moved, "factors", replaces=factors)
            copies = factors.filter(F.col("side").startswith("network")).groupBy(F.pmod("block", F.lit(GROUPS)).alias("group"))
            found = sorted(copies.applyInPandas(partial, "group long, rows long, factors binary, squares binary").collect())
            total = sum(r["rows"] for r in found)
            if total:
                network, squares = (sum(r["rows"] * np.frombuffer(r[c]) for r in found) / total for c in ("factors", "squares"))
    discard(cells)
    tables = named_factors(factors, users, items, blocks, width)
    return NeuralModel(LatentModel(*tables, materialise(pairs_of(train), "history"), width, sizes["item"]), network, rank, layers)


def pair_scores(network: np.ndarray, rank: int, layers: Sequence[int]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The network's score of all pairs of user and item embeddings, as a probability rounded to 9 digits."""
    parts = unpacked(network, rank, layers)

    def score(users: np.ndarray, items: np.ndarray) -> np.ndarray:
        result = np.empty((len(users), len(items)))
        from_items = items[:, rank:] @ parts[0][rank:] + parts[1]  # the first layer splits into a user and an item part
        from_users = users[:, rank:] @ parts[0][:rank]
        products = (users[:, :rank] * parts[-2][:rank]) @ items[:, :rank].T
        some = max(1, PAIRS_AT_ONCE // max(1, len(items)))
        for at in range(0, len(users), some):
            signal = (from_users[at : at + some, None] + from_items).reshape(-1, from_items.shape[1])
            np.maximum(signal, 0.0, out=signal)
            for k in range(1, len(layers)):
                signal = signal @ parts[2 * k]
                signal += parts[2 * k + 1]
                np.maximum(signal, 0.0, out=signal)
            total = products[at : at + some] + (signal @ parts[-2][rank:]).reshape(-1, len(items)) + parts[-1][0]
            result[at : at + some] = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        return np.round(result, 9)

    return score


def recommend_neural(model: NeuralModel, users: DataFrame, k: int = 10, block: int = BLOCK, users_per_shard: int = 2_000) -> DataFrame:
    """Top unseen items of the whole catalogue by the network; users the model does not know get no rows."""
    return _recommend(model.factors, users, k, pair_scores(model.network, model.rank, model.layers), block, users_per_shard)


def score_pairs(model: NeuralModel, pairs: DataFrame) -> DataFrame:
    """``pairs`` (user_id, item_id, ...) of known ids with the network's ``score``."""
    joined = pairs.join(model.factors.user_factors.withColumnRenamed("factors", "_u"), USER).join(model.factors.item_factors.select(ITEM, F.col("factors").alias("_i")), ITEM)
    score = pair_scores(model.network, model.rank, model.layers)

    @F.pandas_udf("double")
    def told(own: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([score(np.array([u]), np.array([i]))[0, 0] for u, i in zip(own, items)])

    return joined.withColumn("score", told("_u", "_i")).drop("_u", "_i")
