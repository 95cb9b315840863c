"""Latent factors from implicit feedback, and a reranker on top of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.models.blocked import BLOCK, USERS_PER_SHARD, blocked_top_k
from trailmark.models.common import ITEM, USER, check_limit, pairs_of, top_k
from trailmark.operators.encoding import encode_ids
from trailmark.operators.sampling import labelled_pairs
from trailmark.storage import materialise

PAIRS_AT_ONCE = 1_024  # pairs of users and items that a network scores together


@dataclass
class LatentModel:
    """Factor tables keyed by id, with the dense item numbers used for scoring."""

    user_factors: DataFrame  # user_id, factors
    item_factors: DataFrame  # item_id, idx, factors
    history: DataFrame
    rank: int
    n_items: int


def fit_latent(weights: DataFrame, rank: int = 64, iterations: int = 10, regularisation: float = 0.1, alpha: float = 1.0, seed: int = 42) -> LatentModel:
    """Alternating least squares on (user_id, item_id, weight).

    Fills the place of the pairwise-trained embedding model: same inputs and
    outputs, a weighted squared loss instead of a pairwise one, and no biases.
    """
    encoded, users, items = encode_ids(weights, USER, ITEM)
    rows = materialise(
        encoded.select(
            F.col("user_index").cast("int"), F.col("item_index").cast("int"), F.col("weight").cast("float").alias("weight")
        ),
        "ratings",
    )
    solver = ALS(
        rank=rank, maxIter=iterations, regParam=regularisation, alpha=alpha, implicitPrefs=True, seed=seed,
        userCol="user_index", itemCol="item_index", ratingCol="weight",
    )
    model = solver.fit(rows)
    user_factors = _named(model.userFactors, users, USER).drop("idx")
    item_factors = _named(model.itemFactors, items, ITEM)
    return LatentModel(
        materialise(user_factors, "user-factors"), materialise(item_factors, "item-factors"),
        materialise(pairs_of(weights), "history"), rank, items.count(),
    )


def _named(factors: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Factor vectors with the id and number they belong to."""
    numbered = factors.select(F.col("id").cast("long").alias("idx"), F.col("features").alias("factors"))
    return numbered.join(ids.withColumnRenamed("id", name), "idx")


Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _recommend(model: LatentModel, users: DataFrame, k: int, score: Scorer, block: int, users_per_shard: int) -> DataFrame:
    """Top unseen items by a score of user and item vectors; users the model does not know get no rows."""
    check_limit(k)
    wanted = model.user_factors.join(users.select(USER).distinct(), USER, "left_semi")
    shards = max(1, -(-wanted.count() // users_per_shard))
    seen = model.history.join(wanted.select(USER), USER).join(model.item_factors.select(ITEM, "idx"), ITEM)
    left = wanted.select(
        F.col(USER).alias("user"), F.lit(-1).cast("long").alias("i"), F.lit(0).alias("seen"), "factors"
    ).unionByName(
        seen.select(F.col(USER).alias("user"), F.col("idx").alias("i"), F.lit(1).alias("seen")), allowMissingColumns=True
    )
    right = model.item_factors.select(
        (F.col("idx") / block).cast("long").alias("bj"), (F.col("idx") % block).alias("place"), "factors"
    )
    rank, model_items = model.rank, model.n_items

    def product(own: pd.DataFrame, panel: pd.DataFrame, number: np.ndarray, count: int) -> np.ndarray:
        vectors = own["seen"].to_numpy() == 0
        user_side = np.zeros((count, rank))
        user_side[number[vectors]] = np.stack(own["factors"].to_numpy()[vectors])
        item_side = np.zeros((min(block, model_items - int(panel["bj"].iloc[0]) * block), rank))  # the last block ends with the last item
        item_side[panel["place"].to_numpy()] = np.stack(panel["factors"].to_numpy())
        return score(user_side, item_side)

    candidates = blocked_top_k(left, right, product, -(-model.n_items // block), block, model.n_items, k, shards)
    named = candidates.join(model.item_factors.select(ITEM, "idx"), F.col("item") == F.col("idx")).select(
        F.col("user").alias(USER), ITEM, "score"
    )
    return top_k(named, k)


def recommend_latent(
    model: LatentModel, users: DataFrame, k: int = 10, block: int = BLOCK, users_per_shard: int = USERS_PER_SHARD
) -> DataFrame:
    """Top unseen items by factor product."""
    return _recommend(model, users, k, lambda own, items: own @ items.T, block, users_per_shard)


def _interaction_features(pairs: DataFrame, model: LatentModel) -> DataFrame:
    """Elementwise product of both factor vectors, followed by the vectors themselves."""
    joined = pairs.join(model.user_factors.withColumnRenamed("factors", "_u"), USER).join(
        model.item_factors.select(ITEM, F.col("factors").alias("_i")), ITEM
    )
    mixed = F.zip_with("_u", "_i", lambda a, b: a * b)
    vector = array_to_vector(F.concat(mixed, "_u", "_i").cast("array<double>"))
    return joined.withColumn("features", vector).drop("_u", "_i")


def fit_reranker(
    model: LatentModel, train: DataFrame, negatives: int = 4, layers: Sequence[int] = (128, 64, 32), iterations: int = 50, seed: int = 42
) -> MultilayerPerceptronClassificationModel:
    """A perceptron on factor features that separates seen pairs from sampled unseen ones.

    Fills the place of the jointly trained neural model; the factors stay fixed.
    """
    encoded, users, items = encode_ids(pairs_of(train), USER, ITEM)
    labels = labelled_pairs(encoded, items.count(), negatives, seed)
    named = labels.join(users.select(F.col("idx").alias("user_index"), F.col("id").alias(USER)), "user_index").join(
        items.select(F.col("idx").alias("item_index"), F.col("id").alias(ITEM)), "item_index"
    )
    rows = materialise(_interaction_features(named.select(USER, ITEM, F.col("label").cast("double")), model), "rerank")
    network = MultilayerPerceptronClassifier(layers=[3 * model.rank, *layers, 2], maxIter=iterations, seed=seed)
    return network.fit(rows)


def network_scorer(network: MultilayerPerceptronClassificationModel, layers: Sequence[int]) -> Scorer:
    """The network's probability of the second class for all pairs of user and item vectors, rounded to 9 digits.

    The weights of a layer stand input by input, its biases after them; hidden layers are logistic.
    """
    flat, parts, at = network.weights.toArray(), [], 0
    for size, outputs in zip(layers, layers[1:]):
        parts.append((flat[at : at + size * outputs].reshape(size, outputs), flat[at + size * outputs : at + (size + 1) * outputs]))
        at += (size + 1) * outputs

    def squashed(signal: np.ndarray) -> np.ndarray:
        """The logistic function, in place."""
        np.clip(signal, -500, 500, out=signal)
        np.exp(np.negative(signal, out=signal), out=signal)
        signal += 1
        return np.divide(1, signal, out=signal)

    def score(users: np.ndarray, items: np.ndarray) -> np.ndarray:
        rank, (weights, bias) = items.shape[1], parts[0]
        from_items, from_users = items @ weights[2 * rank :] + bias, users @ weights[rank : 2 * rank]  # the first layer splits
        result = np.empty((len(users), len(items)))
        some = max(1, PAIRS_AT_ONCE // max(1, len(items)))
        for at in range(0, len(users), some):
            own = users[at : at + some]
            signal = (own[:, None] * items).reshape(-1, rank) @ weights[:rank]
            by_user = signal.reshape(len(own), len(items), -1)
            by_user += from_items
            by_user += from_users[at : at + some, None]
            for after, shift in parts[1:]:
                signal = squashed(signal) @ after
                signal += shift
            result[at : at + some] = 1 / (1 + np.exp(np.clip(signal[:, 0] - signal[:, 1], -500, 500))).reshape(len(own), -1)
        return np.round(result, 9)

    return score


def recommend_network(
    model: LatentModel, network: MultilayerPerceptronClassificationModel, layers: Sequence[int], users: DataFrame, k: int = 10,
    block: int = BLOCK, users_per_shard: int = 2_000,
) -> DataFrame:
    """Top unseen items of the whole catalogue by the network's probability."""
    return _recommend(model, users, k, network_scorer(network, [3 * model.rank, *layers, 2]), block, users_per_shard)


def neural_rerank(
    train: DataFrame, weights: DataFrame, users: DataFrame, k: int = 10, rank: int = 64, iterations: int = 50,
    layers: Sequence[int] = (128, 64, 32),
) -> DataFrame:
    """Rank every unseen item by a perceptron on the factors of the latent model."""
    model = fit_latent(weights, rank=rank)
    network = fit_reranker(model, train, layers=layers, iterations=iterations)
    return recommend_network(model, network, layers, users, k)
