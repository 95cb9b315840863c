"""Shallow item-item autoencoder with a closed-form solution (EASE), for small and for very large catalogues."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.models import conjugate
from trailmark.models.blocked import BLOCK, USERS_PER_SHARD, dense_blocks, each_row, folded_top_k, from_bytes, map_blocks, to_bytes
from trailmark.models.common import (
    ITEM,
    USER,
    check_limit,
    item_counts,
    pairs_of,
    place_items,
    top_k,
    unseen_from,
)
from trailmark.models.conjugate import Places, solve_columns, transposed
from trailmark.operators.cleaning import top_keys
from trailmark.operators.cooccurrence import TASK_MEETINGS, cooccurrence
from trailmark.operators.encoding import id_table
from trailmark.storage import discard, materialise


@dataclass
class EaseModel:
    """Numbered catalogue ``items`` (id, idx), history and counts, and how to get the item weights.

    Weights come in groups of column blocks: rows (bi, bj, data) with blocks of
    ``rows`` x ``width``. After a dense fit all are stored in ``weights``. After a
    conjugate fit ``encoded`` has the interactions by item number and each group is solved
    when it is asked for; the sparse matrix is made for the first.
    """

    items: DataFrame
    history: DataFrame
    popularity: DataFrame
    n: int
    rows: int
    width: int
    weights: DataFrame | None = None
    encoded: DataFrame | None = None
    regularisation: float = 0.0
    columns_at_once: int = 0

    @cached_property
    def matrix(self) -> conjugate.SparseBlocks:
        """The regularised Gram matrix of a conjugate fit."""
        shift = self.items.select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(float(self.regularisation)).alias("w"))
        return conjugate.compress(item_gram(self.encoded).unionByName(shift), self.n, self.rows)

    def groups(self) -> Iterator[tuple[range, DataFrame]]:
        """Column block numbers and their weights, group by group; a solved group is deleted when the next is asked for."""
        blocks = -(-self.n // self.width)
        if self.weights is not None:
            yield range(blocks), self.weights
            return
        size = max(1, (self.columns_at_once or STORED_BYTES // (24 * max(1, self.n))) // self.width)
        for first in range(0, blocks, size):
            columns = range(first, min(first + size, blocks))
            table = materialise(self._solved_weights(columns), "weights", large=True)
            yield columns, table
            discard(table)

    def _solved_weights(self, columns: range) -> DataFrame:
        solved, _ = conjugate.solve_panels(self.matrix, columns[0], len(columns), self.width)
        rows, width, n = self.rows, self.width, self.n

        def own(block: int, panel: int) -> tuple[np.ndarray, np.ndarray]:
            """Rows and columns of a block where an item meets itself."""
            j = np.arange(max(block * rows, panel * width), min((block + 1) * rows, (panel + 1) * width, n))
            return j - block * rows, j - panel * width

        def diagonal(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            values = np.ones(width)
            for block, data in zip(part["block"], part["solution"]):
                i, j = own(block, int(key[0]))
                values[j] = from_bytes(data, width)[i, j]
            return pd.DataFrame({"panel": [int(key[0])], "divisor": [values.tobytes()]})

        def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for r in each_row(batches):
                weights = -from_bytes(r.solution, width) / np.frombuffer(r.divisor)
                weights[own(r.block, r.panel)] = 0.0
                yield pd.DataFrame({"bi": [r.block], "bj": [r.panel], "data": [to_bytes(weights)]})

        meets = (F.col("block") * rows < (F.col("panel") + 1) * width) & ((F.col("block") + 1) * rows > F.col("panel") * width)
        divisors = solved.filter(meets).select("panel", "block", "solution").groupBy("panel").applyInPandas(diagonal, "panel long, divisor binary")
        return solved.select("panel", "block", "solution").join(divisors, "panel").mapInPandas(divide, "bi long, bj long, data binary")


DENSE_ITEMS = 16_384  # up to here the inverse is formed by sweeps over dense blocks
STORED_BYTES = 64 << 30  # of panels that a conjugate fit stores at a time
TASK_ENTRIES = 16_000_000  # interactions that a task holds to solve panels by itself, 16 bytes each at most
TASK_BYTES = 128 << 20  # of the panel that a task solves
PART_USERS = 65_536  # whose items are one row of the table that such a task is given


def fit_ease(
    train: DataFrame, regularisation: float = 250.0, max_items: int = 0, block: int = BLOCK, solver: str = "auto", columns_at_once: int = 0
) -> EaseModel:
    """Weights B = I - P / diag(P) with P the inverse of the regularised item Gram matrix.

    The Gram matrix is aggregated sparsely. ``dense`` lays it out in blocks and
    inverts it by block elimination; its cost is cubic in the catalogue.
    ``conjugate`` keeps it sparse and solves for columns of the inverse by
    conjugate gradients, so that no items x items table ever exists. Up to TASK_ENTRIES
    interactions a task solves and scores panels by itself. Beyond, and with ``columns_at_once``, so
    many columns (0: as many as fit 64 GB of stored panels) are solved in blocks and stored. ``auto`` takes the first up to 16,384 items.
    Both give the same weights. ``max_items`` keeps the most frequent items, 0 keeps all.
    """
    if regularisation <= 0 or max_items < 0:
        raise ValueError("regularisation must be positive and max_items not negative")
    if solver not in ("auto", "dense", "conjugate"):
        raise ValueError("the solver is auto, dense or conjugate")
    history = materialise(pairs_of(train), "history")
    counts = item_counts(history)
    kept = top_keys(counts, ITEM, "score", max_items) if max_items > 0 else counts
    items = materialise(id_table(kept, ITEM), "items")
    n = items.count()
    encoded = materialise(history.join(items, F.col(ITEM) == F.col("id")).select(USER, F.col("idx").alias("i")), "encoded")
    if solver == "dense" or (solver == "auto" and n <= DENSE_ITEMS):
        block = max(1, min(block, n))
        inverse = invert_blocks(dense_blocks(item_gram(encoded), n, block, regularisation), -(-n // block), block)
        return EaseModel(items, history, counts, n, block, block, weights=materialise(_item_weights(inverse, block), "ease"))
    rows, width = (max(1, min(size, n)) for size in (conjugate.ROWS, min(block, conjugate.PANEL)))
    return EaseModel(items, history, counts, n, rows, width, encoded=encoded, regularisation=regularisation, columns_at_once=columns_at_once)


def item_gram(encoded: DataFrame) -> DataFrame:
    """Entries (i, j, w) of the item Gram matrix of rows (user_id, i), both halves and the diagonal."""
    half = cooccurrence(encoded, USER, "i")
    both = F.array(
        F.struct(F.col("item_i").alias("i"), F.col("item_j").alias("j")), F.struct(F.col("item_j").alias("i"), F.col("item_i").alias("j"))
    )
    diagonal = encoded.groupBy("i").agg(F.count("*").cast("double").alias("w")).select("i", F.col("i").alias("j"), "w")
    return half.select(F.inline(both), F.col("dot").alias("w")).unionByName(diagonal)


def gram_residuals(history: DataFrame, columns: DataFrame, regularisation: float) -> DataFrame:
    """Largest absolute entry of (G + regularisation) p - e for columns p of the inverse.

    ``columns`` has rows (i, j, value) by item id. G is not formed: the products
    go from items to users and back over the history, so the check shares nothing
    with the fit. The history is dealt by user to as many tasks as its products
    need, so that a user's sums are made, and used, in one task.
    """
    products = history.count() * columns.count() // max(1, columns.select("i").distinct().count())
    seen = history.select(USER, F.col(ITEM).alias("i")).repartition(products // TASK_MEETINGS + 1, USER)
    by_user = seen.join(columns, "i").groupBy(USER, "j").agg(F.sum("value").alias("value"))
    back = seen.join(by_user, USER).groupBy("i", "j").agg(F.sum("value").alias("value"))
    own = columns.select("i", "j", (F.col("value") * regularisation - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("value"))
    rest = back.unionByName(own).groupBy("i", "j").agg(F.abs(F.sum("value")).alias("value"))
    return rest.groupBy(F.col("j").alias(ITEM)).agg(F.max("value").alias("residual"))


def inverse_columns(model: EaseModel) -> DataFrame:
    """Long rows (i, j, value) of P by item id after a conjugate fit; as many as items x items, for small catalogues."""
    solved, _ = conjugate.solve_panels(model.matrix, 0, -(-model.n // model.width), model.width)
    entries = conjugate.entries_of(solved, model.n, model.rows, model.width)
    name = lambda c: model.items.select(F.col("id").alias(c), F.col("idx").alias(f"_{c}"))
    return entries.withColumnsRenamed({"i": "_i", "j": "_j"}).join(name("i"), "_i").join(name("j"), "_j").select("i", "j", "value")


def invert_blocks(matrix: DataFrame, count: int, block: int) -> DataFrame:
    """Inverse of a symmetric positive definite block matrix, one sweep step per block row.

    Only the blocks on and below the diagonal are kept. With C the pivot's
    column and W = C / pivot, a step sets the column to W, every other block
    (i, j) to A - W_i C_j' and the pivot to minus its inverse, so the matrix stays symmetric; after
    the last step it is minus the inverse. Each step's table replaces the one before.
    """
    current = materialise(matrix.filter(F.col("bi") >= F.col("bj")), "blocks")


    def minus_inverse(row: pd.Series) -> bytes:
        return to_bytes(-np.linalg.inv(from_bytes(row["data"], block)))

    def turned(row: pd.Series) -> bytes:
        """The block of the pivot's column, also where the kept one is its mirror."""
        data = from_bytes(row["data"], block)
        return to_bytes(data.T if row["mirrored"] else data)

    def over_pivot(row: pd.Series) -> bytes:
        return to_bytes(-from_bytes(row["data"], block) @ from_bytes(row["pivot"], block))

    def update(row: pd.Series) -> bytes:
        if row["data"] is not None:
            return to_bytes(from_bytes(row["data"], block) - from_bytes(row["over_i"], block) @ from_bytes(row["of_j"], block).T)
        return row["over_i"] if row["over_i"] is not None else to_bytes(from_bytes(row["over_j"], block).T)

    for k in range(count):
        pivot = materialise(map_blocks(current.filter((F.col("bi") == k) & (F.col("bj") == k)), minus_inverse), "pivot")
        beside = ((F.col("bi") == k) | (F.col("bj") == k)) & (F.col("bi") != F.col("bj"))
        place = F.when(F.col("bj") == k, F.col("bi")).otherwise(F.col("bj"))
        column = current.filter(beside).select(place.alias("bi"), F.lit(k).cast("long").alias("bj"), "data", (F.col("bi") == k).alias("mirrored"))
        column = materialise(map_blocks(column, turned), "column")
        over = column.join(F.broadcast(pivot.select("bj", F.col("data").alias("pivot"))), "bj")
        over = materialise(map_blocks(over, over_pivot), "over")
        inner = current.filter((F.col("bi") != k) & (F.col("bj") != k)).select("bi", "bj", "data")
        edge = current.filter(beside).select("bi", "bj", F.lit(None).cast("binary").alias("data"))
        side = lambda table, at, name: table.select(F.col("bi").alias(at), F.col("data").alias(name))
        joined = (
            inner.unionByName(edge)
            .join(side(over, "bi", "over_i"), "bi", "left")
            .join(side(column, "bj", "of_j"), "bj", "left")
            .join(side(over, "bj", "over_j"), "bj", "left")
        )
        current = materialise(map_blocks(joined, update).unionByName(pivot), "blocks", replaces=current)
        for spent in (pivot, column, over):
            discard(spent)
    both = F.when(F.col("bi") == F.col("bj"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    mirror = current.withColumn("mirrored", F.explode(both))
    place = lambda own, other: F.when(F.col("mirrored"), F.col(other)).otherwise(F.col(own)).alias(own)
    whole = mirror.select(place("bi", "bj"), place("bj", "bi"), "data", "mirrored")

    def signed(row: pd.Series) -> bytes:
        data = -from_bytes(row["data"], block)
        return to_bytes(data.T if row["mirrored"] else data)

    return map_blocks(whole, signed)


def _item_weights(inverse: DataFrame, block: int) -> DataFrame:
    """Divide every column of P by its diagonal element, change the sign and clear the diagonal."""
    diagonal = inverse.filter(F.col("bi") == F.col("bj")).select("bj", F.col("data").alias("pivot"))

    def scale(row: pd.Series) -> bytes:
        weights = -from_bytes(row["data"], block) / np.diag(from_bytes(row["pivot"], block))
        if row["bi"] == row["bj"]:
            np.fill_diagonal(weights, 0.0)
        return to_bytes(weights)

    return map_blocks(inverse.join(diagonal, "bj"), scale)


def recommend_ease(
    model: EaseModel, users: DataFrame, k: int = 10, popularity_weight: float = 0.0, users_per_shard: int = USERS_PER_SHARD
) -> DataFrame:
    """Top unseen items by summed weights of the user's items, optionally plus a popularity term.

    Users without an item of the catalogue get the popular items they have not seen.
    """
    check_limit(k)
    if model.encoded is not None and not model.columns_at_once:
        people = materialise(id_table(model.encoded, USER), "people")
        entries = model.encoded.count()
        if 0 < entries <= TASK_ENTRIES and people.count() * k <= TASK_ENTRIES:
            return _named_lists(model, users, _solved_top_k(model, users, people, k, popularity_weight), people, k)
    encoded = model.history.join(model.items, F.col(ITEM) == F.col("id")).select(USER, F.col("idx").alias("i"))
    known = encoded.join(users.select(USER).distinct(), USER, "left_semi")
    warm = materialise(id_table(known, USER), "warm")
    shards = -(-warm.count() // users_per_shard)
    place = (F.col("idx") / users_per_shard).cast("long").alias("shard"), (F.col("idx") % users_per_shard).alias("number")
    left = materialise(known.join(warm.withColumnRenamed("id", USER), USER).select(*place, "i"), "warm_items")
    best = None
    for columns, weights in model.groups() if shards else ():
        right = weights
        if popularity_weight:
            right = right.unionByName(_popularity_blocks(model, popularity_weight, columns))
        found = folded_top_k(left, right, shards, columns, model.width, model.rows, model.n, k)
        if model.weights is None:  # solved weights go with their group: keep the best so far
            window = Window.partitionBy("shard", "number").orderBy(F.desc("score"), "item")
            both = found if best is None else found.unionByName(best)
            ranked = both.withColumn("_place", F.row_number().over(window)).filter(F.col("_place") <= k).drop("_place")
            best = materialise(ranked, "best", replaces=best)
        else:
            best = found
    if best is None:
        return unseen_from(place_items(model.popularity), users, model.history, k)
    return _named_lists(model, users, best, warm.select("id", *place), k)


def _named_lists(model: EaseModel, users: DataFrame, best: DataFrame, numbers: DataFrame, k: int) -> DataFrame:
    """Lists by id from rows (..., item, score) by number; users without one get the popular items.

    ``numbers`` has the ids and numbers of users, all with an item of the catalogue.
    """
    known = numbers.withColumnRenamed("id", USER)
    named = best.join(model.items.select("id", F.col("idx").alias("item")), "item").withColumnRenamed("id", ITEM)
    named = named.join(known, [c for c in known.columns if c != USER]).select(USER, ITEM, "score")
    rest = users.select(USER).join(known.select(USER), USER, "left_anti")
    return top_k(named, k).unionByName(unseen_from(place_items(model.popularity), rest, model.history, k))


def _solved_top_k(model: EaseModel, users: DataFrame, people: DataFrame, k: int, popularity_weight: float) -> DataFrame:
    """Best items (idx, item, score) of each wanted user, panels being solved and scored in tasks that hold all interactions.

    A task gets the places of the interactions once, solves one panel of columns after the other
    and keeps the ``k`` best of every user; nothing of the inverse is stored. Panels are as wide as TASK_BYTES allow.
    """
    wanted = users.select(USER).distinct().withColumn("wanted", F.lit(True))
    marked = people.join(wanted, people["id"] == wanted[USER], "left").select("id", "idx", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    n, m = model.n, people.count()
    numbered = model.encoded.join(marked, F.col(USER) == F.col("id")).select("idx", "i", "wanted")
    # rows without a user meet no other row: each is a user of its own that nobody asks for
    numbered = numbered.unionByName(model.encoded.filter(F.col(USER).isNull()).select((F.col("i") + m).alias("idx"), "i", F.lit(False).alias("wanted")))
    placed = numbered.select((F.col("idx") / PART_USERS).cast("long").alias("part"), (F.col("idx") % PART_USERS).cast("int").alias("u"), F.col("i").cast("int"), "wanted")

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["u", "i"])
        counts, served = np.bincount(rows["u"], minlength=PART_USERS).astype(np.int32), np.zeros(PART_USERS, bool)
        served[rows["u"][rows["wanted"]]] = True
        return pd.DataFrame({"part": [int(key[0])], "counts": [counts.tobytes()], "items": [rows["i"].to_numpy(np.int32).tobytes()], "served": [served.tobytes()]})

    parts = materialise(placed.groupBy("part").applyInPandas(pack, "part long, counts binary, items binary, served binary"), "places", large=True)
    width = max(1, min(n, TASK_BYTES // (8 * (4 * n + 2 * m))))
    panels = -(-n // width)
    tasks = min(panels, 2 * parts.sparkSession.sparkContext.defaultParallelism)
    shift = model.regularisation

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sorted(((r.task, r.part, r.counts, r.items, r.served) for r in each_row(batches)), key=lambda r: r[:2])
        for task in sorted({r[0] for r in held}):
            mine = [r[1:] for r in held if r[0] == task]
            counts, items, served = (np.concatenate([np.frombuffer(r[c], kind) for r in mine]) for c, kind in ((1, np.int32), (2, np.int32), (3, bool)))
            numbers = np.concatenate([r[0] * PART_USERS + np.arange(PART_USERS) for r in mine])
            some = counts > 0
            counts, served, numbers = counts[some], served[some], numbers[some]
            starts = np.concatenate([[0], np.cumsum(counts)])
            back = transposed(starts, items, n)
            degrees = np.diff(back[0])
            across, down = Places(starts, items), Places(*back)
            bonus = popularity_weight * np.log1p(degrees)
            lists = BestLists(len(counts), k)
            for panel in range(task, panels, tasks):
                columns = range(panel * width, min(n, (panel + 1) * width))
                weights = solve_columns(across, down, degrees + shift, shift, columns)
                weights /= -weights[columns, np.arange(len(columns))]
                weights[columns, np.arange(len(columns))] = 0.0
                scores = across.times(weights, np.empty((len(counts), len(columns)))) + bonus[columns]
                for place, column in enumerate(columns):
                    scores[back[1][back[0][column] : back[0][column + 1]], place] = -np.inf
                scores[~served] = -np.inf
                lists.add(scores, columns[0])
            user, item, score = lists.ended()
            for at in range(0, len(user), 100_000):
                yield pd.DataFrame({"idx": numbers[user[at : at + 100_000]], "item": item[at : at + 100_000], "score": score[at : at + 100_000]})

    dealt = parts.withColumn("task", F.explode(F.sequence(F.lit(0).cast("int"), F.lit(tasks - 1).cast("int")))).repartitionById(tasks, F.col("task"))
    found = dealt.mapInPandas(run, "idx long, item long, score double")
    window = Window.partitionBy("idx").orderBy(F.desc("score"), "item")
    return materialise(found.withColumn("_place", F.row_number().over(window)).filter(F.col("_place") <= k).drop("_place"), "best")


class BestLists:
    """The ``k`` best columns of every row, of blocks of scores that come in the order of the columns."""

    def __init__(self, rows: int, k: int) -> None:
        self.k, self.limit = k, np.full(rows, -np.inf)
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        self.waiting = 0

    def add(self, scores: np.ndarray, first: int) -> None:
        """Scores at or below a row's limit come too late: its k best are larger, or as large and of smaller columns."""
        rows, columns = np.nonzero(scores > self.limit[:, None])
        self.kept.append((rows, columns + first, scores[rows, columns]))
        self.waiting += len(rows)
        if self.waiting > 2 * self.k * len(self.limit):
            self._cut()

    def _cut(self) -> None:
        rows, columns, scores = (np.concatenate(c) for c in zip(*self.kept))
        order = np.lexsort((columns, -scores, rows))
        rows, columns, scores = rows[order], columns[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.limit[rows[last]] = scores[last]
        keep = place < self.k
        self.kept, self.waiting = [(rows[keep], columns[keep], scores[keep])], 0

    def ended(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._cut()
        return self.kept[0]


def _popularity_blocks(model: EaseModel, weight: float, columns: range) -> DataFrame:
    """One row vector per column block holding weight * log1p(count), as block row -1."""
    width = model.width
    placed = model.popularity.join(model.items, F.col(ITEM) == F.col("id")).select(
        (F.col("idx") / width).cast("long").alias("bj"), (F.col("idx") % width).alias("place"), (F.log1p("score") * weight).alias("bonus")
    )

    def lay_out(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        vector = np.zeros((1, width))
        vector[0, rows["place"].to_numpy()] = rows["bonus"].to_numpy()
        return pd.DataFrame({"bi": [-1], "bj": [int(key[0])], "data": [to_bytes(vector)]})

    mine = placed.filter(F.col("bj").between(columns[0], columns[-1]))
    return mine.groupBy("bj").applyInPandas(lay_out, "bi long, bj long, data binary")


def ease(
    train: DataFrame, users: DataFrame, k: int = 10, regularisation: float = 250.0, max_items: int = 0,
    popularity_weight: float = 0.0, block: int = BLOCK, solver: str = "auto",
) -> DataFrame:
    """Fit and recommend in one call."""
    return recommend_ease(fit_ease(train, regularisation, max_items, block, solver), users, k, popularity_weight)
