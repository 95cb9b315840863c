"""Sparse item-item products and cosine neighbours."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.functions.columns import whole_units
from trailmark.operators.ordering import dense_index
from trailmark.storage import discard, materialise

SIMILARITY_UNITS = 1e12  # similarities are kept to 12 digits
GROUP_ITEMS = 1_000  # items of one user that meet in one join group
TASK_MEETINGS = 2_000_000  # items met, copies counted, that one task adds up on average
STRIP_MEETINGS = 32_000_000  # items met that are shuffled at a time, or STRIP_ROWS for each input row if that is more
STRIP_ROWS = 4


def strip_count(moved: float, rows: int) -> int:
    """Strips in which ``moved`` entries are shuffled one after the other, so that those on disk follow the input's rows."""
    return max(1, -(-int(moved) // max(STRIP_MEETINGS, STRIP_ROWS * rows)))


def in_strip(column: str, strip: int, strips: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(strips)) == strip


def _meetings(weights: DataFrame, user: str, item: str, weight: str | None, norm: str | None, group_items: int, upwards: bool, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows (_i, _j, dot, scale) of items with a common user, dealt by ``_i``.

    The list of a user's items goes to the task of each of those
    items, where the products are added up: what is shuffled are lists, a number or two per
    meeting, and pairs exist only inside tasks. Lists of users with more than
    ``group_items`` items are cut into blocks. The number of tasks follows that of meetings.
    ``upwards`` keeps only _i < _j. Without ``weight`` all weights are 1. ``finish`` reduces
    the rows of all pairs of some items to what is wanted of them; with it, lists
    go to one strip of the items after the other, each stored before the next.
    """
    source = weights.select(
        F.col(user).alias("_u"), F.col(item).alias("_i"),
        *([] if weight is None else [F.col(weight).cast("double").alias("_w")]),
        *([] if norm is None else [F.col(norm).alias("_s")]),
    ).filter(F.col("_u").isNotNull() & F.col("_i").isNotNull())
    degrees = source.groupBy("_u").agg(F.count("*").alias("_degree"))
    size = F.col("_degree").cast("double")
    largest, rows, meetings = degrees.agg(*(F.coalesce(x, F.lit(0)) for x in (F.max("_degree"), F.sum("_degree"), F.sum(size * size)))).first()
    strips = strip_count(meetings, rows) if finish else 1
    placed = source.withColumn("_block", F.lit(0).cast("bigint"))
    if largest > group_items:
        sized = source.join(degrees, "_u")
        placed = sized.withColumn("_block", F.pmod(F.xxhash64("_i"), F.ceil(F.col("_degree") / group_items)))
    other = {"_i": "_j", "_w": "_v", "_s": "_t"}
    own = [c for c in source.columns if c != "_u"]
    met = [other[c] for c in own]
    entry = F.struct(*(F.col(c).alias(other[c]) for c in own))
    lists = placed.groupBy("_u", "_block").agg(F.collect_list(entry).alias("_met")).drop("_block")
    if strips > 1:
        lists = materialise(lists, "met")

    def strip(number: int) -> DataFrame:
        if largest > group_items:
            mine = source if strips == 1 else source.filter(in_strip("_i", number, strips))
            joined = mine.join(lists, "_u")
        else:  # a user has one list, and the items in it are the user's
            joined = lists.select("_met", F.inline("_met").alias(*own))
            joined = joined if strips == 1 else joined.filter(in_strip("_i", number, strips))
        if upwards:
            joined = joined.withColumn("_met", F.filter("_met", lambda e: e["_j"] > F.col("_i"))).filter(F.size("_met") > 0)
        dealt = joined.select(*own, *(F.col(f"_met.{c}").alias(c) for c in met)).repartition(int(meetings / strips / TASK_MEETINGS) + 1, "_i")
        # lists side by side are smaller than a list of structs
        pairs = dealt.select(*own, F.inline(F.arrays_zip(*met))).filter(F.col("_i") != F.col("_j"))
        sums = [(F.count("*").cast("double") if weight is None else F.sum(F.col("_w") * F.col("_v"))).alias("dot")]
        if norm is not None:
            sums += [F.first("_s").alias("_s"), F.first("_t").alias("_t")]
        added = pairs.groupBy("_i", "_j").agg(*sums)
        return finish(added) if finish else added

    if strips == 1:
        return strip(0)
    stored = [materialise(strip(number), "strip") for number in range(strips)]
    discard(lists)
    return reduce(DataFrame.unionByName, stored)


def cooccurrence(weights: DataFrame, user: str, item: str, weight: str | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Off-diagonal of the item Gram matrix, one row (item_i, item_j, dot) per pair with item_i < item_j.

    ``weights`` has one row per user and item; without ``weight`` each weighs 1.
    """
    return _meetings(weights, user, item, weight, None, group_items, True).select(F.col("_i").alias("item_i"), F.col("_j").alias("item_j"), "dot")


def numbered_neighbours(weights: DataFrame, user: str, item: str, weight: str | None, n: int, group_items: int = GROUP_ITEMS, listed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items numbered in their order (item, _idx), and the neighbours of each: (_i, _j, similarity, rank), or with ``listed`` (_i, _near) with all _j.

    Numbers make lists small, and the pairs of an item are ranked where they were added up.
    """
    squares = F.count("*").cast("int") if weight is None else F.sum(F.col(weight).cast("double") * F.col(weight))
    sizes = weights.filter(F.col(item).isNotNull()).groupBy(item).agg(squares.alias("_square"))
    items = materialise(dense_index(sizes, [item], "_idx").withColumn("_idx", F.col("_idx").cast("int")), "items")
    own = [] if weight is None else [weight]
    numbered = materialise(weights.join(items, item).select(user, "_idx", "_square", *own), "numbered")
    scale = F.sqrt(F.col("_s").cast("double")) * F.sqrt(F.col("_t").cast("double"))
    window = Window.partitionBy("_i").orderBy(F.desc("similarity"), "_j")

    def nearest(met: DataFrame) -> DataFrame:
        similar = met.withColumn("similarity", whole_units(F.col("dot") / scale, SIMILARITY_UNITS) / F.lit(SIMILARITY_UNITS))
        ranked = similar.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
        return ranked.groupBy("_i").agg(F.collect_list("_j").alias("_near")) if listed else ranked.select("_i", "_j", "similarity", "rank")

    return items.select(item, "_idx"), _meetings(numbered, user, "_idx", weight, "_square", group_items, False, nearest)


def cosine_neighbours(weights: DataFrame, user: str, item: str, weight: str | None, n: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """The ``n`` most similar other items of every item: (item, neighbour, similarity, rank).

    Only items with a common user are similar; ties go to the smaller item.
    """
    items, ranked = numbered_neighbours(weights, user, item, weight, n, group_items)
    name = lambda c, number: items.select(F.col(item).alias(c), F.col("_idx").alias(number))
    return ranked.join(name("item", "_i"), "_i").join(name("neighbour", "_j"), "_j").select("item", "neighbour", "similarity", "rank")
