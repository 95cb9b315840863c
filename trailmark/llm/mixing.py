"""Mix sources to target weights: hash-random order, distributed prefix sums, exact cuts, repeated epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.llm.common import WORD, hash_key
from trailmark.operators.ordering import dense_index, running_totals
from trailmark.storage import materialise

#: the key range of a source is cut into RANGES coarse ranges of RANGES fine ones
RANGES = 1024
KEY_BITS = 60


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """One row per source with its share of all words.

    Sources take the weights in turn, ordered by code point with null last. A
    share stops at ``cap`` times the words the source has; what it cannot take
    goes to the others by weight. Sorted by ``cap * words / weight`` the stopped
    sources come first, so prefix sums find them without iterating.

    Returns source, place, weight, source_size, rows, target.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    totals = totals.withColumn("_last", F.col("source").isNull())
    placed = dense_index(totals, ["_last", "source"], "place").drop("_last")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("_most", F.col("source_size") * float(cap))
    placed = placed.withColumn("_ratio", F.col("_most") / F.col("weight"))
    summed = running_totals(placed, ["_ratio", "place"], {"_sizes": "_most", "_weights": "weight"})
    summed = materialise(summed, "sources")
    whole = summed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight_sum = float(whole["words"] or 0), float(whole["weight"] or 0)
    left = F.lit(words) - (F.col("_sizes") - F.col("_most"))
    stopped = F.col("_most") * (F.lit(weight_sum) - (F.col("_weights") - F.col("weight"))) < left * F.col("weight")
    summed = summed.withColumn("_stopped", stopped)
    taken = summed.filter("_stopped").agg(F.sum("_most").alias("words"), F.sum("weight").alias("weight")).first()
    rest, rest_weight = words - float(taken["words"] or 0), weight_sum - float(taken["weight"] or 0)
    share = F.lit(rest) * F.col("weight") / F.lit(rest_weight or 1.0)
    target = F.when(F.col("_stopped"), F.col("_most")).otherwise(F.least(share, F.col("_most")))
    return summed.select("source", "place", "weight", "source_size", "rows", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words the mix takes from every document.

    Each source's budget is its target rounded to whole words. Whole epochs of
    the source come first; the rest is cut from the hash-random order of its
    documents at the exact word, so that only the last document is taken in part.

    Returns one row per row of ``docs``: doc_id, source, size, source_size,
    target, taken, epochs (whole passes over the source). Null text has size 0;
    null sources form one source; repeated rows count each; tied keys are
    ordered by id and size. No rows give no rows. Other columns are ignored.
    """
    doc, source = F.col(id_col), F.col(source_col)
    sized = docs.select(doc.alias("doc_id"), source.alias("source"), count_words(F.col(text_col)).alias("size"))
    sized = materialise(sized.withColumn("_key", hash_key(seed, F.col("doc_id"))), "sized")
    targets = source_targets(sized, weights, cap)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    targets = targets.withColumn("_budget", budget).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(0).cast("long")
    )
    targets = targets.withColumn("_rest", F.col("_budget") - F.col("epochs") * F.col("source_size"))

    coarse = F.shiftright("_key", KEY_BITS - 10).cast("int")
    fine = F.shiftright("_key", KEY_BITS - 20).bitwiseAND(F.lit(RANGES - 1)).cast("int")
    keyed = sized.join(
        targets.select(F.col("source").alias("_source"), "place", "source_size", "target", "epochs", "_rest"),
        F.col("source").eqNullSafe(F.col("_source")),
    ).drop("_source")
    keyed = materialise(keyed.select("*", coarse.alias("_coarse"), fine.alias("_fine")), "keyed")

    # prefix sums in three levels; no window sees more than RANGES sums or one fine range of a source
    cells = keyed.groupBy("place", "_coarse", "_fine").agg(F.sum("size").alias("_sum"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bands = cells.groupBy("place", "_coarse").agg(F.sum("_sum").alias("_sum"))
    bands = bands.select(
        "place", "_coarse", F.coalesce(F.sum("_sum").over(_over(before, ["place"], "_coarse")), F.lit(0)).alias("_band")
    )
    cells = cells.select(
        "place",
        "_coarse",
        "_fine",
        F.coalesce(F.sum("_sum").over(_over(before, ["place", "_coarse"], "_fine")), F.lit(0)).alias("_cell"),
    )
    starts = cells.join(bands, ["place", "_coarse"]).select("place", "_coarse", "_fine", (F.col("_band") + F.col("_cell")).alias("_start"))
    inner = Window.partitionBy("place", "_coarse", "_fine").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    ranked = ranked.join(starts, ["place", "_coarse", "_fine"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start") - F.col("_inside")))
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "epochs"
    )


def _over(frame, keys: Sequence[str], order: str):
    return frame.partitionBy(*keys).orderBy(order)
