"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.storage import materialise


def _around_least(links: DataFrame) -> DataFrame:
    """For every node its neighbours with the least of them and the node itself."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return links.join(least, "u")


def _settled(stars: DataFrame) -> bool:
    twice = stars.groupBy("u").agg(F.count("*").alias("links")).filter("links > 1")
    chained = stars.join(stars.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return twice.isEmpty() and chained.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Node and root (the least node of its component) for every node in ``links`` (a, b).

    Alternates the large-star and small-star steps: each turns the neighbours
    of a node towards the least one, the first those above the node, the second
    those below. Rounds end when every node has one link, to a node without
    any. A node with very many neighbours is aggregated before the shuffle, and
    its join is split.
    """
    stars = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _settled(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _around_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = _around_least(large)
        small = below.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v")))
        stars = materialise(small.distinct(), "links", replaces=stars)
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
