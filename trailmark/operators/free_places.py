"""The n-th place a user has not taken, for any number of requests per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.ordering import Lanes


def free_places(requests: DataFrame, taken: DataFrame, key: str, rank: str, place: str, most: int | None = None) -> DataFrame:
    """Add ``place`` to ``requests``: the place numbered ``rank`` (from 0) among those their key has not taken.

    With the taken places s_0 < s_1 < ... of a key, free place r is r plus the
    number of i with s_i - i <= r. Taken places and requests are put in one
    order per key, s_i - i against r, and a running count answers all requests,
    so that their number is data and not plan; hot keys are cut into lanes.
    ``taken`` has distinct (key, place) from 0. ``most`` is the largest rank
    asked for, if known: taken places that cannot come before it are left out.
    """
    numbered = Lanes(taken.select(key, place), [key], [place]).row_number("_nth").result()
    starts = numbered.select(key, (F.col(place) - F.col("_nth") + 1).alias("_at"), F.lit(0).alias("_asks"), F.lit(1).alias("_passed_by"))
    if most is not None:
        starts = starts.filter(F.col("_at") <= most)
    asks = requests.select("*", F.col(rank).cast("long").alias("_at"), F.lit(1).alias("_asks"), F.lit(0).alias("_passed_by"))
    both = Lanes(starts.unionByName(asks, allowMissingColumns=True), [key], ["_at", "_asks"]).running_sum("_passed", "_passed_by").result()
    return both.filter("_asks = 1").select(*requests.columns, (F.col("_at") + F.col("_passed")).alias(place))
