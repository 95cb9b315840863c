"""Order-dependent building blocks that never put a whole group or a whole table in one task.

* :func:`dense_index` - 0-based position in a total order (range shuffle + partition offsets).
* :func:`keys_at_ranks` - the rows at given positions, by repeated sampling of pivots.
* :func:`split_at` - cut a table at given positions using only comparisons with those rows.
* :func:`running_totals` - prefix sums over a whole table.
* :class:`Lanes` - per-key window functions whose hot keys are cut into ordered lanes.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from trailmark.storage import materialise

PLACE, PART, COPY, TIE, RANGE = "_tm_place", "_tm_part", "_tm_copy", "_tm_tie", "_tm_range"  # internal columns; input may not have them
POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in its lower 33 bits
DRIVER_ROWS = 50_000  # rows of order keys the driver may hold to finish a rank search
PIVOT_SAMPLE = 4_000
HOT_GROUP_ROWS = 2_000_000  # rows of one key a single window task may sort
LANE_SAMPLE = 500_000
CUTS_PER_BLOCK = 64


# ---------------------------------------------------------------- whole-table order


def _placed(frame: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Range-partition and sort ``frame`` by ``order`` and store where each row landed."""
    return materialise(_numbered(frame.repartitionByRange(*order).sortWithinPartitions(*order)), label)


def _numbered(frame: DataFrame) -> DataFrame:
    """Add where each row stands: its partition, and its place within it in the lower bits."""
    clash = {PLACE, PART, COPY} & set(frame.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are used internally")
    return frame.withColumn(PLACE, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(PLACE, POSITION_BITS).cast("int"))


def _part_offsets(spark: SparkSession, sizes: list[Row], names: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums of per-partition totals: one row per partition."""
    fractional = {n for row in sizes for n in names if isinstance(row[n], float)}
    running = {n: 0.0 if n in fractional else 0 for n in names}
    rows = []
    for row in sorted(sizes, key=lambda r: r[PART]):
        rows.append((row[PART], *(running[n] for n in names)))
        for n in names:
            running[n] += row[n]
    schema = f"{PART} int, " + ", ".join(f"_before_{n} {'double' if n in fractional else 'long'}" for n in names)
    return spark.createDataFrame(rows, schema)


def dense_index(frame: DataFrame, order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: the position of each row in the total order ``order``, counted from ``start``."""
    stored = _placed(frame, order, "index")
    sizes = stored.groupBy(PART).agg(F.count("*").alias("n")).collect()
    offsets = _part_offsets(frame.sparkSession, sizes, ["n"])
    in_part = F.col(PLACE).bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (
        stored.join(F.broadcast(offsets), PART)
        .withColumn(name, in_part + F.col("_before_n") + F.lit(start))
        .select(*frame.columns, name)
    )


def running_totals(frame: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Add inclusive prefix sums over the whole table; ``sums`` maps new column to summed column.

    ``order`` must be unique per row, so that the range shuffle can spread the rows.
    """
    stored = _placed(frame, order, "running")
    sizes = stored.groupBy(PART).agg(*(F.sum(c).alias(n) for n, c in sums.items())).collect()
    offsets = _part_offsets(frame.sparkSession, sizes, list(sums))
    window = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    return (
        stored.join(F.broadcast(offsets), PART)
        .select(
            *frame.columns,
            *((F.sum(c).over(window) + F.col(f"_before_{n}")).alias(n) for n, c in sums.items()),
        )
    )


# ---------------------------------------------------------------- rank selection


@dataclass(frozen=True)
class RankKey:
    """The row found at a position: its order key, the rows before that key and its copies."""

    key: tuple
    before: int
    copies: int


def _literal(schema: T.StructType, order: Sequence[str], key: Sequence[Any]) -> Column:
    return F.struct(*(F.lit(v).cast(schema[c].dataType).alias(c) for c, v in zip(order, key)))


def _row(order: Sequence[str]) -> Column:
    return F.struct(*order)


def _key(row: Sequence[Any]) -> tuple:
    """Sort key with nulls first, as Spark orders them."""
    return tuple((v is not None, v if v is not None else 0) for v in row)


@dataclass(frozen=True)
class _Range:
    """Candidates strictly between ``low`` and ``high``: ``size`` rows after ``below`` smaller ones."""

    low: tuple | None
    high: tuple | None
    below: int
    size: int

    def inside(self, schema: T.StructType, order: Sequence[str]) -> Column:
        """The first order column is compared on its own as well, so that the scan can skip data.

        Nulls come first: they are above no bound and below every other value.
        """
        lead, row, test = F.col(order[0]), _row(order), F.lit(True)
        if self.low is not None:
            test = test & (row > _literal(schema, order, self.low))
            if self.low[0] is not None:
                test = test & (lead >= F.lit(self.low[0]))
        if self.high is not None:
            test = test & (row < _literal(schema, order, self.high))
            test = test & (lead.isNull() if self.high[0] is None else lead.isNull() | (lead <= F.lit(self.high[0])))
        return test


def keys_at_ranks(
    frame: DataFrame, order: Sequence[str], ranks: Sequence[int], total: int | None = None
) -> dict[int, RankKey]:
    """Exact rows at the 0-based ``ranks`` of ``frame`` sorted by ``order``.

    The candidate range is narrowed around each rank with sampled pivots and
    exact counts until at most ``DRIVER_ROWS`` order keys are left to sort, so
    neither a global sort nor a large collect happens. All ranges share the
    passes: a round is one pass that fetches the rows of short ranges and a
    sample of the others, and one that counts around all pivots.
    """
    keys = frame.select(*order)
    if total is None:
        total = keys.count()
    wanted = sorted(set(ranks))
    if wanted and not (0 <= wanted[0] and wanted[-1] < total):
        raise ValueError(f"ranks {wanted} outside 0..{total - 1}")
    found: dict[int, RankKey] = {}
    open_ranges = {_Range(None, None, 0, total): wanted} if wanted else {}
    attempt, short = 0, max(DRIVER_ROWS, PIVOT_SAMPLE)
    while open_ranges:
        attempt += 1
        spans = list(open_ranges)
        shares = [1.0 if span.size <= short else min(1.0, PIVOT_SAMPLE / span.size) for span in spans]
        fetched = _fetch(keys, order, spans, shares, attempt)
        narrowed: dict[_Range, list[int]] = {}
        pivots: dict[tuple[_Range, int], tuple[tuple, tuple]] = {}
        for span, rows in zip(spans, fetched):
            inside = open_ranges[span]
            if span.size <= short:
                found.update(_sorted_ranks(rows, span, inside))
            elif rows:
                pivots |= {(span, rank): pair for rank, pair in _pivots(rows, span, inside).items()}
            else:
                narrowed[span] = inside
        for rank, outcome in _brackets(keys, order, pivots).items():
            if isinstance(outcome, RankKey):
                found[rank] = outcome
            else:
                narrowed.setdefault(outcome, []).append(rank)
        open_ranges = narrowed
    return found


def _fetch(keys: DataFrame, order: Sequence[str], spans: Sequence[_Range], shares: Sequence[float], seed: int) -> list[list[tuple]]:
    """Sampled order keys of every range, all in one pass.

    Ranges of neighbouring ranks may overlap: a row counts for each range it is in.
    """
    tests = [span.inside(keys.schema, order) for span in spans]
    within = F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in enumerate(tests))))
    rows = keys.filter(reduce(Column.__or__, tests)).select(*order, F.explode(within).alias(RANGE))
    if min(shares) < 1.0:
        rows = rows.filter(F.rand(seed) < F.element_at(F.array(*(F.lit(s) for s in shares)), F.col(RANGE) + 1))
    result: list[list[tuple]] = [[] for _ in spans]
    for row in rows.collect():
        result[row[RANGE]].append(tuple(row)[:-1])
    return result


def _sorted_ranks(candidates: list[tuple], span: _Range, ranks: Sequence[int]) -> dict[int, RankKey]:
    """Answer from the few candidates left, sorted by the driver."""
    rows = sorted((_key(r), r) for r in candidates)
    marks = [mark for mark, _ in rows]
    result = {}
    for rank in ranks:
        mark, key = rows[rank - span.below]
        first = bisect_left(marks, mark)
        result[rank] = RankKey(key, span.below + first, bisect_right(marks, mark) - first)
    return result


def _pivots(sampled: list[tuple], span: _Range, ranks: Sequence[int]) -> dict[int, tuple[tuple, tuple]]:
    """Two sampled rows that most likely enclose each rank."""
    sample = sorted(sampled, key=_key)
    margin = 2 + 2 * math.sqrt(len(sample))
    pivots = {}
    for rank in ranks:
        centre = (rank - span.below) / span.size * len(sample)
        pivots[rank] = (sample[max(0, min(len(sample) - 1, int(centre - margin)))], sample[min(len(sample) - 1, int(centre + margin))])
    return pivots


def _brackets(keys: DataFrame, order: Sequence[str], pivots: dict[tuple[_Range, int], tuple[tuple, tuple]]) -> dict[int, RankKey | _Range]:
    """Count exactly how many rows the pivots of every rank enclose, in one pass, and narrow each range.

    The new range leaves the pivots out, so it shrinks even when few values fill it.
    """
    if not pivots:
        return {}
    row, schema = _row(order), keys.schema
    spans = {span for span, _ in pivots}
    counts = []
    for (span, _), pair in pivots.items():
        inside = span.inside(schema, order)
        for pivot in pair:
            at = _literal(schema, order, pivot)
            counts += [F.count_if(inside & (row < at)), F.count_if(inside & (row <= at))]
    counted = keys.filter(reduce(Column.__or__, (span.inside(schema, order) for span in spans))).agg(*counts).first()
    result: dict[int, RankKey | _Range] = {}
    for i, ((span, rank), (first, last)) in enumerate(pivots.items()):
        under_first, upto_first, under_last, upto_last = (span.below + n for n in counted[4 * i : 4 * i + 4])
        if under_first <= rank < upto_first:
            result[rank] = RankKey(first, under_first, upto_first - under_first)
        elif under_last <= rank < upto_last:
            result[rank] = RankKey(last, under_last, upto_last - under_last)
        elif rank < under_first:
            result[rank] = _Range(span.low, first, span.below, under_first - span.below)
        elif rank >= upto_last:
            result[rank] = _Range(last, span.high, upto_last, span.below + span.size - upto_last)
        else:
            result[rank] = _Range(first, last, upto_first, under_last - upto_first)
    return result


def split_at(frame: DataFrame, order: Sequence[str], cuts: Sequence[int], name: str, total: int | None = None) -> DataFrame:
    """Add ``name``: how many of the positions ``cuts`` lie at or before the row.

    A cut at ``c`` separates the first ``c`` rows from the rest. Each cut costs
    one rank search; the result is a plain projection of ``frame``, which is read
    several times: store it first when it is costly to compute. Rows equal in
    every order column follow each other by a hash of their other columns, so
    that storage order plays no part; identical rows are numbered.
    """
    if TIE in frame.columns or name in frame.columns:
        raise ValueError(f"column {TIE if TIE in frame.columns else name} exists already")
    others = [c for c in frame.columns if c not in order]
    if others:
        marked = frame.withColumn(TIE, F.xxhash64(*others))
        return _split_at(marked, [*order, TIE], cuts, name, total).drop(TIE)
    return _split_at(frame, order, cuts, name, total)


def _split_at(frame: DataFrame, order: Sequence[str], cuts: Sequence[int], name: str, total: int | None) -> DataFrame:
    if total is None:
        total = frame.count()
    inner = [c for c in cuts if 0 < c < total]
    passed = F.lit(sum(1 for c in cuts if c <= 0))
    if not inner:
        return frame.withColumn(name, passed.cast("int"))
    schema, row = frame.schema, _row(order)
    found = keys_at_ranks(frame, order, [c - 1 for c in inner], total)
    shared: dict[tuple, list[int]] = {}
    for cut in inner:
        at = found[cut - 1]
        passed = passed + (row > _literal(schema, order, at.key)).cast("int")
        room = cut - at.before
        if room < at.copies:
            shared.setdefault(at.key, []).append(room)
    result = frame.withColumn(name, passed.cast("int"))
    for key, rooms in shared.items():
        same = row == _literal(schema, order, key)
        numbered = _number_copies(result.filter(same))
        late = sum((F.col(COPY) >= F.lit(room)).cast("int") for room in rooms)
        copies = numbered.withColumn(name, (F.col(name) + late).cast("int")).drop(COPY)
        result = result.filter(~same).unionByName(copies)
    return result


def _number_copies(frame: DataFrame) -> DataFrame:
    """Number rows in storage order; used only where the rows are interchangeable."""
    stored = materialise(_numbered(frame), "copies")
    sizes = stored.groupBy(PART).agg(F.count("*").alias("n")).collect()
    offsets = _part_offsets(frame.sparkSession, sizes, ["n"])
    in_part = F.col(PLACE).bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (
        stored.join(F.broadcast(offsets), PART)
        .withColumn(COPY, in_part + F.col("_before_n"))
        .select(*frame.columns, COPY)
    )


def percentiles(frame: DataFrame, value: str, fractions: Sequence[float], method: str = "linear") -> dict[float, float]:
    """Exact percentiles of a column, ``linear`` interpolated or ``nearest`` rank; null when empty.

    The column is stored first, since the rank search reads it several times.
    """
    present = materialise(frame.select(value).filter(F.col(value).isNotNull()), "values")
    total = present.count()
    if total == 0:
        return {q: None for q in fractions}
    places = {q: q * (total - 1) for q in fractions}
    if method == "nearest":
        wanted = {q: (math.floor(p + 0.5),) * 2 for q, p in places.items()}
    else:
        wanted = {q: (math.floor(p), math.ceil(p)) for q, p in places.items()}
    found = keys_at_ranks(present, [value], [r for pair in wanted.values() for r in pair], total)
    result = {}
    for q, (lower, upper) in wanted.items():
        low, high = float(found[lower].key[0]), float(found[upper].key[0])
        result[q] = low + (high - low) * (places[q] - lower) if upper > lower else low
    return result


# ---------------------------------------------------------------- per-key windows


def hot_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.trailmark.hotGroupRows", str(HOT_GROUP_ROWS)))


class Lanes:
    """Window functions per key that stay balanced when one key holds much of the table.

    Keys up to ``hot_group_rows`` rows use an ordinary window. A larger key is
    cut into consecutive lanes at sampled order values; windows run inside
    (key, lane) and what crosses a lane border - the last row, a running sum -
    is carried over from one summary row per lane. ``order`` must be total.
    """

    def __init__(self, frame: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        self.columns = list(frame.columns)
        cuts = _lane_cuts(frame, self.keys, self.order)
        self.split = cuts is not None
        self.frame = _assign_lanes(frame, self.keys, self.order, cuts) if self.split else frame

    @property
    def groups(self) -> list[str]:
        return [*self.keys, "_lane"] if self.split else self.keys

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.groups).orderBy(*self.order)

    def result(self) -> DataFrame:
        return self.frame.drop("_lane")

    def _settle(self) -> None:
        """Store the frame before a second pass over it, so lane summaries do not repeat the work."""
        self.frame = materialise(self.frame, "lanes")

    def _with_carry(self, carry: DataFrame) -> None:
        self.frame = join_keys(self.frame, F.broadcast(carry), self.groups, "left")

    def _lane_rows(self, *aggregates: Column) -> DataFrame:
        """One row per lane of the hot keys; bounded by the number of cuts."""
        return self.frame.filter(F.col("_lane") >= 0).groupBy(*self.groups).agg(*aggregates)

    def _lane_window(self, direction: str = "asc") -> WindowSpec:
        lane = F.col("_lane").asc() if direction == "asc" else F.col("_lane").desc()
        return Window.partitionBy(*self.keys).orderBy(lane)

    def neighbour(self, values: dict[str, str], offset: int) -> Lanes:
        """Add columns holding the value of the previous (-1) or next (+1) row of the key."""
        if offset not in (-1, 1):
            raise ValueError("offset must be -1 or 1")
        shift = F.lag if offset == -1 else F.lead
        local = {n: shift(c).over(self.window) for n, c in values.items()}
        if not self.split:
            self.frame = self.frame.withColumns(local)
            return self
        self._settle()
        pick = F.max_by if offset == -1 else F.min_by
        packed = F.struct(*(F.col(c).alias(n) for n, c in values.items()))
        edge = self._lane_rows(pick(packed, _row(self.order)).alias("_edge"))
        carry = edge.select(*self.groups, F.lag("_edge").over(self._lane_window("asc" if offset == -1 else "desc")).alias("_carry"))
        own = Window.partitionBy(*self.groups).orderBy(*self.order)
        at_border = F.col("_carry").isNotNull() & shift(F.lit(1)).over(own).isNull()
        self._with_carry(carry)
        self.frame = self.frame.withColumns(
            {n: F.when(at_border, F.col(f"_carry.{n}")).otherwise(local[n]) for n in values}
        ).drop("_carry")
        return self

    def running_sum(self, name: str, value: str) -> Lanes:
        """Add the inclusive running sum of ``value`` within the key."""
        local = F.sum(value).over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        if not self.split:
            self.frame = self.frame.withColumn(name, local)
            return self
        self._settle()
        totals = self._lane_rows(F.sum(value).alias("_sum"))
        before = F.sum("_sum").over(self._lane_window().rowsBetween(Window.unboundedPreceding, -1))
        self._with_carry(totals.select(*self.groups, before.alias("_carry")))
        self.frame = self.frame.withColumn(name, local + F.coalesce("_carry", F.lit(0))).drop("_carry")
        return self

    def row_number(self, name: str) -> Lanes:
        """Add the 1-based position of the row within the key."""
        local = F.row_number().over(self.window).cast("long")
        if not self.split:
            self.frame = self.frame.withColumn(name, local)
            return self
        totals = self._lane_rows(F.count("*").alias("_sum"))
        before = F.sum("_sum").over(self._lane_window().rowsBetween(Window.unboundedPreceding, -1))
        self._with_carry(totals.select(*self.groups, before.alias("_carry")))
        self.frame = self.frame.withColumn(name, local + F.coalesce("_carry", F.lit(0))).drop("_carry")
        return self

    def last_known(self, values: dict[str, str], inclusive: bool = True) -> Lanes:
        """Add the latest non-null value up to the row (or strictly before it)."""
        frame_end = 0 if inclusive else -1
        window = self.window.rowsBetween(Window.unboundedPreceding, frame_end)
        local = {n: F.last(c, ignorenulls=True).over(window) for n, c in values.items()}
        if not self.split:
            self.frame = self.frame.withColumns(local)
            return self
        self._settle()
        tails = self._lane_rows(
            *(F.max_by(c, F.when(F.col(c).isNotNull(), _row(self.order))).alias(f"_tail_{n}") for n, c in values.items())
        )
        earlier = self._lane_window().rowsBetween(Window.unboundedPreceding, -1)
        self._with_carry(
            tails.select(
                *self.groups,
                *(F.last(f"_tail_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in values),
            )
        )
        self.frame = self.frame.withColumns({n: F.coalesce(local[n], F.col(f"_carry_{n}")) for n in values}).drop(
            *(f"_carry_{n}" for n in values)
        )
        return self


def join_keys(frame: DataFrame, small: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys of which null equals null; the keys of ``small`` are left out."""
    named = small.withColumnsRenamed({k: f"_tm_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_tm_{k}"))
    return frame.join(named, same, how).drop(*(f"_tm_{k}" for k in keys))


def _lane_cuts(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame | None:
    """Cut points of the hot keys, null among them, or None when no key is hot.

    There are at most as many hot keys as the table holds times the limit, and
    about as many cuts. The sample only places the cuts.
    """
    spark = frame.sparkSession
    limit = hot_group_rows(spark)
    hot = (
        frame.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > limit)
        .collect()
    )
    if not hot:
        return None
    sizes = {tuple(r[k] for k in keys): r["_rows"] for r in hot}
    key_schema = T.StructType([frame.schema[k] for k in keys])
    hot_frame = spark.createDataFrame(list(sizes), key_schema)
    fraction = min(1.0, 50 / limit, LANE_SAMPLE / sum(sizes.values()))
    slim = frame.select(*keys, *(c for c in order if c not in keys))
    sample = join_keys(slim, F.broadcast(hot_frame), keys, "left_semi").sample(fraction=fraction, seed=7).collect()
    points: dict[tuple, list[tuple]] = {}
    for r in sample:
        points.setdefault(tuple(r[k] for k in keys), []).append(tuple(r[c] for c in order))
    rows = []
    for key, size in sizes.items():
        ordered = sorted(set(points.get(key, [])), key=_key)
        lanes = min(math.ceil(size / limit), len(ordered) + 1)
        cuts = sorted({ordered[i * len(ordered) // lanes] for i in range(1, lanes)}, key=_key)
        rows.append((*key, cuts, cuts[CUTS_PER_BLOCK - 1 :: CUTS_PER_BLOCK]))
    cut_type = T.ArrayType(T.StructType([frame.schema[c] for c in order]))
    schema = T.StructType([*key_schema.fields, T.StructField("_cuts", cut_type), T.StructField("_blocks", cut_type)])
    return spark.createDataFrame(rows, schema)


def _assign_lanes(frame: DataFrame, keys: list[str], order: list[str], cuts: DataFrame) -> DataFrame:
    """Add ``_lane``: the number of cuts at or before the row; -1 for keys that are not cut."""
    row = _row(order)
    blocks = F.size(F.filter("_blocks", lambda c: c <= row))
    block = F.slice("_cuts", blocks * CUTS_PER_BLOCK + 1, F.lit(CUTS_PER_BLOCK))
    lane = blocks * CUTS_PER_BLOCK + F.size(F.filter(block, lambda c: c <= row))
    return (
        join_keys(frame, F.broadcast(cuts), keys, "left")
        .withColumn("_lane", F.when(F.col("_cuts").isNull(), F.lit(-1)).otherwise(lane))
        .drop("_cuts", "_blocks")
    )
