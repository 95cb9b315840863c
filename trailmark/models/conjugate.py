"""Columns of the inverse of a large sparse symmetric matrix, by preconditioned conjugate gradients.

The matrix is kept as blocks of compressed sparse rows. The right sides are unit
vectors, a panel of them side by side, cut into the same row blocks. One round
multiplies every panel with the matrix, sums four products per column over the
row blocks and moves all columns; panels advance together. Whatever the size
of the matrix, a task sees one matrix block and one panel block at a time.

A matrix X'X + shift whose places of X fit a task needs neither X'X nor an
exchange: ``Places`` multiplies with X and with X', and ``solve_columns`` makes
all rounds of a panel in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.models.blocked import each_row, from_bytes, multiply_rows, to_bytes
from trailmark.storage import discard, materialise

ROWS = 1024  # rows and columns of a matrix block, rows of a panel block
PANEL = 512  # columns of a panel
FAN = 64  # blocks that one task sums
TOLERANCE = 1e-11  # of the residual, relative to the unit vector

COMPRESSED = "bi long, bj long, starts binary, columns binary, entries binary"
STATE = "panel long, block long, scale binary, solution binary, residual binary, direction binary"


@dataclass
class SparseBlocks:
    """A symmetric positive definite matrix of ``n`` rows in compressed blocks, with its diagonal per row block."""

    table: DataFrame
    diagonal: DataFrame
    n: int
    rows: int

    @property
    def count(self) -> int:
        return -(-self.n // self.rows)


def compress(entries: DataFrame, n: int, rows: int = ROWS) -> SparseBlocks:
    """Blocks from entries (i, j, w); both halves of the matrix and all its diagonal must be there.

    Entries of one place are added. A task compresses one block of at most
    ``rows`` squared entries.
    """
    place = lambda c: (F.col(c) / rows).cast("long")
    placed = entries.select(place("i").alias("bi"), place("j").alias("bj"), (F.col("i") % rows).cast("int").alias("i"), (F.col("j") % rows).cast("int").alias("j"), F.col("w").cast("double"))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at, where = np.unique(part["i"].to_numpy().astype(np.int64) * rows + part["j"].to_numpy(), return_inverse=True)
        values = np.bincount(where, part["w"].to_numpy(), len(at))
        starts = np.searchsorted(at // rows, np.arange(rows + 1)).astype(np.int32)
        return pd.DataFrame({"bi": [int(key[0])], "bj": [int(key[1])], "starts": [starts.tobytes()], "columns": [(at % rows).astype(np.int32).tobytes()], "entries": [to_bytes(values)]})

    def spread(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        values = np.ones(rows)  # rows past the end have an identity
        np.add.at(values, part["i"].to_numpy(), part["w"].to_numpy() - 1.0)
        return pd.DataFrame({"block": [int(key[0])], "scale": [to_bytes(values)]})

    table = materialise(placed.groupBy("bi", "bj").applyInPandas(pack, COMPRESSED), "sparse", large=True)
    own = placed.filter((F.col("bi") == F.col("bj")) & (F.col("i") == F.col("j"))).groupBy("bi", "i").agg(F.sum("w").alias("w"))
    diagonal = materialise(own.groupBy(F.col("bi").alias("block")).applyInPandas(spread, "block long, scale binary"), "diagonal")
    return SparseBlocks(table, diagonal, n, rows)


def _state_row(row: tuple, solution: np.ndarray, residual: np.ndarray, direction: np.ndarray) -> pd.DataFrame:
    own = {"panel": [row.panel], "block": [row.block], "scale": [row.scale]}
    return pd.DataFrame(own | {"solution": [to_bytes(solution)], "residual": [to_bytes(residual)], "direction": [to_bytes(direction)]})


def multiply(matrix: SparseBlocks, panels: DataFrame, vector: str) -> DataFrame:
    """The matrix times the panels (panel, block, ``vector``): rows (panel, block, product).

    Each matrix block meets the panel blocks it multiplies; the products of a
    row of blocks are added at most FAN at a time, in as many steps as that takes.
    """
    right = panels.select("panel", F.col("block").alias("bj"), F.col(vector).alias("dense"))
    matrix_rows = matrix.rows
    schema = "panel long, block long, part long, product binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in each_row(batches):
            width = len(row.dense) // (8 * matrix_rows)
            parts = np.frombuffer(row.starts, np.int32), np.frombuffer(row.columns, np.int32), np.frombuffer(row.entries)
            product = to_bytes(multiply_rows(*parts, from_bytes(row.dense, width)))
            yield pd.DataFrame({"panel": [row.panel], "block": [row.bi], "part": [row.bj], "product": [product]})

    def total(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = np.frombuffer(part["product"].iloc[0]).copy()
        for data in part["product"].iloc[1:]:
            out += np.frombuffer(data)
        return pd.DataFrame({"panel": [int(key[0])], "block": [int(key[1])], "part": [int(key[2])], "product": [out.tobytes()]})

    products, left = matrix.table.join(right, "bj").mapInPandas(run, schema), matrix.count
    while left > 1:
        left = -(-left // FAN)
        products = products.withColumn("part", (F.col("part") / FAN).cast("long")).groupBy("panel", "block", "part").applyInPandas(total, schema)
    return products.drop("part")


def sums_of(residual: np.ndarray, direction: np.ndarray, product: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Five sums per column that one move needs, over the rows of a block."""
    return np.stack([
        (residual**2 / scale).sum(0),
        (direction * product).sum(0),
        (residual * product / scale).sum(0),
        (product**2 / scale).sum(0),
        (residual**2).sum(0),
    ])


def move(solution: np.ndarray, residual: np.ndarray, direction: np.ndarray, product: np.ndarray, scale: np.ndarray, sums: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step of every column that has not converged; the others stay as they are."""
    now, along, cross, square, rest = sums
    moves = (rest > tolerance**2) & (along > 0)
    step = np.divide(now, along, out=np.zeros_like(now), where=moves)
    after = np.maximum(now - 2 * step * cross + step**2 * square, 0.0)
    turn = np.divide(after, now, out=np.zeros_like(now), where=moves)
    residual = residual - step * product
    return solution + step * direction, residual, np.where(moves, residual / scale + turn * direction, direction)


def unit_panels(matrix: SparseBlocks, first: int, count: int, width: int) -> DataFrame:
    """The start: no solution yet, unit vectors as residual, scaled by the diagonal as direction."""
    spark = matrix.table.sparkSession
    blocks, rows, n = matrix.count, matrix.rows, matrix.n
    every = spark.range(count * blocks).select((F.col("id") / blocks).cast("long").alias("panel"), (F.col("id") % blocks).alias("block"))
    placed = every.withColumn("panel", F.col("panel") + first).join(matrix.diagonal, "block")

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in each_row(batches):
            columns = np.arange(row.panel * width, min(n, (row.panel + 1) * width))
            unit = np.zeros((rows, width))
            mine = columns[(columns >= row.block * rows) & (columns < (row.block + 1) * rows)]
            unit[mine - row.block * rows, mine - row.panel * width] = 1.0
            scale = np.frombuffer(row.scale)[:, None]
            yield _state_row(row, np.zeros((rows, width)), unit, unit / scale)

    return placed.select("panel", "block", "scale").mapInPandas(start, STATE)


def solve_panels(matrix: SparseBlocks, first: int, count: int, width: int = PANEL, tolerance: float = TOLERANCE, rounds: int = 2_000) -> tuple[DataFrame, int]:
    """Columns ``first * width`` and following of the inverse, as stored rows (panel, block, solution, residual).

    Also returns the number of rounds. Every round stores its panels and deletes
    those of the round before. Raises if a column is not there after ``rounds``,
    as with a matrix that is too badly conditioned for the tolerance.
    """
    state = materialise(unit_panels(matrix, first, count, width), "panels", large=True)
    if matrix.count == 1:
        state = _solve_in_tasks(matrix, state, width, tolerance, rounds)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in each_row(batches):
            sums = sums_of(from_bytes(r.residual, width), from_bytes(r.direction, width), from_bytes(r.product, width), np.frombuffer(r.scale)[:, None])
            yield pd.DataFrame({"panel": [r.panel], "block": [r.block], "product": [r.product], "sums": [to_bytes(sums)]})

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        whole = np.sum([from_bytes(s, width) for s in part["sums"]], axis=0)
        return pd.DataFrame({"panel": [int(key[0])], "sums": [to_bytes(whole)], "worst": [float(np.sqrt(whole[4].max()))]})

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in each_row(batches):
            blocks = [from_bytes(b, width) for b in (r.solution, r.residual, r.direction, r.product)]
            yield _state_row(r, *move(*blocks, np.frombuffer(r.scale)[:, None], from_bytes(r.sums, width), tolerance))

    done = 0
    while matrix.count > 1:
        product = multiply(matrix, state, "direction").join(state.select("panel", "block", "scale", "residual", "direction"), ["panel", "block"])
        product = materialise(product.mapInPandas(products, "panel long, block long, product binary, sums binary"), "products", large=True)
        sums = materialise(product.select("panel", "sums").groupBy("panel").applyInPandas(add, "panel long, sums binary, worst double"), "sums")
        if sums.filter(F.col("worst") > tolerance).isEmpty():
            discard(product)
            discard(sums)
            break
        if done == rounds:
            raise RuntimeError(f"conjugate gradients are not at {tolerance} after {rounds} rounds; use a larger regularisation or tolerance")
        joined = state.join(product.select("panel", "block", "product"), ["panel", "block"]).join(sums.select("panel", "sums"), "panel")
        state = materialise(joined.mapInPandas(advance, STATE), "panels", replaces=state, large=True)
        discard(product)
        discard(sums)
        done += 1
    return state.select("panel", "block", "solution", "residual"), done


def _solve_in_tasks(matrix: SparseBlocks, state: DataFrame, width: int, tolerance: float, rounds: int) -> DataFrame:
    """All rounds of a matrix of one block: nothing crosses tasks, so a panel needs no exchange."""
    joined = state.join(matrix.table.select("starts", "columns", "entries", F.col("bj").alias("block")), "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for r in each_row(batches):
            parts = np.frombuffer(r.starts, np.int32), np.frombuffer(r.columns, np.int32), np.frombuffer(r.entries)
            scale = np.frombuffer(r.scale)[:, None]
            blocks = [from_bytes(b, width) for b in (r.solution, r.residual, r.direction)]
            for _ in range(rounds + 1):
                product = multiply_rows(*parts, blocks[2])
                sums = sums_of(blocks[1], blocks[2], product, scale)
                if np.sqrt(sums[4].max()) <= tolerance:
                    break
                blocks = move(*blocks, product, scale, sums, tolerance)
            else:
                raise RuntimeError(f"conjugate gradients are not at {tolerance} after {rounds} rounds; use a larger regularisation or tolerance")
            yield _state_row(r, *blocks)

    return materialise(joined.mapInPandas(run, STATE), "panels", replaces=state, large=True)


SLOT_ROWS = 1024  # rows that one gathering adds to


class Places:
    """A 0/1 matrix as the places of its ones, row by row, laid out for sums of many vectors.

    Rows are sorted by their number of ones, SLOT_ROWS of them side by side; the
    t-th ones of those rows make a slot, so that a product gathers and adds whole slots.
    """

    def __init__(self, starts: np.ndarray, columns: np.ndarray) -> None:
        degrees = np.diff(starts)
        order = np.argsort(-degrees, kind="stable")
        self.rows, self.parts = len(degrees), []
        for first in range(0, int(np.count_nonzero(degrees)), SLOT_ROWS):
            some = order[first : first + SLOT_ROWS]
            some = some[degrees[some] > 0]
            filled = np.searchsorted(-degrees[some], -np.arange(1, degrees[some[0]] + 1), "right")
            self.parts.append((some, [columns[starts[some[:m]] + t].astype(np.int32) for t, m in enumerate(filled)]))

    def times(self, dense: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The product with ``dense``, written to ``out``."""
        total, more = np.empty((SLOT_ROWS, dense.shape[1])), np.empty((SLOT_ROWS, dense.shape[1]))
        out[:] = 0.0
        for rows, slots in self.parts:
            np.take(dense, slots[0], axis=0, out=total[: len(rows)], mode="clip")
            for slot in slots[1:]:
                total[: len(slot)] += np.take(dense, slot, axis=0, out=more[: len(slot)], mode="clip")
            out[rows] = total[: len(rows)]
        return out


def transposed(starts: np.ndarray, columns: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and columns of the transpose, which has ``n`` rows."""
    order = np.argsort(columns, kind="stable")
    rows = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    return np.concatenate([[0], np.cumsum(np.bincount(columns, minlength=n))]), rows[order]


def solve_columns(across: Places, down: Places, scale: np.ndarray, shift: float, columns: range, tolerance: float = TOLERANCE, rounds: int = 2_000) -> np.ndarray:
    """Columns of the inverse of X'X + ``shift``; ``across`` is X, ``down`` X' and ``scale`` the diagonal.

    The same rounds as those of :func:`solve_panels`. Holds four arrays of the
    rows of X' and one of the rows of X, of as many columns.
    """
    n, width = down.rows, len(columns)
    solution, residual, direction, product = (np.zeros((n, width)) for _ in range(4))
    between = np.empty((across.rows, width))
    residual[columns, np.arange(width)] = 1.0
    direction[columns, np.arange(width)] = 1.0 / scale[columns]
    now, rest = 1.0 / scale[columns], np.ones(width)
    cuts = [slice(at, at + SLOT_ROWS) for at in range(0, n, SLOT_ROWS)]
    for _ in range(rounds + 1):
        if np.sqrt(rest.max()) <= tolerance:
            return solution
        down.times(across.times(direction, between), product)
        along = np.zeros(width)
        for cut in cuts:
            product[cut] += shift * direction[cut]
            along += np.einsum("ij,ij->j", direction[cut], product[cut])
        moves = (rest > tolerance**2) & (along > 0)
        step = np.divide(now, along, out=np.zeros(width), where=moves)
        after, left = np.zeros(width), np.zeros(width)
        for cut in cuts:
            solution[cut] += step * direction[cut]
            residual[cut] -= step * product[cut]
            scaled = residual[cut] / scale[cut, None]
            after += np.einsum("ij,ij->j", residual[cut], scaled)
            left += np.einsum("ij,ij->j", residual[cut], residual[cut])
            product[cut] = scaled
        turn = np.divide(after, now, out=np.zeros(width), where=moves)
        for cut in cuts:
            direction[cut] = np.where(moves, product[cut] + turn * direction[cut], direction[cut])
        now, rest = after, left
    raise RuntimeError(f"conjugate gradients are not at {tolerance} after {rounds} rounds; use a larger regularisation or tolerance")


def entries_of(solved: DataFrame, n: int, rows: int, width: int) -> DataFrame:
    """The solved columns as long rows (i, j, value); for checks and small results."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                data = from_bytes(r.solution, width)
                i, j = np.indices(data.shape)
                i, j = i.ravel() + r.block * rows, j.ravel() + r.panel * width
                inside = (i < n) & (j < n)
                yield pd.DataFrame({"i": i[inside], "j": j[inside], "value": data.ravel()[inside]})

    return solved.select("panel", "block", "solution").mapInPandas(run, "i long, j long, value double")
