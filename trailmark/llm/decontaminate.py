"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds, runs of MIN_TILE
words. Pairs whose seeds could cover enough of the item are tiled: the longest
unmarked common run of words is marked, again and again, so that an item is
found whatever the order its parts stand in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: words a tile has at least; shorter common runs say nothing
MIN_TILE = 5
#: share of an item's words that tiles must cover
COVERAGE = 0.6
#: characters of benchmark text that one pass over the documents holds in a task
BLOCK_CHARS = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``length`` ids, by doubling windows."""
    count = len(ids) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    part, width, power = ids.astype(np.uint64), 1, BASE
    result, done, left = None, 0, length
    while left:
        if left & 1:
            piece = part[done : done + count]
            result = piece.copy() if result is None else result * power + piece
            done += width
        left >>= 1
        if left:
            part = part[: len(part) - width] * power + part[width:]
            with np.errstate(over="ignore"):
                width, power = width * 2, power * power
    return result


def tiles_of(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: item start, doc start and length of every tile, longest first.

    Ids of 0 match nothing. A common unmarked run of some length implies shorter
    ones, so bisection over hashed windows finds the longest length. Every
    unmarked item window of that length then takes the first unmarked document
    window that is equal to it word by word, and both are marked. Windows of one hash
    share a list of document starts that is walked once, so that repetitive
    texts cost no more than others.
    """
    free_item, free_doc = item > 0, doc > 0
    tiles = []
    most = min(len(item), len(doc))
    while True:
        low, high, found = least, most, None
        while low <= high:
            middle = (low + high + 1) // 2 if found is not None else low
            windows = _common(item, doc, free_item, free_doc, middle)
            if windows is not None:
                found, low = (middle, windows), middle + 1
            else:
                high = middle - 1
        if found is None:
            return tiles
        most, (at, first, last, places) = found
        walked: dict[int, int] = {}
        for i, a, b in zip(at.tolist(), first.tolist(), last.tolist()):
            if not free_item[i : i + most].all():
                continue
            walk = walked.get(a, a)
            while walk < b and not free_doc[places[walk] : places[walk] + most].all():
                walk += 1
            walked[a] = walk
            for d in places[walk:b].tolist():  # the first is equal, unless two windows share a hash
                if np.array_equal(item[i : i + most], doc[d : d + most]) and free_doc[d : d + most].all():
                    tiles.append((i, d, most))
                    free_item[i : i + most] = False
                    free_doc[d : d + most] = False
                    break


def _common(item, doc, free_item, free_doc, length: int) -> tuple[np.ndarray, ...] | None:
    """Unmarked item windows that some unmarked document window equals: their starts, and where their hash's document
    starts begin and end in the last array. None if there is no such pair."""

    def windows(ids, free):
        hashes = window_hashes(ids, length)
        taken = np.concatenate([[0], np.cumsum(~free)])
        starts = np.flatnonzero(taken[length:] == taken[: len(taken) - length])
        return hashes[starts], starts

    own, at = windows(item, free_item)
    other, places = windows(doc, free_doc)
    order = np.argsort(other, kind="stable")
    other, places = other[order], places[order]
    first, last = np.searchsorted(other, own, "left"), np.searchsorted(other, own, "right")
    hit = np.flatnonzero(last > first)
    for k in hit:  # ends at the first, unless two windows share a hash
        i = at[k]
        if any(np.array_equal(item[i : i + length], doc[d : d + length]) for d in places[first[k] : last[k]]):
            return at[hit], first[hit], last[hit], places
    return None


@dataclass
class SeedIndex:
    """Seeds of a block of items: sorted hashes, each with the item positions it stands at."""

    items: list[tuple[object, str]]
    least: int = MIN_TILE

    def build(self) -> SeedIndex:
        self.vocabulary: dict[str, int] = {}
        add = self.vocabulary.setdefault
        self.ids = [np.array([add(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64) for _, text in self.items]
        hashes = [window_hashes(ids, self.least) for ids in self.ids]
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        self.place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owner, self.place = self.hashes[order], self.owner[order], self.place[order]
        return self

    def matches(self, text: str | None, coverage: float) -> list[dict]:
        """The items that tiles of the text cover to ``coverage`` or more."""
        words = words_of(text)
        if len(words) < self.least or not len(self.hashes):
            return []
        get = self.vocabulary.get
        doc = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        known = np.concatenate([[0], np.cumsum(doc == 0)])
        starts = np.flatnonzero(known[self.least :] == known[: -self.least])
        if not len(starts):
            return []
        own = window_hashes(doc, self.least)[starts]
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        hit = self.hashes[at] == own
        if not hit.any():
            return []
        seeds = np.unique(own[hit])
        first, last = np.searchsorted(self.hashes, seeds, "left"), np.searchsorted(self.hashes, seeds, "right")
        rows = np.concatenate([np.arange(a, b) for a, b in zip(first, last)])
        found = []
        for owner in np.unique(self.owner[rows]):
            mine = rows[self.owner[rows] == owner]
            item = self.ids[owner]
            covered = np.zeros(len(item), bool)
            for k in range(self.least):
                covered[self.place[mine] + k] = True
            if covered.sum() < coverage * len(item):
                continue  # tiles consist of seeds, so they cover no more than this
            near = np.zeros(len(doc), bool)
            places = starts[hit][np.isin(own[hit], self.hashes[mine])]
            for k in range(self.least):
                near[places + k] = True
            # words outside of seeds cannot be in a tile; one zero stands for each run of them
            keep = near | np.concatenate([[False], near[:-1]])
            origin = np.flatnonzero(keep)
            tiles = tiles_of(item, np.where(near, doc, 0)[origin], self.least)
            share = sum(n for *_, n in tiles) / len(item)
            if share >= coverage:
                marks = [{"item_start": i, "doc_start": int(origin[d]), "length": n} for i, d, n in sorted(tiles)]
                found.append({"item_id": self.items[owner][0], "coverage": share, "tiles": marks})
        return sorted(found, key=lambda m: (m["item_id"] is not None, m["item_id"]))


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in hash-dealt blocks of about ``block_chars``; each is all that a pass has to hold."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // block_chars + 1
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield sorted((tuple(r) for r in dealt.filter(F.col("_block") == block).select("item_id", "text").collect()), key=str)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    least: int = MIN_TILE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Pairs of a document and a benchmark item that tiles cover to ``coverage`` or more.

    Words are runs of letters, digits and underscores in lower case. Each block
    of items is sent to the tasks and joined to all documents on shared seeds,
    without a shuffle, however often a passage occurs. Items with null text or
    fewer words than ``least`` cannot be tiled and match nothing; repeated rows
    of either side give a pair each. Null texts match nothing.

    Returns doc_id, item_id, coverage, tiles (item_start, doc_start, length in words).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind, item_kind = rows.schema["doc_id"].dataType, benchmark.schema[item_col].dataType
    tile = "struct<item_start:int,doc_start:int,length:int>"
    schema = f"doc_id {kind.simpleString()}, matches array<struct<item_id:{item_kind.simpleString()},coverage:double,tiles:array<{tile}>>>"
    found = None
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_chars):
        part = rows.mapInArrow(_pairs(items, coverage, least, to_arrow_type(item_kind)), schema)
        found = part if found is None else found.unionByName(part)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def _pairs(items, coverage, least, item_kind):
    tile = pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])
    match = pa.list_(pa.struct([("item_id", item_kind), ("coverage", pa.float64()), ("tiles", pa.list_(tile))]))

    def run(batches):
        index = SeedIndex(items, least).build()
        for batch in batches:
            found = [(i, m) for i, m in enumerate(index.matches(t, coverage) for t in batch.column(1).to_pylist()) if m]
            ids = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([m for _, m in found], match)], ["doc_id", "matches"])

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_TILE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that no benchmark item covers."""
    place = docs.columns.index(text_col)
    for items in benchmark_blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(_clean(items, coverage, least, place), docs.schema)
    return docs


def _clean(items, coverage, least, place):
    def run(batches):
        index = SeedIndex(items, least).build()
        for batch in batches:
            yield batch.filter(pa.array([not index.matches(t, coverage) for t in batch.column(place).to_pylist()], pa.bool_()))

    return run
