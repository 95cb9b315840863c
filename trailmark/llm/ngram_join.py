"""Exact Jaccard components over word n-grams, filtered by several global token orders.

Under any global order of the tokens, two sets with enough in common share a
token among the first ones of each. One order, which puts rare tokens first,
makes the candidates; they must also share a first token under the other orders
before the sets are compared.

The first order: tokens with a small hash ("near" tokens), those that can link
no two sets before all others and these by the number of sets that hold them,
then all other tokens by hash, and last the most frequent ones. Only near tokens
have to be counted for it. Any choice of near and frequent tokens gives the same
result; they decide the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmark.llm.components import components
from trailmark.storage import discard, materialise

#: near tokens, as a multiple of the share of a set that its first tokens make up
NEAR = 1.25
#: frequent tokens that the order knows, and the copies within a chunk that make a token one
FREQUENT, CHUNK_TOKENS, CHUNK_COPIES = 65_536, 500_000, 8
STAR_ROUNDS = 2
#: a bucket of more sets is crowded; tokens that only one set of the crowded buckets has are counted
CROWD = 24
#: parts that tokens fall into when what two sets of a crowded bucket can share is bounded, and the most that a part can tell
CELLS, CELL_MOST = 64, 127
#: sets and shingles, about, in a block of a component whose pairs are counted
BLOCK_SETS, BLOCK_SHINGLES = 1_000, 500_000
#: rows of ids that may be broadcast to thin a scan; more are joined by a shuffle
BROADCAST_ROWS = 1_000_000
OTHER_ORDERS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_TURN = np.uint64(33)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range, one to one."""
    values = (values ^ (values >> _TURN)) * _M1
    values = (values ^ (values >> _TURN)) * _M2
    return values ^ (values >> _TURN)


class WordHashes(dict):
    """64-bit hash per word, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of a text.

    A-Z are lower-cased; words are split at ASCII white space. A text of fewer
    than ``n`` words is one shingle, one without words has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    count = len(words) - width + 1
    run = np.full(count, width, np.uint64)
    for k in range(width):
        run = mixed(run * _M2 + codes[k : k + count])
    return np.unique(run)


def first_tokens(size: int, percent: int) -> int:
    """How many first tokens of a set of ``size`` must be looked at."""
    return size - (percent * size + 99) // 100 + 1


def _near_limit(percent: int) -> np.uint64:
    return np.uint64(min(1.0, NEAR * (100 - percent) / 100 + 0.01) * (2**64 - 2**12))


def _texts(batch: pa.RecordBatch, place: int) -> Iterator[bytes | None]:
    return iter(batch.column(place).cast(pa.binary()).to_pylist())


def _frequent_rows(n, percent):
    limit = _near_limit(percent)

    def counted(parts):
        tokens, copies = np.unique(np.concatenate(parts), return_counts=True)
        often = copies >= CHUNK_COPIES
        return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(copies[often])], ["token", "copies"])

    def run(batches):
        hashes, parts, size = WordHashes(), [], 0
        for batch in batches:
            for text in _texts(batch, 0):
                tokens = shingles(text, n, hashes)
                parts.append(tokens[: np.searchsorted(tokens, limit)])
                size += len(parts[-1])
                if size >= CHUNK_TOKENS:
                    yield counted(parts)
                    parts, size = [], 0
        if parts:
            yield counted(parts)

    return run


def _first_rows(n, percent, frequent):
    limit = _near_limit(percent)
    frequent = np.sort(np.array(frequent, np.int64).view(np.uint64))

    def is_frequent(tokens):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        return frequent[at] == tokens if len(frequent) else np.zeros(len(tokens), bool)

    def chosen(tokens):
        need = first_tokens(len(tokens), percent) if len(tokens) else 0
        near = int(np.searchsorted(tokens, limit))
        first = tokens[:near][~is_frequent(tokens[:near])]
        if len(first) < need:
            often = is_frequent(tokens)
            beyond = tokens[near:][~often[near:]]
            first = np.concatenate([first, beyond[: need - len(first)]])
            first = np.concatenate([first, tokens[often][: need - len(first)]])
            near = int((~often[:near]).sum())
        return first.view(np.int64), min(near, len(first))

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sizes, ones, twos, firsts, nears = [], [], [], [], []
            for text in _texts(batch, 3):
                tokens = shingles(text, n, hashes)
                sizes.append(len(tokens))
                ones.append(int(tokens.sum(dtype=np.uint64).view(np.int64)))
                twos.append(int(mixed(tokens + _M1).sum(dtype=np.uint64).view(np.int64)))
                first, near = chosen(tokens)
                firsts.append(first)
                nears.append(near)
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            values = pa.array(np.concatenate([np.empty(0, np.int64), *firsts]))
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(nears, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), values)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "text_hash", "size", "one", "two", "near", "first"])

    return run


def _set_rows(n, percent):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sizes, ones, twos, bodies, others = [], [], [], [], []
            for text in _texts(batch, 0):
                tokens = shingles(text, n, hashes)
                need = first_tokens(len(tokens), percent) if len(tokens) else 0
                sizes.append(len(tokens))
                ones.append(int(tokens.sum(dtype=np.uint64).view(np.int64)))
                twos.append(int(mixed(tokens + _M1).sum(dtype=np.uint64).view(np.int64)))
                bodies.append(tokens.view(np.int64))
                others.append([tokens[np.argsort(mixed(tokens ^ np.uint64(salt)), kind="stable")[:need]].view(np.int64) for salt in OTHER_ORDERS])
            longs = lambda a: pa.array(a, pa.list_(pa.int64()))
            arrays = [pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), longs(bodies), *(longs([o[k] for o in others]) for k in range(len(OTHER_ORDERS)))]
            yield pa.RecordBatch.from_arrays(arrays, ["size", "one", "two", "body", *_ORDER_COLUMNS])

    return run


_ORDER_COLUMNS = [f"order_{k}" for k in range(len(OTHER_ORDERS))]
_KEY = ["size", "one", "two"]


def _thinned(scan: DataFrame, ids: DataFrame, match: Column, how: str = "left_semi") -> DataFrame:
    """Semi or anti join that broadcasts ``ids`` up to BROADCAST_ROWS rows and shuffles beyond."""
    return scan.join(F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids, match, how)


def similar_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose ``n``-word shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Equal sets are compared once. Star rounds first link every set to one
    partner per round, the one of a random rank that is smallest among all that
    share a first token; what they join needs no further comparison, so that a
    large group of near copies costs a few comparisons per copy. All pairs of
    still different components that share a first token then pass the filters
    and are compared, so that no link is lost. Links are then counted in each
    component over all pairs of its sets, block by block.

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id of the component; null if all are null), links (all other
    distinct sets that are similar). Null texts and
    texts without words have no shingles and stay alone. Other columns are
    ignored; no rows give no rows.
    """
    return _groups(docs, n, percent, id_col, text_col, counted=True).drop("text_hash")


def _groups(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, counted: bool = False) -> DataFrame:
    """As :func:`similar_groups`, with a hash of the text to find rows again; links only where ``counted``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    frequent = slim.select("_text").mapInArrow(_frequent_rows(n, percent), "token long, copies long")
    frequent = frequent.groupBy("token").agg(F.sum("copies").alias("copies")).orderBy(F.desc("copies"), "token").limit(FREQUENT)
    frequent = [r["token"] for r in frequent.collect()]
    rows = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("_text").alias("text_hash"), "_text")
    rows = materialise(
        rows.mapInArrow(_first_rows(n, percent, frequent), f"row long, doc_id {kind}, text_hash long, size long, one long, two long, near int, first array<long>"), "firsts"
    )
    some = rows.filter("size > 0")
    sets = materialise(some.groupBy(*_KEY).agg(F.min("row").alias("set"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "sets")
    again = some.select("row", *_KEY).join(sets.filter("copies > 1"), _KEY).filter("row <> set").select(F.col("row").alias("_again"))
    again = materialise(again, "again")
    once = _thinned(some.select(F.col("row").alias("set"), "size", "near", "first"), again, F.col("set") == F.col("_again"), "left_anti")

    tokens = once.select("set", "size", "near", F.size("first").alias("held"), F.posexplode("first").alias("index", "token"))
    # a token of one set, or of two whose sizes do not allow a link, is in no link; in the order such tokens come first
    counts = tokens.groupBy("token").agg(F.count("*").alias("sets"), F.min("size").alias("low"), F.max("size").alias("high"))
    counts = counts.filter((F.col("sets") > 2) | ((F.col("sets") == 2) & (F.col("low") * 100 >= F.col("high") * percent)))
    shared = materialise(tokens.join(counts.select("token", "sets"), "token"), "shared")
    discard(again)
    need = F.col("size") - F.floor((F.col("size") * percent + 99) / 100) + 1
    unshared = F.col("held") - F.count("*").over(Window.partitionBy("set"))
    is_near = F.col("index") < F.col("near")
    place = F.row_number().over(Window.partitionBy("set").orderBy(~is_near, "sets", "token"))
    # the place in the whole set: unshared near tokens come first, and what follows the near ones is listed in order
    shared_near = F.count(F.when(is_near, 1)).over(Window.partitionBy("set"))
    at = F.when(is_near, F.col("near") - shared_near + place).otherwise(F.col("index") + 1)
    placed = shared.select("set", "size", "token", place.alias("place"), unshared.alias("alone"), at.cast("int").alias("at"))
    probes = materialise(placed.filter(F.col("place") <= need - F.col("alone")).select("token", "set", "size", "at"), "probes")
    discard(shared)

    wanted = probes.select("set").distinct().join(rows.select(F.col("row").alias("set"), F.col("doc_id").alias("_wanted"), *_KEY), "set")
    wanted = materialise(wanted, "wanted")
    texts = _thinned(slim, wanted.select("_wanted").distinct(), F.col("doc_id").eqNullSafe(F.col("_wanted")))
    bodies = texts.select("_text").mapInArrow(_set_rows(n, percent), f"size long, one long, two long, body array<long>, {', '.join(f'{c} array<long>' for c in _ORDER_COLUMNS)}")
    bodies = bodies.dropDuplicates(_KEY).join(wanted.select("set", *_KEY), _KEY)
    bodies = materialise(bodies.select("set", "size", "body", *_ORDER_COLUMNS), "bodies")
    discard(wanted)

    probes = _with_cells(probes, bodies)
    links = None
    roots = None
    for turn in range(STAR_ROUNDS + 1):
        members = probes if roots is None else _with_root(probes, roots)
        members = members.withColumn("root", F.col("set")) if roots is None else members
        pairs = _star_pairs(members, percent, turn) if turn < STAR_ROUNDS else _cross_pairs(members, percent)
        pairs = materialise(pairs, "pairs")
        found = _verified(pairs, bodies, percent)
        discard(pairs)
        links = found if links is None else links.unionByName(found)
        roots = materialise(components(links), "roots", replaces=roots)
    discard(probes)
    return _labelled(rows, sets, _link_counts(bodies, roots, percent) if counted else None, roots)


def _with_cells(probes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Add ``most`` and ``cells``: how many tokens, in all and of each of CELLS parts, a set can share with others; else null.

    Only sets of crowded buckets get them, for each other. Tokens that no second one has are not counted. In a
    family of near copies they are the edits. Two sets share at most the
    smaller count of every part, so copies with too many edits, or edits in too many places, do not meet.
    A set with more than CELL_MOST tokens in a part has no ``cells`` and is bounded by ``most`` alone.
    """
    crowded = probes.groupBy("token").agg(F.count("*").alias("sets")).filter(F.col("sets") > CROWD).select("token")
    close = materialise(probes.join(crowded, "token", "left_semi").select("set").distinct(), "crowd")
    tokens = bodies.join(close, "set", "left_semi").select("set", F.explode("body").alias("token"))
    lone = tokens.groupBy("token").agg(F.count("*").alias("sets"), F.min("set").alias("set")).filter("sets = 1")
    signed = tokens.select("set", "token", F.lit(1).alias("sign")).unionByName(lone.select("set", "token", F.lit(-1).alias("sign")))
    part = F.col("token").bitwiseAND(F.lit(CELLS - 1))
    counts = [F.sum(F.when(part == c, F.col("sign")).otherwise(0)).alias(f"c{c}") for c in range(CELLS)]
    parts = F.array(*(f"c{c}" for c in range(CELLS)))
    cells = F.when(F.array_max(parts) <= CELL_MOST, F.transform(parts, lambda c: c.cast("tinyint")))
    counted = materialise(signed.groupBy("set").agg(F.sum("sign").alias("most"), *counts).select("set", "most", cells.alias("cells")), "cells")
    capped = materialise(probes.join(counted, "set", "left").select("token", "set", "size", "at", "most", "cells"), "capped")
    for table in (probes, close, counted):
        discard(table)
    return capped


def _with_root(frame: DataFrame, roots: DataFrame, node: str = "set") -> DataFrame:
    joined = frame.join(roots.select(F.col("node").alias(node), "root"), node, "left")
    return joined.withColumn("root", F.coalesce("root", F.col(node)))


def _close(one: str, other: str, percent: int) -> Column:
    """The sizes allow the similarity, and so does what both sets can share where that is known; the dear test comes last."""
    size, size_2, most, most_2, cells, cells_2 = (F.col(f"{side}{c}") for c in ("size", "most", "cells") for side in (one, other))
    shared = F.aggregate(F.zip_with(cells, cells_2, lambda a, b: F.least(a, b)), F.lit(0), lambda total, n: total + n.cast("int"))
    enough = lambda count: count * (100 + percent) >= (size + size_2) * percent
    return (
        F.when(F.least(size, size_2) * 100 < F.greatest(size, size_2) * percent, False)
        .when(most.isNull() | most_2.isNull(), True)
        .when(~enough(F.least(most, most_2)), False)
        .when(cells.isNull() | cells_2.isNull(), True)
        .otherwise(enough(shared))
    )


def _star_pairs(members: DataFrame, percent: int, turn: int) -> DataFrame:
    """Every set with at most one partner: of the buckets it is in, the hub of smallest rank.

    The first hubs are the sets with the smallest share of tokens of their own,
    ties and later hubs are random.
    """
    own = F.coalesce(F.floor((F.col("size") - F.col("most")) * 100 / F.col("size")), F.lit(0)) if turn == 0 else F.lit(0)
    rank = F.struct(own.cast("long").alias("own"), F.xxhash64(F.lit(turn), F.col("set")).alias("draw"))
    hub = F.min(F.struct(rank.alias("rank"), F.col("set").alias("hub"), F.col("size").alias("hub_size"), F.col("most").alias("hub_most"), F.col("cells").alias("hub_cells"), F.col("root").alias("hub_root")))
    hubs = members.groupBy("token").agg(hub.alias("h")).select("token", "h.*")
    met = members.join(hubs, "token").filter((F.col("root") != F.col("hub_root")) & _close("", "hub_", percent))
    return met.groupBy(F.col("set").alias("a")).agg(F.min(F.struct("rank", "hub"))["hub"].alias("b"))


def _cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of sets of different components in a bucket whose sizes, and the token's places in both, allow a link.

    Of two linked sets, the bucket of the first token they share passes: what comes before it in either is not shared.

    Of two components in a bucket one is not its largest, so the sets outside
    of the largest meet all the others; a bucket of one component makes no pair.
    """
    groups = members.groupBy("token", "root").agg(F.count("*").alias("count"))
    largest = groups.groupBy("token").agg(F.max(F.struct("count", "root"))["root"].alias("main"), F.count("*").alias("roots"))
    mixed_buckets = members.join(largest.filter("roots > 1"), "token")
    mixed_buckets = materialise(mixed_buckets, "buckets")
    left = mixed_buckets.filter("root <> main").select("token", F.col("set").alias("a"), F.col("size").alias("a_size"), F.col("at").alias("a_at"), F.col("most").alias("a_most"), F.col("cells").alias("a_cells"), F.col("root").alias("a_root"))
    right = mixed_buckets.select("token", F.col("set").alias("b"), F.col("size").alias("b_size"), F.col("at").alias("b_at"), F.col("most").alias("b_most"), F.col("cells").alias("b_cells"), F.col("root").alias("b_root"), "main")
    either = (F.col("b_root") == F.col("main")) | (F.col("a") < F.col("b"))
    rest = lambda side: (F.col(f"{side}_size") - F.col(f"{side}_at") + 1) * (100 + percent) >= (F.col("a_size") + F.col("b_size")) * percent
    met = left.join(right, "token").filter((F.col("a_root") != F.col("b_root")) & either & rest("a") & rest("b") & _close("a_", "b_", percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The pairs that share a first token under every other order and then are similar enough."""
    def side(name: str, columns: list[str]) -> DataFrame:
        return bodies.select(F.col("set").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    both = pairs.join(side("a", _ORDER_COLUMNS), "a").join(side("b", _ORDER_COLUMNS), "b")
    for order in _ORDER_COLUMNS:
        both = both.filter(F.arrays_overlap(f"a_{order}", f"b_{order}"))
    filtered = materialise(both.select("a", "b"), "filtered")
    both = filtered.join(side("a", ["body"]), "a").join(side("b", ["body"]), "b")
    common = F.size(F.array_intersect("a_body", "b_body"))
    union = F.size("a_body") + F.size("b_body") - common
    found = materialise(both.filter(common * F.lit(100).cast("long") >= union * F.lit(percent).cast("long")).select("a", "b"), "found")
    discard(filtered)
    return found


def _link_counts(bodies: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """How many other sets each linked set is similar to (set, links).

    All links lie within components. Two sets of one component are linked;
    larger components are dealt into blocks, and each task counts the pairs of
    two blocks and tells one row per set.
    """
    members = materialise(roots.join(bodies.select(F.col("set").alias("node"), "size", "body"), "node"), "members")
    held = members.groupBy("root").agg(F.count("*").alias("sets"), F.sum("size").alias("shingles"))
    held = materialise(held, "held")
    placed = members.join(held, "root")
    pairs = placed.filter("sets = 2").select(F.col("node").alias("set"), F.lit(1).cast("long").alias("links"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = placed.filter("sets > 2").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    dealt = dealt.select("root", low, high, F.col("node").alias("set"), "block", "body").repartition("root", "low", "high")
    dealt = dealt.sortWithinPartitions("root", "low", "high", "block")
    counts = dealt.mapInArrow(_block_rows(percent), "set long, links long").groupBy("set").agg(F.sum("links").alias("links"))
    return pairs.unionByName(counts)


def _block_rows(percent):
    def told(key, sets, blocks, bodies):
        links = similar_counts(bodies, np.array(blocks), key[1] != key[2], percent)
        return pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array(links, pa.int64())], ["set", "links"])

    def run(batches):
        key, sets, blocks, bodies = None, [], [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            body = batch.column(5)
            for at, (root, low, high, node, block) in enumerate(zip(*columns)):
                if key != (root, low, high):
                    if sets:
                        yield told(key, sets, blocks, bodies)
                    key, sets, blocks, bodies = (root, low, high), [], [], []
                sets.append(node)
                blocks.append(block)
                bodies.append(body[at].values.to_numpy())
        if sets:
            yield told(key, sets, blocks, bodies)

    return run


def similar_counts(bodies: list[np.ndarray], blocks: np.ndarray, across: bool, percent: int) -> np.ndarray:
    """For each set the number of similar ones, ``across`` in other blocks only."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    owners = np.repeat(np.arange(len(bodies), dtype=np.int32), sizes)
    tokens = np.concatenate(bodies)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    starts = np.concatenate([[0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1, [len(tokens)]])
    # tokens that the same sets hold are counted together
    runs: dict[bytes, int] = {}
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a > 1:
            holders = owners[a:b].tobytes()
            runs[holders] = runs.get(holders, 0) + 1
    common = np.zeros((len(bodies), len(bodies)), np.int32)
    for holders, times in runs.items():
        held = np.frombuffer(holders, owners.dtype)
        common[held[:, None], held] += times
    # row by row, so that no second matrix is held
    counts = np.zeros(len(bodies), np.int64)
    for at, row in enumerate(common):
        shared = row.astype(np.int64)
        similar = shared * 100 >= (sizes[at] + sizes - shared) * percent
        similar[at] = False
        if across:
            similar &= blocks != blocks[at]
        counts[at] = similar.sum()
    return counts


def _labelled(rows: DataFrame, sets: DataFrame, counts: DataFrame | None, roots: DataFrame) -> DataFrame:
    placed = _with_root(sets, roots)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named, links = placed.join(least, "root"), []
    if counts is not None:
        links = [F.coalesce("links", F.lit(0)).cast("long").alias("links")]
        named = named.join(counts, "set", "left")
    named = materialise(named.select(*_KEY, "component_id", *links), "named")
    told = rows.select("doc_id", "text_hash", *_KEY).join(named, _KEY, "left")
    alone = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return told.select("doc_id", F.col("size").alias("n_shingles"), alone.alias("component_id"), *links, "text_hash")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Rows that repeat both id and text are the same document and stay together.
    """
    groups = _groups(docs, n, percent, id_col, text_col)
    going = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_going"), F.col("text_hash").alias("_hash"))
    going = materialise(going.distinct(), "going")
    match = docs[id_col].eqNullSafe(going["_going"]) & (F.xxhash64(docs[text_col]) == going["_hash"])
    return _thinned(docs, going, match, "left_anti")
