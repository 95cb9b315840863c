"""Masked pseudo-likelihood: a window network reads both sides of every token and predicts it.

The vocabulary comes from counts over the whole corpus. The network (summed
position embeddings, tanh, softmax) is trained in numpy on every partition from
common weights; the weights are averaged by trained tokens in Spark, ROUNDS
times. The rounds share the positions of a text, so that every token of every
text is a target once.

The network tells frequent words and buckets of rare ones. A rare word's
probability is that of its bucket times its share of the bucket's occurrences,
joined from the counts of all words, so that every word has its own. A text's
score is the sum of the log-probabilities of its words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trailmark.storage import materialise

#: the most frequent words are tokens of the network, all others share RARE of its tokens
WORDS, RARE = 192, 64
OFFSETS = (-2, -1, 1, 2)
WIDTH = 16
ROUNDS = 2  # round r trains on positions r, r + ROUNDS, ... of every text
BATCH, RATE = 512, 0.5
CHUNK = 512
FLUSH = 400_000  # counts of words a task holds before it adds them up, and passes them on if half as many are left
SLICE = 4 << 20  # bytes of text split into words at a time, unless one text is longer
PLACES = 1_000_000  # rare words of texts a task holds before it passes them on
PART = 512  # weights per row while averaging
TOKENS = WORDS + RARE
EDGE = TOKENS  # stands for what lies beyond the ends of a text
REACH = max(map(abs, OFFSETS))
LIMIT = 60  # of a logit, either way

#: shapes of the weights, in the order of the flat vector
SHAPES = ((len(OFFSETS), TOKENS + 1, WIDTH), (WIDTH,), (WIDTH, TOKENS), (TOKENS,))
#: the numbers of each row of the position embeddings in the flat table
EMBEDDED = np.arange(len(OFFSETS) * (TOKENS + 1) * WIDTH).reshape(-1, WIDTH)


class TokenIds(dict):
    """Token of a word; rare words are remembered up to a bounded number."""

    def __init__(self, words):
        super().__init__({w: i for i, w in enumerate(words)})
        self.words = dict(self)

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
            self.update(self.words)
        if word not in self:
            self[word] = WORDS + zlib.crc32(word) % RARE
        return self.get(word)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def ids_of(text: bytes | None, tokens: TokenIds) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Neighbouring texts of about SLICE bytes together, and the number of the first."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as :func:`words_of` has them, and the number of the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, owners = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    return words.filter(some).view(pa.binary()), owners.filter(some).to_numpy()


def token_ids(words: pa.Array, tokens: TokenIds) -> np.ndarray:
    """Token of each word; every different word is looked up once."""
    coded = words.dictionary_encode()
    different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    known = np.fromiter(map(tokens.words.get, different, repeat(-1)), np.int64, len(different))
    rare = WORDS + np.fromiter(map(zlib.crc32, different), np.int64, len(different)) % RARE
    return np.where(known < 0, rare, known)[coded.indices.to_numpy()]


def side_by_side(ids: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in a row with EDGE before, between and after them, and where each token stands in it."""
    at = np.arange(len(ids)) + REACH * (owners + 1)
    row = np.full((at[-1] if len(at) else 0) + 1 + REACH, EDGE)
    row[at] = ids
    return row, at


def unpacked(flat: np.ndarray) -> list[np.ndarray]:
    parts, at = [], 0
    for shape in SHAPES:
        size = int(np.prod(shape))
        parts.append(flat[at : at + size].reshape(shape))
        at += size
    return parts


def first_weights(counts: list[int], total: int, seed: int = 3) -> np.ndarray:
    """Small random embeddings; the output bias starts at the logarithm of the token shares."""
    random = np.random.default_rng(seed)
    flat = random.normal(0, 0.1, sum(int(np.prod(s)) for s in SHAPES))
    _, hidden, _, bias = unpacked(flat)
    hidden[:] = 0
    share = np.full(TOKENS, 1.0)
    share[: len(counts)] += counts
    share[WORDS:] += max(0, total - sum(counts)) / RARE
    bias[:] = np.log(share / share.sum())
    return flat.astype(np.float32)


def contexts(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Token at each offset from each place, EDGE outside of the text."""
    padded = np.concatenate([np.full(REACH, EDGE), ids, np.full(REACH, EDGE)])
    return np.stack([padded[places + REACH + o] for o in OFFSETS])


def _cells(around: np.ndarray) -> np.ndarray:
    """Row of the position embeddings, all offsets in one table, of each token of the contexts."""
    return around + np.arange(len(OFFSETS))[:, None] * (TOKENS + 1)


def _logits(parts: list[np.ndarray], around: np.ndarray, into: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hidden state and logits of all tokens, those written to the first rows of ``into``."""
    table, shift, output, bias = parts
    hidden = table.reshape(-1, WIDTH).take(_cells(around), axis=0).sum(axis=0)
    hidden += shift
    np.tanh(hidden, out=hidden)
    logits = np.matmul(hidden, output, out=None if into is None else into[: len(hidden)])
    logits += bias
    if np.abs(output).sum(axis=0).max() + np.abs(bias).max() > LIMIT:  # the hidden state is between -1 and 1
        np.clip(logits, -LIMIT, LIMIT, out=logits)
    return hidden, logits


def forward(parts: list[np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hidden state and log-probabilities of all tokens."""
    hidden, logits = _logits(parts, around)
    return hidden, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def target_log_p(parts: list[np.ndarray], around: np.ndarray, target: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of each target."""
    _, logits = _logits(parts, around, into)
    picked = logits[np.arange(len(target)), target]
    return picked - np.log(np.exp(logits, out=logits).sum(axis=1))


def learn(parts: list[np.ndarray], around: np.ndarray, target: np.ndarray, rate: float, into: np.ndarray | None = None) -> None:
    """One step of gradient descent on the mean negative log-probability."""
    table, shift, output, bias = parts
    hidden, error = _logits(parts, around, into)
    np.exp(error, out=error)
    error /= error.sum(axis=1, keepdims=True)
    error[np.arange(len(target)), target] -= 1
    size = len(target)
    if size & (size - 1):
        error /= size
    else:  # a power of two divides without rounding, so the rate can take it
        rate /= size
    back = (error @ output.T) * (1 - hidden * hidden)
    output -= rate * (hidden.T @ error)
    bias -= rate * error.sum(axis=0)
    shift -= rate * back.sum(axis=0)
    numbers = EMBEDDED.take(_cells(around), axis=0)
    step = (-rate * len(OFFSETS) * back).astype(table.dtype)
    np.add.at(table.reshape(-1), numbers.ravel(), np.broadcast_to(step, numbers.shape).ravel())


def _counted(batches):
    held, size = [], 0

    def added():
        parts = pa.Table.from_arrays([pa.chunked_array([h.field(f) for h in held]) for f in (0, 1)], ["word", "count"])
        sums = parts.group_by("word", use_threads=False).aggregate([("count", "sum")]).combine_chunks()
        return pa.StructArray.from_arrays([sums[n].chunk(0) for n in ("word", "count_sum")], ["word", "count"])

    for batch in batches:
        for _, texts in slices(batch.column(0).cast(pa.binary())):
            held.append(split_words(texts)[0].value_counts())
            size += len(held[-1])
            if size >= FLUSH:
                held = [added()]
                size = len(held[0])
                if 2 * size >= FLUSH:
                    yield pa.RecordBatch.from_struct_array(held[0])
                    held, size = [], 0
    if size:
        yield pa.RecordBatch.from_struct_array(added())


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every word of all texts and its count (word, count), stored."""
    counted = docs.select(F.col(text_col).alias("_text")).mapInArrow(_counted, "word binary, count long")
    return materialise(counted.groupBy("word").agg(F.sum("count").alias("count")), "words")


def vocabulary(counts: DataFrame) -> tuple[list[tuple[bytes, int]], int]:
    """The WORDS most frequent words with their counts, and the number of all words; ties go to the smaller word."""
    top = counts.orderBy(F.desc("count"), "word").limit(WORDS).collect()
    total = counts.agg(F.sum("count")).first()[0] or 0
    return [(bytes(r["word"]), r["count"]) for r in top], total


def within_buckets(counts: DataFrame, words: tuple[bytes, ...]) -> DataFrame:
    """Every word outside of ``words`` and the logarithm of its share of its bucket (word, within)."""
    known = counts.sparkSession.createDataFrame([(bytearray(w),) for w in words], "word binary")
    rare = counts.join(F.broadcast(known), "word", "left_anti").withColumn("bucket", F.crc32("word") % RARE)
    totals = rare.groupBy("bucket").agg(F.sum("count").alias("total"))
    return rare.join(F.broadcast(totals), "bucket").select("word", F.log(F.col("count") / F.col("total")).alias("within"))


def _trained(words, flat, turn):
    def run(batches):
        tokens, parts = TokenIds(words), unpacked(flat.copy())
        arounds, targets, waiting, seen = [], [], 0, 0
        for batch in batches:
            for _, texts in slices(batch.column(0).cast(pa.binary())):
                words_here, owners = split_words(texts)
                ids = token_ids(words_here, tokens)
                row, at = side_by_side(ids, owners)
                first = np.searchsorted(owners, np.arange(len(texts)))
                chosen = np.flatnonzero((np.arange(len(ids)) - first[owners]) % ROUNDS == turn)
                ends, start = np.cumsum(np.bincount(owners[chosen], minlength=len(texts))), 0
                while start < len(chosen):
                    # whole texts up to the one that fills what is waiting
                    full = int(np.searchsorted(ends, start + BATCH * 16 - waiting))
                    some = chosen[start : ends[min(full, len(ends) - 1)]]
                    arounds.append(np.stack([row[at[some] + o] for o in OFFSETS]))
                    targets.append(ids[some])
                    waiting, start = waiting + len(some), start + len(some)
                    if waiting >= BATCH * 16:
                        seen += _steps(parts, arounds, targets, turn)
                        arounds, targets, waiting = [], [], 0
        if waiting:
            seen += _steps(parts, arounds, targets, turn)
        if seen:
            whole = np.concatenate([p.ravel() for p in parts]).astype(np.float64)
            rows = [whole[at : at + PART] for at in range(0, len(whole), PART)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64())), pa.array([seen] * len(rows), pa.int64())], ["part", "weights", "tokens"]
            )

    return run


def _steps(parts, arounds, targets, turn) -> int:
    around, target = np.concatenate(arounds, axis=1), np.concatenate(targets)
    into = np.empty((BATCH, TOKENS), parts[2].dtype)
    for at in range(0, len(target), BATCH):
        learn(parts, around[:, at : at + BATCH], target[at : at + BATCH], RATE / (1 + turn), into)
    return len(target)


@dataclass(frozen=True)
class WindowModel:
    words: tuple[bytes, ...]
    flat: np.ndarray

    def log_probability(self, text: bytes | None, tokens: TokenIds, parts: list[np.ndarray]) -> tuple[int, float]:
        """Number of tokens and the sum of their conditional log-probabilities over the whole text; for a rare word that of its bucket."""
        ids = ids_of(text, tokens)
        told = self.log_probabilities(ids, np.zeros(len(ids), np.int64), parts)
        return len(ids), float(told.sum())

    def log_probabilities(self, ids: np.ndarray, owners: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
        """Conditional log-probability of each token of texts in a row; ``owners`` has the number of each token's text."""
        row, at = side_by_side(ids, owners)
        told, into = np.empty(len(ids)), np.empty((min(CHUNK, len(ids)), TOKENS), parts[2].dtype)
        for start in range(0, len(ids), CHUNK):
            some = at[start : start + CHUNK]
            told[start : start + CHUNK] = target_log_p(parts, np.stack([row[some + o] for o in OFFSETS]), ids[start : start + CHUNK], into)
        return told


def train(docs: DataFrame, counts: DataFrame, text_col: str = "text") -> WindowModel:
    """Train over all documents; only the frequent words and the averaged weights reach the driver."""
    counted, total = vocabulary(counts)
    words = tuple(w for w, _ in counted)
    flat = first_weights([c for _, c in counted], total)
    texts = docs.select(F.col(text_col).alias("_text"))
    for turn in range(ROUNDS):
        local = texts.mapInArrow(_trained(words, flat, turn), "part int, weights array<double>, tokens long")
        each = local.select("part", "tokens", F.posexplode("weights").alias("at", "weight"))
        mean = (F.sum(F.col("weight") * F.col("tokens")) / F.sum("tokens")).alias("weight")
        rows = each.groupBy("part", "at").agg(mean).collect()
        if rows:
            flat = flat.copy()
            flat[[r["part"] * PART + r["at"] for r in rows]] = [r["weight"] for r in rows]
    return WindowModel(words, flat)


def _scored(model: WindowModel, kind: pa.DataType):
    """A row (row, doc_id, n_tokens, log_prob) per text, and rows (word, rows): the texts of a rare word, once per occurrence."""
    names = ["row", "doc_id", "n_tokens", "log_prob", "word", "rows"]

    def places(rare):
        held = pa.table({n: pa.chunked_array(c) for n, c in zip(("word", "rows"), zip(*rare))})
        found = held.group_by("word", use_threads=False).aggregate([("rows", "list")]).combine_chunks()
        empty = [pa.nulls(len(found), t) for t in (pa.int64(), kind, pa.int64(), pa.float64())]
        return pa.RecordBatch.from_arrays([*empty, *(found[n].chunk(0) for n in ("word", "rows_list"))], names)

    def run(batches):
        tokens, parts = TokenIds(model.words), unpacked(model.flat)
        rare, held = [], 0
        for batch in batches:
            counts, sums = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for first, texts in slices(batch.column(2).cast(pa.binary())):
                words, owners = split_words(texts)
                ids = token_ids(words, tokens)
                counts[first : first + len(texts)] = np.bincount(owners, minlength=len(texts))
                sums[first : first + len(texts)] = np.bincount(owners, model.log_probabilities(ids, owners, parts), len(texts))
                outside = np.flatnonzero(ids >= WORDS)
                for start in range(0, len(outside), PLACES):
                    some = outside[start : start + PLACES]
                    rare.append((words.take(pa.array(some)), batch.column(0).take(pa.array(first + owners[some]))))
                    held += len(some)
                    if held >= PLACES:
                        yield places(rare)
                        rare, held = [], 0
            size = len(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(sums), pa.nulls(size, pa.binary()), pa.nulls(size, pa.list_(pa.int64()))], names)
        if rare:
            yield places(rare)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on ``docs`` and score them.

    Returns one row per row of ``docs``: doc_id, n_tokens, log_prob and
    mean_log_prob (null without tokens). Words are split at ASCII white space
    and A-Z lower-cased. Other columns are ignored; no rows give no rows.
    """
    counts = word_counts(docs, text_col)
    model = train(docs, counts, text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["doc_id"].dataType
    schema = f"row long, doc_id {id_type.simpleString()}, n_tokens long, log_prob double, word binary, rows array<long>"
    scored = materialise(rows.mapInArrow(_scored(model, to_arrow_type(id_type)), schema), "scored")
    rare = scored.filter("word IS NOT NULL").select("word", "rows")
    # each word stands once on the right, so a table of a task's words spares sorting all places by word
    shares = rare.join(within_buckets(counts, model.words).hint("shuffle_hash"), "word").select(F.explode("rows").alias("row"), "within")
    shares = shares.groupBy("row").agg(F.sum("within").alias("within"))
    told = scored.filter("word IS NULL").select("row", "doc_id", "n_tokens", "log_prob").join(shares, "row", "left")
    told = told.select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("within", F.lit(0.0))).alias("log_prob"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob")
    return told.select("doc_id", "n_tokens", "log_prob", mean)
