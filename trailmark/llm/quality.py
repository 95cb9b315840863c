"""Compression classifier: which of two zstandard dictionaries, of good and of bad text, compresses a text better."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import learnable
from trailmark.llm.sampling import labelled_sample, sample_texts

#: the bound on what the classifier is fitted on: rows per label, and characters of a text
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
DICTIONARY_BYTES, LEVEL = 65_536, 3
#: most bytes compressed at once: a dictionary helps at the start of what is compressed, so long texts are cut into equal pieces
PIECE_BYTES = 8192
FOLDS, HELD = 3, 1


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries and the weights that turn differences of compressed size into a probability."""

    good: bytes
    bad: bytes
    trained: tuple[bool, bool]
    weights: tuple[float, float, float]

    def features(self) -> TextFeatures:
        return TextFeatures(self)


class TextFeatures:
    """Both compressors, ready to use in one process."""

    def __init__(self, model: CompressionModel):
        self.pair = [_compressor(d, t) for d, t in zip((model.good, model.bad), model.trained)]

    def of(self, text: str | None) -> tuple[float, float, float]:
        """1, and the size with the bad minus that with the good dictionary over the larger size and over the length."""
        data = text.encode("utf-8", "replace") if text else b""
        if not data:
            return 1.0, 0.0, 0.0
        pieces = -(-len(data) // PIECE_BYTES)
        cuts = [len(data) * k // pieces for k in range(pieces + 1)]
        good, bad = (sum(len(c.compress(data[a:b])) for a, b in zip(cuts, cuts[1:])) for c in self.pair)
        return 1.0, (bad - good) / max(good, bad), (bad - good) / len(data)


def _compressor(dictionary: bytes, trained: bool) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    loaded = zstandard.ZstdCompressionDict(dictionary, dict_type=kind) if dictionary else None
    if loaded is not None:
        loaded.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded, write_content_size=False, write_checksum=False, write_dict_id=False)


def build_dictionary(texts: Sequence[bytes], size: int = DICTIONARY_BYTES) -> tuple[bytes, bool]:
    """A trained dictionary, or the last bytes of the texts where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, list(texts)).as_bytes(), True
    except zstandard.ZstdError:
        raw = b"\n".join(texts)[-size:]
        return (raw if len(raw) >= 8 else b""), False


def fit(sample: Sequence[tuple[int, str]], more: Callable[[CompressionModel], Sequence[tuple[int, tuple[float, float, float]]]] = lambda _: ()) -> CompressionModel:
    """Dictionaries from two thirds of the sample, calibration by logistic regression on the rest.

    ``more`` tells label and features of further texts to calibrate on, given the dictionaries.

    The ridge keeps weights finite; the intercept alone (the smoothed share of
    good texts) remains where a class is missing.
    """
    learn = [r for i, r in enumerate(sample) if i % 3 != 2]
    check = [r for i, r in enumerate(sample) if i % 3 == 2]
    books = [build_dictionary([t.encode("utf-8", "replace") for q, t in learn if q == label and t]) for label in (1, 0)]
    model = CompressionModel(books[0][0], books[1][0], (books[0][1], books[1][1]), (0.0, 0.0, 0.0))
    features = model.features()
    known = [(q, features.of(t)) for q, t in check] + list(more(model))
    x = np.array([f for _, f in known]).reshape(-1, 3)
    y = np.array([float(q) for q, _ in known])
    weights = np.zeros(3)
    ridge = np.array([1e-2, 1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + ridge * weights
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        weights = weights - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return CompressionModel(model.good, model.bad, model.trained, tuple(float(w) for w in weights))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> CompressionModel:
    """Fit on a bounded sample of labelled rows outside of the held-out fold.

    Texts of the sample over SAMPLE_CHARS calibrate: their features are taken in tasks, over the whole text.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & learnable(F.col("doc_id"), FOLDS, HELD))
    picked = labelled_sample(known, "label", rows, "quality")
    text = F.col(text_col)
    long = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text")).filter(F.length(text) > SAMPLE_CHARS)
    long = long.join(F.broadcast(picked), "doc_id").select("_key", "label", "_text").distinct()

    def calibration(model: CompressionModel):
        rows = long.select("_key", "label", text_features(model, F.col("_text")).alias("f")).collect()
        return [(r["label"], tuple(r["f"])) for r in sorted(rows, key=lambda r: (r["_key"], r["label"], tuple(r["f"])))]

    return fit(sample_texts(docs, picked, id_col, text_col, SAMPLE_CHARS, "label"), calibration)


def text_features(model: CompressionModel, text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = model.features()
        for texts in batches:
            yield pd.Series([list(features.of(t)) for t in texts])

    return told(text)


def quality_score(model: CompressionModel, text: Column) -> Column:
    """Probability that a text is good; whole texts are compressed. Null and empty texts get the intercept."""
    weights = np.array(model.weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = model.features()
        for texts in batches:
            x = np.array([features.of(t) for t in texts]).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))

    return score(text)


def rate(docs: DataFrame, model: CompressionModel, text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and ``score``, which replaces a column of that name."""
    return docs.withColumn("score", quality_score(model, F.col(text_col)))


def keep_good(docs: DataFrame, model: CompressionModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with their columns."""
    return docs.filter(quality_score(model, F.col(text_col)) >= least)
