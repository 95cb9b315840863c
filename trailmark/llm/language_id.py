"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import learnable
from trailmark.llm.sampling import labelled_sample, sample_texts

#: the bound on what the model is fitted on: rows per language, and characters of a text
SAMPLE_ROWS, SAMPLE_CHARS = 600, 20_000
GRAMS = (1, 2, 3)
BUCKETS, WIDTH = 1 << 15, 16
EPOCHS, RATE = 4, 0.5
PIECE = 300  # characters of a training piece
SLICE = 1 << 20  # code points hashed at once
FOLDS, HELD = 5, 0
UNKNOWN = "und"
#: share of right answers on calibration pieces that rejection may cost
COST = 0.01


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes_of(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text; every other character is 0, and runs of 0 are one."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(letters[codes], codes, 0).astype(np.uint32)
    codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)])
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def buckets_of(codes: np.ndarray) -> np.ndarray:
    """Buckets of all subwords of GRAMS lengths."""
    found = []
    for n in GRAMS:
        if len(codes) >= n:
            run = np.full(len(codes) - n + 1, n, np.uint32)
            for k in range(n):
                run = (run ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x9E3779B1)
                run ^= run >> np.uint32(15)
            found.append((run % np.uint32(BUCKETS))[codes[: len(run)] != 0] if n == 1 else run % np.uint32(BUCKETS))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Score of every bucket per language: embedding times output weights."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    rejection: float

    def logits(self, text: str, letters: np.ndarray) -> np.ndarray | None:
        """Mean bucket scores over the whole text; None without a letter."""
        codes = codes_of(text, letters)
        if len(codes) < 2 or not self.languages:
            return None
        total, count = np.zeros(len(self.languages)), 0
        for start in range(0, len(codes), SLICE):
            found = buckets_of(codes[start : start + SLICE + max(GRAMS) - 1])
            total += self.table[found].sum(axis=0, dtype=np.float64)
            count += len(found)
        return total / max(count, 1) + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(sample: Sequence[tuple[str, str]], seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent over pieces of the texts, one piece a step; every fifth text calibrates."""
    letters = letter_table()
    languages = tuple(sorted({lang for lang, _ in sample}))
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    output, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    learn, check = [], []
    for i, (lang, text) in enumerate(sample):
        codes = codes_of(text, letters)
        for start in range(0, len(codes), PIECE):
            found = buckets_of(codes[start : start + PIECE])
            if len(found):
                (check if i % 5 == 4 else learn).append((languages.index(lang), *np.unique(found, return_counts=True)))
    steps, done = max(1, EPOCHS * len(learn)), 0
    for _ in range(EPOCHS):
        for at in random.permutation(len(learn)):
            label, found, counts = learn[at]
            share = (counts / counts.sum())[:, None]
            hidden = (embedding[found] * share).sum(axis=0)
            error = _softmax(hidden @ output + bias)
            error[label] -= 1
            rate = RATE * (1 - done / steps)
            back = output @ error
            output -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            embedding[found] -= rate * len(found) * share * back / max(1.0, np.sqrt(len(found)))
            done += 1
    table = (embedding @ output).astype(np.float32)
    temperature, rejection = 1.0, 0.0
    if check and len(languages) > 1:
        z = np.array([(table[f] * (c / c.sum())[:, None]).sum(axis=0) + bias for _, f, c in check])
        y = np.array([label for label, *_ in check])
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = _softmax(z / temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            rejection = float(np.quantile(p.max(axis=1)[right], COST))
    return LanguageModel(languages, table, bias, temperature, rejection)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on a bounded sample of the rows with a language outside of the held-out fold."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("label"))
    known = known.filter(F.col("label").isNotNull() & learnable(F.col("doc_id"), FOLDS, HELD))
    picked = labelled_sample(known, "label", rows, "language")
    return fit(sample_texts(docs, picked, id_col, text_col, SAMPLE_CHARS, "label"))


PREDICTION = "struct<lang_pred:string,score:double,rejected:boolean>"


def predict(model: LanguageModel, text: Column) -> Column:
    """Language, calibrated probability, and whether that is below the rejection bound.

    ``und`` with score 0, rejected, for null texts, texts without a letter, and
    without any learned language. Whole texts are read.
    """

    @F.pandas_udf(PREDICTION)
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for texts in batches:
            rows = []
            for t in texts:
                z = model.logits(t, letters) if t else None
                if z is None:
                    rows.append((UNKNOWN, 0.0, True))
                    continue
                p = _softmax(z / model.temperature)
                best = int(p.argmax())
                rows.append((model.languages[best], float(p[best]), bool(p[best] < model.rejection)))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return told(text)
