"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every text gives a few statistics (lengths, shares of kinds of characters, how much
repeats), smoothed with a few words of an average text. Their logarithms are standardised; each class has a mean and a covariance
shrunk towards its mean variance. A document's score is the posterior of class 1
from the difference of the two log densities, whose Mahalanobis parts come from
Cholesky factors computed once. The sums behind means and covariances are taken on
the executors over all labelled training rows, without a sample.

Results for odd rows: null and empty texts have the statistics of an empty text and
a score like any other; repeated rows give repeated results; a document with several
labels counts with the smallest; null labels and labels of unknown documents do not
count; without training rows of both classes every score is 0.5; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import (
    BLOCK,
    SPACED_WORDS,
    distinct_counts,
    in_batches,
    shingles_of,
    string_bytes,
    text_of,
    text_slices,
    words_of,
)

#: Share of the mean variance in each class covariance.
SHRINKAGE = 0.1
#: Rows whose crc32 of the id leaves this remainder by 3 are held out.
FOLDS, HELD_OUT = 3, 1
#: Words of an average text that every share is smoothed with, so that a very short text is no outlier.
SMOOTHING = 10
#: What that average text is like: what its shares come to (fixed values).
AVERAGE = {
    "word_length": 6,
    "words_per_line": 15,
    "symbols": 0.001,
    "upper": 0.02,
    "digits": 0.003,
    "stops": 0.15,
    "exclamations": 0.001,
    "distinct_words": 1,
    "distinct_lines": 1,
    "distinct_triples": 1,
    "short_words": 0.4,
    "long_words": 0.1,
    "symbols_a_word": 0.001,
}
STATISTICS = tuple(AVERAGE)

_lines = np.ones(256, dtype=bool)
_lines[[10, 13]] = False


def _kind(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters)] = True
    return out


_upper, _digit, _stop, _bang = _kind(bytes(range(65, 91))), _kind(b"0123456789"), _kind(b".,;:?"), _kind(b"!")
_symbol = _kind(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?!'\"()-"))
_inner = _kind(bytes([*range(128, 192)]))


def _statistics(column: pa.Array) -> np.ndarray:
    raw, offsets = string_bytes(column)

    def count(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(kind[raw]), offsets)).astype(float)

    words, bounds, lengths = words_of(column, SPACED_WORDS)
    lines, line_bounds, _ = words_of(column, _lines)
    triples, triple_bounds = shingles_of(words, bounds, 3)
    owner = np.repeat(np.arange(len(column)), np.diff(bounds))
    n_words, n_lines, n_triples = (np.diff(x).astype(float) for x in (bounds, line_bounds, triple_bounds))
    size = np.diff(offsets) - count(_inner)
    symbols = count(_symbol)
    letters, few = 6 * SMOOTHING, 2

    def words_with(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=len(column))

    # what is counted, out of how many, how many of the average text, and what keeps the logarithm from -inf
    shares = {
        "word_length": (size, n_words, SMOOTHING, 0),
        "words_per_line": (n_words, n_lines, few, 1),
        "symbols": (symbols, size, letters, 1e-3),
        "upper": (count(_upper), size, letters, 1e-2),
        "digits": (count(_digit), size, letters, 1e-2),
        "stops": (count(_stop), n_words, SMOOTHING, 1e-2),
        "exclamations": (count(_bang), n_words, SMOOTHING, 1e-2),
        "distinct_words": (distinct_counts(words, bounds), n_words, SMOOTHING, 1e-1),
        "distinct_lines": (distinct_counts(lines, line_bounds), n_lines, 2 * few, 1e-1),
        "distinct_triples": (distinct_counts(triples, triple_bounds), n_triples, SMOOTHING, 1e-1),
        "short_words": (words_with(lengths <= 3), n_words, SMOOTHING, 2e-2),
        "long_words": (words_with(lengths >= 12), n_words, SMOOTHING, 2e-2),
        "symbols_a_word": (np.minimum(symbols, 2 * n_words), n_words, SMOOTHING, 1e-2),
    }
    return np.column_stack(
        [np.log((part + AVERAGE[s] * k) / (whole + k) + least) for s, (part, whole, k, least) in shares.items()]
    )


def document_statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics of each text, one row each; a text's row depends on that text alone."""
    parts = [_statistics(column.slice(a, b - a)) for a, b in text_slices(column, 2 * BLOCK)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = document_statistics(batch.column(1))
            values = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], rows.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "statistics"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(
        in_batches,
        run,
        "doc_id long, statistics array<double>",
    )


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in training; a null id does not count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and constants of the two classes."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    constants: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = (rows - self.centre) / self.scale
        logs = [
            c - 0.5 * np.square((z - m) @ w.T).sum(axis=1)
            for m, w, c in zip(self.means, self.whiten, self.constants, strict=True)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant | None:
    """The discriminant from, for each class, the number of rows, their sum and the sum of their outer products."""
    if counts.min() < 1:
        return None
    size = sums.shape[1]
    centre = sums.sum(axis=0) / counts.sum()
    spread = np.diag(products.sum(axis=0)) / counts.sum() - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means, whiten, constants = [], [], []
    for n, s, p in zip(counts, sums, products, strict=True):
        mean = s / n
        cov = (p / n - np.outer(mean, mean)) / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / size, 1e-3) * np.eye(size) + 1e-6 * np.eye(size)
        factor = np.linalg.cholesky((cov + cov.T) / 2)
        means.append((mean - centre) / scale)
        whiten.append(np.linalg.inv(factor))
        constants.append(np.log(n / counts.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(whiten), np.array(constants))


def train(statistics: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant | None:
    """Fit on the labelled documents that are not held out; only sums reach the driver."""
    marked = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
        .filter("label in (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    size = len(STATISTICS)
    width = 1 + size + size * size

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = rows[label == c]
                total[c, 0] += len(own)
                total[c, 1 : 1 + size] += own.sum(axis=0)
                total[c, 1 + size :] += (own.T @ own).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], width)), pa.array(np.tile(np.arange(width), 2)), pa.array(total.ravel())],
            names=["label", "place", "value"],
        )

    rows = (
        statistics.join(marked, "doc_id")
        .select("label", "statistics")
        .transform(in_batches, partial, "label long, place long, value double")
        .groupBy("label", "place")
        .agg(F.sum("value").alias("value"))
        .collect()  # two rows of sums for each pair of statistics
    )
    total = np.zeros((2, width))
    for r in rows:
        total[r["label"], r["place"]] = r["value"]
    return fit(total[:, 0], total[:, 1 : 1 + size], total[:, 1 + size :].reshape(2, size, size), shrinkage)


def _scores(model: Discriminant | None, rows: np.ndarray) -> np.ndarray:
    return np.full(len(rows), 0.5) if model is None else model.scores(rows)


def score(statistics: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``statistics``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, rows))], names=["doc_id", "score"])

    return statistics.transform(in_batches, run, "doc_id long, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Discriminant | None) -> DataFrame:
    """The rows of ``docs``, whole and with all columns, whose score is 0.5 or more. No shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index("text")).fill_null("")
            yield batch.filter(pa.array(_scores(model, document_statistics(text)) >= 0.5))

    return docs.transform(in_batches, run, docs.schema)
