"""Quality: regularised quadratic discriminant analysis of document statistics.

Each text becomes some twenty numbers on its characters, words, lines and repetition, transformed
so that they are roughly normal. The sums that class means and covariances need are taken over all
labelled documents outside the held-out fold, wherever they lie; only sums reach the driver.
Covariances are shrunk to their common one and that to its diagonal. A score compares the two log
densities, by solving with their Cholesky factors, which are computed once and kept in the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import extended, fresh, in_fold, stored
from pitchspark.llm.labelled import calibrated, labelled_sample, sigmoid

# Weight of the common covariance in each class's, and of the diagonal in the common one.
POOLED = 0.2
DIAGONAL = 0.1
# Labelled documents of each class that the logistic curve over the log-density ratio is fitted on.
PER_CLASS = 5000

NAMES = (
    "words", "word_mean", "word_sd", "word_long", "short_words", "letters", "upper", "digits",
    "space", "stops", "symbols", "marked_words", "vocabulary", "top_word", "repeat_pairs",
    "repeat_fives", "lines", "repeat_lines", "line_mean", "title_words", "end_marks",
)

_KIND = np.zeros(256, dtype=np.uint8)  # 0 other symbols
for _b in range(256):
    _c = chr(_b)
    if _b >= 128 or _c.isalpha():
        _KIND[_b] = 2 if _b < 128 and _c.isupper() else 1
    elif _c.isdigit():
        _KIND[_b] = 3
    elif _c.isspace():
        _KIND[_b] = 4
    elif _c in ".,;:'\"-()?!":
        _KIND[_b] = 5


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; those of an empty one are defined too."""
    data = (text or "").encode()
    words, lines = data.split(), data.splitlines()
    n, size = len(words), max(1, len(data))
    counts = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=6)
    letters = counts[1] + counts[2]
    lengths = np.fromiter(map(len, words), np.int64, n)
    hashes = np.fromiter(map(crc32, words), np.uint64, n)
    kinds, times = np.unique(hashes, return_counts=True)
    first = np.frombuffer(b"".join(w[:1] for w in words), np.uint8)
    last = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)

    def share(part: float, whole: float) -> float:
        return (part + 0.5) / (whole + 1)

    def repeated(span: int) -> float:
        """Share of runs of so many words that have been met before."""
        total = n - span + 1
        if total < 1:
            return share(0, 0)
        mixed = np.zeros(total, dtype=np.uint64)
        for i in range(span):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + total]
        return share(total - len(np.unique(mixed)), total)

    raw_shares = [
        share((lengths <= 3).sum(), n),
        share(letters, size),
        share(counts[2], letters),
        share(counts[3], size),
        share(counts[4], size),
        share(counts[5], size),
        share(counts[0], size),
        share((_KIND[last] == 0).sum(), n),
        share(len(kinds), n),
        share(times.max() if n else 0, n),
        repeated(2),
        repeated(5),
        share(len(lines) - len(set(lines)), len(lines)),
        share((_KIND[first] == 2).sum(), n),
        share(np.isin(last, np.frombuffer(b".?!", np.uint8)).sum(), n),
    ]
    logits = np.log(np.array(raw_shares) / (1 - np.array(raw_shares)))
    mean = lengths.mean() if n else 0.0
    sizes = np.log1p(
        [n, mean, lengths.std() if n else 0.0, lengths.max() if n else 0, len(lines), size / max(1, len(lines))]
    )
    at = dict(zip(
        ("short_words", "letters", "upper", "digits", "space", "stops", "symbols", "marked_words",
         "vocabulary", "top_word", "repeat_pairs", "repeat_fives", "repeat_lines", "title_words",
         "end_marks"), logits, strict=True))
    at |= dict(zip(("words", "word_mean", "word_sd", "word_long", "lines", "line_mean"), sizes, strict=True))
    return np.array([at[name] for name in NAMES])


@dataclass
class Model:
    """``means`` is empty if there was nothing to learn; then every score is ``prior``."""

    prior: float = 0.0
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)  # inverse Cholesky factors
    constants: list[float] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of label 1 less that of label 0, with their shares."""
        log = [
            c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1)
            for m, f, c in zip(self.means, self.factors, self.constants, strict=True)
        ]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        return sigmoid(self.slope * self.margin(x) + self.shift)


def model_of(
    counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float, diagonal: float
) -> Model:
    """From the number, sums and sums of products of each class's statistics."""
    means = sums / counts[:, None]
    scatter = squares - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    # A statistic that never varies still has some variance.
    common = scatter.sum(axis=0) / max(1, counts.sum() - 2) + 1e-4 * np.eye(sums.shape[1])
    common = (1 - diagonal) * common + diagonal * np.diag(np.diag(common))
    model = Model(prior=counts[1] / counts.sum())
    for c in (0, 1):
        own = scatter[c] / max(1, counts[c] - 1)
        # Few rows: more of the common one.
        weight = pooled + (1 - pooled) * sums.shape[1] / (sums.shape[1] + counts[c])
        factor = np.linalg.cholesky((1 - weight) * own + weight * common)
        model.means.append(means[c])
        model.factors.append(np.linalg.inv(factor))
        model.constants.append(np.log(counts[c] / counts.sum()) - np.log(np.diag(factor)).sum())
    return model


def with_statistics(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the statistics of its text, an array of doubles, in place of the text."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t.as_py()) for t in batch.column("text")]
            flat = pa.array(np.concatenate([np.zeros(0), *found]))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES))
            columns = [*[batch.column(c) for c in keep], pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, name])

    return docs.mapInArrow(run, extended(docs.select(*keep).schema, f"`{name}` array<double>"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))


def fit(
    known: DataFrame,
    labels: DataFrame,
    folds: int = 4,
    held_out: int = 2,
    pooled: float = POOLED,
    diagonal: float = DIAGONAL,
    per_class: int = PER_CLASS,
) -> Model:
    """Learn ``labels.quality`` from (doc_id, statistics): means and covariances from every labelled
    document outside the held-out fold, the logistic curve from up to ``per_class`` of each class.
    With fewer than two classes every score is the share of label 1."""
    value = labels["quality"].cast("int")
    use = labels.where(value.isin(0, 1) & ~in_fold(labels["doc_id"], folds, held_out))
    rows = known.join(use.select("doc_id", value.alias("label")), "doc_id").select("label", "statistics")
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, squares = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x, label = _matrix(batch.column("statistics")), batch.column("label").to_numpy()
            for c in (0, 1):
                own = x[label == c]
                counts[c] += len(own)
                sums[c] += own.sum(axis=0)
                squares[c] += own.T @ own
        flat = np.concatenate([counts, sums.ravel(), squares.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "part"]
        )

    # A few hundred sums from each task, added up before they reach the driver.
    total = (
        rows.mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("part"))
    ).toPandas()
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    flat[total["place"]] = total["part"]
    counts, sums, squares = flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d)
    if counts.min() < 2:
        return Model(prior=counts[1] / max(1.0, counts.sum()))
    model = model_of(counts, sums, squares, pooled, diagonal)
    chosen, totals = labelled_sample(labels, "quality", per_class, folds, held_out)
    ids = known.sparkSession.createDataFrame(
        chosen, extended(known.select("doc_id").schema, "label int")
    )
    few = known.join(F.broadcast(ids), "doc_id").select("label", "statistics").toPandas()
    label = few["label"].to_numpy()
    weight = np.array([totals[c] / max(1, (label == c).sum()) for c in (0, 1)])[label]
    # Far from both means the ratio grows with the square of the distance; its sign and size in
    # the middle are what the curve needs.
    margin = np.clip(model.margin(np.stack(few["statistics"].tolist())), -50, 50)
    model.slope, model.shift = calibrated(margin, label, weight)
    return model


def scored(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, **options
) -> DataFrame:
    """Every row of ``docs`` without its text, with score (0 to 1; higher: better) after its own
    columns, renamed with a leading _ where it has such a column.

    A null text scores as an empty one; whole texts are read, once. No row gives no row.
    """
    score, x = fresh(docs, "score"), fresh(docs, "statistics")
    known = stored(with_statistics(docs, x), "quality-statistics")
    learned = fit(
        known.select("doc_id", F.col(x).alias("statistics")), labels, folds, held_out, **options
    )
    keep = [c for c in known.columns if c != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = learned.score(_matrix(batch.column(x)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(found)], names=[*keep, score]
            )

    return known.mapInArrow(run, extended(known.select(*keep).schema, f"`{score}` double"))
