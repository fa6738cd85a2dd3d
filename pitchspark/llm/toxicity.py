"""Toxicity: a convolutional text classifier in numpy.

Words are hashed; each hash that several documents of the training have owns an embedding, all others
share an empty one. Filters of several widths slide over the whole text, the maximum of each over
all places is kept, and a linear layer makes a margin of them. The network is trained on a bounded
sample of labelled documents, by Adam, from embeddings whose first number says how far the hash's
documents of label 1 are above chance, and with words left out at random; the gradient of a maximum touches only the place where it was met. A logistic curve, fitted on documents kept out of the
training, turns margins into scores that are probabilities at the share of toxic documents among
all labels. On the same documents a threshold is chosen for each language; languages change
decisions only, never scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import extended, fresh, small_batches, stored
from pitchspark.llm.labelled import calibrated, labelled_sample, sigmoid

DIMENSIONS = 8
# Documents of the training that must have a word's hash for it to own an embedding.
MIN_DOCUMENTS = 2
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 5
# Share of words left out of a training step.
LEFT_OUT = 0.3
# Labelled documents of each class to learn from, and words of the longest of them.
PER_CLASS = 1500
TRAIN_WORDS = 20_000
# Words that are scored at a time.
_WORDS = 1 << 16

_LETTERS = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)  # everything else parts words


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of each word of a whole text."""
    words = (text or "").lower().encode().translate(_LETTERS).split()
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def word_ids(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of hashes among the sorted known ones, from 2 on; 1 for a hash not known, and 0 is
    kept for places outside of the text."""
    place = np.searchsorted(known, hashes)
    found = known[np.minimum(place, len(known) - 1)] == hashes
    return np.where(found, place + 2, 1).astype(np.int32)


@dataclass
class Model:
    """``embedding`` is None if there was nothing to learn; then every score is ``prior``."""

    embedding: np.ndarray | None = None
    known: np.ndarray | None = None
    filters: list[np.ndarray] = field(default_factory=list)  # width x dimensions x filters
    shift: np.ndarray | None = None
    output: np.ndarray | None = None
    prior: float = 0.0
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.3
    by_lang: dict[str, float] = field(default_factory=dict)

    def tables(self) -> list[np.ndarray]:
        """What each word adds to the filters if it stands at their first, second ... place."""
        empty = np.zeros((DIMENSIONS, FILTERS), np.float32)
        return [
            self.embedding
            @ np.concatenate([f[t] if t < len(f) else empty for f in self.filters], axis=1)
            for t in range(max(WIDTHS))
        ]


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words in a row, with empty places after each document, and where documents start."""
    gap = np.zeros(max(WIDTHS), dtype=np.int32)
    starts = np.cumsum([0, *[len(d) + len(gap) for d in docs[:-1]]])
    return np.concatenate([x for d in docs for x in (d, gap)]), starts


def pooled(tables: list[np.ndarray], shift: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """The maxima of all filters over each document; documents are taken in parts if long."""
    reach = len(tables) - 1
    widths = np.repeat(WIDTHS, FILTERS)
    parts, owner, goes_on, out = [], [], [], np.zeros((len(docs), len(shift)), np.float32)

    def flush() -> None:
        if not parts:
            return
        ids, starts = _joined(parts)
        found = tables[0][ids]
        for t in range(1, len(tables)):
            found[:-t] += tables[t][ids[t:]]
        found += shift
        found[ids == 0] = 0
        # Where the text goes on, the next part has these windows whole.
        ends = (starts + [len(p) for p in parts])[np.array(goes_on)]
        for left in range(1, reach + 1):
            found[np.ix_(ends - left, widths > left)] = 0
        np.maximum.at(out, owner, np.maximum.reduceat(found, starts, axis=0))
        parts.clear()
        owner.clear()
        goes_on.clear()

    held = 0
    for i, ids in enumerate(docs):
        for at in range(0, len(ids), _WORDS):
            parts.append(ids[max(0, at - reach) : at + _WORDS])
            owner.append(i)
            goes_on.append(at + _WORDS < len(ids))
            held += len(parts[-1])
            if held >= _WORDS:
                flush()
                held = 0
    flush()
    return out


def train(hashes: list[np.ndarray], label: np.ndarray, epochs: int, seed: int = 11) -> Model:
    """The network without its calibration, from the word hashes of each document."""
    rng = np.random.default_rng(seed)
    each = [np.unique(h) for h in hashes]
    every, times = np.unique(np.concatenate(each), return_counts=True)
    # There is always a known hash, so that places can be looked up.
    use = times >= MIN_DOCUMENTS if (times >= MIN_DOCUMENTS).any() else times > 0
    if not len(every):
        every, use, times = np.zeros(1, np.uint32), np.ones(1, bool), np.zeros(1, int)
    known = every[use]
    up = np.zeros(len(known))
    for h, y in zip(each, label, strict=True):
        # Each hash is once in a document's.
        up[np.searchsorted(known, h[np.isin(h, known)])] += y
    del each
    chance = times[use] * label.mean()
    embedding = 0.02 * rng.standard_normal((len(known) + 2, DIMENSIONS), dtype=np.float32)
    embedding[2:, 0] = np.clip((up - chance) / np.sqrt(chance + 1) / 4, -1, 3)
    docs = [word_ids(h, known) for h in hashes]
    model = Model(
        embedding=embedding,
        known=known,
        filters=[
            rng.normal(0, 1 / np.sqrt(w * DIMENSIONS), (w, DIMENSIONS, FILTERS)).astype(np.float32)
            for w in WIDTHS
        ],
        shift=np.zeros(FILTERS * len(WIDTHS), np.float32),
        output=rng.normal(0, 0.3, FILTERS * len(WIDTHS) + 1).astype(np.float32),
    )
    model.embedding[:2] = 0
    values = [model.embedding, *model.filters, model.shift, model.output]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step, rate, size = 0, 0.005, 32
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), size):
            chosen = order[at : at + size]
            fewer = [np.where(rng.random(len(docs[i])) < LEFT_OUT, 1, docs[i]) for i in chosen]
            gradients = _gradients(model, fewer, label[chosen])
            step += 1
            for v, g, m, s in zip(values, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
            model.embedding[:2] = 0
    return model


def _gradients(model: Model, docs: list[np.ndarray], label: np.ndarray) -> list[np.ndarray]:
    ids, starts = _joined(docs)
    x = model.embedding[ids]
    best, where = [], []
    for k, f in enumerate(model.filters):
        found = x @ f[0]
        for t in range(1, len(f)):
            found[:-t] += x[t:] @ f[t]
        found += model.shift[k * FILTERS : (k + 1) * FILTERS]
        found[ids == 0] = 0
        where.append(
            np.stack([s + np.argmax(found[s : s + max(1, len(d))], axis=0) for s, d in zip(starts, docs, strict=True)])
        )
        best.append(np.take_along_axis(found, where[-1], axis=0))
    features = np.maximum(np.concatenate(best, axis=1), 0)
    features = np.concatenate([features, np.ones((len(docs), 1), np.float32)], axis=1)
    error = (sigmoid(features @ model.output) - label).astype(np.float32) / len(docs)
    out_g = features.T @ error
    emb_g, shift_g, filter_g = np.zeros_like(model.embedding), np.zeros_like(model.shift), []
    for k, f in enumerate(model.filters):
        span = slice(k * FILTERS, (k + 1) * FILTERS)
        back = error[:, None] * model.output[span] * (features[:, span] > 0)
        back[[len(d) == 0 for d in docs]] = 0
        shift_g[span] = back.sum(axis=0)
        g = np.zeros_like(f)
        for t in range(len(f)):
            at = where[k] + t
            g[t] = np.einsum("nfd,nf->df", x[at], back)
            np.add.at(emb_g, ids[at].ravel(), (back[:, :, None] * f[t].T[None]).reshape(-1, DIMENSIONS))
        filter_g.append(g)
    return [emb_g, *filter_g, shift_g, out_g]


def _threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray, prior: float) -> float:
    """The threshold with the largest F1, between two scores; pulled to ``prior`` by few labels."""
    order = np.argsort(-score)
    hit = np.cumsum((weight * label)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + max((weight * label).sum(), 1e-9))
    best = int(np.argmax(f1))
    last = score[order][min(best + 1, len(order) - 1)]
    found = (score[order][best] + last) / 2
    trust = label.sum() / (label.sum() + 20)
    return float(trust * found + (1 - trust) * prior)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    train_words: int = TRAIN_WORDS,
    epochs: int = EPOCHS,
    threshold: float = 0.3,
    folds: int = 4,
    held_out: int = 2,
) -> Model:
    """Learn ``labels.toxic`` from up to ``per_class`` documents of each class, of ids whose crc32
    leaves another remainder by ``folds`` than ``held_out``; those of more than ``train_words``
    words are left out of the training (never of the scoring). With fewer than two classes every
    score is the share of label 1."""
    chosen, totals = labelled_sample(labels, "toxic", per_class, folds, held_out)
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return Model(prior=prior, threshold=threshold)
    spark = docs.sparkSession
    ids = spark.createDataFrame(chosen, extended(docs.select("doc_id").schema, "label int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(t.as_py()) for t in batch.column("text")]
            use = pa.array([len(w) <= train_words for w in words])
            held = pa.array([w.astype("<u4").tobytes() for w in words], pa.binary())
            columns = [batch.column("label"), batch.column("lang"), held]
            columns.append(batch.column("order"))
            yield pa.RecordBatch.from_arrays(columns, ["label", "lang", "words", "order"]).filter(use)

    few = (
        docs.select("doc_id", "text", docs["lang"].cast("string").alias("lang"))
        .join(F.broadcast(ids), "doc_id")  # at most twice per_class rows
        .select("label", "lang", "text", F.xxhash64("doc_id", "text").alias("order"))
        .mapInArrow(run, "label int, lang string, words binary, order long")
        .toPandas()
        .sort_values(["order", "label"], ignore_index=True)
    )
    label = few["label"].to_numpy()
    words = [np.frombuffer(w, "<u4") for w in few["words"]]
    kept = np.arange(len(few)) % 4 == 0  # for the calibration
    if min((label[~kept] == c).sum() for c in (0, 1)) < 1 or not kept.any():
        return Model(prior=prior, threshold=threshold)
    use = np.flatnonzero(~kept)
    model = train([words[i] for i in use], label[use], epochs)
    docs_kept = [word_ids(words[i], model.known) for i in np.flatnonzero(kept)]
    features = pooled(model.tables(), model.shift, docs_kept)
    margin, label = features @ model.output[:-1] + model.output[-1], label[kept]
    weight = np.array([totals[c] / max(1, (label == c).sum()) for c in (0, 1)])[label]
    model.slope, model.offset = calibrated(margin.astype(float), label, weight)
    score = sigmoid(model.slope * margin + model.offset)
    model.prior, model.threshold = prior, threshold
    lang = few["lang"].to_numpy()[kept]
    for name in sorted({x for x in lang if x is not None}):
        of = lang == name
        model.by_lang[name] = _threshold(score[of], label[of], weight[of], threshold)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with score (0 to 1), threshold (that of its language, or the model's)
    and toxic (whether the score reaches it), renamed with a leading _ where it has such columns.

    A null text scores as an empty one; whole texts are read. No row gives no row.
    """
    names = [fresh(docs, c) for c in ("score", "threshold", "toxic")]
    kinds = zip(names, ("double", "double", "boolean"), strict=True)
    schema = extended(docs.schema, ", ".join(f"`{name}` {kind}" for name, kind in kinds))
    columns = schema.names
    text_at, lang_at = columns.index(docs.select("text").columns[0]), columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model.embedding is not None else None
        for batch in batches:
            score = np.full(batch.num_rows, model.prior)
            for at in range(0, batch.num_rows * (tables is not None), 256):
                part = batch.column(text_at)[at : at + 256]
                docs = [word_ids(word_hashes(t.as_py()), model.known) for t in part]
                found = pooled(tables, model.shift, docs)
                margin = found @ model.output[:-1] + model.output[-1]
                score[at : at + 256] = sigmoid(model.slope * margin + model.offset)
            limit = np.array(
                [model.by_lang.get(x.as_py(), model.threshold) for x in batch.column(lang_at)]
            )
            new = [pa.array(score), pa.array(limit, pa.float64()), pa.array(score >= limit)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=columns)

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the model fitted on ``labels`` doesn't find toxic; written once."""
    out = scored(docs, fit(docs, labels, **options))
    kept = out.where(~F.col(out.columns[-1])).select(*docs.columns)
    # Here, as a lazy table would be scored in the batches of whoever asks for its rows.
    with small_batches(docs.sparkSession):
        return stored(kept, "toxicity-kept")
