"""Language identification by error-correcting output codes.

Each language has a codeword of bits. A linear classifier per bit, on hashed character n-grams,
predicts it, and the language whose codeword fits the predictions best wins: the logistic loss of
each bit is weighted by how well that bit was predicted for the language, and a text whose best two
languages are close is flagged as ambiguous. The classifiers are fitted in numpy on a bounded
sample of documents with a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchspark.llm.common import extended, fresh, in_fold
from pitchspark.llm.labelled import sigmoid

UNKNOWN = "und"
# Buckets of n-grams of each order, and orders.
BUCKETS = 2048
ORDERS = (1, 2, 3)
# Documents of a language to learn from on average, and of all languages.
PER_LANGUAGE = 600
MOST_DOCUMENTS = 6000
# Losses of the best two languages closer than this are ambiguous.
AMBIGUOUS = 0.1
_STEP = 1 << 18
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def _classes() -> np.ndarray:
    """Bytes as they count: letters and what lies above ASCII as they are, all else a space."""
    return np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)


_CLASS = _classes()


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of the hashed n-grams of a whole text, for each order."""
    data = (text or "").lower().encode()
    counts = np.zeros((len(ORDERS), BUCKETS))
    before = np.zeros(0, dtype=np.uint32)  # the last characters of the part before
    for at in range(0, len(data), _STEP):
        chars = _CLASS[np.frombuffer(data[at : at + _STEP], np.uint8)]
        # Only one space between words.
        chars = chars[(chars != 32) | (np.concatenate([before[-1:] if len(before) else [0], chars[:-1]]) != 32)]
        chars, known = np.concatenate([before, chars]), len(before)
        mixed = np.zeros(len(chars), dtype=np.uint32)
        for i, n in enumerate(ORDERS):
            mixed = mixed[: max(0, len(chars) - n + 1)] * _MIX[1] + chars[n - 1 :] * _MIX[0]
            places = (mixed * _MIX[2]) >> np.uint32(32 - int(np.log2(BUCKETS)))
            # Those that end in the part before were counted there.
            counts[i] += np.bincount(places[max(0, known - n + 1) :], minlength=BUCKETS)
        before = chars[-(max(ORDERS) - 1) :]
    counts /= np.maximum(1, counts.sum(axis=1, keepdims=True))
    return np.sqrt(counts).ravel().astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A codeword of -1 and 1 for each of ``n`` languages, far apart, no column constant: all
    different columns for few languages, else the best of some random tables."""
    if n <= 5:
        rows = [[1 if n == 1 else -1] * max(1, 2 ** (n - 1) - 1)]
        for i in range(1, n):
            columns = np.arange(1, 2 ** (n - 1))
            rows.append(np.where(columns >> (i - 1) & 1, 1, -1).tolist())
        return np.array(rows)
    bits = min(63, max(15, int(np.ceil(6 * np.log2(n)))))
    rng, best, score = np.random.default_rng(seed), None, -1
    for _ in range(200):
        table = rng.choice([-1, 1], (n, bits))
        apart = (bits - table @ table.T) // 2 + bits * np.eye(n, dtype=int)
        if apart.min() > score and (np.abs(table.sum(axis=0)) < n).all():
            best, score = table, apart.min()
    return best


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    codes: np.ndarray | None = None
    weights: np.ndarray | None = None  # features and a constant x bits
    trust: np.ndarray | None = None  # languages x bits; each row sums to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights[:-1] + self.weights[-1]
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None])
        return (loss * self.trust[None]).sum(axis=2)


def train(x: np.ndarray, codes: np.ndarray, language: np.ndarray, steps: int = 120) -> np.ndarray:
    """One logistic classifier per bit, each language with the same weight, by accelerated
    gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    goal = (codes[language] > 0).astype(np.float32)
    share = (1 / np.bincount(language, minlength=len(codes)).clip(1))[language]
    share = (share / share.sum())[:, None].astype(np.float32)
    w = np.zeros((x.shape[1], codes.shape[1]), np.float32)
    ahead, rate = w, np.float32(4 / (x * x).sum(axis=1).mean())
    for step in range(steps):
        gradient = x.T @ (share * (sigmoid(x @ ahead).astype(np.float32) - goal)) + 1e-5 * ahead
        after = ahead - rate * gradient
        ahead, w = after + np.float32(step / (step + 3)) * (after - w), after
    return w


def fit(
    docs: DataFrame,
    per_language: int = PER_LANGUAGE,
    most: int = MOST_DOCUMENTS,
    folds: int = 3,
    held_out: int = 1,
) -> Model:
    """Learn every language of the documents outside the held-out fold, from about ``per_language``
    documents of each, chosen by a hash of text and id, and about ``most`` in all."""
    lang = docs["lang"].cast("string")
    known = docs.where(
        lang.isNotNull() & ~in_fold(docs["doc_id"], folds, held_out) & docs["text"].isNotNull()
    ).select(lang.alias("lang"), "text", F.xxhash64("doc_id", "text").alias("order"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return Model()
    each = max(1, min(per_language, most // len(counts)))
    limits = known.sparkSession.createDataFrame(
        [(k, min(1.0, each / n)) for k, n in counts.items()], "language string, share double"
    )
    draw = F.pmod("order", F.lit(1 << 30)) / float(1 << 30)
    few = known.join(F.broadcast(limits), F.col("lang") == F.col("language")).where(draw < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(x, pa.binary()), batch.column("order")],
                names=["lang", "x", "order"],
            )

    rows = few.select("lang", "text", "order").mapInArrow(run, "lang string, x binary, order long")
    rows = rows.toPandas().sort_values(["order", "lang"], ignore_index=True)
    languages = sorted(set(rows["lang"]))
    if not languages:
        return Model()
    x = np.stack([np.frombuffer(b, np.float16) for b in rows["x"]]).astype(np.float32)
    language = np.array([languages.index(v) for v in rows["lang"]])
    codes = codewords(len(languages))
    check = np.arange(len(x)) % 5 == 0
    if len(set(language[~check])) < len(languages):
        check[:] = False
    model = Model(languages, codes, train(x[~check], codes, language[~check]))
    # How often each bit is right for each language, on the documents kept out.
    right = np.ones(codes.shape)
    seen = check if check.any() else ~check
    margins = x[seen] @ model.weights[:-1] + model.weights[-1]
    for i in range(len(languages)):
        own = margins[language[seen] == i]
        right[i] = ((own * codes[i] > 0).sum(axis=0) + 1) / (len(own) + 2)
    model.trust = right / right.sum(axis=1, keepdims=True)
    return model


def identified(docs: DataFrame, model: Model, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """Every row of ``docs`` without its text, with lang_pred, score (0 to 1) and ambiguous, renamed
    with a leading _ where it has such columns.

    lang_pred is ``und``, with score 0, for a null text, a text without a letter, and if no language
    was learned. Whole texts are read. No row gives no row.
    """
    names = [fresh(docs, c) for c in ("lang_pred", "score", "ambiguous")]
    keep = [c for c in docs.columns if c != "text"]
    kinds = zip(names, ("string", "double", "boolean"), strict=True)
    columns = ", ".join(f"`{name}` {kind}" for name, kind in kinds)
    schema = extended(docs.select(*keep).schema, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            found, score, close = [UNKNOWN] * n, np.zeros(n), np.ones(n, dtype=bool)
            for at in range(0, n * bool(model.languages), 256):
                texts = batch.column("text")[at : at + 256].to_pylist()
                loss = model.losses(np.stack([features(t) for t in texts]))
                best = np.argmin(loss, axis=1)
                fit_ = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
                sure = 1 / fit_.sum(axis=1)
                second = np.sort(loss, axis=1)[:, 1] if loss.shape[1] > 1 else np.inf
                near = second - loss.min(axis=1) < ambiguous
                for i, text in enumerate(texts):
                    if has_letter(text):
                        found[at + i] = model.languages[best[i]]
                        score[at + i], close[at + i] = sure[i], near[i]
            columns = [batch.column(c) for c in keep]
            new = [pa.array(found, pa.string()), pa.array(score), pa.array(close)]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=[*keep, *names])

    return docs.mapInArrow(run, schema)
