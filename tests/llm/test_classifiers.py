import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchspark.llm import labelled, language, quality, toxicity
from pitchspark.llm.common import in_fold
from tests.llm.helpers import CLASHING, awkward, documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def held_out(scored, labels, label, folds, fold):
    known = scored.where(in_fold(F.col("doc_id"), folds, fold)).join(labels, "doc_id")
    rows = known.select("score", label).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows])


def area(score, label):
    above = score[label == 1][:, None] - score[label == 0][None]
    return (above > 0).mean() + (above == 0).mean() / 2


def test_toxicity(spark, tables, tmp_path):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, model)
    assert out.columns == [*docs.columns, "score", "threshold", "toxic"]
    score, label = held_out(out.select("doc_id", "score"), labels.select("doc_id", F.col("toxic").alias("y")), "y", 4, 2)
    assert 0 <= score.min() and score.max() <= 1 and area(score, label) > 0.7
    assert set(model.by_lang) == {"de", "en", "es", "fr"}
    odd = documents(spark, tmp_path, awkward(), clashing=True)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["_score"] <= 1 for r in rows)
    assert len({r["_score"] for r in rows if not r.text}) == 1
    assert toxicity.scored(odd.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_toxicity_learns_planted_words():
    """Two thousand words, two of them toxic, and one toxic pair of harmless words."""
    rng = random.Random(15)

    def text(bad):
        found = [f"w{rng.randrange(2000)}" for _ in range(rng.randint(5, 120))]
        if bad:
            at = rng.randrange(len(found))
            found[at:at] = rng.choice([["vile"], ["Awful,"], ["you", "there"]])
        elif rng.random() < 0.3:
            found.insert(rng.randrange(len(found)), rng.choice(["you", "there"]))
        return " ".join(found)

    label = np.array([i % 3 == 0 for i in range(900)]).astype(int)
    hashes = [toxicity.word_hashes(text(y)) for y in label]
    model = toxicity.train(hashes[:600], label[:600], epochs=20)
    docs = [toxicity.word_ids(h, model.known) for h in hashes[600:]]
    found = toxicity.pooled(model.tables(), model.shift, docs)
    assert area(found @ model.output[:-1], label[600:]) > 0.9


def test_pooling_in_parts_is_that_of_the_whole(monkeypatch):
    rng = np.random.default_rng(21)
    model = toxicity.train([np.arange(50, dtype=np.uint32)] * 4, np.array([0, 1, 0, 1]), 1)
    docs = [rng.integers(1, 52, n) for n in (0, 1, 10, 11, 12, 300, 77, 20)]
    whole = toxicity.pooled(model.tables(), model.shift, docs)
    monkeypatch.setattr(toxicity, "_WORDS", 10)
    assert np.allclose(toxicity.pooled(model.tables(), model.shift, docs), whole, atol=1e-6)


def test_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(17)
    docs = [rng.integers(2, 8, n) for n in (4, 7, 1)]
    label = np.array([1, 0, 1])
    model = toxicity.train([np.arange(6, dtype=np.uint32)] * 2, np.array([0, 1]), 0)
    # In double precision, and away from ties.
    model.embedding = rng.normal(size=model.embedding.shape)
    model.embedding[:2] = 0
    model.filters = [rng.normal(size=f.shape) for f in model.filters]
    model.shift, model.output = rng.normal(size=model.shift.shape), rng.normal(size=model.output.shape) / 3

    def loss():
        margin = toxicity.pooled(model.tables(), model.shift, docs).astype(float) @ model.output[:-1] + model.output[-1]
        return np.mean(np.logaddexp(0, -np.where(label == 1, margin, -margin)))

    found = toxicity._gradients(model, docs, label)
    for value, gradient in zip([model.embedding, *model.filters, model.shift, model.output], found, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if value is model.embedding and at[0] < 2:
                continue
            before, step = value[at], 1e-3
            value[at] = before + step
            up = loss()
            value[at] = before - step
            down = loss()
            value[at] = before
            assert abs((up - down) / (2 * step) - gradient[at]) < 2e-3


def test_quality(spark, tables, tmp_path):
    docs, labels = tables
    out = quality.scored(docs.select("doc_id", "text"), labels)
    assert out.columns == ["doc_id", "score"]
    score, label = held_out(out, labels, "quality", 4, 2)
    assert 0 <= score.min() and score.max() <= 1 and area(score, label) > 0.98
    assert ((score >= 0.7) == label).mean() > 0.95
    odd = documents(spark, tmp_path, awkward(), clashing=True)
    rows = quality.scored(odd, labels).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["_score"] <= 1 for r in rows)
    assert quality.scored(odd.limit(0), labels).count() == 0


@pytest.mark.parametrize("pooled, diagonal", [(0.0, 0.0), (0.3, 0.1)])
@pytest.mark.parametrize("n", [(4000, 4000), (4000, 60)])
def test_quadratic_discriminant(n, pooled, diagonal):
    """Against the log densities of two normal distributions with shrunk covariances: each class's
    own, drawn to that of both by ``pooled`` and by the statistics per row it has."""
    rng = np.random.default_rng(18)
    d = len(quality.NAMES)
    x = [rng.normal(size=(n[i], d)) @ rng.normal(size=(d, d)) * 0.3 + i for i in (0, 1)]
    counts = np.array(n, dtype=float)
    sums, squares = np.stack([a.sum(axis=0) for a in x]), np.stack([a.T @ a for a in x])
    model = quality.model_of(counts, sums, squares, pooled, diagonal)

    centred = np.concatenate([a - a.mean(axis=0) for a in x])
    common = centred.T @ centred / (len(centred) - 2) + 1e-4 * np.eye(d)
    common[~np.eye(d, dtype=bool)] *= 1 - diagonal

    def density(data, rows):
        share = 1 - (1 - pooled) * (1 - d / (d + len(data)))
        cov, delta = (1 - share) * np.cov(data.T) + share * common, rows - data.mean(axis=0)
        mahalanobis = np.einsum("ij,jk,ik->i", delta, np.linalg.inv(cov), delta)
        return np.log(len(data)) - 0.5 * (mahalanobis + np.linalg.slogdet(cov)[1])

    rows = np.concatenate([x[0][:50], x[1][:50]])
    want = density(x[1], rows) - density(x[0], rows)
    assert np.allclose(model.margin(rows), want, rtol=1e-6, atol=1e-6)
    assert (np.sign(want) == np.repeat([-1, 1], 50)).mean() > 0.9


def test_language(spark, tables, tmp_path):
    docs, _ = tables
    model = language.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    out = language.identified(docs, model)
    rows = out.where(in_fold(F.col("doc_id"), 3, 1)).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    odd = documents(spark, tmp_path, [*awkward(), (5000, "12 34 - !", "en", None, None)], clashing=True)
    found = language.identified(odd, model)
    assert set(CLASHING) <= set(found.columns) and found.count() == len(awkward()) + 1
    for r in found.join(odd.select("doc_id", "text"), "doc_id").collect():
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter)
    assert language.identified(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("step", [1, 2, 3, 7])
def test_language_features_of_parts_are_those_of_the_whole(monkeypatch, step):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab  é\n.Ü中", k=n)) for n in (0, 1, 2, 3, 10, 50, 500)]
    whole = [language.features(t) for t in texts]
    monkeypatch.setattr(language, "_STEP", step)
    assert all(np.array_equal(language.features(t), w) for t, w in zip(texts, whole, strict=True))


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 5, 12, 100):
        table = language.codewords(n)
        assert len(table) == n and set(table.ravel()) <= {-1, 1}
        apart = [(table[i] != table[j]).sum() for i in range(n) for j in range(i)]
        assert n == 1 or min(apart) >= max(1, 2 ** (min(n, 5) - 2))


def test_nothing_to_learn(spark, tables):
    docs, labels = tables
    few = docs.limit(5)
    for none in (labels.limit(0), labels.where("toxic = 0 AND quality = 1"), labels.limit(1)):
        model = toxicity.fit(few, none)
        assert toxicity.scored(few, model).where("score BETWEEN 0 AND 1").count() == 5
        assert quality.scored(few, none).where("score BETWEEN 0 AND 1").count() == 5
    model = language.fit(docs.limit(0))
    assert language.identified(few, model).where("lang_pred = 'und' AND score = 0").count() == 5
    alone = language.fit(docs.where("lang = 'en'").limit(20))
    assert {r.lang_pred for r in language.identified(few, alone).collect()} <= {"en", "und"}


def test_sample_is_bounded(spark):
    rows = [(i, i % 5 == 0, i % 2) for i in range(3000)] + [(None, True, 1), (1, None, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic boolean, quality int")
    sample, totals = labelled.labelled_sample(labels, "toxic", 100, 4, 2)
    assert len(sample) == 200 and sum(y for _, y in sample) == 100
    assert 0.7 * 3000 < sum(totals.values()) < 0.8 * 3000
    assert sample == labelled.labelled_sample(labels.orderBy(F.rand()), "toxic", 100, 4, 2)[0]
