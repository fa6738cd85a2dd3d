import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitchspark.llm import embeddings, mixing
from tests.llm.helpers import awkward, documents, words
from tests.llm.test_exact_and_near import union_find


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """By rounds of resharing, in the words of the contract."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        parts = {s: left * w[s] / total for s in free}
        left = 0.0
        for s, part in parts.items():
            target[s] += part
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def test_targets(spark):
    rng = random.Random(12)
    for trial in range(8):
        names = [None, *[f"s{i}" for i in range(trial)], "Z", "é"][: trial + 1]
        sizes = {s: rng.choice([0, 1, 10, 500, 100_000]) for s in names}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(table).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_mixed(spark, tmp_path):
    rows = awkward()
    docs = documents(spark, tmp_path, rows, clashing=True)
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "_size", "source_size", "target", "_copies"]
    sizes = defaultdict(int)
    count = lambda t: len((t or "").encode().split())
    for r in rows:
        sizes[r[3]] += count(r[1])
    target = brute_targets(sizes)
    got = out.select("doc_id", "text", "source", "_size", "source_size", "target", "_copies").collect()
    assert len(got) == len(rows)
    def times_of(r, seed):
        rate = r.target / r.source_size
        name = f"mix{seed}:{'' if r.doc_id is None else r.doc_id}"
        draw = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) / 2**32
        return math.floor(rate) + (draw < rate - math.floor(rate))

    seed = {}
    for s in sizes:
        own = [r for r in got if r.source == s]
        off = [abs(sum(r["_size"] * times_of(r, i) for r in own) - own[0].target) for i in range(16)]
        seed[s] = off.index(min(off))
    for r in got:
        assert r["_size"] == count(r.text) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, target[r.source])
        assert r["_copies"] == times_of(r, seed[r.source]) <= 2
    again = mixing.mix(docs)
    assert again.columns == docs.columns
    times = Counter({(r.doc_id, r.text): 0 for r in got})
    for r in got:
        times[r.doc_id, r.text] += r["_copies"]
    assert Counter((r.doc_id, r.text) for r in again.collect()) == +times
    assert mixing.mix(documents(spark, tmp_path, [])).count() == 0


def test_taken_words_come_near_the_targets(spark, tmp_path):
    rng = random.Random(13)
    rows = [
        (i, words(rng, rng.randint(1, 40)), "en", rng.choice(["a"] * 10 + ["b", "c", None]), None)
        for i in range(6000)
    ]
    out = mixing.mixed(documents(spark, tmp_path, rows))
    taken = out.selectExpr("source", "target", "size * copies AS taken").groupBy("source", "target")
    for r in taken.sum("taken").collect():
        assert abs(r["sum(taken)"] / r.target - 1) < 0.02


def brute_groups(rows, threshold):
    usable = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            usable[i] = np.array(v) / np.linalg.norm(v)
    links = [
        (i, j) for i in usable for j in usable
        if i < j and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= threshold
    ]
    degree = Counter(x for p in links for x in p)
    root = union_find(range(len(rows)), links)
    ids = defaultdict(list)
    for i, (vec_id, _) in enumerate(rows):
        ids[root[i]].append(vec_id)
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((rows[i][0], degree[i], smallest[root[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [16, 60, 4096])
@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_embedding_groups(spark, tmp_path, block, spread):
    """Tight and loose clouds of vectors, hot copies, and vectors that can't be compared."""
    rng = np.random.default_rng(14)
    base = rng.normal(size=(8, 12))
    found = [base[i % 8] + spread * 0.4 * rng.normal(size=12) for i in range(250)]
    found += [found[0]] * 70 + [2.5 * found[1], -found[1], found[2] * 1e-100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(found)]
    nan, inf = float("nan"), float("inf")
    rows += [(900 + i, v) for i, v in enumerate([
        None, [], [0.0] * 12, [None] + [1.0] * 11, [nan] * 12, [inf] + [0.0] * 11, [1.0, 2.0], [2.0, 4.0],
    ])]
    rows += [rows[5], (None, rows[7][1]), (None, None)]
    path = str(tmp_path / "v.parquet")
    spark.createDataFrame(
        [(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, number long, cell int"
    ).write.parquet(path)
    vectors = spark.read.parquet(path)
    got = embeddings.embedding_groups(vectors, 0.95, block=block, sample=150)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = got.collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_groups(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    stays = embeddings.drop_near_vectors(vectors)
    assert stays.columns == vectors.columns
    assert embeddings.embedding_groups(vectors.limit(0)).count() == 0
