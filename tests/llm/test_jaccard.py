"""Near-dedup by word shingles against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from pitchspark.llm import jaccard
from pitchspark.llm.common import small_batches
from tests.llm.helpers import awkward, documents, words
from tests.llm.test_exact_and_near import union_find

SF = "/root/testdata/sf0.01"


def brute_shingles(text, n=5):
    found = (text or "").encode().lower().split()
    return frozenset(zip(*(found[i:] for i in range(n)))) or frozenset([tuple(found)])


def brute_links(texts):
    sets = [brute_shingles(t) for t in texts]
    return [
        (i, j)
        for i, j in combinations(range(len(sets)), 2)
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    ]


def changed(rng, text, times):
    found = text.split()
    for _ in range(times):
        found[rng.randrange(len(found))] = "changed"
    return " ".join(found)


@pytest.mark.parametrize("block", [4, 512])
def test_jaccard_groups(spark, tmp_path, block):
    """Copies, chains of copies of copies, and texts that only share a passage."""
    rng = random.Random(5)
    rows = awkward()
    for n in (60, 200):
        text = words(rng, n)
        for i in range(25):
            rows.append((len(rows) + 500, changed(rng, text, rng.randint(0, n // 30)), "en", "s1", None))
        for i in range(15):
            text = changed(rng, text, n // 50)
            rows.append((len(rows) + 500, text, "en", "s1", None))
    passage = words(rng, 40)
    rows += [(2000 + i, f"{passage} {words(rng, 12)}", "en", "s1", None) for i in range(40)]
    docs = documents(spark, tmp_path, rows, clashing=True)
    links = brute_links([r[1] for r in rows])
    root = union_find(range(len(rows)), links)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root[i]].append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    got = jaccard.jaccard_groups(docs, block=block).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(
        (r[0], smallest[root[i]]) for i, r in enumerate(rows)
    )
    assert sum(r.kept for r in got) == len(ids)
    stays = jaccard.drop_near_copies(docs, block=block)
    assert stays.columns == docs.columns and stays.count() == len(ids)


def test_stage_drops_all_near_copies(spark):
    """What the stage keeps of real documents is one of each component at 0.8."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    root = union_find(range(len(rows)), brute_links([t for _, t in rows]))
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[root[i]] = min(doc_id, smallest.get(root[i], doc_id))
    got = corpus_pipeline.near_copies(spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(smallest.values())


def test_empty(spark, tmp_path):
    docs = documents(spark, tmp_path, [])
    assert jaccard.jaccard_groups(docs).count() == 0
    assert jaccard.drop_near_copies(docs).columns == docs.columns


def test_close_fingerprints_are_candidates(spark):
    """Rows within 4 bits of one another, over a third one too, meet at their first row; at 5 bits not."""
    prints = {3: 0, 9: 0b1111, 4: 0b11111111, 12: 0, 20: 0b11111 << 40, 21: -1, 22: -1 ^ 0b111 << 60}
    rows = spark.createDataFrame(list(prints.items()), "row long, print long")
    assert as_pairs(jaccard.close_prints(rows)) == {(3, 9), (3, 4), (3, 12), (21, 22)}


def test_candidates_by_fingerprint_alone(spark, tmp_path):
    """Without a MinHash key in common, near copies are still found by their fingerprints, and verified."""
    rng = random.Random(8)
    text = words(rng, 400)
    texts = [text, f"{text} more", "quite another text of a few words", f"{text} {words(rng, 400)}"]
    docs = documents(spark, tmp_path, [(i, t, "en", "s1", None) for i, t in enumerate(texts)]).withColumnRenamed("doc_id", "row")
    keys = spark.createDataFrame(
        [(i, 7 if i != 2 else 7 ^ 0xFFFFFF, [i]) for i in range(4)], "row long, print long, keys array<long>"
    )
    assert as_pairs(jaccard._links(docs, keys, 5, 512)) == {(0, 1)}


@pytest.mark.parametrize("block", [8, 512])
def test_links_grow_with_the_texts_of_a_key(spark, tmp_path, block):
    """A key whose first text is like none of the others, which are all alike, and a text that shares
    a passage with them only: as many links as connect them, not their pairs."""
    rng, n = random.Random(9), 40
    text = words(rng, 200)
    texts = [words(rng, 50), *(f"{text} {words(rng, 2)}" for _ in range(n)), f"{words(rng, 200)} {text}"]
    docs = documents(spark, tmp_path, [(i, t, "en", "s1", None) for i, t in enumerate(texts)]).withColumnRenamed("doc_id", "row")
    prints = [rng.getrandbits(63) for _ in texts]
    keys = spark.createDataFrame(
        [(i, p, [7, 8]) for i, p in enumerate(prints)], "row long, print long, keys array<long>"
    )
    links = [(r.a, r.b) for r in jaccard._links(docs, keys, 5, block).collect()]
    root = union_find(range(len(texts)), links)
    assert len({root[i] for i in range(1, n + 1)}) == 1
    assert len(set(root.values())) == 3
    assert len(links) < 3 * n


def test_blocks_give_no_pairs_of_texts():
    """Links of components, fewer than there are, though all texts are similar."""
    n = 60
    frame = pd.DataFrame({
        "stray": [True] * n + [False] * n,
        "row": range(2 * n),
        "root": [*range(n), *([1000] * (n // 2)), *range(n + n // 2, 2 * n)],
        "found": [np.arange(50)] * (2 * n),
    })
    got = jaccard._tested_blocks((7, 0, 0), frame)
    assert list(got.columns) == ["a", "b"] and len(got) == n + n // 2
    assert set(got["b"]) == {0} and set(got["a"]) == {*range(1, n), *range(n + n // 2, 2 * n), 1000}
    assert len(jaccard._tested_blocks((7, 0, 0), frame.query("stray"))) == 0


def test_lonely_rows_have_no_similar_one(spark):
    """A row goes if over a fifth of its members are its own; at a fifth it may still be similar."""
    rows = {1: range(10), 2: range(8), 3: [*range(8), 20], 4: [0, 1, 2, 30], 5: [0, 1, 2, 3, 40], 6: [50]}
    sets = spark.createDataFrame([(k, list(v)) for k, v in rows.items()], "row long, found array<long>")
    assert {r.row for r in jaccard._lonely(sets).collect()} == {4, 6}


def test_small_batches_are_for_a_while(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark):
        sizes = spark.range(50, numPartitions=1).selectExpr("repeat('x', 100000) AS text").mapInArrow(
            lambda batches: (b.slice(0, 1) for b in batches), "text string"
        ).count()
    assert sizes > 1 and spark.conf.get(name) == before


def as_pairs(df):
    return {(r.a, r.b) for r in df.collect()}
