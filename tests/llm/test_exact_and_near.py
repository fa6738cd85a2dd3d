import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pitchspark.llm import components, exact_dedup, golay, jaccard, simhash
from pitchspark.llm.common import WORD, settled
from tests.llm.helpers import CLASHING, awkward, documents, words

SPACE = re.compile(r"[\x20\x09-\x0D]")


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is not None, doc_id or 0))
    out = []
    for norm, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for i, m in enumerate(sorted(members)):
            ids = [x[2] if x[1] else None for x in (m, best)]
            out.append((*ids, len(members), i == 0, sha))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [7, 64, 4096])
def test_exact_groups(spark, tmp_path, block_bytes):
    rows = awkward()
    docs = documents(spark, tmp_path, rows, clashing=True)
    got = exact_dedup.exact_groups(docs, block_bytes).drop("row")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_exact(rows)
    stays = exact_dedup.drop_exact_copies(docs, block_bytes)
    assert stays.columns == docs.columns and set(CLASHING) <= set(stays.columns)
    assert stays.count() == len({SPACE.sub("", r[1] or "") for r in rows})


def test_exact_groups_split_over_partitions(spark, tmp_path):
    """One block on most rows, cut over many sort partitions, keeps one name."""
    rows = [(i, "same " * 300 if i % 3 else f"other {i // 9}", None, None, None) for i in range(600)]
    docs = documents(spark, tmp_path, rows)
    got = exact_dedup.exact_groups(docs, 64).drop("row")
    assert Counter(tuple(r) for r in got.collect()) == brute_exact(rows)


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, tmp_path, [])
    assert exact_dedup.exact_groups(docs).count() == 0
    assert simhash.simhash_groups(docs).count() == 0
    assert exact_dedup.drop_exact_copies(docs).count() == 0
    assert simhash.drop_near_copies(docs).columns == docs.columns
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_connected(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    links += [(i, i + 1) for i in range(1000, 1060)]  # a long path
    links += [(2000, i) for i in range(2001, 2100)] + [(5, 5), (-4, 7)]
    want = union_find({n for p in links if p[0] != p[1] for n in p}, links)
    got = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    nodes, root = components.roots(np.array([a for a, b in links]), np.array([b for a, b in links]))
    assert dict(zip(nodes.tolist(), root.tolist(), strict=True)) == want | {5: want.get(5, 5)}


def test_golay_code():
    """Perfect: each word within three bits of one codeword, so all words decode to one in reach."""
    rng = np.random.default_rng(2)
    found = rng.integers(0, 1 << 23, 5000).astype(np.uint32)
    index = golay.decode(found)
    assert index.max() < 1 << 12 and len(np.unique(golay.decode(np.arange(1 << 23, dtype=np.uint32)))) == 4096
    zero = golay.decode(np.array([0], dtype=np.uint32))[0]
    for bits in combinations(range(23), 3):
        assert golay.decode(np.array([sum(1 << b for b in bits)], dtype=np.uint32))[0] == zero


def brute_print(text, n=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(WORD, lower)
    shingles = [" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
    shingles = shingles or ([" ".join(found)] if found else [])
    if not shingles:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for _, text, *_ in awkward():
        assert simhash.fingerprint(text) == brute_print(text)


def test_keys_find_every_pair():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for bits in range(1, 5):
        flips = np.zeros(len(prints), dtype=np.uint64)
        for i in range(len(prints)):
            for b in rng.choice(64, bits, replace=False):
                flips[i] |= np.uint64(1) << np.uint64(b)
        found = [simhash.key_rows(p) for p in (prints, prints ^ flips)]
        sets = [defaultdict(set), defaultdict(set)]
        for (keys, places), into in zip(found, sets, strict=True):
            for k, p in zip(keys.tolist(), places.tolist(), strict=True):
                into[p].add(k)
        assert all(sets[0][i] & sets[1][i] for i in range(len(prints)))
        assert max(map(len, sets[0].values())) <= 3 * 12 + 3 * 6


@pytest.mark.parametrize("run", [8, 4096])
def test_linked_prints(spark, run):
    """Chains and dense groups of fingerprints, with few and with large keys."""
    rng = np.random.default_rng(6)
    found = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 120)]
    for base in found[:4]:
        for _ in range(40):
            flip = sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 6), replace=False))
            found.append(base ^ flip)
    found = sorted({*found, 0, 1, 7, 255, -1})
    links = [(a, b) for a, b in combinations(found, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    want = union_find({n for p in links for n in p}, links)
    table = spark.createDataFrame([(x,) for x in found], "print long")
    got = simhash.linked_prints(table, run=run).collect()
    assert {r.node: r.root for r in got} == want


def test_simhash_groups(spark, tmp_path):
    rng = random.Random(8)
    rows = awkward()
    base = words(rng, 400).split()
    for i in range(30):
        near = list(base)
        for _ in range(rng.randint(0, 2)):
            near[rng.randrange(len(near))] = "changed"
        rows.append((1000 + i, " ".join(near), "en", "s1", None))
    docs = documents(spark, tmp_path, rows, clashing=True)
    prints = [brute_print(r[1]) for r in rows]
    links = [
        (i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4
    ]
    assert len(links) > 100
    root = union_find(range(len(rows)), links)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root[i]].append(r[0])
    smallest = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    want = Counter((r[0], prints[i], smallest[root[i]]) for i, r in enumerate(rows))
    got = simhash.simhash_groups(docs).collect()
    mask = (1 << 64) - 1
    assert Counter((r.doc_id, r["print"] & mask, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(ids)
    assert all(r.doc_id == r.component_id for r in got if r.kept)
    stays = simhash.drop_near_copies(docs)
    assert stays.columns == docs.columns and stays.count() == len(ids)


def test_xxhash_agrees_with_spark(spark):
    texts = ["", "a", "word word word word", "é" * 40, "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] & (1 << 64) - 1 for r in rows.select(F.xxhash64("t")).collect()]
    assert got == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("made", ["repartitioned", "joined", "shuffled"])
def test_tables_that_are_not_stored_lose_no_text(spark, tmp_path, made):
    """Rows that Spark may deal out otherwise in each scan: what stays is right all the same."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    table = {
        "repartitioned": lambda: docs.repartition(7),
        "joined": lambda: docs.join(labels, "doc_id", "left").repartition(5, "toxic"),
        "shuffled": lambda: docs.orderBy(F.rand()),
    }[made]()
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r.text)].append((-len(r.text), r.doc_id))
    kept = exact_dedup.drop_exact_copies(table).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(g)[1] for g in groups.values())
    assert {r.doc_id: r.text for r in kept}.items() <= {r.doc_id: r.text for r in rows}.items()
    for drop in (simhash.drop_near_copies, jaccard.drop_near_copies):
        want = sorted(r.doc_id for r in drop(docs).collect())
        assert sorted(r.doc_id for r in drop(table).collect()) == want


def test_a_plain_scan_is_not_written_again(spark, tmp_path):
    docs = documents(spark, tmp_path, awkward())
    for same in (docs, docs.select("doc_id", "text"), docs.withColumn("x", F.upper("text"))):
        assert settled(same, "t") is same
    for other in (docs.limit(3), docs.repartition(2), docs.withColumn("x", F.rand()), docs.unionAll(docs)):
        assert settled(other, "t") is not other
