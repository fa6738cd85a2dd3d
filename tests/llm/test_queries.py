"""The registered queries over whole tables, against SQL or brute force."""

import math
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import connect
from pitchspark.llm import packing, toxicity
from pitchspark.llm.queries import llm_oracles, llm_queries
from tests.llm.helpers import crc32
from tests.llm.test_exact_and_near import SPACE, brute_print, union_find
from tests.llm.test_jaccard import brute_links
from tests.llm.test_mixing_and_embeddings import brute_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_matches_its_sql(spark, name):
    df = llm_queries()[name](spark, SF)
    result = connect(SF).sql(llm_oracles()[name])
    assert sorted(result.columns) == sorted(df.columns)
    at = [result.columns.index(c) for c in df.columns]
    want = Counter(tuple(r[i] for i in at) for r in result.fetchall())
    assert Counter(tuple(r) for r in df.collect()) == want


def test_token_output(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, {}
    for r in docs:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), crc32(ids))
        start += len(ids)
    got = llm_queries()["op2_token_output"](spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    assert len(got) == len(want)


def check_packed(rows, texts):
    """``rows`` against the pieces of each of ``texts`` ((doc_id, text), repeats included)."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        at, cut, piece = 0, len(ids) % 1024 or min(1024, len(ids)), 0
        while at < len(ids):
            want[doc_id, piece, at, cut - at, crc32(ids[at:cut])] += 1
            at, cut, piece = cut, cut + 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist()
        assert sum(n for _, n in places) <= 1024
    bound = packing.lower_bound(np.array([r.length for r in rows]), 1024)
    assert len(sequences) <= bound + 1


def test_best_fit_packing(spark, docs):
    rows = llm_queries()["op3_best_fit_packing"](spark, SF).collect()
    check_packed(rows, [(r.doc_id, r.text) for r in docs])


def test_simhash_dedup(spark, docs):
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    root = union_find(prints, links)
    got = llm_queries()["op6_simhash_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        d: (f"{p:016x}", root[d]) for d, p in prints.items()
    }
    assert len(got) == len(docs)


@pytest.mark.parametrize("name, kinds", [
    ("op1_toxicity", {"score": "double", "predicted": "int"}),
    ("op9_quality", {"score": "double", "predicted": "int"}),
    ("op10_language", {"score": "double", "lang_pred": "string"}),
])
def test_classifiers_score_every_row(spark, docs, name, kinds):
    df = llm_queries()[name](spark, SF)
    types = dict(df.dtypes)
    assert all(types[k] == v for k, v in kinds.items()) and types["held_out"] == "boolean"
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == [r.doc_id for r in docs]
    assert all(0 <= r.score <= 1 for r in rows)


def test_html_text(spark):
    rows = llm_queries()["op5_html_text"](spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert "<p>" not in r.text and "track(" not in r.text
        title = unescape(pages[r.page_id].partition("<h1>")[2].partition("</h1>")[0])
        assert " ".join(title.split()) in " ".join(r.text.split())


def test_pipeline(spark, docs, tmp_path):
    """Each stage on what the one before it kept, against brute force."""
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "near dedup", "mixing", "packing"
    ]
    kept = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    rows = [df.collect() for df in kept]
    assert all(df.columns == kept[0].columns for df in kept[:-1])

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity.scored(kept[0], toxicity.fit(kept[0], labels))
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in scores.where("NOT toxic").collect()}

    groups = defaultdict(list)
    for r in rows[1]:
        groups[SPACE.sub("", r.text)].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in rows[2]} == {min(g)[1] for g in groups.values()}

    texts = [(r.doc_id, r.text) for r in rows[2]]
    root = union_find(range(len(texts)), brute_links([t for _, t in texts]))
    smallest = {}
    for i, (doc_id, _) in enumerate(texts):
        smallest[root[i]] = min(doc_id, smallest.get(root[i], doc_id))
    assert sorted(r.doc_id for r in rows[3]) == sorted(smallest.values())

    sizes = defaultdict(int)
    for r in rows[3]:
        sizes[r.source] += len(r.text.encode().split())
    target = brute_targets(sizes)
    times = Counter(r.doc_id for r in rows[4])
    for r in rows[3]:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(rate) <= times.pop(r.doc_id, 0) <= math.floor(rate) + (rate % 1 > 0)
    assert not times

    check_packed(rows[5], [(r.doc_id, r.text) for r in rows[4]])
    again = corpus_pipeline.run(spark, SF)
    shown = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r) for r in again.select(shown).collect()) == Counter(
        tuple(r[c] for c in shown) for r in rows[5]
    )


def test_held_out_is_crc32_of_the_text(spark):
    import zlib

    rows = llm_queries()["op9_quality"](spark, SF).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
