"""The pipeline's product holds what sequences are built from."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import crc32

SF = "/root/testdata/sf0.001"


def test_sequences_hold_their_tokens(spark):
    """Sequences from the last stage alone; a repeated document is in them twice."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    docs = docs.unionAll(docs)
    rows = corpus_pipeline.sequences(spark, docs, SF).collect()
    assert all(crc32(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    places = {(r.sequence_id, r.offset): r.ids for r in rows}
    assert len(places) == len(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(
        x for r in docs.collect() for x in [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
    )
    assert sorted(x for ids in places.values() for x in ids) == want
