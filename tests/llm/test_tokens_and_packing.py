import glob
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.orc as orc
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitchspark.llm import packing, token_files, tokens
from tests.llm.helpers import awkward, crc32, documents, words

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def plain(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_is_exact(path, monkeypatch):
    rng = random.Random(5)
    encode = plain(path)
    alphabet = ["a", "B", "é", "ß", "σ", "Σ", " ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "'s", ".",
                "12", "#", "<|endoftext|>", "é", "中", "🙂", "\u0085", "!"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += [r[1] for r in awkward()] + ["\n ", " \n", " ", "  ", "   ", " a", "a ", "a  ", "  a"]
    for chunk, cached in ((1_000_000, 600_000), (40, 50)):
        monkeypatch.setattr(tokens, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(tokens, "CACHED_PARTS", cached)
        got = [x.tolist() for x in tokens.Encoder(path).encode(texts)]
        assert got == [encode(t) for t in texts]


def test_token_files(spark, tmp_path):
    rows = awkward()
    docs = documents(spark, tmp_path, rows, clashing=True)
    path = str(tmp_path / "out")
    token_files.write_tokens(docs, path, WORD, end_id=2)
    got = token_files.read_tokens(spark, path).collect()
    encode = plain(WORD)
    want = Counter((r[0], tuple([*encode(r[1]), 2])) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    got.sort(key=lambda r: r.start)
    at, last = 0, None
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert last is None or r.doc_id is not None and r.doc_id >= last
        at, last = at + r.n_tokens, r.doc_id
    digest = token_files.with_crc32(token_files.read_tokens(spark, path), "ids", "crc")
    assert Counter((r.doc_id, r.crc) for r in digest.collect()) == Counter(
        (r.doc_id, crc32(r.ids)) for r in got
    )
    some = token_files.read_tokens(spark, path, F.col("doc_id").isin(3, 70))
    assert Counter(r.doc_id for r in some.collect()) == Counter(
        r[0] for r in rows if r[0] in (3, 70)
    )
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(doc_id" in plan


def test_token_files_have_stripes_indexes_and_blooms(spark, tmp_path):
    rows = [(i, "word " * 200, None, None, None) for i in range(2000)]
    docs = documents(spark, tmp_path, rows)
    path = str(tmp_path / "out")
    token_files.write_tokens(docs, path, WORD, 2, stripe_bytes=1 << 16, index_rows=1000)
    files = [f for f in glob.glob(f"{path}/tokens/*.orc") if orc.ORCFile(f).nrows]
    assert sum(orc.ORCFile(f).nrows for f in files) == 2000
    assert all(orc.ORCFile(f).row_index_stride == 1000 for f in files)
    raw = b"".join(open(f, "rb").read() for f in files)
    assert len(raw) < 2000 * 201  # runs of ids take far less than four bytes each


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, tmp_path, [])
    token_files.write_tokens(docs, str(tmp_path / "out"), WORD, 2)
    assert token_files.read_tokens(spark, str(tmp_path / "out")).count() == 0
    assert packing.packed(docs, BYTE).count() == 0


def check_packing(rows, got, capacity, end=(2,)):
    encode = plain(BYTE)
    want = Counter()
    for r in rows:
        ids = [*encode(r[1]), *end]
        at, cut, piece = 0, len(ids) % capacity or min(capacity, len(ids)), 0
        while at < len(ids):
            want[r[0], piece, at, cut - at, tuple(ids[at:cut])] += 1
            at, cut, piece = cut, cut + capacity, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, tuple(r.ids)) for r in got) == want
    assert all(r.ids_crc32 == crc32(r.ids) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("group", [20, 65_536])
def test_packing(spark, tmp_path, group):
    rows = awkward(n=150)
    docs = documents(spark, tmp_path, rows, clashing=True)
    got = packing.packed(docs, BYTE, capacity=256, group_pieces=group).collect()
    used = check_packing(rows, got, 256)
    lengths = np.array([r.length for r in got])
    bound = packing.lower_bound(lengths, 256)
    # Groups of twenty pieces leave little choice.
    assert bound <= used <= (bound + 2 if group > 20 else 1.03 * bound)
    less = packing.packed(docs, BYTE, capacity=256, group_pieces=group, keep_ids=False)
    assert "ids" not in less.columns and less.count() == len(got)


def test_packing_without_end_and_tokens(spark, tmp_path):
    rows = awkward()
    docs = documents(spark, tmp_path, rows)
    got = packing.packed(docs, BYTE, end_id=None, capacity=64).collect()
    check_packing(rows, got, 64, end=())


def test_exchange_needs_no_more_sequences(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(20, 90)), None, None, None) for i in range(400)]
    docs = documents(spark, tmp_path, rows)
    counts = []
    for rounds in (0, 6):
        got = packing.packed(docs, BYTE, capacity=512, group_pieces=25, rounds=rounds).collect()
        counts.append(check_packing(rows, got, 512))
    assert counts[1] <= counts[0]


def brute_bins(lengths, capacity):
    """Fewest bins, by trying them all."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity:
                bins[j] += lengths[i]
                place(i + 1, bins)
                bins[j] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_lower_bound_and_best_fit():
    rng = random.Random(10)
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        best = brute_bins(sorted(lengths, reverse=True), 20)
        bins, offsets = packing.best_fit(np.array(lengths), 20)
        assert packing.lower_bound(np.array(lengths), 20) <= best <= bins.max() + 1
    assert packing.lower_bound(np.array([11] * 7), 20) == 7
    assert packing.lower_bound(np.array([7] * 6), 20) == 3
    assert packing.lower_bound(np.zeros(0, int), 20) == 0
