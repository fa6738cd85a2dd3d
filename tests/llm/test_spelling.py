"""Spelling variants against brute force, with hot lists, long words and pruned dictionaries."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitchspark.llm import spelling
from pitchspark.llm.queries import spelling_variants
from tests.llm.helpers import awkward, documents


def brute_groups(words, factor=10):
    """{word: (form, root, n, n_near, form_n)} by comparing words that share a deletion."""
    close = defaultdict(set)
    for w in words:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            close[v].add(w)
    near = defaultdict(set)
    for group in close.values():
        for a in group:
            near[a] |= {b for b in group if brute_near(a, b)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= factor * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words.get(form.get(w)))
    return out


def brute_near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1] == 1


def made_words(seed, n, letters="abc"):
    """Words of few syllables, with copies that hold one edit."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choices(letters, k=rng.randint(1, 3))) for _ in range(12)]
    words = {}
    while len(words) < n:
        word = "".join(rng.choices(syllables, k=rng.randint(3, 8)))
        words[word] = rng.choice([1, 2, 30, 400, 5000])
        i, c = rng.randrange(len(word) + 1), rng.choice(letters + "é")
        edited = [word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]]
        words[rng.choice(edited)] = rng.choice([1, 3, 40])
    return {w: c for w, c in words.items() if len(w) >= 7}


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "word string, n long")
    rows = spelling.variant_groups(df, **options).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("options", [
    {}, {"prune": 5, "run": 8}, {"prune": 0, "max_grams": 10}, {"qmin": 3, "qmax": 4, "prune": 20}
])
def test_variants_match_brute_force(spark, options):
    words = made_words(1, 500)
    assert found(spark, list(words.items()), **options) == brute_groups(words)


def test_a_word_that_repeats_grams_and_a_long_one(spark):
    words = {"a" * 7: 500, "a" * 8: 40, "a" * 300: 3, "a" * 301: 60, "ab" * 40: 2, "ab" * 40 + "a": 9,
             "ab" * 20 + "c" + "ab" * 20: 100, "a" * 150 + "b" + "a" * 149: 7}
    assert found(spark, list(words.items()), prune=2) == brute_groups(words)


def test_a_chain_of_forms_leads_to_its_end(spark):
    words = {"abcdefg" + "x" * i: 10**i for i in range(9)}
    got = found(spark, list(words.items()))
    assert got == brute_groups(words)
    assert {root for _, root, *_ in got.values()} == {"abcdefgxxxxxxxx"}


def test_ties_take_the_smallest_by_code_points(spark):
    words = {"abcdefg": 1, "abcdefz": 10, "abcdefé": 10, "abcdef\U0001f600": 10}
    got = found(spark, list(words.items()))
    assert got["abcdefg"] == ("abcdefz", "abcdefz", 1, 3, 10)
    assert got == brute_groups(words)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [("abcdefg", 2), ("abcdefg", 3), (None, 4), ("abcdefgh", None), ("abcdefgh", 50)]
    want = brute_groups({"abcdefg": 5, "abcdefgh": 50})
    assert found(spark, rows) == want
    df = spark.createDataFrame(rows, "word string, n long").selectExpr(
        "*", "n AS key", "n AS size", "word AS a", "word AS root", "n AS n_near", "n AS best"
    )
    assert {r.word: r.root for r in spelling.variant_groups(df).collect()} == {w: v[1] for w, v in want.items()}
    assert found(spark, []) == {}
    with pytest.raises(ValueError, match="code points"):
        found(spark, [("short", 1)])
    with pytest.raises(ValueError, match="factor"):
        found(spark, rows, factor=1)


def test_no_gram_that_an_edit_spares_is_counted_as_affected():
    """The bound of every word against the grams that are lost in each of its edits."""
    rng = random.Random(3)
    words = list(made_words(4, 150, "ab"))
    counts = Counter(w[p : p + q] for w in words for q in range(2, 6) for p in range(len(w) - q + 1))
    dictionary = {
        g: (n, n > 12 and len(g) < 5) for g, n in counts.items() if len(g) == 2 or counts[g[:-1]] > 12
    }
    for word in rng.sample(words, 80):
        grams = spelling.decomposed(word, dictionary, 2, 5)
        bound = spelling.affected(word, grams, dictionary, 2, 5)
        for i in range(len(word) + 1):
            for other in (word[:i] + "b" + word[i:], word[:i] + word[i + 1 :], word[:i] + "a" + word[i + 1 :]):
                if not brute_near(word, other) or len(other) < 7:
                    continue
                them = spelling.decomposed(other, dictionary, 2, 5)
                start = {(p, g) for p, g in enumerate(them)}
                end = {(len(other) - p, g) for p, g in enumerate(them)}
                kept = sum((p, g) in start or (len(word) - p, g) in end for p, g in enumerate(grams))
                assert kept >= len(grams) - bound


def test_one_edit_and_letters_agree_with_the_definition():
    rng = random.Random(5)
    words = list({"".join(rng.choices("ab\0é", k=rng.randint(1, 6))) for _ in range(150)})
    letters = spelling.Letters(np.array(words, dtype=object), np.array(list(map(len, words))))
    pairs = [(i, j) for i in range(len(words)) for j in range(i) if abs(len(words[i]) - len(words[j])) <= 1]
    a, b = letters.near(*np.array(pairs).T)
    want = {(i, j) for i, j in pairs if brute_near(words[i], words[j])}
    assert set(zip(a.tolist(), b.tolist())) == want
    assert {(i, j) for i, j in pairs if spelling.one_edit(words[i], words[j])} == want


def brute_words(rows):
    runs, lower = re.compile("[A-Za-zÀ-ÿ]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for doc_id, text in rows:
        for run in runs.findall(text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute_groups(brute_words([(r.doc_id, r.text) for r in docs]))
    df = spelling_variants(spark, sf)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint",
                               "n_near": "bigint", "form_n": "bigint"}
    rows = df.collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want
    assert len(rows) == len(want) and any(r.form for r in rows)


def test_query_takes_awkward_documents(spark, tmp_path):
    rows = awkward() + [(900 + i, "Überfluß MERCHANT merchant's merchantes" * 3, None, None, None) for i in range(40)]
    documents(spark, tmp_path, rows, clashing=True).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_groups(brute_words([(r[0], r[1]) for r in rows]))
    got = spelling_variants(spark, str(tmp_path)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
