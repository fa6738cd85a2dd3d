"""The audit of filter orders against a plain simulation of every order on every document."""

import random
from collections import Counter
from itertools import permutations

import pytest

from pitchspark.llm import filter_audit
from pitchspark.llm.queries import filter_interactions
from tests.llm.helpers import awkward, documents

LABELS = "doc_id long, quality int, toxic int"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute_fails(rows):
    """The letters that each row fails."""
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = text.encode().split()
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * (doc_id is not None and first[text] < doc_id)
        out.append(set(fails))
    return out


def brute_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    counts, parts = Counter(), {r[3] or "" for r in rows}
    for row, fails in zip(rows, brute_fails(rows), strict=True):
        for order in map("".join, permutations("ABCDE")):
            removed = False
            for step, f in enumerate(order, 1):
                at, hit = (row[3] or "", order, step), f in fails
                counts[at, "removed"] += hit and not removed
                counts[at, "redundant"] += hit and removed
                counts[at, "unique_fails"] += fails == {f}
                counts[at, "good_lost"] += hit and not removed and row[0] in good
                counts[at, "toxic_lost"] += hit and not removed and row[0] in toxic
                counts[(row[3] or "", f), "shapley"] += hit and not removed
                removed |= hit
                counts[at, "kept"] += not removed
    return {
        (part, order, step): tuple(
            counts[(part, order[step - 1]), c] if c == "shapley" else counts[(part, order, step), c]
            for c in COUNTS
        )
        for part in parts
        for order in map("".join, permutations("ABCDE"))
        for step in range(1, 6)
    }


def as_dict(rows):
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_documents_match_brute_force(spark, tmp_path, clashing):
    rng = random.Random(2)
    rows = awkward()
    rows += [(500 + i, rng.choice(["same", "same", "Once $ more"]), None, "s1", None) for i in range(200)]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows[::2]]
    labels += [(None, 1, 1), (3, 1, 0), (3, 0, 1), (99_999, 1, 1)]
    docs = documents(spark, tmp_path, rows, clashing)
    marks = spark.createDataFrame(labels, LABELS)
    if clashing:
        marks = marks.selectExpr("*", "doc_id AS good", "doc_id AS part", "doc_id AS mask")
        docs = docs.selectExpr("*", "doc_id AS part", "doc_id AS quality", "doc_id AS first")
    masks = filter_audit.masked(docs, marks)
    got = filter_audit.audit(masks, "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"}).collect()
    assert as_dict(got) == brute_audit(rows, labels)


def test_no_row(spark, tmp_path):
    docs, labels = documents(spark, tmp_path, []), spark.createDataFrame([], LABELS)
    masks = filter_audit.masked(docs, labels)
    assert filter_audit.audit(masks, "ABCDE", {"good_lost": "good"}).count() == 0


def test_counters_stay_apart_up_to_their_limit(spark):
    most = 2**62
    rows = [("p", 0, most), ("p", 3, most - 1), ("p", 1, 1), ("q", 2, 5)]
    masks = spark.createDataFrame(rows, "part string, mask int, rows long")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(masks, "XY", {}).collect()}
    assert len(got) == 8
    assert got["p", "XY", 1].removed == most and got["p", "XY", 1].kept == most
    assert got["p", "XY", 2].redundant == most - 1 and got["p", "XY", 2].removed == 0
    assert got["p", "XY", 1].unique_fails == 1 and got["p", "YX", 2].removed == 1
    assert got["p", "YX", 2].shapley == most + 1 and got["q", "YX", 1].removed == 5


def test_rows_of_one_mask_add_up_and_filters_are_checked(spark):
    masks = spark.createDataFrame(
        [("p", 1, 2, True), ("p", 1, 3, None), ("p", 0, 1, False)], "part string, mask int, rows long, m boolean"
    )
    row = filter_audit.audit(masks, "A", {"lost": "m"}).first()
    assert (row.kept, row.removed, row.lost, row.shapley) == (1, 5, 2, 5)
    for letters in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError, match="filters"):
            filter_audit.audit(masks, letters, {})


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()
    assert as_dict(filter_interactions(spark, sf).collect()) == brute_audit(docs, [tuple(r) for r in labels])
