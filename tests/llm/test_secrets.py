"""Secrets by their form against a plain search, and weak parts that are linked or not."""

import hashlib
import random
import re

from pitchspark.llm import secret_links
from pitchspark.llm.queries import secrets_found
from tests.llm.helpers import awkward, documents

HEX = "0123456789abcdef" * 2
KEY = "AKIA" + "ABCDEFGH23456789"
OPAQUE = "x9Kq2Lm7Zp4Rt8Vb1Nc6"
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]


def brute_base(text):
    """Spans by walking along the text: no regular expression for the parts of an assignment."""
    word = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    lower = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found, at = [], 0
    while at < len(text):
        name = next((n for n in NAMES if lower.startswith(n, at)), None)
        end = at + len(name) if name else None
        if name:
            end += text[end : end + 1] in ('"', "'") and text[end : end + 1] != ""
            while text[end : end + 1] == " ":
                end += 1
            if text[end : end + 1] in (":", "=") and text[end : end + 1]:
                end += 1
                while text[end : end + 1] == " ":
                    end += 1
                end += text[end : end + 1] in ('"', "'") and text[end : end + 1] != ""
                start = end
                while end < len(text) and text[end] in word:
                    end += 1
                if end > start:
                    if end - start >= 8:
                        found.append((at, 0, end))
                    at = end
                    continue
        at += 1
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]


def noise(rng):
    pieces = [*NAMES, "Password", "API_KEY", '"', "'", " ", ":", "=", ": ", ' = "', "abc", "deadbeef" * 4,
              KEY, "AKIA", "AKIA123", HEX, "A" * 9, ".", "é", "\n", "\n\n", "ſecret", "toKen", "user: bob",
              OPAQUE, "https://example.org/x", "db.local:5432", "pwd: hunter2x", "ASIA" + "B2" * 8]
    return "".join(rng.choices(pieces, k=rng.randint(1, 40)))


def spans(spark, tmp_path, rows, **options):
    df = secret_links.secret_spans(documents(spark, tmp_path, rows), **options)
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(
            ([(s.start, s.kind, s.end) for s in r.certain], [(s.start, s.kind, s.end) for s in r.linked])
        )
    return out


def linked_texts(spark, tmp_path, text, **options):
    [(_, linked)] = spans(spark, tmp_path, [(1, text, None, None, None)], **options)[1]
    return [(kind, text[start:end]) for start, kind, end in linked]


def test_certain_spans_match_a_walk_along_the_text():
    rng = random.Random(1)
    for _ in range(4000):
        text = noise(rng)
        got = [f"{k}:{s}:{e}" for s, k, e in secret_links.certain_spans(text)]
        assert got == brute_base(text), text


def brute_linked(text, gap):
    """Weak parts by comparing all parts of a text, three at a time."""
    certain = secret_links.certain_spans(text)
    weak = secret_links.weak_spans(text, certain)
    ends = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    parts = [
        (sum(e <= s for e in ends), secret_links._ROLE_OF[k], w, s, k, e)
        for found, w in ((certain, False), (weak, True)) for s, k, e in found
    ]

    def near(a, b):
        return a[0] <= b[1] + gap and b[0] <= a[1] + gap

    out = set()
    for i in parts:
        for x in parts:
            if i[1] != "identifier" or x[1] != "secret" or i[0] != x[0] or not near((i[3], i[5]), (x[3], x[5])):
                continue
            hull = (min(i[3], x[3]), max(i[5], x[5]))
            ends_ = [p for p in parts if p[1] == "endpoint" and p[0] == i[0] and near(hull, (p[3], p[5]))]
            out |= {p[3:] for p in ends_}
            if ends_ or not i[2] or not x[2]:
                out |= {p[3:] for p in (i, x) if p[2]}
    return sorted(out)


def test_links_match_a_comparison_of_all_parts(spark, tmp_path):
    rng = random.Random(2)
    texts = [noise(rng) for _ in range(300)] + ["user: bob " + OPAQUE + " db.local:5432 " + "pad " * 3000] * 3
    texts.append(" ".join(noise(rng) for _ in range(200)))
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    for gap in (0, 12, 200):
        got = spans(spark, tmp_path, rows, gap=gap)
        assert sum(bool(got[i][0][1]) for i in got) > 20 or gap == 0
        for i, text in enumerate(texts):
            assert got[i][0][1] == brute_linked(text, gap), (gap, text)


def test_weak_parts_need_what_completes_them(spark, tmp_path):
    def of(text):
        return linked_texts(spark, tmp_path, text)

    # A weak secret beside a certain identifier, and the other way round.
    assert of(f"{KEY} then {OPAQUE}") == [("opaque", OPAQUE)]
    assert of(f"user: bob {HEX}") == [("identifier", "user: bob")]
    # Two weak parts are too little, three are enough.
    assert of(f"user: bob {OPAQUE}") == []
    assert of(f"user: bob {OPAQUE} at db.local:5432") == [
        ("identifier", "user: bob"), ("opaque", OPAQUE), ("endpoint", "db.local:5432")
    ]
    # Nothing is reported alone, from another paragraph or from far away.
    for text in (f"{OPAQUE}", "user: bob", "db.local:5432", f"{KEY}\n \n{OPAQUE}", f"{KEY}{' x' * 150} {OPAQUE}"):
        assert of(text) == []
    # Words and numbers aren't secrets.
    assert of(f"{KEY} abcdefghijklmnopqrstuvwxyz 2669109448945250 https://example.org/") == []


def test_nulls_empty_long_and_repeated_texts(spark, tmp_path):
    long = "filler " * 200_000
    rows = [*awkward(), (700, None, None, None, None), (701, "", None, None, None)]
    rows += [(702, f"{long}{KEY} {OPAQUE}", None, None, None)] * 2 + [(None, HEX, None, None, None)]
    got = spans(spark, tmp_path, rows)
    assert sum(map(len, got.values())) == len(rows)
    assert got[700] == got[701] == [([], [])]
    at = len(long)
    assert got[702] == [([(at, "access", at + 20)], [(at + 21, "opaque", at + 41)])] * 2
    assert ([(0, "hex", 32)], []) in got[None]
    assert spans(spark, tmp_path, []) == {}
    clashing = documents(spark, tmp_path, rows, clashing=True).selectExpr("*", "doc_id AS parts", "doc_id AS start")
    assert secret_links.secret_spans(clashing).count() == len(rows)


def test_query_lists_spans_in_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, noise(rng), None, None, None) for i in range(300)] + awkward()[:70]
    documents(spark, tmp_path, rows).write.parquet(str(tmp_path / "documents.parquet"))
    texts = {}
    for doc_id, text, *_ in rows:
        texts.setdefault(doc_id, []).append(text or "")
    order = [*secret_links.CERTAIN, *secret_links.WEAK]
    for r in secrets_found(spark, str(tmp_path)).collect():
        shas = {hashlib.sha256(",".join(brute_base(t)).encode()).hexdigest(): brute_base(t) for t in texts[r.doc_id]}
        base = shas[r.base_sha256]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        every = r.spans.split(",") if r.spans else []
        assert set(base) <= set(every)
        keys = [(int(x.split(":")[1]), order.index(x.split(":")[0])) for x in every]
        assert keys == sorted(keys)


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = secrets_found(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(",".join(brute_base(docs[r.doc_id])).encode()).hexdigest()
