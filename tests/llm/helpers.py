"""Small tables with the awkward cases that every operator must take."""

import random
import zlib

import numpy as np
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns whose names operators use themselves.
CLASHING = ["row", "name", "size", "score", "text_sha256", "row_number", "copies", "print", "kept"]


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(n))


def awkward(seed=1, n=60):
    """Rows of documents: nulls in every column, empty and long texts, copies, repeated rows."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randint(1, 80)) for _ in range(n)]
    texts += [None, None, "", "", "  \n ", " ", " ", "é ü ß", "<|endoftext|> x", "a  b\n\n  c "]
    texts += [words(rng, 9000), words(rng, 9000)]
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1] + " ", texts[-1]]
    base = words(rng, 200)
    texts += [base, base + " tail", base.replace("a", "b", 1), base.upper()]
    rows = [
        (i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", None]), None)
        for i, t in enumerate(texts)
    ]
    rows += [rows[3], rows[3], (None, texts[5], None, None, None), (None, None, "en", "s1", 5)]
    return rows


def documents(spark, tmp_path, rows, clashing=False):
    """A stored table, as operators that number rows ask for."""
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if clashing:
        for c in CLASHING:
            df = df.selectExpr("*", f"doc_id AS `{c}`")
    path = str(tmp_path / f"documents-{len(rows)}-{clashing}.parquet")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def crc32(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())
