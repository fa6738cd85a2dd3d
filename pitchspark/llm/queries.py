"""The registered queries of this package, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchspark.llm import (
    embeddings,
    exact_dedup,
    filter_audit,
    html_layout,
    language,
    mixing,
    packing,
    quality,
    secret_links,
    simhash,
    spelling,
    token_files,
    toxicity,
)
from pitchspark.llm.common import in_fold, shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), folds=4, held_out=2)
    return toxicity.scored(docs, model).select(
        "doc_id",
        in_fold(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = shared_path(spark, "token-files")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.with_crc32(token_files.read_tokens(spark, path), "ids", "ids_crc32")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed(docs, tokenizer, end_id=2, keep_ids=False)


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(_table(spark, sf_dir, "embeddings"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        "kept",
    )


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("row")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels")
    return quality.scored(docs, labels, folds=4, held_out=2).select(
        "doc_id",
        in_fold(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs, folds=3, held_out=1)
    return language.identified(docs.select("doc_id", "text"), model).select(
        "doc_id",
        in_fold(F.col("doc_id"), 3, 1).alias("held_out"),
        "lang_pred",
        "score",
        "ambiguous",
    )


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = docs.select("doc_id", F.explode(spelling.runs_of_letters(docs)).alias("run"))
    # What is too short can't become longer; rows alike in a document stay alike.
    runs = runs.where(F.length("run") >= 7)
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    h = F.crc32(F.encode(name, "utf-8"))
    place = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    words = (
        runs.select(F.when(h % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
        .where(F.length("word") >= 7)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where("n >= 2")
    )
    return spelling.variant_groups(words)


def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.masked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return filter_audit.audit(masks, "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})


def secrets_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.secret_spans(_table(spark, sf_dir, "documents"))

    def number(kind: str):
        return F.size(F.filter("certain", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secret_links.listed(F.col("certain")), 256).alias("base_sha256"),
        secret_links.listed(F.concat("certain", "linked")).alias("spans"),
    )


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxic_scores,
        "op2_token_output": token_output,
        "op3_best_fit_packing": best_fit_packing,
        "op4_embedding_dedup": embedding_dedup,
        "op5_html_text": html_text,
        "op6_simhash_dedup": simhash_dedup,
        "op7_mix_sources": mix_sources,
        "op8_exact_dedup": exact_copies,
        "op9_quality": quality_scores,
        "op10_language": languages,
        "op11_spelling": spelling_variants,
        "op12_filter_audit": filter_interactions,
        "op13_secrets": secrets_found,
    }


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0
    ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, list_extract([3.0, 1.0, 2.0]::DOUBLE[], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w,
    source_size * 2.0::DOUBLE AS cap
  FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM ranked
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(cap, w * coalesce(
    max(CASE WHEN level * w <= cap THEN level END) OVER (), 'inf'::DOUBLE)) AS target
  FROM levels
), rated AS (
  SELECT doc_id, sized.source, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source
), drawn AS (
  SELECT *, ('0x' || substr(md5('mix' || i || ':' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
    / 4294967296.0::DOUBLE AS draw
  FROM rated CROSS JOIN range(16) seeds(i)
), taken AS (
  SELECT *, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM drawn
), chosen AS (
  SELECT source, arg_min(i, [off, i]) AS i FROM (
    SELECT source, i, abs(sum(taken)::DOUBLE - target) AS off FROM taken GROUP BY source, i, target
  ) GROUP BY source
)
SELECT doc_id, size, source_size, target, taken
FROM taken JOIN chosen ON taken.source IS NOT DISTINCT FROM chosen.source AND taken.i = chosen.i
"""

EXACT_SQL = r"""
WITH clean AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), best AS (
  SELECT *, row_number() OVER same AS place, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER same AS keep_id
  FROM clean WINDOW same AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM best
"""

EMBEDDING_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least_of ON least_of.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""

AUDIT_SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words
  FROM documents
), failing AS (
  SELECT doc_id, part, (len(words) < 200)::INT
    + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM own
), marks AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic
  FROM labels GROUP BY doc_id
), alike AS (
  SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY ALL
), letters AS (SELECT unnest(range(5)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT array_to_string(list_transform(o, lambda i: chr((65 + i)::INT)), '') AS filter_order, step,
    (1 << o[step]) AS bit,
    list_sum(list_transform(o[1:step - 1], lambda i: 1 << i))::BIGINT AS before
  FROM orders, range(1, 6) r(step)
), counted AS (
  SELECT part, filter_order, step, bit,
    sum(n * ((mask & (coalesce(before, 0) | bit)) = 0)::INT) AS kept,
    sum(n * ((mask & bit) > 0 AND (mask & coalesce(before, 0)) = 0)::INT) AS removed,
    sum(n * ((mask & bit) > 0 AND (mask & coalesce(before, 0)) > 0)::INT) AS redundant,
    sum(n * (mask = bit)::INT) AS unique_fails,
    sum(n * good * ((mask & bit) > 0 AND (mask & coalesce(before, 0)) = 0)::INT) AS good_lost,
    sum(n * toxic * ((mask & bit) > 0 AND (mask & coalesce(before, 0)) = 0)::INT) AS toxic_lost
  FROM alike, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op4_embedding_dedup": EMBEDDING_SQL,
        "op7_mix_sources": MIX_SQL,
        "op8_exact_dedup": EXACT_SQL,
        "op12_filter_audit": AUDIT_SQL,
    }
