"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgate.llm import bpe, centroids, decontaminate, huffman, hyperminhash, jaccard, language, language_model, pii, quality, spelling, substring, suffixes
from fitgate.llm.common import documents

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string"))


END_ID = 2


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(documents(spark, sf_dir), WORD_BPE, END_ID)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score_documents(documents(spark, sf_dir), _crc() % 10 != 0)
    held_out = F.coalesce(_crc() % 10 == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    profiles = language.learn(docs.where(_crc() % 4 != 2))
    held_out = F.coalesce(_crc() % 4 == 2, F.lit(False)).alias("held_out")
    return language.identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out, "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.stored_ledger(documents(spark, sf_dir)))
    base_failed = F.col("failed").bitwiseAND(F.lit(quality.BASE_MASK)) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"), "failed",
    )


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every policy version and each of its rules: documents that fail it, fail it alone, and would stay without it."""
    book = quality.stored_ledger(documents(spark, sf_dir))
    versions = [quality.ablations(book, v).select(F.lit(v).alias("version"), "rule", "n_failed", "n_only", "n_kept_without") for v in sorted(quality.POLICIES)]
    return reduce(DataFrame.unionByName, versions)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[pii.count_of(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.joined(pii.base_only(spans)), 256).alias("base_sha256"),
        pii.joined(spans).alias("spans"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), WORD_BPE)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir), texts=False).drop("kept")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_token_files, op2_lm_scoring, op3_language_id, op4_decontamination, op5_substring_dedup, op6_jaccard_join, op7_quality_rules, op8_pii, op9_bpe, op10_suffix_dedup,
        op11_centroid_clustering, op12_minhash_dedup, op13_spelling_variants,
        quality_rule_ablations,
    )
    return {f.__name__: f for f in named}


def _clustering_sql(k: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS) -> str:
    """The same rounds with every distance worked out."""
    size = centroids.DIMENSIONS
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('{centroids.SEED}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    square = "list_sum(list_transform(list_zip(kept.v, {c}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, kept.v, min(struct_pack(d := CAST({square.format(c=f'c{i}')} AS BIGINT), c := c)) AS m FROM kept, c{i} GROUP BY ALL)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT m.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, {size + 1}) t(j) GROUP BY ALL)")
            parts.append(f"n{i} AS (SELECT c, list((CAST(s AS BIGINT) - ((CAST(s AS BIGINT) % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} USING (c))")
    last = rounds
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, c AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c{last}.v, ',')) AS centroid_sha256
        FROM a{last} JOIN c{last} ON m.c = c"""


def _links_sql(percent: int, size: int = jaccard.SHINGLE) -> str:
    """doc_id, n_shingles and component_id by all pairs that share a shingle, and by all that links reach."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return rf"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingled AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: {shingle})) END AS s FROM worded),
        elements AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM shingled),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS c FROM elements a JOIN elements b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * c >= {percent} * (n - c)),
        reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, b FROM reached JOIN links ON a = r)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reached JOIN shingled USING (doc_id) GROUP BY doc_id, s"""


def oracle_sql() -> dict[str, str]:
    near = _links_sql(hyperminhash.PERCENT)
    return {
        "op6_jaccard_join": _links_sql(jaccard.PERCENT),
        "op11_centroid_clustering": _clustering_sql(),
        "op12_minhash_dedup": f"SELECT *, doc_id = component_id AS kept FROM ({near})",
    }
