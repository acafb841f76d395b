"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import table


def op1_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op2_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.maxscore import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"))


def byte_bpe_encoding() -> tuple:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, {"<|endoftext|>": 50256}


def op3_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), byte_bpe_encoding(), end_id=2)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.passage_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"), width=200, with_text=False)


def op5_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from siltstone.llm.pieces import encode_pieces

    return encode_pieces(table(spark, sf_dir, "documents"), public.path("piece_bpe_32k.model"), with_ids=False)


def op6_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), byte_bpe_encoding())


def op8_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from siltstone.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"), limit=2048)


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), bits=4, words=4, seed=42)


def op11_splitting_tree_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.mixing import mixture, words_taken

    return words_taken(mixture(table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least=30, top=50)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from siltstone.llm.alignment import alignment

    return alignment(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_anisotropic_ann, op2_maxscore_topk, op3_rans_token_files, op4_suffix_array_dedup, op5_streaming_viterbi, op6_crf_language_id, op7_best_fit_packing, op8_gru_toxicity, op9_token_counts, op10_simhash_near_duplicates, op11_splitting_tree_mix, op12_source_divergence, op13_tokenizer_alignment]
    return {f.__name__: f for f in found}


#: The score of op2 in plain SQL; those of op11 and op12 are in their modules. The others have no SQL form that runs on whole tables.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_inner_product(q.e, r.e) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id
), k AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    from siltstone.llm import divergence, mixing

    return {"op2_maxscore_topk": OP2_SQL, "op11_splitting_tree_mix": mixing.SQL, "op12_source_divergence": divergence.SQL}
