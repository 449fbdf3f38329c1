"""The registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, chat, common, fingerprint, neardup, packing, pii, prefix_trie, quality, resampling, suffix_tree, token_counts, toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def op2_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(common.table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "cut_chars")


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    return chat.read_back(chat.chat_windows(turns.union(extra), tokenizer_path("byte_bpe_50k.json")))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda c: c["base"])
    return found.select("doc_id", *(n(k) for k in pii.KINDS), F.sha2(pii.spelled(base), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(common.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op6_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = quality.scores(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(common.table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(common.table(spark, sf_dir, "documents"))


def op10_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return suffix_tree.scores(docs, suffix_tree.fit(docs))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(common.table(spark, sf_dir, "conversations"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_toxicity_chain, op2_prefix_token_counts, op3_chat_windows, op4_personal_data, op5_byte_bpe, op6_quality_attention, op7_minhash_groups, op8_configuration_packing, op9_syncmer_fingerprints, op10_kmeans_tree_neighbours, op11_suffix_tree_scores, op12_prefix_trie, op13_importance_resampling, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLES

    return dict(ORACLES)
