"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelspark.llm import ann, decontamination, language_id, line_dedup, lm_scoring, near_dedup, packing, piece_sampling, prefix_trie, quality_rules, secret_scan, spelling, warc
from funnelspark.llm.common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{name}") for kind, name in enumerate(secret_scan.KINDS[:3])),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"),
    )


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = piece_sampling.encode_digest(docs)
    return found.select(
        "doc_id", "sample", F.col("ids.n").alias("n_ids"), F.crc32("ids.ids").alias("ids_crc32"), F.crc32("ids.text").alias("decoded_crc32"),
        "log_prob", "perturbed", "log_inclusion",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.mark(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    ranges = F.coalesce("removed_ranges", F.array().cast("array<struct<first:int,last:int>>"))
    removed = F.aggregate(ranges, F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    listed = F.array_join(F.transform(ranges, lambda x: F.concat_ws("-", x["first"], x["last"])), ",")
    text = line_dedup.without_ranges(F.col("text"), F.col("removed_ranges"))
    return marked.select("doc_id", removed.alias("removed_lines"), listed.alias("removed_ranges"), text.alias("text"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read_table(spark, sf_dir, "pages"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(read_table(spark, sf_dir, "documents"))
    return scored.withColumns({"log_score": F.round("log_score", 4), "per_word": F.round("per_word", 6)})


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(read_table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated_words(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    listed = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_scan, op2_sentencepiece_sampling, op3_line_dedup, op4_nearest_neighbours, op5_language_id, op6_warc, op7_lm_scoring, op8_minhash_near_dedup, op9_packing, op10_quality_rules,
        op11_benchmark_decontamination, op12_spelling_variants, op13_conversation_prefix_trie,
    )
}
ORACLES: dict[str, str] = {
    "op6_warc": warc.ORACLE, "op7_lm_scoring": lm_scoring.ORACLE, "op11_benchmark_decontamination": decontamination.ORACLE,
    "op12_spelling_variants": spelling.ORACLE, "op13_conversation_prefix_trie": prefix_trie.ORACLE,
}
