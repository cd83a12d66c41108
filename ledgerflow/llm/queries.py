"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat, decontam, jaccard, langid, lines, packing, pii, pivots, spelling, toxicity, urlfilter, wavelet
from .common import load


def op1_pii_boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(load(spark, sf_dir, "documents"))


def op2_language_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op3_toxicity_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_decontaminate_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), unnamed=True)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard(load(spark, sf_dir, "documents"))


def op6_pack_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op7_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    conv = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return chat.format_and_read_back(conv.unionByName(extra))


def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.wavelet_documents(load(spark, sf_dir, "documents"))


def op9_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(load(spark, sf_dir, "pages"))


def op10_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(load(spark, sf_dir, "embeddings"))


def op11_centroids_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(load(spark, sf_dir, "embeddings"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(load(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_boosted_spans,
        op2_language_rank_order,
        op3_toxicity_instances,
        op4_decontaminate_aligned,
        op5_ngram_jaccard_join,
        op6_pack_configurations,
        op7_chat_prefix_targets,
        op8_wavelet_shards,
        op9_url_automaton,
        op10_pivot_permutations,
        op11_centroids_simplex,
        op12_line_dedup,
        op13_spelling_variants,
    )
}
SQL = {"op9_url_automaton": urlfilter.SQL, "op11_centroids_simplex": centroids.SQL, "op12_line_dedup": lines.SQL}
