"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.alignment import align
from ledgerlens.llm.collocations import collocations
from ledgerlens.llm.common import table
from ledgerlens.llm.fingerprints import compare_edited
from ledgerlens.llm.mixing import mix
from ledgerlens.llm.near_duplicates import find_groups
from ledgerlens.llm.neighbours import nearest
from ledgerlens.llm.oracles import ORACLES  # noqa: F401 (read with QUERIES)
from ledgerlens.llm.packing import pack
from ledgerlens.llm.pages import extract
from ledgerlens.llm.pii import find_spans
from ledgerlens.llm.quality import clean_documents
from ledgerlens.llm.substrings import repeated_passages
from ledgerlens.llm.tokens import count_tokens
from ledgerlens.llm.toxicity import held_out, learn, score_documents

#: Directory entry of the public tokenizer files; a parameter, never copied.
TOKENIZER_PACKAGE = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    import importlib

    return importlib.import_module(TOKENIZER_PACKAGE).path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.size("copies").cast("long").alias("n_copies"), F.get("copies", F.lit(0))["position"].alias("first_position"),
    ).orderBy("first_position", "doc_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clean_documents(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_words",
    )


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms", "n_misspelled",
    )


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_groups(table(spark, sf_dir, "documents"), shingle_words=3, threshold_percent=85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_rules": op2_quality_rules,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_pack_sequences": op5_pack_sequences,
    "op6_personal_data": op6_personal_data,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_main_text": op8_main_text,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_token_counts": op10_token_counts,
    "op11_fingerprints": op11_fingerprints,
    "op12_collocations": op12_collocations,
    "op13_token_alignment": op13_token_alignment,
}

