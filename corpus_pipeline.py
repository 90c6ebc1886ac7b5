"""Corpus pipeline: five stages over ``documents``, each written and reread.

1. toxicity — documents that the model rejects go.
2. near_duplicates — one document of each group of near copies stays
   (five-word shingles, Jaccard similarity of 0.8 or more).
3. personal_data — personal data and secrets are replaced by tags.
4. mixing — sources are brought to their weights along the curriculum; the rows
   are the training order, repeats included.
5. packing — the ids of the mixed documents are packed into windows.

All but the last return the columns of ``documents``. SQL can't express the
stages (a fitted model, sketches, parsers, a tokenizer), so ``ORACLE_SQL`` is
None and the stages are tested against brute-force versions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import table
from ledgerlens.llm.llm_queries import tokenizer_path
from ledgerlens.llm.mixing import mix, training_order
from ledgerlens.llm.near_duplicates import find_groups
from ledgerlens.llm.packing import pack
from ledgerlens.llm.pii import mask_documents
from ledgerlens.llm.toxicity import keep_clean, learn
from ledgerlens.session import checkpoint_dir

ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id stay as they are; of rows that repeat an id, the first by a hash of the row stays."""
    kept = find_groups(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))
    one = docs.join(kept, "doc_id", "left_semi").withColumn("__nth", nth).filter("__nth = 1")
    return one.select(*docs.columns).union(docs.filter("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(mask_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(training_order(docs, mix(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text it describes."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, over the whole ``documents`` table."""
    folder = f"{checkpoint_dir(spark)}/ledgerlens-pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        step(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
