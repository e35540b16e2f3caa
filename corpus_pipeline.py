"""Training-data pipeline over ``documents``: five stages, each written as
Parquet and read again before the next.

1. toxicity: rows scored 0.7 or more go
2. near duplicates: of each SimHash component the row with the smallest id stays
3. decontamination: rows that hold a benchmark passage go
4. secrets: values found to be secrets are masked in the text
5. encoding: ids of the remaining texts, with digests
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.llm import bpe, decontam, secret_scan, simhash, toxicity
from gradeflow.llm.common import table, write_scratch

SHINGLE_WORDS, MAX_BITS = 3, 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, words_per_shingle=SHINGLE_WORDS, radius=MAX_BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.leaks(docs, table(spark, sf_dir, "benchmark"), pass_through=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("encoding", encode)]

#: Learned scores, fingerprint links and merges have no SQL form; the stages
#: are tested one by one against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs.select(*[F.col(c) for c in docs.columns])
