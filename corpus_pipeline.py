"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.
All but the last return the columns of ``documents``; the last returns the
pieces of packed sequences.

Nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns are handled as the operators say: documents without a letter leave at
the first stage, identical rows become one at the second, rows with a null id
pass the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, langid, mixing, near_dedup, pack
from tessera.llm.common import stored, table

#: A document leaves when no language holds this share of its n-grams.
LEAST_SCORE = 0.25
#: Target token shares by domain.
WEIGHTS = {"good": 0.88, "low": 0.07, "toxic": 0.05}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach."""
    said = langid.identify(docs, langid.train(docs))
    return said.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    return near_dedup.drop_near(docs, width=5, percent=80)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say.

    Rates are fitted so that expected token shares match ``WEIGHTS``. A
    document that is most probably good or low has a rate of 1 or more, so
    none of these is lost; toxic ones may go.
    """
    labelled = mixing.domains_of(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labelled, WEIGHTS, floor=mixing.at_least_once(list(WEIGHTS), ["good", "low"]))
    return mixing.realise(mixed, docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 1024-token sequences along the Hilbert curve, with their ids."""
    return pack.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Hashing, training and iteration are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
