"""From raw documents to packed training sequences: five stages, each written and read again before the next.

Every stage takes all documents that the one before kept. All but the last return the columns of their input, among them
doc_id, text, lang, source and n_chars; other columns pass through, whatever their names. An empty table gives an empty
result in every stage. Texts are worked on whole, of any length; ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfootprint.llm import language, mixing, packing, pii, simhash
from fleetfootprint.llm.frames import free_name
from fleetfootprint.session import discard, fresh_path, scratch, settle_as


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a language that was missing is filled in, a given one stays.

    The classifier learns from the documents' own languages. Texts that are null or have no letter go; without any
    language to learn from all documents go. Rows that repeat are judged each by itself, so all of them stay or go; a
    tie between languages goes to the first by code point.
    """
    found = free_name(docs.columns, "_found")
    judged = language.identify(docs, language.fit(docs), into=found).filter(~F.col(f"{found}.rejected"))
    return judged.withColumn("lang", F.coalesce("lang", F.col(f"{found}.lang_pred"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by op10's links: 3-word shingles, at most 3 of 64 bits.

    The one with the smallest id stays (a null id comes last), of equal ids the one with the smallest hash of its row. Null, empty
    and blank texts are duplicates of each other. Rows that are the same in every column count as one.
    """
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data masked as the kind in angle brackets; no document goes.

    A null text stays null, with null n_chars; n_chars is that of the masked text. Overlapping spans are masked as
    one, by the kind of the first. Rows that repeat are masked each by itself.
    """
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, whole, as often and in the order in which the mix of sources takes them.

    A document in which its source's target ends is in where at least half of it belongs to the mix. Null, empty and blank texts have no words, so
    the mix takes none of them. A null source is a source; rows that repeat are taken each by itself; ties in the position are ordered by id.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the separator alone. A document that the mix takes several times, or that repeats, is packed as often.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", pack),
]

# language identification and tokenization cannot be put in SQL; tests hold every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents in ``sf_dir``; what a stage read goes once its result is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = settle_as(stage(spark, docs, sf_dir), path)
        if last is not None:
            discard(spark, last)
        last = path
    return docs
