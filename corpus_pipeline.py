"""A corpus pipeline: language ID, near-dedup, surrogates for personal data, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result and reads it again as the next
stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bpe, langid, minhash, mixing, pii
from sessionloom.llm.common import columns, stage, unused

LEAST_LANGUAGE_SCORE = 0.5
SURROGATE_KEY = "spark.sessionloom.surrogate.key"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a recognised language (rejected: no text, no letter, or no language at even odds).

    Of ties the first language counts; repeated rows share their fate; texts may be of any length; an empty table stays empty; without any
    language to learn from all documents go; other columns stay as they are, whatever their names.
    """
    names = unused(docs.columns, "lang_pred", "score")
    said = langid.predict(docs, langid.learn(docs), keep=tuple(docs.columns), names=names)
    return said.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_LANGUAGE_SCORE)).select(*columns(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (five-word shingles, 0.8).

    Null and empty texts and rows with a null doc_id link with nothing and stay; rows that repeat a kept doc_id stay; texts may be of any
    length; an empty table stays empty; other columns stay as they are, whatever their names.
    """
    dropped = minhash.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*columns(docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates, checks them for collisions and counts the characters anew.

    A null text stays null, an empty one empty; repeated rows stay equal; texts may be of any length; an empty table stays empty; other
    columns stay as they are, whatever their names. The key is SURROGATE_KEY of the session's settings, or a test key.
    """
    names = unused(docs.columns, "n_entities", "kinds", "entities")
    out = pii.checked(pii.replace(docs, spark.conf.get(SURROGATE_KEY, None) or "sessionloom tests", keep=tuple(docs.columns), names=names), names[2])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns(docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards the target weights of sources, languages and topics.

    Nulls in source or lang are a value of their own; documents without words stay; repeated rows share their fate; texts may be of any
    length; an empty table stays empty; other columns stay as they are, whatever their names.
    """
    return mixing.mix(docs, names=unused(docs.columns, "_topic", "_tokens", "_weight", "_p")).select(*columns(docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids: doc_id, lang, source, token counts, digests and ids.

    A null text is empty and has no ids; repeated rows have equal ones; texts may be of any length; an empty table gives none; other
    columns are left out.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("PII surrogates", personal_data),
    ("mixing to target weights", mixture),
    ("byte-level BPE", encoding),
]

#: The stages learn, sketch and encode; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
