"""Corpus pipeline: language ID, near copies, personal data, source mix, token ids.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last return the columns of documents.  Columns beyond
these are kept as they are, whatever their names, and an empty table gives an empty result at every stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe, language_id, mixing, ngram_join, pii
from riskloom.llm.store import Scratch, ship

LEAST_SCORE = 0.4              # mean probability of the language below which a document is rejected
BLOCK_WORDS = 1024
KEY = b"pseudonyms of the corpus pipeline"

#: No stage but the second could be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets ``lang`` to the predicted language.  Documents without a letter, or without a language of mean probability
    ``LEAST_SCORE`` or more, are rejected: null, empty and blank texts go.  Repeated rows get equal decisions."""
    ship(spark)
    found = language_id.identify(docs, language_id.train(docs), keep=True)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest doc_id, of those linked by 80 % shared 5-word shingles."""
    ship(spark)
    return ngram_join.first_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms; ``n_chars`` follows.  A null text stays null, with ``n_chars`` null, an empty
    one empty; repeated rows get equal texts; no row goes."""
    ship(spark)
    out = pii.pseudonymize(docs, KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document's piece of a block in the mix; ``text`` is the piece, ``n_chars`` its length.  Null,
    empty and blank texts have no words and no rows; repeated rows are documents of their own; a null source is one."""
    ship(spark)
    return mixing.mixed_documents(docs, BLOCK_WORDS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row; a null or empty text has no ids."""
    import public_tokenizers

    ship(spark)
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", replace_personal_data),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
