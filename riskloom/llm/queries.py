"""Registered queries of the operators and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merkle as _merkle
from . import ngram_join as _ngrams
from . import quality_rules as _rules
from . import topk as _topk
from .store import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op3_ngram_jaccard_join": _ngrams.SQL, "op5_topk_search": _topk.SQL, "op7_quality_rules": _rules.SQL,
                          "op13_merkle_manifest": _merkle.SQL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose distinct 5-word shingles overlap by 80 % or more of their union."""
    from .ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@register
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base rules and the line-first verdict of every whole text."""
    from .quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


@register
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text under the multilingual rank file, and the bytes decoded from them."""
    import public_tokenizers

    from .byte_bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the documents outside the held-out third."""
    from .language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text with its personal data replaced by format-preserving pseudonyms, and what was found where."""
    from .pii import pseudonymize

    out = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), b"pseudonyms of the registered query")
    return out.withColumn("n_found", F.size("pii"))


@register
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and taken words of every document in the mix of all sources."""
    from .mixing import taken

    return taken(table(spark, sf_dir, "documents"))


@register
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer products of every fiftieth vector with all others."""
    from .topk import top_products

    return top_products(table(spark, sf_dir, "embeddings"))


@register
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learned from the labels outside the held-out fifth."""
    from .quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, written to indexed shards and read back by key."""
    import public_tokenizers

    from .token_shards import written_digests

    return written_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All visible text of every page, laid out."""
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@register
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 8 leading components of the table, each of variance 1."""
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@register
def op12_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found for every twentieth vector among all others."""
    from .multiprobe import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


@register
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that a partly tampered copy leads to."""
    from .merkle import verified_manifest

    return verified_manifest(table(spark, sf_dir, "documents"))
