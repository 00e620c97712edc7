"""The registered queries of the training-data operators: thin bindings to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workboard.llm import (conversation_repair, embedding_dedup, exact_topk, license_scan, minhash_dedup, mixing, packing,
                           pii, prefix_trie, quality, rotated_codes, substring_dedup, url_filter)
from workboard.llm.oracles import ORACLES as ORACLES
from workboard.llm.store import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents (operator 1)."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of the permitted lengths (operator 2)."""
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts of all vectors (operator 3)."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: Wanted share of tokens of each domain.
TARGETS = {"clean": 0.95, "low": 0.03, "toxic": 0.02}


def domain() -> Column:
    """The domain of a labelled document, over the columns of labels."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain and rate of every document (operator 4)."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), domain(), TARGETS)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated passages cover (operator 5)."""
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of base spans, and all spans, of every document (operator 6)."""
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url (operator 7).

    A page is labelled through the document whose id is the number in its path: bad is low quality or toxic.
    """
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("__doc")).agg(
        F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("__bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    doc = F.regexp_extract(url_filter.host_and_path(F.col("url"))[1], "/([0-9]{1,18})(?:[./]|$)", 1).try_cast("long")
    labelled = pages.withColumn("__key", doc).join(labels, F.col("__key") == F.col("__doc"), "left")
    return url_filter.judge(labelled, F.col("__bad") == 1, URL_RULES)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document (operator 8)."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document, own or inherited (operator 9).

    Documents are the files of a tree by source, language and block of 1024 neighbouring ids. Three of four that mention
    a licence, by id, are a licence file: of their source, of source and language, or of their block.
    """
    source, lang = F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))
    name, block = F.col("doc_id").cast("string"), F.floor(F.col("doc_id") / 1024).cast("string")
    # every fourth stays a plain file; documents without a licence word too
    depth = F.when(F.col("text").rlike(license_scan.KEYWORD), F.pmod(F.col("doc_id"), F.lit(4)))
    path = (F.when(depth == 0, F.concat(F.lit("/"), source, F.lit("/LICENSE-"), name))
            .when(depth == 1, F.concat(F.lit("/"), source, F.lit("/"), lang, F.lit("/LICENSE-"), name))
            .otherwise(F.concat(F.lit("/"), source, F.lit("/"), lang, F.lit("/"), block, F.lit("/"), F.when(
                depth == 2, F.concat(F.lit("LICENSE-"), name)).otherwise(F.concat(name, F.lit(".txt"))))))
    return license_scan.scan(table(spark, sf_dir, "documents"), path, F.col("text"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best matches of every vector whose id is divisible by 50, among all others (operator 10)."""
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op11_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vector whose id is divisible by 100 (operator 11)."""
    return rotated_codes.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every conversation after damage (operator 12)."""
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")), F.col("gone"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and sums of the trie of all rebuilt conversations (operator 13)."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_near_dedup, op2_best_fit_packing, op3_embedding_near_dedup, op4_mixing,
                            op5_substring_dedup, op6_pii, op7_url_filter, op8_quality, op9_license_scan,
                            op10_exact_topk, op11_rotated_codes, op12_conversation_repair, op13_prefix_trie)
}
