"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    byte_bpe,
    byte_gru,
    fm_toxicity,
    line_dedup,
    link_trust,
    merkle_manifest,
    pii_sanitise,
    rule_ledger,
    setsketch,
    spaced_seeds,
    spelling_groups,
    tree_extract,
    wavelet,
)
from tidemark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_wavelet_tokens")
def op1(spark, d):
    """Token ids of all documents, written as wavelet shards and read back."""
    return wavelet.wavelet_tokens(
        table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query("op2_rule_ledger")
def op2(spark, d):
    """Quality measurements, failure bits and the current policy's verdict."""
    return rule_ledger.judge(table(spark, d, "documents"))


@query("op3_spaced_seeds")
def op3(spark, d):
    """Verified overlaps of documents with benchmark items."""
    return spaced_seeds.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


@query("op4_link_trust")
def op4(spark, d):
    """Verdict on every page's url by rules and link-graph propagation."""
    return link_trust.filter_pages(table(spark, d, "pages"), URL_RULES)


@query("op5_setsketch")
def op5(spark, d):
    """Near-duplicate components of all documents."""
    return setsketch.near_duplicates(table(spark, d, "documents"))


@query("op6_byte_gru")
def op6(spark, d):
    """Language of all documents; the network learns from the labelled two thirds."""
    return byte_gru.identify(table(spark, d, "documents"))


@query("op7_fm_toxicity")
def op7(spark, d):
    """Toxicity scores of all documents."""
    return fm_toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op8_prefix_bpe")
def op8(spark, d):
    """Byte-level BPE ids of all documents and their decoding, as digests."""
    return byte_bpe.encode_documents(
        table(spark, d, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


@query("op9_tree_extract")
def op9(spark, d):
    """Main text of every page."""
    return tree_extract.extract(table(spark, d, "pages"))


@query("op10_pii_sanitise")
def op10(spark, d):
    """Personal data of all documents and the terms that reveal it."""
    return pii_sanitise.detect(table(spark, d, "documents"))


@query("op11_spelling_groups", spelling_groups.ORACLE)
def op11(spark, d):
    """Spelling variants of the frequent words of all documents."""
    return spelling_groups.spelling_groups(table(spark, d, "documents"))


@query("op12_merkle_manifest", merkle_manifest.ORACLE)
def op12(spark, d):
    """Merkle leaf, proof and verification of every document."""
    return merkle_manifest.manifest(table(spark, d, "documents"))


@query("op13_line_dedup", line_dedup.ORACLE)
def op13(spark, d):
    """Lines of every document before and after those that many documents share are dropped."""
    return line_dedup.line_report(table(spark, d, "documents"))
