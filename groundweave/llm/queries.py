"""The queries opN_<name> over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


#: Arrivals that op4_compaction's rows come in.
ARRIVALS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import digest, pack_documents

    return digest(pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_idstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._common import shared_dir
    from .idstore import read_digests, verify_manifest, write_store

    path = shared_dir(spark, "idstore")
    root = write_store(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    verify_manifest(spark, path, root)
    return read_digests(spark, path)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` as the compacted table's last manifest holds it, its text as a digest.

    The rows come in ``ARRIVALS`` arrivals. ``merged`` tells whether a merge made the row's shard;
    ``tiers_due``, of the last manifest, how many tiers hold shards enough for another one.
    """
    from pyspark.sql import functions as F

    from ._common import shared_dir
    from .compaction import ShardTable

    table = ShardTable(spark, shared_dir(spark, "shards"))
    docs = _table(spark, sf_dir, "documents")
    table.append_arrivals(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    for _ in table.merges():
        table.vacuum(keep=1, least_age=0)  # nobody else uses this table
    due = len(table.plan(table.manifest()["shards"]))
    return table.read_merges().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), (F.col("merges") > 0).alias("merged"), F.lit(due).cast("long").alias("tiers_due"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import build_index, search

    rows = _table(spark, sf_dir, "embeddings")
    return search(build_index(rows), rows.where("vec_id % 50 = 0"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict_lang, train_langid

    docs = _table(spark, sf_dir, "documents")
    return predict_lang(docs, train_langid(docs))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality, train_quality

    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, _table(spark, sf_dir, "labels")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digest, scan_secrets

    return digest(scan_secrets(_table(spark, sf_dir, "documents")))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("tiles")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_compaction": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, true AS merged, CAST(0 AS BIGINT) AS tiers_due FROM documents"}
