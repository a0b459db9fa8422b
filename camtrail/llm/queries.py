"""The registered queries of this subpackage: each applies one operator with production parameters to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from camtrail import ship
from camtrail.llm import align, ann, langid, lines, merkle, minhash, mixing, packing, quality, sharding, suffix, tokenfile, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str = "documents", sql: str | None = None):
    """Register ``fn(rows) -> DataFrame`` over the whole of ``table``."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark.read.parquet(f"{folder}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_adaptive_scan", table="embeddings")
def op1(rows: DataFrame) -> DataFrame:
    """The 20 nearest found of every query row."""
    return ann.nearest(rows)


@query("op2_signature_join")
def op2(docs: DataFrame) -> DataFrame:
    """Set size, component and survivor of every document; shingles of 4 words."""
    return minhash.near_duplicates(docs, words=4)


@query("op3_exact_top", table="embeddings", sql=topk.oracle())
def op3(rows: DataFrame) -> DataFrame:
    """The 20 highest integer products of every query row."""
    return topk.exact_top(rows)


@query("op4_line_dedup", sql=lines.oracle())
def op4(docs: DataFrame) -> DataFrame:
    """Lines, removed lines and digest of what is left, per document; the source is the site."""
    return lines.drop_boilerplate(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@query("op8_pattern_packing")
def op8(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack_documents(docs)


@query("op9_mix_sources", sql=mixing.oracle())
def op9(docs: DataFrame) -> DataFrame:
    """Size, the source's size and target, and the words the mix takes, per document."""
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op5_merged_transforms")
def op5(docs: DataFrame) -> DataFrame:
    """Bytes removed from every document and the digest of what stays."""
    return suffix.drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_string_kernel_language")
def op6(docs: DataFrame) -> DataFrame:
    """Language of every document and how sure it is."""
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@query("op7_shard_bytes")
def op7(docs: DataFrame) -> DataFrame:
    """Shards of near equal bytes; copies of a text stay together."""
    return sharding.shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op10_range_coded_files")
def op10(docs: DataFrame) -> DataFrame:
    """Place, size and checksum of every document's ids, from files written and read back."""
    return tokenfile.round_trip(docs)


@query("op13_incremental_witnesses", sql=merkle.oracle())
def op13(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a copy without newlines passes."""
    return merkle.newlines_dropped(docs)


def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, and whether the rules and the line labels keep it; the labels table says what the field learns from."""
    ship(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    field = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(docs.select("doc_id", "text"), field).select("row.doc_id", *columns)


QUERIES["op11_line_field_quality"] = op11


@query("op12_shared_cuts")
def op12(docs: DataFrame) -> DataFrame:
    """Tokens of both vocabularies, groups and links of every document."""
    return align.best_links(docs)
