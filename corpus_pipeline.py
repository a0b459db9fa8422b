"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents.

All stages but the last return the columns of documents. Each works on every row its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from camtrail import ship
from camtrail.llm import langid, lines, minhash, mixing, packing
from camtrail.scale import broadcast_if_small, shared_folder

# A document is rejected if it has nothing to read, or if its best language leads the mean of the others by less than this. A text in two languages leads it.
LEAST_MARGIN = 0.05
# Rows of text that cross to Python at once; the default of 10,000 costs some hundred MB per worker.
BATCH_ROWS = "2000"
# Pieces of text a worker keeps encoded, about 200 bytes each; it changes the speed only.
CACHED = 150_000


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _with_nodes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_node``: the doc_id; where rows with one doc_id differ in text, a number of id and text above all ids; without an id, one of the text below all ids."""
    ids = F.xxhash64("doc_id", "text") % (1 << 61)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    repeated = repeated.filter("not (a <=> b)").select(F.col("doc_id").alias("_repeated"))
    if repeated.isEmpty():
        several = F.lit(False)
    else:
        docs = docs.join(broadcast_if_small(repeated), F.col("doc_id") == F.col("_repeated"), "left")
        several = F.col("_repeated").isNotNull()
    node = F.when(several, F.abs(ids) + (3 << 61)).otherwise(F.coalesce("doc_id", -F.abs(F.xxhash64("text") % (1 << 62)) - (1 << 62)))
    return docs.withColumn("_node", node)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those in which no language stands out. Where no language could be learned, or only one, every document with a letter stays."""
    _prepare(spark)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return langid.identify(docs).filter(lettered & F.coalesce(F.col("margin") >= LEAST_MARGIN, F.lit(True))).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the boilerplate lines of each source out of the texts; n_chars follows. No document is dropped.

    A near-duplicate component (5 words, 80 %) is one page of its source, so a group of copies or near copies does not make its own lines boilerplate and near_dedup finds it whole.
    """
    _prepare(spark)
    named = _with_nodes(docs)
    found = minhash.near_duplicates(named, doc_id="_node").filter("component_id <> doc_id")
    members = found.select(F.col("doc_id").alias("_node"), F.col("component_id").alias("_component")).distinct()
    paged = named.join(broadcast_if_small(members), "_node", "left").withColumn("_page", F.coalesce("_component", "_node"))
    return lines.drop_boilerplate(paged, page="_page").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component (5 words, 80 %), the one with the smallest doc_id.

    Rows without a doc_id are known by their text's hash below all ids, so a copy that has an id gives way to them. Rows that repeat an id with different texts are documents of their
    own, and give way to ids that one text has. Rows that repeat both id and text leave one.
    """
    _prepare(spark)
    body = F.col("text").cast("binary")
    named = _with_nodes(docs)
    found = minhash.near_duplicates(named, doc_id="_node")
    gone = found.filter("not kept").select(F.col("doc_id").alias("_node")).distinct()
    kept = named.join(broadcast_if_small(gone), "_node", "left_anti")
    if not named.groupBy("_node").count().filter("count > 1").isEmpty():
        first = F.row_number().over(W.partitionBy("_node", F.md5(body)).orderBy("source", "lang", "n_chars"))
        kept = kept.withColumn("_first", first).filter("_first = 1")
    return kept.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its draw say."""
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    _prepare(spark)
    return packing.pack_documents(docs, cached=CACHED)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

# Language identification and tokenization have no SQL form; tests/llm/test_pipeline_llm.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of ``sf_dir``; results between stages go to the folder that all executors share."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
