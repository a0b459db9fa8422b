"""Writing results: ranked JSON documents and labelled crop CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def documents(results: DataFrame, questions: DataFrame, status: str = "success") -> DataFrame:
    """One JSON document per question with its ranked results; a question without results has an empty list."""
    fields = [c for c in results.columns if c != "query_id"]
    ranked = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *[c for c in fields if c != "rank"]))).alias("results")
    )
    kind = ranked.schema["results"].dataType
    body = questions.join(ranked, "query_id", "left").select(
        "query_id",
        F.to_json(F.struct(F.lit(status).alias("status"), F.col("text").alias("query"),
                           F.coalesce("results", F.array().cast(kind)).alias("results"))).alias("document"),
    )
    return body


def write_documents(docs: DataFrame, path: str) -> None:
    docs.select("document").write.mode("overwrite").text(path)


def write_crops(crops: DataFrame, path: str) -> None:
    """Labelled crop list with a header per file."""
    crops.write.mode("overwrite").option("header", "true").csv(path)
