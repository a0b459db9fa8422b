"""Site-relative line de-duplication: lines found on too large a share of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from camtrail.scale import broadcast_if_small, cut_lineage

RATIO = 0.01
MIN_PAGES = 5


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _key(line: Column, host: str) -> Column:
    """64 bits for a line of a site; a rare line is dropped by mistake only if it meets one of its site's few boilerplate keys."""
    return F.xxhash64(F.col(host), line)


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True, page: str | None = None
) -> DataFrame:
    """(host, line_key, pages, host_pages) of the lines on more than ``ratio`` of the pages of a host and on ``min_pages`` pages at least.

    A row is a page and counts a line once; without ``copies``, the rows of a host that have one text are one page, and with a column ``page``, those that have one value in it. Counts are combined before the shuffle, so a host or
    a line with a third of all rows costs one row per task. Rows of one page are combined so, and a line's pages are counted in two steps, the first over all tasks.
    """
    copies = copies and page is None
    name = F.xxhash64(F.col(text)) if page is None else F.col(page)
    rows = docs.select(F.col(host).alias("host"), F.col(text).alias("text"), *([] if copies else [name.alias("name")]))
    keys = F.array_distinct(F.transform(F.filter(_lines("text"), lambda x: x != ""), lambda x: _key(x, "host")))
    pages = rows.select("host", F.explode(keys).alias("line_key"), *([] if copies else ["name"]))
    pages = (pages if copies else pages.distinct()).groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("pages"))
    totals = (rows if copies else rows.select("host", "name").distinct()).groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).withColumnRenamed("host", "total_host")
    frequent = pages.filter(F.col("pages") >= min_pages)
    return frequent.join(broadcast_if_small(totals), F.col("host").eqNullSafe(F.col("total_host"))).filter(
        F.col("pages") > ratio * F.col("host_pages")
    ).drop("total_host")


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True, page: str | None = None
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and three more columns: n_lines, n_removed and, where lines went, n_chars if ``docs`` has it.

    Lines are split at newlines and compared exactly; empty lines stay. A null host is a host of its own. A null text stays null
    with no lines, an empty text has one empty line. Repeated rows are pages of their own, unless ``copies`` is false or ``page`` names a column that tells pages apart. No row is dropped: a page of boilerplate
    alone ends with an empty text. A host has at most (mean lines per page / ratio) such lines, so the table of them is small
    beside the pages; it is broadcast only after it was counted, and otherwise joined by host with Spark's skew splitting.
    """
    found = cut_lineage(boilerplate(docs, host, text, ratio, min_pages, copies, page).select("host", "line_key"))
    sites = found.groupBy("host").agg(F.collect_list("line_key").alias("_bp_keys")).withColumnRenamed("host", "_bp_host")
    sites = F.broadcast(sites) if found.count() <= 200_000 else sites
    rows = docs.join(sites, F.col(host).eqNullSafe(F.col("_bp_host")), "left").drop("_bp_host")
    lines = _lines(text)
    kept = F.filter(lines, lambda x: (x == "") | ~F.array_contains(F.col("_bp_keys"), _key(x, host)))
    rows = rows.withColumn("_bp_kept", F.when(F.col("_bp_keys").isNull(), lines).otherwise(kept))
    n = F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long")
    left = F.coalesce(F.when(F.col(text).isNotNull(), F.size("_bp_kept")), F.lit(0)).cast("long")
    out = rows.withColumns({"n_lines": n, "n_removed": n - left, "_bp_text": F.array_join("_bp_kept", "\n")})
    out = out.withColumn(text, F.when(F.col("n_removed") > 0, F.col("_bp_text")).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("_bp_keys", "_bp_kept", "_bp_text")


def oracle(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    return f"""
    WITH pages AS (SELECT source, l, count(*) n FROM (SELECT DISTINCT source, doc_id, unnest(string_split(text, chr(10))) l FROM documents)
                   WHERE l <> '' GROUP BY ALL),
    totals AS (SELECT source, count(*) total FROM documents GROUP BY ALL),
    bad AS (SELECT p.source, p.l FROM pages p JOIN totals t ON p.source IS NOT DISTINCT FROM t.source
            WHERE n >= {min_pages} AND n > {ratio} * total),
    lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i FROM documents),
    marked AS (SELECT a.doc_id, a.l, a.i, b.l IS NOT NULL gone FROM lines a LEFT JOIN bad b ON a.source IS NOT DISTINCT FROM b.source AND a.l = b.l),
    sums AS (SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_removed,
                    coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') kept FROM marked GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT n_lines, coalesce(n_removed, 0)::BIGINT n_removed, md5(kept) kept_md5
    FROM documents d LEFT JOIN sums USING (doc_id)"""
