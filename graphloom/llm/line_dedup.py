"""Line dedup by site-relative frequency.

Rows are grouped by host; a line's ratio is the number of the host's pages that contain it,
divided by the host's page total. Lines whose ratio exceeds `ratio`, and that stand on at
least `min_pages` pages of the host, are boilerplate and leave every page of that host.

Lines are what "\\n" separates; two lines are equal if they are so without leading and
trailing spaces, tabs and carriage returns. Blank lines are layout: never counted or dropped.

Plan: each page gives its distinct lines as 64-bit XXH64 keys; (host, key) is counted with
map-side partial sums, so neither a host nor a line that holds a third of all rows puts more
than one row per map task on a reducer. Keys are only compared within a host. The text is
never shuffled while the boilerplate keys, whose number is counted first, fit `max_broadcast`
(they are at most lines-per-page / ratio for a host); beyond that the keys of the pages' own
lines are joined with them instead, which returns the same rows.

Defined results: null text stays null with 0 lines; an empty text has one blank line; null
host: no site, so nothing is dropped; repeated rows count as so many pages; a host with fewer
than `min_pages` pages loses nothing; columns other than host and text pass through whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from graphloom.llm.common import cut, fresh, read

RATIO = 0.05
MIN_PAGES = 5
MAX_BROADCAST = 2_000_000
BLANK = " \t\r"


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Rows (host, line_key, pages, total): the lines to drop."""
    own = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = own.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lines = own.select("host", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _trim))).alias("line")).where("line <> ''")
    counted = lines.groupBy("host", F.xxhash64("line").alias("line_key")).agg(F.count(F.lit(1)).alias("pages"))
    return counted.where(F.col("pages") >= min_pages).join(totals, "host").where(F.col("pages") / F.col("total") > ratio)


def drop_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """All columns of pages with the text rewritten, plus _n_lines and _n_removed, which replace any of those names."""
    pages = pages.drop("_n_lines", "_n_removed")
    columns = pages.columns
    own_host, own_text, drop, kept, key = (fresh(columns, c) for c in ("_host", "_key", "_drop", "_kept", "_text_key"))
    found = cut(boilerplate(pages, host, text, ratio, min_pages).select("host", "line_key"), "boilerplate")
    lines = _lines(F.col(text))
    if found.count() <= max_broadcast:
        by_host = found.groupBy(F.col("host").alias(own_host)).agg(F.collect_list("line_key").alias(drop))
        joined = pages.join(F.broadcast(by_host), F.col(host) == F.col(own_host), "left")
    else:
        marked = pages.withColumn(key, F.xxhash64(text))
        own = marked.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(key).alias("text_key"), F.explode(F.array_distinct(F.transform(lines, _trim))).alias("line"))
        hit = own.where("line <> ''").select("host", "text_key", F.xxhash64("line").alias("line_key")).distinct().join(found, ["host", "line_key"])
        by_text = hit.groupBy(F.col("host").alias(own_host), F.col("text_key").alias(own_text)).agg(F.collect_set("line_key").alias(drop))
        joined = marked.join(by_text, (F.col(host) == F.col(own_host)) & (F.col(key) == F.col(own_text)), "left")
    keep = F.filter(lines, lambda x: (_trim(x) == "") | ~F.array_contains(F.col(drop), F.xxhash64(_trim(x))))
    out = joined.withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(keep))
    n = lambda c: F.when(F.col(text).isNull(), 0).otherwise(F.size(c)).cast("long")
    out = out.withColumn("_n_lines", n(lines)).withColumn("_n_removed", n(lines) - n(F.col(kept)))
    new = F.when(F.col("_n_removed") > 0, F.array_join(kept, "\n")).otherwise(F.col(text))
    return out.withColumn(text, new).select(*[F.col(f"`{c}`") for c in columns], "_n_lines", "_n_removed")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l
), t AS (SELECT source, count(*) AS total FROM documents GROUP BY source
), b AS (
  SELECT k.source, key FROM k JOIN t ON k.source = t.source WHERE key <> ''
  GROUP BY k.source, key, total HAVING count(DISTINCT doc_id) >= {MIN_PAGES} AND count(DISTINCT doc_id) / total > {RATIO}
), m AS (SELECT k.*, b.key IS NOT NULL AS gone FROM k LEFT JOIN b ON k.source = b.source AND k.key = b.key
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
