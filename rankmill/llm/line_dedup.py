"""Operator 8: line dedup by site-relative frequency.

For each site, the pages that contain a line are divided by all pages of the site, and lines above a ratio go from every
page of it. Pages of equal text are one page of the site, so that a page served often doesn't lose all it has. A site
can hold at most (mean lines of a page) / ratio such lines, so the lines to drop are few beside the pages.

DataFrame functions only. Lines are counted by 64-bit hashes, which are summed up before they are shuffled; texts don't
move unless the drop list is too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.shared import BROADCAST_ROWS, fresh, spread_join, written

#: Share of a site's pages above which a line is boilerplate; chosen from measured frequencies (README).
RATIO = 0.05
MIN_PAGES = 5
BLANK = " \t\x0b\x0c\r"


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANK)))


def boilerplate(docs: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, key, pages, total): the lines, by hash, on more than ratio of the site's pages and on min_pages at least."""
    page = docs.select(F.col(site).alias("site"), F.xxhash64("text").alias("page"), "text").where("text is not null")
    total = page.groupBy("site", "page").agg(F.lit(1).alias("one")).groupBy("site").agg(F.count("*").alias("total"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != ""), _line_key))
    line = page.select("site", "page", F.explode(keys).alias("key")).groupBy("site", "key", "page").agg(F.lit(1).alias("one"))
    line = line.groupBy("site", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    both = line.join(F.broadcast(total) if total.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else total, line["site"].eqNullSafe(total["site"]))
    return both.where(F.col("pages") > F.col("total") * ratio).select(line["site"], "key", "pages", "total")


def line_dedup(docs: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with text freed of boilerplate lines, and the columns n_lines and n_dropped (lines with a word).

    docs: text and the site column; all else is passed on. Where docs has a column n_lines or n_dropped itself, the new one
    is called n_lines_1 or n_dropped_1. Lines end at \\n and compare without white space around them; blank lines stay
    where they are. A null text stays null, with 0 lines; an empty one has 0 lines; texts are taken whole, however long.
    A line at the ratio itself stays. Rows whose site is null are one site. Repeated rows are one page when counted, and
    each has its result. An empty table, or one without boilerplate, comes back as it was.
    """
    origin, keys, lines, rest, n_lines, n_dropped = fresh(docs, "ld_site", "ld_keys", "ld_lines", "ld_kept", "n_lines", "n_dropped")
    drop = written(boilerplate(docs, site, ratio, min_pages), "boilerplate")
    rows = drop.limit(BROADCAST_ROWS + 1).count()
    # Sites are joined by a hash, which the null site has as well.
    at = lambda c: F.xxhash64(F.col(c).isNull(), F.col(c).cast("string"))
    drop = drop.groupBy(at("site").alias(origin)).agg(F.collect_list("key").alias(keys))
    d = docs.withColumn(origin, at(site))
    if rows <= BROADCAST_ROWS:
        d = d.join(F.broadcast(drop), origin, "left")
    else:
        size = fresh(d, "rows")[0]
        sizes = d.groupBy(origin).agg(F.count("*").alias(size))
        d = spread_join(d, written(drop.join(sizes, origin), "boilerplate"), [origin], size, "text", "left")
    d = d.withColumn(lines, F.split("text", "\n"))
    filled = lambda x: F.btrim(x, F.lit(BLANK)) != ""
    kept = F.when(F.col(keys).isNull(), F.col(lines)).otherwise(
        F.filter(lines, lambda x: ~(filled(x) & F.array_contains(keys, _line_key(x))))
    )
    d = d.withColumn(rest, kept)
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.filter(c, filled))).cast("long")
    d = d.withColumns({n_lines: count(lines), n_dropped: count(lines) - count(rest), "text": F.array_join(rest, "\n")})
    return d.select(*docs.columns, n_lines, n_dropped)


def cleaned_sql(table: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL for line_dedup(table) with its columns."""
    trim = f"trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
    return f"""
(WITH p AS (SELECT DISTINCT source, text FROM {table} WHERE text IS NOT NULL),
n AS (SELECT source, count(*) AS total FROM p GROUP BY source),
l AS (SELECT source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {trim}), lambda x: x <> ''))) AS line FROM p),
b AS (SELECT l.source, l.line FROM l JOIN n ON l.source IS NOT DISTINCT FROM n.source GROUP BY l.source, l.line, n.total
  HAVING count(*) >= {min_pages} AND count(*) > n.total * {ratio}::DOUBLE),
k AS (SELECT source, list(line) AS keys FROM b GROUP BY source),
s AS (SELECT d.*, string_split(d.text, chr(10)) AS ls, k.keys FROM {table} d LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source),
f AS (SELECT *, CASE WHEN keys IS NULL THEN ls ELSE list_filter(ls, lambda x: {trim} = '' OR NOT list_contains(keys, {trim})) END AS kept FROM s)
SELECT * EXCLUDE (text, ls, keys, kept), CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  coalesce(len(list_filter(ls, lambda x: {trim} <> '')), 0)::BIGINT AS n_lines,
  (coalesce(len(list_filter(ls, lambda x: {trim} <> '')), 0) - coalesce(len(list_filter(kept, lambda x: {trim} <> '')), 0))::BIGINT AS n_dropped FROM f)"""


def oracle() -> str:
    return f"SELECT doc_id, n_lines, n_dropped, md5(text) AS text_md5 FROM {cleaned_sql('documents')}"
