"""Line removal by site-relative frequency.

Pages are grouped by host. A line's frequency on a host is the number of the host's pages that contain it, divided by
all pages of the host. Lines whose frequency exceeds a ratio are boilerplate of that host and are dropped from its pages;
all other lines stay in order. A line on a single page is not repeated and stays, however few pages its host has.

Lines are compared without blanks around them, by their MD5 digest; blank lines are never boilerplate. A null host is a
host of its own. Null texts stay null, empty texts empty; a page that consists of boilerplate becomes ''. Repeated rows
are pages of their own. An empty table gives no rows. All columns stay, in order, whatever their names.

Only (host, digest, pages) of distinct lines of a page is shuffled, and summed before. The boilerplate of a host has no
more entries than its mean number of lines divided by the ratio; Spark broadcasts the written table only below its own
limit and else joins by host, where it splits a hot host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.llm.common import fresh, materialise

#: Share of a host's pages above which a line is boilerplate, and the least number of pages of a repeated line.
RATIO, REPEATED = 0.1, 2


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key(line: Column) -> Column:
    return F.md5(F.trim(line))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO) -> DataFrame:
    """host and lines (digests) of every host that has boilerplate."""
    seen = pages.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(F.filter(lines(F.col(text)), lambda x: F.trim(x) != ""), key))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= REPEATED)
    totals = pages.groupBy(F.col(host).alias("of")).agg(F.count("*").alias("pages"))
    frequent = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") / F.col("pages") > ratio)
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, report: bool = False) -> DataFrame:
    """The pages without boilerplate; with report, n_lines and n_dropped follow the columns and replace those of that name."""
    of, bad = fresh(pages, "gw_host"), fresh(pages, "gw_lines")
    found = materialise(boilerplate(pages, host, text, ratio), "boilerplate").select(F.col("host").alias(of), F.col("lines").alias(bad))
    both = pages.join(found, F.col(host).eqNullSafe(F.col(of)), "left")
    kept = F.filter(lines(F.col(text)), lambda x: ~F.array_contains(F.col(bad), key(x)))
    clean = F.when(F.col(bad).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    columns = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns if not (report and c.lower() in ("n_lines", "n_dropped"))]
    if not report:
        return both.select(*columns)
    n = F.coalesce(F.size(lines(F.col(text))), F.lit(0))
    left = F.when(F.col(bad).isNull(), n).otherwise(F.coalesce(F.size(kept), F.lit(0)))
    return both.select(*columns, F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.when(F.col(text).isNull(), 0).otherwise(n - left).cast("long").alias("n_dropped"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
seen AS (SELECT source, unnest(list_distinct([md5(trim(x)) FOR x IN ls IF trim(x) <> ''])) AS k FROM d),
counts AS (SELECT source, k, count(*) AS n FROM seen GROUP BY ALL),
totals AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (SELECT c.source, list(c.k) AS ks FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
        WHERE n >= {REPEATED} AND n / pages > {RATIO} GROUP BY c.source),
kept AS (SELECT doc_id, text, ls, CASE WHEN ks IS NULL THEN ls ELSE [x FOR x IN ls IF NOT list_contains(ks, md5(trim(x)))] END AS left_over
         FROM d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(left_over, chr(10)), '') END AS text,
       coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(left_over), 0)::BIGINT AS n_dropped FROM kept
"""
