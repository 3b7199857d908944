"""Queries over the blocks of the raw web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.plans.skills import query
from gapweave.sources import html
from gapweave.sources.scratch import materialise
from gapweave.sources.views import Domain

#: Pages without comments, scripts and styles, cut before every tag that begins or ends a block.
PIECES = r""", clean AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g') AS h FROM pages WHERE html IS NOT NULL),
pieces AS (SELECT page_id, k, regexp_extract(p, '^<(/?[a-z0-9]*)', 1) AS tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(p, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\s+', ' ', 'g')) AS t
  FROM (SELECT page_id, unnest(ps) AS p, unnest(range(len(ps))) AS k FROM (SELECT page_id, string_split(regexp_replace(h, '(</?(?:p|li|ul|h1|div|nav|article|footer|body|html|head|title)\b)', chr(1) || '\1', 'g'), chr(1)) AS ps FROM clean)))"""


def blocks(d: Domain) -> DataFrame:
    return materialise(html.scanned(d["pages"], "page_id", "html"), "page-blocks")


@query(PIECES + " SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS place, tag AS kind, md5(t) AS text FROM pieces WHERE t <> '' AND tag IN ('p', 'li', 'h1', 'title', 'div', 'footer')")
def page_blocks(d: Domain) -> DataFrame:
    """Every block of text of the pages in order, with the element that it is in."""
    rows = blocks(d).select("page_id", F.posexplode(F.filter("blocks", lambda b: ~b.kind.isin("a", "meta"))).alias("k", "b"))
    return rows.select("page_id", (F.col("k") + 1).alias("place"), F.col("b.kind").alias("kind"), F.md5("b.text").alias("text"))


@query(PIECES + " SELECT p.page_id, coalesce(any_value(t) FILTER (tag = 'h1'), '') AS title, count(*) FILTER (tag = 'p' AND t <> '') AS paragraphs, count(*) FILTER (tag = 'li' AND t <> '') AS items, coalesce(md5(string_agg(t, chr(10) ORDER BY k) FILTER (tag = 'p' AND t <> '')), md5('')) AS body FROM pages p LEFT JOIN pieces USING (page_id) GROUP BY p.page_id")
def page_outline(d: Domain) -> DataFrame:
    """Each page's main heading, numbers of paragraphs and items, and the digest of its paragraphs."""
    paragraphs, items = html.texts(F.col("blocks"), "p"), html.texts(F.col("blocks"), "li")
    return blocks(d).select("page_id", html.outline(F.col("blocks"))["title"].alias("title"), F.size(paragraphs).cast("long").alias("paragraphs"), F.size(items).cast("long").alias("items"), F.md5(F.concat_ws("\n", paragraphs)).alias("body"))


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS href, md5(unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1))) AS text FROM pages")
def page_links(d: Domain) -> DataFrame:
    """Address and text of every link."""
    return blocks(d).select("page_id", F.explode(F.filter("blocks", lambda b: b.kind == "a")).alias("b")).select("page_id", F.col("b.name").alias("href"), F.md5("b.text").alias("text"))
