"""Boilerplate lines of a site: how many of the site's pages have the line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foretally.llm.store import stored

#: Lines on more than this share of a site's pages, and on at least so many pages, are boilerplate.
RATIO = 0.1
PAGES = 4

_HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
_BREAKS = (r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|hr|nav|article|section|footer|header|table|tr|td|th|title|body|html|head|"
           r"blockquote|pre|form|main|aside)\b[^>]*>")
_TAGS = r"<[^>]*>"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)"


def page_text(html: Column) -> Column:
    """Text of a page, one line for each block; scripts, styles, comments and tags are left out."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    return F.regexp_replace(F.regexp_replace(plain, _BREAKS, "\n"), _TAGS, "")


def page_host(url: Column) -> Column:
    """Lowered host of an address, null where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 2)
    return F.when(host != "", F.lower(host))


def _line(x: Column) -> Column:
    return F.trim(x)


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, least: int = PAGES,
                     spare: bool = False) -> DataFrame:
    """``pages`` without lines that more than ``ratio`` of the host's pages have.

    Adds n_lines and n_removed (lines with something in them) in place of columns of those names and
    replaces ``text``; other columns stay. Lines are compared without outer blanks; a page counts once
    however often it has a line. Lines on fewer than ``least`` pages stay, so small sites lose nothing by
    their smallness. Blank lines stay and count nowhere. A null text becomes empty. Pages without host
    stay as they are. With ``spare``, a page that would lose every line stays whole: it is a copy of
    other pages, not a page around boilerplate. Repeated rows count as pages. An empty table gives an
    empty result.
    """
    # The caller's columns stand in one struct, so none of their names meets one of ours.
    base = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(f"`{host}`").alias("site"),
                        F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n").alias("lines"))
    said = F.array_distinct(F.transform(F.filter("lines", lambda x: _line(x) != ""), lambda x: F.xxhash64(_line(x))))
    known = base.filter("site is not null").select("site", said.alias("said"))
    total = known.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    often = (known.select("site", F.explode("said").alias("code")).groupBy("site", "code")
             .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
    # A host has at most (lines of a page on average / ratio) such lines, so its list is bounded.
    listed = stored(often.join(total, "site").filter(F.col("n") > F.col("pages") * ratio)
                    .groupBy("site").agg(F.collect_set("code").alias("codes")))
    marked = base.join(listed, "site", "left")
    stays = F.filter("lines", lambda x: (_line(x) == "") | ~F.array_contains("codes", F.xxhash64(_line(x))))
    full = F.size(F.filter("lines", lambda x: _line(x) != ""))
    marked = marked.withColumn("left", F.when(F.col("codes").isNull(), F.col("lines")).otherwise(stays))
    left = F.size(F.filter("left", lambda x: _line(x) != ""))
    if spare:
        marked = marked.withColumn("left", F.when(left == 0, F.col("lines")).otherwise(F.col("left")))
    kept = [c for c in pages.columns if c not in ("n_lines", "n_removed")]
    return marked.select(*(F.array_join("left", "\n").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept),
                         full.cast("long").alias("n_lines"), (full - left).cast("long").alias("n_removed"))


def pages_sql(ratio: float = RATIO, least: int = PAGES) -> str:
    """DuckDB's side of the query over ``pages``."""
    return rf"""
WITH plain AS (
  SELECT page_id, nullif(lower(regexp_extract(coalesce(url, ''), '{_HOST}', 2)), '') AS host,
         string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{_HIDDEN}', '', 'g'),
                      '{_BREAKS}', chr(10), 'g'), '{_TAGS}', '', 'g'), chr(10)) AS lines FROM pages),
said AS (SELECT page_id, host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ')), lambda x: x <> '')))
         AS line FROM plain WHERE host IS NOT NULL),
total AS (SELECT host, count(*) AS pages FROM plain GROUP BY host),
boiler AS (SELECT host, list(line) AS codes FROM (
    SELECT host, line, count(*) AS n FROM said GROUP BY ALL) JOIN total USING (host)
  WHERE n >= {least} AND n > pages * {ratio} GROUP BY host),
kept AS (SELECT page_id, host, lines, list_filter(lines, lambda x: trim(x, ' ') = '' OR codes IS NULL
         OR NOT list_contains(codes, trim(x, ' '))) AS stays FROM plain LEFT JOIN boiler USING (host))
SELECT page_id, host, len(list_filter(lines, lambda x: trim(x, ' ') <> '')) AS n_lines,
       len(list_filter(lines, lambda x: trim(x, ' ') <> '')) - len(list_filter(stays, lambda x: trim(x, ' ') <> '')) AS n_removed,
       sha256(array_to_string(stays, chr(10))) AS kept_sha256 FROM kept"""
