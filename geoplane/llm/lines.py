"""Line dedup by the share of a site's pages that hold a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved, table

RATIO, MIN_PAGES = 0.1, 5
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)"
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)(\s[^>]*)?/?>"
TAG = r"<[^>]*>"


def _trimmed(line):
    return F.trim(F.regexp_replace(line, r"[\t\r\f\x0B]", " "))


def _mark(line):
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, marks) of pages (host, text): the lines in over ``ratio`` of a host's pages and in ``min_pages`` at least.

    A host has fewer than (lines of a page on average) / ratio of them, so marks stays short however many pages
    there are. Lines are counted once a page, as 16-byte marks, before and after the shuffle; empty lines don't count.
    """
    marks = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), _trimmed), lambda x: x != ""), _mark))
    counts = pages.select("host", F.explode(marks).alias("mark")).groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.filter(F.col("n") >= min_pages).join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("mark").alias("marks"))


def drop_boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] | None = None) -> DataFrame:
    """``pages`` with ``text`` less the lines that are boilerplate of their ``site``.

    A line is the text between line feeds, compared without white space around it; what stays is kept as it was.
    Empty lines stay. A null site is a site of its own; a null text has no lines and stays null. Repeated rows count
    as pages. On sites of fewer than ``min_pages`` pages all lines stay. ``counts`` names two columns to add: the
    lines of the text before, and those dropped. The list of boilerplate is written first, so that Spark broadcasts
    it only if it is within spark.sql.autoBroadcastJoinThreshold, and else sorts and splits hot sites.
    """
    host, marks, kept = (fresh(n, pages) for n in ("_host", "_marks", "_kept"))
    name = F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit(""))
    found = saved(boilerplate(pages.select(name.alias("host"), F.col(text).alias("text")), ratio, min_pages), "boilerplate")
    found = found.select(F.col("host").alias(host), F.col("marks").alias(marks))
    lines = _lines(F.col(text))
    some = F.filter(lines, lambda x: ~F.array_contains(F.col(marks), _mark(_trimmed(x))))
    keep = F.when(F.col(marks).isNull(), lines).otherwise(some)
    out = pages.withColumn(host, name).join(found, host, "left").withColumn(kept, keep)
    new = [F.when(F.col(text).isNotNull(), F.array_join(kept, "\n")).alias(c) if c == text else F.col(c) for c in pages.columns]
    if counts:
        n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
        new += [n.alias(counts[0]), F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).alias(counts[1])]
    return out.select(*new)


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, host, text) of raw pages: a line for each block of the page, in lower-case hosts ('' if url has none)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", HIDDEN, "\n"), BLOCK, "\n"), TAG, "")
    text = F.array_join(F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda x: x != ""), "\n")
    return pages.select("page_id", host.alias("host"), text.alias("text"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(page_lines(table(spark, sf_dir, "pages")), "host", "text", counts=("n_lines", "n_dropped"))
    return out.select("page_id", "host", F.col("n_lines").cast("bigint"), F.col("n_dropped").cast("bigint"), "text")


SQL = rf"""
with raw as (
  select row_number() over () as row, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) as host, html,
    string_split(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', chr(10), 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)) as parts
  from pages
), lines as (
  select row, host, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[\t\r\f\v]', ' ', 'g'), ' ')), lambda x: x <> '') as lines from raw
), each as (
  select row, host, unnest(lines) as line, generate_subscripts(lines, 1) as k from lines
), totals as (
  select host, count(*) as pages from raw group by host
), often as (
  select host, line from (select distinct row, host, line from each) join totals using (host)
  group by host, line, pages having count(*) >= {MIN_PAGES} and count(*) > {RATIO} * pages
), marked as (
  select e.row, e.line, e.k, o.line is not null as gone from each e left join often o on e.host = o.host and e.line = o.line
), done as (
  select row, count(*) as n, count(*) filter (gone) as dropped, string_agg(line, chr(10) order by k) filter (not gone) as text
  from marked group by row
)
select page_id, host,
  case when html is null then 0 else coalesce(n, 1) end as n_lines, case when html is null then 0 else coalesce(dropped, 0) end as n_dropped,
  case when html is not null then coalesce(text, '') end as text
from raw left join done using (row)
"""
