"""Boilerplate lines of pages, by their frequency within a site.

Lines that stand on more than ``RATIO`` of a host's pages, and on ``LEAST_PAGES``
at least, are dropped from all pages of the host.  Only SQL functions are used.

Counting groups hosts and 64-bit hashes of lines, with lengths beside them, so
texts of lines are not shuffled, and is combined in the map tasks first; a host
with a third of all pages or a line on every page is a count from each task.  The
lines to drop come back as one list for each host.  That list is bounded: each of
its lines stands on a share of ``RATIO`` of the pages, so it has at most the mean
number of lines of a page divided by ``RATIO`` entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.base import table, written
from newsloom.llm.url_filter import host_of

RATIO = 0.3
LEAST_PAGES = 3

HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TAG = r"<[^>]*>"
EDGES = r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$"


def lines_of(html: Column) -> Column:
    """Texts between the tags of a page, trimmed, without empty ones."""
    shown = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n"), TAG, "\n")
    return F.filter(F.transform(F.split(shown, "\n"), lambda x: F.regexp_replace(x, EDGES, "")), lambda x: x != "")


def without_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` of every row of ``pages (page_id, url, html)``.

    ``text`` joins the lines that stay with line feeds.  Null pages and pages
    without text have no lines.  Pages without a host are one site of their own,
    with an empty name.  Rows that repeat an id are pages each.  Columns other
    than the three are not looked at; an empty table gives an empty result.
    """
    marks = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.octet_length(x).alias("n")))
    lines = written(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
                    .withColumn("marks", marks), "page-lines")
    hosts = lines.groupBy("host").agg(F.count("*").alias("pages"))
    found = (lines.select("host", F.explode(F.array_distinct("marks")).alias("mark")).groupBy("host", "mark")
             .agg(F.count("*").alias("n")).filter(F.col("n") >= least_pages))
    common = written(found.join(hosts, "host").filter(F.col("n") > ratio * F.col("pages"))
                     .groupBy("host").agg(F.collect_list("mark").alias("common")), "page-common")
    named = lines.join(common, "host", "left").withColumn("common", F.coalesce("common", F.array()))
    # zip rather than hash again
    kept = F.filter(F.arrays_zip("lines", "marks"), lambda x: ~F.array_contains(F.col("common"), x["marks"]))
    return named.withColumn("kept", F.transform(kept, lambda x: x["lines"])).select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_boilerplate(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP5_SQL = rf"""
WITH shown AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', chr(10), 'g'), '{TAG}',
      chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '{EDGES}', '', 'g')), lambda x: x <> '') AS lines
  FROM pages
), hosts AS (SELECT host, count(*) AS pages FROM shown GROUP BY host),
found AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM shown) GROUP BY host, line
), common AS (
  SELECT host, list(line) AS common FROM found JOIN hosts USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages GROUP BY host
), kept AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept
  FROM shown LEFT JOIN common USING (host)
)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, array_to_string(kept, chr(10)) AS text
FROM kept
"""
