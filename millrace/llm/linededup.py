"""Line dedup by site-relative frequency.

A host's boilerplate lines are those that stand on more than ``RATIO`` of its pages, and on ``REPEATED`` pages or
more, as a line on a single page repeats nothing; that holds for hosts of every size.  Pages of a host with equal texts are one
page, in the count of a line's pages and in the host's total, so that copies of a page don't make its lines
boilerplate.  Lines are compared by 64-bit hashes, without white space (space, tab, carriage return) at their ends; a page
counts once for a line that it repeats.  Boilerplate lines are dropped wherever they stand on that host, all
other lines stay in order.  A page's host is the value of ``host_col``, or the host of its URL (``host_of``).

Each task reduces its pages to (host, text digest, line digests) and counts (host, line) with map-side partial sums,
so a host with a third of all pages is spread over all tasks.  What remains, at most ``lines of a page / RATIO``
digests per host, is written and joined back by host: broadcast if its written size is below the session's
threshold, else a join whose hot hosts adaptive execution splits.  The filter itself is an expression
over the page's own lines; no text is exploded or shuffled for it.

Defined results: blank lines are never boilerplate; pages of a null host form one host; a null text is no page, stays
null and has 0 lines, and an empty one has one blank line; repeated rows are one page and are all cleaned; an empty
table gives no rows; other columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import written

RATIO = 0.1
#: The least number of pages on which a line is repeated at all.
REPEATED = 2
#: Fixed value: what is taken off a line's ends.
BLANKS = " \t\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _digest(line: Column) -> Column:
    return F.xxhash64(_trimmed(line))


def host_of(url: Column | str) -> Column:
    """A URL's host in lower case, without its port; null for what is no URL."""
    return F.lower(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _host(pages: DataFrame, host_col: str, url_col: str | None) -> Column:
    return host_of(pages[url_col]) if url_col else pages[host_col]


def boilerplate(pages: DataFrame, *, ratio: float = RATIO, least: int = REPEATED, host_col: str = "source", text_col: str = "text", url_col: str | None = None) -> DataFrame:
    """host, lines: each host's digests of boilerplate lines, in one array."""
    text = pages[text_col].cast("string")
    lines = F.array_distinct(F.transform(F.filter(_lines(text), lambda x: _trimmed(x) != ""), _digest))
    digest = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(8), text).alias("b"))
    once = pages.where(text.isNotNull()).select(_host(pages, host_col, url_col).alias("host"), digest.alias("digest"), lines.alias("lines")).groupBy("host", "digest").agg(F.first("lines").alias("lines"))
    # the host's total is the count of a line that every page has
    counts = once.select("host", F.explode(F.concat("lines", F.array(F.lit(None).cast("long")))).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.where(F.col("line").isNull()).select(F.col("host").alias("of"), F.col("n").alias("pages"))
    often = counts.where(F.col("line").isNotNull() & (F.col("n") >= least)).join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_set("line").alias("lines"))


def _free(name: str, pages: DataFrame) -> str:
    """The name, or one like it that the pages don't have."""
    have = {c.lower() for c in pages.columns}
    while name in have:
        name += "_"
    return name


def _filtered(pages: DataFrame, options: dict) -> tuple[DataFrame, Column, Column, Column]:
    """The pages, and on them their cleaned text, number of lines and of dropped ones."""
    text_col, bad = options.get("text_col", "text"), _free("bad_lines", pages)
    known = written(boilerplate(pages, **options), "boilerplate")
    joined = pages.join(known, _host(pages, options.get("host_col", "source"), options.get("url_col")).eqNullSafe(known["host"]), "left")
    # the page's own part of its host's lines, by hashing: it is short, however long both are
    own = F.array_intersect(F.transform(_lines(pages[text_col].cast("string")), _digest), known["lines"])
    rows = joined.select(*(pages[c] for c in pages.columns), F.when(F.size(own) > 0, own).alias(bad))
    split = _lines(rows[text_col].cast("string"))
    kept = F.when(rows[bad].isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains(rows[bad], _digest(x))))
    n = F.when(rows[text_col].isNull(), 0).otherwise(F.size(split)).cast("long")
    return rows, F.array_join(kept, "\n"), n, F.when(rows[text_col].isNull(), 0).otherwise(n - F.size(kept)).cast("long")


def report(pages: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, text."""
    rows, text, n, dropped = _filtered(pages, options)
    return rows.select(id_col, n.alias("n_lines"), dropped.alias("n_dropped"), text.alias("text"))


def cleaned(pages: DataFrame, *, length_col: str | None = None, **options) -> DataFrame:
    """The pages, with their own columns only.  length_col: a column that follows the text's length where lines were dropped."""
    rows, text, _, dropped = _filtered(pages, options)
    own = {options.get("text_col", "text"): text}
    if length_col:
        own[length_col] = F.when(dropped > 0, F.char_length(text).cast(pages.schema[length_col].dataType)).otherwise(rows[length_col])
    return rows.select(*(own.get(c, rows[c]).alias(c) for c in pages.columns))


def sql(source: str = "documents", *, ratio: float = RATIO, least: int = REPEATED) -> str:
    """DuckDB SQL of ``report`` over ``source``."""
    return f"""
WITH pages AS (SELECT doc_id, source, text, row_number() OVER () AS row FROM {source}),
lines AS (SELECT row, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM pages),
often AS (
  SELECT c.source, c.line FROM (
    SELECT source, trim(line, ' ' || chr(9) || chr(13)) AS line, count(DISTINCT text) AS n FROM lines
    WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1, 2) c
  JOIN (SELECT source, count(DISTINCT text) AS pages FROM pages GROUP BY 1) t ON c.source IS NOT DISTINCT FROM t.source
  WHERE n >= {least} AND n > {ratio} * pages),
kept AS (
  SELECT row, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM lines l
  WHERE NOT EXISTS (SELECT 1 FROM often o WHERE o.source IS NOT DISTINCT FROM l.source AND o.line = trim(l.line, ' ' || chr(9) || chr(13))) GROUP BY row)
SELECT p.doc_id, CAST(coalesce(len(string_split(p.text, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(string_split(p.text, chr(10))), 0) - coalesce(k.n, 0) AS BIGINT) AS n_dropped,
  CASE WHEN p.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM pages p LEFT JOIN kept k ON p.row = k.row"""
