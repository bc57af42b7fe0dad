"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are words (A-Z lower-cased).  With grams of ``GRAM`` words and ``WINDOW`` words to a window, every
run of ``WINDOW`` words keeps the least hash of its grams, so a span that a document and an item share, of
a window's length or more, has a fingerprint in common: none is missed.  An item of fewer words, but not
none, is one window of all its words, with its own hash as fingerprint.

1. Documents' distinct fingerprints are exploded and joined with the items' (semi join).
2. For documents with a hit, hits are extended to all windows that keep such a fingerprint, by a join on document
   and fingerprint, and those windows' words are compared with the items' windows exactly.
3. Per document the windows that occur are merged: words in any of them, and the items they belong to.

The items' tables are written first.  Their true size decides whether they are broadcast; above the
session's threshold the joins shuffle by fingerprint and by window.  A row is known by its id and two
64-bit digests of its text, so copies and repeated ids keep their own results.

Defined results: a null text has no words; a document without hits has n_hit 0, n_items 0 and the digest
of an empty list; items without words have no windows; items without an id count for hits but not as
items; an id that several items carry counts once; an empty table of items hits nothing; an empty table
of documents gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._scratch import written

WINDOW = 8
GRAM = 5
LEAST_ITEMS = 2
#: Fixed value: what a word is, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ("id", "d1", "d2")


def folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast function serves texts of ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def _grams(h: Column, k: int, n: Column) -> Column:
    """Hashes of k consecutive words; none where there are fewer."""
    return F.transform(F.slice(h, F.lit(1), F.greatest(n - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k)), F.lit(k)))


def _with_marks(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds ``_w`` (words), ``_h``, ``_m`` (each window's fingerprint) and ``_s<k>`` (hashes of runs of k words)."""
    df = df.withColumn("_w", words(F.col("_text"))).withColumn("_n", F.size("_w"))
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_g", _grams(F.col("_h"), GRAM, F.col("_n")))
    span = WINDOW - GRAM + 1
    least = F.transform(
        F.slice("_g", F.lit(1), F.greatest(F.col("_n") - (WINDOW - 1), F.lit(0))), lambda x, i: F.least(x, *(F.get(F.col("_g"), i + j) for j in range(1, span)))
    )
    df = df.withColumn("_m", least)
    for k in short:
        df = df.withColumn(f"_s{k}", _grams(F.col("_h"), k, F.col("_n")))
    return df


def _windows(marks: str, size: int) -> Column:
    """(start, size, fingerprint) of each window."""
    return F.transform(marks, lambda m, i: F.struct(i.alias("start"), F.lit(size).alias("size"), m.alias("mark")))


def item_windows(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """mark, body, items: each different window of the items, its fingerprint and the ids that have it."""
    base = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    marked = _with_marks(base, list(range(1, WINDOW)))
    spans = _windows("_m", WINDOW)
    for k in range(1, WINDOW):
        spans = F.when(F.col("_n") == k, _windows(f"_s{k}", k)).otherwise(spans)
    each = marked.select("item", "_w", F.explode(spans).alias("s"))
    each = each.select("item", F.col("s.mark").alias("mark"), F.col("s.size").alias("size"), F.array_join(F.slice("_w", F.col("s.start") + 1, F.col("s.size")), " ").alias("body"))
    return each.groupBy("mark", "size", "body").agg(F.collect_set("item").alias("items"))


def scan(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    known = written(item_windows(items, item_col, item_text_col), "items")
    short = sorted(r["size"] for r in known.where(F.col("size") < WINDOW).select("size").distinct().collect())  # at most seven numbers
    marks = written(known.select("mark").distinct(), "marks")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(3), text).alias("d2"), text.alias("_text"))
    marked = _with_marks(rows, short)
    prints = F.array_distinct(F.concat("_m", *(f"_s{k}" for k in short)))
    hits = marked.select(*_KEY, F.explode(prints).alias("mark")).join(marks, "mark", "left_semi")
    hits = written(hits.distinct(), "hits")

    def same(a: str, b: str) -> Column:
        return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.d1") == F.col(f"{b}.d1")) & (F.col(f"{a}.d2") == F.col(f"{b}.d2"))

    # each different text with a hit once; its windows meet its hits as rows, so that a long text costs in proportion
    keys = written(hits.select(*_KEY).distinct(), "hit_keys")
    texts = rows.alias("r").join(keys.alias("h"), same("r", "h"), "left_semi").dropDuplicates(_KEY)
    texts = written(texts, "hit_texts")
    spans = F.concat(_windows("_m", WINDOW), *(_windows(f"_s{k}", k) for k in short))
    spans = _with_marks(texts, short).select(*_KEY, F.explode(spans).alias("s"))
    spans = spans.alias("w").join(hits.alias("h"), same("w", "h") & (F.col("w.s.mark") == F.col("h.mark")), "left_semi").groupBy(*_KEY).agg(F.collect_list("s").alias("spans"))
    hit = texts.alias("r").join(spans.alias("h"), same("r", "h")).select("r.id", "r.d1", "r.d2", words(F.col("r._text")).alias("_w"), "h.spans")
    full = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), s["mark"].alias("mark"), F.array_join(F.slice(F.col("_w"), s["start"] + 1, s["size"]), " ").alias("body")))
    found = hit.select(*_KEY, F.explode(full).alias("s")).select(*_KEY, "s.start", "s.size", "s.mark", "s.body").join(known, ["mark", "size", "body"])
    found = found.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["size"]).alias("end"), (a["n"] + F.greatest(s["start"] + s["size"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")),
    )
    found = found.select(*_KEY, covered["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    counted = rows.select(*_KEY, F.size(words(F.col("_text"))).cast("long").alias("n_words"))
    out = counted.alias("c").join(found.alias("f"), same("c", "f"), "left")
    n_items = F.coalesce("n_items", F.lit(0))
    return out.select(
        F.col("c.id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        n_items.alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_items >= LEAST_ITEMS).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_items: int = 1) -> DataFrame:
    """The rows of ``docs``, all their columns kept, in which windows of fewer than ``least_items`` items occur.

    A row is dropped with its id: repeated rows of an id go together.  A row without an id is dropped with its text's digest.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.when(F.col(id_col).isNull(), F.concat(F.lit("t"), F.sha2(text, 256))).otherwise(F.concat(F.lit("i"), F.col(id_col).cast("string")))
    keyed = docs.select(key.alias("_key"), text.alias("_text"))
    gone = scan(keyed, items, id_col="_key", text_col="_text").where(F.col("n_items") >= least_items).select(F.col("_key").alias("_gone")).distinct()
    gone = written(gone, "gone")
    return docs.join(gone, key == gone["_gone"], "left_anti")


def sql(docs: str = "documents", items: str = "benchmark") -> str:
    """DuckDB SQL of ``scan`` over tables of these names."""
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}') AS w FROM {docs}),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}') AS w FROM {items}),
iw AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS body
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT row, s, size, array_to_string(w[s:s + size - 1], ' ') AS body
  FROM (SELECT row, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT dw.row, dw.s, dw.size, iw.item FROM dw JOIN iw ON dw.size = iw.size AND dw.body = iw.body),
cover AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(generate_series(s, s + size - 1)) AS p FROM hit) GROUP BY row),
ids AS (SELECT row, count(DISTINCT item) AS n, sha256(coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '')) AS sha FROM hit GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(x.n, 0) AS BIGINT) AS n_items,
  coalesce(x.sha, sha256('')) AS items_sha256, coalesce(x.n, 0) >= {LEAST_ITEMS} AS contaminated
FROM d LEFT JOIN cover c ON d.row = c.row LEFT JOIN ids x ON d.row = x.row"""
