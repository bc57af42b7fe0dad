"""Chat formatting: preference pairs with a shared prompt and masked completions.

Of a chosen and a rejected conversation the longest common prefix of turns (same role, same text) is
rendered once as the prompt; the rest of each is its completion.  Only assistant turns of a completion are
trained on: a mask gives their character spans in the rendered completion as ``start-end``.

A conversation is one string in the end, so its own turns (and no more) come together, once: turns
shuffle a single time, the two sides of a pair meet by pair, and prefix, texts and masks are expressions over the
two arrays of turns.

The registered query pairs conversations 2k (chosen) and 2k + 1 (rejected).

Defined results: turns are ordered by ``turn``, then role, then text, repeated turns included; null roles
and texts count as empty; turns without a conversation id are left out; a conversation without a partner
makes no pair; if one conversation is a prefix of the other its completion is empty; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    """pair, side (0 chosen, 1 rejected), turn, role, body."""
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair"),
        F.pmod(F.col("conv_id"), F.lit(2)).cast("int").alias("side"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("body"),
    )


def format_pairs(conversations: DataFrame) -> DataFrame:
    """pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    turn = F.struct("turn", "role", "body")
    # both sides in one aggregation by pair: an array each
    both = turns_of(conversations).groupBy("pair").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, turn))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("side") == 1, turn))).alias("b")
    )
    both = both.where((F.size("a") > 0) & (F.size("b") > 0))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["body"] == y["body"]), F.lit(False)))
    n = F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")
    both = both.withColumn("n", n)

    def rendered(turn):
        return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["body"], F.lit(CLOSE))

    def text(array):
        return F.array_join(F.transform(array, rendered), "")

    def mask(array):
        head = F.length(F.lit(OPEN + MIDDLE))
        spans = F.aggregate(
            array,
            F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, t: F.struct(
                (acc["at"] + F.length(rendered(t))).alias("at"),
                F.when(
                    t["role"] == "assistant",
                    F.concat(acc["out"], F.array(F.concat((acc["at"] + head + F.length(t["role"])).cast("string"), F.lit("-"), (acc["at"] + F.length(rendered(t)) - len(CLOSE)).cast("string")))),
                )
                .otherwise(acc["out"])
                .alias("out"),
            ),
        )
        return F.array_join(spans["out"], ",")

    def rest(c):
        return F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))

    return both.select(
        F.col("pair").alias("pair_id"),
        F.col("n").cast("long").alias("n_prefix"),
        text(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        text(rest("a")).alias("chosen"),
        text(rest("b")).alias("rejected"),
        mask(rest("a")).alias("chosen_mask"),
        mask(rest("b")).alias("rejected_mask"),
    )


SQL = """
WITH turns AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair, ((conv_id % 2) + 2) % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
pairs AS (SELECT pair FROM turns GROUP BY pair HAVING count(DISTINCT side) = 2),
prefix AS (
  SELECT p.pair, min(CASE WHEN a.place IS NULL OR b.place IS NULL OR a.role <> b.role OR a.body <> b.body THEN coalesce(a.place, b.place) END) AS differs, count(*) AS n
  FROM pairs p JOIN ((SELECT * FROM turns WHERE side = 0) a FULL JOIN (SELECT * FROM turns WHERE side = 1) b ON a.pair = b.pair AND a.place = b.place) ON p.pair = coalesce(a.pair, b.pair)
  GROUP BY p.pair),
shown AS (
  SELECT t.*, coalesce(x.differs, x.n) AS n, '<|' || role || '|>' || chr(10) || body || chr(10) AS piece
  FROM turns t JOIN prefix x ON t.pair = x.pair),
spans AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair, side, place >= n ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM shown)
SELECT pair AS pair_id, CAST(any_value(n) AS BIGINT) AS n_prefix,
  coalesce(string_agg(piece, '' ORDER BY place) FILTER (WHERE side = 0 AND place < n), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY place) FILTER (WHERE side = 0 AND place >= n), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY place) FILTER (WHERE side = 1 AND place >= n), '') AS rejected,
  coalesce(string_agg(CAST(CAST(pos + 5 + length(role) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(piece) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (WHERE side = 0 AND place >= n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(CAST(pos + 5 + length(role) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(piece) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (WHERE side = 1 AND place >= n AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY pair"""
