"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import aggregates as A
from millrace.functions import scalar as S
from millrace.operators import calc, changelog, joins, over, rank, windows
from millrace.plans import nexmark
from millrace.session import scratch, table
from millrace.sources import binary, files, formats
from millrace.types import ROW_KIND, weight

HOUR, DAY = 3_600_000, 86_400_000
EPOCH = "TIMESTAMP '1970-01-01'"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


#: The events with a whole-number measure, put before SQL that reads ``e``.
E = "WITH e AS (SELECT event_id, ts, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS v, value, props FROM events) "


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("v"), "value", "props")


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def changes(spark: SparkSession, d: str) -> DataFrame:
    """An upsert stream by user: sign-ups insert, errors remove, all else updates."""
    kind = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", 3).otherwise(2)
    return events(spark, d).select("event_id", "user_id", F.pmod("v", F.lit(50)).alias("v"), kind.cast("tinyint").alias(ROW_KIND))


CHANGES = E + ", c AS (SELECT event_id, user_id, ((v % 50) + 50) % 50 AS v, CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 3 ELSE 2 END AS k FROM e) "

# -- calc ---------------------------------------------------------------------------------------------------


@query("calc_project", "SELECT l_orderkey, l_linenumber + 1 AS n, l_quantity * 2 AS q2 FROM lineitem")
def _(s, d):
    return calc.calc(lineitem(s, d), {"l_orderkey": F.col("l_orderkey"), "n": S.add("l_linenumber", F.lit(1), "int"), "q2": F.col("l_quantity") * 2})


@query("calc_filter", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R'")
def _(s, d):
    return lineitem(s, d).where((F.col("l_quantity") > 30) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_partkey", "l_quantity")


@query("calc_arith_trunc_div", E + "SELECT event_id, (v - 20000) // 7 AS q FROM e")
def _(s, d):
    return events(s, d).select("event_id", S.divide(F.col("v") - 20000, F.lit(7), "bigint").alias("q"))


@query("calc_mod", E + "SELECT event_id, (v - 20000) % 7 AS m FROM e")
def _(s, d):
    return events(s, d).select("event_id", S.modulo(F.col("v") - 20000, F.lit(7)).alias("m"))


@query("calc_wrap_arithmetic", """WITH t AS (SELECT o_orderkey, (o_orderkey * 2654435761) AS x FROM orders)
SELECT o_orderkey, CAST(((x + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS w FROM t""")
def _(s, d):
    a = S.wrap(F.col("o_orderkey"), "int")
    return orders(s, d).select("o_orderkey", S.wrap(S.multiply(a.cast("bigint"), F.lit(2654435761), "bigint"), "int").alias("w"))


@query("calc_case_coalesce_nullif", """SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band,
coalesce(nullif(event_type, 'error'), 'none') AS kind, (event_type = 'click') IS TRUE AS clicked FROM events""")
def _(s, d):
    band = F.when(F.col("value") < 10, "low").when(F.col("value") < 50, "mid").otherwise("high")
    return table(s, d, "events").select("event_id", band.alias("band"), F.coalesce(F.nullif(F.col("event_type"), F.lit("error")), F.lit("none")).alias("kind"), F.coalesce(F.col("event_type") == "click", F.lit(False)).alias("clicked"))


@query("calc_casts_widening", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, CAST(l_linenumber AS DOUBLE) AS f, CAST(l_linenumber AS DECIMAL(20,2)) AS c FROM lineitem")
def _(s, d):
    n = F.col("l_linenumber")
    return lineitem(s, d).select("l_orderkey", n.cast("bigint").alias("n"), n.cast("double").alias("f"), S.to_decimal(n, 20, 2).alias("c"))


@query("calc_cast_narrow_wrap", """SELECT o_orderkey, CAST(((o_orderkey + 128) % 256 + 256) % 256 - 128 AS TINYINT) AS t,
CAST(((o_orderkey + 32768) % 65536 + 65536) % 65536 - 32768 AS SMALLINT) AS m FROM orders""")
def _(s, d):
    return orders(s, d).select("o_orderkey", S.wrap("o_orderkey", "tinyint").alias("t"), S.wrap("o_orderkey", "smallint").alias("m"))


@query("calc_cast_saturate", """SELECT o_orderkey, CAST(least(greatest(trunc(o_totalprice - 200000), -128), 127) AS TINYINT) AS t,
CAST(trunc(o_totalprice) AS BIGINT) AS b FROM orders""")
def _(s, d):
    return orders(s, d).select("o_orderkey", S.float_to_int(F.col("o_totalprice") - 200000, "tinyint").alias("t"), S.float_to_int("o_totalprice", "bigint").alias("b"))


@query("calc_decimal", """SELECT o_orderkey, CAST(CAST(o_orderkey AS DECIMAL(12,2)) * CAST(1.13 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS m,
CAST(CAST(o_orderkey AS DECIMAL(12,2)) + CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(14,2)) AS p FROM orders""")
def _(s, d):
    k = S.to_decimal("o_orderkey", 12, 2)
    return orders(s, d).select("o_orderkey", S.decimal_op(k, "*", F.lit("1.13").cast("decimal(3,2)"), 18, 4).alias("m"), S.decimal_op(k, "+", F.lit("0.25").cast("decimal(3,2)"), 14, 2).alias("p"))


@query("calc_string_fns", """SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, CAST(length(c_name) AS INTEGER) AS n, trim('  ' || c_name || ' ') AS t, ltrim('  ' || c_name) AS lt, rtrim(c_name || '  ') AS rt,
substr(c_name, 3, 5) AS sub, CAST(instr(c_name, '0') AS INTEGER) AS pos, replace(c_name, '0', 'oo') AS rep, reverse(c_name) AS rev, repeat(c_mktsegment, 2) AS twice,
left(c_name, 4) AS le, right(c_name, 4) AS ri, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rp, CAST(ascii(c_name) AS INTEGER) AS a, chr(65 + c_nationkey) AS ch FROM customer""")
def _(s, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return table(s, d, "customer").select(
        "c_custkey", F.upper(n).alias("u"), F.lower(n).alias("l"), F.char_length(n).alias("n"), F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), F.ltrim(F.concat(F.lit("  "), n)).alias("lt"), F.rtrim(F.concat(n, F.lit("  "))).alias("rt"),
        F.substring(n, 3, 5).alias("sub"), S.position("0", n).alias("pos"), F.replace(n, F.lit("0"), F.lit("oo")).alias("rep"), F.reverse(n).alias("rev"), F.repeat(m, 2).alias("twice"),
        F.left(n, F.lit(4)).alias("le"), F.right(n, F.lit(4)).alias("ri"), F.lpad(m, 12, "*").alias("lp"), F.rpad(m, 12, "*").alias("rp"), F.ascii(n).alias("a"), F.chr((F.col("c_nationkey") + 65).cast("bigint")).alias("ch"),
    )


@query("calc_split_index", "SELECT page_id, CASE WHEN len(string_split(url, '/')) >= 3 THEN string_split(url, '/')[3] END AS host, CASE WHEN len(string_split(url, '/')) >= 8 THEN string_split(url, '/')[8] END AS deep FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", S.split_index("url", "/", 2).alias("host"), S.split_index("url", "/", 7).alias("deep"))


_PRICE, _QUANTITY = "CAST(l_extendedprice AS DECIMAL(12,2))", "CAST(l_quantity AS DECIMAL(6,2))"


def _hugeint(x: str, y: str, scale: int) -> str:
    """x / y, both positive with two fraction digits, half up to a scale, in whole numbers."""
    a, b = f"CAST({x} * 100 AS HUGEINT) * {10**scale}", f"CAST({y} * 100 AS HUGEINT)"
    whole = f"((2 * ({a}) + ({b})) // (2 * ({b})))"
    return f"CAST(CAST({whole} // {10**scale} AS VARCHAR) || '.' || lpad(CAST({whole} % {10**scale} AS VARCHAR), {scale}, '0') AS DECIMAL(38,{scale}))"


@query("calc_decimal_div", f"SELECT l_orderkey, l_linenumber, {_hugeint(_PRICE, _QUANTITY, 10)} AS q, {_hugeint(_QUANTITY, _PRICE, 18)} AS r FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0")
def _(s, d):
    x, y = S.to_decimal("l_extendedprice", 12, 2), S.to_decimal("l_quantity", 6, 2)
    q, r = S.decimal_op(x, "/", y, 38, 10, types=((12, 2), (6, 2))), S.decimal_op(y, "/", x, 38, 18)
    return lineitem(s, d).where("l_extendedprice > 0 AND l_quantity > 0").select("l_orderkey", "l_linenumber", q.alias("q"), r.alias("r"))


@query("calc_decimal_mod", f"SELECT l_orderkey, l_linenumber, CAST({_PRICE} % {_QUANTITY} AS DECIMAL(6,2)) AS m, CAST((-{_PRICE}) % CAST(0.70 AS DECIMAL(3,2)) AS DECIMAL(6,2)) AS n FROM lineitem WHERE l_quantity > 0")
def _(s, d):
    x, y = S.to_decimal("l_extendedprice", 12, 2), S.to_decimal("l_quantity", 6, 2)
    return lineitem(s, d).where("l_quantity > 0").select("l_orderkey", "l_linenumber", S.decimal_op(x, "%", y, 6, 2).alias("m"), S.decimal_op(-x, "%", F.lit("0.70").cast("decimal(3,2)"), 6, 2).alias("n"))


@query("calc_regexp_java", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '\p{L}+') THEN regexp_extract(text, '\p{L}+', 0) END AS word,
CASE WHEN regexp_matches(text, '([a-z]*)\.') THEN regexp_extract(text, '([a-z]*)\.', 1) END AS before_stop, CASE WHEN regexp_matches(text, '\.(\n)?') AND regexp_extract(text, '\.(\n)?', 1) <> '' THEN chr(10) END AS line_end FROM documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", S.regexp_extract("text", r"\p{L}+").alias("word"), S.regexp_extract("text", r"([a-z]*)\.", 1).alias("before_stop"), S.regexp_extract("text", r"\.(\n)?", 1).alias("line_end"))


@query("calc_cast_string", """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p, substr(o_orderpriority, 1, 4) AS v, rpad(o_orderstatus, 3, ' ') AS c,
CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS x FROM orders""")
def _(s, d):
    return orders(s, d).select("o_orderkey", F.col("o_orderkey").cast("string").alias("t"), S.parse(F.substring("o_orderpriority", 1, 1), "int").alias("p"), S.to_varchar("o_orderpriority", 4).alias("v"), S.to_char("o_orderstatus", 3).alias("c"), S.to_decimal("o_totalprice", 12, 2).cast("string").alias("x"))


@query("calc_regexp_extract", r"""SELECT page_id, CASE WHEN regexp_matches(url, 'page=\d+') THEN regexp_extract(url, 'page=(\d+)', 1) END AS page,
CASE WHEN regexp_matches(url, '[a-z]+\.example') THEN regexp_extract(url, '[a-z]+\.example', 0) END AS site FROM pages""")
def _(s, d):
    return table(s, d, "pages").select("page_id", S.regexp_extract("url", r"page=(\d+)", 1).alias("page"), S.regexp_extract("url", r"[a-z]+\.example").alias("site"))


@query("calc_date_format", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", S.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("f"))


@query("calc_extract", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CAST(second(ts) AS BIGINT) AS s FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", *(S.extract(f, "ts").alias(a) for f, a in (("YEAR", "y"), ("MONTH", "m"), ("DAY", "d"), ("HOUR", "h"), ("MINUTE", "mi"), ("SECOND", "s"))))


@query("calc_interval_arith", "SELECT o_orderkey, o_orderdate + INTERVAL 36 HOUR AS later, o_orderdate - INTERVAL 1 DAY * 3 AS earlier FROM orders")
def _(s, d):
    return orders(s, d).select("o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 36 HOURS")).alias("later"), (F.col("o_orderdate") - F.expr("INTERVAL 1 DAY") * 3).alias("earlier"))


@query("calc_to_timestamp", "SELECT event_id, make_timestamp((epoch_us(ts) // 1000) * 1000) AS t FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", S.ntz_from_ms(S.epoch_ms("ts")).alias("t"))


@query("calc_math", "SELECT o_orderkey, abs(o_totalprice - 1000) AS a, floor(o_totalprice) AS f, ceil(o_totalprice) AS c, CAST(sign(o_totalprice - 1000) AS DOUBLE) AS s, round(sqrt(o_totalprice), 6) AS q, round(ln(o_totalprice), 6) AS l, round(pow(o_totalprice, 0.5), 6) AS p FROM orders")
def _(s, d):
    x = F.col("o_totalprice")
    return orders(s, d).select("o_orderkey", F.abs(x - 1000).alias("a"), S.floor(x).alias("f"), S.ceil(x).alias("c"), F.signum(x - 1000).alias("s"), F.round(F.sqrt(x), 6).alias("q"), F.round(F.ln(x), 6).alias("l"), F.round(F.pow(x, F.lit(0.5)), 6).alias("p"))


@query("calc_field_access", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    e = table(s, d, "events").select("event_id", formats.json_decode("props", T.StructType([T.StructField("k", T.LongType())])).alias("row"))
    return e.select("event_id", F.col("row.k").alias("k"))


@query("calc_array_map_item", """SELECT event_id, list_extract(string_split(event_type, 'i'), 2) AS second, CASE WHEN event_type = 'click' THEN value END AS clicked FROM events""")
def _(s, d):
    e = table(s, d, "events")
    return e.select("event_id", S.item(F.split("event_type", "i"), 2).alias("second"), S.item(F.create_map("event_type", "value"), "click").alias("clicked"))


@query("calc_like_in_between", "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%E%' AND p_size IN (1, 5, 9, 20) OR p_retailprice BETWEEN 950 AND 1000")
def _(s, d):
    return table(s, d, "part").where(F.col("p_type").like("%E%") & F.col("p_size").isin(1, 5, 9, 20) | F.col("p_retailprice").between(950, 1000)).select("p_partkey", "p_name")


@query("calc_proctime")
def _(s, d):
    return table(s, d, "region").select("r_regionkey", F.current_timestamp().alias("proc_time"))


@query("udf_count_char", "SELECT c_custkey, CAST(length(c_mktsegment) - length(replace(c_mktsegment, 'E', '')) AS BIGINT) AS n FROM customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", S.count_char("c_mktsegment", "E").alias("n"))


@query("udf_scalar", "SELECT c_custkey, c_mktsegment || ':' || length(c_name) AS x FROM customer")
def _(s, d):
    from millrace.functions import udf

    joined = udf.scalar(lambda a, b: None if a is None or b is None else f"{a}:{len(b)}", "string")
    return table(s, d, "customer").select("c_custkey", joined("c_mktsegment", "c_name").alias("x"))


# -- sets and shapes ------------------------------------------------------------------------------------------


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
def _(s, d):
    return calc.union_all(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
def _(s, d):
    return calc.union_distinct(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k")))


_GROUPED = "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS grouping_id, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY "


def _grouped() -> list[Column]:
    return [A.count().alias("n"), A.sum_("l_linenumber", "bigint").alias("s")]


@query("grouping_sets", _GROUPED + "GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def _(s, d):
    return calc.grouping_sets(lineitem(s, d), [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], ["l_returnflag", "l_linestatus"], *_grouped())


@query("rollup", _GROUPED + "ROLLUP (l_returnflag, l_linestatus)")
def _(s, d):
    return calc.rollup(lineitem(s, d), ["l_returnflag", "l_linestatus"], *_grouped())


@query("cube", _GROUPED + "CUBE (l_returnflag, l_linestatus)")
def _(s, d):
    return calc.cube(lineitem(s, d), ["l_returnflag", "l_linestatus"], *_grouped())


@query("unnest_array", "SELECT page_id, unnest(string_split(url, '/')) AS part FROM pages")
def _(s, d):
    return calc.unnest_array(table(s, d, "pages").select("page_id", F.split("url", "/").alias("parts")), "parts", "part").drop("parts")


@query("unnest_left_ordinality", """SELECT event_id, x.part, CAST(x.n AS INTEGER) AS n FROM events e LEFT JOIN (
SELECT event_id, unnest(string_split(event_type, 'i')) AS part, generate_subscripts(string_split(event_type, 'i'), 1) AS n FROM events WHERE event_type <> 'error') x USING (event_id)""")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.split("event_type", "i")).alias("parts"))
    return calc.unnest_array(e, "parts", "part", left=True, ordinality="n").drop("parts")


@query("unnest_map", "SELECT event_id, k, x FROM (SELECT event_id, 'v' AS k, value AS x FROM events UNION ALL SELECT event_id, 'u', CAST(user_id AS DOUBLE) FROM events)")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.create_map(F.lit("v"), F.col("value"), F.lit("u"), F.col("user_id").cast("double")).alias("m"))
    return calc.unnest_map(e, "m", "k", "x").drop("m")


@query("unnest_multiset", "SELECT l_orderkey, l_returnflag AS x FROM lineitem, generate_series(1, l_linenumber) g(i)")
def _(s, d):
    rows = lineitem(s, d).select("l_orderkey", F.create_map("l_returnflag", "l_linenumber").alias("m"))
    return calc.unnest_multiset(rows, "m", "x").drop("m")


@query("unnest_rows", "SELECT event_id, event_type AS a, user_id AS b FROM events UNION ALL SELECT event_id, event_type || '!', user_id + 1 FROM events WHERE event_type <> 'view'")
def _(s, d):
    t = F.col("event_type")
    rows = F.array(F.struct(t.alias("a"), F.col("user_id").alias("b")), F.when(t != "view", F.struct(F.concat(t, F.lit("!")).alias("a"), (F.col("user_id") + 1).alias("b"))))
    return calc.unnest_rows(table(s, d, "events").select("event_id", rows.alias("rs")), "rs").drop("rs")


@query("limit_offset", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 25 OFFSET 10")
def _(s, d):
    return calc.limit(table(s, d, "events").select("event_id", "event_type"), [F.asc("event_id")], 25, 10)


@query("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(s, d):
    return calc.limit(orders(s, d).select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@query("event_time_sort", "SELECT event_id, ts, user_id FROM events ORDER BY ts, event_id")
def _(s, d):
    return calc.event_time_sort(table(s, d, "events").select("event_id", "ts", "user_id"), "ts", "event_id")


# -- aggregates -----------------------------------------------------------------------------------------------


@query("agg_sum_min_max_count", E + "SELECT user_id, CAST(sum(v) AS BIGINT) AS s, min(v) AS lo, max(v) AS hi, count(v) AS n FROM e GROUP BY user_id")
def _(s, d):
    return events(s, d).groupBy("user_id").agg(A.sum_("v", "bigint").alias("s"), A.min_("v").alias("lo"), A.max_("v").alias("hi"), A.count("v").alias("n"))


@query("agg_avg_int_trunc", E + "SELECT user_id, CAST(sum(v) // count(v) AS BIGINT) AS a FROM e GROUP BY user_id")
def _(s, d):
    return events(s, d).groupBy("user_id").agg(A.avg_int("v", "bigint").alias("a"))


@query("agg_sum_wrap", "SELECT l_returnflag, CAST((sum(l_linenumber) + 128) % 256 - 128 AS TINYINT) AS s FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    return lineitem(s, d).groupBy("l_returnflag").agg(A.sum_("l_linenumber", "tinyint").alias("s"))


@query("agg_avg_double", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS a, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY l_returnflag")
def _(s, d):
    return lineitem(s, d).groupBy("l_returnflag").agg(F.round(A.avg_float("l_extendedprice"), 4).alias("a"), F.round(A.sum_double("l_quantity"), 2).alias("s"))


@query("agg_decimal", """SELECT l_returnflag, CAST(sum(CAST(l_linenumber AS DECIMAL(10,2))) AS DECIMAL(38,2)) AS s,
CAST(CAST((sum(l_linenumber) * 1000000 * 2 + count(*)) // (count(*) * 2) AS DECIMAL(38,0)) / 1000000 AS DECIMAL(38,6)) AS a FROM lineitem GROUP BY l_returnflag""")
def _(s, d):
    x = S.to_decimal("l_linenumber", 10, 2)
    return lineitem(s, d).groupBy("l_returnflag").agg(A.sum_decimal(x, 2).alias("s"), A.avg_decimal(x, 2).alias("a"))


@query("agg_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(A.count_distinct("user_id").alias("n"))


@query("agg_sum_distinct", E + "SELECT event_type, CAST(sum(DISTINCT v % 1000) AS BIGINT) AS n FROM e GROUP BY event_type")
def _(s, d):
    return events(s, d).groupBy("event_type").agg(A.sum_distinct(F.col("v") % 1000).alias("n"))


@query("agg_filter", E + "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, CAST(sum(v) FILTER (event_type = 'purchase') AS BIGINT) AS spent, max(v) FILTER (v < 5000) AS top FROM e GROUP BY user_id")
def _(s, d):
    kind = F.col("event_type")
    return events(s, d).groupBy("user_id").agg(A.count(when=kind == "click").alias("clicks"), A.sum_("v", "bigint", kind == "purchase").alias("spent"), A.max_("v", F.col("v") < 5000).alias("top"))


@query("agg_filter_distinct", E + "SELECT event_type, count(DISTINCT user_id) FILTER (v > 5000) AS n, count(DISTINCT user_id) AS m FROM e GROUP BY event_type")
def _(s, d):
    return events(s, d).groupBy("event_type").agg(A.count_distinct("user_id", F.col("v") > 5000).alias("n"), A.count_distinct("user_id").alias("m"))


@query("agg_global", E + "SELECT count(*) AS n, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v) // count(v) AS BIGINT) AS a FROM e")
def _(s, d):
    return events(s, d).agg(A.count().alias("n"), A.sum_("v", "bigint").alias("s"), A.avg_int("v", "bigint").alias("a"))


@query("agg_over_agg", E + "SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM e GROUP BY user_id) GROUP BY n")
def _(s, d):
    return events(s, d).groupBy("user_id").agg(A.count().alias("n")).groupBy("n").agg(A.count().alias("users"))


@query("agg_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(s, d):
    return lineitem(s, d).select("l_returnflag", "l_linestatus").distinct()


@query("agg_string_minmax", "SELECT c_nationkey, min(c_name) AS lo, max(c_mktsegment) AS hi FROM customer GROUP BY c_nationkey")
def _(s, d):
    return table(s, d, "customer").groupBy("c_nationkey").agg(A.min_("c_name").alias("lo"), A.max_("c_mktsegment").alias("hi"))


@query("agg_complex_keys", "SELECT string_split(event_type, 'i') AS k, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return table(s, d, "events").groupBy(F.split("event_type", "i").alias("k")).agg(A.count().alias("n"))


# -- windows --------------------------------------------------------------------------------------------------

_SUMS = "count(*) AS n, CAST(sum(v) AS BIGINT) AS s"
_BUCKET = f"time_bucket(INTERVAL 1 HOUR, ts, {EPOCH})"


def _sums() -> list[Column]:
    return [A.count().alias("n"), A.sum_("v", "bigint").alias("s")]


def _partial() -> tuple[dict, dict]:
    return {"_n": F.count(F.lit(1)), "_s": F.sum("v")}, {"n": F.sum("_n"), "s": F.sum("_s")}


@query("win_tumble", E + f"SELECT {_BUCKET} AS window_start, {_BUCKET} + INTERVAL 1 HOUR AS window_end, event_type, {_SUMS} FROM e GROUP BY ALL")
def _(s, d):
    return windows.tumble_aggregate(events(s, d), "ts", HOUR, ["event_type"], *_sums())


def _hop_sql(slide: int, size: int, keys: str, unit: str = "HOUR") -> str:
    n = -(-size // slide)
    starts = ", ".join(f"time_bucket(INTERVAL {slide} {unit}, ts, {EPOCH}) - INTERVAL {i * slide} {unit}" for i in range(n))
    return E + f"SELECT w AS window_start, w + INTERVAL {size} {unit} AS window_end, {keys}, {_SUMS} FROM (SELECT *, unnest([{starts}]) AS w FROM e) WHERE ts < w + INTERVAL {size} {unit} GROUP BY ALL"


@query("win_hop", _hop_sql(6, 24, "event_type"))
def _(s, d):
    return windows.hop_aggregate(events(s, d), "ts", 6 * HOUR, 24 * HOUR, ["event_type"], *_partial())


@query("win_hop_nondividing", _hop_sql(5, 12, "event_type"))
def _(s, d):
    return windows.aggregate(windows.hop(events(s, d), "ts", 5 * HOUR, 12 * HOUR), ["event_type"], *_sums())


@query("win_hop_gapped", _hop_sql(6, 2, "event_type"))
def _(s, d):
    return windows.aggregate(windows.hop(events(s, d), "ts", 6 * HOUR, 2 * HOUR), ["event_type"], *_sums())


@query("win_cumulate", E + f"""SELECT b AS window_start, b + to_hours(CAST(i AS INTEGER) * 6) AS window_end, event_type, {_SUMS} FROM (
SELECT *, time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) AS b, unnest(generate_series(CAST(floor(hour(ts) / 6) AS BIGINT) + 1, 4)) AS i FROM e) GROUP BY ALL""")
def _(s, d):
    return windows.cumulate_aggregate(events(s, d), "ts", 6 * HOUR, DAY, ["event_type"], *_partial())


_SESSIONS = ", x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM x) "


@query("win_session", E + _SESSIONS + f"SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, {_SUMS} FROM g GROUP BY user_id, g")
def _(s, d):
    return windows.session_aggregate(events(s, d), "ts", HOUR // 2, ["user_id"], *_sums())


@query("win_tumble_tvf", E + f"SELECT event_id, v, {_BUCKET} AS window_start, {_BUCKET} + INTERVAL 1 HOUR AS window_end, {_BUCKET} + INTERVAL 3599999 MILLISECOND AS window_time FROM e")
def _(s, d):
    return windows.tumble(events(s, d).select("event_id", "v", "ts"), "ts", HOUR).drop("ts")


@query("win_cumulate_tvf", E + f"""SELECT event_id, b AS window_start, b + to_hours(CAST(i AS INTEGER) * 6) AS window_end, b + to_hours(CAST(i AS INTEGER) * 6) - INTERVAL 1 MILLISECOND AS window_time FROM (
SELECT *, time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) AS b, unnest(generate_series(CAST(floor(hour(ts) / 6) AS BIGINT) + 1, 4)) AS i FROM e)""")
def _(s, d):
    return windows.cumulate(events(s, d).select("event_id", "ts"), "ts", 6 * HOUR, DAY).drop("ts")


@query("win_distinct_only", f"SELECT DISTINCT {_BUCKET} AS window_start, {_BUCKET} + INTERVAL 1 HOUR AS window_end, user_id FROM events")
def _(s, d):
    return windows.aggregate(windows.tumble(events(s, d), "ts", HOUR), ["user_id"])


@query("win_legacy_group", E + f"SELECT {_BUCKET} AS w_start, {_BUCKET} + INTERVAL 1 HOUR AS w_end, {_BUCKET} + INTERVAL 3599999 MILLISECOND AS w_rowtime, event_type, {_SUMS} FROM e GROUP BY ALL")
def _(s, d):
    return windows.legacy(windows.tumble_aggregate(events(s, d), "ts", HOUR, ["event_type"], *_sums()))


@query("win_count_distinct", f"SELECT {_BUCKET} AS window_start, {_BUCKET} + INTERVAL 1 HOUR AS window_end, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def _(s, d):
    return windows.tumble_aggregate(events(s, d), "ts", HOUR, [], A.count_distinct("user_id").alias("users"))


_RANKED = E + f", w AS (SELECT event_id, user_id, event_type, v, time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) AS window_start, time_bucket(INTERVAL 1 DAY, ts, {EPOCH}) + INTERVAL 1 DAY AS window_end, ts FROM e) "


def _daily(s, d):
    return windows.tumble(events(s, d).select("event_id", "user_id", "event_type", "v", "ts"), "ts", DAY).drop("window_time")


@query("win_topn", _RANKED + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start, event_type ORDER BY v DESC, event_id) AS r FROM w) WHERE r <= 3")
def _(s, d):
    return rank.window_top_n(_daily(s, d), ["event_type"], [F.desc("v"), F.asc("event_id")], 3, "r")


@query("win_dedup_first", _RANKED + "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY window_start, user_id ORDER BY ts, event_id) AS r FROM w) WHERE r = 1")
def _(s, d):
    return rank.window_top_n(_daily(s, d), ["user_id"], [F.asc("ts"), F.asc("event_id")], 1)


@query("win_dedup_last", _RANKED + "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY window_start, user_id ORDER BY ts DESC, event_id DESC) AS r FROM w) WHERE r = 1")
def _(s, d):
    return rank.window_top_n(_daily(s, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 1)


@query("win_agg_over_window_agg", E + f"SELECT time_bucket(INTERVAL 1 DAY, w, {EPOCH}) AS window_start, time_bucket(INTERVAL 1 DAY, w, {EPOCH}) + INTERVAL 1 DAY AS window_end, max(n) AS most FROM (SELECT {_BUCKET} AS w, count(*) AS n FROM e GROUP BY 1) GROUP BY ALL")
def _(s, d):
    hourly = windows.tumble_aggregate(events(s, d), "ts", HOUR, [], A.count().alias("n"))
    return windows.tumble_aggregate(hourly, "window_start", DAY, [], A.max_("n").alias("most"))


# -- over -----------------------------------------------------------------------------------------------------


@query("over_range_unbounded", E + "SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS s, count(v) OVER w AS n, min(v) OVER w AS lo, max(v) OVER w AS hi FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def _(s, d):
    spec = over.range_unbounded(["user_id"], "ts")
    return over.over(events(s, d), spec, {"s": F.sum("v"), "n": F.count("v"), "lo": F.min("v"), "hi": F.max("v")}).select("event_id", "s", "n", "lo", "hi")


@query("over_rows_n", E + "SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS s, count(v) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def _(s, d):
    return over.over(events(s, d), over.rows_preceding(["user_id"], "ts", 3, "event_id"), {"s": F.sum("v"), "n": F.count("v")}).select("event_id", "s", "n")


@query("over_range_interval", E + "SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS s, max(v) OVER w AS hi FROM e WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 7200000 PRECEDING AND CURRENT ROW)")
def _(s, d):
    return over.over(events(s, d), over.range_interval(["user_id"], "ts", 2 * HOUR, S.epoch_ms_nearest), {"s": F.sum("v"), "hi": F.max("v")}).select("event_id", "s", "hi")


@query("over_rank_functions", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_number, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def _(s, d):
    return events(s, d).select("event_id", *(c.alias(n) for n, c in over.ranks(["user_id"], "ts", "event_id").items()))


@query("over_first_last", E + "SELECT event_id, first_value(v) OVER w AS f, last_value(v) OVER w AS l FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(s, d):
    return over.over(events(s, d), over.rows_preceding(["user_id"], "ts", 4, "event_id"), {"f": F.first("v"), "l": F.last("v")}).select("event_id", "f", "l")


@query("over_count_distinct", E + """SELECT event_id, count(DISTINCT event_type) OVER w AS n, CAST(sum(DISTINCT v % 100) OVER w AS BIGINT) AS s FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(s, d):
    e, spec = events(s, d).withColumn("m", F.col("v") % 100), over.rows_preceding(["user_id"], "ts", 9, "event_id")
    return e.select("event_id", over.count_distinct("event_type", spec).alias("n"), over.sum_distinct("m", spec).alias("s"))


# -- rank ------------------------------------------------------------------------------------------------------


@query("topn_asc", E + "SELECT event_id, user_id, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v, event_id) AS r FROM e) WHERE r <= 5")
def _(s, d):
    return rank.top_n(events(s, d).select("event_id", "user_id", "v"), ["user_id"], [F.asc("v"), F.asc("event_id")], 5)


@query("topn_desc_rank", E + "SELECT event_id, user_id, v, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_id) AS r FROM e) WHERE r <= 5")
def _(s, d):
    return rank.top_n(events(s, d).select("event_id", "user_id", "v"), ["user_id"], [F.desc("v"), F.asc("event_id")], 5, rank="r")


@query("topn_offset", E + "SELECT event_id, user_id, v, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_id) AS r FROM e) WHERE r BETWEEN 3 AND 6")
def _(s, d):
    return rank.top_n(events(s, d).select("event_id", "user_id", "v"), ["user_id"], [F.desc("v"), F.asc("event_id")], 4, offset=2, rank="r")


@query("topn_of_agg", E + "SELECT event_type, user_id, s, r FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s DESC, user_id) AS r FROM (SELECT event_type, user_id, CAST(sum(v) AS BIGINT) AS s FROM e GROUP BY 1, 2)) WHERE r <= 3")
def _(s, d):
    sums = events(s, d).groupBy("event_type", "user_id").agg(A.sum_("v", "bigint").alias("s"))
    return rank.top_n(sums, ["event_type"], [F.desc("s"), F.asc("user_id")], 3, rank="r")


_DEDUP = E + "SELECT event_id, user_id, h, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {}) AS r FROM (SELECT *, date_trunc('day', ts) AS h FROM e)) WHERE r = 1"


def _coarse(s, d):
    return events(s, d).select("event_id", "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("h"), "v")


@query("dedup_first_rowtime", _DEDUP.format("h, event_id"))
def _(s, d):
    return rank.dedup_first(_coarse(s, d), ["user_id"], "h", "event_id")


@query("dedup_last_rowtime", _DEDUP.format("h DESC, event_id DESC"))
def _(s, d):
    return rank.dedup_last(_coarse(s, d), ["user_id"], "h", "event_id")


@query("dedup_proctime_by_seq", _DEDUP.format("event_id DESC"))
def _(s, d):
    return rank.dedup_arrival(_coarse(s, d), ["user_id"], "event_id", first=False)


# -- joins -----------------------------------------------------------------------------------------------------

_ON = "FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) o {} JOIN (SELECT c_custkey, c_nationkey, c_acctbal FROM customer) c ON o_custkey = c_custkey"


def _sides(s, d):
    return orders(s, d).select("o_orderkey", "o_custkey", "o_totalprice"), table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


for _how, _kind in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"), ("semi", "SEMI")):

    @query(f"join_{_how}", "SELECT * " + _ON.format(_kind))
    def _(s, d, how=_how):
        o, c = _sides(s, d)
        return joins.regular(o, c, o["o_custkey"] == c["c_custkey"], how)


# no order lacks its customer: the condition makes the misses
for _name, _how, _kind in (("anti", "anti", "ANTI"), ("residual", "left", "LEFT")):

    @query(f"join_{_name}", "SELECT * " + _ON.format(_kind) + " AND o_totalprice > c_acctbal * 20")
    def _(s, d, how=_how):
        o, c = _sides(s, d)
        return joins.regular(o, c, (o["o_custkey"] == c["c_custkey"]) & (o["o_totalprice"] > c["c_acctbal"] * 20), how)


@query("join_of_aggs", """SELECT a.k, a.n, b.m FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY 1) b ON a.k = b.k""")
def _(s, d):
    a = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(A.count().alias("n"))
    b = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k2")).agg(A.count().alias("m"))
    return joins.regular(a, b, F.col("k") == F.col("k2")).drop("k2")


@query("join_multiway", "SELECT l_orderkey, l_linenumber, o_totalprice, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    c, n = table(s, d, "customer"), table(s, d, "nation")
    both = joins.regular(lineitem(s, d), orders(s, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return joins.regular(joins.regular(both, c, F.col("o_custkey") == F.col("c_custkey")), n, F.col("c_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "o_totalprice", "c_name", "n_name")


def _clicks(s, d):
    e = table(s, d, "events")
    l = e.where("event_type = 'click'").select(F.col("event_id").alias("lid"), F.col("user_id").alias("lu"), F.col("ts").alias("lts"))  # noqa: E741
    return l, e.where("event_type = 'purchase'").select(F.col("event_id").alias("rid"), F.col("user_id").alias("ru"), F.col("ts").alias("rts"))


_PAIR = "FROM (SELECT event_id AS lid, user_id AS lu, ts AS lts FROM events WHERE event_type = 'click') l {} JOIN (SELECT event_id AS rid, user_id AS ru, ts AS rts FROM events WHERE event_type = 'purchase') r ON "

for _how, _kind in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL")):

    @query(f"join_interval_{_how}", "SELECT * " + _PAIR.format(_kind) + "lu = ru AND epoch_ms(lts) - epoch_ms(rts) BETWEEN -36000000 AND 18000000 AND (lid + rid) % 5 <> 0")
    def _(s, d, how=_how):
        l, r = _clicks(s, d)  # noqa: E741
        return joins.interval(l, r, [("lu", "ru")], ("lts", "rts"), -10 * HOUR, 5 * HOUR, how, (F.col("lid") + F.col("rid")) % 5 != 0)

    @query(f"join_window_{_how}", f"""SELECT lid, lu, l.w AS window_start, rid, ru, r.w AS r_window_start FROM (SELECT event_id AS lid, user_id AS lu, time_bucket(INTERVAL 6 HOUR, ts, {EPOCH}) AS w FROM events WHERE event_type = 'click') l
{_kind} JOIN (SELECT event_id AS rid, user_id AS ru, time_bucket(INTERVAL 6 HOUR, ts, {EPOCH}) AS w FROM events WHERE event_type = 'purchase') r ON lu = ru AND l.w = r.w""")
    def _(s, d, how=_how):
        l, r = _clicks(s, d)  # noqa: E741
        out = joins.window(windows.tumble(l, "lts", 6 * HOUR), windows.tumble(r, "rts", 6 * HOUR), [("lu", "ru")], how)
        return out.select("lid", "lu", "window_start", "rid", "ru", "r_window_start")


def _versions(s, d):
    e = events(s, d)
    kind = F.when(F.col("event_type") == "error", 3).otherwise(0).cast("tinyint")
    versions = e.where("event_type IN ('signup', 'error', 'view')").select(F.col("user_id").alias("vu"), F.col("ts").alias("vts"), F.col("v").alias("rate"), F.col("event_id").alias("vid"), kind.alias(ROW_KIND))
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "v"), versions


_TEMPORAL = E + """, p AS (SELECT event_id, user_id, ts, v FROM e WHERE event_type = 'purchase'), r AS (SELECT user_id AS vu, ts AS vts, v AS rate, event_id AS vid, event_type FROM e WHERE event_type IN ('signup', 'error', 'view')),
j AS (SELECT * FROM p ASOF LEFT JOIN r ON p.user_id = r.vu AND p.ts >= r.vts), x AS (SELECT *, coalesce(event_type <> 'error', FALSE) AND {} AS hit FROM j) """
_CUT = ", ".join(f"CASE WHEN hit THEN {c} END AS {c}" for c in ("vu", "vts", "rate", "vid"))


@query("join_temporal_inner", _TEMPORAL.format("TRUE") + "SELECT event_id, user_id, ts, v, vu, vts, rate, vid FROM x WHERE hit")
def _(s, d):
    p, v = _versions(s, d)
    return joins.temporal(p, v, ("user_id", "vu"), ("ts", "vts"), "vid")


@query("join_temporal_left", _TEMPORAL.format("TRUE") + f"SELECT event_id, user_id, ts, v, {_CUT} FROM x")
def _(s, d):
    p, v = _versions(s, d)
    return joins.temporal(p, v, ("user_id", "vu"), ("ts", "vts"), "vid", "left")


@query("join_temporal_segments", _TEMPORAL.format("TRUE") + f"SELECT event_id, user_id, ts, v, {_CUT} FROM x")
def _(s, d):
    p, v = _versions(s, d)
    return joins.temporal(p, v, ("user_id", "vu"), ("ts", "vts"), "vid", "left", segment_ms=2 * DAY)


@query("join_temporal_residual", _TEMPORAL.format("coalesce(rate > v, FALSE)") + f"SELECT event_id, user_id, ts, v, {_CUT} FROM x")
def _(s, d):
    p, v = _versions(s, d)
    return joins.temporal(p, v, ("user_id", "vu"), ("ts", "vts"), "vid", "left", F.col("rate") > F.col("v"))


for _how, _kind in (("inner", "INNER"), ("left", "LEFT")):

    @query(f"join_lookup_{_how}", f"SELECT c_custkey, n_name FROM customer {_kind} JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey AND c_acctbal > 0")
    def _(s, d, how=_how):
        n, c = table(s, d, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name"), table(s, d, "customer")
        return joins.lookup(c, n, (c["c_nationkey"] == n["n_nationkey"]) & (c["c_acctbal"] > 0), how).select("c_custkey", "n_name")


# -- changelogs ------------------------------------------------------------------------------------------------


@query("changelog_collapse", CHANGES + "SELECT user_id, v FROM (SELECT user_id, v, CAST(sum(CASE WHEN k IN (0, 2) THEN 1 ELSE -1 END) AS BIGINT) AS net FROM c GROUP BY 1, 2), generate_series(1, net) g(i) WHERE net > 0")
def _(s, d):
    return changelog.collapse(changes(s, d).drop("event_id"))


@query("changelog_latest", CHANGES + "SELECT event_id, user_id, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM c) WHERE r = 1 AND k <> 3")
def _(s, d):
    return changelog.latest(changes(s, d), ["user_id"], "event_id")


@query("changelog_normalize", CHANGES + """, s AS (SELECT *, lag(CASE WHEN k <> 3 THEN v END) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM c), m AS (
SELECT CAST(0 AS TINYINT) AS _row_kind, event_id, 0 AS change, user_id, v FROM s WHERE k <> 3 AND b IS NULL UNION ALL
SELECT CAST(1 AS TINYINT), event_id, 0, user_id, b FROM s WHERE k <> 3 AND b <> v UNION ALL SELECT CAST(2 AS TINYINT), event_id, 1, user_id, v FROM s WHERE k <> 3 AND b <> v UNION ALL
SELECT CAST(3 AS TINYINT), event_id, 0, user_id, b FROM s WHERE k = 3 AND b IS NOT NULL) SELECT * FROM m""")
def _(s, d):
    return changelog.normalize(changes(s, d), ["user_id"], "event_id")


@query("changelog_retract_agg", CHANGES + """SELECT user_id, CAST(sum(w) AS BIGINT) AS n, CAST(sum(w * v) AS BIGINT) AS s, CAST(trunc(sum(w * v) / sum(w)) AS BIGINT) AS a FROM (SELECT *, CASE WHEN k IN (0, 2) THEN 1 ELSE -1 END AS w FROM c) GROUP BY user_id HAVING sum(w) > 0""")
def _(s, d):
    w = weight()
    return changelog.group_aggregate(changes(s, d), ["user_id"], A.count(weight=w).alias("n"), A.sum_("v", "bigint", weight=w).alias("s"), A.avg_int("v", "bigint", weight=w).alias("a"))


_ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.LongType()), T.StructField("t", T.StringType())])


@query("cdc_debezium_decode", E + """SELECT CAST(0 AS TINYINT) AS _row_kind, event_id AS id, v, event_type AS t FROM e WHERE event_type = 'signup' UNION ALL
SELECT CAST(1 AS TINYINT), event_id, v, NULL FROM e WHERE event_type = 'click' UNION ALL SELECT CAST(2 AS TINYINT), event_id, v + 1, 'click' FROM e WHERE event_type = 'click' UNION ALL
SELECT CAST(3 AS TINYINT), event_id, v, event_type FROM e WHERE event_type = 'error'""")
def _(s, d):
    t, row = F.col("event_type"), F.struct(F.col("event_id").alias("id"), "v", F.col("event_type").alias("t"))
    none = F.lit(None).cast("string")
    before = F.when(t == "error", row).when(t == "click", F.struct(F.col("event_id").alias("id"), F.col("v"), none.alias("t")))
    after = F.when(t == "signup", row).when(t == "click", F.struct(F.col("event_id").alias("id"), (F.col("v") + 1).alias("v"), t.alias("t")))
    op = F.when(t == "signup", "c").when(t == "click", "u").when(t == "error", "d")
    wire = events(s, d).where(op.isNotNull()).select(F.to_json(F.struct(before.alias("before"), after.alias("after"), op.alias("op"))).alias("value"))
    return formats.debezium_decode(wire, "value", _ROW)


@query("cdc_maxwell_old_presence", E + """SELECT CAST(0 AS TINYINT) AS _row_kind, event_id AS id, v, event_type AS t FROM e WHERE event_type = 'signup' UNION ALL
SELECT CAST(1 AS TINYINT), event_id, v - 1, NULL FROM e WHERE event_type = 'click' UNION ALL SELECT CAST(2 AS TINYINT), event_id, v, event_type FROM e WHERE event_type = 'click' UNION ALL
SELECT CAST(3 AS TINYINT), event_id, v, event_type FROM e WHERE event_type = 'error'""")
def _(s, d):
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "error", "delete")
    data = formats.json_encode(F.struct(F.col("event_id").alias("id"), "v", F.col("event_type").alias("t")))
    old = F.when(kind == "update", F.concat(F.lit(',"old":{"v":'), (F.col("v") - 1).cast("string"), F.lit(',"t":null}'))).otherwise(F.lit(""))
    wire = events(s, d).where(kind.isNotNull()).select(F.concat(F.lit('{"type":"'), kind, F.lit('","data":'), data, old, F.lit("}")).alias("value"))
    return formats.maxwell_decode(wire, "value", _ROW)


# -- formats ---------------------------------------------------------------------------------------------------


@query("json_roundtrip", "SELECT event_id AS id, CAST(floor(value * 100) AS BIGINT) AS v, event_type AS t FROM events")
def _(s, d):
    wire = events(s, d).select(formats.json_encode(F.struct(F.col("event_id").alias("id"), "v", F.col("event_type").alias("t"))).alias("value"))
    return wire.select(formats.json_decode("value", _ROW).alias("r")).select("r.*")


@query("json_decode_props", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    row = formats.json_decode("props", T.StructType([T.StructField("k", T.LongType())]), lenient=True)
    return table(s, d, "events").select(row["k"].alias("k")).groupBy("k").agg(A.count().alias("n"))


@query("csv_roundtrip", "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS v, 'a \"b\",' || c_name AS t FROM customer")
def _(s, d):
    wire = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("v"), F.concat(F.lit('a "b",'), "c_name").alias("t")).select(formats.csv_encode(["id", "v", "t"]).alias("value"))
    return wire.select(formats.csv_decode("value", _ROW).alias("r")).select("r.*")


@query("raw_codec", "SELECT o_orderkey, o_orderkey - 5000 AS b, CAST(o_orderkey - 5000 AS INTEGER) AS i, o_orderstatus AS t FROM orders")
def _(s, d):
    k = F.col("o_orderkey") - 5000
    wire = orders(s, d).select("o_orderkey", formats.raw_encode(k, "bigint").alias("x"), formats.raw_encode(k.cast("int"), "int", little_endian=True).alias("y"), formats.raw_encode("o_orderstatus", "string").alias("z"))
    return wire.select("o_orderkey", formats.raw_decode("x", "bigint").alias("b"), formats.raw_decode("y", "int", little_endian=True).alias("i"), formats.raw_decode("z", "string").alias("t"))

_WIRE_SQL = "SELECT event_id AS id, CAST(floor(value * 100) AS BIGINT) AS v, CASE WHEN event_type <> 'error' THEN event_type END AS t FROM events"


def _wire_rows(s, d):
    return events(s, d).select(F.col("event_id").alias("id"), "v", F.when(F.col("event_type") != "error", F.col("event_type")).alias("t"))


@query("avro_roundtrip", _WIRE_SQL)
def _(s, d):
    wire = _wire_rows(s, d).select(binary.avro_encode(["id", "v", "t"], _ROW).alias("value"))
    return wire.select(binary.avro_decode("value", _ROW).alias("r")).select("r.*")


@query("avro_confluent_roundtrip", _WIRE_SQL)
def _(s, d):
    wire = _wire_rows(s, d).select(binary.avro_encode(["id", "v", "t"], _ROW, schema_id=3).alias("value"))
    return wire.select(binary.avro_decode("value", _ROW, confluent=True).alias("r")).select("r.*")


@query("protobuf_roundtrip", _WIRE_SQL)
def _(s, d):
    fields = (binary.Field("id", 1, "int64"), binary.Field("v", 2, "sint64"), binary.Field("t", 3, "string", optional=True))
    wire = _wire_rows(s, d).select(binary.protobuf_encode(["id", "v", "t"], fields).alias("value"))
    return wire.select(binary.protobuf_decode("value", fields).alias("r")).select("r.*")


_MOVES = E + """SELECT CAST(0 AS TINYINT) AS _row_kind, event_id AS id, v, event_type AS t FROM e WHERE event_type = 'signup' UNION ALL
SELECT CAST(1 AS TINYINT), event_id, v - 1, event_type FROM e WHERE event_type = 'click' UNION ALL SELECT CAST(2 AS TINYINT), event_id, v, event_type FROM e WHERE event_type = 'click' UNION ALL
SELECT CAST(3 AS TINYINT), event_id, v, event_type FROM e WHERE event_type = 'error'"""


def _images(s, d):
    t = F.col("event_type")
    row = lambda v: F.struct(F.col("event_id").alias("id"), v.alias("v"), t.alias("t"))
    before = F.when(t == "error", row(F.col("v"))).when(t == "click", row(F.col("v") - 1))
    return events(s, d).where(t.isin("signup", "click", "error")), before, F.when(t != "error", row(F.col("v")))


@query("cdc_ogg_decode", _MOVES)
def _(s, d):
    e, before, after = _images(s, d)
    op = F.when(F.col("event_type") == "signup", "I").when(F.col("event_type") == "click", "U").otherwise("D")
    return formats.ogg_decode(e.select(F.to_json(F.struct(before.alias("before"), after.alias("after"), op.alias("op_type"))).alias("value")), "value", _ROW)


@query("cdc_canal_decode", _MOVES)
def _(s, d):
    e, before, after = _images(s, d)
    kind = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "click", "UPDATE").otherwise("DELETE")
    old = F.when(kind == "UPDATE", F.array(F.struct((F.col("v") - 1).alias("v"))))
    return formats.canal_decode(e.select(F.to_json(F.struct(F.array(F.coalesce(after, before)).alias("data"), old.alias("old"), kind.alias("type"))).alias("value")), "value", _ROW)


@query("cdc_debezium_avro", _MOVES)
def _(s, d):
    e, before, after = _images(s, d)
    image = T.StructType([T.StructField("before", _ROW), T.StructField("after", _ROW), T.StructField("op", T.StringType())])
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "click", "u").otherwise("d")
    rows = e.select(before.alias("before"), after.alias("after"), op.alias("op"))
    wire = rows.select(binary.avro_encode(image.names, image, schema_id=1).alias("value"))
    return formats.debezium_decode(wire.select(F.to_json(binary.avro_decode("value", image, confluent=True)).alias("value")), "value", _ROW)


@query("upsert_messages", """SELECT '{"id":' || event_id || '}' AS key, CASE WHEN event_type <> 'error' THEN '{"id":' || event_id || ',"t":"' || event_type || '"}' END AS value FROM events WHERE event_type <> 'view'""")
def _(s, d):
    kind = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 3).otherwise(2)
    rows = changelog.tag(events(s, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("t"), "event_type"), kind)
    return formats.upsert_encode(rows, ["id"], ["id", "t"])


@query("parquet_sink", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(s, d):
    path = scratch(s, "sink")
    files.write_parquet(orders(s, d).select("o_orderkey", "o_totalprice", "o_orderpriority"), path, partition_by=["o_orderpriority"], codec="zstd")
    return s.read.schema("o_orderkey bigint, o_totalprice double, o_orderpriority string").parquet(path)


@query("snapshot_upsert", CHANGES + "SELECT user_id, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM c) WHERE r = 1 AND k <> 3")
def _(s, d):
    kept = files.Snapshot(s, scratch(s, "snapshot"), ["user_id"], T.StructType([T.StructField("user_id", T.LongType()), T.StructField("v", T.LongType())]), buckets=4)
    c = changes(s, d)
    kept.upsert(c.where("user_id % 2 = 0"), "event_id")
    kept.upsert(c.where("user_id % 2 <> 0"), "event_id")
    return kept.read()


@query("datagen_events", """SELECT CAST(event_type AS INTEGER) AS event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN i % 50 = 0 THEN 0 WHEN i % 50 <= 3 THEN 1 ELSE 2 END AS event_type FROM range(10000) t(i)) GROUP BY 1""")
def _(s, d):
    return nexmark.event_stream(s, 10_000).groupBy("event_type").agg(A.count().alias("n"))


def queries() -> dict[str, Query]:
    from millrace.streaming import catalog as streaming

    return _QUERIES | nexmark.queries() | streaming.queries()


def oracle_sql() -> dict[str, str]:
    from millrace.streaming import catalog as streaming

    return _SQL | nexmark.oracle_sql() | streaming.oracle_sql()
