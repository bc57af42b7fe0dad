"""The Nexmark query suite (q0 to q5, q7 to q23) over person, auction and bid tables.

Persons, auctions and bids stand in for customers, orders and line items.  Line items have no key of their
own, so queries that rank bids order by every column that the result shows.  ``event_stream`` makes the
suite's own deterministic events; ``person_of``, ``auction_of`` and ``bid_of`` are the views of that stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import aggregates as A
from millrace.functions import scalar as S
from millrace.operators import joins, rank, windows
from millrace.session import table
from millrace.sources.files import datagen

DAY = 86_400_000

#: The three views in DuckDB SQL, put before each query's SQL.
VIEWS = """
WITH person AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS city, CAST(c_nationkey AS VARCHAR) AS state, TIMESTAMP '1992-01-01' + to_days(CAST(c_custkey % 2400 AS INTEGER)) AS date_time FROM customer),
auction AS (SELECT o_orderkey AS id, 'item-' || o_orderkey AS item_name, o_custkey AS seller, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS category,
  CAST(floor(o_totalprice) AS BIGINT) AS initial_bid, o_orderdate AS date_time, o_orderdate + INTERVAL 90 DAY AS expires FROM orders),
bid AS (SELECT l_orderkey AS auction, l_suppkey AS bidder, CAST(floor(l_extendedprice) AS BIGINT) AS price, 'channel-' || l_returnflag || l_linestatus AS channel,
  'https://auction.test/' || l_returnflag || '/' || l_partkey || '/item.htm?query=1&channel_id=' || l_suppkey AS url, l_shipdate AS date_time, CAST(l_linenumber AS BIGINT) AS line FROM lineitem)
"""


def person(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), F.col("c_nationkey").cast("string").alias("state"), (F.lit("1992-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 2400).cast("int"))).alias("date_time"))


def auction(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("item-"), F.col("o_orderkey").cast("string")).alias("item_name"), F.col("o_custkey").alias("seller"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("category"), F.floor("o_totalprice").cast("bigint").alias("initial_bid"),
        F.col("o_orderdate").alias("date_time"), (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("expires"),
    )


def bid(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("auction"), F.col("l_suppkey").alias("bidder"), F.floor("l_extendedprice").cast("bigint").alias("price"),
        F.concat(F.lit("channel-"), "l_returnflag", "l_linestatus").alias("channel"),
        F.concat(F.lit("https://auction.test/"), "l_returnflag", F.lit("/"), F.col("l_partkey").cast("string"), F.lit("/item.htm?query=1&channel_id="), F.col("l_suppkey").cast("string")).alias("url"),
        F.col("l_shipdate").alias("date_time"), F.col("l_linenumber").cast("bigint").alias("line"),
    )


def q0(spark, d):
    return bid(spark, d).select("auction", "bidder", "price", "date_time")


def q1(spark, d):
    return bid(spark, d).select("auction", "bidder", S.decimal_op(F.lit("0.908").cast("decimal(3,3)"), "*", F.col("price").cast("decimal(20,0)"), 23, 3).alias("price"), "date_time")


def q2(spark, d):
    return bid(spark, d).where(S.modulo("auction", F.lit(123)) == 0).select("auction", "price")


def q3(spark, d):
    a, p = auction(spark, d).withColumnRenamed("id", "auction_id"), person(spark, d).where(F.col("city").isin("BUILDING", "MACHINERY"))
    return joins.regular(a.where("category = 2"), p, F.col("seller") == p["id"]).select("name", "city", "state", F.col("auction_id").alias("id"))


def _winning(spark, d):
    a, b = auction(spark, d).withColumnRenamed("date_time", "opened"), bid(spark, d)
    return joins.regular(b, a, (b["auction"] == a["id"]) & b["date_time"].between(a["opened"], a["expires"]))


def q4(spark, d):
    best = _winning(spark, d).groupBy("id", "category").agg(F.max("price").alias("final"))
    return best.groupBy("category").agg(A.avg_int("final", "bigint").alias("final"))


def q5(spark, d):
    counts = windows.hop_aggregate(bid(spark, d), "date_time", 5 * DAY, 10 * DAY, ["auction"], {"n": F.count(F.lit(1))}, {"num": F.sum("n")})
    most = counts.groupBy("window_start", "window_end").agg(F.max("num").alias("max_num"))
    return joins.window(counts, most, [], residual=F.col("num") >= F.col("max_num")).select("auction", "num", "window_start")


def q7(spark, d):
    b = bid(spark, d)
    top = windows.tumble_aggregate(b, "date_time", 10 * DAY, [], F.max("price").alias("max_price")).select("max_price", F.col("window_end").alias("end_time"))
    near = joins.interval(b, top, [("price", "max_price")], ("date_time", "end_time"), -10 * DAY, 0)
    return near.select("auction", "bidder", "price", "date_time", "line", "channel")


def _new_sellers(p: DataFrame, a: DataFrame, size: int) -> DataFrame:
    joined = windows.aggregate(windows.tumble(p.select("id", "name", "date_time"), "date_time", size), ["id", "name"])
    sellers = windows.aggregate(windows.tumble(a.select("seller", "date_time"), "date_time", size), ["seller"])
    return joins.window(joined, sellers, [("id", "seller")]).select("id", "name", F.col("window_start").alias("stime"))


def q8(spark, d):
    return _new_sellers(person(spark, d), auction(spark, d), 30 * DAY)


def q9(spark, d):
    order = [F.desc("price"), F.asc("date_time"), *(F.asc(c) for c in ("bidder", "channel", "url", "line"))]
    return rank.top_n(_winning(spark, d), ["id"], order, 1).select("id", "item_name", "seller", "category", "auction", "bidder", "price", "date_time")


def q10(spark, d):
    return bid(spark, d).select("auction", "bidder", "price", "date_time", S.date_format("date_time", "yyyy-MM-dd").alias("dt"), S.date_format("date_time", "HH:mm").alias("hm"))


def q11(spark, d):
    return windows.session_aggregate(bid(spark, d), "date_time", 10 * DAY, ["bidder"], A.count().alias("bid_count")).select("bidder", "bid_count", "window_start", "window_end")


def q12(spark, d):
    now = bid(spark, d).withColumn("p_time", F.current_timestamp())
    return windows.tumble_aggregate(now, "p_time", 10_000, ["bidder"], A.count().alias("bid_count"))


def q13(spark, d):
    side = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value"))
    b = bid(spark, d)
    return joins.lookup(b, side, S.modulo(b["auction"], F.lit(25)) == side["k"]).select("auction", "bidder", "price", "date_time", "value")


def q14(spark, d):
    hour = S.extract("HOUR", F.col("date_time") + F.make_dt_interval(hours=F.pmod("bidder", F.lit(24)).cast("int")))
    kind = F.when((hour >= 8) & (hour <= 18), "dayTime").when((hour <= 6) | (hour >= 20), "nightTime").otherwise("otherTime")
    price = S.decimal_op(F.lit("0.908").cast("decimal(3,3)"), "*", F.col("price").cast("decimal(20,0)"), 23, 3)
    return bid(spark, d).where((price > 10_000) & (price < 50_000)).select("auction", "bidder", price.alias("price"), kind.alias("bid_time_type"), "date_time", S.count_char("url", "a").alias("c_counts"))


def _gates() -> tuple[Column, ...]:
    return F.col("price") < 10_000, (F.col("price") >= 10_000) & (F.col("price") < 50_000), F.col("price") >= 50_000


def _day_counts(rows: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """Bids, bidders and auctions, all and by rank of price; ``more`` are maxima.

    Distinct counts in two levels: once for each key and bidder (or auction) with flags of the ranks met, then for each key.
    """
    ranks = range(1, 4)
    met = lambda name: [F.max(F.when(F.col(name).isNotNull() & g, 1).otherwise(0)).alias(f"rank{i}_{name}s") for i, g in zip(ranks, _gates(), strict=True)]
    bids = [A.count().alias("total_bids"), *(A.count(when=g).alias(f"rank{i}_bids") for i, g in zip(ranks, _gates(), strict=True))]
    by_bidder = rows.groupBy(*keys, "bidder").agg(*bids, *(F.max(c).alias(n) for n, c in more.items()), *met("bidder")).withColumnRenamed("bidder", "of_bidder")
    by_auction = rows.groupBy(*keys, "auction").agg(*met("auction")).withColumnRenamed("auction", "of_auction")
    both = by_bidder.unionByName(by_auction, allowMissingColumns=True)
    out = [F.max(n).alias(n) for n in more]
    out += [F.sum(c).alias(c) for c in ("total_bids", *(f"rank{i}_bids" for i in ranks))]
    for name in ("bidder", "auction"):
        out += [F.count(f"of_{name}").alias(f"total_{name}s"), *(F.coalesce(F.sum(f"rank{i}_{name}s"), F.lit(0)).alias(f"rank{i}_{name}s") for i in ranks)]
    return both.groupBy(*keys).agg(*out)


def _monthly(b: DataFrame) -> DataFrame:
    """Grouped by number, formatted after."""
    return b.withColumn("month", F.year("date_time") * 12 + F.month("date_time") - 1)


def _month() -> Column:
    return F.format_string("%04d-%02d", F.floor(F.col("month") / 12).cast("int"), (F.col("month") % 12 + 1).cast("int")).alias("day")


def q15(spark, d):
    counts = _day_counts(_monthly(bid(spark, d)), ["month"])
    return counts.select(_month(), *(c for c in counts.columns if c != "month"))


def q16(spark, d):
    minute = F.hour("date_time") * 60 + F.minute("date_time")
    counts = _day_counts(_monthly(bid(spark, d)), ["channel", "month"], last=minute)
    last = F.format_string("%02d:%02d", F.floor(F.col("last") / 60).cast("int"), F.col("last") % 60).alias("minute")
    return counts.select("channel", _month(), last, *(c for c in counts.columns if c not in ("channel", "month", "last")))


def q17(spark, d):
    by = bid(spark, d).groupBy("auction", F.date_trunc("day", "date_time").alias("at")).agg(
        A.count().alias("total_bids"), *(A.count(when=g).alias(f"rank{i}_bids") for i, g in enumerate(_gates(), 1)),
        A.min_("price").alias("min_price"), A.max_("price").alias("max_price"), A.avg_int("price", "bigint").alias("avg_price"), A.sum_("price", "bigint").alias("sum_price"),
    )
    return by.select("auction", S.date_format("at", "yyyy-MM-dd").alias("day"), *(c for c in by.columns if c not in ("auction", "at")))


def q18(spark, d):
    order = [F.desc(c) for c in ("date_time", "price", "channel", "url", "line")]
    return rank.top_n(bid(spark, d), ["bidder", "auction"], order, 1)


def q19(spark, d):
    order = [F.desc("price"), *(F.asc(c) for c in ("date_time", "bidder", "channel", "url", "line"))]
    return rank.top_n(bid(spark, d), ["auction"], order, 10, rank="rank_number")


def q20(spark, d):
    a, b = auction(spark, d).withColumnRenamed("date_time", "opened"), bid(spark, d)
    return joins.regular(b, a.where("category = 5"), b["auction"] == a["id"]).select("auction", "bidder", "price", "channel", "url", "date_time", "item_name", "initial_bid", "opened", "expires", "seller", "category")


def _channel_ids(b: DataFrame, names: tuple[str, ...]) -> DataFrame:
    lowered, from_url = F.lower("channel"), S.regexp_extract("url", "(&|^)channel_id=([^&]*)", 2)
    channel = F.lit(None)
    for i, name in reversed(list(enumerate(names))):
        channel = F.when(lowered == name, str(i)).otherwise(channel if i < len(names) - 1 else from_url)
    return b.where(lowered.isin(*names) | from_url.isNotNull()).select("auction", "bidder", "price", "channel", channel.alias("channel_id"))


def q21(spark, d):
    return _channel_ids(bid(spark, d), ("channel-ro", "channel-af"))


def q22(spark, d):
    return bid(spark, d).select("auction", "bidder", "price", "channel", *(S.split_index("url", "/", i).alias(f"dir{i - 2}") for i in (3, 4, 5)))


def _sold_by_bidders(b: DataFrame, p: DataFrame, a: DataFrame) -> DataFrame:
    a = a.select("item_name", F.col("date_time").alias("opened"), "seller")
    known = joins.regular(b.select("auction", "bidder", "price"), p.select("id"), F.col("bidder") == F.col("id"))
    return joins.regular(known, a, F.col("seller") == F.col("bidder")).select("auction", "bidder", "price", "item_name", "opened", "seller")


def q23(spark, d):
    return _sold_by_bidders(bid(spark, d), person(spark, d), auction(spark, d))


_COUNTS = """count(*) AS total_bids, count(*) FILTER (price < 10000) AS rank1_bids, count(*) FILTER (price >= 10000 AND price < 50000) AS rank2_bids, count(*) FILTER (price >= 50000) AS rank3_bids,
count(DISTINCT bidder) AS total_bidders, count(DISTINCT bidder) FILTER (price < 10000) AS rank1_bidders, count(DISTINCT bidder) FILTER (price >= 10000 AND price < 50000) AS rank2_bidders, count(DISTINCT bidder) FILTER (price >= 50000) AS rank3_bidders,
count(DISTINCT auction) AS total_auctions, count(DISTINCT auction) FILTER (price < 10000) AS rank1_auctions, count(DISTINCT auction) FILTER (price >= 10000 AND price < 50000) AS rank2_auctions, count(DISTINCT auction) FILTER (price >= 50000) AS rank3_auctions"""
_WINNING = "bid b JOIN auction a ON b.auction = a.id AND b.date_time BETWEEN a.date_time AND a.expires"
_EPOCH = "TIMESTAMP '1970-01-01'"
_Q8 = f"""SELECT P.id, P.name, P.s AS stime FROM (SELECT id, name, time_bucket({{span}}, date_time, {_EPOCH}) AS s FROM person GROUP BY ALL) P
JOIN (SELECT seller, time_bucket({{span}}, date_time, {_EPOCH}) AS s FROM auction GROUP BY ALL) A ON P.id = A.seller AND P.s = A.s"""
_Q21 = """SELECT auction, bidder, price, channel, CASE {names} ELSE regexp_extract(url, '(&|^)channel_id=([^&]*)', 2) END AS channel_id
FROM bid WHERE regexp_matches(url, '(&|^)channel_id=([^&]*)') OR lower(channel) IN ({some})"""
_Q23 = "SELECT B.auction, B.bidder, B.price, A.item_name, A.date_time AS opened, A.seller FROM bid B JOIN person P ON P.id = B.bidder JOIN auction A ON A.seller = B.bidder"

SQL = {
    "q0": "SELECT auction, bidder, price, date_time FROM bid",
    "q1": "SELECT auction, bidder, CAST(CAST(0.908 AS DECIMAL(3,3)) * price AS DECIMAL(23,3)) AS price, date_time FROM bid",
    "q2": "SELECT auction, price FROM bid WHERE auction % 123 = 0",
    "q3": "SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE a.category = 2 AND p.city IN ('BUILDING', 'MACHINERY')",
    "q4": f"SELECT category, CAST(sum(final) // count(final) AS BIGINT) AS final FROM (SELECT a.id, a.category, max(b.price) AS final FROM {_WINNING} GROUP BY 1, 2) GROUP BY category",
    "q5": f""", counts AS (SELECT auction, s AS window_start, count(*) AS num FROM (
  SELECT auction, unnest([time_bucket(INTERVAL 5 DAY, date_time, {_EPOCH}), time_bucket(INTERVAL 5 DAY, date_time, {_EPOCH}) - INTERVAL 5 DAY]) AS s FROM bid) GROUP BY 1, 2)
SELECT auction, num, window_start FROM counts c WHERE num >= (SELECT max(num) FROM counts m WHERE m.window_start = c.window_start)""",
    "q7": f"""SELECT b.auction, b.bidder, b.price, b.date_time, b.line, b.channel FROM bid b JOIN (
  SELECT max(price) AS max_price, time_bucket(INTERVAL 10 DAY, date_time, {_EPOCH}) + INTERVAL 10 DAY AS end_time FROM bid GROUP BY 2) t
ON b.price = t.max_price AND b.date_time BETWEEN t.end_time - INTERVAL 10 DAY AND t.end_time""",
    "q8": _Q8.format(span="INTERVAL 30 DAY"),
    "q9": f"""SELECT id, item_name, seller, category, auction, bidder, price, date_time FROM (
  SELECT a.id, a.item_name, a.seller, a.category, b.auction, b.bidder, b.price, b.date_time, row_number() OVER (PARTITION BY a.id ORDER BY b.price DESC, b.date_time, b.bidder, b.channel, b.url, b.line) AS r FROM {_WINNING}) WHERE r = 1""",
    "q10": "SELECT auction, bidder, price, date_time, strftime(date_time, '%Y-%m-%d') AS dt, strftime(date_time, '%H:%M') AS hm FROM bid",
    "q11": """, s AS (SELECT *, CASE WHEN date_time - lag(date_time) OVER (PARTITION BY bidder ORDER BY date_time) <= INTERVAL 10 DAY THEN 0 ELSE 1 END AS new FROM bid),
g AS (SELECT *, sum(new) OVER (PARTITION BY bidder ORDER BY date_time, new DESC ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT bidder, count(*) AS bid_count, min(date_time) AS window_start, max(date_time) + INTERVAL 10 DAY AS window_end FROM g GROUP BY bidder, g""",
    "q13": "SELECT auction, bidder, price, date_time, n_name AS value FROM bid JOIN nation ON auction % 25 = n_nationkey",
    "q14": """, h AS (SELECT *, CAST(CAST(0.908 AS DECIMAL(3,3)) * price AS DECIMAL(23,3)) AS p, hour(date_time + to_hours(bidder % 24)) AS h FROM bid)
SELECT auction, bidder, p AS price, CASE WHEN h >= 8 AND h <= 18 THEN 'dayTime' WHEN h <= 6 OR h >= 20 THEN 'nightTime' ELSE 'otherTime' END AS bid_time_type, date_time,
CAST(length(url) - length(replace(url, 'a', '')) AS BIGINT) AS c_counts FROM h WHERE p > 10000 AND p < 50000""",
    "q15": f"SELECT strftime(date_time, '%Y-%m') AS day, {_COUNTS} FROM bid GROUP BY 1",
    "q16": f"SELECT channel, strftime(date_time, '%Y-%m') AS day, max(strftime(date_time, '%H:%M')) AS minute, {_COUNTS} FROM bid GROUP BY 1, 2",
    "q17": """SELECT auction, strftime(date_time, '%Y-%m-%d') AS day, count(*) AS total_bids, count(*) FILTER (price < 10000) AS rank1_bids, count(*) FILTER (price >= 10000 AND price < 50000) AS rank2_bids,
count(*) FILTER (price >= 50000) AS rank3_bids, min(price) AS min_price, max(price) AS max_price, CAST(sum(price) // count(price) AS BIGINT) AS avg_price, CAST(sum(price) AS BIGINT) AS sum_price FROM bid GROUP BY 1, 2""",
    "q18": "SELECT auction, bidder, price, channel, url, date_time, line FROM (SELECT *, row_number() OVER (PARTITION BY bidder, auction ORDER BY date_time DESC, price DESC, channel DESC, url DESC, line DESC) AS r FROM bid) WHERE r = 1",
    "q19": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, date_time, bidder, channel, url, line) AS rank_number FROM bid) WHERE rank_number <= 10",
    "q20": "SELECT b.auction, b.bidder, b.price, b.channel, b.url, b.date_time, a.item_name, a.initial_bid, a.date_time AS opened, a.expires, a.seller, a.category FROM bid b JOIN auction a ON b.auction = a.id WHERE a.category = 5",
    "q21": _Q21.format(names="WHEN lower(channel) = 'channel-ro' THEN '0' WHEN lower(channel) = 'channel-af' THEN '1'", some="'channel-ro', 'channel-af'"),
    "q22": "SELECT auction, bidder, price, channel, split_part(url, '/', 4) AS dir1, split_part(url, '/', 5) AS dir2, split_part(url, '/', 6) AS dir3 FROM bid",
    "q23": _Q23,
}


# -- the suite's own events -------------------------------------------------------------------------------

#: The stream's states, start, rates, texts and price rule, which decide its rows.
STATES = ("OR", "ID", "CA", "WA", "NY", "TX")


#: Events of the queries over the suite's own stream.
EVENTS = 100_000


def event_stream(spark: SparkSession, n: int = EVENTS) -> DataFrame:
    """n deterministic events: in 50 there are 1 person, 3 auctions and 46 bids."""
    i = F.col("i")
    block, pos = F.floor(i / 50), F.pmod(i, F.lit(50))
    ms = F.lit(1_704_067_200_000) + block * 1000 + pos * 10
    time, text = F.timestamp_millis(ms), lambda head, x: F.concat(F.lit(head), x.cast("string"))
    state = F.get(F.array(*(F.lit(s) for s in STATES)), F.pmod(block, F.lit(6)).cast("int"))
    number = block * 3 + pos - 1
    target = block * 3 + F.pmod(pos, F.lit(3))
    a_person = F.struct(block.alias("id"), text("person-", block).alias("name"), F.concat(F.lit("p"), block.cast("string"), F.lit("@nexmark.test")).alias("email_address"), F.lit("1234-5678-9012-3456").alias("credit_card"), text("city-", F.pmod(block, F.lit(1000))).alias("city"), state.alias("state"), time.alias("date_time"), F.lit("pextra").alias("extra"))
    an_auction = F.struct(number.alias("id"), text("item-", number).alias("item_name"), text("desc-", number).alias("description"), F.lit(10).cast("bigint").alias("initial_bid"), F.lit(50).cast("bigint").alias("reserve"), time.alias("date_time"), F.timestamp_millis(ms + 20_000).alias("expires"), block.alias("seller"), F.pmod(block, F.lit(100)).alias("category"), F.lit("aextra").alias("extra"))
    a_bid = F.struct(target.alias("auction"), pos.alias("bidder"), (F.pmod(i, F.lit(1000)) + 1).alias("price"), text("channel-", F.pmod(pos, F.lit(8))).alias("channel"), text("https://nexmark.test/", target).alias("url"), time.alias("date_time"), F.lit("bextra").alias("extra"))
    return datagen(spark, n, {
        "seq": i, "event_type": F.when(pos == 0, 0).when(pos <= 3, 1).otherwise(2),
        "person": F.when(pos == 0, a_person), "auction": F.when((pos >= 1) & (pos <= 3), an_auction), "bid": F.when(pos > 3, a_bid), "date_time": time,
    })


def person_of(events: DataFrame) -> DataFrame:
    return events.where("event_type = 0").select("seq", "person.*")


def auction_of(events: DataFrame) -> DataFrame:
    return events.where("event_type = 1").select("seq", "auction.*")


def bid_of(events: DataFrame) -> DataFrame:
    return events.where("event_type = 2").select("seq", "bid.*")


def events_q8(spark, d):
    e = event_stream(spark)
    return _new_sellers(person_of(e), auction_of(e), 10_000)


def events_q21(spark, d):
    return _channel_ids(bid_of(event_stream(spark)), ("channel-4", "channel-5"))


def events_q23(spark, d):
    e = event_stream(spark)
    return _sold_by_bidders(bid_of(e), person_of(e), auction_of(e))


#: The same events' views in DuckDB SQL.
EVENT_VIEWS = f"""
WITH e AS (SELECT i // 50 AS block, i % 50 AS pos, i, make_timestamp((1704067200000 + (i // 50) * 1000 + (i % 50) * 10) * 1000) AS date_time FROM generate_series(0, {EVENTS - 1}) g(i)),
person AS (SELECT block AS id, 'person-' || block AS name, date_time FROM e WHERE pos = 0),
auction AS (SELECT block * 3 + pos - 1 AS id, 'item-' || (block * 3 + pos - 1) AS item_name, block AS seller, date_time FROM e WHERE pos BETWEEN 1 AND 3),
bid AS (SELECT block * 3 + pos % 3 AS auction, pos AS bidder, i % 1000 + 1 AS price, 'channel-' || (pos % 8) AS channel, 'https://nexmark.test/' || (block * 3 + pos % 3) AS url, date_time FROM e WHERE pos > 3)
"""
EVENT_SQL = {
    "events_q8": _Q8.format(span="INTERVAL 10 SECOND"),
    "events_q21": _Q21.format(names="WHEN lower(channel) = 'channel-4' THEN '0' WHEN lower(channel) = 'channel-5' THEN '1'", some="'channel-4', 'channel-5'"),
    "events_q23": _Q23,
}


def queries() -> dict:
    every = (q0, q1, q2, q3, q4, q5, q7, q8, q9, q10, q11, q12, q13, q14, q15, q16, q17, q18, q19, q20, q21, q22, q23, events_q8, events_q21, events_q23)
    return {f"nexmark_{f.__name__}": f for f in every}


def oracle_sql() -> dict[str, str]:
    return {f"nexmark_{k}": VIEWS + v for k, v in SQL.items()} | {f"nexmark_{k}": EVENT_VIEWS + v for k, v in EVENT_SQL.items()}
