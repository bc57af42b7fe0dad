"""Streaming queries, each run to the end of the event stream; their results equal the bounded queries'."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import aggregates as A
from millrace.operators import changelog, windows
from millrace.streaming import processors as P
from millrace.streaming.runner import END, events_stream, finish, keyed, ntz, time_sort
from millrace.types import ROW_KIND

HOUR = 3_600_000
E = "WITH e AS (SELECT event_id, ts, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS v FROM events) "
_EPOCH = "TIMESTAMP '1970-01-01'"
_LONG, _TEXT = T.LongType(), T.StringType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _changes(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(ROW_KIND, T.ByteType()), *_schema(**fields)])


def _events(s, d, end=True):
    rows = events_stream(s, d, end=end)
    return rows.select("event_id", "ts", "user_id", "event_type", F.floor(F.col("value") * 100).cast("bigint").alias("v"))


def _bounded(df, time="window_start"):
    return ntz(df.where(F.col(time) < F.lit(END).cast("timestamp")))


def stream_filter(s, d):
    return finish(_events(s, d, end=False).where("v > 5000").select("event_id", "v"))


def stream_tumble(s, d):
    agg = windows.tumble_aggregate(_events(s, d), "ts", HOUR, ["event_type"], A.count().alias("n"), F.sum("v").alias("s"))
    return _bounded(finish(agg))


def stream_hop(s, d):
    agg = windows.hop_aggregate_rows(_events(s, d), "ts", 6 * HOUR, 12 * HOUR, ["event_type"], A.count().alias("n"))
    return _bounded(finish(agg)).where(F.col("window_end") < F.lit(END).cast("timestamp_ntz"))


def stream_session(s, d):
    return _bounded(finish(windows.session_aggregate(_events(s, d), "ts", HOUR // 2, ["user_id"], A.count().alias("n"), F.sum("v").alias("s"))))


def _click_and_purchase(s, d):
    """Both sides; the last row's user is no NULL, lest the planner drop that row before it moves the watermark."""
    a = _events(s, d).where("event_type = 'click' OR event_type IS NULL").select(F.col("event_id").alias("lid"), F.coalesce("user_id", F.lit(-1)).alias("lu"), F.col("ts").alias("lts"))
    return a, _events(s, d).where("event_type = 'purchase' OR event_type IS NULL").select(F.col("event_id").alias("rid"), F.coalesce("user_id", F.lit(-2)).alias("ru"), F.col("ts").alias("rts"))


def _interval_join(s, d, how):
    a, b = _click_and_purchase(s, d)
    on = (F.col("lu") == F.col("ru")) & (F.col("lts") >= F.col("rts") - F.expr("INTERVAL 10 HOURS")) & (F.col("lts") <= F.col("rts") + F.expr("INTERVAL 5 HOURS"))
    return ntz(finish(a.join(b, on, how)).where(F.col("lid").isNotNull() | F.col("rid").isNotNull()))


def stream_interval_join(s, d):
    return _interval_join(s, d, "inner")


def stream_interval_join_left(s, d):
    return _interval_join(s, d, "left")


def stream_interval_join_right(s, d):
    return _interval_join(s, d, "right")


def stream_interval_join_full(s, d):
    return _interval_join(s, d, "full")


def stream_window_join(s, d):
    a, b = _click_and_purchase(s, d)
    a, b = a.withColumn("w", F.window("lts", "6 hours")), b.withColumn("rw", F.window("rts", "6 hours"))
    both = a.join(b, (F.col("lu") == F.col("ru")) & (F.col("w") == F.col("rw")))
    return ntz(finish(both.select("lid", "rid", "lu", F.col("w.start").alias("window_start"))).where(F.col("lid").isNotNull()))


def stream_cumulate(s, d):
    """Steps are summed on the stream, and each closed step is then repeated for the windows that hold it."""
    steps = windows.tumble_aggregate(_events(s, d), "ts", 2 * HOUR, ["event_type"], A.count().alias("n"), F.sum("v").alias("s"))
    closed = _bounded(finish(steps)).drop("window_end").withColumnRenamed("window_start", "step")
    return windows.aggregate(windows.cumulate(closed, "step", 2 * HOUR, 6 * HOUR), ["event_type"], F.sum("n").alias("n"), F.sum("s").alias("s"))


def stream_lookup_join(s, d):
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    e = _events(s, d, end=False)
    return finish(e.join(n, e["user_id"] % 25 == n["k"]).select("event_id", "n_name"))


def stream_dedup_first(s, d):
    return finish(_events(s, d, end=False).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"))


def stream_group_agg_changelog(s, d):
    agg = P.GroupAggregate(["user_id"], [("count", None), ("sum", "v"), ("avg", "v"), ("max", "v"), ("count_distinct", "event_type")], ["n", "s", "a", "hi", "kinds"], "event_id")
    out = keyed(_events(s, d, end=False), ["user_id"], agg, _changes(user_id=_LONG, n=_LONG, s=_LONG, a=_LONG, hi=_LONG, kinds=_LONG))
    return changelog.collapse(finish(out, "update"))


def stream_topn(s, d):
    top = P.TopN([("v", False), ("event_id", True)], 5, ["user_id", "event_id", "v"], "event_id", rank="r")
    return changelog.collapse(finish(keyed(_events(s, d, end=False), ["user_id"], top, _changes(user_id=_LONG, event_id=_LONG, v=_LONG, r=_LONG)), "update"))


def stream_dedup_last(s, d):
    last = P.KeepLast("ts", ["user_id", "event_id", "v"], "event_id")
    return changelog.collapse(finish(keyed(_events(s, d, end=False), ["user_id"], last, _changes(user_id=_LONG, event_id=_LONG, v=_LONG)), "update"))


def stream_normalize(s, d):
    kind = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "error", 3).otherwise(2).cast("tinyint")
    rows = _events(s, d, end=False).select("event_id", "user_id", F.pmod("v", F.lit(50)).alias("v"), kind.alias(ROW_KIND))
    return changelog.collapse(finish(keyed(rows, ["user_id"], P.Normalize("event_id", ["user_id", "v"]), _changes(user_id=_LONG, v=_LONG)), "update"))


def stream_over(s, d):
    over = P.Over("v", ["event_id"], "event_id", rows=3)
    return finish(keyed(_events(s, d, end=False), ["user_id"], over, _changes(event_id=_LONG, s=_LONG, n=_LONG)), "update").drop(ROW_KIND)


def stream_updating_join(s, d):
    side = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1)
    rows = _events(s, d, end=False).where(side.isNotNull()).select(side.alias("_side"), F.col("user_id").alias("k"), "event_id", F.col("event_id").alias("lid"), F.col("event_id").alias("rid"))
    out = keyed(rows, ["k"], P.UpdatingJoin(["lid"], ["rid"], "full", "event_id"), _changes(lid=_LONG, rid=_LONG))
    return changelog.collapse(finish(out, "update"))


def _retracting_join(s, d, how):
    """Clicks and errors with NULL keys and NULL values; a third of each side is removed again after all have come."""
    e = _events(s, d, end=False).where("event_type IN ('click', 'error')")
    left, key = F.col("event_type") == "click", F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
    rows = e.select(F.when(left, 0).otherwise(1).alias("_side"), key.alias("k"), "event_id", "v", F.when(left, F.col("event_id")).alias("lid"), F.when(left & (F.col("v") % 5 != 0), F.col("v")).alias("lv"), F.when(~left, F.col("event_id")).alias("rid"))
    put = F.struct(F.lit(0).cast("tinyint").alias("kind"), F.col("event_id").alias("seq"))
    gone = F.struct(F.lit(3).cast("tinyint").alias("kind"), (F.col("event_id") + F.lit(1 << 60)).alias("seq"))
    rows = rows.select("*", F.explode(F.when(F.col("v") % 3 == 0, F.array(put, gone)).otherwise(F.array(put))).alias("c"))
    rows = rows.select("_side", "k", "lid", "lv", "rid", F.col("c.kind").alias(ROW_KIND), F.col("c.seq").alias("seq"))
    fields = {"lid": _LONG, "lv": _LONG} | ({} if how in ("semi", "anti") else {"rid": _LONG})
    return changelog.collapse(finish(keyed(rows, ["k"], P.UpdatingJoin(["lid", "lv"], ["rid"], how, "seq"), _changes(**fields)), "update"))


def stream_join_left(s, d):
    return _retracting_join(s, d, "left")


def stream_join_right(s, d):
    return _retracting_join(s, d, "right")


def stream_join_semi(s, d):
    return _retracting_join(s, d, "semi")


def stream_join_anti(s, d):
    return _retracting_join(s, d, "anti")


def stream_over_range(s, d):
    """RANGE of a day before each event, and everything before it."""
    rows = _events(s, d, end=False).withColumn("ms", F.unix_millis("ts"))
    aggregates = [("sum", "s"), ("count", "n"), ("min", "lo"), ("max", "hi"), ("first_value", "fv"), ("last_value", "lv"), ("count_distinct", "dv")]
    over = P.Over("v", ["event_id"], "event_id", interval=24 * HOUR, time="ms", aggregates=aggregates)
    return finish(keyed(rows, ["user_id"], over, _changes(event_id=_LONG, **{n: _LONG for _, n in aggregates})), "update").drop(ROW_KIND)


def stream_over_unbounded(s, d):
    aggregates = [("sum", "s"), ("min", "lo"), ("max", "hi"), ("first_value", "fv"), ("count_distinct", "dv")]
    over = P.Over("v", ["event_id"], "event_id", aggregates=aggregates)
    return finish(keyed(_events(s, d, end=False), ["user_id"], over, _changes(event_id=_LONG, **{n: _LONG for _, n in aggregates})), "update").drop(ROW_KIND)


def stream_topn_text(s, d):
    """Descending by text, then ascending by number."""
    top = P.TopN([("event_type", False), ("event_id", True)], 3, ["user_id", "event_type", "event_id"], "event_id", rank="r")
    return changelog.collapse(finish(keyed(_events(s, d, end=False), ["user_id"], top, _changes(user_id=_LONG, event_type=_TEXT, event_id=_LONG, r=_LONG)), "update"))


def stream_temporal_join(s, d):
    e = _events(s, d)
    side = F.when(F.col("event_type") == "purchase", 1).otherwise(0)
    kind = F.when(F.col("event_type") == "error", 3).otherwise(0).cast("tinyint")
    rows = e.where("event_type <> 'click' OR event_type IS NULL").select(
        F.coalesce("user_id", F.lit(-1)).alias("user_id"), "ts", F.unix_millis("ts").alias("_ms"), side.alias("_side"), kind.alias(ROW_KIND), F.coalesce("event_id", F.lit(-1)).alias("event_id"), "v", F.col("v").alias("rate")
    )
    out = keyed(rows, ["user_id"], P.TemporalJoin(["event_id", "v"], ["rate"], "left", "event_id"), _schema(event_id=_LONG, v=_LONG, rate=_LONG), mode="Append", time="EventTime")
    return finish(out).where("event_id >= 0")


def stream_sort(s, d):
    """The last row stays behind, as no watermark passes it."""
    return time_sort(_events(s, d).select("ts", "event_id", "v"), "ts", "event_id").drop("ts")


_BUCKET = f"time_bucket(INTERVAL 1 HOUR, ts, {_EPOCH})"
SQL = {
    "stream_filter": E + "SELECT event_id, v FROM e WHERE v > 5000",
    "stream_tumble": E + f"SELECT {_BUCKET} AS window_start, {_BUCKET} + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM e GROUP BY ALL",
    "stream_hop": E + f"SELECT w AS window_start, w + INTERVAL 12 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts, {_EPOCH}), time_bucket(INTERVAL 6 HOUR, ts, {_EPOCH}) - INTERVAL 6 HOUR]) AS w FROM e) GROUP BY ALL",
    "stream_session": E + """, x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM x)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM g GROUP BY user_id, g""",
    "stream_interval_join": """SELECT l.event_id AS lid, l.user_id AS lu, l.ts AS lts, r.event_id AS rid, r.user_id AS ru, r.ts AS rts FROM events l JOIN events r
ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'purchase' AND l.ts BETWEEN r.ts - INTERVAL 10 HOUR AND r.ts + INTERVAL 5 HOUR""",
    **{f"stream_interval_join_{h}": f"""SELECT l.event_id AS lid, l.user_id AS lu, l.ts AS lts, r.event_id AS rid, r.user_id AS ru, r.ts AS rts FROM (SELECT * FROM events WHERE event_type = 'click') l {h.upper()} JOIN (SELECT * FROM events WHERE event_type = 'purchase') r
ON l.user_id = r.user_id AND l.ts BETWEEN r.ts - INTERVAL 10 HOUR AND r.ts + INTERVAL 5 HOUR""" for h in ("left", "right", "full")},
    "stream_window_join": f"""SELECT l.event_id AS lid, r.event_id AS rid, l.user_id AS lu, time_bucket(INTERVAL 6 HOUR, l.ts, {_EPOCH}) AS window_start FROM events l JOIN events r
ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'purchase' AND time_bucket(INTERVAL 6 HOUR, l.ts, {_EPOCH}) = time_bucket(INTERVAL 6 HOUR, r.ts, {_EPOCH})""",
    "stream_cumulate": E + f"""SELECT w AS window_start, w + to_hours(CAST(k * 2 AS INTEGER)) AS window_end, event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS s
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, {_EPOCH}) AS w FROM e), generate_series(1, 3) g(k) WHERE ts < w + to_hours(CAST(k * 2 AS INTEGER)) GROUP BY ALL""",
    **{f"stream_join_{h}": E + f"""SELECT {"l.lid, l.lv" if h in ("semi", "anti") else "l.lid, l.lv, r.rid"} FROM (SELECT nullif(user_id, CASE WHEN user_id % 10 = 0 THEN user_id END) AS k, event_id AS lid, CASE WHEN v % 5 <> 0 THEN v END AS lv FROM e WHERE event_type = 'click' AND v % 3 <> 0) l
{h.upper()} JOIN (SELECT nullif(user_id, CASE WHEN user_id % 10 = 0 THEN user_id END) AS k, event_id AS rid FROM e WHERE event_type = 'error' AND v % 3 <> 0) r ON l.k = r.k""" for h in ("left", "right", "semi", "anti")},
    "stream_over_range": E + """SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS s, count(v) OVER w AS n, min(v) OVER w AS lo, max(v) OVER w AS hi, first_value(v) OVER w AS fv, last_value(v) OVER w AS lv, count(DISTINCT v) OVER w AS dv
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""",
    "stream_over_unbounded": E + """SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS s, min(v) OVER w AS lo, max(v) OVER w AS hi, first_value(v) OVER w AS fv, count(DISTINCT v) OVER w AS dv
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
    "stream_topn_text": E + "SELECT user_id, event_type, event_id, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type DESC, event_id) AS r FROM e) WHERE r <= 3",
    "stream_lookup_join": "SELECT event_id, n_name FROM events JOIN nation ON user_id % 25 = n_nationkey",
    "stream_dedup_first": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_group_agg_changelog": E + "SELECT user_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v) // count(v) AS BIGINT) AS a, max(v) AS hi, count(DISTINCT event_type) AS kinds FROM e GROUP BY user_id",
    "stream_topn": E + "SELECT user_id, event_id, v, r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_id) AS r FROM e) WHERE r <= 5",
    "stream_dedup_last": E + "SELECT user_id, event_id, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM e) WHERE r = 1",
    "stream_normalize": E + "SELECT user_id, v FROM (SELECT user_id, event_type, ((v % 50) + 50) % 50 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM e) WHERE r = 1 AND event_type <> 'error'",
    "stream_over": E + "SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS s, count(v) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
    "stream_updating_join": "SELECT l.event_id AS lid, r.event_id AS rid FROM (SELECT * FROM events WHERE event_type = 'click') l FULL JOIN (SELECT * FROM events WHERE event_type = 'error') r ON l.user_id = r.user_id",
    "stream_temporal_join": E + """SELECT p.event_id, p.v, CASE WHEN r.event_type <> 'error' THEN r.v END AS rate FROM (SELECT * FROM e WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM e WHERE event_type NOT IN ('purchase', 'click')) r ON p.user_id = r.user_id AND p.ts >= r.ts""",
    "stream_sort": E + "SELECT event_id, v FROM e",
}


def queries() -> dict:
    return {f.__name__: f for f in (stream_filter, stream_tumble, stream_hop, stream_session, stream_interval_join, stream_lookup_join, stream_dedup_first, stream_group_agg_changelog, stream_topn, stream_dedup_last, stream_normalize, stream_over, stream_updating_join, stream_temporal_join, stream_sort, stream_interval_join_left, stream_interval_join_right, stream_interval_join_full, stream_window_join, stream_cumulate, stream_join_left, stream_join_right, stream_join_semi, stream_join_anti, stream_over_range, stream_over_unbounded, stream_topn_text)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
