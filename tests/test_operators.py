"""Operators on hand-checked fixtures."""

import datetime
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import calc, changelog, joins, over, rank, windows
from millrace.sources import files, formats
from millrace.types import DELETE, INSERT, ROW_KIND, UPDATE_AFTER, UPDATE_BEFORE


def timed(spark, data, schema, ms="ts"):
    df = spark.createDataFrame(data, schema)
    return df.withColumn(ms, F.timestamp_millis(ms).cast("timestamp_ntz"))


def ms(df, *columns):
    return df.select(*(F.unix_millis(F.col(c).cast("timestamp")).alias(c) if c.startswith(("w", "r_w")) else F.col(c) for c in columns))


def test_windows(spark):
    df = timed(spark, [(1, 0), (2, 500), (3, 600), (4, 1500), (5, 2500), (6, -1), (7, None)], "v long, ts long")
    assert rows(ms(windows.tumble_aggregate(df, "ts", 1000, [], F.sum("v").alias("s")), "window_start", "window_end", "s")) == [(-1000, 0, 6), (0, 1000, 6), (1000, 2000, 4), (2000, 3000, 5)]
    assert rows(ms(windows.aggregate(windows.hop(df, "ts", 2000, 1000), [], F.sum("v").alias("s")), "window_start", "window_end", "s")) == [(0, 1000, 6), (2000, 3000, 5)]
    hop = ms(windows.aggregate(windows.hop(df, "ts", 1000, 2000), [], F.sum("v").alias("s")), "window_start", "window_end", "s")
    sliced = ms(windows.hop_aggregate(df, "ts", 1000, 2000, [], {"p": F.sum("v")}, {"s": F.sum("p")}), "window_start", "window_end", "s")
    assert rows(hop) == rows(sliced) == [(-2000, 0, 6), (-1000, 1000, 12), (0, 2000, 10), (1000, 3000, 9), (2000, 4000, 5)]
    cumulate = ms(windows.aggregate(windows.cumulate(df, "ts", 1000, 3000), [], F.sum("v").alias("s")), "window_start", "window_end", "s")
    assert rows(cumulate) == [(-3000, 0, 6), (0, 1000, 6), (0, 2000, 10), (0, 3000, 15)]
    assert rows(windows.tumble(df, "ts", 1000).where("v = 1").select(F.unix_millis(F.col("window_time").cast("timestamp")))) == [(999,)]
    with pytest.raises(ValueError):
        windows.cumulate(df, "ts", 700, 1000)


def test_sessions_merge_at_the_gap(spark):
    df = timed(spark, [(1, 0), (2, 1500), (4, 700), (9, 5000), (3, 2500)], "v long, ts long")
    assert rows(ms(windows.session_aggregate(df, "ts", 1000, [], F.sum("v").alias("s")), "window_start", "window_end", "s")) == [(0, 3500, 10), (5000, 6000, 9)]


def test_top_n_and_dedup(spark):
    df = spark.createDataFrame([(1, 10, 300, 0), (2, 7, 500, 1), (1, 20, 200, 2), (1, 15, 250, 3), (2, 9, 500, 4), (1, 30, 100, 5)], "k long, v long, ts long, seq long")
    pick = lambda d: rows(d, "k", "v")
    assert pick(rank.dedup_first(df, ["k"], "ts", "seq")) == [(1, 30), (2, 7)]
    assert pick(rank.dedup_last(df, ["k"], "ts", "seq")) == [(1, 10), (2, 9)]
    assert pick(rank.dedup_arrival(df, ["k"], "seq")) == [(1, 10), (2, 7)]
    assert rows(rank.top_n(df, ["k"], [F.desc("v"), F.asc("seq")], 2, offset=1, rank="r"), "k", "v", "r") == [(1, 15, 3), (1, 20, 2), (2, 7, 2)]
    assert rows(calc.limit(df, [F.asc("seq")], 2, 1), "seq") == [(1,), (2,)]


def test_over(spark):
    df = timed(spark, [(1, 10, 1000), (2, 20, 1500), (1, 30, 2000), (2, 40, 2500), (1, 50, 3000), (1, 5, 3000)], "k long, v long, ts long")
    out = over.over(df, over.range_unbounded(["k"], "ts"), {"s": F.sum("v")})
    assert rows(out, "k", "v", "s") == [(1, 5, 95), (1, 10, 10), (1, 30, 40), (1, 50, 95), (2, 20, 20), (2, 40, 60)]
    out = over.over(df, over.range_interval(["k"], "ts", 1000), {"s": F.sum("v")})
    assert rows(out, "k", "v", "s") == [(1, 5, 85), (1, 10, 10), (1, 30, 40), (1, 50, 85), (2, 20, 20), (2, 40, 60)]


def test_unnest(spark):
    df = spark.createDataFrame([(1, [10, 20]), (2, []), (3, None), (4, [40, None])], "k long, vs array<long>")
    assert rows(calc.unnest_array(df, "vs", "v"), "k", "v") == [(1, 10), (1, 20), (4, None), (4, 40)]
    assert rows(calc.unnest_array(df, "vs", "v", left=True, ordinality="n"), "k", "v", "n") == [(1, 10, 1), (1, 20, 2), (2, None, None), (3, None, None), (4, None, 2), (4, 40, 1)]
    rs = spark.createDataFrame([(1, [(10, "x"), (20, "y")]), (2, [None, (30, "z")]), (3, [None])], "k long, rs array<struct<a:long,b:string>>")
    assert rows(calc.unnest_rows(rs, "rs", ordinality="n"), "k", "a", "b", "n") == [(1, 10, "x", 1), (1, 20, "y", 2), (2, 30, "z", 1)]
    assert rows(calc.unnest_rows(rs, "rs", left=True), "k", "a") == [(1, 10), (1, 20), (2, 30), (3, None)]
    bag = spark.createDataFrame([(1, {"a": 2, "b": 1})], "k long, m map<string,int>")
    assert rows(calc.unnest_multiset(bag, "m", "x", ordinality="n"), "x", "n") == [("a", 1), ("a", 2), ("b", 3)]


def test_regular_join_of_nulls_and_copies(spark):
    a = spark.createDataFrame([(1, 10), (1, 10), (2, 30), (None, 5)], "k long, v long")
    b = spark.createDataFrame([(1, 100), (3, 400), (None, 7)], "j long, w long")
    on = F.col("k") == F.col("j")
    assert rows(joins.regular(a, b, on, "full"), "v", "w") == [(None, 7), (None, 400), (5, None), (10, 100), (10, 100), (30, None)]
    assert rows(joins.regular(a, b, on, "anti"), "v") == [(5,), (30,)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_interval_join_equals_nested_loops(spark, how):
    rnd = random.Random(3)
    left = [(i, rnd.choice([1, 2, 3, None]), rnd.choice([None, *range(-50, 50)])) for i in range(60)]
    right = [(i, rnd.choice([1, 2, 4, None]), rnd.choice([None, *range(-50, 50)])) for i in range(60)]
    a, b = timed(spark, left, "i long, k long, t long", "t"), timed(spark, right, "j long, m long, u long", "u")
    got = rows(joins.interval(a, b, [("k", "m")], ("t", "u"), -7, 4, how), "i", "j")
    match = [(x, y) for x in left for y in right if None not in (x[1], x[2], y[2]) and x[1] == y[1] and -7 <= x[2] - y[2] <= 4]
    want = [(x[0], y[0]) for x, y in match]
    if how in ("left", "full"):
        want += [(x[0], None) for x in left if x not in [m[0] for m in match]]
    if how in ("right", "full"):
        want += [(None, y[0]) for y in right if y not in [m[1] for m in match]]
    assert Counter(got) == Counter(want)


def test_temporal_join(spark):
    probe = timed(spark, [("USD", 1, 150), ("EUR", 2, 250), ("GBP", 4, 260), ("USD", 3, 450), (None, 9, 450), ("USD", 5, 300)], "c string, amount long, t long", "t")
    rates = timed(spark, [("USD", 10, 100, 0, 0), ("EUR", 99, 100, 1, 0), ("USD", 20, 300, 2, 0), ("USD", 21, 300, 3, 0), ("EUR", 99, 200, 4, 3)], "cur string, rate long, u long, seq long, _row_kind byte", "u")
    args = (probe, rates, ("c", "cur"), ("t", "u"), "seq")
    assert rows(joins.temporal(*args, "left", segment_ms=70), "amount", "rate") == rows(joins.temporal(*args, "left"), "amount", "rate")
    assert rows(joins.temporal(*args), "amount", "rate") == [(1, 10), (3, 21), (5, 21)]
    assert rows(joins.temporal(*args, "left", F.col("rate") > 10), "amount", "rate") == [(1, None), (2, None), (3, 21), (4, None), (5, 21), (9, None)]


def test_normalize_and_collapse(spark):
    data = [(0, INSERT, 1, 10), (1, UPDATE_AFTER, 1, 20), (2, INSERT, 2, 5), (3, UPDATE_AFTER, 2, 5), (4, DELETE, 1, 20), (5, INSERT, 3, 7), (6, DELETE, 9, 1)]
    df = spark.createDataFrame(data, f"seq long, {ROW_KIND} byte, f0 long, f1 long")
    out = changelog.normalize(df, ["f0"], "seq")
    assert [tuple(r) for r in out.orderBy("seq", "change").select(ROW_KIND, "f0", "f1").collect()] == [(INSERT, 1, 10), (UPDATE_BEFORE, 1, 10), (UPDATE_AFTER, 1, 20), (INSERT, 2, 5), (DELETE, 1, 20), (INSERT, 3, 7)]
    assert rows(changelog.collapse(out.drop("seq", "change"))) == [(2, 5), (3, 7)] == rows(changelog.latest(df, ["f0"], "seq").select("f0", "f1"))
    with pytest.raises(ValueError):
        changelog.insert_only(df)


def test_empty_inputs(spark):
    df = timed(spark, [], "k long, v long, ts long, seq long")
    assert rank.dedup_last(df, ["k"], "ts", "seq").count() == 0
    assert windows.session_aggregate(df, "ts", 1000, ["k"], F.count("v").alias("n")).count() == 0
    assert changelog.collapse(changelog.tag(df)).count() == 0


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


def test_cdc(spark):
    put = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    bez = put('{"op":"c","after":{"id":1,"t":"a"}}', '{"op":"u","before":{"id":1,"t":"a"},"after":{"id":1,"t":null}}', '{"op":"d","before":{"id":1,"t":null}}', None)
    want = [(0, 1, "a"), (1, 1, "a"), (2, 1, None), (3, 1, None)]
    assert rows(formats.debezium_decode(bez, "value", ROW)) == want
    ogg = put('{"op_type":"I","after":{"id":1,"t":"a"}}', '{"op_type":"U","before":{"id":1,"t":"a"},"after":{"id":1}}', '{"op_type":"D","before":{"id":1}}')
    assert rows(formats.ogg_decode(ogg, "value", ROW)) == want
    wells = put('{"type":"insert","data":{"id":1,"t":"a"}}', '{"type":"update","data":{"id":1,"t":null},"old":{"t":"a"}}', '{"type":"delete","data":{"id":1,"t":null}}')
    assert rows(formats.maxwell_decode(wells, "value", ROW)) == want
    canal = put('{"type":"INSERT","data":[{"id":1,"t":"a"}]}', '{"type":"UPDATE","data":[{"id":1,"t":null}],"old":[{"t":"a"}]}', '{"type":"DELETE","data":[{"id":1,"t":null}]}')
    assert rows(formats.canal_decode(canal, "value", ROW)) == want
    back = formats.debezium_encode(formats.debezium_decode(bez, "value", ROW), ["id", "t"])
    assert rows(changelog.collapse(formats.debezium_decode(back, "value", ROW))) == []


def test_old_names_a_null_field(spark):
    df = spark.createDataFrame([('{"type":"update","data":{"id":1,"t":"b"},"old":{"t":null}}',)], "value string")
    assert rows(formats.maxwell_decode(df, "value", ROW)) == [(1, 1, None), (2, 1, "b")]


def test_json_csv_raw(spark):
    df = spark.createDataFrame([('[{"id":1,"t":"a"},{"id":2}]',), ('{"id":3,"t":"c"}',)], "value string")
    assert rows(formats.json_rows(df, "value", ROW)) == [(1, "a"), (2, None), (3, "c")]
    bad = spark.createDataFrame([('{"id":"x","t":"a"}',)], "value string")
    assert bad.select(formats.json_decode("value", ROW, lenient=True)["t"]).first()[0] == "a"
    with pytest.raises(Exception):
        bad.select(formats.json_decode("value", ROW)).collect()
    row = spark.createDataFrame([(1, 'a;"b"'), (2, None)], ROW)
    wire = row.select(formats.csv_encode(["id", "t"], delimiter=";", null_literal="~").alias("v"))
    assert rows(wire.select(formats.csv_decode("v", ROW, delimiter=";", null_literal="~").alias("r")).select("r.*")) == [(1, 'a;"b"'), (2, None)]
    n = spark.createDataFrame([(-2, 1.5)], "a int, d double")
    for little in (False, True):
        out = n.select(formats.raw_encode("a", "int", little_endian=little).alias("x"), formats.raw_encode("d", "double", little_endian=little).alias("y"))
        assert bytes(out.first()["x"]) == (-2).to_bytes(4, "little" if little else "big", signed=True)
        assert tuple(out.select(formats.raw_decode("x", "int", little_endian=little), formats.raw_decode("y", "double", little_endian=little)).first()) == (-2, 1.5)
    with pytest.raises(Exception, match="expected 4 bytes"):
        spark.range(1).select(formats.raw_decode(F.unhex(F.lit("00")), "int")).collect()
    keyed = changelog.tag(row, F.when(F.col("id") == 2, DELETE).otherwise(INSERT))
    assert rows(formats.upsert_encode(keyed, ["id"], ["id", "t"])) == [('{"id":1}', '{"id":1,"t":"a;\\"b\\""}'), ('{"id":2}', None)]


def test_snapshot_upserts(spark, tmp_path):
    table = files.Snapshot(spark, str(tmp_path / "t"), ["id"], ROW, buckets=4)
    assert table.read().count() == 0
    change = lambda *r: spark.createDataFrame(list(r), f"id long, t string, {ROW_KIND} byte, seq long")
    assert table.upsert(change((1, "a", 0, 0), (2, "b", 0, 1), (3, "c", 0, 2)), "seq") == 1
    assert table.upsert(change((2, "b2", 2, 3), (3, "c", 3, 4), (1, "a", 1, 5), (1, "a2", 2, 6)), "seq") == 2
    assert rows(table.read()) == [(1, "a2"), (2, "b2")] and rows(table.read(1)) == [(1, "a"), (2, "b"), (3, "c")]


def test_nexmark_events(spark):
    from millrace.plans import nexmark

    e = nexmark.event_stream(spark, 100)
    assert (nexmark.person_of(e).count(), nexmark.auction_of(e).count(), nexmark.bid_of(e).count()) == (2, 6, 92)
    first = nexmark.auction_of(e).orderBy("seq").first()
    assert (first["id"], first["seller"], first["date_time"]) == (0, 0, datetime.datetime(2024, 1, 1, 0, 0, 0, 10000))


def test_whole_queries_leave_no_customer_or_bid_out(spark, sf):
    from millrace.plans import catalog

    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    made = {k: catalog.queries()[k](spark, sf) for k in ("join_inner", "join_semi", "join_residual", "join_anti", "nexmark_q21")}
    assert made["join_inner"].count() == made["join_semi"].count() == made["join_residual"].count() == n
    assert 0 < made["join_anti"].count() < n
    assert made["nexmark_q21"].count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_every_line_item_is_unnested(spark, sf):
    from millrace.plans import catalog

    want = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.sum("l_linenumber")).first()[0]
    assert catalog.queries()["unnest_multiset"](spark, sf).count() == want


def test_range_interval_query_rounds_times_as_its_sql(spark, tmp_path):
    """Times within a millisecond of the frame's edge, before and after 1970, and NULL ones."""
    import duckdb

    from millrace.plans import catalog

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, CASE WHEN i % 45 <> 44 THEN make_timestamp((i % 5 - 2) * 7200000000 + (i * 100) % 4500 - 2000) END AS ts, CASE WHEN i % 4 > 0 THEN i % 4 END AS user_id, 'view' AS event_type, i * i / 8 AS value, NULL::VARCHAR AS props
FROM range(600) t(i)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = rows(catalog.queries()["over_range_interval"](spark, str(tmp_path)), "event_id", "s", "hi")
    assert got == sorted(con.execute(catalog.oracle_sql()["over_range_interval"]).fetchall())
