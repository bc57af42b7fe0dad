"""Streams equal batches however they are cut into micro-batches, and changelogs have the right kinds."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import changelog, joins, rank
from millrace.streaming import processors as P
from millrace.streaming.runner import finish, keyed
from millrace.types import DELETE, INSERT, ROW_KIND, UPDATE_AFTER, UPDATE_BEFORE

LONG = T.LongType()


def stream(spark, path, data, schema, cuts):
    """The rows as ``cuts`` files, one per micro-batch."""
    size = -(-len(data) // cuts)
    for i in range(cuts):
        spark.createDataFrame(data[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def changes(**fields):
    return T.StructType([T.StructField(ROW_KIND, T.ByteType()), *(T.StructField(k, v) for k, v in fields.items())])


def history(n, seed):
    """Random inserts and deletes of live rows."""
    rnd, live, out = random.Random(seed), [], []
    for i in range(n):
        if live and rnd.random() < 0.4:
            k, v = live.pop(rnd.randrange(len(live)))
            out.append((i, k, v, DELETE))
        else:
            k, v = rnd.randrange(3), rnd.randrange(5)
            live.append((k, v))
            out.append((i, k, v, INSERT))
    return out, live


SCHEMA = f"seq long, k long, v long, {ROW_KIND} byte"


@pytest.mark.parametrize("cuts", [1, 3])
def test_group_aggregate_with_removals(spark, tmp_path, cuts):
    data, live = history(40, cuts)
    agg = P.GroupAggregate(["k"], [("count", None), ("sum", "v"), ("min", "v"), ("count_distinct", "v")], ["n", "s", "lo", "d"], "seq")
    out = finish(keyed(stream(spark, tmp_path / "in", data, SCHEMA, cuts), ["k"], agg, changes(k=LONG, n=LONG, s=LONG, lo=LONG, d=LONG)), "update")
    want = []
    for k in sorted({k for k, _ in live}):
        vs = [v for j, v in live if j == k]
        want.append((k, len(vs), sum(vs), min(vs), len(set(vs))))
    assert rows(changelog.collapse(out)) == want


@pytest.mark.parametrize("cuts", [1, 3])
def test_top_n_with_removals(spark, tmp_path, cuts):
    data, live = history(40, 7 + cuts)
    top = P.TopN([("v", False)], 2, ["k", "v"], "seq", rank="r", retract=True)
    out = finish(keyed(stream(spark, tmp_path / "in", data, SCHEMA, cuts), ["k"], top, changes(k=LONG, v=LONG, r=LONG)), "update")
    want = [(k, v, i + 1) for k in range(3) for i, v in enumerate(sorted((v for j, v in live if j == k), reverse=True)[:2])]
    assert rows(changelog.collapse(out)) == sorted(want)


@pytest.mark.parametrize("how", ["inner", "full", "semi", "anti"])
def test_updating_join(spark, tmp_path, how):
    data, _ = history(50, 5)
    rnd = random.Random(1)
    sided = []
    live = [[], []]
    for seq, k, v, kind in data:  # removals go to the side that holds the row
        side = rnd.randrange(2) if kind == INSERT else next(s for s in (0, 1) if (k, v) in live[s])
        (live[side].append if kind == INSERT else live[side].remove)((k, v))
        sided.append((seq, k, v, v, side, kind))
    join = P.UpdatingJoin(["k", "v"], ["w"], how, "seq")
    schema = f"seq long, k long, v long, w long, _side int, {ROW_KIND} byte"
    fields = {"k": LONG, "v": LONG} if how in ("semi", "anti") else {"k": LONG, "v": LONG, "w": LONG}
    out = finish(keyed(stream(spark, tmp_path / "in", sided, schema, 3), ["k"], join, changes(**fields)), "update")
    a, b = spark.createDataFrame(live[0], "k long, v long"), spark.createDataFrame(live[1], "j long, w long")
    want = joins.regular(a, b, F.col("k") == F.col("j"), how).drop("j")
    assert rows(changelog.collapse(out)) == rows(want)


def test_kinds_of_one_key(spark, tmp_path):
    data = [(0, 7, 1, INSERT), (1, 7, 2, INSERT), (2, 7, 0, INSERT)]
    agg = P.GroupAggregate(["k"], [("sum", "v")], ["s"], "seq")
    out = finish(keyed(stream(spark, tmp_path / "in", data, SCHEMA, 3), ["k"], agg, changes(k=LONG, s=LONG)), "update")
    assert rows(out) == [(INSERT, 7, 1), (UPDATE_BEFORE, 7, 1), (UPDATE_AFTER, 7, 3)]  # the 0 changes nothing


def test_keep_last_ties_go_to_the_later(spark, tmp_path):
    data = [(0, 1, 300, 10), (1, 2, 500, 7), (2, 1, 200, 20), (3, 2, 500, 9)]
    last = P.KeepLast("t", ["k", "v"], "seq")
    out = finish(keyed(stream(spark, tmp_path / "in", data, "seq long, k long, t long, v long", 2), ["k"], last, changes(k=LONG, v=LONG)), "update")
    batch = rank.dedup_last(spark.createDataFrame(data, "seq long, k long, t long, v long"), ["k"], "t", "seq")
    assert rows(changelog.collapse(out)) == rows(batch, "k", "v") == [(1, 10), (2, 9)]


def test_updating_join_query_joins_every_click_and_error(spark, sf):
    from millrace.streaming import catalog

    got = rows(catalog.queries()["stream_updating_join"](spark, sf))
    events = [(r.event_id, r.event_type) for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    assert {i for i, _ in got if i is not None} == {i for i, t in events if t == "click"}
    assert {i for _, i in got if i is not None} == {i for i, t in events if t == "error"}


def side_rows(spark, path, batches):
    """One micro-batch for each list of (seq, side, k, left, right, kind)."""
    schema = f"seq long, _side int, k long, a long, b long, {ROW_KIND} byte"
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_no_ghosts_beside_nulls(spark, tmp_path):
    batches = [[(0, 0, 1, 5, None, INSERT), (1, 1, 2, None, 7, INSERT)], [(2, 0, 1, 5, None, DELETE)], [(3, 1, 1, None, 8, INSERT)]]
    out = finish(keyed(side_rows(spark, tmp_path / "in", batches), ["k"], P.UpdatingJoin(["a"], ["b"], "inner", "seq"), changes(a=LONG, b=LONG)), "update")
    assert rows(out) == []


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_padding_over_batches(spark, tmp_path, how):
    batches = [[(0, 0, 1, None, None, INSERT), (1, 0, None, 3, None, INSERT), (2, 0, 1, 2**53 + 1, None, INSERT)], [(3, 1, 1, None, 8, INSERT), (4, 1, 5, None, 9, INSERT)], [(5, 0, 1, None, None, DELETE), (6, 1, 1, None, 8, DELETE)]]
    out = finish(keyed(side_rows(spark, tmp_path / "in", batches), ["k"], P.UpdatingJoin(["a"], ["b"], how, "seq"), changes(a=LONG, b=LONG)), "update")
    want = [(2**53 + 1, None), (3, None)] * (how != "right") + [(None, 9)] * (how != "left")
    assert rows(changelog.collapse(out)) == sorted(want, key=lambda r: [(x is not None, x or 0) for x in r])


def test_big_integers_beside_nulls_and_nan(spark, tmp_path):
    big = 9007199254740993
    data = [(0, 1, big, float("nan"), INSERT), (1, 1, None, None, INSERT), (2, 2, None, 1.5, INSERT)]
    source = stream(spark, tmp_path / "in", data, f"seq long, k long, v long, x double, {ROW_KIND} byte", 1)
    agg = P.GroupAggregate(["k"], [("sum", "v"), ("max", "v"), ("count", "x")], ["s", "hi", "n"], "seq")
    assert rows(finish(keyed(source, ["k"], agg, changes(k=LONG, s=LONG, hi=LONG, n=LONG)), "update"), "k", "s", "hi", "n") == [(1, big, big, 1), (2, None, None, 1)]


def test_extremes_come_back(spark, tmp_path):
    data = [(0, 1, 5, INSERT), (1, 1, 9, INSERT), (2, 1, 9, INSERT), (3, 1, 9, DELETE), (4, 1, 9, DELETE), (5, 1, 5, DELETE)]
    agg = P.GroupAggregate(["k"], [("max", "v"), ("min", "v"), ("sum_distinct", "v")], ["hi", "lo", "s"], "seq")
    out = finish(keyed(stream(spark, tmp_path / "in", data, SCHEMA, 6), ["k"], agg, changes(k=LONG, hi=LONG, lo=LONG, s=LONG)), "update")
    moves = sorted((r[ROW_KIND], r.hi, r.lo, r.s) for r in out.collect())
    assert moves == [(INSERT, 5, 5, 5), (UPDATE_BEFORE, 5, 5, 5), (UPDATE_BEFORE, 9, 5, 14), (UPDATE_AFTER, 5, 5, 5), (UPDATE_AFTER, 9, 5, 14), (DELETE, 5, 5, 5)]


def test_descending_text_with_nulls(spark, tmp_path):
    data = [(0, 1, "a"), (1, 1, None), (2, 1, "c"), (3, 1, "b")]
    top = P.TopN([("t", False)], 3, ["k", "t"], "seq", rank="r")
    out = finish(keyed(stream(spark, tmp_path / "in", data, "seq long, k long, t string", 2), ["k"], top, changes(k=LONG, t=T.StringType(), r=LONG)), "update")
    assert [t for _, t, _ in sorted(rows(changelog.collapse(out), "k", "t", "r"), key=lambda r: r[2])] == ["c", "b", "a"]


def test_late_rows_are_dropped(spark, tmp_path):
    from millrace.operators import windows

    data = [(0, "2024-01-01 00:00:10"), (1, "2024-01-01 02:00:00"), (4, "2024-01-01 02:10:00"), (2, "2024-01-01 00:00:20"), (3, "2024-01-01 05:00:00")]
    schema = "seq long, at string"
    source = stream(spark, tmp_path / "in", data, schema, 5).select("seq", F.col("at").cast("timestamp").alias("ts")).withWatermark("ts", "0 seconds")
    out = finish(windows.tumble_aggregate(source, "ts", 3_600_000, [], F.count("seq").alias("n")))
    assert sorted((str(r.window_start), r.n) for r in out.collect()) == [("2024-01-01 00:00:00", 1), ("2024-01-01 02:00:00", 2)]  # row 2 came after its window had closed


def test_time_sort_over_batches(spark, tmp_path):
    from millrace.streaming.runner import time_sort

    at = "2024-01-01 00:00:"
    batches = [[(0, at + "10", 1), (1, at + "05", 2), (2, None, 3)], [(3, at + "10", 4), (-7, at + "09.000001", 5), (-7, at + "09.000001", 5), (-8, at + "09.000002", 6), (None, at + "12", 7)], [(4, at + "03", 8), (5, at + "12", 9)], [(9, "2100-01-01 00:00:00", 0)]]
    for some in batches:
        spark.createDataFrame(some, "seq long, at string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("seq long, at string, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = time_sort(source.select("seq", F.col("at").cast("timestamp").alias("ts"), "v").withWatermark("ts", "2 seconds"), "ts", "seq")
    assert out.columns == ["seq", "ts", "v"]
    assert [r.v for r in out.collect()] == [3, 2, 5, 5, 6, 1, 4, 9, 7]  # 8 came too late, and nothing has passed the last row


def test_sort_query_is_whole_ordered_and_spread(spark, tmp_path):
    """Rows without a time or an id and with ids below zero count; no one task gives all rows."""
    import duckdb

    from millrace.streaming import catalog

    con = duckdb.connect()
    con.execute(f"""COPY (SELECT CASE WHEN i % 50 <> 7 THEN i - 20 END AS event_id, CASE WHEN i % 40 <> 9 THEN TIMESTAMP '2024-01-01' + to_microseconds((i * 37 % 50) * 400) END AS ts, i % 3 AS user_id, 'view' AS event_type, i / 8 AS value, NULL::VARCHAR AS props
FROM range(120) t(i)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    out = catalog.queries()["stream_sort"](spark, str(tmp_path))
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, con.execute(catalog.oracle_sql()["stream_sort"]).fetchall()))
    times = dict(con.execute("SELECT CAST(floor(value * 100) AS BIGINT), (ts IS NULL, ts, event_id IS NULL, event_id) FROM events").fetchall())
    timed = [k for _, v in got if not (k := times[v])[0]]
    assert timed == sorted(timed)
    assert sum(spark.read.parquet(f).count() > 0 for f in out.inputFiles()) > 1
