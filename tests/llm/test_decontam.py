"""Decontamination against plain window search."""

import hashlib

from cases import LONG, TEXTS, documents, sample, words

from millrace.llm import decontam

ITEMS = [
    (1, "quick brown fox jumps over the lazy dog again"),
    (2, "fox jumps over the lazy dog again and again"),
    (3, "One Two"),
    (4, "tie"),
    (5, None),
    (6, "..."),
    (10, " ".join(LONG.split()[500:530])),
    (10, "another text of the same item that nothing else has in it"),
    (None, "a row without an id is a row"),
    (7, "a row without an id is a row"),
]


def plain(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(len(v), 8)
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
        for s in range(len(w) - n + 1) if windows else ():
            if tuple(w[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                if i is not None:
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2


def compare(spark, docs, items):
    table = spark.createDataFrame([(i, t, 5, "x") for i, t in items], "item_id long, text string, id long, mark string")
    got = decontam.scan(documents(spark, docs), table).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *plain(t, items)) for i, t, *_ in docs), key=key)


def test_odd_documents(spark):
    compare(spark, [*TEXTS, (30, "x " * 50 + ITEMS[0][1], "en", "a"), (31, ITEMS[0][1] + " " + ITEMS[0][1], "en", "a")], ITEMS)


def test_every_cut_of_a_span_is_found(spark):
    passage = LONG.split()[100:108]
    docs = [(i, " ".join([*(f"p{i}q{j}" for j in range(i))] + passage + [f"r{i}"]), "en", "a") for i in range(12)]
    compare(spark, docs, [(1, " ".join(LONG.split()[95:120]))])


def test_generated_documents(spark):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    compare(spark, sample(spark, 200), items)


def test_empty_tables(spark):
    compare(spark, TEXTS, [])
    compare(spark, [], ITEMS)


def test_leaked_rows_go(spark):
    table = spark.createDataFrame([(1, ITEMS[0][1])], "item_id long, text string")
    kept = decontam.uncontaminated(documents(spark), table)
    assert kept.columns == documents(spark).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in TEXTS} - {1, 2}


def test_leaked_rows_without_an_id_go(spark):
    table = spark.createDataFrame([(1, ITEMS[0][1])], "item_id long, text string")
    docs = [(None, "see: " + ITEMS[0][1], "en", "a"), (None, "nothing of it", "en", "a"), (None, None, "en", "a"), (1, "clean", "en", "a")]
    kept = decontam.uncontaminated(documents(spark, docs), table)
    assert sorted(str(r.text) for r in kept.collect()) == ["None", "clean", "nothing of it"]


def test_plan_is_native(spark):
    table = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontam.scan(documents(spark), table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
