"""The pipeline against plain versions of its stages, each on what the one before kept."""

from collections import Counter

from cases import words
from test_lines_tokens_prefs import boilerplate
from test_neardup import stays
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from millrace.llm import langid
from millrace.llm._scratch import written
from millrace.llm.catalog import tokenizer_path


def test_stages(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    odd = spark.createDataFrame([(9001, None, "en", "src1", None), (9002, "", "en", "src1", 0), (9003, "123 456", "en", None, 7)], source.schema)
    first = source.orderBy("doc_id").limit(2)
    odd = odd.union(first).union(first.withColumn("doc_id", F.lit(7777).cast("long"))).union(source.limit(5).withColumn("doc_id", F.lit(None).cast("long")))  # repeated rows, an id with two texts, no id
    docs = written(source.unionByName(odd), "test")
    columns, kept = docs.columns, [tuple(r) for r in docs.collect()]
    stages = dict(cp.STAGES)
    assert list(stages) == [n for n, _ in cp.STAGES] and len(stages) == 5

    now = written(stages["language ID"](spark, docs, "/root/testdata/sf0.01"), "t")
    numbered = spark.createDataFrame([(i, r[1]) for i, r in enumerate(kept)], "doc_id long, text string")
    told = {r.doc_id for r in langid.score(numbered, *langid.train(docs)).collect() if r.lang_pred != "und" and r.score >= cp.LANGUAGE_LEAST}
    kept = [r for i, r in enumerate(kept) if i in told]
    assert now.columns == columns and sorted(map(tuple, now.collect()), key=str) == sorted(kept, key=str)
    assert not {9001, 9002, 9003} & {r[0] for r in kept} and {None, 7777} <= {r[0] for r in kept}

    now = written(stages["line dedup"](spark, now, ""), "t")
    bad = boilerplate(kept)
    cut = lambda t, s: "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in bad)
    kept = [(r[0], cut(r[1], r[3]), r[2], r[3], len(cut(r[1], r[3])) if cut(r[1], r[3]) != r[1] else r[4]) for r in kept]
    assert now.columns == columns and sorted(map(tuple, now.collect()), key=str) == sorted(kept, key=str)

    now = written(stages["n-gram Jaccard join"](spark, now, ""), "t")
    one = stays([r[:4] for r in kept])
    kept = [r for r in {(r[0], r[1]): r for r in kept}.values() if (r[0], r[1]) in one]
    assert now.columns == columns and sorted(map(tuple, now.collect()), key=str) == sorted(kept, key=str)

    now = written(stages["benchmark decontamination"](spark, now, "/root/testdata/sf0.01"), "t")
    windows = set()
    for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect():
        w = words(r.text)
        n = min(8, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    leaked = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    kept = [r for r in kept if not leaked(words(r[1]))]
    assert now.columns == columns and sorted(map(tuple, now.collect()), key=str) == sorted(kept, key=str)

    packed = stages["packing"](spark, now, "").collect()
    library = Tokenizer.from_file(tokenizer_path())
    want = {r[0]: len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in kept}
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == Counter(want)


def test_run_ends_in_pieces(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
