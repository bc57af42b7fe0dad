"""Language ID and quality: held-out accuracy, folds, and odd documents."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import TEXTS, documents

from millrace.llm import langid, quality
from millrace.llm._words import _BYTE, span_hashes


@pytest.fixture(scope="module")
def generated(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_language_accuracy(spark, generated):
    docs, _ = generated
    rows = langid.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def test_language_of_odd_documents(spark, generated):
    docs, _ = generated
    languages, model = langid.train(docs)
    rows = langid.score(documents(spark, [*TEXTS, (40, "12 34 ²", "en", "a"), (41, "ß", "de", "a")]), languages, model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) + 2
    assert [by[i].lang_pred for i in (3, 4, 5, 40)] == ["und"] * 4 and by[41].lang_pred != "und"
    assert by[None].held_out is False and by[7].lang_pred in languages


def test_language_without_labels(spark):
    assert langid.classify(documents(spark, [])).count() == 0
    unlabelled = documents(spark, [(i, t, None, s) for i, t, _, s in TEXTS])
    assert {r.lang_pred for r in langid.classify(unlabelled).collect()} == {"und"}


def test_accepted_keeps_columns(spark, generated):
    kept = langid.accepted(documents(spark))
    assert kept.columns == documents(spark).columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {3, 4, 5, 6} and {1, 2} <= ids


def test_quality(spark, generated):
    docs, labels = generated
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum((r.score >= 0.5) == bool(r.quality) for r in out) >= 0.85 * len(out)


def test_quality_of_odd_documents(spark, generated):
    docs, labels = generated
    model = quality.train(docs, labels)
    rows = quality.score(documents(spark), *model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) and by[3].score == by[4].score and by[13].score == by[14].score and by[5].score == by[6].score


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(documents(spark), labels).collect()} == {0.5}
    assert quality.classify(documents(spark, []), labels).count() == 0


def test_quality_of_two_labels_for_one_id(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (9, 0), (11, 1), (12, 1)], "doc_id long, quality int")
    assert quality.classify(documents(spark), labels).count() == len(TEXTS)


def place(token):
    raw = np.frombuffer(token, dtype=np.uint8)
    return int(span_hashes(_BYTE[raw], np.array([0]), np.array([len(raw)]))[0]) >> 50


def tokens(text):
    return [place(t) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").encode())]


SOME = [t for _, t, *_ in TEXTS if t is None or len(t) < 1000] + ["a a a, b!! a", "x"]


def test_word_vectors_against_a_plain_version():
    index = quality.index_vectors()
    seen = np.zeros_like(index)
    for w in map(tokens, SOME):
        for i, a in enumerate(w):
            for j in range(max(0, i - quality.WINDOW), min(len(w), i + quality.WINDOW + 1)):
                if j != i:
                    seen[a] += index[w[j]]
    norm = np.linalg.norm(seen, axis=1, keepdims=True)
    want = index + np.where(norm > 0, seen / np.where(norm > 0, norm, 1), 0)
    batch = pa.RecordBatch.from_arrays([pa.array(SOME), pa.array(SOME)], names=["key", "text"])
    assert np.allclose(quality._neighbours(iter([batch])), want, atol=1e-4)


def test_pooled_features_against_a_plain_version():
    vectors = np.random.default_rng(3).normal(size=(quality.WORDS, quality.DIM)).astype(np.float32)
    got = quality.features(pa.array(SOME), vectors)
    cosine = lambda a, b: vectors[a] @ vectors[b] / np.linalg.norm(vectors[a]) / np.linalg.norm(vectors[b])
    for row, w in zip(got, map(tokens, SOME), strict=True):
        counts = {a: w.count(a) for a in w}
        mean = sum((vectors[a] for a in w), np.zeros(quality.DIM)) / max(len(w), 1)
        weight = {a: np.log1p(n) for a, n in counts.items()}
        soft = sum((vectors[a] * x for a, x in weight.items()), np.zeros(quality.DIM)) / max(sum(weight.values()), 1)
        alike = [sum(cosine(a, b) for a, b in zip(w, w[d:], strict=False)) / max(len(w) - d, 1) for d in (1, 2)]
        assert np.allclose(row, [*mean, *soft, np.linalg.norm(mean), np.linalg.norm(soft), *alike, np.log1p(len(w))], atol=1e-4)


def test_gradient_against_differences():
    rng = np.random.default_rng(5)
    z, y = rng.normal(size=(30, 7)), rng.integers(0, 2, 30).astype(float)
    model = {"w1": rng.normal(size=(7, 4)), "b1": rng.normal(size=4), "w2": rng.normal(size=(4, 1)), "b2": rng.normal(size=1), "mean": np.zeros(7), "scale": np.ones(7)}
    loss = lambda m: float((np.logaddexp(0, quality.logits(m, z)) - y * quality.logits(m, z)).mean())
    for name, grad in quality.gradient(model, z, y).items():
        for at in np.ndindex(grad.shape):
            up, down = model[name].copy(), model[name].copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            assert abs((loss(model | {name: up}) - loss(model | {name: down})) / 2e-6 - grad[at]) < 1e-6


def test_quality_ranks_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = (np.array([r.score for r in rows if r.quality == q]) for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 50)
    seen = []
    monkeypatch.setattr(quality, "train_once", lambda sample, learn: seen.append(sample.count()))
    docs = documents(spark, [(1, f"text {i}", "en", "a") for i in range(200)])
    quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    monkeypatch.setattr(langid, "SAMPLE", 50)
    monkeypatch.setattr(langid, "train_once", lambda sample, learn: seen.append(sample.count()))
    langid.train(docs)
    assert seen and max(seen) <= 50


def test_kernel_and_ridge_against_plain_versions():
    rng = np.random.default_rng(6)
    x, y = (rng.random((90, 40)) < 0.3).astype(np.uint8), np.arange(90) % 3
    model = langid.fit(x, y, 3)
    near = lambda a, b: (a & b).sum() / np.sqrt(max(a.sum(), 1) * max(b.sum(), 1))
    first = [i for k in range(90) for i in (k,)][: langid.LANDMARKS]  # all rows are landmarks here
    kernel = np.array([[near(a, b) for b in x[first]] for a in x])
    got = langid.kernel(x.astype(np.float32), x[first] / np.sqrt(np.maximum(x[first].sum(axis=1), 1))[:, None])
    assert np.allclose(got, kernel, atol=1e-5)
    # the same scores from the dual form of weighted ridge regression with all landmarks, the bias a constant feature
    weight, target = np.diag(1.0 / np.bincount(y)[y]), np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    gram = kernel + 1.0
    dual = np.linalg.solve(weight @ gram + langid.RIDGE * np.eye(90), weight @ target)
    scores = langid.kernel(x.astype(np.float32), model["landmarks"]) @ model["weights"] + model["bias"]
    assert np.allclose(scores, gram @ dual, atol=1e-2)
