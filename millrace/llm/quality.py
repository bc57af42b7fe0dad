"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer numpy network.

Tokens are runs of letters and digits, and runs of symbols, with case kept; each is hashed to one of ``WORDS``
places.  Every place has a sparse ternary index vector from a fixed seed.  A word's vector is its index vector
plus the normalized sum of its neighbours' index vectors within ``WINDOW`` tokens over the sample.  A text's features
are pooled from these vectors: the mean over its tokens, the mean over its different words with logarithms of their
counts as weights, both means' norms, and how alike successive tokens' vectors are (mean cosine at distances 1 and 2);
and the logarithm of its length.
The network has one hidden layer; a temperature fitted on a part of the sample that it did not see calibrates it.

Learning takes at most ``SAMPLE`` rows: those of the ``SAMPLE`` labelled ids that aren't held out with the least
hashes, and of these, where ids repeat, the rows with the least hashes of id and text.  Scores depend on the text alone.

Defined results: null and empty texts get the score of a text without tokens; ids without a label are
scored all the same; an id labelled twice counts with its least label; null ids are scored, not learned
from; without any label the score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._learn import fold, held_out, train_once
from millrace.llm._scratch import small_batches, written
from millrace.llm._words import _BYTE, row_slices, span_hashes, utf8

WORDS = 1 << 14
DIM, NONZERO, WINDOW = 64, 8, 2
SAMPLE = 8000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 0.004, 1e-4
THRESHOLD = 0.7
N_FEATURES = 2 * DIM + 5
#: Texts pooled at a time.
BLOCK = 64

_KIND = np.full(256, 2, dtype=np.uint8)  # 0 space, 1 letter or digit, 2 symbol
_KIND[:33] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(20)
    out = np.zeros((WORDS, DIM), dtype=np.float32)
    at = np.argsort(rng.random(out.shape), axis=1)[:, :NONZERO]
    out[np.arange(len(out))[:, None], at] = rng.choice([-1.0, 1.0], at.shape)
    return out / np.sqrt(NONZERO)


@dataclass
class Texts:
    """Rows lo to hi: their tokens' places, each text's first token, and each token's text."""

    lo: int
    hi: int
    word: np.ndarray
    first: np.ndarray
    owner: np.ndarray  # each token's text, from 0


def blocks(column: pa.Array) -> Iterator[Texts]:
    data, offsets = utf8(column)
    for begin, end in row_slices(offsets):
        for lo in range(begin, end, BLOCK):
            hi = min(end, lo + BLOCK)
            raw = data[offsets[lo] : offsets[hi]]
            bounds = offsets[lo : hi + 1] - offsets[lo]
            n, m = len(raw), hi - lo
            kind = _KIND[raw]
            edge = np.zeros(n + 1, dtype=bool)
            edge[bounds] = True
            starting, stop = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
            if n:
                starting[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
                stop[:-1] = starting[1:]
            starts, ends = np.flatnonzero(starting & (kind > 0)), np.flatnonzero(stop & (kind > 0)) + 1
            first = np.searchsorted(starts, bounds)
            word = (span_hashes(_BYTE[raw], starts, ends) >> np.uint64(50)).astype(np.int64)
            owner = np.repeat(np.arange(m), np.diff(first))
            yield Texts(lo, hi, word, first, owner)


def _mean(weight: np.ndarray, place: np.ndarray, owner: np.ndarray, m: int, vectors: np.ndarray) -> np.ndarray:
    """Each text's weighted mean of its places' vectors; owners ascend."""
    out, total = np.zeros((m, DIM)), np.bincount(owner, weight, minlength=m)
    if len(owner):
        heads = np.flatnonzero(np.r_[True, np.diff(owner) > 0])
        out[owner[heads]] = np.add.reduceat(vectors[place] * weight[:, None].astype(np.float32), heads, axis=0)
    return out / np.maximum(total, 1)[:, None]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Vectors of all places, from one pass over the sample."""
    index = index_vectors()
    seen = np.zeros_like(index)
    for batch in batches:
        for t in blocks(batch.column(1)):
            if not len(t.word):
                continue
            owner = t.owner
            near = np.zeros((len(t.word), DIM), dtype=np.float32)
            for d in range(1, WINDOW + 1):
                same = (owner[d:] == owner[:-d])[:, None]
                near[d:] += index[t.word[:-d]] * same
                near[:-d] += index[t.word[d:]] * same
            order = np.argsort(t.word, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(t.word[order]) > 0])
            seen[t.word[order][heads]] += np.add.reduceat(near[order], heads, axis=0)
    norm = np.linalg.norm(seen, axis=1, keepdims=True)
    return index + seen / np.where(norm > 0, norm, 1)


def features(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros((len(column), N_FEATURES))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for t in blocks(column):
        m = t.hi - t.lo
        n, owner = np.diff(t.first), t.owner
        pair, count = np.unique(owner * WORDS + t.word, return_counts=True)
        pooled = [_mean(weight, pair % WORDS, pair // WORDS, m, vectors) for weight in (count, np.log1p(count))]
        alike = []
        for d in (1, 2):
            pairs = np.flatnonzero(owner[d:] == owner[:-d])
            product = np.einsum("ij,ij->i", unit[t.word[pairs]], unit[t.word[pairs + d]])
            alike.append(np.bincount(owner[pairs], product, minlength=m) / np.maximum(n - d, 1))
        out[t.lo : t.hi] = np.hstack([*pooled, *(np.linalg.norm(x, axis=1)[:, None] for x in pooled), np.stack([*alike, np.log1p(n)], axis=1)])
    return out


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    hidden = np.tanh((x - model["mean"]) / model["scale"] @ model["w1"] + model["b1"])
    return (hidden @ model["w2"])[:, 0] + model["b2"]


def probability(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(logits(model, x) / model["temperature"], -30, 30)))


def gradient(model: dict, z: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean logistic loss over standardized rows."""
    hidden = np.tanh(z @ model["w1"] + model["b1"])
    p = 1 / (1 + np.exp(-np.clip((hidden @ model["w2"])[:, 0] + model["b2"], -30, 30)))
    d = ((p - y) / len(y))[:, None]
    back = (d @ model["w2"].T) * (1 - hidden**2)
    return {"w2": hidden.T @ d, "b2": d.sum(axis=0), "w1": z.T @ back, "b1": back.sum(axis=0)}


def fit(x: np.ndarray, y: np.ndarray) -> dict | None:
    """Adam on the logistic loss over 85 in 100 rows; the others choose the temperature."""
    if not len(x):
        return None
    rng = np.random.default_rng(6)
    cut = max(1, int(0.85 * len(x)))
    model = {"mean": x[:cut].mean(axis=0), "scale": x[:cut].std(axis=0) + 1e-6}
    model |= {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), "b2": np.zeros(1)}
    z = (x - model["mean"]) / model["scale"]
    names = ("w1", "b1", "w2", "b2")
    m, v = ({k: np.zeros_like(model[k]) for k in names} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(cut)
        for i in range(0, cut, BATCH):
            at = order[i : i + BATCH]
            grad = gradient(model, z[at], y[at])
            step += 1
            for k in names:
                g = grad[k] + DECAY * model[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    rest = slice(cut, None) if cut < len(x) else slice(None)
    out, truth = logits(model, x[rest]), y[rest]
    best = (np.inf, 1.0)
    for t in np.geomspace(1, 8, 25):
        s = np.clip(out / t, -30, 30)
        best = min(best, (float((np.logaddexp(0, s) - truth * s).mean()), float(t)))
    model["temperature"] = best[1]
    return model


def _fit(batches: Iterator[pa.RecordBatch]) -> dict | None:
    parts = [(b.column(0).to_numpy(), np.stack(b.column(2).to_numpy(zero_copy_only=False)), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return None
    key, x, y = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    return fit(x[order], y[order].astype(float))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, dict | None]:
    """Word vectors and network, from at most ``SAMPLE`` labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    key = F.xxhash64(F.col("id").cast("string"), F.lit(6))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("y")).where(F.col("y").isin(0, 1) & (fold("id") != 2)).groupBy("id").agg(F.min("y").alias("y"))
    chosen = known.select("id", "y", key.alias("key")).orderBy("key", "id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = written(rows.join(F.broadcast(chosen), "id").select("key", "text", "y").orderBy(F.xxhash64("key", "text"), "y").limit(SAMPLE), "quality")  # at most SAMPLE ids are broadcast
    vectors = train_once(sample, _neighbours)
    if vectors is None:
        vectors = index_vectors()
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("y", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def pooled(batches):
        for batch in batches:
            x = features(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["key", "y", "x"])

    return vectors, train_once(sample.mapInArrow(pooled, schema), _fit)


def score(docs: DataFrame, vectors: np.ndarray, model: dict | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((vectors, model))  # WORDS x DIM floats
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        v, m = held.value
        for batch in batches:
            p = probability(m, features(batch.column(2), v))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], schema=arrow)

    return docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    return score(docs, *train(docs, labels, **columns), **{k: v for k, v in columns.items() if k != "label_col"})
