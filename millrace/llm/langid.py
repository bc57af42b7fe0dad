"""Language ID: string-kernel classification with Nystroem landmarks and kernel ridge regression.

A text's blended spectrum is the set of its byte 1-, 2- and 3-grams (A-Z lower-cased, everything but
letters as a space), hashed to ``GRAMS`` places.  The presence kernel of two texts is the size of their
spectra's intersection over the geometric mean of their sizes.  ``LANDMARKS`` sampled texts span the
Nystroem feature space, in which one ridge regression per language is fitted, one against the rest.
Texts are scored in blocks: presence matrix times landmarks times weights.

Learning takes at most ``SAMPLE`` texts, evenly over at most ``LANGUAGES`` languages, chosen by a hash of
id and text (which rows are taken does not depend on partitioning).  Rarer languages than those are not learned.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if nothing could be
learned; a null id is scored but is neither held out nor learned from; null ``lang`` is never learned;
repeated rows are scored each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._learn import fold, held_out, train_once
from millrace.llm._scratch import small_batches
from millrace.llm._words import FOLD, row_slices, utf8

GRAMS = 4096
LANDMARKS = 192
SAMPLE = 4000
LANGUAGES = 256
RIDGE = 1e-3
#: Texts of one matrix product.
BLOCK = 512

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


def spectra(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, their presence matrix (float32), and whether each has a letter."""
    data, offsets = utf8(column)
    for a, b in row_slices(offsets):
        for lo in range(a, b, BLOCK):
            hi = min(b, lo + BLOCK)
            bounds = offsets[lo : hi + 1] - offsets[lo]
            raw = FOLD[data[offsets[lo] : offsets[hi]]]
            text = np.where(_LETTER[raw], raw, 32).astype(np.uint32)
            n = hi - lo
            owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds)) * GRAMS
            x = np.zeros(n * GRAMS, dtype=np.float32)
            code, size = text, len(text)
            for k in (1, 2, 3):
                if size < k:
                    break
                if k > 1:
                    code = (code[: size - k + 1] << np.uint32(8)) | text[k - 1 :]
                own = owner[: size - k + 1]
                within = own == owner[k - 1 :]
                place = ((code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(20)).astype(np.int64)
                x[(own + place)[within]] = 1
            ascii_letters = np.zeros(size + 1, dtype=np.int64)
            np.cumsum(_LETTER[raw] & (raw < 128), out=ascii_letters[1:])
            letter = ascii_letters[bounds[1:]] > ascii_letters[bounds[:-1]]
            for i in np.flatnonzero(~letter & (np.diff(bounds) > 0)).tolist():
                whole = data[offsets[lo + i] : offsets[lo + i + 1]]
                letter[i] = bool((whole > 127).any()) and any(c.isalpha() for c in whole.tobytes().decode())
            yield lo, hi, x.reshape(n, GRAMS), letter


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.maximum(x.sum(axis=1), 1))
    return (x @ landmarks.T) / size[:, None]  # the landmarks are divided by their own size already


def fit(x: np.ndarray, y: np.ndarray, n_classes: int) -> dict:
    """x: presence rows in a fixed order; y: class numbers."""
    order = np.lexsort((np.arange(len(y)) - np.searchsorted(np.sort(y), y), y))
    rank = np.zeros(len(y), dtype=np.int64)
    rank[order] = np.arange(len(y)) - np.searchsorted(y[order], y[order])
    chosen = np.lexsort((y, rank))[:LANDMARKS]  # in turn from each class
    z = x[chosen].astype(np.float32)
    z /= np.sqrt(np.maximum(z.sum(axis=1), 1))[:, None]
    kmm = kernel(x[chosen].astype(np.float32), z).astype(np.float64)
    value, vector = np.linalg.eigh((kmm + kmm.T) / 2)
    keep = value > 1e-6 * value.max()
    white = vector[:, keep] / np.sqrt(value[keep])
    phi = np.concatenate([kernel(x[i : i + BLOCK].astype(np.float32), z) for i in range(0, len(x), BLOCK)]) @ white
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    target = np.where(y[:, None] == np.arange(n_classes), 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=n_classes)[y]
    gram = (phi1 * weight[:, None]).T @ phi1 + RIDGE * np.eye(phi1.shape[1])
    w = np.linalg.solve(gram, (phi1 * weight[:, None]).T @ target)
    score = phi1 @ w
    best = (np.inf, 1.0)
    for t in (1, 2, 4, 8, 16, 32):  # sharpness by the likelihood of the sample
        p = softmax(score * t)
        best = min(best, (float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-9)).mean()), float(t)))
    return {"landmarks": z, "weights": (white @ w[:-1]).astype(np.float32), "bias": w[-1].astype(np.float32), "sharpness": best[1]}


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _learn(batches: Iterator[pa.RecordBatch], languages: list[str]) -> dict | None:
    xs, ys, keys = [], [], []
    for batch in batches:
        lang = np.array([languages.index(v) for v in batch.column(2).to_pylist()], dtype=np.int64)
        ys.append(lang)
        keys.append(batch.column(0).to_numpy())
        xs.extend(x.astype(np.uint8) for _, _, x, _ in spectra(batch.column(1)))
    if not xs:
        return None
    x, y, key = np.concatenate(xs), np.concatenate(ys), np.concatenate(keys)
    order = np.lexsort((y, key))
    return fit(x[order], y[order], len(languages))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], dict | None]:
    """Languages and model, from rows that aren't held out."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where((fold("id") != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return [], None
    languages = sorted(r["lang"] for r in counts)
    each = max(1, SAMPLE // len(languages))
    share = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], min(1.0, each / r["n"]))))
    key = F.xxhash64(F.col("id").cast("string"), "text", F.lit(20))
    sample = rows.where(F.pmod(key, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select(key.alias("key"), "text", "lang").orderBy("key", "lang").limit(SAMPLE)
    return languages, train_once(sample, lambda batches: _learn(batches, languages))


def _score(batches: Iterator[pa.RecordBatch], languages: list[str], model: dict | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    names = np.array([*languages, "und"], dtype=object)
    for batch in batches:
        n = batch.num_rows
        best, score = np.full(n, len(languages)), np.zeros(n)
        if model:
            for lo, hi, x, letter in spectra(batch.column(2)):
                p = softmax((kernel(x, model["landmarks"]) @ model["weights"] + model["bias"]).astype(np.float64) * model["sharpness"])
                top = p.argmax(axis=1)
                best[lo:hi] = np.where(letter, top, len(languages))
                score[lo:hi] = np.where(letter, p[np.arange(hi - lo), top], 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score)], schema=schema)


def classify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, after learning from rows that aren't held out."""
    languages, model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return score(docs, languages, model, id_col=id_col, text_col=text_col)


def score(docs: DataFrame, languages: list[str], model: dict | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast((languages, model))  # at most LANGUAGES names and GRAMS x LANDMARKS floats
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    rows = docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _score(it, *held.value, arrow), schema)


def accepted(docs: DataFrame, *, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns kept, whose language is told with ``least`` probability or more."""
    from pyspark.sql.pandas.types import to_arrow_schema

    languages, model = train(docs, text_col=text_col)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((languages, model))
    at = docs.columns.index(text_col)
    inner = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    arrow = to_arrow_schema(docs.schema)

    def run(batches):
        for batch in batches:
            nothing = pa.array(np.zeros(batch.num_rows, np.int64))
            probe = pa.RecordBatch.from_arrays([nothing, nothing, batch.column(at)], names=["a", "b", "text"])
            found = next(_score(iter([probe]), *held.value, inner))
            good = np.array([x != "und" for x in found.column(2).to_pylist()], dtype=bool) & (found.column(3).to_numpy() >= least)
            yield pa.RecordBatch.from_arrays(batch.columns, schema=arrow).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
