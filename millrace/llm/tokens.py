"""Token counts by offset-mapped attribution.

Each whole text is encoded once.  Its tokens' spans (from the tokens' byte lengths, which add up to the
text) are interval-joined to the spans of sections by binary search, and a token that crosses a boundary
goes where ``rule`` says:

* ``start``: to the section of its first byte; ``end``: to that of its last byte;
* ``most``: to the section that holds most of its bytes, the earlier one if equal.

Sections of a text are its lines, each with its line feed; an empty or null text has one empty section.
Fields of a row are joined by ``separator``, which counts with the field before it; a null field is empty.
Tokens are counted once: the counts of a row's sections add up to its tokens.  Null and repeated ids are
carried along, each row by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._bpe import encoder
from millrace.llm._scratch import small_batches

RULES = ("start", "end", "most")


def allocate(begin: np.ndarray, end: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For tokens [begin, end) in order: the section of each, and whether it crosses a boundary.

    cuts: where sections begin, ascending, the first at or before the first token.
    """
    a = np.searchsorted(cuts, begin, side="right") - 1
    b = np.searchsorted(cuts, np.maximum(end - 1, begin), side="right") - 1
    cross = b > a
    if rule == "start":
        return a, cross
    if rule == "end":
        return b, cross
    out = a.copy()
    for i in np.flatnonzero(cross).tolist():
        edges = np.concatenate([[begin[i]], cuts[a[i] + 1 : b[i] + 1], [end[i]]])
        out[i] = a[i] + int(np.diff(edges).argmax())
    return out, cross


def line_cuts(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin in texts that stand one after another, and each text's first line."""
    feeds = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
    inner = feeds[~np.isin(feeds, bounds)]
    starts = bounds[:-1]
    cuts = np.sort(np.concatenate([starts, inner]), kind="stable")  # an empty text's cut stands before the next one's
    first = np.searchsorted(inner, starts) + np.arange(len(starts))
    return cuts, np.append(first, len(cuts))


def _lines(batches: Iterator[pa.RecordBatch], path: str, rule: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        ids_of = batch.column(0)
        for lo, hi, raw, bounds, ids, at in enc.encode(batch.column(1)):
            ends = np.cumsum(enc.byte_length[ids])
            if (ends[-1] if len(ends) else 0) != len(raw):
                raise ValueError("token lengths do not add up to the text")
            cuts, first = line_cuts(raw, bounds)
            sec, cross = allocate(ends - enc.byte_length[ids], ends, cuts, rule)
            n, x = np.bincount(sec, minlength=len(cuts)), np.bincount(sec[cross], minlength=len(cuts))
            chars = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80, out=chars[1:])
            owner = np.repeat(np.arange(hi - lo), np.diff(first))
            stop = np.append(cuts[1:], len(raw))
            begin = chars[bounds[:-1]][owner]
            yield pa.RecordBatch.from_arrays(
                [ids_of.take(pa.array(owner + lo)), *(pa.array(v.astype(np.int64)) for v in (np.arange(len(cuts)) - first[:-1][owner], chars[cuts] - begin, chars[stop] - begin, n, x))], schema=schema
            )


def count_lines(docs: DataFrame, tokenizer: str, *, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: doc_id, section (from 0), char_start, char_end, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("section", "char_start", "char_end", "n_tokens", "n_crossing"))])
    arrow = to_arrow_schema(schema)
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _lines(it, tokenizer, rule, arrow), schema)


def _fields(batches: Iterator[pa.RecordBatch], path: str, rule: str, names: list[str], separator: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        columns = [batch.column(i + 1).to_pylist() for i in range(len(names))]
        rows = [[x or "" for x in row] for row in zip(*columns, strict=True)]
        texts = [separator.join(row) for row in rows]
        for lo, hi, _, bounds, ids, at in enc.encode(pa.array(texts, pa.large_string())):
            ends = np.cumsum(enc.byte_length[ids])
            cuts = np.concatenate([bounds[i - lo] + np.cumsum([0, *(len((x + separator).encode()) for x in rows[i][:-1])]) for i in range(lo, hi)])
            sec, cross = allocate(ends - enc.byte_length[ids], ends, cuts, rule)
            n, x = np.bincount(sec, minlength=len(cuts)), np.bincount(sec[cross], minlength=len(cuts))
            owner = np.repeat(np.arange(lo, hi), len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(names * (hi - lo)), pa.array(n.astype(np.int64)), pa.array(x.astype(np.int64))], schema=schema)


def count_fields(df: DataFrame, tokenizer: str, fields: list[str], *, rule: str = "most", separator: str = "\n", id_col: str = "doc_id") -> DataFrame:
    """One row per field of each row: id, field, n_tokens, n_crossing; the fields are encoded as one text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("field", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType())])
    arrow = to_arrow_schema(schema)
    return df.select(id_col, *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields))).mapInArrow(lambda it: _fields(it, tokenizer, rule, list(fields), separator, arrow), schema)
