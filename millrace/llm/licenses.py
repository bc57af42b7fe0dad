"""License scans by a positional index of rare tokens.

Templates are short licence notices, each with one or more mandatory key phrases.  The index posts every phrase of
every template under its words, with the word's place in the phrase.  Words are weighted by inverse document
frequency over the whole corpus (one count per template word comes to the driver), and a phrase's postings are ranked
from its rarest word on.  In a file only its highest-IDF licence words are looked up, those under which a phrase is posted first: each
place of one, less the place posted, is a candidate start of the phrase.  The candidates of all templates are then
intersected with the postings of the next rarest word at its relative position, and so on, until all words of a
mandatory phrase are verified at one start.  Around a verified phrase the rest of its template is matched at relative
positions; the score is the matched share of the template's weight, the best over its places.  Work grows with the places of rare words, not
with the number of templates.

Every place counts: nothing is cut from a text, and no word is passed over.

Defined results: a null or empty text has no words, no labels and score 0; a text with a verified phrase
scores above 0; null and repeated ids are carried along, each row by itself; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._scratch import small_batches
from millrace.llm._words import _BYTE, pieces, span_hashes


@dataclass(frozen=True)
class Template:
    label: str
    phrases: tuple[str, ...]  # each alone is enough
    notice: str  # holds the phrases
    base: bool = False


#: Labels, key phrases and notices.
TEMPLATES = (
    Template("cc-by", ("cc by",), "licensed under cc by 4 0", True),
    Template("gpl", ("general public license",), "this work is licensed under the gnu general public license version 3", True),
    Template("reserved", ("all rights reserved",), "all rights reserved", True),
    Template("agpl", ("affero general public license",), "licensed under the gnu affero general public license version 3"),
    Template("apache-2.0", ("apache license version 2 0", "apache license 2 0"), "licensed under the apache license version 2 0"),
    Template("bsd", ("redistribution and use in source and binary forms", "bsd license"), "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("bsl-1.0", ("boost software license",), "distributed under the boost software license version 1 0"),
    Template("cc-by-nc", ("cc by nc", "attribution noncommercial"), "licensed under cc by nc 4 0"),
    Template("cc-by-nd", ("cc by nd", "attribution noderivatives"), "licensed under cc by nd 4 0"),
    Template("cc-by-sa", ("cc by sa", "attribution sharealike"), "licensed under cc by sa 4 0"),
    Template("cc0", ("cc0 1 0 universal", "creative commons zero"), "cc0 1 0 universal public domain dedication"),
    Template("epl", ("eclipse public license",), "made available under the terms of the eclipse public license 2 0"),
    Template("isc", ("isc license", "permission to use copy modify and or distribute this software"), "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", ("lesser general public license",), "under the terms of the gnu lesser general public license"),
    Template("mit", ("mit license", "permission is hereby granted free of charge"), "released under the mit license"),
    Template("mpl", ("mozilla public license",), "subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", ("released into the public domain",), "this is free and unencumbered software released into the public domain"),
)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(span_hashes(_BYTE[raw], np.array([0]), np.array([len(raw)]))[0])


class Index:
    """Template words in a fixed order, and postings of the templates' phrases."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.words = sorted({w for t in templates for s in (*t.phrases, t.notice) for w in s.split()})
        number = {w: i for i, w in enumerate(self.words)}
        h = np.array([word_hash(w) for w in self.words], dtype=np.uint64)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.phrases = [[number[w] for w in p.split()] for t in templates for p in t.phrases]
        self.template = np.array([i for i, t in enumerate(templates) for _ in t.phrases])
        self.length = np.array([len(p) for p in self.phrases])
        notices = [[number[w] for w in t.notice.split()] for t in templates]
        self.notice = np.full((len(templates), max(map(len, notices))), -2)  # -2 is no word's number
        for i, words in enumerate(notices):
            self.notice[i, : len(words)] = words
        #: Where each phrase stands in its template's notice, -1 if it doesn't.
        self.offset = np.array([next((i for i in range(len(notices[t])) if notices[t][i : i + len(p)] == p), -1) for t, p in zip(self.template.tolist(), self.phrases, strict=True)])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)

    def post(self, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each rank, the word and the place that each phrase is posted with, rarest words first; -1 past its last."""
        ranked = [sorted(range(len(p)), key=lambda j: (-idf[p[j]], j)) for p in self.phrases]
        out = []
        for rank in range(int(self.length.max())):
            place = np.array([r[rank] if rank < len(r) else -1 for r in ranked])
            out.append((np.array([p[j] if j >= 0 else -1 for p, j in zip(self.phrases, place.tolist(), strict=True)]), place))
        return out

    def lookup(self, n: np.ndarray, owner: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All (phrase, start) that stand in the texts, by intersecting postings from the rarest words on."""
        (word, place), *rest = postings
        by_word = np.argsort(word, kind="stable")
        begin = np.searchsorted(word[by_word], np.arange(len(self.words) + 1))
        some = np.flatnonzero(n >= 0)
        count = (begin[1:] - begin[:-1])[n[some]]
        at = np.repeat(some, count)
        phrase = by_word[np.repeat(begin[n[some]] - np.cumsum(count) + count, count) + np.arange(len(at))]
        start = at - place[phrase]
        ok = (start >= 0) & (start + self.length[phrase] <= len(n))
        phrase, start = phrase[ok], start[ok]
        ok = owner[start] == owner[start + self.length[phrase] - 1]
        phrase, start = phrase[ok], start[ok]
        for word, place in rest:
            ok = (place[phrase] < 0) | (n[start + np.maximum(place[phrase], 0)] == word[phrase])
            phrase, start = phrase[ok], start[ok]
        return phrase, start


def _frequencies(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Texts, and how many hold each template word; one row per task."""
    held, texts = np.zeros(len(index.words), dtype=np.int64), 0
    for batch in batches:
        for p in pieces(batch.column(0)):
            n = index.numbers(p.hashes)
            at = np.flatnonzero(n >= 0)
            pair = np.unique(p.owner[at] * len(index.words) + n[at])
            held += np.bincount(pair % len(index.words), minlength=len(index.words))
            texts += p.hi - p.lo
    yield pa.RecordBatch.from_arrays([pa.array([texts, *held.tolist()], pa.int64()), pa.array(np.arange(len(held) + 1) - 1)], names=["n", "word"])


def frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> np.ndarray:
    """Inverse document frequency of each template word over all rows."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("word", T.LongType())])
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _frequencies(it, index), schema)
    n = {r["word"]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row per template word
    return np.array([math.log((1 + n.get(-1, 0)) / (1 + n.get(i, 0))) + 1.0 for i in range(len(index.words))])


def _scan(batches: Iterator[pa.RecordBatch], index: Index, idf: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    labels = np.array([t.label for t in index.templates], dtype=object)
    base = np.array([t.base for t in index.templates])
    by_name = np.argsort(labels)
    postings = index.post(idf)
    weight = np.where(index.notice >= 0, idf[index.notice], 0.0)
    for batch in batches:
        ids = batch.column(0)
        for p in pieces(batch.column(1)):
            m = p.hi - p.lo
            n, owner = index.numbers(p.hashes), p.owner
            phrase, start = index.lookup(n, owner, postings)
            doc, t = owner[start], index.template[phrase]
            found, score = np.zeros((m, len(labels)), dtype=bool), np.zeros(m)
            found[doc, t] = True
            n_base = np.bincount(doc[base[t]], minlength=m)
            first, last = np.full(m, np.iinfo(np.int64).max), np.full(m, -1)
            own = (start - p.first[:-1][doc])[base[t]]
            np.minimum.at(first, doc[base[t]], own)
            np.maximum.at(last, doc[base[t]], own)
            matched, begin = np.zeros(len(start)), start - index.offset[phrase]
            for i in range(index.notice.shape[1]):
                ok = (begin + i >= p.first[:-1][doc]) & (begin + i < p.first[1:][doc])
                matched += weight[t, i] * (ok & (n[np.clip(begin + i, 0, len(n) - 1)] == index.notice[t, i]))
            # a phrase that the notice doesn't hold vouches for itself
            np.maximum.at(score, doc, np.where(index.offset[phrase] < 0, 1.0, matched / weight.sum(axis=1)[t]))
            base_labels, all_labels = [""] * m, [""] * m
            for i in np.flatnonzero(found.any(axis=1)).tolist():
                own = by_name[found[i, by_name]]
                all_labels[i] = ",".join(labels[own])
                base_labels[i] = ",".join(labels[own[base[own]]])
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [ids.slice(p.lo, m), pa.array(np.diff(p.first).astype(np.int64)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(base_labels), pa.array(all_labels), pa.array(np.minimum(score, 1.0))],
                schema=schema,
            )


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    index = Index(templates)
    idf = frequencies(docs, index, text_col)
    long, text = T.LongType(), T.StringType()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in (("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", text), ("labels", text), ("score", T.DoubleType())))])
    arrow = to_arrow_schema(schema)
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _scan(it, index, idf, arrow), schema)
