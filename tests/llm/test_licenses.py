"""Licence scans against plain phrase search."""

from cases import TEXTS, documents, sample, words

from millrace.llm import licenses

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def places(w, phrase):
    p = phrase.encode().split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def plain(text):
    w = words(text)
    found = {label: places(w, phrase) for label, phrase in BASE.items()}
    starts = [s for x in found.values() for s in x]
    every = {t.label for t in licenses.TEMPLATES if any(places(w, p) for p in t.phrases)}
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(k for k, v in found.items() if v)), ",".join(sorted(every))


def compare(spark, texts):
    got = licenses.scan(documents(spark, texts).repartition(3)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
    mine = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got), key=key)
    assert mine == sorted(((i, *plain(t)) for i, t, *_ in texts), key=key)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    return {r.doc_id: r for r in got}


def test_odd_documents(spark):
    more = [(20, "all rights", "en", "a"), (21, "reserved all rights", "en", "a"), (22, "cc by cc by", "en", "a"), (23, "rights reserved", "en", "a"), (24, "Released under the MIT License.", "en", "a"), (25, "all rights reserved " * 4000, "en", "a")]
    found = compare(spark, TEXTS + more)
    assert found[24].labels == "mit" and found[24].score == 1.0 and found[25].n_base == 4000
    assert found[11].labels == "cc-by,cc-by-nc,reserved" and found[11].base_labels == "cc-by,reserved"


def test_generated_documents(spark):
    compare(spark, sample(spark, 600))


def test_empty(spark):
    assert licenses.scan(documents(spark, [])).count() == 0
