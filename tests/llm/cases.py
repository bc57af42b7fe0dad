"""Small documents with every oddity, and plain versions of what operators compute."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, node long, mark string, host string, words string, _w string, row int"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
    (2, "the QUICK brown fox jumps, over the lazy dog again and again", "en", "a"),
    (3, "", "en", None),
    (4, None, None, "a"),
    (5, "?!... --", "en", "b"),
    (6, "?!... --", "en", "b"),
    (7, LONG, "en", "b"),
    (7, LONG, "en", "b"),
    (8, LONG + " changed at the very end", None, "b"),
    (9, "Äpfel und Öl, größer als 中文 字 😀 ok\nzweite Zeile\n", "de", "a"),
    (10, "one two", None, "a"),
    (11, "Licensed under CC BY-NC 4.0.\nAll rights reserved. all RIGHTS reserved", "en", "c"),
    (12, "GNU General Public License; the general  public\tlicense", "en", "c"),
    (None, "a row without an id is a row", "en", "c"),
    (13, "tie", "en", "a"),
    (14, "tie", "fr", "a"),
]
EXTRA = (99, 98, 97, "m", "h", "w", "_", 1)


def documents(spark, texts=None):
    rows = [(i, t, lang, src, None if t is None else len(t), *EXTRA) for i, t, lang, src in (TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    return WORD.findall((text or "").encode().lower())


def shingle_set(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def tokenizer():
    from millrace.llm.catalog import tokenizer_path

    return tokenizer_path()


def sample(spark, n=250, name="documents"):
    """Rows of the small generated table, for comparisons with plain versions."""
    return [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").orderBy("doc_id").limit(n).select("doc_id", "text", "lang", "source").collect()]
