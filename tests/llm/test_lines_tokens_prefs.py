"""Line dedup, token counts and preference pairs."""

from collections import Counter, defaultdict

import duckdb
import pytest
from cases import TEXTS, documents, sample, tokenizer
from tokenizers import Tokenizer

from millrace.llm import catalog, linededup, prefs, tokens


def boilerplate(rows):
    """(host, line) that stand on more than a tenth and two or more of the host's different pages."""
    total, holds = Counter(), Counter()
    for s, t in {(s, t) for _, t, _, s, *_ in rows if t is not None}:
        total[s] += 1
        holds.update({(s, x.strip(" \t\r")) for x in t.split("\n") if x.strip(" \t\r")})
    return {k for k, n in holds.items() if n >= 2 and 10 * n > total[k[0]]}


def test_lines_against_plain(spark):
    rows = [(i, f"page {i}\n  Menu\t\nline {i}\n\nMenu" + ("\nrare" if i < 3 else "\nonce" * (i == 7)), "en", "s") for i in range(40)] + [(100 + i, f"Menu\nother {i}", "en", None) for i in range(12)] + [(200, "Menu\nalone", "en", "t"), *TEXTS]
    rows += [(300 + i, "copies of\na page", "en", "u") for i in range(5)] + [(310 + i, f"own {i}\nFoot" if i < 2 else f"own {i}", "en", "u") for i in range(4)]
    bad = boilerplate(rows)
    want = sorted(repr((i, 0, 0, None) if t is None else (i, len(t.split("\n")), sum((s, x.strip(" \t\r")) in bad for x in t.split("\n")), "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in bad))) for i, t, _, s in rows)
    docs = documents(spark, rows)
    assert sorted(repr(tuple(r)) for r in linededup.report(docs).collect()) == want
    assert {x for x in bad if x[0] in ("s", "u", None)} == {("s", "Menu"), (None, "Menu"), ("u", "Foot")}
    assert linededup.cleaned(docs).columns == docs.columns
    assert linededup.report(documents(spark, [])).count() == 0


def test_lines_beside_columns_of_any_name(spark):
    rows = [(i, f"Menu\npage {i}", f"http://Shop.test:80/{i}", 1, 2, 3, 4) for i in range(4)] + [(8, "Menu\nalone", "https://u@other.test/x", 1, 2, 3, 4), (9, "Menu\nelse", "no url", 1, 2, 3, 4)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, _host int, lines int, bad_lines int, n_lines long")
    options = {"text_col": "html", "url_col": "url"}
    assert sorted(tuple(r) for r in linededup.report(pages, id_col="page_id", **options).collect()) == [*((i, 2, 1, f"page {i}") for i in range(4)), (8, 2, 0, "Menu\nalone"), (9, 2, 0, "Menu\nelse")]
    kept = linededup.cleaned(pages, length_col="n_lines", **options)
    assert kept.columns == pages.columns and sorted((r.page_id, r.lines, r.n_lines) for r in kept.collect()) == [*((i, 2, 6) for i in range(4)), (8, 2, 4), (9, 2, 4)]


def test_small_hosts_lose_lines_too(spark, tmp_path):
    rows = [(i, f"Menu\npage {i}", "en", "s") for i in range(4)] + [(9, "Menu\nalone", "en", "t"), (10, None, "en", "t"), (11, "Menu\npage 1", "en", "s")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalog.queries()["op8_lines"](spark, str(tmp_path)).collect())
    assert got == [*((i, 2, 1, f"page {i}") for i in range(4)), (9, 2, 0, "Menu\nalone"), (10, 0, 0, None), (11, 2, 1, "page 1")]
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duckdb.sql(catalog.oracle_sql()["op8_lines"]).fetchall()) == got


@pytest.mark.parametrize("rule", tokens.RULES)
def test_line_tokens_against_offsets(spark, rule):
    rows = [*TEXTS, *((i + 1000, *r) for i, *r in sample(spark, 60)), (50, "\n\n\n  \nx\n", "en", "a")]
    library = Tokenizer.from_file(tokenizer())
    want = Counter()
    for i, t, *_ in rows:
        text = t or ""
        spans = library.encode(text, add_special_tokens=False).ids
        sizes = [len(library.decode([x]).encode()) for x in spans]
        cuts, at = [0], 0
        for line in text.encode().split(b"\n")[:-1]:
            at += len(line) + 1
            cuts.append(at)
        if len(cuts) > 1 and cuts[-1] == len(text.encode()):
            cuts.pop()
        if "�" in "".join(library.decode([x]) for x in spans):
            continue  # a token that holds part of a character has no text of its own to measure here
        counts, at = Counter({k: 0 for k in range(len(cuts))}), 0
        for n in sizes:
            inside = Counter(max(k for k, c in enumerate(cuts) if c <= b) for b in range(at, at + n))
            first, last = min(inside), max(inside)
            most = max(inside.items(), key=lambda x: (x[1], -x[0]))[0]
            counts[{"start": first, "end": last, "most": most}[rule]] += 1
            at += n
        for k, n in counts.items():
            want[(i, k, n)] += 1
    known = {i for i, *_ in want}
    got = Counter((r.doc_id, r.section, r.n_tokens) for r in tokens.count_lines(documents(spark, rows), tokenizer(), rule=rule).collect() if r.doc_id in known)
    assert got == want


def test_line_spans_cover_the_text(spark):
    by = defaultdict(list)
    for r in tokens.count_lines(documents(spark), tokenizer()).collect():
        by[r.doc_id].append(r)
    for i, t, *_ in TEXTS:
        if i != 7:
            spans = sorted((r.char_start, r.char_end) for r in by[i])
            assert spans[0][0] == 0 and spans[-1][1] == len(t or "") and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    with pytest.raises(ValueError):
        tokens.count_lines(documents(spark), tokenizer(), rule="half")


def test_fields_add_up(spark):
    docs = documents(spark)
    library = Tokenizer.from_file(tokenizer())
    total = Counter()
    for r in tokens.count_fields(docs, tokenizer(), ["lang", "text", "source"]).collect():
        total[r.doc_id] += r.n_tokens
    want = Counter()
    for i, t, lang, src in TEXTS:
        want[i] += len(library.encode("\n".join(x or "" for x in (lang, t, src)), add_special_tokens=False).ids)
    assert total == want
    assert tokens.count_lines(documents(spark, []), tokenizer()).count() == 0


TURNS = [
    (0, 0, "user", "Hi"), (0, 1, "assistant", "Hello"), (0, 2, "user", "Bye"), (0, 3, "assistant", "So long"),
    (1, 0, "user", "Hi"), (1, 1, "assistant", "Hello"), (1, 2, "user", "Bye"), (1, 3, "assistant", "No"),
    (2, 0, "user", "Hi"), (3, 0, "user", "Hi"), (3, 1, "assistant", None), (3, None, "system", "s"),
    (4, 0, "user", "alone"), (None, 0, "user", "nobody"), (6, 0, None, "x"), (6, 0, None, "x"), (7, 5, None, "x"),
]


def test_preference_pairs(spark):
    table = spark.createDataFrame([(*t, 9) for t in TURNS], "conv_id long, turn long, role string, text string, pair long")
    got = {r.pair_id: r for r in prefs.format_pairs(table).collect()}
    assert set(got) == {0, 1, 3}
    first = got[0]
    assert first.n_prefix == 3 and first.prompt == "<|user|>\nHi\n<|assistant|>\nHello\n<|user|>\nBye\n"
    assert first.chosen == "<|assistant|>\nSo long\n" and first.rejected == "<|assistant|>\nNo\n"
    a, b = map(int, first.chosen_mask.split("-"))
    assert first.chosen[a:b] == "So long"
    assert got[1].n_prefix == 0 and got[1].prompt == "" and got[1].chosen_mask == "" and got[1].rejected_mask
    assert got[3].n_prefix == 1 and got[3].rejected == ""
    assert prefs.format_pairs(table.where("conv_id > 90")).count() == 0


def test_preference_sql(spark, tmp_path):
    table = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", table.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    answer = con.execute(prefs.SQL)
    names = [c[0] for c in answer.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in sorted(names))) for r in answer.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(names))) for r in prefs.format_pairs(table).collect()) == want


def test_registered_queries():
    names = list(catalog.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(catalog.oracle_sql()) <= set(names)
