"""The Jaccard join against all pairs."""

import hashlib
import random
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, TEXTS, documents, sample, shingle_set

from millrace.llm import neardup


def plain(rows):
    """{(id, text): (class, links)} by comparing all different texts."""
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(t, []).append(i)
    texts = list(ids)
    sets = [shingle_set(t) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, t in enumerate(texts):
        some = [i for i in ids[t] if i is not None]
        least[find(k)] = min([*some, *([least[find(k)]] if find(k) in least else [])], default=None)
    return {(i, t): (least[find(k)] if t else i, links[k]) for k, t in enumerate(texts) for i in ids[t]}


def compare(spark, rows, **options):
    want = plain(rows)
    got = neardup.join(documents(spark, rows).repartition(3), **options).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *want[(i, t)]) for i, t, *_ in rows)


def test_odd_documents(spark):
    compare(spark, TEXTS)


def variants(n, seed=0):
    """Groups of near copies with a few words changed, and copies of some."""
    rnd, out = random.Random(seed), []
    for g in range(4):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(120)]
        for _ in range(n):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(len(w))] = f"c{rnd.randrange(10**6)}"
            out.append(" ".join(w))
    return [(100 + i, t, "en", "a") for i, t in enumerate(out + out[::7])]


@pytest.mark.parametrize("options", [{}, {"block": 500}, {"cost": 2000}])
def test_near_copies(spark, options):
    compare(spark, variants(25), **options)


def short(n):
    """Texts of 1 to 16 words, near copies among them."""
    rnd, out = random.Random(5), []
    for g in range(n):
        w = [f"s{g}w{i}" for i in range(rnd.randrange(1, 16))]
        out += [w, [*w, "x"], ["y", *w], w[1:], [*w[:-1], "z"]]
    return [(i, " ".join(w), "en", "a") for i, w in enumerate(out)]


def test_short_texts(spark):
    compare(spark, short(60))


def test_an_id_beside_several_texts_and_rows_without_id(spark):
    a, b, c = (t for _, t, *_ in variants(1)[:3])
    near = a + " and more"
    compare(spark, [(1, a, "en", "a"), (5, a, "en", "a"), (5, b, "en", "a"), (9, b, "fr", "b"), (9, b, "fr", "b"), (None, near, None, None), (None, c, None, None), (None, c + " end", None, None)])


def test_generated_documents(spark):
    compare(spark, sample(spark, 400))


def stays(rows):
    """Of each class one (id, text): the least id, None last, then the least digest."""
    want = plain(rows)
    sets = {t: shingle_set(t) for _, t, *_ in rows}
    groups = {}
    for i, t, *_ in rows:
        same = min((u or "" for _, u, *_ in rows if sets[u] == sets[t] and (sets[t] or u == t)), default="") if t else ""
        groups.setdefault((want[(i, t)][0], None) if t and want[(i, t)][0] is not None else (None, same), set()).add((i, t))
    order = lambda x: (x[0] is None, x[0] or 0, x[1] is not None, hashlib.md5((x[1] or "").encode()).digest())
    return sorted((min(g, key=order) for g in groups.values()), key=str)


@pytest.mark.parametrize("rows", [[*variants(6), *TEXTS], [(1, "a b c d e f", "en", "a"), (5, "a b c d e f", "en", "a"), (5, "g h i", "en", "a"), (9, "g h i", "en", "a")], [(2, "one row", "en", "a")] * 3 + [(3, None, None, None), (None, "", None, None)]])
def test_one_row_of_a_class_stays(spark, rows):
    docs = documents(spark, rows)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == stays(rows)


def test_near_copies_under_one_id_cost_no_more(spark):
    """3,000 near copies that share an id, against as many with their own."""
    rnd, base = random.Random(8), [f"w{i}" for i in range(30)]
    texts = [" ".join([*base, f"c{rnd.randrange(10**9)}"]) for _ in range(3000)]
    took = []
    for one in (False, False, True):
        began = time.perf_counter()
        got = neardup.join(spark.createDataFrame([(7 if one else i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
        took.append(time.perf_counter() - began)
        assert {r.class_id for r in got} == {7 if one else 0} and {r.n_links for r in got} == {len(set(texts)) - 1}
    assert took[2] < 3 * took[1] + 5


def test_empty(spark):
    assert neardup.join(documents(spark, [])).count() == 0


def test_depth_reaches_the_recall():
    d = neardup.depth()
    assert 1 - (1 - 0.8**d) ** neardup.TREES >= neardup.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** neardup.TREES
    with pytest.raises(ValueError):
        neardup.depth(0.1, 2)


def test_depth_differs_between_texts():
    exact = Fraction(4, 5)
    depths = neardup.depths(exact, neardup.TREES, neardup.LONGEST, neardup.RECALL)
    assert depths[:4].tolist() == [0, 0, 0, 0] and neardup.least_link(3, exact) is None  # 3 of 4 is under the threshold
    assert neardup.least_link(7, exact) == Fraction(6, 7) and depths[7] == 6 > depths[6] == 5 > depths[5] == depths[-1] == neardup.depth()
    for n in range(1, 15):
        every = [Fraction(c, n + m - c) for m in range(1, 30) for c in range(1, min(n, m) + 1) if (n, m) != (c, c) and Fraction(c, n + m - c) >= exact]
        assert neardup.least_link(n, exact) == min(every, default=None)


@pytest.mark.parametrize("floor,longest", [(4, 8), (2, 3), (3, 3)])
@pytest.mark.parametrize("cut", [1, 7, 1000])
def test_matched_leaves_of_sorted_tries(floor, longest, cut):
    rng = np.random.default_rng(2)
    values = np.unique(np.column_stack([rng.integers(0, 3, (400, longest)), np.arange(400)]), axis=0)
    levels = longest - floor
    bits = neardup.tail_bits(floor, longest)
    rows = [(int("".join(map(str, v[:floor])), 4), sum(int(x) << bits * (levels - 1 - i) for i, x in enumerate(v[floor:-1])), int(v[-1]), int(rng.integers(0, 5))) for v in values.tolist()]
    rows.sort()
    depth_of = np.array([longest, floor, floor + 1 if levels else floor, longest, floor])
    table = pa.table([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.uint32()).view(pa.int32()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], names=["node", "tail", "key", "n"])
    schema = pa.schema([("node", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])
    got = {k for b in neardup._matched(iter(table.to_batches(cut)), depth_of, longest, schema) for k in b.column(1).to_pylist()}
    by_key = {int(v[-1]): tuple(v[:-1].tolist()) for v in values}
    want = {r[2] for r in rows if any(k != r[2] and by_key[k][: depth_of[r[3]]] == by_key[r[2]][: depth_of[r[3]]] for k in by_key)}
    assert got == want | {rows[0][2], rows[-1][2]}


def test_compare_is_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = {a: set(hit.tolist()) for a, hit in neardup.compare(np.concatenate(sets), at, Fraction(1, 2), None)}
    for a, x in enumerate(sets):
        want = {b for b, y in enumerate(sets) if b != a and 2 * len(np.intersect1d(x, y)) >= len(np.union1d(x, y))}
        assert got.get(a, set()) == want


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


def test_long_text_is_whole(spark):
    near = LONG + " and one more"
    compare(spark, [(1, LONG, "en", "a"), (2, near, "en", "a"), (3, near[: len(near) // 2], "en", "a")])
