"""Packing: every id in one piece, sequences gapless, little padding, and the linear program's plan."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import TEXTS, documents, sample, tokenizer
from tokenizers import Tokenizer

from millrace.llm.pack import CAPACITY, WIDTH, head_of, knapsack, make_plan, pack


def check(rows, texts):
    library = Tokenizer.from_file(tokenizer())
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        filled[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, docs in want.items():
        cut = []
        for start, length, crc, total in pieces[i]:
            match = [d for d in docs if len(d) == total and zlib.crc32(d[start : start + length].tobytes()) == crc]
            assert match
            cut.append(length)
        assert sum(cut) == sum(map(len, docs))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return [sum(n for _, n in spans) for spans in filled.values()]


def test_odd_documents(spark):
    rows = pack(documents(spark), tokenizer()).collect()
    check(rows, [(i, t) for i, t, *_ in TEXTS])


def test_little_padding(spark):
    docs = sample(spark, 1000)
    rows = pack(documents(spark, docs).repartition(5), tokenizer()).collect()
    sizes = check(rows, [(i, t) for i, t, *_ in docs])
    padding = sum(0 if n & (n - 1) == 0 else CAPACITY - n for n in sizes)
    assert padding < 0.03 * sum(sizes)


def test_empty_table(spark):
    assert pack(documents(spark, []), tokenizer()).count() == 0


def test_knapsack_against_all_multisets():
    value, weight = np.array([0.31, 0.52, 0.2, 0.9]), np.array([3, 5, 2, 8])
    best = max((a * 0.31 + b * 0.52 + c * 0.2 + d * 0.9) for a in range(5) for b in range(3) for c in range(7) for d in range(2) if 3 * a + 5 * b + 2 * c + 8 * d <= 13)
    got, counts = knapsack(value, weight, 13)
    assert got == pytest.approx(best) == pytest.approx(float(counts @ value)) and counts @ weight <= 13


@pytest.mark.parametrize("lengths", [[600] * 500, [5], [1023] * 3, list(range(1, 1024)), [512] * 10 + [700] * 90])
def test_plans_hold_their_pieces(lengths):
    r = np.array(lengths)
    k = -(-r // WIDTH)
    plan = make_plan(np.bincount(k, minlength=CAPACITY // WIDTH + 1))
    rank, seen = np.zeros(len(r), int), defaultdict(int)
    for i, c in enumerate(k.tolist()):
        rank[i], seen[c] = seen[c], seen[c] + 1
    cut = rank < plan.cut[k]
    room = np.bincount(plan.sequence(k[~cut], rank[~cut] - plan.cut[k[~cut]]), weights=r[~cut], minlength=plan.bins).astype(float)
    if cut.any():
        c = k[cut]
        tail = -(-(c * WIDTH - head_of(c * WIDTH)) // WIDTH)
        room += np.bincount(plan.sequence(tail, plan.tail_base[c] + rank[cut]), weights=r[cut] - head_of(r[cut]), minlength=plan.bins)
    assert room.max() <= CAPACITY
    if len(lengths) > 50:
        assert room.sum() > 0.93 * CAPACITY * plan.bins
