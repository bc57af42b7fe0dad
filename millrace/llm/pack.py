"""Packing: cutting-stock column generation over the histogram of remainder lengths.

``pack`` cuts every document's ids (its tokens, then the end id 0) into full sequences and one remainder.
Remainders fall into length classes ``width`` tokens wide.  A linear program over patterns (how many of
each class share one sequence) is solved by revised simplex; a knapsack dynamic program prices new
patterns.  A second kind of column cuts a remainder at its highest power of two, whose head then stands
alone without padding.  Rounded-down patterns are laid over the documents ranked in each class; what
rounding leaves (a few pieces for each class) is packed first-fit decreasing.

Only the histogram (``capacity / width`` counts) and the plan made from it live on the driver.  Ranks
come from counts by task and class, so no class, however common, meets in one task.

Defined results: a null text counts as empty and yields one piece of one token; a null or repeated
``doc_id`` is carried along, as each row is packed by itself; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._bpe import encoder
from millrace.llm._scratch import small_batches, written

#: Sequences' length.
CAPACITY = 1024
#: Tokens of one length class.
WIDTH = 8
#: The linear program stops within this share of the room that the tokens need without any padding.
GAP = 0.01
#: Cost of cutting a remainder, in sequences, besides the head's own room.
CUT_COST = 0.02


def head_of(r: np.ndarray) -> np.ndarray:
    """The highest power of two that is less than r, 0 for r of 1."""
    r = np.asarray(r, dtype=np.int64)
    out = np.zeros_like(r)
    for p in range(0, 40):
        out = np.where(r > (1 << p), 1 << p, out)
    return out


@dataclass
class Plan:
    """Where the ranked pieces of each class go."""

    n_class: int
    cut: np.ndarray  # by class: its first so many ranks are cut
    stay: np.ndarray  # by class: how many remainders stay whole
    tail_base: np.ndarray  # by class: rank, in the tail's class, of the first tail
    cut_base: np.ndarray  # by class: number of the first head's sequence among heads
    lo: list[np.ndarray]  # by class: first rank of each segment
    per: list[np.ndarray]  # pieces of the class in each sequence of the segment
    bin0: list[np.ndarray]  # first sequence of the segment
    bins: int
    cuts: int
    loose: list[np.ndarray]  # by class: sequences of the pieces after all segments

    def sequence(self, cls: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(cls), dtype=np.int64)
        for c in np.unique(cls).tolist():
            at = np.flatnonzero(cls == c)
            r = rank[at]
            seg = np.searchsorted(self.lo[c], r, side="right") - 1
            total = self.lo[c][-1]
            loose = r >= total
            ok = ~loose
            out[at[ok]] = self.bin0[c][seg[ok]] + (r[ok] - self.lo[c][seg[ok]]) // self.per[c][seg[ok]]
            out[at[loose]] = self.loose[c][r[loose] - total]
        return out


def knapsack(value: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of items within the capacity."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(weight, kind="stable")
    w, v = weight[order], value[order]
    upto = np.searchsorted(w, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            got = best[c - w[:n]] + v[:n]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], pick[c] = got[j], j
    counts, c = np.zeros(len(value), dtype=np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= w[pick[c]]
    return float(best[capacity]), counts


def solve(demand: np.ndarray, weight: np.ndarray, capacity: int, cut_cost: np.ndarray, cut_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, their levels, and for each column the row that it cuts (-1: a pattern).

    Minimizes sequences used so that every row's demand is met.  ``cut_to``: the row that the tail of a
    cut piece joins, -1 where there is no tail to place, -2 where the row can't be cut.
    """
    m = len(demand)
    start = np.maximum(1, capacity // weight)
    columns = [np.eye(m, dtype=float)[i] * start[i] for i in range(m)]
    cuts = [-1] * m
    inverse = np.diag(1.0 / start)
    cost = np.ones(m)
    basis = list(range(m))
    level = inverse @ demand
    bound = float(demand @ weight) / capacity  # no padding at all
    for step in range(20 * m + 200):
        y = cost @ inverse
        price, counts = knapsack(np.maximum(y, 0), weight, capacity)
        cut_price = np.where(cut_to > -2, y - np.where(cut_to >= 0, y[np.maximum(cut_to, 0)], 0) - cut_cost, -1.0)
        now = float(cost @ level)
        if (price <= 1 + 1e-7 and cut_price.max(initial=0) <= 1e-7) or now - bound <= GAP * now:
            break
        if cut_price.max(initial=0) > price - 1:
            row = int(cut_price.argmax())
            column, c, kind = np.zeros(m), float(cut_cost[row]), row
            column[row] += 1
            if cut_to[row] >= 0:
                column[cut_to[row]] -= 1
        else:
            column, c, kind = counts.astype(float), 1.0, -1
        move = inverse @ column
        ratio = np.where(move > 1e-9, level / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        inverse[out] /= move[out]
        others = move.copy()
        others[out] = 0
        inverse -= others[:, None] * inverse[out]
        columns.append(column)
        cuts.append(kind)
        basis[out], cost[out] = len(columns) - 1, c
        level = np.maximum(inverse @ demand, 0)
    return np.array([columns[b] for b in basis]), level, np.array([cuts[b] for b in basis])


def make_plan(histogram: np.ndarray, capacity: int = CAPACITY, width: int = WIDTH) -> Plan:
    """histogram[k]: remainders of class k, that is of (k - 1) * width + 1 to k * width tokens; [0] is unused."""
    n = capacity // width
    count = np.zeros(n + 1, dtype=np.int64)
    count[1 : len(histogram)] = histogram[1:]
    have = np.flatnonzero(count)
    longest = have * width
    tail = np.where(head_of(longest - width + 1) == head_of(longest), -(-(longest - head_of(longest)) // width), -1)
    rows = np.unique(np.concatenate([have, tail[tail > 0]])).astype(np.int64)
    empty = [np.zeros(1, np.int64) for _ in range(n + 1)]
    plan = Plan(n, np.zeros(n + 1, np.int64), count.copy(), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), [x.copy() for x in empty], [x.copy() + 1 for x in empty], [x.copy() for x in empty], 0, 0, [np.zeros(0, np.int64) for _ in range(n + 1)])
    if not len(have):
        return plan
    row_of = {int(k): i for i, k in enumerate(rows)}
    demand = count[rows].astype(float)
    cut_to, cut_cost = np.full(len(rows), -2), np.zeros(len(rows))
    for k, t in zip(have.tolist(), tail.tolist(), strict=True):
        if t > 0:
            cut_to[row_of[k]] = row_of[t]
            cut_cost[row_of[k]] = head_of(k * width) / capacity + CUT_COST
    columns, level, cuts = solve(demand, rows.copy(), n, cut_cost, cut_to)
    whole = np.floor(level + 1e-6).astype(np.int64)
    for i in np.flatnonzero((cuts >= 0) & (whole > 0)).tolist():
        k = int(rows[cuts[i]])
        plan.cut[k] = min(whole[i], count[k])
    tails = np.zeros(n + 1, dtype=np.int64)
    for k in np.flatnonzero(plan.cut).tolist():
        t = int(rows[cut_to[row_of[k]]])
        plan.tail_base[k] = count[t] - plan.cut[t] + tails[t]
        tails[t] += plan.cut[k]
    plan.cut_base = np.cumsum(plan.cut) - plan.cut
    plan.cuts = int(plan.cut.sum())
    plan.stay = count - plan.cut
    supply = plan.stay + tails
    lo: list[list[int]] = [[0] for _ in range(n + 1)]
    per: list[list[int]] = [[] for _ in range(n + 1)]
    bin0: list[list[int]] = [[] for _ in range(n + 1)]
    for i in np.flatnonzero((cuts < 0) & (whole > 0)).tolist():
        for j in np.flatnonzero(columns[i]).tolist():
            k, a = int(rows[j]), int(columns[i][j])
            lo[k].append(lo[k][-1] + a * int(whole[i]))
            per[k].append(a)
            bin0[k].append(plan.bins)
        plan.bins += int(whole[i])
    loose: list[list[int]] = [[] for _ in range(n + 1)]
    room: list[int] = []  # left in each sequence opened here
    for k in range(n, 0, -1):
        for _ in range(int(max(0, supply[k] - lo[k][-1]))):
            at = next((i for i, r in enumerate(room) if r >= k), None)
            if at is None:
                room.append(n)
                at = len(room) - 1
            room[at] -= k
            loose[k].append(plan.bins + at)
    plan.bins += len(room)
    plan.lo = [np.array(x, np.int64) for x in lo]
    plan.per = [np.array([*x, 1], np.int64) for x in per]
    plan.bin0 = [np.array([*x, 0], np.int64) for x in bin0]
    plan.loose = [np.array(x, np.int64) for x in loose]
    return plan


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    seen = np.zeros(capacity // width + 1, dtype=np.int64)
    enc = encoder(path)
    for batch in batches:
        ids_of = batch.column(0)
        for lo, hi, _, _, ids, at in enc.encode(batch.column(1)):
            n = hi - lo
            flat = np.zeros(len(ids) + n, dtype="<u4")
            flat[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(at))] = ids
            ends = at[1:] + np.arange(1, n + 1)
            begins = np.concatenate([[0], ends[:-1]])
            total = ends - begins
            full = total // capacity
            rest = total - full * capacity
            view = memoryview(flat.tobytes())
            rows: list[tuple] = []
            heads = head_of(rest)
            for i, (b, e, f, r, h) in enumerate(zip(begins.tolist(), ends.tolist(), full.tolist(), rest.tolist(), heads.tolist(), strict=True)):
                for j in range(f):
                    p = b + j * capacity
                    rows.append((i, j * capacity, capacity, zlib.crc32(view[4 * p : 4 * (p + capacity)]), 0, 0, 0, int(seen[0])))
                    seen[0] += 1
                if r:
                    p, k = e - r, -(-r // width)
                    rows.append((i, f * capacity, r, zlib.crc32(view[4 * p : 4 * e]), zlib.crc32(view[4 * p : 4 * (p + h)]), zlib.crc32(view[4 * (p + h) : 4 * e]), k, int(seen[k])))
                    seen[k] += 1
            i, start, length, crc, crc_head, crc_tail, cls, local = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(i + lo)), *(pa.array(x) for x in (start, length, crc, crc_head, crc_tail, total[i], cls, np.full(len(i), part), local))], schema=schema)


def _assign(batches: Iterator[pa.RecordBatch], plan: Plan, fulls: int, width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, start, length, crc, head_crc, tail_crc, total, cls, rank = (batch.column(i) for i in range(9))
        start, length, crc, head_crc, tail_crc, total, cls, rank = (x.to_numpy() for x in (start, length, crc, head_crc, tail_crc, total, cls, rank))
        out = []
        full = np.flatnonzero(cls == 0)
        out.append((full, start[full], length[full], crc[full], rank[full], np.zeros(len(full), np.int64), np.zeros(len(full), bool)))
        cut = np.flatnonzero((cls > 0) & (rank < plan.cut[cls]))
        if len(cut):
            h, k = head_of(length[cut]), cls[cut]
            out.append((cut, start[cut], h, head_crc[cut], fulls + plan.bins + plan.cut_base[k] + rank[cut], np.zeros(len(cut), np.int64), np.zeros(len(cut), bool)))
            # a cut class has one head length, so its tails are no longer than the class planned for them
            planned = -(-(k * width - head_of(k * width)) // width)
            r = plan.tail_base[k] + rank[cut]
            out.append((cut, start[cut] + h, length[cut] - h, tail_crc[cut], fulls + plan.sequence(planned, r), (planned << 32) + r, np.ones(len(cut), bool)))
        stay = np.flatnonzero((cls > 0) & (rank >= plan.cut[cls]))
        r = rank[stay] - plan.cut[cls[stay]]
        out.append((stay, start[stay], length[stay], crc[stay], fulls + plan.sequence(cls[stay], r), (cls[stay] << 32) + r, np.ones(len(stay), bool)))
        at, a, n, c, seq, slot, shared = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(x) for x in (a, n, c, total[at], seq, slot, shared))], schema=schema)


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a byte-level BPE file of the tokenizers library.  ``capacity`` must be a multiple of ``width``.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    long = T.LongType()
    pieces_type = T.StructType([T.StructField(id_col, kind), *(T.StructField(x, long) for x in ("start", "length", "crc", "head_crc", "tail_crc", "doc_tokens", "cls", "part", "local"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(pieces_type)
    cut = docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _cut(it, tokenizer, capacity, width, arrow), pieces_type)
    cut = written(cut, "pack")
    by_part = cut.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity // width + 1, dtype=np.int64)
    for row in by_part.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # one row for each length class
        histogram[row["cls"]] = row["n"]
    fulls = int(histogram[0])
    plan = make_plan(histogram, capacity, width)
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "cls", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "cls"]).select(id_col, "start", "length", "crc", "head_crc", "tail_crc", "doc_tokens", "cls", (F.col("base") + F.col("local")).alias("rank"))
    placed_type = T.StructType([T.StructField(id_col, kind), *(T.StructField(x, long) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot")), T.StructField("shared", T.BooleanType())])
    placed_arrow = to_arrow_schema(placed_type)
    placed = ranked.mapInArrow(lambda it: _assign(it, plan, fulls, width, placed_arrow), placed_type)
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(within), F.lit(0)).alias("offset"))
