"""Stateful operators that Structured Streaming has no form of: they read and give changelogs.

Each handles one key's rows of a micro-batch at once, in arrival order (``arrival``), and gives the net change:
a micro-batch is the bundle.  Rows carry ``_row_kind``; input without it is append-only.  State that grows
with a key's values or rows is kept entry by entry in map state, under a canonical text of the entry; what is bounded
(sums, N rows, one row) in one value.  ``TopN(retract=True)`` alone keeps all of a key's rows in one value.
``ttl_ms`` lets idle state expire after its last write (the stream then needs ``time="ProcessingTime"``).
"""

from __future__ import annotations

import base64
import functools
import json
import pickle
from collections.abc import Iterator
from datetime import date
from decimal import Decimal

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.types import DELETE, INSERT, PUTS, ROW_KIND, UPDATE_AFTER, UPDATE_BEFORE

#: The row kind as ``runner.keyed`` hands it over.
KIND_IN = ROW_KIND.lstrip("_")
_BLOB = T.StructType([T.StructField("blob", T.BinaryType())])
_COUNT = T.StructType([T.StructField("count", T.LongType()), T.StructField("degree", T.LongType())])
_ENTRY = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("value", T.StringType())])
_READ = {
    "tinyint": int, "smallint": int, "int": int, "bigint": int, "float": float, "double": float, "boolean": lambda v: v == "true",
    "date": date.fromisoformat, "timestamp": pd.Timestamp, "timestamp_ntz": pd.Timestamp, "binary": base64.b64decode,
}


class Values:
    """Reads values that came as text by the types of their columns, exactly."""

    def __init__(self, types: dict[str, str], keys: list[str]):
        self.types, self.keys = types, keys

    def one(self, column: str, v):
        if not isinstance(v, str):  # a column that came as it is
            return None if v is None or v is pd.NaT else v
        kind = self.types[column]
        return Decimal(v) if kind.startswith("decimal") else _READ.get(kind, str)(v)

    def key(self, key: tuple) -> tuple:
        return tuple(self.one(c, v) for c, v in zip(self.keys, key, strict=True))


def _text_rows(batches: Iterator[pd.DataFrame], arrival: str, values: Values) -> Iterator[dict]:
    """A key's rows as they came, by arrival."""
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    frame = pd.concat(frames, ignore_index=True)
    names = frame.columns.tolist()
    rows = [dict(zip(names, (v if isinstance(v, str) or v is not None and v is not pd.NaT and v == v else None for v in row), strict=True)) for row in zip(*(frame[c].tolist() for c in names), strict=True)]
    yield from sorted(rows, key=lambda r: (r[arrival] is not None, 0 if r[arrival] is None else values.one(arrival, r[arrival])))


def _kind(row: dict) -> int:
    return int(row.get(KIND_IN) or INSERT)


def _state(handle: StatefulProcessorHandle, make: str, name: str, *types: T.StructType, ttl_ms: int | None = None):
    return getattr(handle, make)(name, *types, *([ttl_ms] if ttl_ms else []))


class Changelog(StatefulProcessor):
    """Base: rows of a key in arrival order, a pickled value as state, changes as output."""

    def __init__(self, arrival: str, columns: list[str], update_before: bool = True, ttl_ms: int | None = None):
        self.arrival, self.columns, self.update_before, self.ttl_ms = arrival, columns, update_before, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = _state(handle, "getValueState", "value", _BLOB, ttl_ms=self.ttl_ms)

    def load(self, default):
        got = self.state.get() if self.state.exists() else None
        return pickle.loads(bytes(got[0])) if got is not None else default

    def save(self, value) -> None:
        self.state.update((pickle.dumps(value),))

    def rows(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, dict]]:
        for row in _text_rows(batches, self.arrival, self.values):
            yield _kind(row), {c: self.values.one(c, v) for c, v in row.items() if c != KIND_IN}

    def out(self, changes: list[tuple[int, tuple]]) -> Iterator[pd.DataFrame]:
        if changes:
            frame = pd.DataFrame([row for _, row in changes], columns=self.columns, dtype=object)
            frame.insert(0, ROW_KIND, [kind for kind, _ in changes])
            yield frame

    def move(self, before: tuple | None, after: tuple | None) -> list[tuple[int, tuple]]:
        if before == after:
            return []
        if before is None:
            return [(INSERT, after)]
        if after is None:
            return [(DELETE, before)]
        return ([(UPDATE_BEFORE, before)] if self.update_before else []) + [(UPDATE_AFTER, after)]

    def close(self) -> None:
        pass


class GroupAggregate(Changelog):
    """COUNT(*), COUNT, SUM, truncating AVG, MIN, MAX, COUNT DISTINCT and SUM DISTINCT per key, with retraction.

    aggregates: (kind, column) pairs.  MIN, MAX and the distinct ones count each value in map state; only when
    the present extreme goes are the values read again.
    """

    def __init__(self, keys: list[str], aggregates: list[tuple[str, str | None]], names: list[str], arrival: str, **options):
        super().__init__(arrival, [*keys, *names], **options)
        self.keys, self.aggregates = keys, aggregates

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = _state(handle, "getMapState", "values", _ENTRY, T.StructType([T.StructField("n", T.LongType())]), ttl_ms=self.ttl_ms)

    def result(self, key: tuple, state) -> tuple | None:
        rows, cells = state
        if rows <= 0:
            return None
        out = []
        for (kind, _), (n, total) in zip(self.aggregates, cells, strict=True):
            if kind in ("count", "count_distinct"):
                out.append(n)
            elif kind == "avg":
                out.append(None if not n else abs(total) // n * (1 if total >= 0 else -1))
            else:  # a sum, an extreme
                out.append(total if n else None)
        return (*key, *out)

    def entry(self, i: int, column: str, text: str, w: int) -> int:
        """Counts a value; 1 or -1 as it comes or goes, else 0."""
        at = (i, text)
        was = int(self.seen.getValue(at)[0]) if self.seen.containsKey(at) else 0
        if was + w > 0:
            self.seen.updateValue(at, (was + w,))
        elif was:
            self.seen.removeKey(at)
        return int(was <= 0 < was + w) - int(was + w <= 0 < was)

    def extreme(self, i: int, column: str, pick):
        return pick((self.values.one(column, k[1]) for k in self.seen.keys() if int(k[0]) == i), default=0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        key = self.values.key(key)
        state = self.load([0, [[0, 0] for _ in self.aggregates]])
        before = self.result(key, state)
        for row in _text_rows(rows, self.arrival, self.values):
            w = 1 if _kind(row) in PUTS else -1
            state[0] += w
            for i, ((name, column), cell) in enumerate(zip(self.aggregates, state[1], strict=True)):
                text = "1" if column is None else row[column]
                if text is None:
                    continue
                x = None if column is None else self.values.one(column, text)
                if name in ("min", "max", "count_distinct", "sum_distinct"):
                    moved = self.entry(i, column, text, w)
                    cell[0] += moved
                    pick = min if name == "min" else max
                    if name == "sum_distinct":
                        cell[1] += moved * x
                    elif name != "count_distinct" and moved:
                        if moved > 0:
                            cell[1] = x if cell[0] == 1 else pick(x, cell[1])
                        elif x == cell[1]:
                            cell[1] = self.extreme(i, column, pick)
                else:
                    cell[0] += w
                    cell[1] += w * x if name in ("sum", "avg") else 0
        if state[0] <= 0:
            self.state.clear()
            self.seen.clear()
        else:
            self.save(state)
        yield from self.out(self.move(before, self.result(key, state)))


@functools.total_ordering
class _Reversed:
    """Orders values of any type the other way round."""

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        return self.v == other.v

    def __lt__(self, other):
        return other.v < self.v


class TopN(Changelog):
    """The first n rows of each key; ``order``: (column, ascending) pairs, ties in arrival order.

    With a rank column, changed ranks are updates; without, rows come and go.  An append-only input needs
    n rows of state; with ``retract`` all rows are kept, so that the next one can move up.
    """

    def __init__(self, order: list[tuple[str, bool]], n: int, columns: list[str], arrival: str, *, rank: str | None = None, retract: bool = False, **options):
        super().__init__(arrival, [*columns, *([rank] if rank else [])], **options)
        self.order, self.n, self.rank, self.retract, self.row_columns = order, n, rank, retract, columns

    def sort_key(self, item: tuple[dict, int]):
        row, seq = item
        out = []
        for column, ascending in self.order:
            v = row[column]
            out.append((v is not None) if ascending else (v is None))  # NULLs first ascending, last descending
            out.append(0 if v is None else v if ascending else _Reversed(v))
        return (*out, seq)

    def top(self, held: list) -> list[tuple]:
        return [tuple(row[c] for c in self.row_columns) + ((i + 1,) if self.rank else ()) for i, (row, _) in enumerate(held[: self.n])]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, seq = self.load(([], 0))
        before = self.top(held)
        for kind, row in self.rows(rows):
            kept = {c: row[c] for c in {*self.row_columns, *(c for c, _ in self.order)}}
            if kind in PUTS:
                held.append((kept, seq))
                seq += 1
            else:
                at = next((i for i, (r, _) in enumerate(held) if r == kept), None)
                if at is not None:
                    del held[at]
        held.sort(key=self.sort_key)
        self.save((held if self.retract else held[: self.n], seq))
        after = self.top(held)
        if self.rank:
            moves = [m for i in range(max(len(before), len(after))) for m in self.move(before[i] if i < len(before) else None, after[i] if i < len(after) else None)]
        else:
            gone, come = list(before), []
            for row in after:
                if row in gone:
                    gone.remove(row)
                else:
                    come.append(row)
            moves = [(DELETE, r) for r in gone] + [(INSERT, r) for r in come]
        yield from self.out(moves)


class KeepLast(Changelog):
    """Deduplication that keeps the row of the greatest time (arrival if None); ties go to the later arrival."""

    def __init__(self, time: str | None, columns: list[str], arrival: str, *, first: bool = False, **options):
        super().__init__(arrival, columns, **options)
        self.time, self.first = time, first

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.load(None)
        before = held[1] if held else None
        for _, row in self.rows(rows):
            t = row[self.time] if self.time else 0
            better = held is None or (self.time is not None and t < held[0] if self.first else t >= held[0])
            if better:
                held = (t, tuple(row[c] for c in self.columns))
        self.save(held)
        yield from self.out(self.move(before, held[1]))


class Normalize(Changelog):
    """An upsert stream as a regular changelog: every change in order, unchanged rows left out."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.load(None), []
        for kind, row in self.rows(rows):
            now = tuple(row[c] for c in self.columns) if kind in PUTS else None
            out += self.move(held, now)
            held = now
        if held is None:
            self.state.clear()
        else:
            self.save(held)
        yield from self.out(out)


class Over(Changelog):
    """Running aggregates per key in time order: over ``rows`` preceding ones, over those within ``interval`` before (in the units of
    ``time``), or over everything before.

    aggregates: (kind, name) pairs of sum, count, min, max, first_value, last_value, count_distinct.  Append-only
    input in time order within and across batches; gives one row per input row.  With an interval, rows of the same time
    in a micro-batch are peers.
    """

    def __init__(self, value: str, columns: list[str], arrival: str, *, rows: int | None = None, interval: int | None = None, time: str | None = None, names: tuple[str, str] = ("s", "n"), aggregates: list[tuple[str, str]] | None = None):
        self.aggregates = aggregates or [("sum", names[0]), ("count", names[1])]
        super().__init__(arrival, [*columns, *(n for _, n in self.aggregates)])
        self.value, self.row_columns, self.preceding, self.interval, self.time = value, columns, rows, interval, time
        self.folded = rows is None and interval is None

    def result(self, held: list) -> list:
        some = [v for _, v in held if v is not None]
        of = {
            "sum": lambda: sum(some) if some else None, "count": lambda: len(some), "min": lambda: min(some, default=None), "max": lambda: max(some, default=None),
            "first_value": lambda: held[0][1], "last_value": lambda: held[-1][1], "count_distinct": lambda: len(set(some)),
        }
        return [of[kind]() for kind, _ in self.aggregates]

    def fold(self, held: dict, x) -> list:
        """Everything before in bounded state, but for the values of COUNT DISTINCT."""
        if not held:
            held |= {"sum": None, "count": 0, "min": None, "max": None, "first_value": x}
        held["last_value"] = x
        if x is not None:
            held["count"] += 1
            for kind, pick in (("sum", lambda a: a + x if held["count"] > 1 else x), ("min", lambda a: min(a, x) if a is not None else x), ("max", lambda a: max(a, x) if a is not None else x)):
                if kind in (k for k, _ in self.aggregates):
                    held[kind] = pick(held[kind])
            if "count_distinct" in (k for k, _ in self.aggregates):
                held.setdefault("values", set()).add(x)
        return [len(held.get("values", ())) if kind == "count_distinct" else held[kind] for kind, _ in self.aggregates]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.load({} if self.folded else []), []
        batch = [row for _, row in self.rows(rows)]
        for i, row in enumerate(batch):
            x = row[self.value]
            if self.folded:
                result = self.fold(held, x)
            elif self.interval is None:
                held = [*held, (0, x)][-(self.preceding + 1) :]
                result = self.result(held)
            else:
                now = row[self.time]
                if not i or batch[i - 1][self.time] != now:
                    held = [h for h in held if h[0] >= now - self.interval] + [(now, r[self.value]) for r in batch[i:] if r[self.time] == now]
                result = self.result(held)
            out.append((INSERT, (*(row[c] for c in self.row_columns), *result)))
        self.save(held)
        yield from self.out(out)


class UpdatingJoin(StatefulProcessor):
    """Regular join of two changelogs that meet by key; ``_side`` 0 is left, 1 right.

    how: inner, left, right, full, semi or anti.  Each different row of a side is a state entry with its count, and for
    outer sides its degree (how many rows it matches), so padding comes and goes as matches do.  A side is read as a whole
    only when the other one changes.  ttl_ms: for each side, how long an entry lives after its last write.
    """

    def __init__(self, left: list[str], right: list[str], how: str, arrival: str, ttl_ms: tuple[int | None, int | None] = (None, None)):
        self.left, self.right, self.how, self.arrival, self.ttl_ms = left, right, how, arrival, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = [_state(handle, "getMapState", name, _BLOB, _COUNT, ttl_ms=ttl) for name, ttl in zip(("left", "right"), self.ttl_ms, strict=True)]

    @staticmethod
    def _name(row: tuple) -> tuple[bytes]:
        return (json.dumps(row).encode(),)  # of texts and NULLs: equal rows, equal bytes

    def _all(self, side: int, held: dict) -> dict[tuple, list[int]]:
        """Adds the side's stored rows to those that this batch has touched."""
        for k, v in self.sides[side].iterator():
            held.setdefault(tuple(json.loads(bytes(k[0]))), [int(v[0]), int(v[1])])
        return held

    def _cell(self, side: int, row: tuple, held: dict) -> list[int]:
        if row not in held:
            name = self._name(row)
            held[row] = [int(x) for x in self.sides[side].getValue(name)] if self.sides[side].containsKey(name) else [0, 0]
        return held[row]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, whole, touched = [{}, {}], [False, False], [set(), set()]
        padded = [self.how in ("left", "full"), self.how in ("right", "full")]
        nulls = [(None,) * len(self.left), (None,) * len(self.right)]
        matchable = all(k is not None and k == k for k in key)
        net: dict[tuple, int] = {}

        def give(a: tuple, b: tuple, n: int) -> None:
            net[(a, b)] = net.get((a, b), 0) + n

        for row in _text_rows(rows, self.arrival, self.values):
            side = int(row["side"])
            w = 1 if _kind(row) in PUTS else -1
            mine = tuple(row[c] for c in (self.left, self.right)[side])
            if matchable and not whole[1 - side]:
                self._all(1 - side, held[1 - side])
                whole[1 - side] = True
            others = {o: c for o, c in held[1 - side].items() if c[0]} if matchable else {}
            degree = sum(c for c, _ in others.values())
            cell = self._cell(side, mine, held[side])
            cell[0] += w
            cell[1] = degree
            touched[side].add(mine)
            pair = (lambda x, y: (x, y)) if side == 0 else (lambda x, y: (y, x))
            if self.how in ("semi", "anti"):
                if side == 0:
                    if (degree > 0) == (self.how == "semi"):
                        give(mine, (), w)
                else:
                    for other, o in others.items():
                        was, o[1] = o[1], o[1] + w
                        touched[0].add(other)
                        if (was > 0) != (o[1] > 0):
                            give(other, (), o[0] * (1 if (o[1] > 0) == (self.how == "semi") else -1))
            else:
                for other, o in others.items():
                    give(*pair(mine, other), w * o[0])
                    was, o[1] = o[1], o[1] + w
                    touched[1 - side].add(other)
                    if padded[1 - side] and (was > 0) != (o[1] > 0):
                        give(*pair(nulls[side], other), o[0] * (1 if was > 0 else -1))
                if padded[side] and degree == 0:
                    give(*pair(mine, nulls[1 - side]), w)
        for side in (0, 1):
            for row in touched[side]:
                if held[side][row][0]:
                    self.sides[side].updateValue(self._name(row), tuple(held[side][row]))
                elif self.sides[side].containsKey(self._name(row)):
                    self.sides[side].removeKey(self._name(row))
        columns = self.left if self.how in ("semi", "anti") else [*self.left, *self.right]
        read = lambda row: tuple(self.values.one(c, v) for c, v in zip(columns, row, strict=True))
        out = [(DELETE if n < 0 else INSERT, *read((*a, *b))) for (a, b), n in net.items() for _ in range(abs(n))]
        if out:
            yield pd.DataFrame(out, columns=[ROW_KIND, *columns], dtype=object)

    def close(self) -> None:
        pass


class TemporalJoin(StatefulProcessor):
    """Probes (``_side`` 1) with the latest version (``_side`` 0) at or before their time ``_ms``.

    Versions are kept by time, the last arrival at a time winning.  Probes wait until the watermark has passed
    their time, so that versions that come late but in time count; then versions before the last one used go.
    """

    def __init__(self, probe: list[str], version: list[str], how: str, arrival: str):
        self.probe, self.version, self.how, self.arrival = probe, version, how, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        time = T.StructType([T.StructField("ms", T.LongType())])
        self.versions = handle.getMapState("versions", time, _BLOB)
        self.waiting = handle.getMapState("waiting", time, _BLOB)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for text in _text_rows(rows, self.arrival, self.values):
            row = {c: self.values.one(c, v) for c, v in text.items()}
            at, seq = (row["ms"],), row[self.arrival]
            if row["side"] == 0:
                held = pickle.loads(bytes(self.versions.getValue(at)[0])) if self.versions.containsKey(at) else None
                if held is None or held[0] <= seq:
                    self.versions.updateValue(at, (pickle.dumps((seq, None if _kind(text) not in PUTS else tuple(row[c] for c in self.version))),))
            else:
                held = pickle.loads(bytes(self.waiting.getValue(at)[0])) if self.waiting.containsKey(at) else []
                self.waiting.updateValue(at, (pickle.dumps([*held, tuple(row[c] for c in self.probe)]),))
                self.handle.registerTimer(at[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (int(expiredTimerInfo.getExpiryTimeInMs()),)
        if not self.waiting.containsKey(at):
            return
        probes = pickle.loads(bytes(self.waiting.getValue(at)[0]))
        self.waiting.removeKey(at)
        times = sorted(int(k[0]) for k in self.versions.keys() if int(k[0]) <= at[0])
        found = pickle.loads(bytes(self.versions.getValue((times[-1],))[0]))[1] if times else None
        for old in times[:-1]:
            self.versions.removeKey((old,))
        if found is None and self.how == "inner":
            return
        yield pd.DataFrame([(*p, *(found or (None,) * len(self.version))) for p in probes], columns=[*self.probe, *self.version], dtype=object)

    def close(self) -> None:
        pass
