"""N-gram Jaccard join: an LSH forest of sorted MinHash prefix tries, and exact verification.

Texts are sets of shingles of five words.  Each of ``TREES`` tries holds every set's leaf, ``LONGEST`` MinHash
values.  All leaves are sorted by tree and values over the whole cluster (a range shuffle, so that a node of any
size is spread out); the prefix that a leaf shares with a neighbour in that order is the longest that it
shares with any.  A set starts from these longest prefixes and shortens them, in all its tries alike, until
a link would be met with probability ``RECALL`` or more.  Where that is depends on the set: the fewer its shingles,
the fewer the similarities at the threshold or above that it can have at all, and the longer the prefix
that is enough (``depths``).  A set that no other can link with is in no trie.  Sets of over about ten shingles
can have a link at the threshold itself, so they all go down to the same ``floor`` (4 of 8 values with the
defaults), and no data shorten that.  A leaf whose longest shared prefix is shorter than its set's depth meets nothing.

No pair is ever a row.  A node's candidates meet at its *pivot*, the node's least set; a text goes once to
each of its pivots, however many nodes they share, and a task there intersects the shingle sets of all that
have met, by an inverted index.  A pair that meets at several pivots counts at the least one only.  Where a
pivot's texts hold more than ``BLOCK`` shingles, or comparing them would visit more than ``COST`` postings, they are
dealt out in blocks and every pair of blocks is a task of its own, so one group of any size is spread out.
What comes out is one row per text and pivot: how many texts it is linked with, and one edge of a spanning
forest.  Components are found by large-star and small-star rounds over those edges.

Texts are known by their MD5 digests, sets by 64-bit keys.  Equal texts, and texts with equal shingle sets,
are one class from the start and never form pairs.

Defined results: n_links counts the other *different* texts at the threshold or above.  A text of one to
four words has one shingle of them all.  A text without words is in a class with equal texts only; an
empty or null one is alone.  A row without an id links like any other; a class without any id has a null
class_id.  Repeated rows are copies, and an id that stands beside several texts is in the class of each.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._scratch import shared_dir, small_batches, written
from millrace.llm._words import mix, pieces, shingles

WORDS = 5
THRESHOLD = 0.8
TREES = 20
LONGEST = 8
RECALL = 0.9999
#: Shingles that meet in one task, in expectation; twice as many where two blocks are compared.
BLOCK = 3_000_000
#: Postings that one task visits, about: texts that meet there, times their shingles.
COST = 1 << 26


def depth(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some trie with the recall."""
    for d in range(longest, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("more trees are needed for this recall")


def least_link(n: int, threshold: Fraction) -> Fraction | None:
    """The least similarity, at the threshold or above, of a set of n shingles and a different one; None if there is none."""
    up, down = threshold.numerator, threshold.denominator
    found = []
    for m in range(-(-n * up // down), n * down // up + 1):
        both = -(-up * (n + m) // (up + down))  # the fewest shared shingles that reach the threshold
        if both <= min(n, m) and not n == m == both:
            found.append(Fraction(both, n + m - both))
    return min(found, default=None)


def depths(threshold: Fraction, trees: int, longest: int, recall: float) -> np.ndarray:
    """For sets of 0, 1, ... shingles the prefix to shorten to, 0 where nothing can link; larger sets go as the last one."""
    out = [0]
    for n in range(1, 4 * threshold.denominator):  # beyond, hardly any size misses the threshold
        low = least_link(n, threshold)
        out.append(0 if low is None else depth(float(low), trees, longest, recall))
    return np.array([*out, depth(float(threshold), trees, longest, recall)])


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1010)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distinct(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, and their offsets."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(at)))


def set_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each text's set of shingles (0 where it is empty)."""
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5)), out=sums[1:])
    n = np.diff(at).astype(np.uint64)
    return np.where(n > 0, mix(sums[at[1:]] - sums[at[:-1]] + n), np.uint64(0)).view(np.int64)


def leaves(h: np.ndarray, at: np.ndarray, trees: int, floor: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's leaf in each tree: a key of its first ``floor`` values, and the other values packed into 32 bits.

    Rows of texts without shingles mean nothing.
    """
    full = np.flatnonzero(np.diff(at))
    node, tail = np.zeros((len(at) - 1, trees), dtype=np.uint64), np.zeros((len(at) - 1, trees), dtype=np.uint32)
    if not len(full):
        return node.view(np.int64), tail.view(np.int32)
    heads = at[:-1][full]
    flip, odd = _seeds(trees * longest)
    bits = tail_bits(floor, longest)
    for t in range(trees):
        key, rest = np.full(len(full), t + 1, dtype=np.uint64), np.zeros(len(full), dtype=np.uint64)
        for j in range(longest):
            least = np.minimum.reduceat((h ^ flip[t * longest + j]) * odd[t * longest + j], heads)
            if j < floor:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            else:
                rest = rest << np.uint64(bits) | mix(least) >> np.uint64(64 - bits)
        node[full, t], tail[full, t] = key, rest.astype(np.uint32)
    return node.view(np.int64), tail.view(np.int32)


def tail_bits(floor: int, longest: int) -> int:
    """Bits of each value beyond the floor; values that agree in them by chance only add candidates."""
    return 32 // max(longest - floor, 1)


def _sign(batches: Iterator[pa.RecordBatch], words: int, trees: int, depth_of: np.ndarray, longest: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    floor = int(depth_of[-1])
    for batch in batches:
        ids, digests = batch.column(0), batch.column(2)
        for p in pieces(batch.column(1)):
            h, at = distinct(*shingles(p.hashes, p.first, words))
            n = np.diff(at)
            key = set_keys(h, at)
            some = depth_of[np.minimum(n, len(depth_of) - 1)] > 0
            node, tail = leaves(h, at, trees, floor, longest)
            digest = digests.slice(p.lo, p.hi - p.lo)
            bare = np.flatnonzero((n == 0) & (np.diff(p.bounds) > 0))
            key[bare] = [int.from_bytes(x[:8], "little", signed=True) for x in digest.take(pa.array(bare)).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum(some * trees)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(p.lo, p.hi - p.lo),
                    digest,
                    pa.array(key, mask=np.diff(p.bounds) == 0),
                    pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(node[some].reshape(-1))),
                    pa.ListArray.from_arrays(offsets, pa.array(tail[some].reshape(-1))),
                ],
                schema=schema,
            )


def _matched(batches: Iterator[pa.RecordBatch], depth_of: np.ndarray, longest: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of leaves (node, tail, key, n) in sorted order, those whose longest shared prefix reaches their set's depth.

    The first and the last leaf of a task have a neighbour elsewhere and always stay.
    """
    floor, bits = int(depth_of[-1]), tail_bits(int(depth_of[-1]), longest)

    held = None  # the last leaf so far, and how much it shares with the one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(4)]
        if held:
            rows = [np.concatenate(x) for x in zip(held[0], rows, strict=True)]
        node, tail, _, n = rows
        diff = tail.view(np.uint32)[1:] ^ tail.view(np.uint32)[:-1]
        length = np.full(len(diff), floor)
        for j in range(longest - floor):  # one more for each value on from the floor, up to the first that differs
            length += diff >> np.uint32(bits * (longest - floor - 1 - j)) == 0
        between = np.where(node[1:] == node[:-1], length, 0)
        before = np.concatenate([[held[1] if held else longest], between])
        ok = np.maximum(before[:-1], between) >= depth_of[np.minimum(n[:-1], len(depth_of) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][ok]) for x in (rows[0], rows[2], rows[3])], schema=schema)
        held = [x[-1:] for x in rows], int(before[-1])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held[0][k]) for k in (0, 2, 3)], schema=schema)


def compare(h: np.ndarray, at: np.ndarray, threshold: Fraction, side: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each text, the others at the threshold or above.  side: if given, only texts of other sides.

    Shingles that a quarter of the texts have or more are counted by matrix products, the others by their postings.
    """
    m = len(at) - 1
    size = np.diff(at)
    owner = np.repeat(np.arange(m), size)
    _, place, count = np.unique(h, return_inverse=True, return_counts=True)
    often = 4 * count >= max(m, 8)
    column = np.cumsum(often) - 1
    dense = np.zeros((m, int(often.sum())), dtype=np.float32)  # at most four entries for each shingle of a text
    dense[owner[often[place]], column[place[often[place]]]] = 1
    shared = (count[place] > 1) & ~often[place]  # what only one text has meets nothing
    place, owner = place[shared], owner[shared]
    order = np.argsort(place, kind="stable")
    posting = owner[order]
    begin = np.searchsorted(place[order], np.arange(len(count) + 1))
    mine = np.searchsorted(owner, np.arange(m + 1))
    up, down = threshold.numerator, threshold.denominator
    for lo in range(0, m, 128):
        product = dense[lo : lo + 128] @ dense.T
        for a in range(lo, min(m, lo + 128)):
            both = product[a - lo].astype(np.int64)
            own = place[mine[a] : mine[a + 1]]
            n = begin[own + 1] - begin[own]
            total = int(n.sum())
            if total:
                step = np.zeros(len(n), dtype=np.int64)
                np.cumsum(n[:-1], out=step[1:])
                both += np.bincount(posting[np.repeat(begin[own] - step, n) + np.arange(total)], minlength=m)
            hit = both * (down + up) >= up * (size[a] + size)
            hit[a] = False
            if side is not None:
                hit &= side != side[a]
            yield a, np.flatnonzero(hit)


def _meet(keys: np.ndarray, texts: pa.Array, pivots: list[list[int]], weight: np.ndarray, block: np.ndarray, pivot: int, split: bool, words: int, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, roots and numbers of links of the texts that have met in one task."""
    parts, sizes = [], []
    for p in pieces(texts):
        h, at = distinct(*shingles(p.hashes, p.first, words))
        parts.append(h)
        sizes.append(np.diff(at))
    h, at = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    m = len(keys)
    less = [[q for q in x if q < pivot] for x in pivots]
    known = {q: j for j, q in enumerate(sorted({q for x in less for q in x}))}
    member = [[] for _ in known]
    for i, x in enumerate(less):
        for q in x:
            member[known[q]].append(i)
    member = [np.array(x) for x in member]
    label, links = np.arange(m), np.zeros(m, dtype=np.int64)
    for a, hit in compare(h, at, threshold, block if split else None):
        if not len(hit):
            continue
        others = label[hit]
        if (others != label[a]).any():
            joined = np.unique(np.append(others, label[a]))
            label[np.isin(label, joined)] = joined[0]
        if less[a]:  # pairs that meet at a lesser pivot too are counted there
            new = np.ones(m, dtype=bool)
            for q in less[a]:
                new[member[known[q]]] = False
            hit = hit[new[hit]]
        links[a] = weight[hit].sum()
    root = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(root, label, keys)
    root = root[label]
    some = (links > 0) | (root != keys)
    return keys[some], root[some], links[some]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal (pivot, i, j) in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            now = tuple(key[a].tolist())
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _verify(batches: Iterator[pa.RecordBatch], words: int, threshold: Fraction, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for group in _groups(batches):
        if group.num_rows < 2:
            continue
        pivot, i, j = (group.column(k)[0].as_py() for k in range(3))
        got = _meet(group.column(3).to_numpy(), group.column(4).combine_chunks(), group.column(5).to_pylist(), group.column(6).to_numpy(), group.column(7).to_numpy(), pivot, i != j, words, threshold)
        out.append(got)
        rows += len(got[0])
        if rows > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)
            out, rows = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's least node) for every node of ``edges`` (a, b; longs).

    Large-star and small-star rounds; each is checkpointed, and rounds go on until nothing changes.
    """
    shared_dir(edges.sparkSession)

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            near = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = near.join(low, "a")
        if large:
            moved = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = None
    while True:
        now = stars(stars(now, True), False).checkpoint()
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _linked(docs: DataFrame, threshold: float, words: int, trees: int, recall: float, block: int, cost: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """id, digest, key of every row (its set's key), and key, root, class_id, n_links of every set."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    exact = Fraction(str(threshold))
    depth_of = depths(exact, trees, LONGEST, recall)
    long = T.LongType()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), _digest(F.col(text_col)).alias("digest"))
    signed_type = T.StructType([T.StructField("id", long), T.StructField("digest", T.BinaryType()), T.StructField("key", long), T.StructField("n", long), T.StructField("nodes", T.ArrayType(long)), T.StructField("tails", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(signed_type)
    signed = written(rows.mapInArrow(lambda it: _sign(it, words, trees, depth_of, LONGEST, arrow), signed_type), "signed")

    # one row per set of shingles: how many different texts have it, and the digest of one of them
    leaf = [F.first(c).alias(c) for c in ("n", "nodes", "tails")]
    texts = signed.where(F.col("key").isNotNull()).groupBy("key", "digest").agg(F.min("id").alias("id"), *leaf)
    sets = written(texts.groupBy("key").agg(F.min("id").alias("id"), F.min("digest").alias("digest"), F.count(F.lit(1)).alias("texts"), *leaf), "sets")

    # the sorted tries, and each set's pivots
    leaf_type = T.StructType([T.StructField(c, long) for c in ("node", "key", "n")])
    leaf_arrow = to_arrow_schema(leaf_type)
    each = sets.select("key", "n", F.explode(F.arrays_zip("nodes", "tails")).alias("leaf")).select("leaf.nodes", "leaf.tails", "key", "n")
    each = each.repartitionByRange("nodes", "tails", "key").sortWithinPartitions("nodes", "tails", "key")
    node = written(each.mapInArrow(lambda it: _matched(it, depth_of, LONGEST, leaf_arrow), leaf_type), "matched")
    pivot = node.groupBy("node").agg(F.min("key").alias("pivot"), F.max("key").alias("most")).where(F.col("pivot") != F.col("most")).select("node", "pivot")
    homes = written(node.join(pivot, "node").groupBy("key", "pivot").agg(F.max("n").alias("n")), "homes")
    load = homes.groupBy("pivot").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("m"))
    blocks = F.greatest(F.col("load") / block, F.sqrt(4.0 * F.col("m") * F.col("load") / cost))  # two blocks that meet hold twice as many texts and shingles
    load = load.select("pivot", F.ceil(blocks).cast("int").alias("blocks"))
    lists = homes.join(load, "pivot").groupBy("key").agg(F.collect_list(F.struct("pivot", "blocks")).alias("homes"))  # at most one for each tree
    carried = written(lists.join(sets.select("key", "digest", "texts"), "key"), "carried")
    # merged at every size: a broadcast would spare small inputs a shuffle of texts that large ones can't be spared
    once = rows.select("digest", "text").groupBy("digest").agg(F.first("text").alias("text"))  # copies are dropped before the shuffle
    met = once.join(carried.hint("merge"), "digest").select(
        "key", "text", "texts", F.transform("homes", lambda x: x["pivot"]).alias("pivots"), F.explode("homes").alias("home")
    )
    own = F.pmod(F.xxhash64("key", F.lit(3)), F.col("home.blocks")).cast("int")
    dealt = met.select("key", "text", "texts", "pivots", F.col("home.pivot").alias("pivot"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("home.blocks") - 1)).alias("other"))
    dealt = dealt.select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "text", "pivots", "texts", "own")
    found_type = T.StructType([T.StructField("key", long), T.StructField("root", long), T.StructField("links", long)])
    found_arrow = to_arrow_schema(found_type)
    dealt = dealt.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    found = written(dealt.mapInArrow(lambda it: _verify(it, words, exact, found_arrow), found_type), "found")

    comp = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    linked = sets.select("key", "id", "texts").join(comp.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    linked = written(linked.select("key", "id", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).alias("n_links")), "linked")
    least = linked.groupBy("root").agg(F.min("id").alias("class_id"))
    return signed.select("id", "digest", "key"), linked.join(least, "root").select("key", "root", "class_id", "n_links")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def join(docs: DataFrame, *, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL, block: int = BLOCK, cost: int = COST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its component of near copies), n_links, for every row."""
    signed, of_set = _linked(docs, threshold, words, trees, recall, block, cost, id_col, text_col)
    out = signed.select("id", "key").join(of_set, "key", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def deduplicated(docs: DataFrame, *, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, recall: float = RECALL, block: int = BLOCK, cost: int = COST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, all its columns kept.

    A class belongs to rows, not to ids: the row that stays is that of the least id, then of the least digest; rows
    without an id come last.  Of rows with the same id and text one stays; which one is not determined where other columns differ.
    All null and empty texts are one class here.
    """
    signed, of_set = _linked(docs, threshold, words, trees, recall, block, cost, id_col, text_col)
    rows = signed.groupBy("id", "digest", "key").agg(F.count(F.lit(1)).alias("times"))
    rows = written(rows.join(of_set.select("key", "root"), "key", "left").select("id", "digest", "root", "times"), "rooted")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", F.col("digest").isNotNull(), "digest")).alias("first")).select(F.col("root").alias("class"), F.col("first.id").alias("first_id"), F.col("first.digest").alias("first_digest"))
    rows = rows.join(first, F.col("root").eqNullSafe(F.col("class")))
    stays = F.col("id").eqNullSafe(F.col("first_id")) & F.col("digest").eqNullSafe(F.col("first_digest"))
    rows = written(rows.select("id", "digest", stays.alias("stays"), (stays & (F.col("times") > 1)).alias("repeated")), "stays")

    def among(these: DataFrame) -> Column:
        return docs[id_col].cast("long").eqNullSafe(these["id"]) & _digest(docs[text_col]).eqNullSafe(these["digest"])

    gone, repeated = written(rows.where(~F.col("stays") | F.col("repeated")), "gone"), written(rows.where("repeated"), "repeated")
    # merged at every size: what goes grows with the documents
    return docs.join(gone.hint("merge"), among(gone), "left_anti").union(docs.join(repeated, among(repeated), "left_semi").dropDuplicates([id_col, text_col]))


def sql(docs: str = "documents") -> str:
    """DuckDB SQL of ``join`` with its defaults, by all shared shingles and a transitive closure; for small tables."""
    up, down = Fraction(str(THRESHOLD)).as_integer_ratio()
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}') AS w FROM {docs}),
x AS (SELECT text, row_number() OVER () AS rep, min(doc_id) AS id, any_value(w) AS w FROM d WHERE text <> '' GROUP BY text),
s AS (SELECT DISTINCT rep, array_to_string(w[k:k + least(len(w), {WORDS}) - 1], ' ') AS g FROM (SELECT rep, w, unnest(generate_series(1, greatest(len(w) - {WORDS - 1}, 1))) AS k FROM x WHERE len(w) > 0)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
meet AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM meet JOIN n na ON a = na.rep JOIN n nb ON b = nb.rep WHERE meet.n * {down} >= {up} * (na.n + nb.n - meet.n)),
r AS (SELECT rep AS a, rep AS b FROM x UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(x.id) AS class_id FROM r JOIN x ON r.b = x.rep GROUP BY a),
m AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN d.doc_id ELSE c.class_id END AS class_id, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN x ON d.text = x.text LEFT JOIN c ON x.rep = c.a LEFT JOIN m ON x.rep = m.a"""
