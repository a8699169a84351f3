"""Exact n-gram Jaccard join of whole texts by signature trees.

A document's set holds its distinct word shingles. Two documents link when their sets' Jaccard similarity
reaches the threshold; linked documents form groups. Every distinct set is a leaf of signature trees whose
nodes carry the OR of the token bitmaps below them and the range of set sizes; two trees (or one with itself)
are traversed together, and a pair of nodes is dropped when its greatest possible overlap, or its sizes, rule
out every pair below it. What survives down to the leaves is verified on the sets themselves, inside the task;
no list of pairs leaves it, only the links of a spanning forest.

A tree over a whole corpus cannot prune near its root, where every bit is set. So the root's children are
cells: a cell holds the sets that share one of their necessary tokens (a linked pair must share one of the
first n - ceil(0.8 n) + 1 tokens of either set in any common order). The order puts tokens of more than HOT
documents last - a bitmap of fixed size says which; the order need only be the same for all - so common
passages open no large cells unless a text consists of little else. Below a cell stand the groups that are
already known to be linked (their bitmaps stay sparse, as their members are near copies), and below these the
sets. A cell whose sets are all of one group needs no traversal; and cells of the same members are one.

The known groups come first: sets that agree in a sketch (two minima of their tokens) are compared with the
least set of that sketch. This finds nearly all links of large groups at one comparison per member; the cells
find the rest, so the result is exact. Equal sets are one leaf from the start. A large cell is cut into blocks
whose pairs are separate tasks.

Sets are told apart by 64-bit fingerprints, shingles by 64-bit hashes.

Defined results: a null or empty text, or one of separators alone, has an empty set and links with nothing
(component_id is its doc_id); a text of fewer words than a shingle has its whole sequence as its only shingle;
equal rows each have a row; a null doc_id never becomes a component_id unless the group has no other; other
columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitcurve.llm.bitmap import bitmap_of, marked
from bitcurve.llm.components import connected_components
from bitcurve.llm.groups import keyed_groups
from bitcurve.llm.session import discard, ship, stored
from bitcurve.llm.text import SPACE, Words, mix, row_pieces

WORDS = 5  # words of a shingle
SHARE = 80  # per cent of the union that the intersection must reach
HOT = 32  # documents that make a token common; only the order of tokens depends on it
SKETCHES = 4
BLOCK = 512  # rows of a block of a large cell
FANOUT = 8
NARROW, WIDE = 2, 16  # bits per token of the bitmaps that thin out the cells, and of those that choose the pairs

_SEEDS = np.random.default_rng(5).integers(1, 2**62, 2 * SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Tokens of which a linked partner shares at least one: n - ceil(share * n) + 1."""
    return np.where(n > 0, n - -(-n * SHARE // 100) + 1, 0)


def linked(common, a, b):
    """The link condition on the sizes of intersection and sets."""
    return common * 100 >= SHARE * (a + b - common)


class Sets:
    """The shingle sets of some rows: tokens of row i are values[first[i]:first[i + 1]]."""

    def __init__(self, column):
        self.values, self.first = Words(column, SPACE).shingle_sets(WORDS)
        self.size = np.diff(self.first)
        self.some = np.flatnonzero(self.size)

    def reduce(self, ufunc, values) -> np.ndarray:
        """Per non-empty row."""
        return ufunc.reduceat(values, self.first[:-1][self.some]) if len(self.some) else np.zeros(0, values.dtype)

    def ids(self) -> np.ndarray:
        """Fingerprints of the non-empty rows' sets."""
        return mix(self.reduce(np.add, mix(self.values)) + self.size[self.some].astype(np.uint64)).view(np.int64)

    def firsts(self, order_last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each row's prefix tokens; those flagged in ``order_last`` come after the others."""
        values, want = self.values, prefix_length(self.size)
        row = np.repeat(np.arange(len(self.size)), self.size)
        if order_last is not None and order_last.any():
            values = values[np.lexsort((order_last, row))]  # stable: by hash within either part
        keep = np.arange(len(values)) - self.first[:-1][row] < want[row]
        return values[keep], want


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def unseen(ids: np.ndarray, seen: set) -> np.ndarray:
    """Positions of ids that this task meets for the first time."""
    out = [i for i, x in enumerate(ids.tolist()) if not (x in seen or seen.add(x))]
    return np.asarray(out, np.int64)


def describe(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Per document its set's size and id, the sketches, and (once per task and set) the prefix tokens."""
    names = ["doc_id", "text_key", "n_shingles", "set_id", *[f"s{j}" for j in range(SKETCHES)], "prefix"]
    schema = ", ".join(f"{n} {'array<long>' if n == 'prefix' else 'long'}" for n in names)

    def run(batches):
        seen: set = set()
        for batch in batches:
            for rows in row_pieces(batch, 2):
                sets, n = Sets(rows.column(2)), rows.num_rows
                ids = np.zeros(n, np.int64)
                ids[sets.some] = sets.ids()
                empty = sets.size == 0
                minima = [sets.reduce(np.minimum, sets.values * seed) for seed in _SEEDS]
                sketch = np.zeros((SKETCHES, n), np.int64)
                for j in range(SKETCHES):
                    sketch[j, sets.some] = mix(minima[2 * j] ^ mix(minima[2 * j + 1])).view(np.int64)
                values, want = sets.firsts()
                fresh = np.zeros(n, bool)
                fresh[sets.some[unseen(ids[sets.some], seen)]] = True
                values = values[np.repeat(fresh, want)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array(sets.size.astype(np.int64)),
                        pa.array(ids, mask=empty),
                        *[pa.array(s, mask=empty) for s in sketch],
                        lists(values, np.where(fresh, want, 0)),
                    ],
                    names,
                )

    body = F.col(text).cast("string")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(body), body).mapInArrow(run, schema)


def prefixes(docs: DataFrame, text: str, hot: np.ndarray) -> DataFrame:
    """(set_id, prefix) in the order that puts common tokens last; once per task and set."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        seen: set = set()
        for batch in batches:
            for rows in row_pieces(batch, 0):
                sets = Sets(rows.column(0))
                ids = sets.ids()
                values, want = sets.firsts(marked(shared.value, sets.values))
                fresh = unseen(ids, seen)
                keep = np.zeros(len(want), bool)
                keep[sets.some[fresh]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[fresh]), lists(values[np.repeat(keep, want)], want[keep])], ["set_id", "prefix"]
                )

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "set_id long, prefix array<long>")


def wanted_sets(docs: DataFrame, text: str, wanted: DataFrame, make, schema: str) -> DataFrame:
    """A row per set whose id is in ``wanted``: set_id and the columns that ``make(sets, positions)`` gives."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "set_id"))
    names = ["set_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches):
        seen: set = set()
        for batch in batches:
            for rows in row_pieces(batch, 0):
                sets = Sets(rows.column(0))
                ids = sets.ids()
                take = np.flatnonzero(marked(shared.value, ids.view(np.uint64)))
                take = take[unseen(ids[take], seen)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[take]), *make(sets, take)], names)

    found = docs.select(F.col(text).cast("string")).mapInArrow(run, f"set_id long, {schema}")
    # Rows that only share a bit with a wanted id go; so do copies that other tasks have found.
    return found.join(wanted.select("set_id").distinct(), "set_id", "left_semi").dropDuplicates(["set_id"])


def sets_of(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(set_id, tokens) of the sets whose ids are in ``wanted``."""

    def run(sets: Sets, take: np.ndarray):
        keep = np.zeros(len(sets.size), bool)
        keep[sets.some[take]] = True
        return [lists(sets.values[np.repeat(keep, sets.size)], sets.size[keep])]

    return wanted_sets(docs, text, wanted, run, "tokens array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of set ids that really link."""
    left = pairs.join(sets.select(F.col("set_id").alias("u"), F.col("tokens").alias("x")), "u")
    both = left.join(sets.select(F.col("set_id").alias("v"), F.col("tokens").alias("y")), "v")
    common = both.select("u", "v", F.size("x").alias("a"), F.size("y").alias("b"), F.size(F.array_intersect("x", "y")).alias("i"))
    return common.filter(f"i * 100L >= {SHARE} * (a + b - i)").select("u", "v")


# ---- trees -------------------------------------------------------------------------------------------


def width_of(sizes: np.ndarray, share: int) -> np.ndarray:
    """Bits of a set's bitmap: a power of two, at least 64 and ``share`` times the size, so that linked sets'
    widths differ by one doubling at most."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1) * share)).astype(np.int64))


def bitmaps(values: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Token bitmaps, a row of 64-bit words per set."""
    out = np.zeros((len(size), width // 64), np.uint64)
    bit = values & np.uint64(width - 1)
    np.bitwise_or.at(
        out,
        (np.repeat(np.arange(len(size)), size), (bit >> np.uint64(6)).astype(np.int64)),
        np.uint64(1) << (bit & np.uint64(63)),
    )
    return out


def fold(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


class Tree:
    """Levels of nodes over rows ordered by (group, size): OR-combined bitmaps, size range, the most tokens
    of a row that share bits with others (excess), and the common group or -1."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, group: np.ndarray, bits: np.ndarray):
        self.rows = rows
        excess = size - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, size, size, excess, group)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, excess, group = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            least, most = np.minimum.reduceat(group, at), np.maximum.reduceat(group, at)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(excess, at),
                    np.where(least == most, least, -1),
                )
            )

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def surviving(x, y, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs may hold a linked pair of different groups, by sizes and by the greatest overlap that
    their bitmaps allow."""
    (xb, xl, xh, xe, xg), (yb, yl, yh, ye, yg) = x, y
    keep = (xh[i] * 100 >= SHARE * yl[j]) & (yh[j] * 100 >= SHARE * xl[i])
    keep &= (xg[i] != yg[j]) | (xg[i] < 0)
    at = np.flatnonzero(keep)
    for part in np.array_split(at, max(1, len(at) * xb.shape[1] // (1 << 18))):
        a, b = i[part], j[part]
        most = np.bitwise_count(xb[a] & yb[b]).sum(axis=1) + np.minimum(xe[a], ye[b])
        most = np.minimum(most, np.minimum(xh[a], yh[b]))
        # overlap >= share / (100 + share) * (|A| + |B|), least for the smallest sets below
        keep[part] = most * (100 + SHARE) >= SHARE * (xl[a] + yl[b])
    return keep


def traverse(x: Tree, y: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two trees that survive the dual traversal; within one tree each pair once."""
    top = max(len(x.levels), len(y.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for k in range(top, -1, -1):
        keep = surviving(x.level(k), y.level(k), i, j)
        i, j = i[keep], j[keep]
        if k == 0 or not len(i):
            break
        i, j = children(x, y, i, j, k)
        if x is y:
            half = i <= j
            i, j = i[half], j[half]
    if x is y:
        i, j = i[i != j], j[i != j]
    return x.rows[i], y.rows[j]


def children(x: Tree, y: Tree, i, j, k):
    """All pairs of children of the node pairs of level k; a tree that is not as high keeps its node."""

    def of(tree, node):
        if k >= len(tree.levels):
            return node[:, None], np.ones((len(node), 1), bool)
        child = node[:, None] * FANOUT + np.arange(FANOUT)
        return child, child < len(tree.levels[k - 1][1])

    (ci, oi), (cj, oj) = of(x, i), of(y, j)
    shape = (len(i), ci.shape[1], cj.shape[1])
    ok = np.broadcast_to(oi[:, :, None], shape) & np.broadcast_to(oj[:, None, :], shape)
    return np.broadcast_to(ci[:, :, None], shape)[ok], np.broadcast_to(cj[:, None, :], shape)[ok]


def cell_pairs(size: np.ndarray, group: np.ndarray, side: np.ndarray, bits: list[np.ndarray]) -> np.ndarray:
    """Candidate pairs of one cell's rows, as columns (position, position). ``side`` is 0 for
    a cell or block by itself; of a pair of blocks, whose sides are 1 and 2, only pairs across are made."""
    out = [np.zeros((2, 0), np.int64)]
    width = np.array([len(b) for b in bits])
    trees: dict = {}

    def tree(s: int, w: int, fold_to: int):
        if (s, w, fold_to) not in trees:
            rows = np.flatnonzero((side == s) & (width == w))
            if not len(rows):
                trees[s, w, fold_to] = None
            else:
                rows = rows[np.lexsort((size[rows], group[rows]))]
                own = np.stack([bits[r] for r in rows])
                own = fold(own) if fold_to < w else own
                trees[s, w, fold_to] = Tree(rows, size[rows], group[rows], own)
        return trees[s, w, fold_to]

    sides = [(0, 0)] if (side == 0).all() else [(1, 2)]
    for w in np.unique(width).tolist():
        for s, t in sides:
            joins = [(tree(s, w, w), tree(t, w, w)), (tree(s, w, w), tree(t, 2 * w, w))]
            # The narrower side may have no row of this width.
            if s != t:
                joins.append((tree(s, 2 * w, w), tree(t, w, w)))
            out += [np.stack(traverse(x, y)) for x, y in joins if x is not None and y is not None]
    return np.concatenate(out, axis=1)


def dealt(cells: DataFrame, rows: DataFrame, columns) -> DataFrame:
    """(cell, i, j, side, set_id, group, *columns), sorted by cell and block pair inside the partitions: the
    cells' members with their ``columns`` of ``rows``. Large cells are dealt out as pairs of blocks: of two
    blocks i < j, pair (i, j) holds both, as sides 1 and 2; pair (i, i) is a block by itself, side 0."""
    counts = cells.groupBy("cell").agg(F.expr(f"(count(1) - 1) div {BLOCK} + 1 AS blocks"))
    blocked = cells.join(counts, "cell").withColumn("block", F.expr("pmod(xxhash64(set_id, cell), blocks)"))
    copies = blocked.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).selectExpr(
        "cell",
        "least(block, other) AS i",
        "greatest(block, other) AS j",
        "CASE WHEN block = other THEN 0 WHEN block < other THEN 1 ELSE 2 END AS side",
        "set_id",
        "group",
    )
    joined = copies.join(rows, "set_id").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return joined.select("cell", "i", "j", "side", "set_id", "group", *columns)


def with_candidates(cells: DataFrame, signed: DataFrame) -> DataFrame:
    """(cell, set_id) of the cells' members that have any candidate in their cell, by the bitmaps ``signed``."""

    def run(batches):
        for batch, start in keyed_groups(batches, 3):
            out = [np.zeros((2, 0), np.int64)]
            cell = batch.column(0).to_numpy()
            side, ids, group, size = (batch.column(k).to_numpy() for k in range(3, 7))
            for a, b in zip(start.tolist(), np.append(start[1:], batch.num_rows).tolist()):
                if b - a < 2 or (group[a:b] == group[a]).all():
                    continue
                bits = [np.frombuffer(batch.column(7)[r].as_buffer(), np.uint64) for r in range(a, b)]
                some = np.unique(cell_pairs(size[a:b], group[a:b], side[a:b], bits)) + a
                out.append(np.stack([np.full(len(some), cell[a]), ids[some]]))
            found = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["cell", "set_id"])

    return dealt(cells, signed, ["n", "bits"]).mapInArrow(run, "cell long, set_id long").distinct()


def links_within(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links that join all sets of the cells' members that any link joins - a spanning forest of each
    cell or block pair. Candidates come from the trees and are verified on the sets at once, unless links found
    before already join them, so that no list of pairs leaves a task."""

    def run(batches):
        for batch, start in keyed_groups(batches, 3):
            u, v = [], []
            side, ids, group = (batch.column(k).to_numpy() for k in range(3, 6))
            tokens = batch.column(6)
            first = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
            values = tokens.flatten().to_numpy().view(np.uint64)
            for a, b in zip(start.tolist(), np.append(start[1:], batch.num_rows).tolist()):
                if b - a < 2 or (group[a:b] == group[a]).all():
                    continue
                own = [values[first[r] : first[r + 1]] for r in range(a, b)]
                size = np.array([len(x) for x in own])
                width = width_of(size, WIDE).tolist()
                bits = [bitmaps(x, np.array([len(x)]), w)[0] for x, w in zip(own, width)]
                names: dict[int, int] = {}  # groups that links of this cell have joined

                def name(g: int) -> int:
                    while g in names:
                        g = names[g]
                    return g

                for p, q in cell_pairs(size, group[a:b], side[a:b], bits).T.tolist():
                    gp, gq = name(int(group[a + p])), name(int(group[a + q]))
                    if gp == gq:
                        continue
                    common = len(np.intersect1d(own[p], own[q], assume_unique=True))
                    if linked(common, len(own[p]), len(own[q])):
                        names[max(gp, gq)] = min(gp, gq)
                        u.append(min(ids[a + p], ids[a + q]))
                        v.append(max(ids[a + p], ids[a + q]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt(cells, sets, ["tokens"]).mapInArrow(run, "u long, v long").distinct()


def signatures(docs: DataFrame, text: str, wanted: DataFrame, share: int) -> DataFrame:
    """(set_id, n, bits): sizes and bitmaps, of ``share`` to twice as many bits a token, of the sets whose ids
    are in ``wanted``."""

    def run(sets: Sets, take: np.ndarray):
        rows = sets.some[take]
        size, width = sets.size[rows], width_of(sets.size[rows], share)
        values = (sets.values[sets.first[r] : sets.first[r + 1]] for r in rows)
        bits = [bitmaps(v, np.array([n]), w).tobytes() for v, n, w in zip(values, size, width.tolist())]
        return [pa.array(size.astype(np.int64)), pa.array(bits, pa.binary())]

    return wanted_sets(docs, text, wanted, run, "n long, bits binary")


# ---- the join ----------------------------------------------------------------------------------------


def hub_links(described: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Verified links between each set and the least sets of its sketches."""
    minima = [F.min(f"s{j}").alias(f"s{j}") for j in range(SKETCHES)]
    sets = described.filter("n_shingles > 0").groupBy("set_id").agg(F.min("n_shingles").alias("n"), *minima)
    keys = sets.select(
        "set_id", "n", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"s{j}").alias("s")) for j in range(SKETCHES)])).alias("k")
    ).select("set_id", "n", "k.j", "k.s")
    hubs = keys.groupBy("j", "s").agg(F.min(F.struct("set_id", "n")).alias("hub"), F.count(F.lit(1)).alias("m"))
    pairs = keys.join(hubs.filter("m > 1"), ["j", "s"]).filter(
        f"set_id > hub.set_id AND least(n, hub.n) * 100 >= {SHARE} * greatest(n, hub.n)"
    )
    pairs = stored(pairs.select(F.col("hub.set_id").alias("u"), F.col("set_id").alias("v")).distinct(), "hub-pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("set_id"))
    return stored(verified(pairs, sets_of(docs, text, wanted)), "hub-links")


def hot_tokens(described: DataFrame) -> np.ndarray:
    counts = described.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return bitmap_of(counts.filter(F.col("n") > HOT), "token")


def live_cells(firsts: DataFrame) -> DataFrame:
    """(cell, set_id, group): the cells with sets of several groups, one of all cells with the same members.
    ``firsts`` is (set_id, group, prefix)."""
    tokens = firsts.select("group", F.explode("prefix").alias("token"))
    span = tokens.groupBy("token").agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a < b")
    live = stored(span.select("token"), "live-tokens")
    shared = firsts.sparkSession.sparkContext.broadcast(bitmap_of(live, "token"))

    def run(batches):
        for batch in batches:
            prefix = batch.column(2)
            size = np.diff(prefix.offsets.to_numpy())
            values = prefix.flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            keep = marked(shared.value, values.view(np.uint64))
            row = row[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[keep]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                ["cell", "set_id", "group"],
            )

    thinned = firsts.select("set_id", "group", "prefix").mapInArrow(run, "cell long, set_id long, group long")
    exact = thinned.join(live.withColumnRenamed("token", "cell"), "cell", "left_semi").distinct()
    members = stored(exact, "cell-members")
    return one_of_alike(members, "cells")


def one_of_alike(cells: DataFrame, name: str) -> DataFrame:
    """Of all cells with the same members one."""
    both = [F.expr("bit_xor(xxhash64(set_id)) AS f"), F.expr("bit_xor(xxhash64(7, set_id)) AS g")]
    alike = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), *both)
    one = alike.groupBy("m", "f", "g").agg(F.min("cell").alias("cell")).select("cell")
    return stored(cells.join(one, "cell", "left_semi"), name)


def cell_links(cells: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Links between sets of different groups that share a cell, all that are needed to join the groups.

    Narrow bitmaps find the few members of the cells that have any candidate; only their sets go to the cells,
    where wide bitmaps choose the pairs to verify."""
    members = with_candidates(cells, signatures(docs, text, cells, NARROW))
    rest = stored(cells.join(members, ["cell", "set_id"]), "open-cell-members")
    rest = one_of_alike(rest, "open-cells")
    return links_within(rest, sets_of(docs, text, rest))


def jaccard_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    rows, names = grouped(docs, id_column, text)
    named_rows = rows.join(names, "set_id", "left")
    return named_rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def grouped(docs: DataFrame, id_column: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents' sets (doc_id, text_key, n_shingles, set_id), and the groups (set_id, component_id, component)."""
    ship(docs.sparkSession)
    described = stored(describe(docs, id_column, text), "described")
    hub = hub_links(described, docs, text)
    known = stored(connected_components(hub), "known-groups")
    hot = hot_tokens(described)
    rows = stored(described.select("doc_id", "text_key", "n_shingles", "set_id"), "document-sets")
    discard(described)
    firsts = prefixes(docs, text, hot).join(known.withColumnRenamed("id", "set_id"), "set_id", "left")
    firsts = stored(firsts.select("set_id", F.expr("coalesce(component, set_id) AS group"), "prefix"), "firsts")
    cells = live_cells(firsts)
    discard(firsts)
    found = cell_links(cells, docs, text)
    # Links between groups join the groups.
    links = stored(hub.unionByName(found), "links")
    groups = stored(connected_components(links), "groups")
    named = (
        rows.filter("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("first_doc"))
        .join(groups.withColumnRenamed("id", "set_id"), "set_id", "left")
        .select("set_id", F.expr("coalesce(component, set_id) AS component"), "first_doc")
    )
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    return rows, named.select("set_id", "component").join(least, "component").select("set_id", "component_id", "component")


def first_of_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of the least id of their group, and all without words, with all their columns. Rows that
    agree in id and text are one document; a group without any id keeps its first by set and text.

    Only documents that share their text's hash with one that goes (a bitmap tells) are shuffled."""
    rows, names = grouped(docs, id_column, text)
    placed = rows.join(names.select("set_id", "component"), "set_id")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "set_id", "text_key")
    first = placed.groupBy("component").agg(F.min(order).alias("first"))
    flags = placed.join(first, "component").select(
        "doc_id", "text_key", F.expr("doc_id <=> first.doc_id AND text_key = first.text_key AS stays")
    )
    # What goes, and what stays but stands in the table more than once.
    doubtful = flags.groupBy("doc_id", "text_key").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    doubtful = stored(doubtful.filter("NOT stays OR n > 1").select("doc_id", "text_key", "stays"), "not-first")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(doubtful, "text_key"))

    @F.pandas_udf("boolean")
    def touched(key: pd.Series) -> pd.Series:
        return pd.Series(marked(shared.value, key.to_numpy(np.int64).view(np.uint64)))

    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = keyed.withColumn("key", F.xxhash64(F.col(f"row.`{text}`").cast("string"))).withColumn("touched", touched("key"))
    same = (F.col("key") == F.col("text_key")) & F.col(f"row.`{id_column}`").cast("long").eqNullSafe(F.col("doc_id"))
    looked_up = keyed.filter("touched").join(doubtful, same, "left")
    # Rows that are known by (doc_id, text_key) stay once.
    once = looked_up.filter("stays").dropDuplicates(["doc_id", "text_key"])
    parts = [keyed.filter("NOT touched"), looked_up.filter("text_key IS NULL"), once]
    parts = [part.select("row.*") for part in parts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
