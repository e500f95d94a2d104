"""Exact neighbours and range joins that leave most pairs unmeasured, by cells around pivots.

Pivots are a sample of the corpus by hash. A row's cell is its nearest pivot's, and a cell is dealt into parts of bounded size, so
that a dense one, or one of many copies, is no larger task. By the triangle inequality a part can hold nothing within t of a query
if the query is farther from its pivot than the part's radius and t, or nearer than its least radius less t; and of a part's rows, sorted by
distance to the pivot, only those in a ring count.

Parts that lie side by side are a group, of bounded size, too. A query is sent to a group once, however many of its parts it has to
visit, so where no bound leaves anything out the join sends what a join of blocks sends, and measures in products as large.

A k-nearest join takes two rounds. In the first a query meets the part it falls into, and what its k-th distance there leaves of the
group. Its k-th distance so far, or what pivots and counts promise if that is less, bounds the second round, where the query goes to
just the other groups that may hold something nearer. A range join is the second round alone. Corpus rows are shuffled once for each
round, and queries as often as they have groups to visit. A group visited by very many queries is copied once for each `visits` of them.

In a range join of a table with itself a pair is measured once and returned both ways. A group's rows meet each other where they are held, and
of two groups just one sends its rows to the other. The hits of both ways alternate by the few dozen, so that a file's compression sees a
distance for the second time while it still has the first.

In a task, a group's rows come first and are held; the queries that visit it pass by in batches, in the order of their own parts. What
the driver holds are pivots and a few numbers for each part, both of bounded size.

L2 only. Ties: by id. Rows with null vectors are left out. Vectors are moved by the mean of the pivots first, and bounds are
widened by what rounding may move them, so that vectors far from the origin are told apart as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.vectors import TINY
from nearfield.operators import knn
from nearfield.operators.knn import CHUNK, MAX_QUERIES, _least_copies, _margin, _measured, matrix, top
from nearfield.plans.session import kept

#: Corpus rows of a part and of a group, the most pivots, and visits of queries to one copy of a group.
MAX_ROWS, MAX_PIVOTS, VISITS = 20_000, 4096, 200_000
#: Visits below which a group isn't copied to keep more tasks busy; rows that a task hands on at once.
FEW_VISITS, AT_ONCE = 10_000, 1 << 14
#: Cuts by distance on the way to a group, beyond which parts are halved; hits one way before those of the other, and hits handed on at once.
CUTS, ONE_WAY, HITS_AT_ONCE = 64, 64, 1 << 17


@dataclass(frozen=True)
class Cells:
    """Pivots (moved by `mean`) and, for each part, its cell, its number in it, rows, and least and largest distance to the pivot."""

    mean: np.ndarray
    pivots: np.ndarray
    cell: np.ndarray
    part: np.ndarray
    rows: np.ndarray
    near: np.ndarray
    far: np.ndarray
    parts: dict[int, int]

    def distances(self, x: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible distances of moved vectors to all pivots, or those at `at`."""
        p = self.pivots if at is None else self.pivots[at]
        d = np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0)
        off = _margin(x, "l2")[:, None] + _margin(p, "l2")[None]
        return np.sqrt(np.maximum(d - off, 0)), np.sqrt(d + off)

    def at_once(self) -> int:
        """Queries whose distances to all parts are held at once."""
        return max(1, (1 << 19) // max(len(self.cell), len(self.pivots), 1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For moved vectors their cell and the distance to its pivot."""
        step = self.at_once()
        cell = np.concatenate([self.distances(x[s : s + step])[0].argmin(1) for s in range(0, len(x), step)] or [np.zeros(0, int)])
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))


def _moved(column: pa.Array, mean: np.ndarray) -> np.ndarray:
    return matrix(column) - mean


def _slack(*sizes) -> np.ndarray:
    """What rounding, to nine digits too, may move an exact distance."""
    return 2e-9 + 1e-12 * sum(sizes)


def _table(df: DataFrame, id_col: str, v: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v")).where("v IS NOT NULL")


def pivots_of(rows: DataFrame, count: int) -> np.ndarray:
    """The vectors of the rows that come first by a hash of id and vector."""
    got = rows.orderBy(F.xxhash64("id", "v"), "id").limit(count).select("v").collect()
    return np.unique(np.array([r[0] for r in got], np.float64), axis=0) if got else np.zeros((0, 0))


def dealt(corpus: DataFrame, max_rows: int = MAX_ROWS, pivots: int | None = None) -> tuple[DataFrame, Cells | None]:
    """(id, v, c, s, d) of corpus (id, v), a copy: cell, part, and distance to the pivot; and the cells, None for an empty corpus."""
    rows = _table(corpus, "id", "v")
    n = rows.count()
    if not n:
        return rows.selectExpr("id", "v", "0 AS c", "0 AS s", "0D AS d"), None
    found = pivots_of(rows, min(MAX_PIVOTS, pivots or max(1, 2 * math.isqrt(n))))
    mean = found.mean(0)
    cells = Cells(mean, found - mean, *(np.zeros(0),) * 5, {})
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            c, d = sent.value.nearest(_moved(batch.column(1), sent.value.mean))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c, pa.int32()), pa.array(d)], names=["id", "v", "c", "d"])

    rows = kept(rows.mapInArrow(run, "id long, v array<double>, c int, d double"))
    parts = {r.c: -(-r.n // max_rows) for r in rows.groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
    many = {c: k for c, k in parts.items() if k > 1}
    shares = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in many.items() for x in kv)), F.col("c")), F.lit(1)) if many else F.lit(1)
    rows = rows.withColumn("s", F.pmod(F.xxhash64("id", "v"), shares).cast("int")).select("id", "v", "c", "s", "d")
    one = rows.groupBy("c", "s").agg(F.count("*").alias("n"), F.min("d").alias("near"), F.max("d").alias("far")).collect()  # n / max_rows rows, and one for each pivot
    col = lambda k, t: np.array([r[k] for r in one], t)
    return rows, Cells(mean, found - mean, col("c", np.int64), col("s", np.int64), col("n", np.int64), col("near", float), col("far", float), parts)


def _cut(x: np.ndarray, rows: np.ndarray) -> int:
    """Where to cut sorted places with so many rows, for sides that vary least in themselves: between clusters, if there are any."""
    n, total = np.cumsum(rows)[:-1], np.cumsum(rows * (x - x[0]))
    between = (total[:-1] * rows.sum() - total[-1] * n) ** 2 / (n * (rows.sum() - n))
    return int(between.argmax()) + 1


def grouped(cells: Cells, size: int) -> tuple[Cells, np.ndarray]:
    """The cells with their parts in an order where neighbours lie side by side, and the places where groups start: parts are cut in two
    along the dimension in which their pivots lie farthest apart, where clusters part, until they have at most `size` rows, or are one.
    Small ones side by side are then put together, so that any two in a row have more than `size`."""
    order, starts, todo, held = [], [], [(0, np.arange(len(cells.cell)))], 0
    while todo:
        cuts, at = todo.pop()
        own = cells.rows[at].sum()
        if len(at) <= 1 or own <= size:
            if not starts or held + own > size:
                starts.append(len(order))
                held = 0
            held += own
            order += at.tolist()
            continue
        p = cells.pivots[cells.cell[at]]
        p = p[:, np.ptp(p, axis=0).argmax()]
        by = np.argsort(p, kind="stable")
        at, p = at[by], p[by]
        sums = np.cumsum(cells.rows[at])
        if size and cuts < CUTS and p[0] < p[-1]:
            half = _cut(p, cells.rows[at].astype(float))
        else:
            half = min(max(int(np.searchsorted(sums, sums[-1] / 2)), 1), len(at) - 1)
        todo += [(cuts + 1, at[half:]), (cuts + 1, at[:half])]
    of = lambda a: a[order]
    return replace(cells, cell=of(cells.cell), part=of(cells.part), rows=of(cells.rows), near=of(cells.near), far=of(cells.far)), np.array(starts)


def _places(cells: Cells) -> dict[tuple[int, int], int]:
    """The place of each part (cell, part)."""
    return {key: p for p, key in enumerate(zip(cells.cell.tolist(), cells.part.tolist(), strict=True))}


#: Rows that go to a copy of a group: kind 0 with the part, id, v, d of the corpus; kind 1 with a query's own part, id, vector and bound.
_TO_GROUP = "k int, kind int, p int, id long, v array<double>, d double, t double"
_NAMES = [f.split()[0] for f in _TO_GROUP.split(", ")]
_FOUND = "qid long, id long, dist double, measured long"


class Block:
    """The rows of a group in order of part and distance to its pivot, ready to be measured. most: how many copies of a vector can
    count, those of least ids; None: all."""

    def __init__(self, cells: Cells, part: np.ndarray, ids: np.ndarray, x: np.ndarray, d: np.ndarray, k: int | None, exclude: str):
        self.cells, self.k, self.exclude = cells, k, exclude
        self.spare = int(np.unique(ids, return_counts=True)[1].max(initial=0)) if exclude == "id" else 0
        order = np.arange(len(ids)) if k is None else _least_copies(ids, x, k + self.spare)
        order = order[np.lexsort((d[order], part[order]))]
        self.ids, self.x, self.d, self.part = ids[order], x[order], d[order], part[order]
        self.parts, self.first = np.unique(self.part, return_index=True)
        self.last = np.append(self.first[1:], len(self.part))
        self.mean = self.x.mean(0)
        moved = self.x - self.mean
        self.sq, self.far, self.twice = (moved * moved).sum(1), _margin(moved, "l2"), -2 * moved
        self.base = self.sq - self.far
        self.size, self.moved_size = np.sqrt((self.x * self.x).sum(1).max()), np.sqrt(self.sq.max())

    def rows_of(self, part: int) -> np.ndarray:
        at = np.searchsorted(self.parts, part)
        return np.arange(self.first[at], self.last[at]) if at < len(self.parts) and self.parts[at] == part else np.zeros(0, int)

    def within(self, q: np.ndarray, t: np.ndarray, but: int = -1) -> np.ndarray:
        """The rows, but those of one part, that may lie within t of any of q."""
        c, n = self.cells, self.parts
        lo, hi = c.distances(q - c.mean, c.cell[n])
        reach = t[:, None] + _slack(hi.max(), c.far.max())
        may = (lo <= c.far[n] + reach) & (hi >= c.near[n] - reach) & (n != but)
        inner = np.where(may, lo - reach, np.inf).min(0)
        outer = np.where(may, hi + reach, -np.inf).max(0)
        out = []
        for at in np.flatnonzero(may.any(0)):
            a, z = self.first[at], self.last[at]
            d = self.d[a:z]
            if inner[at] > d[0] or outer[at] < d[-1]:
                a, z = a + np.searchsorted(d, inner[at], "left"), a + np.searchsorted(d, outer[at], "right")
            out.append(np.arange(a, z))
        return np.concatenate(out) if out else np.zeros(0, int)

    def pairs(self, qid: np.ndarray, q: np.ndarray, t: np.ndarray, at: np.ndarray):
        """(place of the query, place of the row, distance to 9 digits) of pairs with rows `at` that lie within t of the query, and,
        if there is a k, may be among its k nearest of them."""
        none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        if not len(at) or not len(q):
            return none
        whole = len(at) == len(self.ids)
        twice, base, far = (self.twice, self.base, self.far) if whole else (self.twice[at], self.base[at], self.far[at])
        moved = q - self.mean
        own = (moved * moved).sum(1)
        size, moved_size = np.sqrt((q * q).sum(1).max()), np.sqrt(own.max())
        lost = np.finfo(float).eps * (size + self.size + np.sqrt((self.mean * self.mean).sum()))  # by moving, in each vector's length
        near = _margin(moved, "l2") + 4 * lost * (moved_size + self.moved_size + lost)
        low = moved @ twice.T  # with what is the query's own, the least that the square of the distance may be
        low += base
        with np.errstate(invalid="ignore"):
            most = (t + 2e-9) ** 2 - own + near
        loose = np.flatnonzero(~np.isfinite(most))
        if len(loose) and self.k is not None and self.exclude != "zero" and self.k + self.spare < len(at):
            n = self.k + self.spare - 1
            kth = np.partition(low[loose] + 2 * far, n, axis=1)[:, n]
            most[loose] = self._reach(kth + own[loose] + near[loose]) - own[loose] + near[loose]
        i, j = np.nonzero(low <= most[:, None])
        value = low[i, j]
        keep = np.ones(len(i), bool)
        if self.exclude == "id":
            keep = qid[i] != self.ids[at[j]]
        elif self.exclude == "zero":
            same = np.flatnonzero(value + own[i] <= 1e-6 + near[i])
            keep[same] = _measured(q, self.x, i[same], at[j[same]], "l2") > TINY
        i, j, value = i[keep], j[keep], value[keep]
        if self.k is not None and len(i):
            high = value + 2 * far[j]
            order = np.lexsort((high, i))
            of, start = np.unique(i, return_index=True)
            count = np.diff(np.append(start, len(i)))
            enough = count >= self.k
            bound = np.full(len(q), np.inf)
            bound[of[enough]] = self._reach(high[order[start[enough] + self.k - 1]] + (own + near)[of[enough]])
            keep = value + own[i] <= bound[i] + near[i]
            i, j = i[keep], j[keep]
        dist = np.round(_measured(q, self.x, i, at[j], "l2"), 9)
        keep = dist <= t[i] + 2e-9
        return i[keep], at[j[keep]], dist[keep]

    @staticmethod
    def _reach(square: np.ndarray) -> np.ndarray:
        """Rows that are equal after rounding to 9 digits are not farther."""
        return (np.sqrt(np.maximum(square, 0)) + 2e-9) ** 2

    def best(self, i: np.ndarray, j: np.ndarray, dist: np.ndarray):
        order = np.lexsort((self.ids[j], dist, i))
        i, j, dist = i[order], j[order], dist[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        return i[keep], j[keep], dist[keep]


def _first(block: Block, p: np.ndarray, qid: np.ndarray, q: np.ndarray, t: np.ndarray):
    """The k nearest of a group for queries that fall into it: first in a query's own part, then in what that leaves of the others."""
    ends = np.append(np.flatnonzero(p[1:] != p[:-1]) + 1, len(p))
    start = 0
    for end in ends.tolist():
        for s in range(start, end, CHUNK):
            mine = slice(s, min(s + CHUNK, end))
            own = block.rows_of(int(p[s]))
            got = block.best(*block.pairs(qid[mine], q[mine], t[mine], own))
            count = np.bincount(got[0], minlength=mine.stop - s)
            near = t[mine].copy()
            full = count >= block.k
            near[full] = got[2][np.cumsum(count)[full] - 1]
            rest = block.within(q[mine], near, int(p[s]))
            more = block.pairs(qid[mine], q[mine], near, rest)
            i, j, dist = block.best(*(np.concatenate(c) for c in zip(got, more, strict=True)))
            yield (qid[mine][i], block.ids[j], dist), (mine.stop - s) * (len(own) + len(rest))
        start = end


def _to_measure(block: Block, p: np.ndarray, q: np.ndarray, t: np.ndarray, s: int, least: int = 0):
    """(queries, rows that may lie within t of any of them) for the queries from s on that are measured together. least: rows before it are left out."""
    mine = slice(s, min(s + CHUNK, len(q)))
    near = lambda m: (at := block.within(q[m], t[m]))[at >= least]
    todo = [(mine, near(mine))]
    ends = [s, *(s + 1 + np.flatnonzero(p[mine][1:] != p[mine][:-1])).tolist(), mine.stop]
    apart = [(m, near(m)) for m in map(slice, ends[:-1], ends[1:])]
    if 2 * sum((m.stop - m.start) * len(at) for m, at in apart) < (mine.stop - s) * len(todo[0][1]):
        return apart  # queries of several parts that have little to visit in common
    return todo


def _second(block: Block, p: np.ndarray, qid: np.ndarray, q: np.ndarray, t: np.ndarray):
    """What lies within t of queries from elsewhere, the k nearest if there is a k."""
    for s in range(0, len(q), CHUNK):
        for own, at in _to_measure(block, p, q, t, s):
            i, j, dist = block.pairs(qid[own], q[own], t[own], at)
            i, j, dist = block.best(i, j, dist) if block.k is not None else (i, j, dist)
            yield (qid[own][i], block.ids[j], dist), (own.stop - own.start) * len(at)


def _itself(block: Block, radius: float, share: int, shares: int):
    """What lies within a radius of a block's rows among the rows after them, for one of several shares of the rows."""
    t = np.full(len(block.ids), radius)
    for s in range(share * CHUNK, len(block.ids), shares * CHUNK):
        for own, at in _to_measure(block, block.part, block.x, t, s, s + 1):
            i, j, dist = block.pairs(block.ids[own], block.x[own], t[own], at)
            keep = j > own.start + i
            yield (block.ids[own][i[keep]], block.ids[j[keep]], dist[keep]), (own.stop - own.start) * len(at)


def _both_ways(found, radius: float):
    """Hits with 1e-9 < dist <= radius and the same the other way, ONE_WAY of them at a time, in pieces of bounded size."""
    for (a, b, dist), measured in found:
        keep = np.flatnonzero((dist > TINY) & (dist <= radius))
        for s in range(0, max(len(keep), 1), HITS_AT_ONCE // 2):
            at = keep[s : s + HITS_AT_ONCE // 2]
            turn = np.arange(len(at)) // ONE_WAY
            order = np.argsort(np.concatenate([turn, turn]), kind="stable")
            yield tuple(np.concatenate([x[at], y[at]])[order] for x, y in ((a, b), (b, a), (dist, dist))), 0 if s else measured


def _meet(rows: DataFrame, keys: int, sent: Broadcast, find: Callable, k: int | None, exclude: str, alone: Callable | None = None) -> DataFrame:
    """rows (_TO_GROUP) brought together by k, of which there are `keys`; find(block, p, q_ids, q, t) yields arrays of hits and the
    pairs that were measured, as does alone(block, k) for the rows of a group with each other, which are the same rows in the same order in each copy."""

    def shown(found):
        for hits, measured in found:
            last = np.append(np.zeros(len(hits[0]), bool), True)  # a row without a hit has the count
            cols = [pa.array(np.append(h, np.zeros(1, h.dtype)), kind, mask=last) for h, kind in zip(hits, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(last * measured)], names=["qid", "id", "dist", "measured"])

    def built(held):
        p, ids, x, d = (np.concatenate(c) for c in zip(*((b.column(2).to_numpy(), b.column(3).to_numpy(), matrix(b.column(4)), b.column(5).to_numpy()) for b in held), strict=True))
        return Block(sent.value, p, ids, x, d, k, exclude)

    def run(batches):
        key, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            ks = np.stack([batch.column(c).to_numpy() for c in range(2)], 1)
            starts = [0, *(np.flatnonzero((ks[1:] != ks[:-1]).any(1)) + 1).tolist(), len(ks)]
            for a, z in zip(starts[:-1], starts[1:], strict=True):
                part, own = batch.slice(a, z - a), ks[a, 0]
                if own != key:
                    if alone and held:  # of a group that no query visits
                        yield from shown(alone(built(held), key))
                    key, held, block = own, [], None
                if ks[a, 1] == 0:
                    held.append(part)
                elif held or block:
                    if block is None:
                        block, held = built(held), []
                        if alone:
                            yield from shown(alone(block, key))
                    p, qid, q, t = part.column(2).to_numpy(), part.column(3).to_numpy(), matrix(part.column(4)), part.column(6).to_numpy()
                    yield from shown(find(block, p, qid, q, t))
        if alone and held:
            yield from shown(alone(built(held), key))

    by = ["k", "kind", "p", "d", "id", "v"] if alone else ["k", "kind", "p"]
    return rows.repartitionById(max(keys, 1), F.col("k")).sortWithinPartitions(*by).mapInArrow(run, _FOUND)


def _queries(queries: DataFrame, sent: Broadcast) -> DataFrame:
    """(p, id, v) of queries (qid, qv): the place of the part that each falls into, -1 where its cell has none."""

    def run(batches):
        cells = sent.value
        shares = np.array([cells.parts.get(c, 0) for c in range(len(cells.pivots))])
        places = _places(cells)
        for batch in batches:
            c = cells.nearest(_moved(batch.column(1), cells.mean))[0]
            s = batch.column(0).to_numpy() % np.maximum(shares[c], 1)
            p = np.array([places.get(key, -1) for key in zip(c.tolist(), s.tolist(), strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(p), batch.column(0), batch.column(1)], names=["p", "id", "v"])

    return _table(queries, "qid", "qv").mapInArrow(run, "p int, id long, v array<double>")


def _routed(bounded: DataFrame, sent: Broadcast, starts: np.ndarray, which: str, copies: np.ndarray | None) -> DataFrame:
    """bounded: p, id, v, t; rows of kind 1 for each group that a query visits: own, others (those within t), all (within t, with its
    own), or once (of two groups one's queries visit the other). copies: of each group. Without them g and n, the visits of some of the queries
    to it, for counting."""

    def run(batches):
        cells = sent.value
        step = cells.at_once()
        first = None if copies is None else np.cumsum(copies) - copies
        for batch in batches:
            p, ids, v, t = (batch.column(c) for c in range(4))
            own = np.searchsorted(starts, p.to_numpy(), "right") - 1
            for s in range(0, batch.num_rows, step):
                mine = own[s : s + step]
                if which == "own":
                    i = np.flatnonzero(mine >= 0)
                    g = mine[i]
                else:
                    x, near = _moved(v.slice(s, step), cells.mean), t.to_numpy()[s : s + step]
                    lo, hi = cells.distances(x)
                    reach = near[:, None] + _slack(hi.max(), cells.far.max())
                    may = (lo[:, cells.cell] <= cells.far[None] + reach) & (hi[:, cells.cell] >= cells.near[None] - reach)
                    may = np.logical_or.reduceat(may, starts, axis=1)
                    if which != "all":
                        to = np.arange(len(starts))[None]
                        may &= to != mine[:, None]
                    if which == "once":
                        may &= (to > mine[:, None]) == ((to + mine[:, None]) % 2 == 1)
                    i, g = np.nonzero(may)
                if copies is None:
                    n = np.bincount(g, minlength=len(starts))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["g", "n"])
                    continue
                for a in range(0, len(i), AT_ONCE):
                    at, to = i[a : a + AT_ONCE] + s, g[a : a + AT_ONCE]
                    key = (first[to] + ids.to_numpy()[at] % copies[to]).astype(np.int32)
                    n, at = len(at), pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ones(n, np.int32)), p.take(at), ids.take(at), v.take(at), pa.array(np.zeros(n)), t.take(at)], names=_NAMES)

    return bounded.select("p", "id", "v", "t").mapInArrow(run, "g int, n long" if copies is None else _TO_GROUP)


def _visited(rows_of, bounded: DataFrame, sent: Broadcast, starts: np.ndarray, which: str, find: Callable, k: int | None, exclude: str, visits: int, alone: Callable | None = None) -> DataFrame:
    """Queries (p, id, v, t) at the groups they visit; a group that many visit is there in several copies. alone(block, share, shares): hits of
    a group's rows with each other, dealt over its copies."""
    spark, cells = bounded.sparkSession, sent.value
    counts = np.zeros(len(starts), np.int64)
    for r in _routed(bounded, sent, starts, which, None).groupBy("g").agg(F.sum("n").alias("n")).collect():  # a row for each group
        counts[r.g] = r.n
    if alone:
        counts += np.add.reduceat(cells.rows, starts)
    most = min(visits, max(FEW_VISITS, int(counts.sum()) // (3 * spark.sparkContext.defaultParallelism)))
    copies = -(-counts // most)
    first = np.cumsum(copies) - copies
    group = np.searchsorted(starts, np.arange(len(cells.cell)), "right") - 1
    at = [(int(cells.cell[p]), int(cells.part[p]), p, int(first[g]), int(copies[g])) for p, g in enumerate(group.tolist()) if counts[g]]
    places = spark.createDataFrame(at, "c int, s int, p int, first int, copies int")
    held = rows_of({(c, s) for c, s, *_ in at}).join(F.broadcast(places), ["c", "s"])  # a row for each part
    held = held.withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    held = held.select("k", F.lit(0).alias("kind"), "p", "id", "v", "d", F.lit(0.0).alias("t"))

    def shared(block: Block, key: int):
        g = int(np.searchsorted(first, key, "right")) - 1
        return alone(block, int(key - first[g]), int(copies[g]))

    return _meet(held.unionByName(_routed(bounded, sent, starts, which, copies)), int(copies.sum()), sent, find, k, exclude, shared if alone else None)


def _promised(cells: Cells, k: int):
    """A function from moved queries to a bound of the k-th distance: k rows lie in the parts nearest by their outer ends."""

    def bound(x: np.ndarray) -> np.ndarray:
        out, step = [np.zeros(0)], cells.at_once()
        for s in range(0, len(x), step):
            reach = cells.distances(x[s : s + step])[1][:, cells.cell] + cells.far[None]
            order = np.argsort(reach, axis=1)
            enough = (np.cumsum(cells.rows[order], axis=1) >= k).argmax(1)
            out.append(np.take_along_axis(reach, order, 1)[np.arange(len(reach)), enough])
        return np.concatenate(out)

    return bound if cells.rows.sum() >= k else lambda x: np.full(len(x), np.inf)


@dataclass(frozen=True)
class Joined:
    """hits: qid, id, dist, rank or no rank; measured: one row with the pairs whose distance was looked at."""

    hits: DataFrame
    measured: DataFrame


def _result(found: DataFrame) -> Joined:
    return Joined(found.where("id IS NOT NULL").select("qid", "id", "dist"), found.agg(F.coalesce(F.sum("measured"), F.lit(0)).alias("measured")))


def nearest(corpus: DataFrame, queries: DataFrame, k: int, exclude: str = "none", max_rows: int = MAX_ROWS, pivots: int | None = None, visits: int = VISITS) -> Joined:
    """The k nearest of corpus (id, v) for each of queries (qid, qv): qid, id, dist, rank. exclude: none, id (rows of the query's id) or
    zero (distance up to 1e-9)."""
    rows, cells = dealt(corpus, max_rows, pivots)
    return search(lambda parts: rows, cells, queries, k, exclude, visits, max_rows)


def search(rows_of: Callable, cells: Cells | None, queries: DataFrame, k: int, exclude: str = "none", visits: int = VISITS, together: int = 0) -> Joined:
    """The same over rows that are dealt already: rows_of(parts) has the rows (id, v, c, s, d) of at least these parts, (cell, part).
    together: rows of a group; 0: each part is one, so that no other part than those that bounds leave is asked for."""
    spark = queries.sparkSession
    if cells is None:
        return _result(spark.createDataFrame([], _FOUND))
    cells, starts = grouped(cells, together)
    sent = spark.sparkContext.broadcast(cells)
    asked = kept(_queries(queries, sent))
    found = kept(_visited(rows_of, asked.withColumn("t", F.lit(float("inf"))), sent, starts, "own", _first, k, exclude, visits))
    # Query ids that stand repeatedly share their hits: the farthest of k or more bounds what is still looked for.
    reached = found.where("id IS NOT NULL").groupBy("qid").agg(F.count("*").alias("n"), F.max("dist").alias("t"))
    asked = asked.join(reached.withColumnRenamed("qid", "__q"), F.col("id") == F.col("__q"), "left")
    bounded = asked.select("p", "id", "v", F.when(F.col("n") >= k, F.col("t")).otherwise(float("inf")).alias("t"))

    def tighten(batches):
        own = sent.value
        promise = _promised(own, k)
        for batch in batches:
            x, t = _moved(batch.column(2), own.mean), batch.column(3).to_numpy()
            if exclude == "none":  # how many rows are left out isn't known else
                t = np.minimum(t, promise(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(t)], names=["p", "id", "v", "t"])

    bounded = kept(bounded.mapInArrow(tighten, "p int, id long, v array<double>, t double"))
    out = _result(found.unionByName(kept(_visited(rows_of, bounded, sent, starts, "others", _second, k, exclude, visits))))
    return Joined(top(out.hits, k), out.measured)


def within(corpus: DataFrame, queries: DataFrame, radius: float, max_rows: int = MAX_ROWS, pivots: int | None = None, visits: int = VISITS) -> Joined:
    """qid, id, dist of all pairs with 1e-9 < dist <= radius. Both results measure anew: pairs may be many more than rows, and aren't stored."""
    rows, cells = dealt(corpus, max_rows, pivots)
    spark = corpus.sparkSession
    if cells is None:
        return _result(spark.createDataFrame([], _FOUND))
    cells, starts = grouped(cells, max_rows)
    sent = spark.sparkContext.broadcast(cells)

    def find(block: Block, p, qid, q, t):
        for (ids, to, dist), measured in _second(block, p, qid, q, t):
            keep = (dist > TINY) & (dist <= radius)
            yield (ids[keep], to[keep], dist[keep]), measured

    bounded = kept(_queries(queries, sent).withColumn("t", F.lit(float(radius))))
    return _result(_visited(lambda parts: rows, bounded, sent, starts, "all", find, None, "none", visits))


def within_itself(corpus: DataFrame, radius: float, max_rows: int = MAX_ROWS, pivots: int | None = None, visits: int = VISITS) -> Joined:
    """The same for all rows of corpus (id, v) as queries; a pair is measured once."""
    rows, cells = dealt(corpus, max_rows, pivots)
    spark = corpus.sparkSession
    if cells is None:
        return _result(spark.createDataFrame([], _FOUND))
    cells, starts = grouped(cells, max_rows)
    sent = spark.sparkContext.broadcast(cells)
    places = spark.createDataFrame([(c, s, p) for (c, s), p in _places(cells).items()], "c int, s int, p int")
    bounded = rows.join(F.broadcast(places), ["c", "s"]).select("p", "id", "v", F.lit(float(radius)).alias("t"))  # a row for each part

    def find(*visit):
        return _both_ways(_second(*visit), radius)

    def alone(block: Block, share: int, shares: int):
        return _both_ways(_itself(block, radius, share, shares), radius)

    return _result(_visited(lambda parts: rows, bounded, sent, starts, "once", find, None, "none", visits, alone))


def neighbours(corpus: DataFrame, queries: DataFrame, k: int, exclude: str = "none", few: int = MAX_QUERIES) -> DataFrame:
    """qid, id, dist, rank, by one scan of the corpus for few queries, by cells for more."""
    if queries.limit(few + 1).count() <= few:
        return knn.nearest(corpus, queries, k, exclude=exclude, max_queries=few)
    return nearest(corpus, queries, k, exclude).hits
