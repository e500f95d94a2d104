"""A layered proximity graph whose node degrees and beams follow local density and intrinsic dimension.

Vectors are dealt into shards by a hash of their id; a shard, of bounded size, is built in one task, all shards at once.
A search runs in every shard and the best k of all are kept, so shards need no links between them. Building is in bulk:
levels come from ids, candidates from exact neighbours within the shard and layer, then signals and policy, diverse
selection, reverse links and, on layer 0, a second selection that knows the first pass's in-degrees. An insert is in bulk,
too: beams over the graph and the new vectors themselves give the candidates. Nothing depends on an insertion order. Nodes
that the entry point can't reach get a link from the nearest reached one. Deleted nodes lead searches on but are never
returned; healing ties their neighbours together and drops links to them, compaction drops the nodes.

Selection and beams are array operations over many nodes or queries at once: all beams of a block of queries take a step
together.

An index is a DataFrame with a row for each node: shard, id, v, level, m, ef, density, lid, links (for each layer from 0,
ids in order of distance), and deleted. It can be written to Parquet and read again.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.operators.knn import MAX_QUERIES, block_hits, exact, matrix, top
from nearfield.plans.session import kept

SCHEMA = "shard int, id long, v array<double>, level int, m int, ef int, density double, lid double, links array<array<long>>, deleted boolean"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Vectors of a shard, queries whose beams go together, nodes whose links are selected together.
SHARD, TOGETHER, BATCH = 20_000, 256, 64
#: The widest default beam of a stock build.
STOCK_EF = 200
#: Queries of a shard by which it is seen how wide beams have to be for a recall that is asked for.
PROBES = 128
#: Pairs of a shard that are measured at once.
MEASURED = 1 << 20
#: Beams that are at least this share of a shard see about all of it, and it is measured at once; hits that a task merges at once.
WHOLE, MERGED = 4, 1 << 20


@dataclass(frozen=True)
class GraphConfig:
    metric: str = "l2"
    adaptive: bool = True
    m_base: int = 16
    m_min: int = 8
    m_max: int = 24
    ef_base: int = 120
    ef_min: int = 40
    ef_max: int = 220
    sensitivity: float = 0.4
    decay: float = 0.75
    m_min_layer: int = 4
    hub_penalty: float = 0.15
    probe: int = 30
    kappa: float = 0.4
    beam_min: int = 16
    beam_max: int = 128
    kind: str = "continuous"
    tier: float = 0.5

    def __post_init__(self):
        if self.metric not in ("l2", "cosine"):
            raise ValueError(f"no metric {self.metric}")
        if self.kind not in ("continuous", "quantile", "lid_only", "density_only"):
            raise ValueError(f"no policy {self.kind}")


def level_of(node: int, m_base: int) -> int:
    u = (int(hashlib.md5(str(node).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296.0
    return math.floor(-math.log(u) / math.log(m_base))


def lid(dists: np.ndarray) -> float:
    d = np.sort(dists[dists > 1e-9])
    if len(d) < 3:
        return 2.0
    s = np.log(np.clip(d[:-1] / d[-1], 1e-9, 1 - 1e-9)).sum()
    return 1.0 if abs(s) < 1e-9 else float(np.clip(-(len(d) - 1) / s, 1, 1000))


def select(cand: np.ndarray, dist: np.ndarray, x: np.ndarray, m: np.ndarray, metric: str, degree: np.ndarray | None = None, penalty: float = 0.0) -> list[np.ndarray]:
    """For each row of candidates (node or -1, with ascending distances) the chosen ones, up to m, in order of distance: one is
    taken unless a taken one is nearer to it than the centre is, where distances from nodes of high degree count more; free
    places go to the nearest rejected."""
    v = x[cand]
    if metric == "l2":
        v = v - x[np.maximum(cand[:, :1], 0)]
    else:
        size = np.sqrt((v * v).sum(2))[:, :, None]
        v = np.where(size < 1e-9, 0.0, v / np.maximum(size, 1e-9))
    n = (v * v).sum(2)
    hub = None if degree is None else 1 + penalty * degree[cand] / max(1.0, float(degree.mean()))
    free, taken, at = cand >= 0, np.zeros(cand.shape, bool), np.arange(len(cand))
    own = v  # of the rows that still take
    for step in range(int(m.max(initial=0))):  # the next one of each row, and which ones are nearer to it than to the centre
        go = (step < m[at]) & free[at].any(1)
        if not go.all():
            at, own = at[go], own[go]
        if not len(at):
            break
        j = free[at].argmax(1)
        taken[at, j] = True
        cross = np.matmul(own, own[np.arange(len(at)), j][:, :, None])[:, :, 0]
        between = np.sqrt(np.maximum(n[at] + n[at, j][:, None] - 2 * cross, 0)) if metric == "l2" else np.maximum(1 - cross, 0)
        if hub is not None:
            between *= hub[at, j][:, None]
        free[at] &= ~(between < dist[at]) & (np.arange(cand.shape[1]) > j[:, None])
    spare = (cand >= 0) & ~taken
    taken |= spare & (np.cumsum(spare, axis=1) <= (m - taken.sum(1))[:, None])
    return [c[t] for c, t in zip(cand, taken, strict=True)]


def _padded(lists: list, fill, kind) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=0)), fill, kind)
    for k, row in enumerate(lists):
        out[k, : len(row)] = row
    return out


class Shard:
    """Nodes are places in ids, which are sorted. links: for each layer {node: its links, nearest first}."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, c: GraphConfig):
        self.ids, self.x, self.c = ids, x, c
        self.deleted = np.zeros(len(ids), bool)
        self.links = []

    @property
    def links(self) -> list[dict[int, list[int]]]:
        if self._links is None:  # read from a table, and so far only searched
            rows = [[r[r >= 0].tolist() for r in m] for m in self._matrices]
            self._links = [{int(u): r[u] for u in np.flatnonzero(self.level[: len(r)] >= layer)} for layer, r in enumerate(rows)]
        return self._links

    @links.setter
    def links(self, layers: list[dict[int, list[int]]]) -> None:
        self._links, self._matrices = layers, None

    def _changed(self) -> None:
        """What links say is no longer in the matrices."""
        self._links, self._matrices = self.links, None

    # Building

    def _nearest(self, of: np.ndarray, members: np.ndarray, k: int) -> tuple[list, list]:
        """For each node of `of` its k nearest other members: their distances, and the nodes."""
        x, dists, nodes = self.x[members], [], []
        k = min(k + 1, len(members))
        step = max(16, min(TOGETHER, MEASURED // max(1, len(x))))
        if self.c.metric == "l2":
            mean = x.mean(0)
            y = x - mean
            size = (y * y).sum(1)[None]
        else:
            unit = lambda a: a / np.maximum(np.sqrt((a * a).sum(1)), 1e-9)[:, None]
            y = unit(x)
        for s in range(0, len(of), step):
            mine = of[s : s + step]
            part = self.x[mine]
            if self.c.metric == "l2":
                d = (-2 * (part - mean)) @ y.T
                d += size
            else:
                d = -unit(part) @ y.T
            at = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(mine), 0), int)
            to = members[at]
            far = exact(self.x[to], part[:, None], self.c.metric)
            far[to == mine[:, None]] = np.inf  # the node itself
            order = np.lexsort((to, far), axis=1)
            for t, f in zip(np.take_along_axis(to, order, 1), np.take_along_axis(far, order, 1), strict=True):
                keep = np.isfinite(f)
                nodes.append(t[keep])
                dists.append(f[keep])
        return dists, nodes

    def _signals(self, dists: list) -> tuple[np.ndarray, np.ndarray]:
        probe = [d[: self.c.probe] for d in dists]
        return np.array([p.mean() if len(p) else 1.0 for p in probe], float), np.array([lid(p) for p in probe], float)

    def score(self, density: np.ndarray, lids: np.ndarray) -> np.ndarray:
        """How hard nodes of these signals are, beside the shard's nodes."""
        z = lambda a, all_: (a - all_.mean()) / ((all_.std() if all_.std() > 1e-6 else 1.0) + 1e-6)
        share = {"lid_only": 1.0, "density_only": 0.0}.get(self.c.kind, 0.5)
        return np.clip(share * z(lids, self.lid) + (1 - share) * z(density, self.density), -3, 3)

    def _policy(self, density: np.ndarray, lids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.c
        if not c.adaptive or not len(density):
            return np.full(len(density), c.m_base), np.full(len(density), STOCK_EF)
        score = self.score(density, lids)
        if c.kind == "quantile":
            pick = lambda low, middle, high: np.where(score > c.tier, high, np.where(score < -c.tier, low, middle))
            return pick(c.m_min, c.m_base, c.m_max), pick(c.ef_min, c.ef_base, c.ef_max)
        f = 1 + c.sensitivity * score
        return np.clip(np.rint(c.m_base * f), c.m_min, c.m_max).astype(int), np.clip(np.rint(c.ef_base * f), c.ef_min, c.ef_max).astype(int)

    def neighbours(self, k: int = 0) -> tuple[list, list]:
        """What build() begins with; shards of the same vectors and metric share it. k: more of them, for others that need them."""
        return self._nearest(np.arange(len(self.ids)), np.arange(len(self.ids)), max(k, self.widest))

    @property
    def widest(self) -> int:
        return self.c.ef_max if self.c.adaptive else STOCK_EF

    def build(self, near: tuple[list, list] | None = None) -> Shard:
        c, n = self.c, len(self.ids)
        self.level = np.array([level_of(int(i), c.m_base) for i in self.ids], int)
        near = near or self.neighbours()
        self.density, self.lid = self._signals(near[0])
        self.m, self.ef = self._policy(self.density, self.lid)
        self.links = []
        for layer in range(int(self.level.max(initial=0)) + 1):
            members = np.flatnonzero(self.level >= layer)
            if layer:
                near = self._nearest(members, members, int(self.ef.max(initial=1)))
            links = self._layer(layer, members, near, None)
            if layer == 0 and c.adaptive and c.hub_penalty:
                degree = np.bincount([w for ws in links.values() for w in ws], minlength=n)
                links = self._layer(layer, members, near, degree)
            self.links.append(links)
        self._join_up()
        return self

    def _budget(self, node, layer: int):
        """The links that a node chooses, and the most it may have."""
        m = self.m[node]
        up = np.maximum(self.c.m_min_layer, np.floor(m * self.c.decay**layer)).astype(int) if self.c.adaptive else m
        return (m, 2 * m) if layer == 0 else (up, up)

    def _chosen(self, nodes: np.ndarray, dists: list, cands: list, most: np.ndarray, degree) -> dict[int, list[int]]:
        """select() for many nodes, those with about as many candidates together."""
        out: dict[int, list[int]] = {}
        order = np.argsort([len(w) for w in cands], kind="stable")
        for s in range(0, len(order), BATCH):
            at = order[s : s + BATCH].tolist()
            cand, dist = _padded([cands[i] for i in at], -1, np.int64), _padded([dists[i] for i in at], np.inf, float)
            if cand.shape[1]:
                got = select(cand, dist, self.x, most[at], self.c.metric, degree, self.c.hub_penalty)
                out.update((int(nodes[i]), g.tolist()) for i, g in zip(at, got, strict=True))
            else:
                out.update((int(nodes[i]), []) for i in at)
        return out

    def _layer(self, layer: int, members: np.ndarray, near: tuple[list, list], degree) -> dict[int, list[int]]:
        ef = self.ef[members]
        out = self._chosen(members, [d[:e] for d, e in zip(near[0], ef, strict=True)], [w[:e] for w, e in zip(near[1], ef, strict=True)], self._budget(members, layer)[0], degree)
        of, to = np.repeat(members, [len(out[u]) for u in members.tolist()]), np.fromiter((w for u in members.tolist() for w in out[u]), int)
        both = np.unique(np.concatenate([of, to]) * len(self.ids) + np.concatenate([to, of]))  # each link once, by nodes, as members are
        of, to = np.divmod(both, len(self.ids))
        return self._cut(layer, members, np.bincount(of, minlength=len(self.ids))[members], to, degree)

    def _trimmed(self, layer: int, links: dict, degree) -> dict[int, list[int]]:
        """Each node's links in order of distance; where they are over its budget, the chosen ones."""
        nodes = np.array(list(links), int)
        count = np.array([len(ws) for ws in links.values()], int)
        return self._cut(layer, nodes, count, np.fromiter((w for ws in links.values() for w in ws), int, count.sum()), degree)

    def _cut(self, layer: int, nodes: np.ndarray, count: np.ndarray, to: np.ndarray, degree) -> dict[int, list[int]]:
        """The same of links in arrays: so many for each node, one node's after another's."""
        of = np.repeat(nodes, count)
        dist = np.concatenate([exact(self.x[of[s : s + 8192]], self.x[to[s : s + 8192]], self.c.metric) for s in range(0, len(of), 8192)] or [np.zeros(0)])
        order = np.lexsort((to, dist, np.repeat(np.arange(len(nodes)), count)))
        to, dist, ends = to[order], dist[order], np.cumsum(count)
        most = self._budget(nodes, layer)[1] if len(nodes) else count
        out = {int(u): to[e - n : e].tolist() for u, n, e in zip(nodes, count, ends, strict=True)}
        over = np.flatnonzero(count > most)
        cut = [slice(ends[k] - count[k], ends[k]) for k in over]
        out.update(self._chosen(nodes[over], [dist[c] for c in cut], [to[c] for c in cut], most[over], degree))
        return out

    def _join_up(self) -> None:
        """Ties live nodes that the entry can't reach on layer 0 to the nearest reached one."""
        self._changed()
        at = self.entry()
        self._changed()
        if at < 0:
            return
        links, seen = self.links[0], np.zeros(len(self.ids), bool)
        todo = [at]
        while True:
            while todo:
                u = todo.pop()
                if not seen[u]:
                    seen[u] = True
                    todo += [w for w in links[u] if not seen[w]]
            rest = np.flatnonzero(~seen & ~self.deleted)
            if not len(rest):
                return
            u, reached = int(rest[0]), np.flatnonzero(seen)
            d = exact(self.x[reached], self.x[u], self.c.metric)
            links[int(reached[d.argmin()])].append(u)
            todo = [u]

    # Changes

    def insert(self, ids: np.ndarray, x: np.ndarray) -> Shard:
        """A shard that has the new nodes as well. Their candidates come from beams over the graph and from each other."""
        if not len(self.ids):
            return Shard(ids, x, self.c).build()
        old = len(self.ids)
        if not len(ids):
            return self
        new = np.arange(old, old + len(ids))
        first = self.search_many(x, 1, 1, levels=True)  # the way down: for each layer, where a beam starts
        widest = self.c.ef_max if self.c.adaptive else STOCK_EF

        def beams(starts: np.ndarray, layer: int) -> tuple:
            some = [slice(s, s + TOGETHER) for s in range(0, len(x), TOGETHER)]
            got = [self._beams(x[b], starts[b], np.full(len(x[b]), widest), layer)[0] for b in some]
            return tuple(np.concatenate(c) for c in zip(*got, strict=True))

        found = [beams(starts, layer) if starts is not None else None for layer, starts in enumerate(first)]
        self._changed()
        self.ids, self.x = np.r_[self.ids, ids], np.concatenate([self.x, x])
        self.deleted = np.r_[self.deleted, np.zeros(len(ids), bool)]
        level = np.array([level_of(int(i), self.c.m_base) for i in ids], int)
        self.level = np.r_[self.level, level]

        def candidates(layer: int) -> tuple[list, list]:
            at = new[self.level[new] >= layer]
            own = self._nearest(at, at, widest)
            dists, nodes = [], []
            for u, d, w in zip(at.tolist(), *own, strict=True):
                if layer < len(found) and found[layer] is not None:
                    fd, fw = found[layer][0][u - old], found[layer][1][u - old]
                    live = np.isfinite(fd) & ~self.deleted[np.maximum(fw, 0)] & (fw >= 0)
                    d, w = np.r_[d, fd[live]], np.r_[w, fw[live]]
                order = np.lexsort((w, d))[:widest]
                dists.append(d[order])
                nodes.append(w[order])
            return dists, nodes

        near = candidates(0)
        density, lids = self._signals(near[0])
        m, ef = self._policy(density, lids)
        self.density, self.lid, self.m, self.ef = np.r_[self.density, density], np.r_[self.lid, lids], np.r_[self.m, m], np.r_[self.ef, ef]
        for layer in range(int(level.max(initial=0)) + 1):
            at = new[self.level[new] >= layer]
            if layer == len(self.links):
                self.links.append({})
            dists, nodes = near if layer == 0 else candidates(layer)
            got = self._chosen(at, [d[:e] for d, e in zip(dists, self.ef[at], strict=True)], [w[:e] for w, e in zip(nodes, self.ef[at], strict=True)], self._budget(at, layer)[0], None)
            links = self.links[layer]
            touched = {u: set(ws) for u, ws in got.items()}
            for u, ws in got.items():
                for w in ws:
                    touched.setdefault(w, set(links.get(w, ()))).add(u)
            links.update(self._trimmed(layer, touched, None))
        self._join_up()
        return self._sorted()

    def _sorted(self) -> Shard:
        """The same with nodes in the order of their ids."""
        order = np.argsort(self.ids, kind="stable")
        return self._taken(order)

    def _taken(self, order: np.ndarray) -> Shard:
        """The shard of those nodes, in that order; links to others go."""
        place = np.full(len(self.ids), -1)
        place[order] = np.arange(len(order))
        out = Shard(self.ids[order], self.x[order], self.c)
        for name in ("level", "m", "ef", "density", "lid", "deleted"):
            setattr(out, name, getattr(self, name)[order])
        out.links = [{int(place[u]): [int(place[w]) for w in ws if place[w] >= 0] for u, ws in layer.items() if place[u] >= 0} for layer in self.links]
        while out.links and not out.links[-1]:
            out.links.pop()
        return out

    def heal(self) -> Shard:
        """Live nodes lose their links to dead ones and choose again among what is left and the dead ones' live links; the dead
        keep theirs, so that a beam that starts there finds a way."""
        for layer, links in enumerate(self.links):
            changed = {}
            for u, ws in links.items():
                lost = [w for w in ws if self.deleted[w]]
                if lost and not self.deleted[u]:
                    changed[u] = {w for w in ws if not self.deleted[w]} | {w for d in lost for w in links.get(d, ()) if w != u and not self.deleted[w]}
            for u, ws in list(changed.items()):
                for w in ws:  # both ways
                    if u not in links.get(w, ()):
                        changed.setdefault(w, {y for y in links.get(w, ()) if not self.deleted[y]}).add(u)
            links.update(self._trimmed(layer, changed, None))
        self._join_up()
        return self

    def compact(self) -> Shard:
        """The shard without its dead nodes."""
        out = self.heal()._taken(np.flatnonzero(~self.deleted))
        out._join_up()
        return out

    # Searching

    def entry(self) -> int:
        """On the highest layer that has a live node with a link, the one of most links; else the first live node, or -1."""
        for links in reversed(self._links_of()):
            degree = np.where(self.deleted, 0, (links >= 0).sum(1))
            if degree.any():
                return int(degree.argmax())
        live = np.flatnonzero(~self.deleted)
        return int(live[0]) if len(live) else -1

    def _links_of(self) -> list[np.ndarray]:
        """[node, place] for each layer: its links, -1 where there are none."""
        if self._matrices is None:
            self._matrices = [_padded([layer.get(u, ()) for u in range(len(self.ids))], -1, np.int64) for layer in self._links]
        return self._matrices

    def _beams(self, q: np.ndarray, starts: np.ndarray, ef: np.ndarray, layer: int, patience: int = 0, eps: float = 1e-4, x: np.ndarray | None = None, trace: list | None = None, noted: dict | None = None):
        """Best first, a step of all queries at a time: ((distances, nodes) [query, rank], evaluations). A beam ends when each of
        its ef nearest was looked at. patience > 0 ends it after so many steps in a row that improved nothing, once it is full.
        noted: {patience: } gets the same for other, lesser ones, as beams pass where these end."""
        x, links, n = self.x if x is None else x, self._links_of()[layer], len(q)
        if n and not patience and not noted and trace is None and ef.min() >= len(self.ids):
            return self._all_reached(q, starts, layer, x)
        width = int(min(ef.max(initial=1), len(self.ids)))
        dist, node, done = np.full((n, width), np.inf), np.full((n, width), -1), np.zeros((n, width), bool)
        limit = np.minimum(ef, width)
        seen = np.zeros(n * len(self.ids), bool)
        evals, still, rows = np.ones(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        node[:, 0], dist[:, 0], seen[rows * len(self.ids) + starts] = starts, exact(x[starts], q, self.c.metric), True
        beyond = np.arange(width)[None] >= limit[:, None]
        past = {p: np.zeros(n, bool) for p in noted or ()}
        for p in past:
            noted[p] = ((dist.copy(), node.copy()), evals.copy())
        active = rows
        while len(active):
            waiting = (node[active] >= 0) & ~done[active]
            has = waiting.any(1)
            if trace is not None and not has.all():
                trace.append(("prune_w", int(node[0, 0]), -1, layer, float(dist[0, limit[0] - 1])))
            active, waiting = active[has], waiting[has]
            if not len(active):
                break
            k = waiting.argmax(1)
            done[active, k] = True
            at = node[active, k]
            to = links[at]
            place = (active * len(self.ids))[:, None] + np.maximum(to, 0)
            fresh = (to >= 0) & ~seen.take(place)
            if patience or past:
                best, worst, size = dist[active, 0], dist[active, limit[active] - 1], (node[active] >= 0).sum(1)
                full = node[active, limit[active] - 1] >= 0
            row, col = np.nonzero(fresh)
            if len(row):
                of, w = active[row], to[row, col]
                seen[place[row, col]] = True
                evals += np.bincount(of, minlength=n)
                d = exact(x[w], q[of], self.c.metric)
                enters = d < dist[of, limit[of] - 1]  # a full beam's equals stay before
                self._enter(dist, node, done, beyond, of[enters], w[enters], d[enters])
                if trace is not None:
                    kept = set(node[0].tolist())
                    trace += [("explore", u, int(at[0]), layer, y) for u, y in sorted(zip(w.tolist(), d.tolist(), strict=True), key=lambda p: p[1]) if u in kept]
            if patience or past:
                now = dist[active, limit[active] - 1]
                shrunk = np.where(full, worst - np.where(full, now, 0), 0)
                better = ((node[active] >= 0).sum(1) > size) | (shrunk > eps) | (best - dist[active, 0] > eps)
                is_full = node[active, limit[active] - 1] >= 0
                still[active] = np.where(is_full & ~better, still[active] + 1, 0)
                for p, over in past.items():
                    first = active[(still[active] >= p) & ~over[active]]
                    self._note(noted[p], dist, node, evals, first)
                    over[first] = True
                stop = (still[active] >= patience) & (patience > 0)
                if trace is not None and stop.any():
                    trace.append(("early_exit", int(at[0]), -1, layer, float(dist[0, 0])))
                active = active[~stop]
        for p, over in past.items():
            self._note(noted[p], dist, node, evals, np.flatnonzero(~over))
        return (dist, node), evals

    @staticmethod
    def _note(into: tuple, dist: np.ndarray, node: np.ndarray, evals: np.ndarray, rows: np.ndarray) -> None:
        (d, w), e = into
        d[rows], w[rows], e[rows] = dist[rows], node[rows], evals[rows]

    @staticmethod
    def _enter(dist: np.ndarray, node: np.ndarray, done: np.ndarray, beyond: np.ndarray, of: np.ndarray, w: np.ndarray, d: np.ndarray) -> None:
        """Puts nodes w into the beams `of`, one beam's after another's, in order of distance, those that were there first."""
        if not len(of):
            return
        new = np.diff(of, prepend=of[0] - 1) != 0
        b, first = of[new], np.flatnonzero(new)
        line = np.cumsum(new) - 1
        at = np.arange(len(of)) - first[line]
        more = (len(b), int(at.max()) + 1)
        more_d, more_n = np.full(more, np.inf), np.full(more, -1)
        more_d[line, at], more_n[line, at] = d, w
        all_d, all_n = np.concatenate([dist[b], more_d], 1), np.concatenate([node[b], more_n], 1)
        all_done = np.concatenate([done[b], np.zeros(more, bool)], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, : dist.shape[1]]
        order += (np.arange(len(b)) * all_d.shape[1])[:, None]
        out = beyond[b]
        dist[b], node[b], done[b] = np.where(out, np.inf, all_d.take(order)), np.where(out, -1, all_n.take(order)), all_done.take(order)

    def _all_reached(self, q: np.ndarray, starts: np.ndarray, layer: int, x: np.ndarray):
        """What beams that are never full end with: all nodes that links lead to from a query's start, in whatever order they were
        looked at, once each. Their distances come a few queries at a time, in order of distance and, as in a beam, without a rule for
        equals."""
        n = len(q)
        dist, node, evals = np.full((n, len(self.ids)), np.inf), np.full((n, len(self.ids)), -1), np.zeros(n, np.int64)
        for start in np.unique(starts):
            reached = self._reached(int(start), layer)
            for i in np.flatnonzero(starts == start):
                d = exact(x[reached], q[i], self.c.metric)
                order = np.argsort(d, kind="stable")
                dist[i, : len(order)], node[i, : len(order)], evals[i] = d[order], reached[order], len(order)
        return (dist, node), evals

    def _all_hits(self, q: np.ndarray, starts: np.ndarray, k: int) -> tuple[tuple, np.ndarray]:
        """The k best live hits of beams on layer 0 that are never full, in products, and how many nodes each beam reaches. From a
        start that the entry leads to and that leads to the entry, these are the nodes that the entry leads to."""
        at, links = self.entry(), self._links_of()[0]
        reached = self._reached(at, 0)
        leads, before, inside = np.zeros(len(self.ids), bool), 0, np.zeros(len(self.ids), bool)
        leads[at], inside[reached] = True, True
        while leads.sum() > before:
            before = leads.sum()
            leads |= ((links >= 0) & leads[links]).any(1)
        same = leads[starts] & inside[starts]
        parts, n_reached = [], np.zeros(len(q), np.int64)
        for mine, nodes in [(np.flatnonzero(same), reached), *((np.flatnonzero(starts == u), self._reached(int(u), 0)) for u in np.unique(starts[~same]))]:
            live = nodes[~self.deleted[nodes]]
            row, place, _ = block_hits(mine, q[mine], live, self.x[live], k, self.c.metric, "none") if len(mine) and len(live) else (np.zeros(0, int),) * 3
            n_reached[mine] = len(nodes)
            parts.append((row, place))
        row, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        d = exact(self.x[w], q[row], self.c.metric)
        order = np.lexsort((self.ids[w], d, row))
        return (row[order], self.ids[w[order]], d[order]), n_reached

    def _reached(self, start: int, layer: int) -> np.ndarray:
        """The nodes that links lead to from one, itself included."""
        links, seen, front = self._links_of()[layer], np.zeros(len(self.ids), bool), np.array([start])
        while len(front):
            seen[front] = True
            to = links[front]
            front = np.unique(to[to >= 0])
            front = front[~seen[front]]
        return np.flatnonzero(seen)

    def coded(self, bits: int) -> np.ndarray:
        """The vectors as they come back from codes of so many bits for each dimension, of the live vectors' range."""
        live = self.x[~self.deleted] if (~self.deleted).any() else self.x
        low, high, steps = live.min(0), live.max(0), (1 << bits) - 1
        scale = np.where(high - low <= 1e-7, 1.0, (high - low) / steps)
        return low + np.clip(np.rint((self.x - low) / scale), 0, steps) * scale

    def search_many(self, q: np.ndarray, k: int, ef: int, patience: int = 0, dynamic: str = "", bits: int = 0, pool: int = 0, trace: list | None = None, levels: bool = False, recall: float = 0.0) -> list:
        """For each query (hits as (distance, id), evaluations, used ef); the dead lead on, but aren't returned. dynamic: a beam as
        wide as the entry's score (score), or that and the query's distance from it (hardness), ask for. bits: beams over codes
        of 8 or 4 bits, whose first `pool` live hits (0: all) are measured again exactly. levels: where beams start, by layer. recall: the
        share of a query's k nearest of the shard that is wanted; see _enough."""
        if levels:
            at, layers = self.entry(), len(self._links_of())
            return self._way_down(q, self.x, at, None)[0] if at >= 0 and len(q) else [None] * layers
        (row, ids, dist), evals, used = self.found_many(q, k, ef, patience, dynamic, bits, pool, trace, recall)
        ends = np.searchsorted(row, np.arange(len(q) + 1)).tolist()
        hits = list(zip(dist.tolist(), ids.tolist(), strict=True))
        return [(hits[a:z], e, u) for a, z, e, u in zip(ends[:-1], ends[1:], evals.tolist(), used.tolist(), strict=True)]

    def _way_down(self, q: np.ndarray, x: np.ndarray, at: int, trace: list | None) -> tuple[list, np.ndarray]:
        """For each layer where beams start, and evaluations above layer 0."""
        n, layers = len(q), len(self._links_of())
        starts, evals, way = np.full(n, at), np.zeros(n, np.int64), [None] * layers
        for layer in range(layers - 1, 0, -1):
            if self.level[at] >= layer:
                got, e = [], []
                for s in range(0, n, TOGETHER):
                    b = self._beams(q[s : s + TOGETHER], starts[s : s + TOGETHER], np.ones(len(q[s : s + TOGETHER]), int), layer, x=x, trace=trace)
                    got.append(b[0][1][:, 0])
                    e.append(b[1])
                way[layer] = starts
                starts, evals = np.concatenate(got), evals + np.concatenate(e)
        way[0] = starts
        return way, evals

    def found_many(self, q: np.ndarray, k: int, ef: int, patience: int = 0, dynamic: str = "", bits: int = 0, pool: int = 0, trace: list | None = None, recall: float = 0.0) -> tuple[tuple, np.ndarray, np.ndarray]:
        """What search_many says, as arrays: hits as (place of the query, id, distance), evaluations, used ef. A shard of which a beam
        would be a quarter or more is measured whole, in products: such a beam's links lead to about all of it as well, at a step each. So is what the links of one as
        wide as the shard lead to."""
        at, n = self.entry(), len(q)
        if at < 0 or not n:
            return (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)), np.zeros(n, np.int64), np.full(n, ef)
        dead = int(self.deleted.sum())
        if not (patience or dynamic or bits) and trace is None and ef < len(self.ids) <= WHOLE * ef:
            reached = self._reached(at, 0)
            live = reached[~self.deleted[reached]]
            row, ids, dist = block_hits(np.arange(n), q, self.ids[live], self.x[live], min(k, ef), self.c.metric, "none")
            return (row, ids, dist), np.full(n, len(reached)), np.full(n, min(2 * ef, ef + ef * dead // len(self.ids)))
        x = self.coded(bits) if bits else self.x
        if trace is not None:
            trace.append(("enter", at, -1, len(self._links_of()) - 1, float(exact(x[at], q[0], self.c.metric))))
        way, evals = self._way_down(q, x, at, trace)
        starts = way[0]
        wide = np.full(n, max(ef, pool))
        if dynamic:
            hard = self.score(self.density[starts], self.lid[starts])
            if dynamic == "score":
                wide = np.floor(np.clip(ef * (1 + 0.3 * hard), k, 2 * ef)).astype(int)
            elif dynamic == "hardness":
                std = self.density.std() if self.density.std() > 1e-6 else 1.0
                z = np.clip((exact(x[starts], q, self.c.metric) - self.density.mean()) / (std + 1e-6), -2, 2)
                wide = np.clip(np.floor(ef * (1 + self.c.kappa * (0.7 * hard + 0.3 * z)) + 0.5), self.c.beam_min, self.c.beam_max).astype(int)
            else:
                raise ValueError(f"no dynamic beam {dynamic}")
        wide = np.minimum(2 * wide, wide + wide * dead // max(1, len(self.ids)))
        if not (patience or dynamic or bits) and trace is None and ef >= len(self.ids):
            hits, n_reached = self._all_hits(q, starts, k)
            return hits, evals + n_reached, wide
        if recall:
            more = self._enough(q, starts, wide, k, recall, patience, bits, pool, x)
            wide, patience, pool = wide * more, patience * more, pool * more
        out = []
        for s in range(0, n, TOGETHER):
            mine = slice(s, s + TOGETHER)
            found, e = self._beams(q[mine], starts[mine], wide[mine], 0, patience, x=x, trace=trace)
            row, ids, dist = self._hits(q[mine], *found, k, bits, pool)
            out.append((row + s, ids, dist))
            evals[mine] += e
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)), evals, wide

    def found_for(self, q: np.ndarray, k: int, ef: int, hows: list[dict], recall: float = 0.0) -> list[tuple]:
        """found_many for each of hows. Those that differ in patience alone share their beams, as far as these are of one width."""
        out = [None] * len(hows)
        alike = [i for i, how in enumerate(hows) if set(how) <= {"patience"} and (how.get("patience") or len(self.ids) > WHOLE * ef)]
        if len(alike) < 2 or not len(q) or self.entry() < 0:
            alike = []
        for i in set(range(len(hows))) - set(alike):
            out[i] = self.found_many(q, k, ef, recall=recall, **hows[i])
        if not alike:
            return out
        way, above = self._way_down(q, self.x, self.entry(), None)
        starts, wide = way[0], np.full(len(q), ef)
        wide = np.minimum(2 * wide, wide + wide * int(self.deleted.sum()) // len(self.ids))
        groups: dict[int, list[int]] = {}
        for i in alike:
            times = self._enough(q, starts, wide, k, recall, hows[i].get("patience", 0), 0, 0, self.x) if recall else 1
            groups.setdefault(times, []).append(i)
        for times, mine in groups.items():
            stops = {i: hows[i].get("patience", 0) * times for i in mine}
            last = 0 if 0 in stops.values() else max(stops.values())
            parts = {p: [] for p in stops.values()}
            for s in range(0, len(q), TOGETHER):
                b = slice(s, s + TOGETHER)
                noted = {p: None for p in parts if p != last}
                noted[last] = self._beams(q[b], starts[b], times * wide[b], 0, last, noted=noted)
                for p, (found, e) in noted.items():
                    row, ids, dist = self._hits(q[b], *found, k, 0, 0)
                    parts[p].append((row + s, ids, dist, e))
            for i, p in stops.items():
                *hits, evals = (np.concatenate(c) for c in zip(*parts[p], strict=True))
                out[i] = tuple(hits), above + evals, times * wide
        return out

    def _hits(self, q: np.ndarray, dist: np.ndarray, node: np.ndarray, k: int, bits: int, pool: int) -> tuple:
        """The k best live hits of each beam as (place of the query, id, distance); those over codes are measured again."""
        live = (node >= 0) & ~self.deleted[np.maximum(node, 0)]
        if bits and pool:
            live &= np.cumsum(live, axis=1) <= pool
        row, at = np.nonzero(live)
        w = node[row, at]
        d = exact(self.x[w], q[row], self.c.metric) if bits else dist[row, at]
        order = np.lexsort((self.ids[w], d, row))
        row, w, d = row[order], w[order], d[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[best], self.ids[w[best]], d[best]

    def _enough(self, q: np.ndarray, starts: np.ndarray, wide: np.ndarray, k: int, recall: float, patience: int, bits: int, pool: int, x: np.ndarray) -> int:
        """How many times as wide, and as patient, beams have to be: a power of 2 with which up to PROBES of the queries, evenly taken, find
        a share `recall` of their k nearest live nodes, or from which twice as much finds no more. What this measures doesn't
        count as a query's evaluations; it is bounded for a shard, whatever the queries are."""
        some = np.unique(np.linspace(0, len(q) - 1, min(len(q), PROBES)).astype(int))
        q, starts, wide = q[some], starts[some], wide[some]
        live = np.flatnonzero(~self.deleted)
        k, times, before = min(k, len(live)), 1, -1.0
        true = np.array([np.partition(exact(self.x[live], v, self.c.metric), k - 1)[k - 1] + 1e-9 for v in q] if k else [])
        while k and wide.min() * times < len(self.ids):
            found = self._beams(q, starts, wide * times, 0, patience * times, x=x)[0]
            row, _, dist = self._hits(q, *found, k, bits, pool * times)
            share = (dist <= true[row]).sum() / (k * len(q))
            if share >= recall:
                break
            if share <= before + 0.002:
                return times // 2
            times, before = 2 * times, share
        return times

    def search(self, q, k: int, ef: int, patience: int = 0, trace: list | None = None, **how):
        return self.search_many(np.asarray(q, float)[None], k, ef, patience, trace=trace, **how)[0]

    # As a table

    def table(self, shard: int) -> pa.Table:
        links = [[[int(self.ids[w]) for w in layer[u]] for layer in self.links if u in layer] for u in range(len(self.ids))]
        cols = [[shard] * len(self.ids), self.ids, self.x.tolist(), self.level, self.m, self.ef, self.density, self.lid, links, self.deleted]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.list_(pa.int64())), pa.bool_()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=NAMES)

    @classmethod
    def of(cls, t: pa.Table, c: GraphConfig) -> Shard:
        t = t.sort_by("id").combine_chunks()
        s = cls(t["id"].to_numpy(), matrix(t["v"].combine_chunks()) if t.num_rows else np.zeros((0, 0)), c)
        outer = t["links"].combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.list_(pa.int64())))
        inner = outer.flatten()
        layers, first = np.diff(outer.offsets.to_numpy()), outer.offsets.to_numpy()[:-1] - (outer.offsets.to_numpy()[0] if len(outer) else 0)
        ends, to = inner.offsets.to_numpy(), inner.flatten().to_numpy()
        ends = ends - (ends[0] if len(ends) else 0)
        place = np.minimum(np.searchsorted(s.ids, to), max(0, len(s.ids) - 1))
        place = np.where(s.ids[place] == to, place, -1) if len(to) else place
        s._links, s._matrices = None, []
        for layer in range(int(layers.max(initial=0))):
            u = np.flatnonzero(layers > layer)
            at = first[u] + layer
            count = ends[at + 1] - ends[at]
            links = np.full((len(s.ids), int(count.max(initial=0))), -1, np.int64)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            links[np.repeat(u, count), k] = place[np.repeat(ends[at], count) + k]
            s._matrices.append(links)
        for name in ("level", "m", "ef", "density", "lid"):
            setattr(s, name, t[name].to_numpy())
        s.deleted = np.array(t["deleted"].to_pylist(), bool)
        return s


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    return rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))


def _valid(rows: DataFrame) -> DataFrame:
    """Of repeated ids the least vector, so that a task that runs again has the same one."""
    return rows.where("v IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))


def build(corpus: DataFrame, config: GraphConfig = GraphConfig(), shard_size: int = SHARD) -> DataFrame:
    """The index of corpus (id, v); null vectors are left out, of repeated ids the least vector stays."""
    corpus = _valid(corpus)
    shards = max(1, -(-corpus.count() // shard_size))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        return Shard(t["id"].to_numpy(), matrix(t["v"].combine_chunks()), config).build().table(t["shard"][0].as_py())

    return _dealt(corpus, shards).groupBy("shard").applyInArrow(run, SCHEMA)


def insert(index: DataFrame, rows: DataFrame, config: GraphConfig = GraphConfig(), shard_size: int = SHARD) -> DataFrame:
    """The index with rows (id, v) linked in; ids that it has, and null vectors, are left out. Only shards that get rows change. When
    shards would hold twice their size on average, the index is built anew from its live nodes, in more shards."""
    index = kept(index.select(NAMES))  # it is read several times, and would be built as often
    rows = kept(_valid(rows.select("id", "v")).join(index.select("id"), "id", "left_anti"))
    stats = index.agg(F.max("shard").alias("last"), F.count("*").alias("n")).first()
    if stats.last is None or stats.n + rows.count() > 2 * shard_size * (stats.last + 1):
        live = index.where("NOT deleted").select("id", "v")
        return build(live.unionByName(rows.select(F.col("id").cast("long"), F.col("v").cast("array<double>"))), config, shard_size)

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        if not new.num_rows:
            return old.select(NAMES)
        new = new.sort_by("id").combine_chunks()
        return Shard.of(old, config).insert(new["id"].to_numpy(), matrix(new["v"].combine_chunks())).table(new["shard"][0].as_py())

    return index.select(NAMES).groupBy("shard").cogroup(_dealt(rows, stats.last + 1).groupBy("shard")).applyInArrow(run, SCHEMA)


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index with those nodes marked dead."""
    dead = ids.select(F.col("id").cast("long")).distinct().withColumn("__dead", F.lit(True))
    return index.join(dead, "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("__dead", F.lit(False))).select(NAMES)


def _changed(index: DataFrame, change, config: GraphConfig) -> DataFrame:
    return index.select(NAMES).groupBy("shard").applyInArrow(lambda t: change(Shard.of(t, config)).table(t["shard"][0].as_py()), SCHEMA)


def heal(index: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """The index whose live nodes no longer link to dead ones, but to those around them."""
    return _changed(index, Shard.heal, config)


def compact(index: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """The index without its dead nodes, healed."""
    return _changed(index, Shard.compact, config)


FOUND = "qid long, id long, dist double, n_evals long, used_ef int, first boolean"


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of all shards, with the evaluations in all of them, also in those without a hit."""
    spent = F.sum(F.when(F.col("first"), F.col("n_evals"))).over(Window.partitionBy("qid"))
    return top(hits.withColumn("n_evals", spent).where("id IS NOT NULL").drop("first"), k)


def search(index: DataFrame, queries: DataFrame, k: int = 10, ef: int | None = None, config: GraphConfig = GraphConfig(), patience: int = 0, max_queries: int = 20_000, **how) -> DataFrame:
    """qid, id, dist, rank, n_evals (of the query in all shards), used_ef (in the hit's shard). queries: qid, qv. Up to max_queries are broadcast; more
    are dealt into blocks, and each shard meets each block in a task of its own. ef: by default half the build's, k at least; less
    than k gives fewer hits. how: dynamic, bits, pool, recall as for a shard: with a recall wanted, ef and patience are the least, and a
    shard where a sample of the queries finds less widens its beams."""
    queries = queries.select(F.col("qid").cast("long"), F.col("qv").cast("array<double>").alias("qv")).where("qv IS NOT NULL")
    blocks = max(1, -(-queries.count() // max_queries))
    ef = max(k, (config.ef_base if config.adaptive else STOCK_EF) // 2) if ef is None else ef

    def found(t: pa.Table, ids: np.ndarray, q: np.ndarray) -> pa.Table:
        """The k best hits of each query in the shards of t, and what it cost in all of them."""
        evals, wide, hits = np.zeros(len(ids), np.int64), np.full(len(ids), ef), [np.zeros((0, 4))[:, c].astype(kind) for c, kind in enumerate((int, np.int64, float, int))]
        parts, held = [hits], 0
        for one in _shards(t) if len(ids) else ():
            (row, to, dist), cost, used = Shard.of(one, config).found_many(q, k, ef, patience, **how)
            evals += cost
            wide = used
            parts.append((row, to, np.round(dist, 9), used[row]))
            held += len(row)
            if held > MERGED:
                parts = [_merged(parts, k)]
                held = len(parts[0][0])
        row, to, dist, used = _merged(parts, k)
        none = np.arange(len(ids) + len(row)) < len(ids)  # the cost, and the hits
        col = lambda a, fill, kind: pa.array(np.concatenate([np.full(len(ids), fill), a]), kind, mask=none)
        cols = [pa.array(np.concatenate([ids, ids[row]]), pa.int64()), col(to, 0, pa.int64()), col(dist, 0.0, pa.float64())]
        cols += [pa.array(np.concatenate([evals, evals[row]]), pa.int64()), pa.array(np.concatenate([wide, used]), pa.int32()), pa.array(none)]
        return pa.table(cols, names=["qid", "id", "dist", "n_evals", "used_ef", "first"])

    index = index.select(NAMES)
    if blocks == 1:
        rows = queries.collect()  # at most max_queries
        sent = index.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))
        return _best(index.groupBy("shard").applyInArrow(lambda t: found(t, *sent.value), FOUND), k)
    # The index is copied for each block, so these are no smaller than a task bears, however few queries a broadcast may have; and
    # queries are for each group, so small shards go to a task together.
    blocks = -(-queries.count() // max(max_queries, MAX_QUERIES))
    index = kept(index)
    stats = index.agg(F.max("shard").alias("last"), F.count("*").alias("n")).first()
    shards = (stats.last or 0) + 1
    together = max(1, SHARD * shards // max(1, stats.n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    qs = queries.withColumn("block", F.pmod(F.xxhash64("qid", "qv"), F.lit(blocks)).cast("int")).withColumn("g", every(-(-shards // together)))
    xs = index.withColumn("g", F.floor(F.col("shard") / together).cast("int")).withColumn("block", every(blocks))

    def cell(t: pa.Table, mine: pa.Table) -> pa.Table:
        return found(t, mine["qid"].to_numpy(), matrix(mine["qv"].combine_chunks()) if mine.num_rows else np.zeros((0, 0)))

    return _best(xs.groupBy("g", "block").cogroup(qs.groupBy("g", "block")).applyInArrow(cell, FOUND), k)


def _shards(t: pa.Table):
    """The shards of a table, one after another."""
    t = t.sort_by("shard").combine_chunks()
    shard = t["shard"].to_numpy()
    ends = [*np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)).tolist(), len(shard)]
    yield from (t.slice(a, z - a) for a, z in zip(ends[:-1], ends[1:], strict=True))


def _merged(parts: list[tuple], k: int) -> tuple:
    """Of hits (place of the query, id, distance, used ef) of several shards the k best of each query."""
    got = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort((got[1], got[2], got[0]))
    got = [c[order] for c in got]
    keep = np.arange(len(order)) - np.searchsorted(got[0], got[0]) < k
    return tuple(c[keep] for c in got)


def trace(index: DataFrame, qid: int, q: list[float], k: int, ef: int, config: GraphConfig = GraphConfig(), patience: int = 0) -> DataFrame:
    """shard, step, action, id, from, layer, dist of one query's way through the graph: enter; explore, a node that joins the beam,
    and from where it was seen; prune_w or early_exit, where a layer's beam ends. from is null where there is none."""

    def run(t: pa.Table) -> pa.Table:
        s, steps = Shard.of(t, config), []
        s.search(np.array(q, np.float64), k, ef, patience, steps)
        shard = t["shard"][0].as_py()
        rows = [(shard, n, a, int(s.ids[u]), int(s.ids[w]) if w >= 0 else None, layer, d) for n, (a, u, w, layer, d) in enumerate(steps)]
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
        return pa.table([pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], names=["shard", "step", "action", "id", "from", "layer", "dist"])

    return index.select(NAMES).groupBy("shard").applyInArrow(run, "shard int, step int, action string, id long, `from` long, layer int, dist double")


def edges(index: DataFrame) -> DataFrame:
    """layer, src, dst, pos."""
    by = index.select(F.col("id").alias("src"), F.posexplode("links").alias("layer", "ws"))
    return by.select("layer", "src", F.posexplode("ws").alias("pos", "dst")).select("layer", "src", "dst", "pos")


def entries(index: DataFrame) -> DataFrame:
    """shard, id: where a search of each shard starts that has a live node with a link: on the highest layer that has one, the live node
    of most links; the least id of equals."""
    by = index.where("NOT deleted").select("shard", "id", F.posexplode("links").alias("layer", "ws")).where(F.size("ws") > 0)
    return by.groupBy("shard").agg(F.max_by("id", F.struct("layer", F.size("ws"), -F.col("id"))).alias("id"))
