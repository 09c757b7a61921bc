"""Shortest paths on a graph in sorted arrays (CSR), for graphs that were counted and found small enough to send.

A graph is out-edge offsets by node, and head, key and weight of each edge in the
order of (tail, head, key): 16 bytes an edge and 8 a node. Nodes are numbered in the
order of their names. Costs are settled bucket by bucket (delta-stepping): labels
under the bucket's bound are relaxed all at once until none changes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


class Arrays(NamedTuple):
    first: np.ndarray
    head: np.ndarray
    key: np.ndarray
    weight: np.ndarray


def build(edges: DataFrame, limit: int) -> tuple[np.ndarray, dict[str, tuple]] | None:
    """Names of the nodes in order, and the arrays of each scenario; None if there are more than `limit` edges (scenario, u, v, key, weight)."""
    if edges.limit(limit + 1).count() > limit:
        return None
    t = edges.select("scenario", "u", "v", F.col("key").cast("int").alias("key"), "weight").toArrow()
    key, w = t.column("key").to_numpy(), t.column("weight").to_numpy()
    # Names are told apart in Arrow: no text of an edge becomes an object.
    ends = [pc.unique(t.column(c)) for c in "uv"]
    known = pc.unique(pa.concat_arrays(ends))
    known = known.take(pc.array_sort_indices(known))
    names, (u, v) = known.to_numpy(zero_copy_only=False).astype(object), (pc.index_in(t.column(c), value_set=known).to_numpy() for c in "uv")
    scenarios = pc.unique(t.column("scenario"))
    scenario = pc.index_in(t.column("scenario"), value_set=scenarios).to_numpy()
    del t
    out = {}
    for place, s in enumerate(scenarios.to_pylist()):
        at = np.flatnonzero(scenario == place)
        at = at[np.lexsort((key[at], v[at], u[at]))]
        first = np.concatenate([[0], np.cumsum(np.bincount(u[at], minlength=len(names)))])
        # Plain tuples: what is sent needs no class of this package to be read.
        out[s] = (first, v[at].astype(np.int32), key[at].astype(np.int32), w[at].astype(np.float64))
    return names, out


class Ranked(NamedTuple):
    """Edges in the order of (tail, weight, head, key): offsets by tail, head and weight of each, and whether its tail has another one to the same head."""

    first: np.ndarray
    head: np.ndarray
    weight: np.ndarray
    twin: np.ndarray


def ranked(g: Arrays) -> Ranked:
    tail = np.repeat(np.arange(len(g.first) - 1, dtype=np.int32), np.diff(g.first))
    same = (tail[1:] == tail[:-1]) & (g.head[1:] == g.head[:-1])
    twin = np.zeros(len(tail), bool)
    twin[1:] |= same
    twin[:-1] |= same
    at = np.lexsort((g.weight, tail))
    return Ranked(g.first, g.head[at], g.weight[at], twin[at])


def out_edges(g: Arrays, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the edges out of the nodes, and how many each has."""
    a, n = g.first[nodes], g.first[nodes + 1] - g.first[nodes]
    return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def search(g: Arrays, source: int, targets: np.ndarray | None = None, ahead: np.ndarray | None = None) -> np.ndarray:
    """Least costs from the source; exact for all nodes no farther than the farthest of `targets` (all nodes if None).

    `ahead` guides a search to one target: a bound from below of the cost from each node to it.
    """
    cost = np.full(len(g.first) - 1, np.inf)
    cost[source] = 0.0
    width = 2 * float(g.weight.mean()) if len(g.weight) else 1.0
    open_ = np.array([source])
    while len(open_):
        now = cost[open_]
        far = np.inf if targets is None else cost[targets].max()
        f = now if ahead is None else now + ahead[open_]
        keep = f <= far
        open_, now, f = open_[keep], now[keep], f[keep]
        if not len(open_):
            break
        near = f < max((np.floor(f.min() / width) + 1) * width, np.nextafter(f.min(), np.inf))
        edges, n = out_edges(g, open_[near])
        to, c = g.head[edges], np.repeat(now[near], n) + g.weight[edges]
        better = c < cost[to]
        to, c = to[better], c[better]
        np.minimum.at(cost, to, c)
        open_ = np.unique(np.concatenate([open_[~near], to]))
    return cost


def predecessors(g: Arrays, cost: np.ndarray, source: int, farthest: float = np.inf) -> np.ndarray:
    """For each node the number of the edge by which it is reached, the first of equal ones in the order of (tail, key); -1 for none."""
    nodes = np.flatnonzero(cost <= min(farthest, np.finfo(float).max))
    edges, n = out_edges(g, nodes)
    tight = edges[np.repeat(cost[nodes], n) + g.weight[edges] == cost[g.head[edges]]]
    best = np.full(len(cost), len(g.head))
    np.minimum.at(best, g.head[tight], tight)
    best[best == len(g.head)] = -1
    best[source] = -1
    return best


def path(g: Arrays, by: np.ndarray, source: int, target: int) -> np.ndarray:
    """Numbers of the edges from source to target."""
    out, at = [], target
    while at != source:
        e = by[at]
        out.append(e)
        at = int(np.searchsorted(g.first, e, "right")) - 1
    return np.array(out[::-1], np.int64)


class Back(NamedTuple):
    """Edges by their heads: for each node the numbers of the edges into it in the order of (tail, key), and the tail of every edge."""

    first: np.ndarray
    edge: np.ndarray
    tail: np.ndarray


def turned(g: Arrays) -> Back:
    n = len(g.first) - 1
    first = np.concatenate([[0], np.cumsum(np.bincount(g.head, minlength=n))])
    return Back(first, np.argsort(g.head, kind="stable").astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), np.diff(g.first)))


def fine_width(g: Arrays) -> float:
    """Cost that one bucket spans in searches that end soon: the least of the edges out of some nodes, on average."""
    used = max(1, int((np.diff(g.first) > 0).sum()))
    return 2 * float(g.weight.mean()) * used / len(g.weight) if len(g.weight) else 1.0


def ball(g: Arrays, back: Back, target: int, width: float, most: int) -> tuple[np.ndarray, float]:
    """Costs to the target from the nodes around it, and a bound: costs under it are least, and no other node is nearer. Ends with the bucket in which `most` edges have been seen."""
    cost = np.full(len(g.first) - 1, np.inf)
    cost[target] = 0.0
    open_, bound, seen = np.array([target]), width, 0
    # Labels past the bound wait as they come; only those of a bucket are told apart.
    later, when = np.empty(0, np.int32), np.empty(0)
    while True:
        while len(open_):
            at, n = out_edges(back, open_)
            edges = back.edge[at]
            to, c = back.tail[edges], np.repeat(cost[open_], n) + g.weight[edges]
            seen += len(edges)
            better = c < cost[to]
            to, c = to[better], c[better]
            np.minimum.at(cost, to, c)
            near = c < bound
            later, when = np.concatenate([later, to[~near]]), np.concatenate([when, c[~near]])
            open_ = np.unique(to[near])
        still = when == cost[later]
        later, when = later[still], when[still]
        if not len(later):
            return cost, np.inf
        if seen >= most:
            return cost, bound
        bound = max((np.floor(when.min() / width) + 1) * width, np.nextafter(when.min(), np.inf))
        near = when < bound
        open_, later, when = np.unique(later[near]), later[~near], when[~near]


def between(g: Arrays, back: Back, source: int, target: int, width: float, guide=None) -> np.ndarray:
    """Costs from the source, least for all nodes on best ways to the target; met from both ends.

    A ball around the target bounds from below what remains from every node, and guides the
    search from the source; `guide(nodes)` may give another such bound. The cheapest way
    that goes on through the ball is a bound from above: nothing that cannot lie on a best
    way goes on, so either side sees some multiple of the root of the edges.
    """
    left, bound = ball(g, back, target, width, 2 * int(np.sqrt(len(g.head))) + 16)
    cost = np.full(len(g.first) - 1, np.inf)
    cost[source] = 0.0
    least = left[source]
    to, c, f = np.array([source]), np.zeros(1), np.minimum(left[[source]], bound)
    if not np.isfinite(f[0]):
        return cost
    while len(to):
        end = max((np.floor(f.min() / width) + 1) * width, np.nextafter(f.min(), np.inf))
        near = f < end
        open_, later = np.unique(to[near]), [(to[~near], c[~near], f[~near])]
        while len(open_):
            edges, n = out_edges(g, open_)
            to, c = g.head[edges], np.repeat(cost[open_], n) + g.weight[edges]
            ahead = left[to]
            least = min(least, (c + ahead).min(initial=np.inf))
            f = c + np.minimum(ahead, bound)
            # Sums from either end may differ in their last digits.
            some = (c < cost[to]) & (f <= least * (1 + 1e-12)) & np.isfinite(f)
            to, c, f = to[some], c[some], f[some]
            if guide is not None:
                f = np.maximum(f, c + guide(to))
            np.minimum.at(cost, to, c)
            near = f < end
            open_ = np.unique(to[near])
            later.append((to[~near], c[~near], f[~near]))
        to, c, f = (np.concatenate(x) for x in zip(*later, strict=True))
        still = (c == cost[to]) & (f <= least * (1 + 1e-12))
        to, c, f = to[still], c[still], f[still]
    return cost


def way(g: Arrays, back: Back, cost: np.ndarray, source: int, target: int) -> np.ndarray:
    """Numbers of the edges from source to target, as `predecessors` and `path` give them, looked up along the way alone."""
    out, at = [], target
    while at != source:
        edges = back.edge[back.first[at] : back.first[at + 1]]
        e = edges[np.flatnonzero(cost[back.tail[edges]] + g.weight[edges] == cost[at])[0]]
        out.append(e)
        at = int(back.tail[e])
    return np.array(out[::-1], np.int64)


def straight(lat: np.ndarray, lon: np.ndarray, to: int, metres_per_s: float, nodes: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Straight-line seconds from each node (of `nodes`) to one; 0 where coordinates are missing."""
    return line(lat[nodes], lon[nodes], lat[to], lon[to], metres_per_s)


def line(lat1, lon1, lat2, lon2, metres_per_s: float) -> np.ndarray:
    """Straight-line seconds from points to points; 0 where coordinates are missing."""
    p, q, d = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    s = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(d / 2) ** 2
    return np.nan_to_num(2 * EARTH_M * np.arctan2(np.sqrt(s), np.sqrt(1 - s)) / metres_per_s)


def settled(cost: np.ndarray, target: int, ahead: np.ndarray | None = None) -> int:
    """Nodes that a heap search takes off before it stops: those before the target in the order of (cost and guide, node), itself included."""
    f = cost if ahead is None else cost + ahead
    if not np.isfinite(cost[target]):
        return int(np.isfinite(cost).sum())
    return int((f < f[target]).sum() + (f[: target + 1] == f[target]).sum())


def look_ahead(g: Ranked, lat: np.ndarray, lon: np.ndarray, node: np.ndarray, cost: np.ndarray, ahead: np.ndarray, seen: np.ndarray, shut: np.ndarray, target: np.ndarray, to: np.ndarray, depths: list[int], fanout: int, metres_per_s: float, dead_end: float, no_way_on: float) -> dict[int, np.ndarray]:
    """For each depth the cheapest way on from each of some first edges, level by level (`choice.lookahead` says which).

    node (under zero: not in the graph), cost and ahead (line to the target): of the first
    edges. seen: a row for each of the nodes seen, under zero for none; shut: nothing counts
    as not seen. target: a node or under zero; to: its lat and lon. Ways over the same nodes
    share their `fanout` edges on, the cheaper way first.
    """
    n, last = len(node), max(depths)
    best = {k: np.full(n, np.inf) for k in depths}
    arrived, by = np.full(n, np.inf), np.arange(n)
    room, group = np.full(n, fanout), np.arange(n)

    def leaf(at: np.ndarray, value: np.ndarray, first: int, to: int) -> None:
        for k in depths:
            if first <= k <= to:
                np.minimum.at(best[k], at, value)

    def rest(at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return line(lat[x], lon[x], to[0][at], to[1][at], metres_per_s)

    for level in range(1, last + 1):
        there = node == target[by]
        leaf(by[there], cost[there], level, last)
        np.minimum.at(arrived, by[there], cost[there])
        # No cost is under zero. Ways that share their edges on with others stay.
        keep = ~there & ((cost < arrived[by]) | (room < fanout))
        by, node, cost, room, group, seen = by[keep], node[keep], cost[keep], room[keep], group[keep], seen[:, keep]
        if not len(by):
            break
        if level == 1:
            ahead = ahead[keep]
            leaf(by, cost + ahead, 1, 1)
        elif level == last:
            # The cheapest of each first edge go before, and leave few that may be better.
            starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]])
            least = cost == np.repeat(np.minimum.reduceat(cost, starts), np.diff(np.r_[starts, len(by)]))
            leaf(by[least], cost[least] + rest(by[least], node[least]), last, last)
            some = ~least & (cost < best[last][by])
            leaf(by[some], cost[some] + rest(by[some], node[some]), last, last)
        elif level in depths:
            leaf(by, cost + rest(by, node), level, level)
        if level == last:
            break
        start = np.where(node >= 0, g.first[node], 0)
        n_out = np.where(node >= 0, g.first[node + 1] - start, 0)
        none = n_out == 0
        leaf(by[none], cost[none] + dead_end, level + 1, last)
        by, node, cost, room, group, seen, start, n_out = by[~none], node[~none], cost[~none], room[~none], group[~none], seen[:, ~none], start[~none], n_out[~none]
        if not len(by):
            break
        most = np.minimum(n_out, fanout + 2)
        while True:
            ends = np.cumsum(most)
            row = np.repeat(np.arange(len(by)), most)
            edge = np.repeat(start - (ends - most), most) + np.arange(ends[-1])
            head = g.head[edge]
            ok = ~shut[by][row]
            for x in seen:
                ok &= head != x[row]
            upto = np.cumsum(ok)
            before = upto[ends - most] - ok[ends - most]
            found = upto[ends - 1] - before
            if not ((found < room) & (most < n_out)).any():
                break
            most = n_out
        leaf(by[found == 0], cost[found == 0] + no_way_on, level + 1, last)
        on = np.flatnonzero(ok & (upto - before[row] <= room[row]))
        row, edge, head = row[on], edge[on], head[on]
        by, node, cost, old, shared = by[row], head, cost[row] + g.weight[edge], group[row], (room < fanout).any()
        room, group = np.full(len(by), fanout), np.arange(len(by))
        if level + 1 == last:
            seen = np.empty((0, len(by)), np.int32)
            continue
        if len(by) and (shared or g.twin[edge].any()):
            at = np.lexsort((cost, node, old))
            new = np.r_[True, (old[at][1:] != old[at][:-1]) | (node[at][1:] != node[at][:-1])]
            run = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(at)])[run]
            room[at], group[at] = np.maximum(-(-(fanout - (np.arange(len(at)) - first[run])) // size), 0), run
        seen = np.concatenate([seen[:, row], node[None, :]])
    return best
