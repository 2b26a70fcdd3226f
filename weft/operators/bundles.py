"""Shortest paths, walks and sums over neighbours inside bundles: a large component, or small ones side by side.

Sources are dealt into groups of about COST edges to be seen, and a group gets the pieces of its own bundle's adjacency. It
goes through its sources in blocks of as many as STATE values allow, so that neither the pairs of nodes nor the levels of a search are
ever rows. Bundles beyond HELD_EDGES edges or HELD_NODES nodes are left to blocks of sources and chunks of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.order import numbered
from weft.plans.lineage import cut

#: Directed edges and nodes of a bundle that a task may hold.
HELD_EDGES, HELD_NODES = 16_000_000, 250_000
#: Places in which the components of a bundle begin.
BUNDLE = 1_024
#: Edges that the sources of a group see, about; rows of a group of neighbour_sums; values of a matrix of a block of sources.
COST, ROWS, STATE = 4_000_000_000, 500_000, 8_000_000
WIDEST, SHARES = 128, 32
#: Steps that a walk takes, about, so that its sources see so many times the edges.
STEPS = 64
_FEW = 16  # rows from which on neighbours are added row by row

KEYS = ["bundle", "part"]


def bundles(places: DataFrame, pieces: DataFrame, chunk: int) -> DataFrame:
    """(component, bundle, first, n, edges) of places(place, component): edges is that of all pieces of the bundle's chunks, so at least its own."""
    of = places.groupBy("component").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("size")).withColumn("bundle", F.floor(F.col("start") / BUNDLE))
    one = of.groupBy("bundle").agg(F.min("start").alias("first"), F.sum("size").alias("n"))
    met = _met(one, chunk).join(pieces.select("chunk", (F.length("src") / 2).cast("long").alias("edges")), "chunk").groupBy("bundle").agg(F.sum("edges").alias("edges"))
    return of.select("component", "bundle").join(one.join(met, "bundle", "left").na.fill(0, ["edges"]), "bundle")


def _met(one: DataFrame, chunk: int) -> DataFrame:
    """The rows of one(first, n) once for each chunk that they lie in."""
    return one.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor((F.col("first") + F.col("n") - 1) / chunk))))


class Adjacency:
    """Neighbours of the nodes 0 to n - 1 of a bundle, node by node."""

    def __init__(self, pieces: pd.DataFrame, first: int, n: int, chunk: int):
        src, dst = [], []
        for c, some in pieces.groupby("chunk"):  # pieces come in no order
            s, d = np.concatenate([np.frombuffer(x, np.int16) for x in some.src]), np.concatenate([np.frombuffer(x, np.int32) for x in some.dst])
            lo, hi = first - c * chunk, first + n - c * chunk
            if lo > 0 or hi < chunk:
                inside = (s >= lo) & (s < hi)
                s, d = s[inside], d[inside]
            order = np.argsort(s, kind="stable")
            src.append(np.bincount(s, minlength=chunk)[max(lo, 0) : min(hi, chunk)])
            dst.append(d[order] - np.int32(first))
        self.n, self.nbr = n, np.concatenate(dst) if dst else np.zeros(0, np.int32)
        self.degree = np.zeros(n, np.int64)
        for c, counts in zip(sorted(set(pieces.chunk)), src, strict=True):
            at = max(int(c) * chunk - first, 0)
            self.degree[at : at + len(counts)] = counts
        self.start = np.cumsum(self.degree) - self.degree

    def edges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in nodes, neighbour) of all edges of nodes."""
        many = self.degree[nodes]
        at = np.arange(many.sum()) + np.repeat(self.start[nodes] - (np.cumsum(many) - many), many)
        return np.repeat(np.arange(len(nodes)), many), self.nbr[at]

    def around(self, nodes: np.ndarray) -> np.ndarray:
        """The neighbours of nodes, each once."""
        seen = np.zeros(self.n, bool)
        seen[self.edges(nodes)[1]] = True
        return np.flatnonzero(seen)

    def sums(self, x: np.ndarray, nodes: np.ndarray, add: np.ufunc = np.add) -> np.ndarray:
        """For each of nodes the lines of x at its neighbours, added: the k-th neighbours of all nodes of a slice at a time."""
        out = np.zeros((len(nodes), x.shape[1]), x.dtype)
        width = x.shape[1]
        order = np.argsort(-self.degree[nodes], kind="stable")
        slab = max(64, 65_536 // width)
        for i in range(0, len(nodes), slab):
            rows = order[i : i + slab]
            degree, start = self.degree[nodes[rows]], self.start[nodes[rows]]
            got, k = np.zeros((len(rows), width), x.dtype), 0
            while (many := int(np.searchsorted(-degree, -k))) > (_FEW if k else 0):
                add(got[:many], x.take(self.nbr[start[:many] + k], axis=0), out=got[:many])
                k += 1
            for r in range(many):
                for lo in range(start[r] + k, start[r] + degree[r], slab):
                    add(got[r], add.reduce(x.take(self.nbr[lo : min(lo + slab, start[r] + degree[r])], axis=0), axis=0), out=got[r])
            out[rows] = got
        return out

    def spread(self, values: np.ndarray, nodes: np.ndarray, to: np.ndarray) -> np.ndarray | None:
        """As sums, of lines values at nodes, for nodes to, value by value; None where these are too many."""
        line, col = np.nonzero(values)
        if self.degree[nodes[line]].sum() * 8 > self.degree[to].sum() * values.shape[1]:
            return None
        at, nbr = self.edges(nodes[line])
        where = np.full(self.n, -1)
        where[to] = np.arange(len(to))
        place = where[nbr]
        keep = place >= 0
        at = at[keep]
        got = np.bincount(place[keep] * values.shape[1] + col[at], values[line[at], col[at]], len(to) * values.shape[1])
        return got.reshape(len(to), values.shape[1])


def reach(adj: Adjacency, sources: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Level after level of a search: nodes, and how many of the sources reach them there; a bit a source."""
    front, seen = np.zeros((adj.n, -(-len(sources) // 64)), np.uint64), np.zeros((adj.n, -(-len(sources) // 64)), np.uint64)
    at = np.arange(len(sources))
    np.bitwise_or.at(front, (sources, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    nodes, full = np.unique(sources), np.bitwise_or.reduce(front, axis=0)
    seen |= front
    while len(nodes):
        yield nodes, np.bitwise_count(front[nodes]).sum(1, dtype=np.int64)
        new = adj.around(nodes)
        new = new[(seen[new] != full).any(1)]
        got = adj.sums(front, new, np.bitwise_or) & ~seen[new]
        some = got.any(1)
        front[nodes] = 0
        nodes, got = new[some], got[some]
        front[nodes] = got
        seen[nodes] |= got


def dependencies(adj: Adjacency, sources: np.ndarray, ends: np.ndarray, load: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(level, nodes, sources that reach them there, sum of dependencies): levels outwards without, and from the last to the first with the latter."""
    shape = (adj.n, len(sources))
    paths, level, x = np.zeros(shape), np.full(shape, -1, np.int32), np.zeros(shape)
    cols = np.arange(len(sources))
    paths[sources, cols], level[sources, cols] = 1, 0
    nodes, found, open_ = np.unique(sources), [], np.ones(adj.n, bool)
    values = paths[nodes]
    while len(nodes):
        d = len(found)
        found.append(nodes)
        yield d, nodes, (values > 0).sum(1), None
        values = (values > 0).astype(float) if load else values
        new = adj.around(nodes)
        new = new[open_[new]]
        got = adj.spread(values, nodes, new)
        if got is None:
            x[nodes] = values
            got = adj.sums(x, new)
            x[nodes] = 0
        got[level[new] >= 0] = 0
        some = (got > 0).any(1)
        nodes, values = new[some], got[some]
        paths[nodes] += values
        level[nodes] = np.where(values > 0, d + 1, level[nodes])
        open_[nodes] = (level[nodes] < 0).any(1)
    for d in range(len(found) - 1, 0, -1):
        nodes = found[d]
        here, own = level[nodes] == d, paths[nodes]
        delta = np.zeros(own.shape)
        if d < len(found) - 1:
            delta = adj.sums(x, nodes)
            delta *= here if load else own * here
            x[found[d + 1]] = 0
            yield d, nodes, None, delta.sum(1)
        x[nodes] = np.divide(ends[nodes][:, None] + delta, own, out=np.zeros(own.shape), where=here)


def walks(adj: Adjacency, sources: np.ndarray, tolerance: float, most: int) -> np.ndarray:
    """The diagonal of the exponential of the adjacency at the sources: sums of squares of their lines of exp(A / 2), sums of positive terms."""
    term = np.zeros((adj.n, len(sources)))
    term[sources, np.arange(len(sources))] = 1
    total, nodes = term.copy(), np.unique(sources)
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(1, most + 1):
            nodes = adj.around(nodes) if len(nodes) < adj.n else nodes
            got = adj.sums(term, nodes) / (2.0 * k)
            term[:] = 0
            term[nodes] = got
            total[nodes] += got
            if k % 8 == 0 and not ((term.sum(0) > tolerance * total.sum(0)) & (total.sum(0) < np.inf)).any():
                break
        return np.nan_to_num((total * total).sum(0), nan=np.inf, posinf=np.inf)


def _blocks(rows: pd.DataFrame, n: int, widest: int) -> Iterator[tuple[object, np.ndarray]]:
    """(scope, sources) of each block of a group's rows."""
    width = max(8, min(widest, STATE // max(n, 1)))
    for scope, some in rows.groupby("scope", sort=False):
        at = np.sort(some["at"].to_numpy(np.int64))
        for i in range(0, len(at), width):
            yield scope, at[i : i + width]


def dealt(sources: DataFrame, cost: int | None = None) -> DataFrame:
    """sources(scope, bundle, first, n, edges, at) with their part: neighbours in the same one, of COST edges about and a share of SHARES of the bundle's, but no fewer than WIDEST."""
    rows = cut(numbered(sources, "k", F.col("bundle"), F.col("scope"), F.col("at")))
    rows = rows.join(rows.groupBy("bundle").agg(F.min("k").alias("k0"), F.count(F.lit(1)).alias("every")), "bundle")
    many = F.greatest(F.lit(WIDEST), F.least(F.floor(F.lit(cost or COST) / F.greatest("edges", F.lit(1))), F.ceil(F.col("every") / SHARES)))
    return cut(rows.withColumn("part", F.floor((F.col("k") - F.col("k0")) / many)).drop("k", "k0", "every"))


def each(rows: DataFrame, pieces: DataFrame, chunk: int, work: Callable[[Adjacency, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(adjacency, rows) of each group of rows(bundle, part, first, n, ...)."""
    groups = cut(rows.select(*KEYS, "first", "n").distinct())
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * groups.count(), 4_000))
    given = _met(groups, chunk).join(pieces, "chunk").select(*KEYS, "chunk", "src", "dst")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return work(Adjacency(right, int(left["first"].iat[0]), int(left.n.iat[0]), chunk), left)

    return rows.repartition(parts, *KEYS).groupBy(*KEYS).cogroup(given.repartition(parts, *KEYS).groupBy(*KEYS)).applyInPandas(run, schema)


def path_sums(rows: DataFrame, ends: DataFrame | None, pieces: DataFrame, chunk: int, flow: bool, load: bool) -> DataFrame:
    """(scope, place, r, total, inverse, delta) as blocks.path_sums has them, of dealt rows; not yet summed over the groups."""
    rows = rows.withColumn("role", F.lit(0))
    if ends is not None:
        met = rows.select("scope", "first", "n", *KEYS).distinct()
        rows = rows.select("scope", "first", "n", *KEYS, "at", "role").unionByName(met.join(ends, ["scope", "bundle"]).select("scope", "first", "n", *KEYS, "at", F.lit(1).alias("role")))
    kind = rows.schema["scope"].dataType.simpleString()
    some_ends = ends is not None

    def work(adj: Adjacency, left: pd.DataFrame) -> pd.DataFrame:
        out, given = {}, left[left.role == 1]
        for scope, at in _blocks(left[left.role == 0], adj.n, WIDEST if flow else 64 * 64):
            r, total, inverse, delta = out.setdefault(scope, tuple(np.zeros(adj.n, t) for t in (np.int64, np.int64, float, float)))
            if not flow:
                levels = ((d, nodes, many, None) for d, (nodes, many) in enumerate(reach(adj, at)))
            else:
                end = np.ones(adj.n)
                if some_ends:
                    end[:] = 0
                    end[given["at"].to_numpy()[(given.scope == scope).to_numpy()]] = 1
                levels = dependencies(adj, at, end, load)
            for d, nodes, many, more in levels:
                if many is None:
                    delta[nodes] += more
                else:
                    r[nodes] += many
                    total[nodes] += many * d
                    inverse[nodes] += many / d if d else 0.0
        first, parts = int(left["first"].iat[0]), []
        for scope, (r, total, inverse, delta) in out.items():
            at = np.flatnonzero(r)
            parts.append(pd.DataFrame({"scope": [scope] * len(at), "place": first + at, "r": r[at], "total": total[at], "inverse": inverse[at], "delta": delta[at]}))
        return pd.concat(parts)

    return each(rows.select("scope", "first", "n", *KEYS, "at", "role"), pieces, chunk, work, f"scope {kind}, place long, r long, total long, inverse double, delta double")


def closed_walks(rows: DataFrame, pieces: DataFrame, chunk: int, tolerance: float, most: int) -> DataFrame:
    """(place, value) of dealt rows."""

    def work(adj: Adjacency, left: pd.DataFrame) -> pd.DataFrame:
        first = int(left["first"].iat[0])
        return pd.concat([pd.DataFrame({"place": first + at, "value": walks(adj, at, tolerance, most)}) for _, at in _blocks(left, adj.n, WIDEST)])

    return each(rows.select("scope", "first", "n", *KEYS, "at"), pieces, chunk, work, "place long, value double")


def neighbour_sums(held: DataFrame, columns: list[str], values: dict[str, str], pieces: DataFrame, chunk: int, schema: str) -> DataFrame:
    """The given columns of held(seed, bundle, first, n, at, ...) with sums over the seed's rows at neighbours, as whole numbers."""
    size = held.groupBy("bundle", "seed").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("low"))
    order = cut(numbered(size, "k", F.col("bundle"), F.col("low"), F.col("seed")))  # seeds of a neighbourhood in the same group
    per = order.groupBy("bundle").agg(F.min("k").alias("k0"), F.greatest(F.lit(1), F.floor(F.lit(ROWS) / F.avg("rows"))).alias("many"))
    part = order.join(per, "bundle").select("bundle", "seed", F.floor((F.col("k") - F.col("k0")) / F.col("many")).alias("part"), "k")
    rows = cut(held.join(part, ["bundle", "seed"]).select(*columns, "first", "n", *KEYS, "at", "k"))
    given = sorted(set(values.values()))

    def work(adj: Adjacency, left: pd.DataFrame) -> pd.DataFrame:
        out = left[columns].copy()
        for name in values:
            out[name] = np.int64(0)
        at, names = left["at"].to_numpy(np.int64), {v: [k for k, of in values.items() if of == v] for v in given}
        slot = np.unique(left.k, return_inverse=True)[1]
        width = max(8, min(WIDEST, STATE // adj.n))
        order = np.argsort(slot, kind="stable")
        bounds = np.searchsorted(slot[order], np.arange(0, slot.max() + 1 + width, width))
        x = np.zeros((adj.n, width), np.int64)
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            mine = order[lo:hi]
            nodes, line = np.unique(at[mine], return_inverse=True)
            col = slot[mine] - i * width
            for v in given:
                x[at[mine], col] = left[v].to_numpy(np.int64)[mine]
                got = adj.sums(x, nodes)[line, col]
                x[at[mine], col] = 0
                for name in names[v]:
                    out.iloc[mine, out.columns.get_loc(name)] = got
        return out

    return each(rows, pieces, chunk, work, schema)
