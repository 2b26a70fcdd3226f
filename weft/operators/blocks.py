"""Shortest paths and walks from blocks of sources through an adjacency cut into pieces.

Nodes get places, one component after the other, and lie in chunks of CHUNK places; sources lie in blocks of WIDTH. A row is
a block and a chunk with a small matrix: a line of WIDTH values for each node of the chunk that has any. A step
multiplies the matrix with the pieces of the adjacency that start in its chunk, in the task that holds both, and Spark sums what
arrives at each chunk. So an edge moves no row of its own, and neither the graph nor a search is ever in one task.

What arrives are up to as many lines for each block and chunk as there are nodes, so where a task may hold the edges of a component
(bundles.HELD_EDGES) its sources go to groups that do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import bundles
from weft.operators.components import connected_components
from weft.operators.order import numbered
from weft.plans.lineage import cut

KEYS = ["scope", "block", "chunk"]
CHUNK, WIDTH = 512, 128
#: Edges of a piece of the adjacency, about; bytes of the batches between JVM and workers.
PIECE, BATCH_BYTES = 65_536, 8 << 20
#: Pairs of a source and a node that it can reach in a batch of sources; bounds the tables of a run.
BATCH_PAIRS = 400_000_000
_ROLES = {"step": 0, "front": 1, "last": 2, "ends": 3}


@dataclass
class Layout:
    """places(node, place, component) and pieces(chunk, src, dst) of the adjacency; bundles of components, and places in those that a task may hold."""

    places: DataFrame
    pieces: DataFrame
    held: DataFrame
    large: bool  # whether others are left


def layout(adj: DataFrame, nodes: DataFrame) -> Layout:
    """adj(node, nbr) of nodes(node), isolated ones too, laid out in chunks."""
    adj.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    first = cut(numbered(nodes.select("node").distinct(), "at", F.col("node")))
    ends = adj.join(first.withColumnRenamed("at", "a"), "node").select("a", "nbr").join(first.select(F.col("node").alias("nbr"), F.col("at").alias("b")), "nbr")
    ends = cut(ends.select("a", "b"))
    found = connected_components(ends.where("a < b"), "a", "b").withColumnRenamed("node", "at")
    rows = first.join(found, "at", "left").select("node", "at", F.coalesce("component", "at").alias("component"))
    places = cut(numbered(rows, "place", F.col("component"), F.col("at")).withColumn("place", F.col("place") - 1))
    where = places.select("at", "place")
    laid = ends.join(where.withColumnsRenamed({"at": "a", "place": "src"}), "a").join(where.withColumnsRenamed({"at": "b", "place": "dst"}), "b")
    chunks = F.floor(F.col("src") / CHUNK)
    laid = cut(laid.select(chunks.alias("chunk"), (F.col("src") % CHUNK).cast("int").alias("src"), "dst"))
    parts = max(1, -(-laid.count() * CHUNK // (PIECE * max(1, places.count()))))
    pieces = laid.groupBy("chunk", F.pmod(F.floor(F.col("dst") / CHUNK), F.lit(parts)).alias("part")).applyInPandas(_piece, "chunk long, src binary, dst binary")
    pieces = cut(pieces)
    packed = cut(bundles.bundles(places, pieces, CHUNK))
    few = (F.col("edges") <= bundles.HELD_EDGES) & (F.col("n") <= bundles.HELD_NODES)
    held = places.join(packed.where(few), "component").select("node", "place", "bundle", "first", "n", "edges", (F.col("place") - F.col("first")).alias("at"))
    return Layout(places, pieces, cut(held), not packed.where(~few).isEmpty())


def _piece(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf.sort_values(["dst", "src"])
    return pd.DataFrame({"chunk": [pdf.chunk.iat[0]], "src": [rows.src.to_numpy(np.int16).tobytes()], "dst": [rows.dst.to_numpy(np.int32).tobytes()]})


def in_blocks(laid: Layout, sources: DataFrame) -> DataFrame:
    """(scope, block, slot, place) of sources(scope, node): blocks of WIDTH by place, full but the last of each scope."""
    rows = sources.select("scope", "node").distinct().join(laid.places.select("node", "place"), "node")
    rows = cut(numbered(rows, "at", F.col("scope"), F.col("place")))
    rows = rows.join(F.broadcast(rows.groupBy("scope").agg(F.min("at").alias("first"))), "scope")
    at = F.col("at") - F.col("first")
    return cut(rows.select("scope", F.floor(at / WIDTH).alias("block"), (at % WIDTH).cast("int").alias("slot"), "place"))


def batches(laid: Layout, blocks: DataFrame, pairs: int | None = None) -> list[DataFrame]:
    """The blocks dealt by hash into batches of so many pairs of a source and a node of its component, about."""
    size = laid.places.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    reach = blocks.join(laid.places.select("place", "component"), "place").join(size, "component").agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-reach // (pairs or BATCH_PAIRS)))
    return [blocks.where(F.pmod(F.xxhash64("scope", "block"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [blocks]


def _schema(rows: DataFrame, *more: str) -> str:
    return ", ".join([f"scope {rows.schema['scope'].dataType.simpleString()}", *more])


def _matrix_schema(rows: DataFrame, *more: str) -> str:
    return _schema(rows, "block long", "chunk long", "cols binary", "vals binary", *more)


def _lines(cols: bytes, vals: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(cols, np.int16), np.frombuffer(vals, kind).reshape(-1, WIDTH)


def starts(blocks: DataFrame, kind: str) -> DataFrame:
    """The sources themselves, as rows (scope, block, chunk, cols, vals)."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        vals = np.zeros((len(pdf), WIDTH), kind)
        vals[np.arange(len(pdf)), pdf.slot] = 1
        return pd.DataFrame({**{k: [pdf[k].iat[0]] for k in KEYS}, "cols": [(pdf.place % CHUNK).to_numpy(np.int16).tobytes()], "vals": [vals.tobytes()]})

    return blocks.withColumn("chunk", F.floor(F.col("place") / CHUNK)).groupBy(*KEYS).applyInPandas(make, _matrix_schema(blocks))


def _times(lines: np.ndarray, src: np.ndarray, at: np.ndarray, out: int) -> np.ndarray:
    """Sums of lines[src] by at, sorted: by a dense product where edges are many, else edge by edge."""
    if len(src) * 50 > out * CHUNK:
        a = np.zeros((out, CHUNK), lines.dtype)
        a[at, src] = 1
        return a @ lines
    got, first = np.zeros((out, WIDTH), lines.dtype), np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    for i in range(0, len(first), 256):  # a slice of ends at a time, so that the gathered lines stay small
        lo, hi = first[i], first[i + 256] if i + 256 < len(first) else len(src)
        got[i : i + 256] = np.add.reduceat(lines[src[lo:hi]], first[i : i + 256] - lo, axis=0)
    return got


def step(laid: Layout, rows: DataFrame, kind: str, ones: bool = False) -> DataFrame:
    """What the lines of rows send to their neighbours, not yet summed; ones sends 1 for each positive value."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for r in pdf.itertuples(index=False):
                cols, vals = _lines(r.cols, r.vals, kind)
                lines = np.zeros((CHUNK, WIDTH), np.float32 if kind == "u1" else np.float64)
                lines[cols] = vals > 0 if ones else vals
                src, dst = np.frombuffer(r.src, np.int16), np.frombuffer(r.dst, np.int32)
                alive = lines.any(1)[src]
                if not alive.any():
                    continue
                src, dst = src[alive], dst[alive]
                ends, at = np.unique(dst, return_inverse=True)
                got = _times(lines, src, at, len(ends))
                got = got > 0 if kind == "u1" else got
                chunk = ends // CHUNK
                for c in np.unique(chunk):
                    lo, hi = np.searchsorted(chunk, [c, c + 1])
                    out.append((r.scope, r.block, int(c), (ends[lo:hi] % CHUNK).astype(np.int16).tobytes(), got[lo:hi].astype(kind).tobytes()))
            if out:
                yield pd.DataFrame(out, columns=[*KEYS, "cols", "vals"])

    return rows.select(*KEYS, "cols", "vals").join(laid.pieces, "chunk").mapInPandas(run, _matrix_schema(rows))


def _role(rows: DataFrame, role: str) -> DataFrame:
    return rows.select(*KEYS, "cols", "vals", F.lit(_ROLES[role]).alias("role"))


def _summed(pdf: pd.DataFrame, role: str, kind: str) -> np.ndarray:
    total = np.zeros((CHUNK, WIDTH), kind)
    for cols, vals in pdf.loc[pdf.role == _ROLES[role], ["cols", "vals"]].itertuples(index=False):
        at, lines = _lines(cols, vals, kind)
        total[at] = np.maximum(total[at], lines) if kind == "u1" else total[at] + lines
    return total


def _row(pdf: pd.DataFrame, total: np.ndarray, keep: np.ndarray, **more: bytes) -> pd.DataFrame:
    if not len(keep):
        return pd.DataFrame({k: [] for k in (*KEYS, "cols", "vals", *more)})
    return pd.DataFrame({**{k: [pdf[k].iat[0]] for k in KEYS}, "cols": [keep.astype(np.int16).tobytes()], "vals": [total[keep].tobytes()], **{k: [v] for k, v in more.items()}})


def levels(laid: Layout, blocks: DataFrame, kind: str = "f8", load: bool = False) -> list[DataFrame]:
    """Level after level of a search from the blocks: numbers of shortest paths, with load of predecessors; with kind u1 only what is reached."""

    def new(pdf: pd.DataFrame) -> pd.DataFrame:
        if not (pdf.role == _ROLES["step"]).any():
            return _row(pdf, None, [])
        total = _summed(pdf, "step", kind)
        for role in ("front", "last"):  # a neighbour of level L is on level L - 1, L or L + 1
            total[_summed(pdf, role, kind) > 0] = 0
        return _row(pdf, total, np.flatnonzero(total.any(1)))

    out, front, last = [], cut(starts(blocks, kind)), None
    while not front.isEmpty():
        out.append(front)
        rows = _role(step(laid, front, kind, load), "step").unionByName(_role(front, "front"))
        rows = rows if last is None else rows.unionByName(_role(last, "last"))
        front, last = cut(rows.groupBy(*KEYS).applyInPandas(new, _matrix_schema(blocks))), front
    return out


def _reached(rows: DataFrame, d: int, kind: str) -> DataFrame:
    """(scope, place, r, total, inverse) of one level, summed over the sources of a batch of rows."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                cols, vals = _lines(r.cols, r.vals, kind)
                yield pd.DataFrame({"scope": [r.scope] * len(cols), "place": r.chunk * CHUNK + cols.astype(np.int64), "r": (vals > 0).sum(1)})

    per = rows.mapInPandas(run, _schema(rows, "place long", "r long")).groupBy("scope", "place").agg(F.sum("r").alias("r"))
    return per.select("scope", "place", "r", (F.col("r") * d).alias("total"), (F.col("r") / d if d else F.lit(0.0)).alias("inverse"))


def _given(laid: Layout, found: list[DataFrame], ends: DataFrame | None, load: bool) -> Iterator[DataFrame]:
    """From the deepest level up, (scope, place, delta): a node hands (1 + delta) / paths up to all neighbours, and those one level up take the sum times their own paths."""

    def hand(pdf: pd.DataFrame) -> pd.DataFrame:
        if not (pdf.role == _ROLES["front"]).any():
            return _row(pdf, None, [], delta=b"")
        paths = _summed(pdf, "front", "f8")
        delta = _summed(pdf, "step", "f8") * ((paths > 0) if load else paths)
        end = 1.0
        if some_ends:
            end = np.zeros((CHUNK, 1))
            for cols in pdf.cols[pdf.role == _ROLES["ends"]]:
                end[np.frombuffer(cols, np.int16)] = 1
        give = np.divide(end + delta, paths, out=np.zeros_like(paths), where=paths > 0)
        keep = np.flatnonzero((paths > 0).any(1))
        return _row(pdf, give, keep, delta=delta.sum(1)[keep].tobytes())

    def sums(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                cols = np.frombuffer(r.cols, np.int16).astype(np.int64)
                yield pd.DataFrame({"scope": [r.scope] * len(cols), "place": r.chunk * CHUNK + cols, "delta": np.frombuffer(r.delta)})

    below, some_ends = None, ends is not None
    for d in range(len(found) - 1, 0, -1):
        rows = _role(found[d], "front")
        if below is not None:
            rows = rows.unionByName(_role(below, "step"))
        if ends is not None:
            marks = found[d].select(*KEYS).join(ends, ["scope", "chunk"]).withColumn("vals", F.lit(None).cast("binary"))
            rows = rows.unionByName(_role(marks, "ends"))
        here = cut(rows.groupBy(*KEYS).applyInPandas(hand, _matrix_schema(found[d], "delta binary")))
        yield here.mapInPandas(sums, _schema(here, "place long", "delta double")).groupBy("scope", "place").agg(F.sum("delta").alias("delta"))
        below = step(laid, here, "f8") if d > 1 else None


def _ends(laid: Layout, targets: DataFrame) -> DataFrame:
    """(scope, chunk, cols) of targets(scope, node)."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"scope": [pdf.scope.iat[0]], "chunk": [pdf.chunk.iat[0]], "cols": [(pdf.place % CHUNK).to_numpy(np.int16).tobytes()]})

    rows = targets.select("scope", "node").distinct().join(laid.places.select("node", "place"), "node").withColumn("chunk", F.floor(F.col("place") / CHUNK))
    return cut(rows.groupBy("scope", "chunk").applyInPandas(make, _schema(rows, "chunk long", "cols binary")))


def path_sums(laid: Layout, sources: DataFrame, flow: bool = True, load: bool = False, targets: DataFrame | None = None, pairs: int | None = None) -> DataFrame:
    """(scope, node, r, total, inverse, delta) of nodes that a source of sources(scope, node) reaches.

    Sources that reach it, itself included, the sums of their distances and of 1 / distance and, with flow, of their Brandes
    dependencies on it, those of sources on themselves left out; targets(scope, node) restricts the ends of paths that count there; load shares
    flow equally among predecessors.
    """
    sources = sources.select("scope", "node").distinct()
    near = laid.held.drop("place")
    inside = None if targets is None else targets.select("scope", "node").distinct().join(near, "node").select("scope", "bundle", "at")
    rows = bundles.dealt(sources.join(near, "node").drop("node"))
    parts, kind = [cut(_total(bundles.path_sums(rows, inside, laid.pieces, CHUNK, flow, load)))], "f8" if flow else "u1"
    if laid.large:
        sources = sources.join(near, "node", "left_anti")
    ends = _ends(laid, targets) if targets is not None and laid.large else None
    for some in batches(laid, in_blocks(laid, sources), pairs) if laid.large else []:
        found = levels(laid, some, kind, load)
        rows = [_reached(x, d, kind).withColumn("delta", F.lit(0.0)) for d, x in enumerate(found)]
        if flow:
            rows += [x.select("scope", "place", *(F.lit(0).cast(t).alias(c) for c, t in (("r", "long"), ("total", "long"), ("inverse", "double"))), "delta") for x in _given(laid, found, ends, load)]
        if rows:
            parts.append(cut(_total(reduce(DataFrame.unionByName, rows))))
    return _total(reduce(DataFrame.unionByName, parts)).join(laid.places.select("node", "place"), "place").drop("place")


def _total(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scope", "place").agg(*(F.sum(c).alias(c) for c in ("r", "total", "inverse", "delta")))


def whole(sources: DataFrame) -> DataFrame:
    return sources.select(F.lit(0).alias("scope"), "node")


def distance_sums(adj: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, r, total, inverse) of nodes that a source reaches: sources that reach it, itself included, the sum of their distances and of 1 / distance."""
    laid = layout(adj, adj.select("node").union(sources.select("node")))
    return path_sums(laid, whole(sources), flow=False).select("node", "r", "total", "inverse")


def flows(adj: DataFrame, sources: DataFrame, load: bool = False) -> DataFrame:
    """(node, delta): the sum over the sources of Brandes dependencies on each node, those of sources on themselves left out; load shares flow equally among predecessors."""
    laid = layout(adj, adj.select("node").union(sources.select("node")))
    return path_sums(laid, whole(sources), load=load).select("node", "delta")


def neighbour_sums(laid: Layout, rows: DataFrame, values: dict[str, str]) -> DataFrame:
    """rows(seed, node, ...), one a seed and node and without nulls, with sums: for each new name that of a column of longs over the seed's rows at neighbours of the node.

    A piece adds at most CHUNK values to a node, exact in doubles below 2 ** 44; the pieces are added as whole numbers.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), *(f"`{name}` long" for name in values)])
    near = laid.held.select("node", "bundle", "first", "n", "at")
    done = bundles.neighbour_sums(rows.join(near, "node"), rows.columns, values, laid.pieces, CHUNK, schema)
    if not laid.large:
        return done
    held = rows.join(laid.places.select("node", "place").join(near, "node", "left_anti"), "node")
    order = held.groupBy("seed").agg(F.min("place").alias("first"))  # seeds of a component in the same blocks
    at = F.col("at") - 1
    slots = cut(numbered(order, "at", F.col("first"), F.col("seed")).select("seed", F.lit(0).alias("scope"), F.floor(at / WIDTH).alias("block"), (at % WIDTH).cast("int").alias("slot")))
    held = held.join(slots, "seed").withColumns({"chunk": F.floor(F.col("place") / CHUNK), "col": (F.col("place") % CHUNK).cast("int")})
    held, given = cut(held.select(*rows.columns, *KEYS, "slot", "col")), sorted(set(values.values()))
    carried = rows.columns

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        cols, line = np.unique(pdf.col, return_inverse=True)
        vals = np.zeros((len(given), len(cols), WIDTH))
        for i, v in enumerate(given):
            vals[i, line, pdf.slot] = pdf[v]
        return pd.DataFrame({**{k: [pdf[k].iat[0]] for k in KEYS}, "cols": [cols.astype(np.int16).tobytes()], **{v: [vals[i].tobytes()] for i, v in enumerate(given)}})

    some = reduce(lambda a, b: a | b, (F.col(v) != 0 for v in given))
    kept = held.where(some).select(*KEYS, "slot", "col", *given)
    lines = cut(kept.groupBy(*KEYS).applyInPandas(make, _schema(held, "block long", "chunk long", "cols binary", *(f"{v} binary" for v in given))))
    sent = reduce(DataFrame.unionByName, (step(laid, lines.select(*KEYS, "cols", F.col(v).alias("vals")), "f8").withColumn("role", F.lit(i)) for i, v in enumerate(given)))

    def fill(wanted: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        out = wanted[carried].copy()
        for name, v in values.items():
            total = np.zeros((CHUNK, WIDTH), np.int64)
            for cols, vals in sent.loc[sent.role == given.index(v), ["cols", "vals"]].itertuples(index=False):
                at, got = _lines(cols, vals, "f8")
                total[at] += got.astype(np.int64)
            out[name] = total[wanted.col.to_numpy(np.int64), wanted.slot.to_numpy(np.int64)]
        return out

    return done.unionByName(held.groupBy(*KEYS).cogroup(sent.groupBy(*KEYS)).applyInPandas(fill, schema))


def closed_walks(laid: Layout, sources: DataFrame, tolerance: float = 1e-14, most: int = 2_000, pairs: int | None = None) -> DataFrame:
    """(node, value) of sources(node): the diagonal of the exponential of the adjacency, each closed walk of k steps weighing 1 / k!.

    Its entry is the sum of squares of the node's line of exp(A / 2), a sum of positive terms; terms are
    added until the last one is below tolerance of its line. An exponential beyond doubles becomes infinite.
    """

    def half(k: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            term = _summed(pdf, "step", "f8") / (2.0 * k)
            total = _summed(pdf, "front", "f8") + term
            keep = np.flatnonzero(total.any(1))
            return _row(pdf, total, keep, term=term[keep].tobytes())

        return run

    def squares(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                _, vals = _lines(r.cols, r.vals, "f8")
                _, last = _lines(r.cols, r.term, "f8")
                yield pd.DataFrame({"scope": [r.scope] * WIDTH, "block": r.block, "slot": np.arange(WIDTH, dtype=np.int32), "value": (vals * vals).sum(0), "all": vals.sum(0), "last": last.sum(0)})

    near = laid.held.drop("place")
    parts = [cut(bundles.closed_walks(bundles.dealt(whole(sources).distinct().join(near, "node").drop("node"), bundles.COST // bundles.STEPS), laid.pieces, CHUNK, tolerance, most))]
    others = sources.join(near, "node", "left_anti") if laid.large else sources.limit(0)
    for some in batches(laid, in_blocks(laid, whole(others)), pairs) if laid.large else []:
        first = cut(starts(some, "f8"))
        rows = first.withColumn("term", F.col("vals"))
        for k in range(1, most + 1):
            sent = step(laid, rows.select(*KEYS, "cols", F.col("term").alias("vals")), "f8")
            both = _role(sent, "step").unionByName(_role(rows, "front"))
            rows = cut(both.groupBy(*KEYS).applyInPandas(half(k), _matrix_schema(some, "term binary")))
            if k % 8 == 0:
                lines = rows.mapInPandas(squares, _schema(rows, "block long", "slot int", "value double", "all double", "last double")).groupBy("scope", "block", "slot").agg(*(F.sum(c).alias(c) for c in ("value", "all", "last")))
                if lines.where((F.col("last") > tolerance * F.col("all")) & (F.col("all") < float("inf"))).isEmpty():
                    break
        parts.append(cut(some.join(lines, ["scope", "block", "slot"]).select("place", "value")))
    return reduce(DataFrame.unionByName, parts).join(laid.places.select("node", "place"), "place").select("node", "value")
