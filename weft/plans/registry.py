"""Catalogue of community detectors behind one typed parameter interface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from weft.graph import Graph


@dataclass(frozen=True)
class Param:
    """A parameter: int, float, bool, enum (one of options) or node (any node id; None: the first)."""

    key: str
    kind: str
    default: Any
    low: float | None = None
    high: float | None = None
    options: tuple = ()
    help: str = ""

    def check(self, value: Any) -> Any:
        if self.kind == "enum":
            if value not in self.options:
                raise ValueError(f"{self.key}: {value!r} is none of {self.options}")
            return value
        if self.kind == "node":
            return value
        if self.kind not in ("int", "float", "bool"):
            raise ValueError(f"{self.key}: unknown kind {self.kind!r}")
        value = {"int": int, "float": float, "bool": bool}[self.kind](value)
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise ValueError(f"{self.key}: {value} is not within [{self.low}, {self.high}]")
        return value


@dataclass(frozen=True)
class Detector:
    key: str
    name: str
    run: Callable[[Graph, dict], DataFrame]
    params: tuple[Param, ...] = ()
    overlapping: bool = True
    help: str = ""

    def bind(self, given: dict | None = None) -> dict:
        """All parameters, checked; unknown ones raise."""
        given = given or {}
        if unknown := set(given) - {p.key for p in self.params}:
            raise ValueError(f"{self.key} has no parameter {', '.join(sorted(unknown))}")
        return {p.key: p.check(given.get(p.key, p.default)) for p in self.params}


@dataclass
class Clustering:
    """The result of a detector: membership(cid, node), cids dense by size and smallest node."""

    membership: DataFrame
    graph: Graph
    method: str
    params: dict
    overlapping: bool = True
    stats: dict = field(default_factory=dict)


_DETECTORS: dict[str, Detector] = {}


def register(key: str, name: str, *params: Param, overlapping: bool = True, help: str = "") -> Callable:
    """Decorator: adds (graph, **params) -> membership to the catalogue."""

    def add(f: Callable) -> Callable:
        _DETECTORS[key] = Detector(key, name, lambda g, p: f(g, **p), params, overlapping, help)
        return f

    return add


def detectors(include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), hide: tuple[str, ...] = ()) -> list[Detector]:
    """In order of registration: only include, without exclude, without those whose key, name or help holds a part of hide."""
    import weft.plans.detect  # noqa: F401  registers them

    low = lambda xs: {x.lower() for x in xs}
    out = [d for k, d in _DETECTORS.items() if (not include or k.lower() in low(include)) and k.lower() not in low(exclude)]
    return [d for d in out if not any(h in f"{d.key} {d.name} {d.help}".lower() for h in low(hide))]


def detector(key: str) -> Detector:
    found = {d.key: d for d in detectors()}
    if key not in found:
        raise KeyError(f"no detector {key!r}")
    return found[key]


def detect(graph: Graph, key: str, stats: bool = False, **params) -> Clustering:
    """Runs a detector; with stats the result has those of with_stats, for COBS with its crisp start."""
    from weft.operators.cover import relabel
    from weft.plans.detect import boundary_overlap, greedy
    from weft.plans.lineage import cut

    d = detector(key)
    bound = d.bind(params)
    part = cut(greedy(graph)) if stats and d.key == "COBS" else None
    found = d.run(graph, bound) if part is None else boundary_overlap(graph, **bound, part=part)
    made = Clustering(relabel(found.distinct()), graph, d.name, bound, d.overlapping)
    return with_stats(made, part) if stats else made


def with_stats(found: Clustering, part: DataFrame | None = None) -> Clustering:
    """found with stats: communities, overlapping nodes, nodes by number of communities, and of the partition that it came from, if given, its communities, modularity and boundary nodes."""
    from weft.operators import boundary, cover, metrics

    per = {r.memberships: r.nodes for r in cover.count_histogram(found.graph, found.membership).collect() if r.memberships}
    stats = {"final_k": found.membership.select("cid").distinct().count(), "overlap_nodes": sum(n for k, n in per.items() if k > 1), "membership_count_dist": dict(sorted(per.items()))}
    if part is not None:
        stats |= {"crisp_k": part.select("cid").distinct().count(), "crisp_modularity": metrics.modularity(found.graph, part).first()[0], "boundary_nodes": boundary.boundary_candidates(found.graph, part).select("node").distinct().count()}
    found.stats = stats
    return found
