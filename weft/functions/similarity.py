"""Set similarities from sufficient statistics, as columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of the similarities.
ALIASES = {
    "salton": "cosine", "cos": "cosine", "cosine": "cosine", "ochiai": "cosine", "jaccard": "jaccard", "tanimoto": "jaccard", "dice": "dice", "sorensen": "dice", "sorensen_dice": "dice",
    "overlap": "overlap", "simpson": "overlap", "szymkiewicz_simpson": "overlap", "overlap_coefficient": "overlap", "aa": "aa", "adamic_adar": "aa", "ra": "ra", "resource_allocation": "ra",
}
METRICS = ("cosine", "jaccard", "dice", "overlap", "aa", "ra")


def metric_name(name: str) -> str:
    """The canonical name, whatever its accents and whether blanks, hyphens or dashes join its words; none is cosine, an unknown one raises."""
    plain = unicodedata.normalize("NFD", (name or "cosine").strip().lower().replace("ø", "o"))
    key = re.sub(r"[\s\u2010-\u2015-]+", "_", "".join(c for c in plain if not unicodedata.combining(c)))
    if key not in ALIASES:
        raise ValueError(f"unknown similarity {name!r}; known: {', '.join(METRICS)}")
    return ALIASES[key]


def node_weight(degree: Column, metric: str) -> Column:
    """Weight of a shared node: 1/ln(1+degree) for aa, 1/degree for ra, else 1; 0 without neighbours."""
    if metric == "aa":
        return F.when(degree <= 0, 0.0).otherwise(1 / F.log1p(degree))
    if metric == "ra":
        return F.when(degree <= 0, 0.0).otherwise(1 / degree.cast("double"))
    return F.lit(1.0)


def similarity(metric: str, a: Column, b: Column, both: Column, dot: Column | None = None, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Similarity of two sets of sizes a and b that share `both` elements; dot and norms are sums of squared weights."""
    formulas = {
        "cosine": lambda: both / F.sqrt(a.cast("double") * b),
        "jaccard": lambda: both / (a + b - both).cast("double"),
        "dice": lambda: 2 * both / (a + b).cast("double"),
        "overlap": lambda: both / F.least(a, b).cast("double"),
        "aa": lambda: F.try_divide(dot, F.sqrt(norm_a * norm_b)),
        "ra": lambda: F.try_divide(dot, F.sqrt(norm_a * norm_b)),
    }
    return F.when((both <= 0) | (a <= 0) | (b <= 0), 0.0).otherwise(F.coalesce(formulas[metric](), F.lit(0.0)))
