"""Beyond the operations above: basic graph patterns, stars and value ranges, as joins and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms
from quadrille.functions.errors import QueryError
from quadrille.operators.graph import Graph


def basic_pattern(graph: Graph, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Solutions of triple patterns with ?variables, joined on those they share.

    A pattern is taken when it shares a variable with those before it; patterns that never do have only
    a product of all rows as their answer, and are refused.
    """
    out: DataFrame | None = None
    patterns = list(patterns)
    while patterns:
        at = next((i for i, x in enumerate(patterns) if out is None or {v[1:] for v in x if v.startswith("?")} & set(out.columns)), None)
        if at is None:
            raise QueryError("unsupported", f"no variable joins {patterns} to the patterns before them")
        pattern = patterns.pop(at)
        names = {c: v[1:] for c, v in zip("spo", pattern) if v.startswith("?")}
        rows = graph.found(**{c: v for c, v in zip("spo", pattern) if not v.startswith("?")})[0]
        for name in set(names.values()):
            own = [c for c in names if names[c] == name]
            rows = reduce(lambda r, c, a=own[0]: r.filter(F.col(a) == F.col(c)), own[1:], rows)
        columns = {n: c for c, n in names.items()}
        rows = rows.select(*(F.col(c).alias(n) for n, c in columns.items()))
        if out is None:
            out = rows
        else:
            out = out.join(rows, [c for c in rows.columns if c in out.columns])
    return out


def star(graph: Graph, predicates: dict[str, str]) -> DataFrame:
    """(s, a column for each predicate): one pass and one grouping, the least value where there are several."""
    rows = graph.triples.filter(F.col("p").isin(list(predicates.values())))
    return rows.groupBy("s").agg(*(F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, p in predicates.items()))


def number_range(graph: Graph, p: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """(s, value decimal) of a predicate's numeric literals with low <= value < high."""
    rows = graph.matching(graph.triples, p=p).select("s", terms.lexical(F.col("o")).try_cast("decimal(38,6)").alias("value")).filter("value IS NOT NULL")
    if low is not None:
        rows = rows.filter(F.col("value") >= F.lit(low).cast("decimal(38,6)"))
    if high is not None:
        rows = rows.filter(F.col("value") < F.lit(high).cast("decimal(38,6)"))
    return rows
