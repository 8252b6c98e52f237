"""Ranked search in literals.

Tokens are runs of letters and digits, lower-cased. A literal matches if it has every token of the
query, unstemmed (class "exact") or stemmed (class "normalized"). Within a class the order is BM25
(k1 = 1.2, b = 0.75) over the distinct literals searched, then the term. The stemmer takes common
English endings off; it and the scores are this engine's own choice.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms
from quadrille.functions.errors import PREDICATES_CAP, SEARCH_CAP, QueryError, limited
from quadrille.operators.graph import Graph

EXACT, NORMALIZED = "exact", "normalized"
K1, B = 1.2, 0.75
STEM = r"^(.{3,}?)(?:ing|ed|es|s)$"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def stemmed(token: Column) -> Column:
    ends = token.endswith("s") | token.endswith("ed") | token.endswith("ing")  # else the expression matches nothing
    return F.when(ends, F.regexp_replace(token, STEM, "$1")).otherwise(token)


def stem(word: str) -> str:
    return re.sub(STEM, r"\1", word)


def _has_stem(value: str):
    return lambda t: t.startswith(value) & (stemmed(t) == F.lit(value))


def sized(rows: DataFrame) -> DataFrame:
    """Terms (term, ...) with the size of those that are literals: how many tokens they have."""
    return rows.withColumn("size", F.when(terms.is_literal(F.col("term")), F.size(tokens(terms.lexical(F.col("term"))))))


def postings(found: DataFrame, parts: int) -> DataFrame:
    """(stem, word, id, n): the inverted index of literals (id, term), which it names by their ids.

    Literals are dealt out by id and their words counted where they then are, so words are not moved and no stem
    is one task's; each part is sorted by stem.
    """
    words = found.repartition(parts, "id").select("id", F.explode(tokens(terms.lexical(F.col("term")))).alias("word"))
    counted = words.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(stemmed(F.col("word")).alias("stem"), "word", "id", F.col("n").cast("int").alias("n")).sortWithinPartitions("stem", "id")


def corpus(found: DataFrame) -> DataFrame:
    """(literals, mean): one row, from literals with their size."""
    return found.agg(F.count(F.lit(1)).cast("double").alias("literals"), F.avg("size").alias("mean"))


def _words(query: str) -> list[str]:
    return list(dict.fromkeys("".join(c.lower() if c.isalnum() else " " for c in query).split()))


def _measured(rows: DataFrame, asked: list[str]) -> DataFrame:
    """Those of the rows whose object is a literal, with its size, how often it holds each token (n0, ...) and whether unstemmed (e0, ...)."""
    own = rows.filter(terms.is_literal(F.col("o"))).withColumn("_text", F.lower(terms.lexical(F.col("o"))))
    own = own.withColumn("words", tokens(F.col("_text")))
    for i, w in enumerate(asked):
        # a token begins with its stem, so most texts and words are told apart without stemming any
        one = F.size(F.filter("words", _has_stem(stem(w))))
        own = own.withColumn(f"n{i}", F.when(F.col("_text").contains(stem(w)), one).otherwise(0).cast("double")).withColumn(f"e{i}", F.array_contains("words", w))
    return own.withColumn("size", F.size("words").cast("double")).drop("_text", "words")


def _known(own: DataFrame, asked: list[str], size: DataFrame | None = None) -> DataFrame:
    """One row: how many literals, their mean length, and how many hold each token, by one pass over own where that has all literals."""
    held = [F.count_if(F.col(f"n{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(asked))]
    return own.agg(F.count(F.lit(1)).cast("double").alias("literals"), F.avg("size").alias("mean"), *held) if size is None else size.crossJoin(own.agg(*held))


def _all_held(asked: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"n{i}") > 0 for i in range(len(asked))])


def _ranked(own: DataFrame, known: DataFrame, asked: list[str]) -> DataFrame:
    """The rows of own that match, with class, match_kind and score."""
    at = range(len(asked))
    match = own.filter(_all_held(asked)).crossJoin(F.broadcast(known))
    score = F.lit(0.0)
    for i in at:
        n, df = F.col(f"n{i}"), F.col(f"df{i}")
        idf = F.log(F.lit(1.0) + (F.col("literals") - df + 0.5) / (df + 0.5))
        score = score + idf * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    exact = reduce(lambda a, b: a & b, [F.col(f"e{i}") for i in at])
    rest = [c for c in own.columns if c != "size" and c not in {f"{x}{i}" for i in at for x in "ne"}]
    return match.select(*rest, F.when(exact, 0).otherwise(1).alias("class"), F.when(exact, EXACT).otherwise(NORMALIZED).alias("match_kind"), F.round(score, 6).alias("score"))


def _searched(graph: Graph, predicates: list[str] | None) -> DataFrame:
    return graph.bag if predicates is None else graph.triples.filter(F.col("p").isin(predicates))


def _refused(query: str, predicates: list[str] | None) -> None:
    if not query.strip():
        raise QueryError("malformed_request", "the query is empty")
    if predicates is not None and len(predicates) > PREDICATES_CAP:
        raise QueryError("cap_exceeded", f"over {PREDICATES_CAP} predicates")


def hits(graph: Graph, query: str, predicates: list[str] | None = None) -> DataFrame:
    """(o, class, match_kind, score) of the distinct literals that match.

    A published index is read by the query's stems. Without one, or where predicates narrow the literals, they
    are scanned.
    """
    _refused(query, predicates)
    asked = _words(query)
    if not asked:
        return graph.triples.filter("false").select("o", F.lit(0).alias("class"), F.lit(EXACT).alias("match_kind"), F.lit(0.0).alias("score"))
    if "postings" in graph.tables and predicates is None:
        rows = graph.tables["postings"].filter(F.col("stem").isin(list({stem(w) for w in asked})))
        times = [F.sum(F.when(F.col("stem") == stem(w), F.col("n")).otherwise(0)).cast("double").alias(f"n{i}") for i, w in enumerate(asked)]
        own = rows.groupBy("id").agg(*times, *(F.max(F.col("word") == w).alias(f"e{i}") for i, w in enumerate(asked)))
        match = own.filter(_all_held(asked)).join(graph.tables["terms"].select("id", F.col("term").alias("o"), F.col("size").cast("double").alias("size")), "id")
        return _ranked(match, _known(own, asked, graph.tables["corpus"]), asked).select("o", "class", "match_kind", "score")
    own = _measured(_searched(graph, predicates).select("o").distinct(), asked)
    return _ranked(own, _known(own, asked), asked)


def found(graph: Graph, query: str, rows: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """(s, p, o, class, match_kind, score) of those of the rows whose object matches.

    Without an index each row's literal is held against the query where it stands, so rows are not joined with hits.
    """
    _refused(query, predicates)
    asked = _words(query)
    if not asked or "postings" in graph.tables and predicates is None:
        return rows.join(hits(graph, query, predicates), "o")
    known = _known(_measured(_searched(graph, predicates).select("o").distinct(), asked), asked)
    return _ranked(_measured(rows.select("s", "p", "o"), asked), known, asked)


def statements(graph: Graph, query: str, s=None, p=None) -> DataFrame:
    """(s, p, o, match_kind, score): a pattern whose object is a matching literal."""
    return found(graph, query, graph.found(s, p)[0]).select("s", "p", "o", "match_kind", "score")


def count(graph: Graph, query: str, s=None, p=None) -> DataFrame:
    return statements(graph, query, s, p).agg(F.count(F.lit(1)).alias("count"))


def search(graph: Graph, query: str, role: str | None = None, predicate: str | None = None, limit: int | None = None) -> DataFrame:
    """(subject, predicate, literal, match_kind, score): each subject's best literal, best first."""
    predicates = None
    if role is not None:
        if role not in graph.roles:
            raise QueryError("malformed_request", f"{role!r} is no role")
        predicates = list(dict.fromkeys(graph.roles[role]))
    if predicate is not None:
        predicates = [*(predicates or []), graph.parse(predicate).stored()]
    n = limited(limit, 10, SEARCH_CAP)
    rows = graph.whole if predicates is None else graph.triples.filter(F.col("p").isin(predicates))
    best = found(graph, query, rows, predicates).groupBy("s").agg(F.min(F.struct("class", (-F.col("score")).alias("down"), "o", "p", "match_kind")).alias("b"))
    best = best.orderBy("b.class", "b.down", "b.o", "s").limit(n)
    return best.select(F.col("s").alias("subject"), F.col("b.p").alias("predicate"), F.col("b.o").alias("literal"), F.col("b.match_kind").alias("match_kind"), (-F.col("b.down")).alias("score"))
