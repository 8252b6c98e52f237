"""Preferred labels: the best literal of a node by language, then predicate, then term order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms, texts
from quadrille.functions.errors import LABELS_CAP, LANGS_CAP, QueryError
from quadrille.operators.graph import Graph


def candidates(graph: Graph, predicates: list[str], langs: list[str]) -> DataFrame:
    """(node, rank, ord, o) of literals of the label predicates; rank: ranges asked for, untagged, others."""
    if len(langs) > LANGS_CAP:
        raise QueryError("cap_exceeded", f"over {LANGS_CAP} languages")
    own = graph.triples.filter(F.col("p").isin(predicates) & terms.is_literal(F.col("o")))
    tag = terms.language(F.col("o"))
    rank = F.when(tag.isNull(), len(langs))
    for i, wanted in reversed(list(enumerate(langs))):
        rank = F.when(tag.isNotNull() & texts.language_matches(tag, wanted), i).otherwise(rank)
    order = reduce(lambda c, x: c.when(F.col("p") == x[1], x[0]), list(enumerate(predicates))[1:], F.when(F.col("p") == predicates[0], 0))
    return own.select(F.col("s").alias("node"), F.coalesce(rank, F.lit(len(langs) + 1)).alias("rank"), order.alias("ord"), "p", "o")


def preferred(graph: Graph, predicates: list[str] | None = None, langs: list[str] | tuple = ()) -> DataFrame:
    """(node, label, source, lang): one row for each node that has a label; a grouped minimum, so no sort."""
    predicates = predicates or graph.roles["label"]
    best = candidates(graph, predicates, list(langs)).groupBy("node").agg(F.min(F.struct("rank", "ord", "o", "p")).alias("b"))
    return best.select("node", terms.lexical(F.col("b.o")).alias("label"), F.col("b.p").alias("source"), terms.language(F.col("b.o")).alias("lang"))


def resolve(graph: Graph, iris: list[str], predicates: list[str] | None = None, langs: list[str] | tuple = ()) -> DataFrame:
    """(ord, iri, label, source, lang) in the order asked, repeats and all; null where there is none."""
    if len(iris) > LABELS_CAP:
        raise QueryError("cap_exceeded", f"{len(iris)} nodes are over the cap of {LABELS_CAP}")
    named = [graph.parse(p).stored() for p in predicates] if predicates else None
    asked = graph.spark.createDataFrame([(i, graph.parse(x).stored()) for i, x in enumerate(iris)], "ord int, iri string")
    small = F.broadcast(asked)  # LABELS_CAP rows at most
    mine = Graph(graph.triples.join(F.broadcast(asked.select(F.col("iri").alias("s")).distinct()), "s", "left_semi"), roles=graph.roles)
    found = preferred(mine, named, langs)
    return small.join(found, F.col("iri") == F.col("node"), "left").select("ord", "iri", "label", "source", "lang").orderBy("ord")


def hydrated(graph: Graph, rows: DataFrame, langs: list[str] | tuple = (), predicates: list[str] | None = None, sources: bool = False) -> DataFrame:
    """rows with label_s, label_p and label_o of the IRIs in them, and with sources the predicates that gave them.

    Labels are looked up for the terms of the rows alone. An object that is a statement term has its
    label made of its parts' labels.
    """
    shown = [x for x in "spo" if x in rows.columns]
    asked = rows.select(F.explode(F.array(*shown)).alias("s"))
    props = None
    if graph.propositions is not None and "o" in shown:
        props = graph.propositions.join(rows.select(F.col("o").alias("tt_id")).distinct(), "tt_id", "left_semi").select("tt_id", "s", "p", "o")
        asked = asked.union(props.select(F.explode(F.array("s", "p", "o")).alias("s")))
    own = graph.triples.filter(F.col("p").isin(predicates or graph.roles["label"])).join(asked.distinct(), "s", "left_semi")
    found = preferred(Graph(own, roles=graph.roles), predicates, langs).select("node", "label", "source")
    for c in shown:
        rows = rows.join(found.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"), F.col("source").alias(f"source_{c}")), c, "left")
    if props is not None:
        parts = props
        for c in "spo":
            parts = parts.join(found.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left")
        named = F.concat_ws(" ", *(F.coalesce(f"l{c}", terms.lexical(F.col(c)), texts.fallback_label(F.col(c))) for c in "spo"))
        rows = rows.join(parts.select(F.col("tt_id").alias("o"), named.alias("_tt")), "o", "left").withColumn("label_o", F.coalesce("label_o", "_tt")).drop("_tt")
    return rows if sources else rows.drop(*(f"source_{c}" for c in shown))
