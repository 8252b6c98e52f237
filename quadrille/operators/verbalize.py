"""Nodes as text: a label line, then a line for each predicate and kept value.

Names: an IRI is named by a template of its class (a profile), if one renders, else by the first
literal of its label predicates in their order and then in term order (no language order here), else
by its humanized fragment. Templates name the values of their fields in turn, at most eight deep; a
node that is being named already is named without templates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import terms, texts
from quadrille.functions.errors import QueryError
from quadrille.functions.terms import RDF_TYPE
from quadrille.operators.graph import Graph

DEPTH = 8
VALUES = 3
_FIELD = re.compile(r"\{([^{}]*)\}")


@dataclass
class Template:
    """Text with {field} places; a field is a predicate."""

    text: str
    fields: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        names = _FIELD.findall(self.text)
        if not names or any(n not in self.fields for n in names):
            raise QueryError("malformed_request", f"a template's places are its fields: {self.text!r}")
        if _FIELD.sub("", self.text).count("{") or _FIELD.sub("", self.text).count("}"):
            raise QueryError("malformed_request", f"a brace is unmatched: {self.text!r}")


@dataclass
class Target:
    cls: str
    labels: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    template: Template | None = None
    predicate_limit: int = VALUES


@dataclass
class Config:
    targets: dict[str, Target]
    profiles: dict[str, Template] = field(default_factory=dict)  # by class


def plain_names(graph: Graph, predicates: list[str]) -> DataFrame:
    """(node, label): the first literal by predicate order, then term order."""
    own = graph.triples.filter(F.col("p").isin(predicates) & terms.is_literal(F.col("o")))
    order = reduce(lambda c, x: c.when(F.col("p") == x[1], x[0]), list(enumerate(predicates))[1:], F.when(F.col("p") == predicates[0], 0))
    best = own.groupBy(F.col("s").alias("node")).agg(F.min(F.struct(order.alias("k"), "o")).alias("b"))
    return best.select("node", texts.normalized(terms.lexical(F.col("b.o"))).alias("label")).filter("label != ''")


def _rendered(template: Template, values: dict[str, Column]) -> Column:
    """The template's text; a field without a value adds nothing, and a template without text renders to nothing."""
    parts, last = [], 0
    for m in _FIELD.finditer(template.text):
        parts += [F.lit(template.text[last : m.start()]), F.coalesce(values[m[1]], F.lit(""))]
        last = m.end()
    return F.concat(*parts, F.lit(template.text[last:]))


def template_names(graph: Graph, profiles: dict[str, Template], plain: DataFrame) -> DataFrame:
    """(node, label) of nodes that a profile renders.

    Paths of nodes being named grow by joins, level by level, and are folded back from the deepest. A
    node of several classes takes the first profile that renders, in the order of its types' terms: classes that
    are subjects too come first, as they do in the dictionary.
    """
    if not profiles:
        return plain.filter("false")
    subjects = {r.s for r in graph.found()[0].filter(F.col("s").isin(list(profiles))).select("s").distinct().collect()}  # a row for each profile
    place = {c: i for i, c in enumerate(sorted(profiles, key=lambda c: (c not in subjects, c)))}
    preds = sorted({p for t in profiles.values() for p in t.fields.values()})
    edges = graph.triples.filter(F.col("p").isin(preds) & ~terms.is_blank(F.col("o")))
    typed = graph.triples.filter((F.col("p") == RDF_TYPE) & F.col("o").isin(list(profiles))).select("s", F.col("o").alias("cls"))
    level = typed.select("s").distinct().select(F.array("s").alias("path"), F.col("s").alias("node"))
    steps = []
    for depth in range(DEPTH):
        grown = level.join(edges, level["node"] == edges["s"]).select("path", "node", "p", "o")
        steps.append((level, grown))
        deeper = grown.filter(~F.array_contains("path", F.col("o"))).join(typed.select("s").distinct(), F.col("o") == F.col("s"), "left_semi")
        level = deeper.select(F.concat("path", F.array("o")).alias("path"), F.col("o").alias("node")).distinct()
        if depth + 1 < DEPTH and level.isEmpty():
            break
    named = None
    for level, grown in reversed(steps):
        value = grown.join(plain.select(F.col("node").alias("o"), F.col("label").alias("plain")), "o", "left")
        base = F.when(terms.is_literal(F.col("o")), texts.normalized(terms.lexical(F.col("o")))).otherwise(F.coalesce("plain", texts.fallback_label(F.col("o"))))
        if named is not None:
            value = value.withColumn("deep", F.concat("path", F.array("o"))).join(named.select(F.col("path").alias("deep"), "label"), "deep", "left")
            base = F.coalesce("label", base)
        value = value.withColumn("value", base).filter("value != ''")
        wide = value.groupBy("path", "node").agg(*(F.min(F.when(F.col("p") == p, F.col("value"))).alias(f"f{i}") for i, p in enumerate(preds)))
        rows = level.join(wide.drop("node"), "path", "left").join(typed, F.col("node") == F.col("s"))
        label = F.lit(None).cast("string")
        for cls, t in profiles.items():
            label = F.when(F.col("cls") == cls, _rendered(t, {n: F.col(f"f{preds.index(p)}") for n, p in t.fields.items()})).otherwise(label)
        rows = rows.withColumn("label", texts.normalized(label)).filter("label IS NOT NULL AND label != ''")
        order = reduce(lambda c, x: c.when(F.col("cls") == x[0], x[1]), list(place.items())[1:], F.when(F.col("cls") == next(iter(place)), place[next(iter(place))]))
        named = rows.groupBy("path", "node").agg(F.min(F.struct(order.alias("place"), "label")).alias("b")).select("path", "node", F.col("b.label").alias("label"))
    return named.select("node", "label")


def statement_texts(graph: Graph, names) -> DataFrame:
    """(tt_id, text): a statement term's parts by name, joined by spaces; nested ones in brackets, blank nodes left out.

    A level is named by the one below it, from the terms that hold no other, up to the depth that terms may have.
    """
    props = graph.propositions.select("tt_id", "s", "p", "o")
    for c in "spo":
        props = props.join(names.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left")
    named = lambda c: F.coalesce(f"l{c}", F.when(terms.is_literal(F.col(c)), texts.normalized(terms.lexical(F.col(c)))), texts.fallback_label(F.col(c)))
    piece = {c: F.when(~terms.is_blank(F.col(c)), named(c)) for c in "so"}
    piece["p"] = F.lower(F.coalesce(texts.humanized(F.col("lp")), texts.fallback_label(F.col("p"))))
    rest = props.select("tt_id", F.col("o").alias("inner"), *(piece[c].alias(f"t{c}") for c in "spo"))
    ids = props.select(F.col("tt_id").alias("inner"))
    level = rest.join(ids, "inner", "left_anti").select("tt_id", F.concat_ws(" ", "ts", "tp", "to").alias("text"))
    done, rest = level, rest.join(ids, "inner", "left_semi")
    for _ in range(terms.DEPTH_CAP):
        if rest.join(level.select(F.col("tt_id").alias("inner")), "inner", "left_semi").isEmpty():
            break
        level = rest.join(level.select(F.col("tt_id").alias("inner"), "text"), "inner").select("tt_id", F.concat_ws(" ", "ts", "tp", F.concat(F.lit("("), "text", F.lit(")"))).alias("text"))
        done = done.union(level)
    return done


def verbalize(graph: Graph, config: Config, target: str, roots: list[str] | None = None, text_bytes: int | None = None) -> DataFrame:
    """(target, iri, label, text, digest, chars, lines, truncated, limited) of a target's roots.

    limited: a predicate had more values than are shown. text_bytes bounds the bytes of a text's lines behind its
    label line; a text that it cuts, at a line's end, is truncated. Without it none is.
    """
    if target not in config.targets:
        raise QueryError("not_found", f"there is no target {target!r}")
    own = config.targets[target]
    members = graph.triples.filter((F.col("p") == RDF_TYPE) & (F.col("o") == own.cls) & ~terms.is_blank(F.col("s"))).select(F.col("s").alias("root"))
    if roots is not None:
        asked = [graph.parse(r).stored() for r in roots]
        members = graph.spark.createDataFrame([(r,) for r in dict.fromkeys(asked)], "root string")
    predicates = list(dict.fromkeys([*own.labels, *graph.roles["label"]]))
    plain = plain_names(graph, predicates)
    by_profile = template_names(graph, config.profiles, plain)
    names = plain.join(by_profile.select("node", F.col("label").alias("made")), "node", "full").select("node", F.coalesce("made", "label").alias("label"))
    first = names
    if own.template is not None:
        made = template_names(graph, {own.cls: own.template}, plain)
        first = names.join(made.select("node", F.col("label").alias("made")), "node", "full").select("node", F.coalesce("made", "label").alias("label"))

    star = members.join(graph.triples, members["root"] == graph.triples["s"]).filter(~terms.is_blank(F.col("o"))).select("root", "p", "o")
    if own.include:
        star = star.filter(F.col("p").isin(own.include))
    if own.ignore:
        star = star.filter(~F.col("p").isin(own.ignore))
    value = F.coalesce(terms.lexical(F.col("o")), F.col("o"))
    star = star.withColumn("score", texts.stable_score(F.col("root"), F.col("p"), value))
    # sizes by hash aggregation, and a rank with a limit alone: each task keeps predicate_limit values of a hub before the shuffle
    over = star.groupBy("root", "p").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > own.predicate_limit).groupBy("root").agg(F.count(F.lit(1)).alias("cut"))
    star = star.withColumn("rn", F.row_number().over(Window.partitionBy("root", "p").orderBy("score", "o"))).filter(F.col("rn") <= own.predicate_limit)
    star = star.join(names.select(F.col("node").alias("o"), F.col("label").alias("ol")), "o", "left").join(names.select(F.col("node").alias("p"), F.col("label").alias("pl")), "p", "left")
    if graph.propositions is not None:
        star = star.join(statement_texts(graph, names).select(F.col("tt_id").alias("o"), F.col("text").alias("tt")), "o", "left")
    else:
        star = star.withColumn("tt", F.lit(None).cast("string"))
    shown = F.when(terms.is_literal(F.col("o")), texts.normalized(terms.lexical(F.col("o")))).otherwise(F.coalesce("tt", "ol", texts.fallback_label(F.col("o"))))
    name = F.lower(F.coalesce(texts.humanized(F.col("pl")), texts.fallback_label(F.col("p"))))
    star = star.withColumn("shown", shown).filter("shown != ''").withColumn("line", F.concat(name, F.lit(": "), "shown"))
    lines = star.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("p", "score", "line"))).alias("lines"))
    cut = F.lit(False)
    if text_bytes is not None:
        spent = F.aggregate("lines", F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("kept")), lambda a, x: F.struct((a["bytes"] + F.octet_length(x["line"]) + 1).cast("long").alias("bytes"), F.when(a["bytes"] + F.octet_length(x["line"]) + 1 <= text_bytes, a["kept"] + 1).otherwise(a["kept"]).alias("kept")))
        lines = lines.withColumn("kept", spent["kept"]).withColumn("truncated", F.col("kept") < F.size("lines")).withColumn("lines", F.slice("lines", F.lit(1), F.col("kept")))
        cut = F.coalesce("truncated", F.lit(False))
    out = members.join(lines, "root", "left").join(over, "root", "left").join(first.select(F.col("node").alias("root"), "label"), "root", "left")
    label = F.coalesce("label", texts.fallback_label(F.col("root")))
    text = F.concat_ws("\n", F.concat(F.lit("label: "), label), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    out = out.select(F.lit(target).alias("target"), F.col("root").alias("iri"), label.alias("label"), text.alias("text"), F.coalesce(F.size("lines"), F.lit(0)).alias("n"), F.coalesce("cut", F.lit(0)).alias("cut"), cut.alias("truncated"))
    return out.select("target", "iri", "label", "text", texts.digest(F.col("text")).alias("digest"), F.length("text").alias("chars"), (F.greatest("n", F.lit(0)) + 1).alias("lines"), "truncated", (F.col("cut") > 0).alias("limited"))


def plan(records: DataFrame) -> DataFrame:
    """(target, members, mean_chars, max_chars, mean_lines, truncated, limited) of a target's records."""
    return records.groupBy("target").agg(F.count(F.lit(1)).alias("members"), F.expr("sum(chars) div count(1)").alias("mean_chars"), F.max("chars").alias("max_chars"), F.expr("sum(lines) div count(1)").alias("mean_lines"), F.count_if("truncated").alias("truncated"), F.count_if("limited").alias("limited"))


def outputs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roots, texts): each root with its text's digest, and each text once."""
    return records.select("iri", "target", "digest"), records.select("digest", "text").dropDuplicates(["digest"])
