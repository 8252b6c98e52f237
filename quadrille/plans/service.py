"""Requests by name: an operation and its parameters, as a client states them.

Every parameter is used or refused. ``answer`` gives rows with their cursor, completeness and absent
terms; ``request`` gives the rows alone. Counts are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms, values
from quadrille.functions.errors import LABELS_CAP, ROOTS_CAP, SAMPLE_CAP, QueryError, limited
from quadrille.functions.terms import RDF_TYPE
from quadrille.operators import labels, search, stats, verbalize
from quadrille.operators.graph import Answer, Graph

#: Parameters of each operation.
PARAMETERS = {
    "fragment": {"s", "p", "o", "o.text", "g", "limit", "cursor", "labels", "lang", "label_source"},
    "bindings": {"pattern", "bindings", "values", "g", "distinct", "limit", "cursor", "labels", "lang", "label_source"},
    "tpf": {"subject", "predicate", "object", "graph", "values", "order", "limit", "cursor"},
    "count": {"s", "p", "o", "o.text", "g", "pattern", "bindings"},
    "describe": {"iri", "direction"},
    "sample": {"s", "p", "o", "n", "seed"},
    "distinct": {"s", "p", "o", "g", "group_by", "pattern", "bindings", "limit", "cursor"},
    "terms": {"prefix", "role", "count", "limit", "cursor"},
    "search": {"q", "role", "predicate", "limit"},
    "labels": {"iris", "labels", "lang", "label_source"},
    "graphs": {"limit", "cursor"},
    "schema": {"class", "predicate", "datatype", "children", "projection", "view", "limit", "cursor"},
    "void": set(),
    "summary": set(),
    "verbalize": {"config", "iri", "target", "n", "seed", "plan"},
}
#: Parameters that other services of this kind have and this one does not answer.
UNSUPPORTED = {"o.lang", "o.dt", "o.ge", "o.gt", "o.le", "o.lt"}


def request(graph: Graph, operation: str, /, **params) -> DataFrame:
    """The rows of an operation. Dots in a parameter's name are written as two underscores."""
    return answer(graph, operation, **params).rows


def answer(graph: Graph, operation: str, /, **params) -> Answer:
    """The answer of an operation: its rows and, where it has pages, the cursor and whether the page is the last."""
    params = {k.replace("__", "."): v for k, v in params.items() if v is not None}
    if operation not in PARAMETERS:
        raise QueryError("not_found", f"there is no operation {operation!r}")
    for k in params:
        if k in UNSUPPORTED:
            raise QueryError("unsupported", f"{k} is not answered")
        if k not in PARAMETERS[operation]:
            raise QueryError("unknown_parameter", f"{operation} has no parameter {k!r}; it has {sorted(PARAMETERS[operation])}")
    got = _OPERATIONS[operation](graph, params)
    return got if isinstance(got, Answer) else Answer(got)


def _spo(p: dict) -> dict:
    return {k: p[k] for k in "spo" if k in p}


def _text(graph: Graph, p: dict) -> DataFrame:
    for k in ("o", "g"):
        if k in p:
            raise QueryError("malformed_request", f"{k} and o.text do not go together")
    return search.statements(graph, p["o.text"], p.get("s"), p.get("p"))


def _labelled(graph: Graph, found: Answer, p: dict) -> Answer:
    """found with labels, if they are asked for; what shapes labels is refused without them."""
    if not p.get("labels"):
        for k in ("lang", "label_source"):
            if p.get(k):
                raise QueryError("malformed_request", f"{k} without labels changes nothing")
        return found
    predicates = None if p["labels"] is True else [graph.parse(x).stored() for x in p["labels"]]
    found.rows = labels.hydrated(graph, found.rows, p.get("lang", []), predicates, bool(p.get("label_source")))
    return found


def _fragment(graph: Graph, p: dict) -> Answer:
    if "o.text" in p:
        ranked = _text(graph, p).withColumn("_class", (F.col("match_kind") != search.EXACT).cast("int"))
        asked = {k: p.get(k) for k in ("o.text", "s", "p")}
        found = graph.paged("text", ranked, ["_class", "-score", "o", "s", "p"], asked, p.get("limit"), p.get("cursor"))
    else:
        found = graph.fragment(**_spo(p), g=p.get("g"), limit=limited(p.get("limit")), cursor=p.get("cursor"))
    return _labelled(graph, found, p)


def _table(graph: Graph, p: dict) -> tuple:
    if "values" in p:
        names, rows = values.parse_values(p["values"], graph.prefixes)
    else:
        names, rows = p["bindings"]["vars"], p["bindings"]["rows"]
    if p.get("g", "").startswith("?"):
        raise QueryError("unsupported", "a table does not bind the graph")
    return p["pattern"], names, rows


def _bindings(graph: Graph, p: dict) -> Answer:
    pattern, names, rows = _table(graph, p)
    rows = values.normalized_rows(rows) if p.get("distinct") else rows
    return _labelled(graph, graph.binding_page(pattern, names, rows, p.get("g"), p.get("limit"), p.get("cursor"), bool(p.get("distinct"))), p)


def _tpf(graph: Graph, p: dict) -> Answer:
    """Explicit syntax: bare IRIs, no prefixes. Without a graph it is the quad view, if there are graphs.

    order names positions whose terms order the rows, as plain strings; without it the pattern's order holds.
    """
    variables = [v for v in (p.get(k) for k in ("subject", "predicate", "object")) if v and v.startswith("?")]
    if "values" not in p and len(set(variables)) != len(variables):
        raise QueryError("unsupported", "a variable that stands twice is bound in every row")
    own = {c: p.get(k) for c, k in zip("spo", ("subject", "predicate", "object"))}
    fixed = {c: terms.parse(v, explicit=True) for c, v in own.items() if v and not v.startswith("?")}
    g = p.get("graph", "*" if graph.quads_given and "values" not in p else None)
    g = g if g in (None, "*") else f"<{g}>"
    if "values" in p:
        names, rows = values.parse_values(p["values"], {})
        if g == "*" or f"?{p.get('graph', '')[1:]}" in [f"?{n}" for n in names] and p.get("graph", "").startswith("?"):
            raise QueryError("unsupported", "a table does not bind the graph")
        scoped = Graph(graph.found(**fixed, g=g)[0])
        found, quads = scoped.restricted({c: v for c, v in own.items() if v and v.startswith("?")}, names, values.normalized_rows(rows)), False
    else:
        found, quads = graph.found(**fixed, g=g)
    if "order" in p:
        if not p["order"] or len(set(p["order"])) != len(p["order"]) or set(p["order"]) - set("spo"):
            raise QueryError("malformed_request", f"an order names s, p and o, not {p['order']!r}")
        sorted_, keys = found, [*p["order"], *(c for c in "spo" if c not in p["order"]), *(["g"] if quads else [])]
    else:
        sorted_, keys = graph.order_keys(found, graph.shape(**fixed), quads)
    asked = {k: p.get(k) for k in ("subject", "predicate", "object", "graph", "values", *(["order"] if "order" in p else []))}
    return graph.paged("tpf", sorted_, [*keys, *(c for c in "spo" if c not in keys)], asked, p.get("limit"), p.get("cursor"))


def _count(graph: Graph, p: dict) -> DataFrame:
    if "pattern" in p:
        return graph.binding_count(*_table(graph, p), p.get("g"))
    if "o.text" in p:
        return _text(graph, p).agg(F.count(F.lit(1)).alias("count"))
    return graph.count(**_spo(p), g=p.get("g"))


def _distinct(graph: Graph, p: dict) -> DataFrame:
    if "group_by" not in p:
        raise QueryError("malformed_request", "group_by is required")
    if "pattern" in p:
        pattern, names, rows = _table(graph, p)
        return graph.distinct_page(p["group_by"], p.get("limit"), p.get("cursor"), g=p.get("g"), pattern=pattern, names=names, rows=rows)
    return graph.distinct_page(p["group_by"], p.get("limit"), p.get("cursor"), **_spo(p), g=p.get("g"))


def _terms(graph: Graph, p: dict) -> DataFrame:
    if p.get("count"):
        if {"limit", "cursor"} & set(p):
            raise QueryError("malformed_request", "a count has no page")
        return graph.term_counts(p.get("prefix", ""))
    return graph.term_page(p.get("prefix", ""), p.get("role", "any"), p.get("limit"), p.get("cursor"))


def _labels(graph: Graph, p: dict) -> DataFrame:
    if len(p.get("iris", [])) > LABELS_CAP:
        raise QueryError("cap_exceeded", f"over {LABELS_CAP} nodes")
    found = labels.resolve(graph, p["iris"], p.get("labels"), p.get("lang", []))
    return found if p.get("label_source") else found.drop("source")


def _schema(graph: Graph, p: dict) -> DataFrame | Answer:
    limited(p.get("limit"), cap=stats.SCHEMA_CAP)
    page = {"limit": p.get("limit"), "cursor": p.get("cursor"), "cap": stats.SCHEMA_CAP}
    view = p.get("view", "design")
    table = stats.views(graph, [view])
    asked = {k: p.get(k) for k in ("class", "predicate", "datatype", "children", "projection", "view")}
    if "projection" in p:
        if p["projection"] not in stats.PROJECTIONS:
            raise QueryError("malformed_request", f"{p['projection']!r} is no projection")
        rows, keys = stats.projection(table, p["projection"], view)
        return graph.paged("schema", rows, keys, asked, **page)
    chosen = {"cls": p.get("class"), "predicate": p.get("predicate"), "datatype": p.get("datatype")}
    if "children" in p:
        parent = "datatype" if chosen["datatype"] else "property" if chosen["predicate"] else "class" if chosen["cls"] else "dataset"
        rows = stats.children(table, parent, p["children"], **chosen, view=view)
        names = [c for c in stats.COLUMNS if c in ("class", "predicate", "object_class", "datatype", "language")]
        return graph.paged("schema", rows.select("*", *(F.coalesce(c, F.lit("")).alias(f"_{c}") for c in names)), [f"_{c}" for c in names], asked, **page)
    if p.get("cursor"):
        raise QueryError("malformed_request", "a node has no pages")
    return stats.schema_node(table, **chosen, view=view)


def _verbalize(graph: Graph, p: dict) -> DataFrame:
    config = p["config"]
    target = p.get("target") or next(iter(config.targets))
    if "iri" in p:
        if len(p["iri"]) > ROOTS_CAP:
            raise QueryError("cap_exceeded", f"over {ROOTS_CAP} roots")
        return verbalize.verbalize(graph, config, target, p["iri"])
    if p.get("plan"):
        return verbalize.plan(verbalize.verbalize(graph, config, target))
    n = limited(p.get("n", 5), cap=ROOTS_CAP)
    drawn = graph.sample(p=f"<{RDF_TYPE}>", o=f"<{config.targets[target].cls}>", n=n, seed=p.get("seed", 0)).collect()  # n rows
    return verbalize.verbalize(graph, config, target, [f"<{r.s}>" for r in drawn])


_OPERATIONS = {
    "fragment": _fragment,
    "bindings": _bindings,
    "tpf": _tpf,
    "count": _count,
    "describe": lambda g, p: g.describe(p["iri"], p.get("direction", "both")),
    "sample": lambda g, p: g.sample(**_spo(p), n=limited(p.get("n"), cap=SAMPLE_CAP), seed=p.get("seed", 0)),
    "distinct": _distinct,
    "terms": _terms,
    "search": lambda g, p: search.search(g, p.get("q", ""), p.get("role"), p.get("predicate"), p.get("limit")),
    "labels": _labels,
    "graphs": lambda g, p: g.graph_page(p.get("limit"), p.get("cursor")),
    "schema": _schema,
    "void": lambda g, p: stats.as_void(stats.views(g)),
    "summary": lambda g, p: stats.summary(g),
    "verbalize": _verbalize,
}
