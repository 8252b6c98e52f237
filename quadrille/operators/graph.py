"""A graph as DataFrames, and the pattern operations on it.

Triples are distinct rows (s, p, o); memberships add a graph g; propositions hold statement terms.
Every operation is a declarative plan: equality filters reach the scan, counts are hash aggregates,
inline bindings are a broadcast side of bounded size (the cap on rows), and pages are
TakeOrderedAndProject over the role order. Nothing is collected but pages, whose size is capped.
"""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.functions import terms
from quadrille.functions.errors import BINDINGS_CAP, PAGE_CAP, SAMPLE_CAP, QueryError, limited
from quadrille.functions.terms import Term
from quadrille.sources.mapping import UNION, UNNAMED

#: The order of a pattern's rows, by which positions are bound.
ORDERS = {"": "spo", "s": "spo", "sp": "spo", "spo": "spo", "p": "pos", "po": "pos", "o": "ops", "so": "p"}
DEFAULT_ROLES = {
    "label": [terms.RDFS_LABEL, "http://www.w3.org/2004/02/skos/core#prefLabel"],
    "synonym": ["http://www.w3.org/2004/02/skos/core#altLabel"],
    "description": ["http://purl.org/dc/terms/description", "http://www.w3.org/2000/01/rdf-schema#comment"],
}


@dataclass
class Answer:
    """Rows of an operation. ``exact`` counts them by a plan of its own, without the page's limit."""

    rows: DataFrame
    total: DataFrame | None = None
    absent: list[tuple[str, str]] = field(default_factory=list)
    cursor: str | None = None
    complete: bool | None = None

    def exact(self) -> int:
        return self.total.first()[0]


def token(kind: str, request: dict, last: list) -> str:
    return base64.urlsafe_b64encode(json.dumps([kind, fingerprint(request), last]).encode()).decode()


def fingerprint(request: dict) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()[:16]


def resume(kind: str, request: dict, cursor: str) -> list:
    """The last key of a page, if the token belongs to this request."""
    try:
        got = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        if got[:2] == [kind, fingerprint(request)]:
            return got[2]
    except (ValueError, TypeError, IndexError):
        pass
    raise QueryError("stale_cursor", "the cursor is of another request or graph")


class Graph:
    """Triples, and what may be known of them besides.

    whole is another form of the triples, better for operations over all of them; so are, where they are known,
    bag (rows may repeat), typed (s, p, o, class, first: with the one class that a subject has; first is true in one
    row of each (s, p)), marks (p and g alone, a row for each triple or, if there are graphs, membership), subjects
    (s, class) and predicates (p), each once. copies are sorted by subject ("s") or object ("o", where a long object has its digest); published holds
    tables made from the triples: terms, stats, postings (see quadrille.sources.bundle).
    """

    def __init__(
        self,
        triples: DataFrame,
        memberships: DataFrame | None = None,
        propositions: DataFrame | None = None,
        prefixes: dict[str, str] | None = None,
        roles: dict[str, list[str]] | None = None,
        identity: str = "",
        whole: DataFrame | None = None,
        copies: dict[str, DataFrame] | None = None,
        published: dict[str, DataFrame] | None = None,
        bag: DataFrame | None = None,
        typed: DataFrame | None = None,
        marks: DataFrame | None = None,
        subjects: DataFrame | None = None,
        predicates: DataFrame | None = None,
    ):
        self.triples = triples.select("s", "p", "o")
        self.whole = self.triples if whole is None else whole.select("s", "p", "o")
        self.bag = self.whole if bag is None else bag.select("s", "p", "o")
        self.typed, self.marks, self._subjects, self._predicates = typed, marks, subjects, predicates
        self.copies = copies or {}
        self.tables = published or {}
        self.memberships = memberships.select("s", "p", "o", "g") if memberships is not None else self.triples.withColumn("g", F.lit(UNNAMED))
        self.quads_given = memberships is not None
        self.propositions = propositions
        self.prefixes = prefixes or {}
        self.roles = {**DEFAULT_ROLES, **(roles or {})}  # a declared role replaces the default
        self.identity = identity
        self.spark = triples.sparkSession

    # -- terms ---------------------------------------------------------------------------------

    @property
    def subjects(self) -> DataFrame:
        """(s): each subject once."""
        return self.whole.select("s").distinct() if self._subjects is None else self._subjects.select("s")

    @property
    def predicates(self) -> DataFrame:
        """(p): each predicate once."""
        return self.bag.select("p").distinct() if self._predicates is None else self._predicates

    def _roles(self, roles: str = "spo", kept=None) -> DataFrame:
        """(term, in_s, in_p, in_o): each term that is kept once, with those of the roles it has."""
        of = {"s": lambda: self.subjects, "p": lambda: self.predicates, "o": lambda: self.bag.select("o")}
        one = [of[c]().select(F.col(c).alias("term"), *(F.lit(c == x).alias(f"in_{x}") for x in "spo")) for c in roles]
        # the filter is below the aggregate, so it reaches the scan
        one = one if kept is None else [x.filter(kept(F.col("term"))) for x in one]
        return reduce(DataFrame.union, one).groupBy("term").agg(*(F.max(f"in_{x}").alias(f"in_{x}") for x in "spo"))

    @cached_property
    def shared(self) -> DataFrame:
        """Terms that are both subject and object: they come first in either role's order."""
        if "terms" in self.tables:
            return self.tables["terms"].filter("section = 'shared'").select(F.col("term").alias("shared"))
        return self._roles("so", lambda t: ~terms.is_literal(t)).filter("in_s AND in_o").select(F.col("term").alias("shared"))

    def _shared_among(self, found: DataFrame) -> DataFrame:
        """(term): those of the terms, all of one role, that have the other role too."""
        if "terms" in self.tables:
            return self.shared.select(F.col("shared").alias("term"))
        ((c, other),) = [(c, {"s": "o", "o": "s"}[c]) for c in found.columns]
        wanted = found.select(F.col(c).alias("term")).distinct()
        rows = self.bag.select(F.col(other).alias("term")).filter(~terms.is_literal(F.col("term")))  # a literal has one role
        return rows.join(wanted, "term", "left_semi").distinct()

    def terms(self) -> DataFrame:
        """(term, in_s, in_p, in_o, section)."""
        if "terms" in self.tables:
            return self.tables["terms"].select("term", "in_s", "in_p", "in_o", "section")
        section = F.when(F.col("in_s") & F.col("in_o"), "shared").when(F.col("in_s"), "subjects").when(F.col("in_o"), "objects").otherwise("predicates")
        return self._roles().withColumn("section", section)

    def term_prefix(self, prefix: str, role: str = "any", limit: int | None = None, after: str | None = None) -> DataFrame:
        """Terms whose stored form begins with prefix, in plain order, behind the term after."""
        if prefix.startswith("<"):
            raise QueryError("bad_term_syntax", "a prefix is of the stored form, which has no angle brackets")
        n = limited(limit)
        out = self._with_prefix(prefix, role)
        if after is not None:
            out = out.filter(F.col("term") > after)
        return out.orderBy("term").limit(n)

    def term_page(self, prefix: str, role: str = "any", limit: int | None = None, cursor: str | None = None) -> Answer:
        """One page of term_prefix, and a cursor."""
        self.term_prefix(prefix, role, limit)  # refused as there
        return self.paged("terms", self._with_prefix(prefix, role), ["term"], {"prefix": prefix, "role": role}, limit, cursor)

    def _with_prefix(self, prefix: str, role: str) -> DataFrame:
        if role not in ("any", "subject", "predicate", "object"):
            raise QueryError("malformed_request", f"{role!r} is no role")
        if "terms" in self.tables:
            own = self.tables["terms"].filter(F.col("term").startswith(prefix)).select("term", "in_s", "in_p", "in_o")
            return own if role == "any" else own.filter(f"in_{role[0]}").select("term", *((F.col(f"in_{x}") if x == role[0] else F.lit(False)).alias(f"in_{x}") for x in "spo"))
        return self._roles("spo" if role == "any" else role[0], lambda t: t.startswith(prefix))

    def term_counts(self, prefix: str) -> DataFrame:
        """(subject, predicate, object, any): terms under a prefix; any counts a term once."""
        own = self._with_prefix(prefix, "any")
        n = lambda c: F.count_if(F.col(c))
        return own.agg(n("in_s").alias("subject"), n("in_p").alias("predicate"), n("in_o").alias("object"), F.count(F.lit(1)).alias("any"))

    def parse(self, value: str | Term | None) -> Term | None:
        return value if value is None or isinstance(value, Term) else terms.parse(value, self.prefixes, variables=True)

    # -- scopes ----------------------------------------------------------------------------------

    def scope(self, g: str | None) -> tuple[DataFrame, bool]:
        """(rows, whether they have a graph column) for union, unnamed, a named graph or "*"."""
        if self.is_union(g):
            return self.triples, False
        if g == "*":
            return self.memberships, True
        name = UNNAMED if g in ("unnamed", UNNAMED) else self.parse(g).stored()
        return self.memberships.filter(F.col("g") == name).select("s", "p", "o"), False

    @staticmethod
    def is_union(g: str | None) -> bool:
        return g is None or g == "union" or g == UNION

    def found(self, s=None, p=None, o=None, g: str | None = None) -> tuple[DataFrame, bool]:
        """(the rows of a pattern in a scope, whether they have a graph column), from the copy that suits what is bound."""
        rows, quads = self.scope(g)
        if self.is_union(g):
            bound = [t and t.kind not in ("variable", "triple") for t in map(self.parse, (s, o))]
            if bound[1] and not bound[0] and "o" in self.copies:
                t = self.parse(o)
                own = self.copies["o"] if t.kind == "blank" else self.copies["o"].filter(F.col("o") == terms.brief(F.lit(t.stored()))).withColumn("o", F.lit(t.stored()))
                return self.matching(own, s, p, o), quads
            rows = self.copies.get("s" if bound[0] else "p", rows)
            if s is None and p is None and o is None:
                rows = self.whole
        return self.matching(rows, s, p, o), quads

    def published(self, rows: DataFrame) -> DataFrame:
        """rows with blank nodes under IRIs that requests can name."""
        return rows.select(*(terms.skolemized(F.col(c), self.identity).alias(c) if c in ("s", "o") else F.col(c) for c in rows.columns))

    def addressed(self) -> "Graph":
        """This graph with its blank nodes under their published IRIs."""
        return Graph(self.published(self.triples), self.published(self.memberships) if self.quads_given else None, self.propositions, self.prefixes, self.roles, self.identity)

    def graphs(self) -> DataFrame:
        """(graph, count): the unnamed graph first, if it has triples, then names in order."""
        rows = self.marks if self.quads_given and self.marks is not None else self.memberships
        counts = rows.groupBy(F.col("g").alias("graph")).agg(F.count(F.lit(1)).alias("count"))
        return counts.withColumn("unnamed", F.col("graph") == UNNAMED).orderBy(F.desc("unnamed"), "graph").drop("unnamed")

    def graph_page(self, limit: int | None = None, cursor: str | None = None) -> Answer:
        """One page of graphs, and a cursor."""
        return self.paged("graphs", self.graphs().withColumn("_n", (F.col("graph") != UNNAMED).cast("int")), ["_n", "graph"], {}, limit, cursor)

    def graphs_of(self) -> DataFrame:
        """(s, p, o, graphs): each triple with the graphs it is in."""
        return self.memberships.groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("g")).alias("graphs"))

    # -- patterns --------------------------------------------------------------------------------

    def condition(self, s=None, p=None, o=None) -> tuple[Column | None, dict[str, Term]]:
        """The filter of the bound positions, and the positions bound to statement patterns."""
        out, statements = None, {}
        for name, value in (("s", s), ("p", p), ("o", o)):
            t = self.parse(value)
            if t is None or t.kind == "variable":
                continue
            if t.kind == "triple":
                if name != "o":
                    raise QueryError("bad_term_syntax", "a statement term stands in the object's place")
                statements[name] = t
                continue
            if t.kind == "blank":
                c = F.lit(False)  # a blank node's label addresses nothing
            else:
                c = F.col(name) == t.stored()
            out = c if out is None else out & c
        return out, statements

    def matching(self, rows: DataFrame, s=None, p=None, o=None) -> DataFrame:
        cond, statements = self.condition(s, p, o)
        if cond is not None:
            rows = rows.filter(cond)
        for t in statements.values():
            rows = rows.join(self.statements(t).select(F.col("tt_id").alias("o")), "o", "left_semi")
        return rows

    def statements(self, pattern: Term) -> DataFrame:
        """Propositions that a statement pattern matches; nested patterns are joined by id."""
        if self.propositions is None:
            raise QueryError("not_found", "the graph has no statement terms")
        names = [x.value for x in pattern.parts if x.kind == "variable" and x.value]
        if len(names) != len(set(names)):
            raise QueryError("unsupported", "a variable stands twice in a statement pattern")
        out = self.propositions
        for c, part in zip("spo", pattern.parts):
            if part.kind == "triple":
                out = out.join(self.statements(part).select(F.col("tt_id").alias(c)), c, "left_semi")
            elif part.kind != "variable":
                out = out.filter(F.col(c) == part.stored())
        return out

    def decode(self, rows: DataFrame) -> DataFrame:
        """rows with the parts (tt_s, tt_p, tt_o, asserted) of objects that are statement terms."""
        own = self.propositions.select(F.col("tt_id").alias("o"), F.col("s").alias("tt_s"), F.col("p").alias("tt_p"), F.col("o").alias("tt_o"), "asserted")
        return rows.join(own, "o", "left")

    @staticmethod
    def shape(**bound) -> str:
        return "".join(k for k in "spo" if bound.get(k) is not None)

    def order_keys(self, rows: DataFrame, shape: str, graph: bool) -> tuple[DataFrame, list[str]]:
        """Columns that sort rows in the pattern's order: shared terms come before a role's own."""
        keys, found = [], rows
        # terms of the matching rows alone are looked up, each in the one role that it may have besides
        for c in ORDERS[shape]:
            if c != "p":
                also = self._shared_among(found.select(c)).select(F.col("term").alias(c), F.lit(0).alias(f"_{c}"))
                rows = rows.join(also, c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", F.lit(1)))
                keys.append(f"_{c}")
            keys.append(c)
        if graph:
            rows = rows.withColumn("_g", F.when(F.col("g") == UNNAMED, 0).otherwise(1))
            keys += ["_g", "g"]
        return rows, keys

    def paged(self, kind: str, rows: DataFrame, keys: list[str], request: dict, limit: int | None, cursor: str | None, default: int | None = None, cap: int = PAGE_CAP) -> Answer:
        """One page of rows by keys (which hold no null and tell rows apart), a cursor, and whether it is the last.

        A key with "-" before it descends and is a number. Columns that begin with "_" order rows and are not shown.
        The cursor belongs to this graph and request.
        """
        n = limited(limit, *([default] if default else []), cap=cap)
        request = {**request, "identity": self.identity}
        sort = [(-F.col(k[1:]) if k[0] == "-" else F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
        names = [f"_k{i}" for i in range(len(keys))]
        sorted_ = rows.select("*", *sort)
        if cursor:
            last = resume(kind, request, cursor)
            if len(last) != len(keys):
                raise QueryError("stale_cursor", "the cursor is of another order")
            sorted_ = sorted_.filter(F.struct(*names) > F.struct(*(F.lit(x).cast(sorted_.schema[k].dataType).alias(k) for x, k in zip(last, names))))
        page = sorted_.orderBy(*names).limit(n + 1).collect()  # n is capped
        more = len(page) > n
        page = page[:n]
        shown = [f for f in rows.schema.fields if not f.name.startswith("_")]
        schema = T.StructType([T.StructField("ord", T.LongType()), *shown])
        out = self.spark.createDataFrame([(i, *(r[f.name] for f in shown)) for i, r in enumerate(page)], schema)
        return Answer(out, rows.agg(F.count(F.lit(1)).alias("count")), [], token(kind, request, [page[-1][k] for k in names]) if more else None, not more)

    def fragment(self, s=None, p=None, o=None, g: str | None = None, limit: int | None = None, cursor: str | None = None) -> Answer:
        """All rows of a pattern, or with a limit one page of them in order. An empty page says which terms are absent."""
        found, quads = self.found(s, p, o, g)
        shape = self.shape(s=s, p=p, o=o)
        shown = [c for c in "spo" if c not in shape or c == "o" and "o" in self.condition(s, p, o)[1]] + ["g"] * quads
        if limit is None and cursor is None:
            return Answer(found.select(*shown) if shown else found, found.agg(F.count(F.lit(1)).alias("count")))
        sorted_, keys = self.order_keys(found, shape, quads)
        hidden = [F.col(c).alias(f"_h{c}") for c in "spo" if c not in shown]
        renamed = [f"_h{k}" if k in "spo" and k not in shown else k for k in keys]
        out = self.paged("fragment", sorted_.select(*shown, *hidden, *(k for k in keys if k.startswith("_"))), renamed, {"s": s, "p": p, "o": o, "g": g}, limit, cursor)
        out.total = found.agg(F.count(F.lit(1)).alias("count"))
        if out.complete and not cursor and out.rows.isEmpty():
            out.absent = self.absent(s, p, o)
        return out

    def ordered(self, s=None, p=None, o=None, g: str | None = None, limit: int = PAGE_CAP) -> DataFrame:
        """(s, p, o[, g]) of the first rows of a pattern in its order, as a plan."""
        found, quads = self.found(s, p, o, g)
        sorted_, keys = self.order_keys(found, self.shape(s=s, p=p, o=o), quads)
        return sorted_.orderBy(*keys).limit(limited(limit)).select("s", "p", "o", *(["g"] if quads else []))

    def _marked(self, s, p, o, g: str | None) -> bool:
        """Whether the pattern is all triples of a graph of which there are marks."""
        return self.marks is not None and not self.quads_given and self.is_union(g) and s is None and p is None and o is None

    def count(self, s=None, p=None, o=None, g: str | None = None) -> DataFrame:
        return (self.marks if self._marked(s, p, o, g) else self.found(s, p, o, g)[0]).agg(F.count(F.lit(1)).alias("count"))

    def absent(self, s=None, p=None, o=None) -> list[tuple[str, str]]:
        """(position, reason) of bound terms that the graph does not hold there, by one job."""
        out, asked = [], {}
        for name, value in (("s", s), ("p", p), ("o", o)):
            t = self.parse(value)
            if t is None or t.kind in ("variable", "triple"):
                continue
            if t.kind == "blank":
                out.append((name, "blank nodes are not addressed by label"))
            else:
                asked[name] = F.col(name) == t.stored()
        if asked:
            held = self.triples.filter(reduce(lambda a, b: a | b, asked.values())).agg(*(F.count_if(c).alias(n) for n, c in asked.items())).first()
            out += [(n, "not held in this position") for n in asked if not held[n]]
        return sorted(out, key=lambda x: "spo".index(x[0]))

    # -- bindings --------------------------------------------------------------------------------

    def bindings(self, names: list[str], rows: list[list[str | None]]) -> DataFrame:
        """(binding, variables...) of an inline table; None is unbound. At most BINDINGS_CAP rows."""
        if len(rows) > BINDINGS_CAP:
            raise QueryError("cap_exceeded", f"{len(rows)} rows of bindings are over the cap of {BINDINGS_CAP}")
        if len(set(names)) != len(names) or any(len(r) != len(names) for r in rows):
            raise QueryError("malformed_request", "a table has distinct variables and full rows")
        stored = [[i, *(None if v is None else self._stored(v) for v in r)] for i, r in enumerate(rows)]
        return self.spark.createDataFrame([tuple(r) for r in stored], ", ".join(["binding int", *(f"`v_{n}` string" for n in names)]))

    def _stored(self, value: str) -> str:
        t = self.parse(value)
        return "\x00blank" if t.kind == "blank" else t.stored()

    def bound(self, pattern: dict[str, str | None], names: list[str], table: DataFrame, how: str = "inner", g: str | None = None) -> DataFrame:
        """The pattern's rows under each binding. pattern: position to ?variable, term or None."""
        variables = {c: v[1:] for c, v in pattern.items() if v and v.startswith("?")}
        if len(set(variables.values())) != len(variables):
            twice = [v for v in variables.values() if list(variables.values()).count(v) > 1]
            if any(v not in names for v in twice) or not table.filter(reduce(lambda a, b: a | b, [F.col(f"v_{v}").isNull() for v in twice])).isEmpty():
                raise QueryError("unsupported", "a variable that stands twice is bound in every row")
        missing = [n for n in names if n not in variables.values()]
        if missing:
            raise QueryError("malformed_request", f"the pattern lacks the variables {missing}")
        rest = {c: v for c, v in pattern.items() if v and not v.startswith("?")}
        rows = self.found(**rest, g=g)[0]
        own = [(c, f"v_{v}") for c, v in variables.items() if v in names]
        nulls = table.select(*(F.count_if(F.col(b).isNull()).alias(b) for _, b in own)).first() if own else {}
        cond = None
        for c, b in own:
            one = F.col(b) == F.col(c) if not nulls[b] else F.col(b).isNull() | (F.col(b) == F.col(c))
            cond = one if cond is None else cond & one
        small = F.broadcast(table)  # BINDINGS_CAP rows at most
        if how == "semi":
            return rows.join(small, cond if cond is not None else F.lit(True), "left_semi")
        if how == "left":
            return table.join(rows, cond if cond is not None else F.lit(True), "left")
        return rows.join(small, cond if cond is not None else F.lit(True))

    def binding_fragment(self, pattern, names, rows, g: str | None = None) -> DataFrame:
        """A bag: (binding, s, p, o) for every row of the table and every triple it matches."""
        return self.bound(pattern, names, self.bindings(names, rows), g=g).select("binding", "s", "p", "o")

    def binding_page(self, pattern, names, rows, g: str | None = None, limit: int | None = None, cursor: str | None = None, distinct: bool = False) -> Answer:
        """One page of binding_fragment by input row and then the pattern's order; distinct: of restricted, in the pattern's order."""
        found = self.restricted(pattern, names, rows, g) if distinct else self.binding_fragment(pattern, names, rows, g)
        shape = self.shape(**{c: v for c, v in pattern.items() if v and not v.startswith("?")})
        sorted_, keys = self.order_keys(found, shape, False)
        rest = [c for c in "spo" if c not in keys]
        return self.paged("bindings", sorted_, [*([] if distinct else ["binding"]), *keys, *rest], {"pattern": pattern, "names": names, "rows": rows, "g": g, "distinct": distinct}, limit, cursor)

    def binding_count(self, pattern, names, rows, g: str | None = None) -> DataFrame:
        """(binding, count) for every row of the table, zeros kept."""
        table = self.bindings(names, rows)
        found = self.bound(pattern, names, table, g=g).groupBy("binding").agg(F.count(F.lit(1)).alias("n"))
        return table.select("binding").join(found, "binding", "left").select("binding", F.coalesce("n", F.lit(0)).cast("long").alias("count"))

    def restricted(self, pattern, names, rows, g: str | None = None) -> DataFrame:
        """A set: the triples that any row of the table matches."""
        return self.bound(pattern, names, self.bindings(names, rows), "semi", g).select("s", "p", "o")

    def distinct(self, group_by: str, s=None, p=None, o=None, g: str | None = None, pattern=None, names=None, rows=None) -> DataFrame:
        """(value, count[, bindings]): the values of one position, and how many rows have each."""
        if group_by not in ("s", "p", "o"):
            raise QueryError("malformed_request", "group_by names s, p or o")
        if names is None:
            found = self.marks if group_by == "p" and self._marked(s, p, o, g) else self.found(s, p, o, g)[0]
            return found.groupBy(F.col(group_by).alias("value")).agg(F.count(F.lit(1)).alias("count"))
        found = self.bound(pattern, names, self.bindings(names, rows), g=g)
        return found.groupBy(F.col(group_by).alias("value")).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("binding").alias("bindings"))

    def distinct_page(self, group_by: str, limit: int | None = None, cursor: str | None = None, **pattern) -> Answer:
        """One page of distinct in the values' order: shared terms first, then plain order."""
        found = self.distinct(group_by, **pattern)
        keys = ["value"]
        if group_by != "p":
            also = self._shared_among(found.select(F.col("value").alias(group_by))).select(F.col("term").alias("value"), F.lit(0).alias("_shared"))
            found, keys = found.join(also, "value", "left").withColumn("_shared", F.coalesce("_shared", F.lit(1))), ["_shared", "value"]
        return self.paged("distinct", found, keys, {"group_by": group_by, **pattern}, limit, cursor)

    # -- describe and sample -----------------------------------------------------------------------

    def describe(self, node: str | Term, direction: str = "both") -> DataFrame:
        """A bag (direction, s, p, o): edges from the node, then edges to it."""
        if direction not in ("out", "in", "both"):
            raise QueryError("malformed_request", f"{direction!r} is no direction")
        t = self.parse(node)
        parts = []
        for way, c in (("out", "s"), ("in", "o")):
            if direction in (way, "both"):
                parts.append(self.found(**{c: t})[0].select(F.lit(way).alias("direction"), "s", "p", "o"))
        return reduce(DataFrame.union, parts)

    def sample(self, s=None, p=None, o=None, n: int = 100, seed: int = 0) -> DataFrame:
        """(ord, s, p, o) of n distinct members of a pattern: those with the least SHA-256 of the seed and the row.

        Every member has the same chance, a seed always draws the same rows, and a larger n adds to those of a
        smaller one. Each task keeps n rows; nothing is sorted or numbered as a whole.
        """
        n = limited(n, cap=SAMPLE_CAP)
        if self.condition(s, p, o)[1]:
            raise QueryError("unsupported", "a statement pattern is not sampled")
        draw = F.sha2(F.concat_ws("\t", F.lit(str(seed)), "s", "p", "o"), 256)
        drawn = self.found(s, p, o)[0].select(draw.alias("_draw"), "s", "p", "o").orderBy("_draw").limit(n)
        ranked = drawn.agg(F.array_sort(F.collect_list(F.struct("_draw", "s", "p", "o"))).alias("x"))  # n rows
        return ranked.select(F.posexplode("x").alias("ord", "x")).select(F.col("ord").cast("long").alias("ord"), "x.s", "x.p", "x.o")
