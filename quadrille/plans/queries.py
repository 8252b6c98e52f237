"""The registered queries: each operation over the whole mapped tables, with its DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms, texts
from quadrille.functions.terms import RDF_TYPE, RDFS_LABEL
from quadrille.operators import joins, keysets, labels, search, stats, verbalize
from quadrille.operators.graph import Graph
from quadrille.plans import service
from quadrille.plans.registry import register
from quadrille.sources import bundle, mapping, ntriples
from quadrille.sources.mapping import BASE, FULL, SKOS, UNNAMED

P, C = BASE + "p/", BASE + "c/"
PREFIXES = {"d": BASE, "p": P, "c": C, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "skos": SKOS, "rdf": terms.RDF, "xsd": mapping.XSD}
T = f"WITH t AS ({mapping.sql()})\n"
TFULL = f"WITH t AS ({mapping.sql(FULL)})\n"
M = f"WITH m AS ({mapping.membership_sql(FULL)})\n"
LEX = "regexp_extract(o, '(?s)^\"(.*)\"(?:@[A-Za-z0-9-]+|\\^\\^<[^<>\"]*>)?$', 1)"
TAG = "nullif(regexp_extract(o, '(?s)^\".*\"@([A-Za-z0-9-]+)$', 1), '')"
FRAGMENT = "CASE WHEN {x} LIKE '%#%' THEN regexp_extract({x}, '(?s)^.*#(.*)$', 1) WHEN {x} LIKE '%/%' THEN regexp_extract({x}, '(?s)^.*/(.*)$', 1) ELSE {x} END"
HUMAN = "trim(regexp_replace(regexp_replace(replace(replace({x}, '_', ' '), '-', ' '), '(\\p{{Ll}})(\\p{{Lu}})', '\\1 \\2', 'g'), '\\s+', ' ', 'g'))"


def core(spark: SparkSession, d: str) -> Graph:
    return Graph(mapping.triples(spark, d), prefixes=PREFIXES, **mapping.forms(spark, d))


def full(spark: SparkSession, d: str) -> Graph:
    return Graph(mapping.triples(spark, d, FULL), prefixes=PREFIXES, **mapping.forms(spark, d, FULL))


def quads(spark: SparkSession, d: str) -> Graph:
    marks = mapping.exploded(spark, d, FULL, graph=True, objects=False).select("p", "g")
    return Graph(mapping.triples(spark, d, FULL), mapping.triples(spark, d, FULL, graph=True), prefixes=PREFIXES, marks=marks)


def claims(spark: SparkSession, d: str) -> Graph:
    props, outer = mapping.propositions(spark, d)
    return Graph(mapping.triples(spark, d).union(outer), propositions=props, prefixes=PREFIXES)


# -- patterns: the eight shapes ------------------------------------------------------------------


@register("fragment_all", TFULL + "SELECT s, p, o FROM t")
def fragment_all(spark, d):
    return full(spark, d).fragment().rows


@register("fragment_p", T + f"SELECT s, o FROM t WHERE p = '{P}o_custkey'")
def fragment_p(spark, d):
    return core(spark, d).fragment(p="p:o_custkey").rows


@register("fragment_po", T + f"SELECT s FROM t WHERE p = '{P}o_orderstatus' AND o = '\"F\"'")
def fragment_po(spark, d):
    return core(spark, d).fragment(p="p:o_orderstatus", o='"F"').rows


@register("fragment_o", T + f"SELECT s, p FROM t WHERE o = '{BASE}nation/7'")
def fragment_o(spark, d):
    return core(spark, d).fragment(o="d:nation/7").rows


@register("fragment_s", T + f"SELECT p, o FROM t WHERE s = '{BASE}customer/7'")
def fragment_s(spark, d):
    return core(spark, d).fragment(s="d:customer/7").rows


@register("fragment_sp", T + f"SELECT o FROM t WHERE s = '{BASE}customer/7' AND p = '{P}c_nationkey'")
def fragment_sp(spark, d):
    return core(spark, d).fragment(s="d:customer/7", p="p:c_nationkey").rows


@register("fragment_so", T + f"SELECT p FROM t WHERE s = '{BASE}customer/7' AND o = '{C}Customer'")
def fragment_so(spark, d):
    return core(spark, d).fragment(s="d:customer/7", o="c:Customer").rows


@register("fragment_spo", T + f"SELECT s, p, o FROM t WHERE s = '{BASE}customer/7' AND p = '{RDF_TYPE}' AND o = '{C}Customer'")
def fragment_spo(spark, d):
    g = core(spark, d)
    return g.matching(g.triples, s="d:customer/7", p="rdf:type", o="c:Customer")


@register("count_p", TFULL + f"SELECT count(*) AS count FROM t WHERE p = '{P}l_partkey'")
def count_p(spark, d):
    return full(spark, d).count(p="p:l_partkey")


@register("count_all", TFULL + "SELECT count(*) AS count FROM t")
def count_all(spark, d):
    return full(spark, d).count()


_ORDER = "row_number() OVER (ORDER BY (p.s NOT IN (SELECT o FROM t WHERE o IS NOT NULL))::INT, p.s, p.p, (p.o NOT IN (SELECT s FROM t))::INT, p.o) AS pos"


_ORACLE_PAGE = T + f""", q AS (SELECT s, p, o FROM t WHERE p = '{P}c_nationkey'),
subjects AS (SELECT DISTINCT s FROM t), objects AS (SELECT DISTINCT o FROM t),
r AS (SELECT q.s, q.o, row_number() OVER (ORDER BY (subjects.s IS NULL)::INT, q.o, (objects.o IS NULL)::INT, q.s) - 1 AS ord
      FROM q LEFT JOIN subjects ON subjects.s = q.o LEFT JOIN objects ON objects.o = q.s)
SELECT ord, s, o FROM r WHERE ord >= 100 AND ord < 200"""


@register("page_p", _ORACLE_PAGE)
def page_p(spark, d):
    """The second page of 100, resumed by its cursor."""
    g = core(spark, d)
    first = g.fragment(p="p:c_nationkey", limit=100)
    return g.fragment(p="p:c_nationkey", limit=100, cursor=first.cursor).rows.withColumn("ord", F.col("ord") + 100)


def _bundle(spark: SparkSession, d: str) -> Graph:
    """The core graph, published and opened again; once for each session and folder of tables."""
    held = _BUNDLES.setdefault(id(spark), {})
    if d not in held:
        held[d] = f"{bundle.scratch(spark)}/bundle-{uuid.uuid4().hex}"
        bundle.publish(core(spark, d), held[d], bundle.Manifest("core", "1"))
    return bundle.open_bundle(spark, held[d])


_BUNDLES: dict[int, dict[str, str]] = {}


@register("bundle_page_p", _ORACLE_PAGE)
def bundle_page_p(spark, d):
    """page_p over an opened bundle, whose order comes from its table of terms."""
    g = _bundle(spark, d)
    first = g.fragment(p="p:c_nationkey", limit=100)
    return g.fragment(p="p:c_nationkey", limit=100, cursor=first.cursor).rows.withColumn("ord", F.col("ord") + 100)


@register("bundle_fragment_o", T + f"SELECT s, p FROM t WHERE o = '{BASE}nation/7'")
def bundle_fragment_o(spark, d):
    return _bundle(spark, d).fragment(o="d:nation/7").rows


# -- bindings ------------------------------------------------------------------------------------

_NAMES = ["n", "x"]
_ROWS = [["d:nation/1", None], ["d:nation/2", None], ["d:nation/1", "d:customer/7"], [None, "d:customer/9"], ["d:nothing", None]]
_B = f"""b(binding, n, x) AS (VALUES (0, '{BASE}nation/1', NULL), (1, '{BASE}nation/2', NULL), (2, '{BASE}nation/1', '{BASE}customer/7'), (3, NULL, '{BASE}customer/9'), (4, '{BASE}nothing', NULL)),
j AS (SELECT b.binding, t.s, t.p, t.o FROM b LEFT JOIN t ON t.p = '{P}c_nationkey' AND (b.n IS NULL OR b.n = t.o) AND (b.x IS NULL OR b.x = t.s))"""
_PATTERN = {"s": "?x", "p": "p:c_nationkey", "o": "?n"}


@register("bindings_fragment", T + f", {_B} SELECT binding, s, p, o FROM j WHERE s IS NOT NULL")
def bindings_fragment(spark, d):
    return core(spark, d).binding_fragment(_PATTERN, _NAMES, _ROWS)


@register("bindings_count", T + f", {_B} SELECT binding, count(s) AS count FROM j GROUP BY binding")
def bindings_count(spark, d):
    return core(spark, d).binding_count(_PATTERN, _NAMES, _ROWS)


@register("tpf_values", T + f", {_B} SELECT DISTINCT s, p, o FROM j WHERE s IS NOT NULL")
def tpf_values(spark, d):
    return core(spark, d).restricted(_PATTERN, _NAMES, _ROWS)


@register("distinct_bindings", T + f", {_B} SELECT o AS value, count(*) AS count, count(DISTINCT binding) AS bindings FROM j WHERE s IS NOT NULL GROUP BY o")
def distinct_bindings(spark, d):
    return core(spark, d).distinct("o", pattern=_PATTERN, names=_NAMES, rows=_ROWS)


@register("distinct_p", TFULL + "SELECT p AS value, count(*) AS count FROM t GROUP BY p")
def distinct_p(spark, d):
    return full(spark, d).distinct("p")


@register("distinct_p_o", TFULL + f"SELECT o AS value, count(*) AS count FROM t WHERE p = '{P}l_suppkey' GROUP BY o")
def distinct_p_o(spark, d):
    return full(spark, d).distinct("o", p="p:l_suppkey")


@register("distinct_type_s", TFULL + f"SELECT s AS value, count(*) AS count FROM t WHERE p = '{RDF_TYPE}' GROUP BY s")
def distinct_type_s(spark, d):
    return full(spark, d).distinct("s", p="rdf:type")


@register("distinct_o_p", T + f"SELECT p AS value, count(*) AS count FROM t WHERE o = '{BASE}nation/7' GROUP BY p")
def distinct_o_p(spark, d):
    return core(spark, d).distinct("p", o="d:nation/7")


# -- graphs --------------------------------------------------------------------------------------


@register("graphs", M + "SELECT g AS graph, count(*) AS count FROM m GROUP BY g")
def graphs(spark, d):
    return quads(spark, d).graphs()


@register("quads_all", M + f"SELECT s, o, g FROM m WHERE p = '{RDFS_LABEL}'")
def quads_all(spark, d):
    return quads(spark, d).fragment(p="rdfs:label", g="*").rows


@register("graph_named", M + f"SELECT s, p, o FROM m WHERE g = '{BASE}g/customer'")
def graph_named(spark, d):
    return quads(spark, d).fragment(g="d:g/customer").rows


@register("graph_unnamed_count", M + f"SELECT count(*) AS count FROM m WHERE g = '{UNNAMED}'")
def graph_unnamed_count(spark, d):
    return quads(spark, d).count(g="unnamed")


@register("graphs_of_triple", M + f"SELECT s, p, o, string_agg(g, ' ' ORDER BY g) AS graphs FROM m WHERE p = '{P}n_regionkey' GROUP BY s, p, o")
def graphs_of_triple(spark, d):
    return quads(spark, d).graphs_of().filter(F.col("p") == P + "n_regionkey").withColumn("graphs", F.array_join("graphs", " "))


# -- terms, describe, sample -----------------------------------------------------------------------

_ROLES = "(SELECT term, max(s) AS in_s, max(p) AS in_p, max(o) AS in_o FROM (SELECT s AS term, 1 AS s, 0 AS p, 0 AS o FROM t UNION ALL SELECT p, 0, 1, 0 FROM t UNION ALL SELECT o, 0, 0, 1 FROM t) GROUP BY term)"


@register("terms_sections", TFULL + f"SELECT term, CASE WHEN in_s + in_o = 2 THEN 'shared' WHEN in_s = 1 THEN 'subjects' WHEN in_o = 1 THEN 'objects' ELSE 'predicates' END AS section FROM {_ROLES}")
def terms_sections(spark, d):
    return full(spark, d).terms().select("term", "section")


@register("terms_prefix", TFULL + f"SELECT term, in_s = 1 AS in_s, in_p = 1 AS in_p, in_o = 1 AS in_o FROM {_ROLES} WHERE starts_with(term, '{BASE}nation/') ORDER BY term LIMIT 100")
def terms_prefix(spark, d):
    return full(spark, d).term_prefix(BASE + "nation/", limit=100)


@register("terms_count", TFULL + f"SELECT sum(in_s)::BIGINT AS subject, sum(in_p)::BIGINT AS predicate, sum(in_o)::BIGINT AS object, count(*) AS \"any\" FROM {_ROLES} WHERE starts_with(term, '{BASE}')")
def terms_count(spark, d):
    return full(spark, d).term_counts(BASE)


@register("describe", T + f"SELECT 'out' AS direction, s, p, o FROM t WHERE s = '{BASE}nation/7' UNION ALL SELECT 'in', s, p, o FROM t WHERE o = '{BASE}nation/7'")
def describe(spark, d):
    return core(spark, d).describe("d:nation/7")


@register("sample", T + f", q AS (SELECT s, p, o, sha256('7' || chr(9) || s || chr(9) || p || chr(9) || o) AS draw FROM t WHERE p = '{P}o_custkey' ORDER BY draw LIMIT 100) SELECT row_number() OVER (ORDER BY draw) - 1 AS ord, s, p, o FROM q")
def sample(spark, d):
    return core(spark, d).sample(p="p:o_custkey", n=100, seed=7)


@register("shared_terms", TFULL + "SELECT DISTINCT s AS shared FROM t WHERE s IN (SELECT o FROM t)")
def shared_terms(spark, d):
    return full(spark, d).shared


# -- labels, names, search -------------------------------------------------------------------------

_LABELS = f"""c AS (SELECT s, o, p, CASE WHEN p = '{RDFS_LABEL}' THEN 0 ELSE 1 END AS ord,
  CASE WHEN {TAG} IS NULL THEN 2 WHEN {TAG} = 'de' OR {TAG} LIKE 'de-%' THEN 0 WHEN {TAG} = 'en' OR {TAG} LIKE 'en-%' THEN 1 ELSE 3 END AS rank
  FROM t WHERE p IN ('{RDFS_LABEL}', '{SKOS}prefLabel') AND o LIKE '"%'),
best AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY rank, ord, o) AS rn FROM c)"""


@register("labels_preferred", T + f", {_LABELS} SELECT s AS node, {LEX} AS label, p AS source, {TAG} AS lang FROM best WHERE rn = 1")
def labels_preferred(spark, d):
    return labels.preferred(core(spark, d), langs=["de", "en"])


@register("labels_batch", T + f""", {_LABELS}, asked(ord, iri) AS (VALUES (0, '{BASE}nation/3'), (1, '{BASE}nothing'), (2, '{BASE}document/5'), (3, '{BASE}nation/3'))
SELECT asked.ord, iri, {LEX} AS label, p AS source, {TAG} AS lang FROM asked LEFT JOIN best ON s = iri AND rn = 1""")
def labels_batch(spark, d):
    return labels.resolve(core(spark, d), ["d:nation/3", "d:nothing", "d:document/5", "d:nation/3"], langs=["de", "en"])


@register("labels_hydrated", T + f""", {_LABELS}, l AS (SELECT s AS node, {LEX} AS label FROM best WHERE rn = 1)
SELECT t.s, t.p, t.o, a.label AS label_s, b.label AS label_p, c2.label AS label_o FROM t LEFT JOIN l a ON a.node = t.s LEFT JOIN l b ON b.node = t.p LEFT JOIN l c2 ON c2.node = t.o WHERE t.p = '{P}c_nationkey'""")
def labels_hydrated(spark, d):
    g = core(spark, d)
    return labels.hydrated(g, g.matching(g.triples, p="p:c_nationkey"), ["de", "en"])


@register("names_fallback", TFULL + f"SELECT DISTINCT p, {HUMAN.format(x=FRAGMENT.format(x='p'))} AS name FROM t")
def names_fallback(spark, d):
    g = full(spark, d)
    return g.predicates.select("p", texts.fallback_label(F.col("p")).alias("name"))


@register("term_parts", TFULL + f"""SELECT DISTINCT o AS term, {LEX} AS lex, {TAG} AS lang,
CASE WHEN {TAG} IS NOT NULL THEN '{terms.RDF_LANG}' ELSE coalesce(nullif(regexp_extract(o, '(?s)^".*"\\^\\^<([^<>"]*)>$', 1), ''), '{terms.XSD_STRING}') END AS datatype
FROM t WHERE o LIKE '"%'""")
def term_parts(spark, d):
    o = F.col("o")
    return full(spark, d).bag.filter(terms.is_literal(o)).select("o").distinct().select(o.alias("term"), terms.lexical(o).alias("lex"), terms.language(o).alias("lang"), terms.datatype(o).alias("datatype"))


_WORDS = "list_filter(regexp_split_to_array(lower(lex), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_STEM = "list_transform(words, lambda x: regexp_replace(x, '^(.{3,}?)(?:ing|ed|es|s)$', '\\1'))"
_HITS = f"""d AS (SELECT DISTINCT o, {LEX} AS lex FROM t WHERE o LIKE '"%'), w AS (SELECT o, {_WORDS} AS words FROM d),
n AS (SELECT o, words, len(words)::DOUBLE AS size, len(list_filter({_STEM}, lambda x: x = 'the'))::DOUBLE AS n0, len(list_filter({_STEM}, lambda x: x = 'thing'))::DOUBLE AS n1 FROM w),
c AS (SELECT count(*)::DOUBLE AS literals, avg(size) AS mean, sum((n0 > 0)::INT)::DOUBLE AS df0, sum((n1 > 0)::INT)::DOUBLE AS df1 FROM n),
h AS (SELECT o, CASE WHEN list_contains(words, 'the') AND list_contains(words, 'thing') THEN 'exact' ELSE 'normalized' END AS match_kind,
 round(ln(1.0 + (literals - df0 + 0.5) / (df0 + 0.5)) * n0 * 2.2 / (n0 + 1.2 * (0.25 + 0.75 * size / mean)) + ln(1.0 + (literals - df1 + 0.5) / (df1 + 0.5)) * n1 * 2.2 / (n1 + 1.2 * (0.25 + 0.75 * size / mean)), 6) AS score
 FROM n, c WHERE n0 > 0 AND n1 > 0)"""


@register("text_fragment", T + f", {_HITS} SELECT t.s, t.p, t.o, match_kind, score FROM t JOIN h ON h.o = t.o")
def text_fragment(spark, d):
    return search.statements(core(spark, d), "the thing")


@register("text_count", T + f", {_HITS} SELECT count(*) AS count FROM t JOIN h ON h.o = t.o")
def text_count(spark, d):
    return search.count(core(spark, d), "the thing")


_SEARCH_TOP = T + f""", {_HITS}, f AS (SELECT t.s, t.p, t.o, match_kind, score, row_number() OVER (PARTITION BY t.s ORDER BY match_kind, score DESC, t.o) AS rn FROM t JOIN h ON h.o = t.o)
SELECT s AS subject, p AS predicate, o AS literal, match_kind, score FROM f WHERE rn = 1 ORDER BY match_kind, score DESC, o, s LIMIT 10"""


@register("search_top", _SEARCH_TOP)
def search_top(spark, d):
    return search.search(core(spark, d), "the thing")


@register("bundle_search_top", _SEARCH_TOP)
def bundle_search_top(spark, d):
    """search_top over an opened bundle, by its inverted index."""
    return search.search(_bundle(spark, d), "the thing")


# -- statistics ------------------------------------------------------------------------------------

_DISTINCTS = "count(*) AS triples, count(DISTINCT s) AS distinct_subjects, count(DISTINCT o) AS distinct_objects"
_TYPES = f"y AS (SELECT DISTINCT s AS node, o AS class FROM t WHERE p = '{RDF_TYPE}')"
_RELATIONS = "SELECT a.class AS subject_class, t.p AS predicate, b.class AS object_class, count(*) AS triples FROM t JOIN y a ON a.node = t.s JOIN y b ON b.node = t.o GROUP BY ALL"


@register("void_totals", TFULL + f"SELECT {_DISTINCTS}, count(DISTINCT p) AS properties FROM t")
def void_totals(spark, d):
    return stats.totals(full(spark, d))


@register("void_property_partitions", TFULL + f"SELECT p AS predicate, {_DISTINCTS} FROM t GROUP BY p")
def void_property_partitions(spark, d):
    return stats.properties(full(spark, d))


@register("void_class_partitions", TFULL + f", {_TYPES} SELECT class, count(*) AS entities FROM y GROUP BY class")
def void_class_partitions(spark, d):
    return stats.classes(full(spark, d))


@register("void_class_properties", TFULL + f", {_TYPES} SELECT class, p AS predicate, {_DISTINCTS} FROM t JOIN y ON y.node = t.s GROUP BY class, p")
def void_class_properties(spark, d):
    return stats.class_properties(full(spark, d))


@register("void_class_relations", TFULL + f", {_TYPES} {_RELATIONS}")
def void_class_relations(spark, d):
    return stats.class_relations(full(spark, d))


@register("void_datatypes", TFULL + f""", {_TYPES} SELECT class, p AS predicate, CASE WHEN {TAG} IS NOT NULL THEN '{terms.RDF_LANG}' ELSE coalesce(nullif(regexp_extract(o, '(?s)^".*"\\^\\^<([^<>"]*)>$', 1), ''), '{terms.XSD_STRING}') END AS datatype, count(*) AS triples
FROM t JOIN y ON y.node = t.s WHERE o LIKE '"%' GROUP BY ALL""")
def void_datatypes(spark, d):
    return stats.datatypes(full(spark, d))


@register("void_languages", TFULL + f", {_TYPES} SELECT class, p AS predicate, {TAG} AS language, count(*) AS triples FROM t JOIN y ON y.node = t.s WHERE o LIKE '\"%' AND {TAG} IS NOT NULL GROUP BY ALL")
def void_languages(spark, d):
    return stats.languages(full(spark, d))


@register("void_graph_properties", M + f"SELECT g, p AS predicate, {_DISTINCTS} FROM m GROUP BY g, p")
def void_graph_properties(spark, d):
    return stats.properties(mapping.exploded(spark, d, FULL, graph=True), ["g"])


@register("schema_relations_page", TFULL + f", {_TYPES} {_RELATIONS} ORDER BY triples DESC, subject_class, predicate, object_class LIMIT 1000")
def schema_relations_page(spark, d):
    return stats.relations_page(full(spark, d))


@register("schema_children", TFULL + f", {_TYPES} SELECT p AS predicate, {_DISTINCTS} FROM t JOIN y ON y.node = t.s WHERE class = '{C}Customer' GROUP BY p")
def schema_children(spark, d):
    return stats.schema_children(stats.tidy(full(spark, d)), "class", "properties", cls=C + "Customer", limit=1000).select("predicate", "triples", "distinct_subjects", "distinct_objects")


@register("bundle_schema_children", T + f", {_TYPES} SELECT p AS predicate, {_DISTINCTS} FROM t JOIN y ON y.node = t.s WHERE class = '{C}Customer' GROUP BY p")
def bundle_schema_children(spark, d):
    """schema_children over an opened bundle, from its published statistics."""
    return service.request(_bundle(spark, d), "schema", **{"class": C + "Customer", "children": "properties", "limit": 1000}).select("predicate", "triples", "distinct_subjects", "distinct_objects")


@register("tpf_graph", M + f"SELECT DISTINCT s, p, o FROM m WHERE g = '{BASE}g/customer' AND p = '{P}c_nationkey' ORDER BY s LIMIT 10000")
def tpf_graph(spark, d):
    """A page of a pattern in a named graph, in explicit syntax, by subject."""
    return service.request(quads(spark, d), "tpf", predicate=P + "c_nationkey", graph=BASE + "g/customer", order="s", limit=10_000).select("s", "p", "o")


_SPACES = [(k, ns) for k, ns in sorted(PREFIXES.items(), key=lambda kv: (-len(kv[1]), kv[0]))]
_OWNER = "CASE " + " ".join(f"WHEN starts_with(term, '{ns}') THEN '{k}'" for k, ns in _SPACES) + " END"


@register("namespaces", TFULL + f", r AS (SELECT {_OWNER} AS prefix, in_s, in_p, in_o FROM {_ROLES} WHERE term NOT LIKE '\"%' AND term NOT LIKE '\\_:%' ESCAPE '\\') SELECT prefix, sum(in_s)::BIGINT AS subjects, sum(in_p)::BIGINT AS predicates, sum(in_o)::BIGINT AS objects FROM r GROUP BY prefix")
def namespaces(spark, d):
    return stats.namespaces(full(spark, d), PREFIXES).drop("namespace")


@register("summary", TFULL + f""", {_TYPES}, a AS (SELECT 'classes' AS section, class AS name, count(*) AS count FROM y GROUP BY class UNION ALL SELECT 'properties', p, count(*) FROM t GROUP BY p
UNION ALL SELECT 'relations', subject_class || ' ' || predicate || ' ' || object_class, triples FROM ({_RELATIONS})),
r AS (SELECT section, name, count, row_number() OVER (PARTITION BY section ORDER BY count DESC, name) - 1 AS ord FROM a)
SELECT section, ord, name, count FROM r WHERE ord < 10""")
def summary(spark, d):
    return stats.summary(full(spark, d))


# -- statement terms -------------------------------------------------------------------------------

_PROPS = f"WITH q AS ({mapping.PROPOSITION_SQL})\n"


@register("statement_fragment", _PROPS + f"SELECT DISTINCT '{BASE}assessment/' || CAST(doc_id AS VARCHAR) AS s, '{terms.RDF_REIFIES}' AS p, tt_id AS o, s AS tt_s, p AS tt_p, o AS tt_o, asserted FROM q")
def statement_fragment(spark, d):
    g = claims(spark, d)
    return g.decode(g.matching(g.triples, o="<<( ?s p:quality ?o )>>")).select("s", "p", "o", "tt_s", "tt_p", "tt_o", "asserted")


@register("statement_count", _PROPS + f"SELECT count(DISTINCT doc_id) AS count FROM q WHERE o = '\"0\"^^<{mapping.XSD}integer>'")
def statement_count(spark, d):
    return claims(spark, d).count(o='<<( ?s p:quality "0"^^xsd:integer )>>')


# -- text of nodes ---------------------------------------------------------------------------------

_CONFIG = verbalize.Config(
    {"customers": verbalize.Target(C + "Customer"), "orders": verbalize.Target(C + "Order", template=verbalize.Template("order of {customer}", {"customer": P + "o_custkey"}))},
)
_VERBALIZE = f"""n AS (SELECT s AS node, trim(regexp_replace({LEX}, '\\s+', ' ', 'g')) AS label FROM (SELECT s, o, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN p = '{RDFS_LABEL}' THEN 0 ELSE 1 END, o) AS rn FROM t WHERE p IN ('{RDFS_LABEL}', '{SKOS}prefLabel') AND o LIKE '"%') WHERE rn = 1),
k AS (SELECT s AS iri FROM t WHERE p = '{RDF_TYPE}' AND o = '{C}Customer'),
e AS (SELECT t.s, t.p, t.o, sha256(t.s || chr(9) || t.p || chr(9) || CASE WHEN t.o LIKE '"%' THEN {LEX.replace('(o,', '(t.o,')} ELSE t.o END) AS score FROM t JOIN k ON k.iri = t.s),
r AS (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY score, o) AS rn FROM e),
l AS (SELECT r.s, r.p, r.score, lower({HUMAN.format(x=FRAGMENT.format(x='r.p'))}) || ': ' || CASE WHEN r.o LIKE '"%' THEN trim(regexp_replace({LEX.replace('(o,', '(r.o,')}, '\\s+', ' ', 'g')) ELSE coalesce(n.label, {HUMAN.format(x=FRAGMENT.format(x='r.o'))}) END AS line FROM r LEFT JOIN n ON n.node = r.o WHERE rn <= 3)
SELECT k.iri, n.label, 'label: ' || n.label || chr(10) || string_agg(l.line, chr(10) ORDER BY l.p, l.score) AS text FROM k JOIN n ON n.node = k.iri JOIN l ON l.s = k.iri GROUP BY k.iri, n.label"""


@register("verbalize_customers", T + f", {_VERBALIZE}")
def verbalize_customers(spark, d):
    return verbalize.verbalize(core(spark, d), _CONFIG, "customers").select("iri", "label", "text")


@register("verbalize_plan", T + f", v AS (WITH {_VERBALIZE}) SELECT 'customers' AS target, count(*) AS members, sum(length(text))::BIGINT // count(*) AS mean_chars, max(length(text))::BIGINT AS max_chars FROM v")
def verbalize_plan(spark, d):
    return verbalize.plan(verbalize.verbalize(core(spark, d), _CONFIG, "customers")).select("target", "members", "mean_chars", F.col("max_chars").cast("long").alias("max_chars"))


@register("verbalize_orders_template", T + f""", n AS (SELECT s AS node, min({LEX}) AS label FROM t WHERE p = '{RDFS_LABEL}' AND s LIKE '{BASE}customer/%' GROUP BY s)
SELECT t.s AS iri, 'order of ' || n.label AS label FROM t JOIN n ON n.node = t.o WHERE t.p = '{P}o_custkey'""")
def verbalize_orders_template(spark, d):
    return verbalize.verbalize(core(spark, d), _CONFIG, "orders").select("iri", "label")


# -- sinks, key sets, joins ------------------------------------------------------------------------


@register("ntriples_lines", TFULL + """SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o LIKE '"%' THEN '"' || replace(replace(replace(replace(""" + LEX + """, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r') || '"' || regexp_extract(o, '(?s)^".*"((?:@[A-Za-z0-9-]+|\\^\\^<[^<>"]*>)?)$', 1) ELSE '<' || o || '>' END || ' .' AS value FROM t""")
def ntriples_lines(spark, d):
    return ntriples.lines(full(spark, d).whole)


@register("ntriples_round_trip", TFULL + "SELECT s, p, o FROM t")
def ntriples_round_trip(spark, d):
    """Lines written and parsed again."""
    return ntriples.parse_lines(ntriples.lines(full(spark, d).whole))[0].select("s", "p", "o")


@register("key_set_sections", TFULL + f"SELECT CASE WHEN in_s + in_o = 2 THEN 'shared' WHEN in_s = 1 THEN 'subjects' ELSE 'objects' END AS section, count(*) AS keys FROM {_ROLES} WHERE in_s + in_o > 0 GROUP BY ALL")
def key_set_sections(spark, d):
    return keysets.key_set(full(spark, d)).groupBy("section").agg(F.count_distinct("key").alias("keys"))


@register("overlap_terms", "SELECT DISTINCT o AS term FROM (" + mapping.sql(("customer", "nation")) + ") WHERE o IN (SELECT o FROM (" + mapping.sql(("supplier", "nation")) + ")) UNION SELECT DISTINCT s FROM (" + mapping.sql(("nation",)) + ")")
def overlap_terms(spark, d):
    a, b = (Graph(mapping.triples(spark, d, (t, "nation"))) for t in ("customer", "supplier"))
    return keysets.overlap(a, b)


@register("bgp_join", T + f"SELECT a.s AS \"order\", b.o AS nation, c.o AS region FROM t a JOIN t b ON b.s = a.o JOIN t c ON c.s = b.o WHERE a.p = '{P}o_custkey' AND b.p = '{P}c_nationkey' AND c.p = '{P}n_regionkey'")
def bgp_join(spark, d):
    return joins.basic_pattern(core(spark, d), [("?order", "p:o_custkey", "?customer"), ("?customer", "p:c_nationkey", "?nation"), ("?nation", "p:n_regionkey", "?region")]).select("order", "nation", "region")


@register("star_join", T + f"SELECT s, min(CASE WHEN p = '{P}c_nationkey' THEN o END) AS nation, min(CASE WHEN p = '{P}c_mktsegment' THEN o END) AS segment FROM t WHERE p IN ('{P}c_nationkey', '{P}c_mktsegment') GROUP BY s")
def star_join(spark, d):
    return joins.star(core(spark, d), {"nation": P + "c_nationkey", "segment": P + "c_mktsegment"})


@register("number_range", T + f"SELECT s, CAST({LEX} AS DECIMAL(38,6))::VARCHAR AS value FROM t WHERE p = '{P}o_totalprice' AND CAST({LEX} AS DECIMAL(38,6)) >= 100000 AND CAST({LEX} AS DECIMAL(38,6)) < 200000")
def number_range(spark, d):
    return joins.number_range(core(spark, d), "p:o_totalprice", "100000", "200000").withColumn("value", F.col("value").cast("string"))
