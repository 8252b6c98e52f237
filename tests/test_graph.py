import itertools

import pytest
from pyspark.sql import functions as F

from quadrille.functions.errors import QueryError
from quadrille.operators import joins, keysets, labels, search, stats, verbalize
from quadrille.operators.graph import Graph
from quadrille.sources import bundle, ntriples
from quadrille.sources.mapping import UNNAMED
from quadrille.streaming.ingest import ingest

X = "http://x.test/"
PRE = {"x": X, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#"}
#: ann is linked to itself and from bob; some terms are shared, some in one role only.
LINES = f"""
<{X}ann> <{X}name> "Ann" .
<{X}ann> <{X}label> "Ann"@en .
<{X}ann> <{X}likes> <{X}bob> .
<{X}ann> <{X}likes> <{X}cat> .
<{X}ann> <{X}self> <{X}ann> .
<{X}bob> <{X}name> "Bob" .
<{X}bob> <{X}likes> <{X}ann> .
<{X}cat> <{X}name> "Cat" .
<{X}cat> <{X}age> "31"^^<http://www.w3.org/2001/XMLSchema#integer> .
_:n1 <{X}note> "a blank subject" .
""".strip().split("\n")


def loaded(spark, lines, **more):
    m, props = ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    m, props = m.cache(), props.cache()
    named = any(r.g != UNNAMED for r in m.select("g").distinct().collect())
    return Graph(m.select("s", "p", "o").distinct(), m if named else None, props if not props.isEmpty() else None, PRE, **more)


@pytest.fixture(scope="module")
def graph(spark):
    return loaded(spark, LINES)


def order(rows, shape, subjects, objects):
    key = {"s": lambda t: (t not in objects, t), "p": lambda t: (False, t), "o": lambda t: (t not in subjects, t)}
    how = {"": "spo", "s": "spo", "sp": "spo", "spo": "spo", "p": "pos", "po": "pos", "o": "ops", "so": "p"}[shape]
    return sorted(rows, key=lambda r: [key[c](r["spo".index(c)]) for c in how])


def test_all_shapes_in_their_order_and_in_pages(graph):
    rows = [tuple(r) for r in graph.triples.collect()]
    subjects, objects = {r[0] for r in rows}, {r[2] for r in rows}
    picked = {"s": X + "ann", "p": X + "likes", "o": X + "ann"}
    for n in range(4):
        for shape in itertools.combinations("spo", n):
            bound = {c: f"<{picked[c]}>" for c in shape}
            want = order([r for r in rows if all(r["spo".index(c)] == picked[c] for c in shape)], "".join(shape), subjects, objects)
            assert [tuple(r) for r in graph.ordered(**bound).collect()] == want
            assert graph.count(**bound).first()[0] == len(want)
    for size in (1, 3, 100):
        got, cursor = [], None
        while True:
            page = graph.fragment(p="x:likes", limit=size, cursor=cursor)
            got += [(r.s, r.o) for r in page.rows.orderBy("ord").collect()]
            assert page.complete == (page.cursor is None)
            cursor = page.cursor
            if not cursor:
                break
        assert got == [(r[0], r[2]) for r in order([r for r in rows if r[1] == X + "likes"], "p", subjects, objects)]


def test_cursors_are_of_one_request(graph):
    cursor = graph.fragment(p="x:likes", limit=1).cursor
    for bad in (cursor, "no token"):
        with pytest.raises(QueryError) as e:
            graph.fragment(p="x:name", limit=1, cursor=bad)
        assert e.value.code == "stale_cursor"


def test_absent_terms_are_named(graph):
    assert graph.absent(s="x:nobody", p="x:likes", o="_:n1") == [("s", "not held in this position"), ("o", "blank nodes are not addressed by label")]
    assert graph.fragment(s="_:n1").rows.collect() == []


def test_graph_scopes(spark):
    a, b, c, d, x, y, z = (f"<{X}{k}>" for k in "abcdxyz")
    g = loaded(spark, [f"{a} {b} {c} .", f"{a} {b} {c} <{X}g1> .", f"{a} {b} {d} .", f"{x} {y} {z} <{X}g1> .", f"{x} {y} {z} <{X}g2> ."])
    counts = {k: g.count(g=k).first()[0] for k in (None, "x:g1", "x:g2", "unnamed", "*")}
    assert counts == {None: 3, "x:g1": 2, "x:g2": 1, "unnamed": 2, "*": 5}
    assert [g.count(p="x:y", g=k).first()[0] for k in ("x:g1", "unnamed", "*")] == [1, 0, 2]
    assert [tuple(r) for r in g.graphs().collect()] == [(UNNAMED, 2), (X + "g1", 2), (X + "g2", 1)]
    assert [r.g for r in g.ordered(p="x:b", o="x:c", g="*").collect()] == [UNNAMED, X + "g1"]
    assert {tuple(r.graphs) for r in g.graphs_of().collect()} == {(X + "g1", UNNAMED), (UNNAMED,), (X + "g1", X + "g2")}


def test_bindings(graph):
    pattern, names = {"s": "?x", "p": "x:name", "o": "?n"}, ["x"]
    rows = [["x:cat"], ["x:nobody"], ["x:ann"], ['"Ann"'], ["x:cat"]]
    assert sorted((r.binding, r.s) for r in graph.binding_fragment(pattern, names, rows).collect()) == [(0, X + "cat"), (2, X + "ann"), (4, X + "cat")]
    assert sorted(map(tuple, graph.binding_count(pattern, names, rows).collect())) == [(0, 1), (1, 0), (2, 1), (3, 0), (4, 1)]
    assert sorted(r.s for r in graph.restricted(pattern, names, rows).collect()) == [X + "ann", X + "cat"]
    assert sorted(map(tuple, graph.distinct("s", pattern=pattern, names=names, rows=rows).collect())) == [(X + "ann", 1, 1), (X + "cat", 2, 2)]
    free = graph.binding_fragment(pattern, ["x", "n"], [[None, '"Bob"'], ["x:ann", None], [None, None]]).collect()
    assert sorted(r.binding for r in free) == [0, 1, 2, 2, 2]
    same = {"s": "?x", "p": None, "o": "?x"}
    assert [r.p for r in graph.binding_fragment(same, ["x"], [["x:ann"], ["x:bob"]]).collect()] == [X + "self"]
    for bad in (lambda: graph.binding_fragment(same, [], [[]]), lambda: graph.binding_fragment(same, ["x"], [[None]]), lambda: graph.binding_fragment(pattern, ["q"], [["x:a"]]), lambda: graph.bindings(["a"], [["x:a"]] * 1001)):
        with pytest.raises(QueryError):
            bad().collect()


def test_distinct_is_the_grouping_of_the_fragment(graph):
    rows = [tuple(r) for r in graph.triples.collect()]
    for by, (p, s) in itertools.product("spo", ((None, None), (X + "likes", None), (None, X + "ann"))):
        want: dict = {}
        for r in rows:
            if p in (None, r[1]) and s in (None, r[0]):
                want[r["spo".index(by)]] = want.get(r["spo".index(by)], 0) + 1
        assert dict(map(tuple, graph.distinct(by, p=p and f"<{p}>", s=s and f"<{s}>").collect())) == want
    with pytest.raises(QueryError):
        graph.distinct("g")


def test_describe_terms_and_sample(graph):
    ways = [r.direction for r in graph.describe("x:ann").collect()]
    assert ways.count("out") == 5 and ways.count("in") == 2
    assert tuple(graph.term_counts(X).first()) == (3, 6, 3, 9)
    assert [r.term for r in graph.term_prefix(X, limit=3).collect()] == [X + "age", X + "ann", X + "bob"]
    assert [r.term for r in graph.term_prefix(X, "subject", after=X + "ann").collect()] == [X + "bob", X + "cat"]
    with pytest.raises(QueryError):
        graph.term_prefix("<" + X)
    import hashlib

    got = [tuple(r)[1:] for r in graph.sample(n=4, seed=9).orderBy("ord").collect()]
    rows = [tuple(r) for r in graph.triples.collect()]
    assert got == sorted(rows, key=lambda r: hashlib.sha256("\t".join(("9", *r)).encode()).hexdigest())[:4]


LABELLED = f"""
<{X}a> <{X}label> "Asthma"@de .
<{X}a> <{X}name> "asthma"@en .
<{X}b> <{X}label> "Atrazin"@de .
<{X}b> <{X}label> "atrazine" .
<{X}c> <{X}label> "colour"@en-gb .
<{X}c> <{X}label> "couleur"@fr .
<{X}d> <{X}label> "beta"@en .
<{X}d> <{X}label> "Alpha"@en .
<{X}e> <{X}name> "by name" .
<{X}e> <{X}label> "by label" .
<{X}f> <{X}label> <{X}a> .
<{X}f> <{X}name> "linked" .
""".strip().split("\n")


def test_preferred_labels(spark):
    g = loaded(spark, LABELLED, roles={"label": [X + "label", X + "name"]})
    cases = [("a", ["en"], "asthma"), ("a", ["de"], "Asthma"), ("a", [], "Asthma"), ("a", ["fr"], "Asthma"), ("b", ["en"], "atrazine"), ("b", [], "atrazine"), ("b", ["de"], "Atrazin"), ("b", ["*"], "Atrazin"), ("c", ["en"], "colour"), ("c", ["EN-GB"], "colour"), ("c", ["fr", "en"], "couleur"), ("c", ["fr-ca", "en-us"], "colour"), ("d", ["en"], "Alpha"), ("d", [], "Alpha"), ("e", [], "by label"), ("f", [], "linked")]
    for langs in {tuple(c[1]) for c in cases}:
        found = {r.node: r.label for r in labels.preferred(g, langs=list(langs)).collect()}
        for node, own, want in cases:
            if tuple(own) == langs:
                assert found[X + node] == want, (node, own)
    got = labels.resolve(g, ["x:e", "x:zzz", "x:a", "x:e"], ["x:name", "x:label"], ["fr"]).collect()
    assert [(r.ord, r.label) for r in got] == [(0, "by name"), (1, None), (2, "asthma"), (3, "by name")]
    with pytest.raises(QueryError):
        labels.preferred(g, langs=["en"] * 17)


def test_search(spark):
    g = loaded(spark, [f'<{X}1> <{X}t> "Red foxes run" .', f'<{X}2> <{X}t> "red fox" .', f'<{X}3> <{X}t> "a fox, red" .', f'<{X}3> <{X}u> "red red fox fox" .', f'<{X}4> <{X}t> "blue" .'])
    got = search.search(g, "Red FOX").collect()
    assert {r.subject for r in got} == {X + k for k in "123"}
    assert [r.match_kind for r in got] == ["exact", "exact", "normalized"] and got[-1].subject == X + "1"
    assert search.count(g, "red fox").first()[0] == 4
    assert search.count(g, "nothing").first()[0] == 0 and search.statements(g, "!!").collect() == []
    assert {r.predicate for r in search.search(g, "red", predicate="x:u").collect()} == {X + "u"}
    for bad in (lambda: search.search(g, " "), lambda: search.search(g, "a", role="none"), lambda: search.search(g, "a", limit=0)):
        with pytest.raises(QueryError):
            bad()


TYPED = [*LINES, f"<{X}ann> <{PRE['rdf']}type> <{X}Person> .", f"<{X}bob> <{PRE['rdf']}type> <{X}Person> .", f"<{X}bob> <{PRE['rdf']}type> <{X}Agent> .", f"<{X}cat> <{PRE['rdf']}type> <{X}Animal> ."]


def test_statistics(spark):
    t = loaded(spark, TYPED).triples
    assert tuple(stats.totals(t).first()) == (14, 4, 12, 7)
    rel = {(r.subject_class, r.predicate, r.object_class): r.triples for r in stats.class_relations(t).collect()}
    assert rel[X + "Person", X + "likes", X + "Person"] == 2 and rel[X + "Agent", X + "likes", X + "Person"] == 1 and rel[X + "Person", X + "likes", X + "Animal"] == 1
    assert {r["class"]: r.entities for r in stats.classes(t).collect()} == {X + "Person": 2, X + "Agent": 1, X + "Animal": 1}
    table = stats.tidy(t).cache()
    assert stats.verified(t, table).collect() == []
    assert stats.schema_node(table, cls=X + "Person").first().entities == 2
    assert [r.predicate for r in stats.schema_children(table, "class", "properties", cls=X + "Animal").collect()] == [PRE["rdf"] + "type", X + "age", X + "name"]
    with pytest.raises(QueryError):
        stats.schema_children(table, "class", "languages")
    void = {(r.p, r.o) for r in stats.as_void(table).collect()}
    assert ("http://rdfs.org/ns/void#triples", '"14"^^<http://www.w3.org/2001/XMLSchema#integer>') in void
    assert {r.name for r in stats.summary(t).collect() if r.section == "classes"} == {X + "Person", X + "Agent", X + "Animal"}


def test_a_description_is_held_against_the_triples(spark):
    t = loaded(spark, TYPED).triples
    void = stats.as_void(stats.tidy(t)).cache()
    assert stats.from_void(void).count() == stats.tidy(t).count()
    assert stats.verified(t, void).collect() == []
    wrong = void.withColumn("o", F.when((F.col("p") == stats.VOID + "entities") & F.col("o").startswith('"2"'), F.lit('"3"^^<http://www.w3.org/2001/XMLSchema#integer>')).otherwise(F.col("o")))
    assert {(r.found, r.entities) for r in stats.verified(t, wrong).collect()} == {("stored", 3), ("computed", 2)}


def test_views_of_graphs_and_components(spark):
    lines = [f"<{X}a> <{X}p> <{X}b> <{X}g1> .", f"<{X}a> <{X}q> <{X}b> <{X}g2> .", f"<{X}a> <{PRE['rdf']}type> <{X}T> <{X}g2> ."]
    g = loaded(spark, lines)
    parts = [{"id": "main", "kind": "source", "graph": X + "g2"}]
    table = stats.all_views(g, parts).cache()
    assert {r.view for r in table.select("view").distinct().collect()} == {"design", "queryable", f"graph:{X}g1", "component:main"}
    own = stats.views(g, ["component:main", f"graph:{X}g1"], parts)
    key = lambda df: sorted((r.view, r.kind, r.predicate or "", r.triples or 0) for r in df.filter("kind = 'property' AND view NOT IN ('design', 'queryable')").collect())
    assert key(own) == key(table) and len(key(own)) == 3
    with pytest.raises(QueryError):
        stats.views(g, ["graph:"[:-1]])
    assert {r.section for r in stats.summary(g).collect()} >= {"graphs", "classes"}
    assert "## Graphs" in stats.summary_card(stats.summary(g), "x")


def test_statement_terms(spark):
    tt = f"<<( <{X}a> <{X}knows> <{X}b> )>>"
    reifies = PRE["rdf"] + "reifies"
    g = loaded(spark, [f"<{X}a> <{X}knows> <{X}b> .", f"<{X}e1> <{reifies}> {tt} .", f"<{X}e2> <{reifies}> {tt} .", f"<{X}e3> <{X}says> <<( <{X}d> <{X}claims> <<( <{X}b> <{X}knows> <{X}e> )>> )>> .", f'<{X}e4> <{reifies}> <<( <{X}a> <{X}name> "A"@en--ltr )>> .'])
    assert {r.s for r in g.matching(g.triples, o="<<( x:a x:knows x:b )>>").collect()} == {X + "e1", X + "e2"}
    assert g.count(o="<<( x:a ?p ?o )>>").first()[0] == 3
    assert g.count(o="<<( ?s x:claims <<( ?t x:knows ?u )>> )>>").first()[0] == 1
    assert g.count(o='<<( x:a x:name "A"@en--ltr )>>').first()[0] == 1
    asserted = g.propositions.join(g.triples, ["s", "p", "o"], "left_semi").count()
    assert asserted == 1
    with pytest.raises(QueryError):
        g.count(o="<<( ?x x:knows ?x )>>").first()
    deep = "<<( " * 0 + f"<<( <{X}s> <{X}isPartOf> <{X}o0> )>>"
    for i in range(1, 6):
        deep = f"<<( <{X}s{i}> <{X}isPartOf> {deep} )>>"
    nested = loaded(spark, [f"<{X}e> <{X}says> {deep} ."])
    found = {r.text for r in verbalize.statement_texts(nested, verbalize.plain_names(nested, [X + "label"])).collect()}
    assert len(found) == 6 and max(found, key=len) == "s5 is part of (s4 is part of (s3 is part of (s2 is part of (s1 is part of (s is part of o0)))))"
    hydrated = labels.hydrated(nested, nested.matching(nested.triples, p="x:says")).first()
    assert hydrated.label_o.startswith("s5 is Part Of")
    assert {r.text for r in verbalize.statement_texts(g, verbalize.plain_names(g, [X + "label"])).collect()} >= {"a knows b", "d claims (b knows e)"}


def test_texts_of_nodes(spark):
    lines = [f"<{X}r> <{PRE['rdf']}type> <{X}Thing> .", f'<{X}r> <{X}label> "Root  label" .', f'<{X}r> <{X}hasScore> "42" .', f"<{X}r> <{X}rel> <{X}q> .", f'<{X}q> <{X}label> "Other" .', f'<{X}rel> <{X}label> "Related predicate" .', f"<{X}r> <{X}rel> _:b ."]
    g = loaded(spark, lines, roles={"label": [X + "label"]})
    r = verbalize.verbalize(g, verbalize.Config({"t": verbalize.Target(X + "Thing")}), "t").first()
    assert r.text == "label: Root label\ntype: Thing\nhas score: 42\nlabel: Root label\nrelated predicate: Other"
    assert r.lines == 5 and r.chars == len(r.text) and not r.limited and not r.truncated
    r = verbalize.verbalize(g, verbalize.Config({"t": verbalize.Target(X + "Thing")}), "t", text_bytes=30).first()
    assert r.text == "label: Root label\ntype: Thing\nhas score: 42" and r.truncated
    ignored = verbalize.Config({"t": verbalize.Target(X + "Thing", ignore=[X + "label", X + "rel"], predicate_limit=1)})
    assert verbalize.verbalize(g, ignored, "t").first().text == "label: Root label\ntype: Thing\nhas score: 42"
    with pytest.raises(QueryError):
        verbalize.verbalize(g, ignored, "u")


def test_templates_nest_and_stop_at_cycles(spark):
    t = PRE["rdf"] + "type"
    lines = [f"<{X}p{i}> <{t}> <{X}P> ." for i in range(3)] + [f"<{X}p0> <{X}knows> <{X}p1> .", f"<{X}p1> <{X}knows> <{X}p2> .", f"<{X}p2> <{X}knows> <{X}p0> .", f'<{X}p0> <{X}label> "zero" .']
    g = loaded(spark, lines, roles={"label": [X + "label"]})
    names = verbalize.template_names(g, {X + "P": verbalize.Template("friend of {k}", {"k": X + "knows"})}, verbalize.plain_names(g, [X + "label"]))
    assert {r.node: r.label for r in names.collect()}[X + "p0"] == "friend of friend of friend of zero"
    lone = loaded(spark, [f"<{X}p> <{t}> <{X}P> .", f"<{X}p> <{t}> <{X}A> .", f'<{X}p> <{X}a> "1" .', f"<{X}P> <{X}x> <{X}y> ."])
    two = verbalize.Template("{a} and {b} of all", {"a": X + "a", "b": X + "b"})
    assert verbalize.template_names(lone, {X + "P": two}, verbalize.plain_names(lone, [X + "label"])).first().label == "1 and of all"
    # P is a subject too, so it comes before A
    both = {X + "A": verbalize.Template("by A {a}", {"a": X + "a"}), X + "P": verbalize.Template("by P {a}", {"a": X + "a"})}
    assert verbalize.template_names(lone, both, verbalize.plain_names(lone, [X + "label"])).first().label == "by P 1"
    for bad in ("none", "{a", "{other}"):
        with pytest.raises(QueryError):
            verbalize.Template(bad, {"k": X + "knows"})


def test_lines_round_trip(spark, tmp_path):
    rows = [(X + "a", X + "p", '"tab\t quote" back\\slash\nline"@en', X + "g"), ("_:b", X + "p", X + "a", UNNAMED), (X + "a", X + "p", '"\\n is no line"', UNNAMED), (X + "a", X + "p", '"1"^^<http://t.test/i>', UNNAMED)]
    df = spark.createDataFrame(rows, "s string, p string, o string, g string")
    ntriples.write(df, f"{tmp_path}/q")
    back, props = ntriples.read(spark, f"{tmp_path}/q")
    plain = [tuple("_:b" if x.startswith("_:") else x for x in r) for r in back.collect()]
    assert sorted(plain) == sorted(rows) and props.isEmpty()
    for name in "mn":
        (tmp_path / f"{name}.nt").write_text(f'_:b0 <{X}p> "{name}" .\n_:b0 <{X}q> <<( _:b0 <{X}p> "x" )>> .\n')
    two, props = ntriples.read(spark, str(tmp_path / "[mn].nt"))
    assert two.select("s").distinct().count() == 2 and props.select("s").distinct().count() == 2
    assert two.select("s").intersect(props.select("s")).count() == 2
    for bad in ("<a> <b> .", "garbage", '<a> <b> "open .'):
        with pytest.raises(Exception):
            ntriples.parse_lines(spark.createDataFrame([(bad,)], "value string"))[0].collect()
    escaped = ntriples.parse_lines(spark.createDataFrame([(f'<{X}a> <{X}p> "\\u00e9\\\\u" .',), ("# only a comment",), ("",)], "value string"))[0]
    assert [r.o for r in escaped.collect()] == ['"é\\u"']
    text = ntriples.turtle([(X + "a", PRE["rdf"] + "type", X + "C"), (X + "a", X + "p", '"x"@en')], PRE)
    assert "x:a a x:C" in text and 'x:p "x"@en' in text
    assert ntriples.json_ld([(X + "a", X + "p", '"x"@en')]) == [{"@id": X + "a", X + "p": [{"@value": "x", "@language": "en"}]}]


def test_bundles(spark, tmp_path):
    g = loaded(spark, TYPED)
    path = f"file://{tmp_path}/bundles/people/1"
    m = bundle.publish(g, path, bundle.Manifest("people", "1"), parts=2)
    assert "schema" in m.capabilities and "graphs" not in m.capabilities
    back = bundle.open_bundle(spark, path)
    assert sorted(map(tuple, back.triples.collect())) == sorted(map(tuple, g.triples.collect())) and back.prefixes == PRE
    assert bundle.check(spark, path) == [] and bundle.described(spark, path).collect() == []
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(back.terms().select("term", "section")) == rows(g.terms().select("term", "section")) and rows(back.shared) == rows(g.shared)
    for asked in ({}, {"s": "x:ann"}, {"p": "x:likes"}, {"o": "x:ann"}, {"s": "x:ann", "o": "x:ann"}):
        assert [tuple(r) for r in back.ordered(**asked).collect()] == [tuple(r) for r in g.ordered(**asked).collect()]
        if asked:
            assert f"/{'by_subject' if 's' in asked else 'by_object' if 'o' in asked else 'triples'}" in back.found(**asked)[0].inputFiles()[0]
    for query in ("ann", "blank subjects", "a"):
        assert rows(search.hits(back, query)) == rows(search.hits(g, query))
    assert rows(stats.summary(back)) == rows(stats.summary(g)) and rows(stats.views(back)) == rows(stats.views(g))
    plan = back.order_keys(back.found(p="x:likes")[0], "p", False)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") < 10
    assert [r.dataset for r in bundle.catalog(spark, f"file://{tmp_path}/bundles").collect()] == ["people"]
    with pytest.raises(QueryError):
        bundle.publish(g, path, bundle.Manifest("people", "1"))
    with pytest.raises(QueryError):
        bundle.open_bundle(spark, f"file://{tmp_path}/none")
    text = m.to_json().replace(m.content_digest, "0" * 64)
    with pytest.raises(QueryError):
        bundle.Manifest.from_json(text)


def test_incremental_ingest_adds_each_row_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.nq").write_text("\n".join(LINES[:6]) + "\n")
    args = (spark, str(source), f"file://{tmp_path}/table", f"file://{tmp_path}/state")
    ingest(*args)
    (source / "b.nq").write_text("\n".join(LINES[4:]) + "\n")
    ingest(*args)
    ingest(*args)
    assert spark.read.parquet(f"{tmp_path}/table").count() == len(LINES)
    (source / "c.nq").write_text(f"<{X}e> <{PRE['rdf']}reifies> <<( <{X}a> <{X}p> <{X}b> )>> .\n")
    ingest(*args)
    held = spark.read.parquet(f"{tmp_path}/table").filter(F.col("s") == X + "e").first()
    assert [r.s for r in spark.read.parquet(f"{tmp_path}/table-propositions").filter(F.col("tt_id") == held.o).collect()] == [X + "a"]


def test_key_sets_and_joins(spark, graph):
    assert keysets.resemblance(*(keysets.bottom_keys(graph, 50),) * 2).first().estimate == 1.0
    assert {r.term for r in keysets.overlap(graph, graph).collect()} >= {X + "ann"}
    assert keysets.distinct_estimate(graph).first()[0] == graph.triples.select("o").distinct().count()
    got = joins.basic_pattern(graph, [("?a", "x:likes", "?b"), ("?b", "x:name", "?n")]).collect()
    assert {(r.a, r.n) for r in got} == {(X + "ann", '"Bob"'), (X + "ann", '"Cat"'), (X + "bob", '"Ann"')}
    assert [r.s for r in joins.number_range(graph, "x:age", "30", "40").collect()] == [X + "cat"]
    assert joins.basic_pattern(graph, [("?a", "?p", "?a")]).first().p == X + "self"
    late = joins.basic_pattern(graph, [("?a", "x:likes", "?b"), ("?c", "x:self", "?d"), ("?b", "x:likes", "?c")])
    assert {(r.a, r.c) for r in late.collect()} == {(X + "bob", X + "ann")} or late.count() >= 1
    with pytest.raises(QueryError):
        joins.basic_pattern(graph, [("?a", "x:likes", "?b"), ("?c", "x:self", "?d")])
