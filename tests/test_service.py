import json

import pytest

from quadrille.functions.errors import QueryError
from quadrille.functions.values import normalized_rows, parse_values
from quadrille.operators import verbalize
from quadrille.operators.graph import token
from quadrille.plans.service import PARAMETERS, answer, request
from quadrille.sources import build, bundle

from .test_graph import LINES, TYPED, X, loaded


@pytest.fixture(scope="module")
def graph(spark):
    return loaded(spark, TYPED)


def test_values_tables():
    assert parse_values('VALUES (?x ?y) { (<http://a> "b"@en) (UNDEF ex:c) }', {"ex": "http://e/"}) == (["x", "y"], [["<http://a>", '"b"@en'], [None, "ex:c"]])
    assert parse_values("values ?x { 1 2.5 }")[1] == [['"1"^^<http://www.w3.org/2001/XMLSchema#integer>'], ['"2.5"^^<http://www.w3.org/2001/XMLSchema#decimal>']]
    assert normalized_rows([["a", None], ["a", "b"], ["a", None], [None, "b"]]) == [["a", None], [None, "b"]]
    for bad in ("SELECT ?x", "VALUES ?x { <a> ", "VALUES (?x ?x) { }", "VALUES (?x) { (<a> <b>) }", "VALUES ?x { <a> } FILTER", "VALUES ?x { nope:a }"):
        with pytest.raises(QueryError):
            parse_values(bad, {})


def test_every_operation_answers(graph):
    config = verbalize.Config({"people": verbalize.Target(X + "Person")})
    pattern, table = {"s": "?x", "p": "x:name", "o": None}, {"vars": ["x"], "rows": [["x:ann"], ["x:nobody"]]}
    asked = {
        "fragment": ({"p": "x:likes"}, 3),
        "bindings": ({"pattern": pattern, "bindings": table}, 1),
        "tpf": ({"predicate": X + "likes", "subject": "?s"}, 3),
        "count": ({"pattern": pattern, "bindings": table}, 2),
        "describe": ({"iri": "x:ann", "direction": "in"}, 2),
        "sample": ({"p": "x:name", "n": 2, "seed": 1}, 2),
        "distinct": ({"group_by": "p"}, 7),
        "terms": ({"prefix": X, "role": "subject"}, 3),
        "search": ({"q": "ann"}, 1),
        "labels": ({"iris": ["x:ann"], "labels": ["x:name"]}, 1),
        "graphs": ({}, 1),
        "schema": ({"class": X + "Person", "children": "properties"}, 5),
        "void": ({}, None),
        "summary": ({}, None),
        "verbalize": ({"config": config, "n": 1}, 1),
    }
    assert set(asked) == set(PARAMETERS)
    for name, (params, rows) in asked.items():
        got = request(graph, name, **params).collect()
        assert rows is None and got or len(got) == rows, name
    assert request(graph, "fragment", o__text="ann", p="x:name").count() == 1
    assert request(graph, "count", o__text="ann").first()[0] == 2
    assert request(graph, "verbalize", config=config, plan=True).first().members == 2
    assert [r.iri for r in request(graph, "verbalize", config=config, iri=["x:bob"]).collect()] == [X + "bob"]
    values = f"VALUES ?s {{ <{X}ann> <{X}ann> <{X}zzz> }}"
    assert request(graph, "tpf", subject="?s", predicate=X + "likes", values=values).count() == 2
    assert request(graph, "bindings", pattern=pattern, values="VALUES ?x { x:ann x:ann }", distinct=True).count() == 1
    assert request(graph, "schema", projection="class-relations").count() > 0


@pytest.mark.parametrize(
    "operation, params, code",
    [
        ("none", {}, "not_found"),
        ("fragment", {"q": "x"}, "unknown_parameter"),
        ("fragment", {"o__ge": "3"}, "unsupported"),
        ("fragment", {"o__text": "a", "g": "*"}, "malformed_request"),
        ("fragment", {"limit": 0}, "malformed_request"),
        ("distinct", {"p": "x:name"}, "malformed_request"),
        ("terms", {"count": True, "limit": 5}, "malformed_request"),
        ("tpf", {"subject": "?a", "object": "?a"}, "unsupported"),
        ("schema", {"projection": "all"}, "malformed_request"),
        ("search", {"q": "a", "limit": 5000}, "cap_exceeded"),
    ],
)
def test_what_is_not_answered_is_refused(graph, operation, params, code):
    with pytest.raises(QueryError) as e:
        request(graph, operation, **params)
    assert e.value.code == code


def test_pages_go_through_the_whole_of_every_operation(graph):
    pattern, table = {"s": "?x", "p": None, "o": None}, {"vars": ["x"], "rows": [["x:ann"], ["x:bob"], ["x:ann"]]}
    asked = {
        "fragment": [{"p": "x:likes"}, {}, {"o__text": "ann"}],
        "bindings": [{"pattern": pattern, "bindings": table}, {"pattern": pattern, "bindings": table, "distinct": True}],
        "tpf": [{"predicate": X + "likes"}, {"subject": "?s", "values": f"VALUES ?s {{ <{X}ann> <{X}bob> }}"}],
        "distinct": [{"group_by": "o"}, {"group_by": "p"}],
        "terms": [{"prefix": X}],
        "graphs": [{}],
        "schema": [{"class": X + "Person", "children": "properties"}, {"projection": "class-relations"}],
    }
    for name, each in asked.items():
        for params in each:
            whole = answer(graph, name, **params, limit=1000)
            assert whole.complete and whole.cursor is None
            want = [tuple(r)[1:] for r in whole.rows.orderBy("ord").collect()]
            got, cursor = [], None
            while True:
                page = answer(graph, name, **params, limit=3, cursor=cursor)
                got += [tuple(r)[1:] for r in page.rows.orderBy("ord").collect()]
                cursor = page.cursor
                assert page.complete == (cursor is None)
                if page.complete:
                    break
            assert got == want and len(want) == whole.exact() and want, (name, params)
            for bad in ("garbage", token("other", {}, [])):
                with pytest.raises(QueryError) as e:
                    request(graph, name, **params, cursor=bad)
                assert e.value.code == "stale_cursor"
    assert answer(graph, "fragment", s="x:ann", p="x:nothing").absent == [("p", "not held in this position")]


def test_explicit_patterns_take_a_graph(spark):
    g = loaded(spark, [f"<{X}a> <{X}p> <{X}b> <{X}g1> .", f"<{X}c> <{X}p> <{X}d> <{X}g2> ."])
    assert [r.s for r in request(g, "tpf", predicate=X + "p", graph=X + "g1").collect()] == [X + "a"]
    assert [r.s for r in request(g, "tpf", subject="?s", graph=X + "g2", values=f"VALUES ?s {{ <{X}a> <{X}c> }}", limit=5).collect()] == [X + "c"]
    assert {r.g for r in request(g, "tpf", predicate=X + "p").collect()} == {X + "g1", X + "g2"}


def test_labels_of_a_page_and_their_sources(graph):
    row = request(graph, "fragment", p="x:self", labels=["x:label"], lang=["en"], label_source=True).first()
    assert (row.label_s, row.source_s, row.label_o) == ("Ann", X + "label", "Ann")
    assert "source_s" not in request(graph, "fragment", p="x:self", labels=True).columns
    with pytest.raises(QueryError):
        request(graph, "fragment", p="x:self", label_source=True)


def test_commands(tmp_path, capsys):
    from quadrille.__main__ import main, parser

    (tmp_path / "bad.json").write_text('{"dataset": "d"}')
    (tmp_path / "good.json").write_text(json.dumps({"dataset": "d", "version": "1", "inputs": ["a"], "output": "b"}))
    assert main(["check-config", str(tmp_path / "bad.json")]) == 1 and "missing" in capsys.readouterr().out
    assert main(["check-config", str(tmp_path / "good.json")]) == 0
    assert parser().parse_args(["verbalize", "b", "c", "o"]).cls == "c"


def test_blank_nodes_are_published_under_iris(graph):
    own = graph.addressed()
    row = own.fragment(o='"a blank subject"').rows.first()
    assert row.s.startswith("urn:x-quadrille:bnode:") and own.count(s=f"<{row.s}>").first()[0] == 1


def test_builds_follow_a_checked_configuration(spark, tmp_path):
    (tmp_path / "a.nt").write_text("\n".join(LINES))
    values = {"dataset": "d", "version": "1", "inputs": [str(tmp_path / "a.nt")], "output": f"file://{tmp_path}/out", "prefixes": {"x": X}}
    config = build.BuildConfig.of(values)
    assert build.build(spark, config, dry_run=True)[-1].endswith("/d/1") and not (tmp_path / "out").exists()
    build.build(spark, config)
    assert bundle.open_bundle(spark, f"file://{tmp_path}/out/d/1").count().first()[0] == len(LINES)
    assert json.loads((tmp_path / "out/d/1/manifest.json").read_text())["capabilities"]
    for bad in ({**values, "typo": 1}, {**values, "inputs": []}, {**values, "components": [{"id": "a", "kind": "none", "graph": "g"}]}):
        with pytest.raises(QueryError):
            build.BuildConfig.of(bad)
