"""Operations over all triples: forms of the mapping that shuffle no triples, on rows that repeat and at odd sizes."""

import datetime
import os

import pytest

from quadrille.operators import search, stats
from quadrille.operators.graph import Graph
from quadrille.plans import queries, registry
from quadrille.sources import mapping, ntriples

D = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A table whose rows repeat keys: up to nine rows of one, nulls, and values that differ but make equal terms."""
    d = str(tmp_path_factory.mktemp("odd"))
    at = lambda i: datetime.datetime(2020, 1, 1, 0, 0, i % 3, 7 * i)
    rows = []
    for key, n in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 9)):
        for i in range(n):
            rows.append((key, None if i % 4 == 1 else i % 3, 7, 1, float(i % 2), None if key == 4 and i < 2 else 10.001 + i % 2 / 1000, 0.1 * i, None, "AB"[i % 2], None if i == 0 else "O", at(i)))
    rows += [(None, 1, 1, 1, 1.0, 1.0, 1.0, 1.0, "A", "O", at(0)), (7, 1, 1, None, 1.0, 1.0, 1.0, 1.0, "A", "O", at(0)), rows[-1]]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_rows_of_one_key_make_each_triple_once(spark, odd):
    tables = ("lineitem",)
    want = sorted(map(tuple, mapping.triples(spark, odd, tables).collect()))
    typed = mapping.exploded(spark, odd, tables).collect()
    assert sorted((r.s, r.p, r.o) for r in typed) == want and len(set(want)) == len(want)
    assert sorted((r.s, r.p) for r in typed if r.first) == sorted({(s, p) for s, p, _ in want})
    f = mapping.forms(spark, odd, tables)
    assert set(map(tuple, f["bag"].collect())) == set(want) and f["bag"].count() > len(want)
    assert sorted(r.p for r in f["marks"].collect()) == sorted(p for _, p, _ in want)
    assert sorted(r.s for r in f["subjects"].collect()) == sorted({s for s, _, _ in want})
    assert sorted(r.p for r in f["predicates"].collect()) == sorted({p for _, p, _ in want})
    plain, known = Graph(mapping.triples(spark, odd, tables)), Graph(mapping.triples(spark, odd, tables), **f)
    for of in (stats.totals, stats.properties, stats.classes, stats.class_properties, stats.class_relations, stats.datatypes, stats.summary, lambda g: stats.namespaces(g, queries.PREFIXES), Graph.terms, Graph.count, lambda g: g.distinct("p"), lambda g: g.shared):
        a, b = of(plain), of(known)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_statistics_of_the_mapped_graph_shuffle_no_triples(spark):
    """Rows are brought together by key, as they are read; classes are not joined; what needs no distinct rows shuffles none."""
    for name in ("count_all", "distinct_p", "graphs", "fragment_all", "ntriples_lines", "void_class_properties", "void_datatypes", "void_property_partitions", "void_graph_properties", "schema_children"):
        got = plan(registry.queries()[name](spark, D))
        assert "Join" not in got, name
        assert "hashpartitioning(l_orderkey" in got or name == "schema_children", name
    for name in ("names_fallback", "term_parts", "shared_terms", "terms_sections", "terms_count", "namespaces", "key_set_sections"):
        got = plan(registry.queries()[name](spark, D))
        assert "Join" not in got and "lag(" not in got, name


def test_the_type_tests_of_terms_read_from_the_end(spark):
    from quadrille.functions import terms
    from pyspark.sql import functions as F

    rows = [('"a"',), ('"a"@en',), ('"a"^^<http://x/d>',), ('"x" y"@en-gb',), ('"say "@en"',), ('""',), ('"',), ('"open',), ('"a"@e n',), ('"l\n"q"\nm"@de',), ("http://x/a",), ("_:b",), ('"é"^^<u:\u00e9>',)]
    c = F.col("t")
    old = F.regexp_extract(c, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^<>"]*>)?$', 1)
    tail = F.regexp_extract(c, r'(?s)^".*"((?:@[A-Za-z0-9-]+|\^\^<[^<>"]*>)?)$', 1)
    got = spark.createDataFrame(rows, "t string").select("t", F.when(terms.is_literal(c), old).alias("old"), terms.lexical(c).alias("new"), tail.alias("a"), F.when(terms.is_literal(c), terms._suffix(c)).otherwise("").alias("b")).collect()
    assert all(r.old == r.new and r.a == r.b for r in got), got


def test_a_line_is_made_once_and_matched_once(spark):
    got = plan(registry.queries()["ntriples_round_trip"](spark, D))
    easy = got[: got.index("MapInArrow")]
    assert "regexp_extract(value" not in easy and easy.count("regexp_replace(") == 1
    for line in got.splitlines():
        assert "Filter" not in line or "concat_ws" not in line, line[:200]


def test_lines_are_parsed_to_their_ends(spark):
    lines = ['<a:s> <a:p> "x  y" .', '_:b <a:p> <a:o> <a:g> .', '<a:s> <a:p> "q\\"\\\\n \\n"@EN-gb _:g . # note', ' <a:s>\t<a:p>"\x01 . "^^<a:d>.', '<a:s> <a:p> "" .\n']
    got = ntriples.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))[0].collect()
    unnamed = mapping.UNNAMED
    assert sorted(map(tuple, got)) == sorted([("a:s", "a:p", '"x  y"', unnamed), ("_:b", "a:p", "a:o", "a:g"), ("a:s", "a:p", '"q"\\n \n"@en-gb', "_:g"), ("a:s", "a:p", '"\x01 . "^^<a:d>', unnamed), ("a:s", "a:p", '""', unnamed)])
    for bad in ("no line", "\n.a b c d e f g h i j", '<a:s> <a:p> "x" . .'):
        with pytest.raises(Exception, match="no N-Quads line"):
            ntriples.parse_lines(spark.createDataFrame([(bad,)], "value string"))[0].collect()


def test_a_page_in_explicit_syntax_is_ordered_as_asked(spark):
    from quadrille.functions.errors import QueryError
    from quadrille.plans import service

    own = [("x:a", "x:p", "x:2"), ("x:b", "x:p", "x:1"), ("x:c", "x:p", "x:1")]
    g = Graph(spark.createDataFrame(own, "s string, p string, o string"))
    asked = lambda **k: [(r.s, r.o) for r in sorted(service.request(g, "tpf", predicate="x:p", **k).collect(), key=lambda r: r.ord)]
    assert asked(limit=2) == [("x:b", "x:1"), ("x:c", "x:1")] and asked(limit=2, order="s") == [("x:a", "x:2"), ("x:b", "x:1")]
    first = service.answer(g, "tpf", predicate="x:p", order="s", limit=2)
    assert asked(limit=2, order="s", cursor=first.cursor) == [("x:c", "x:1")]
    for bad in ("", "x", "ss"):
        with pytest.raises(QueryError):
            asked(order=bad)


def test_a_bundle_writes_a_text_once_for_its_words(spark, tmp_path):
    """The index names literals by ids, long objects of the copy by object are digests, and no shuffle's files stay."""
    from quadrille.sources import bundle

    long = '"' + "one two three " * 4_000 + "last\\" + '"@en'
    own = [(f"x:{i}", "x:p", o) for i, o in enumerate((long, '"two threes"', "x:0", "x:" + "y" * 200))]
    g = Graph(spark.createDataFrame(own, "s string, p string, o string"))
    path = f"file://{tmp_path}/b"
    m = bundle.publish(g, path, bundle.Manifest("b", "1"), parts=2)
    assert m.content_digest == bundle.publish(g, f"{path}2", bundle.Manifest("b", "1"), parts=3).content_digest
    back = bundle.open_bundle(spark, path)
    assert back.tables["postings"].columns == ["stem", "word", "id", "n"] and back.tables["terms"].filter("id IS NOT NULL").select("id").distinct().count() == 2
    assert max(len(r.o) for r in back.copies["o"].collect()) <= 96
    for s, p, o in own:
        asked = long.replace("\\", "\\\\") if o == long else o if o.startswith('"') else f"<{o}>"
        assert [tuple(r) for r in back.found(o=asked)[0].collect()] == [(s, p, o)] and [tuple(r) for r in back.found(s=f"<{s}>", o=asked)[0].collect()] == [(s, p, o)]
    rows = lambda df: sorted(map(str, df.collect()))
    for query in ("three", "two last", "one", "nothing"):
        assert rows(search.search(back, query)) == rows(search.search(g, query)) and rows(search.statements(back, query)) == rows(search.statements(g, query))
    assert bundle.check(spark, path) == []


def test_tokens_and_stems_are_those_of_the_expressions(spark):
    from pyspark.sql import functions as F

    rows = [(x,) for x in ("", " ", "a", ",Things, SINGING wished boxes as es!", "thing  thing", "Straße s", "é-ed")]
    t = F.col("t")
    old = F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    df = spark.createDataFrame(rows, "t string").select(old.alias("old"), search.tokens(t).alias("new"))
    got = df.select("old", "new", F.transform("new", search.stemmed).alias("a"), F.transform("new", lambda x: F.regexp_replace(x, search.STEM, "$1")).alias("b")).collect()
    assert all(r.old == r.new and r.a == r.b for r in got)
    assert "filter(split" not in plan(df.select("new"))
