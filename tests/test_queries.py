"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from quadrille.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def multiset(rows, names, order):
    at = [names.index(n) for n in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    got = registry.queries()[name](spark, D)
    want = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    assert multiset([tuple(r) for r in got.collect()], got.columns, order) == multiset(want.fetchall(), names, order)


def test_the_sample_is_the_stated_one(spark):
    from quadrille.plans.queries import core

    g = core(spark, D)
    got = g.sample(p="p:o_custkey", n=100, seed=7).collect()
    assert [r.ord for r in got] == list(range(100)) and len({r.s for r in got}) == 100
    fewer, other = ({r.s for r in g.sample(p="p:o_custkey", n=30, seed=x).collect()} for x in (7, 8))
    assert fewer < {r.s for r in got} and fewer != other
    assert g.sample(p="p:none").collect() == []


def test_a_bound_predicate_leaves_one_scan(spark):
    from quadrille.plans.queries import core

    plan = core(spark, D).fragment(p="p:o_custkey").rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_whole_texts_are_mapped_and_searched(spark, tmp_path):
    from quadrille.operators import labels, search
    from quadrille.operators.graph import Graph
    from quadrille.sources import mapping, ntriples

    texts = ["short", "x " * 30 + "late wording", 'a "quote",\n a \\ and\r blanks ' * 5_000 + "late wording", "late"]
    rows = [(i, t, "EN", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    g = Graph(mapping.triples(spark, str(tmp_path), ("documents",)))
    assert sorted(r.s for r in search.statements(g, "late wording").collect()) == ["http://data/document/1", "http://data/document/2"]
    assert {r.node: r.label for r in labels.preferred(g, langs=["en"]).collect()} == {f"http://data/document/{i}": t for i, t in enumerate(texts)}
    again = ntriples.parse_lines(ntriples.lines(g.triples))[0].select("s", "p", "o")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, g.triples.collect()))


def test_operations_over_the_whole_graph_take_every_column_of_every_table(spark):
    import pyarrow.parquet as pq

    from quadrille.sources import mapping

    for table in mapping.FULL:
        _, key, _, columns, _ = mapping.TABLES[table]
        assert set(pq.read_schema(f"{D}/{table}.parquet").names) <= {*key, *columns}, table
    item, q = "http://data/c/LineItem", registry.queries()
    assert item in {r.name for r in q["summary"](spark, D).collect() if r.section == "classes"}
    assert {r.predicate.rsplit("/", 1)[1] for r in q["void_datatypes"](spark, D).collect() if r["class"] == item} >= {"l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"}
    assert {r.graph for r in q["graphs"](spark, D).collect()} >= {f"http://data/g/{t}" for t in mapping.FULL}


@pytest.mark.parametrize("gone", [("quadrille/llm", "tests/llm"), ("quadrille/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_entry_module_stands_without_the_optional_parts(tmp_path, gone):
    """On a copy of the repository from which they are deleted."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root, copy = pathlib.Path(__file__).parent.parent, tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e\nq=e.queries()\nassert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q\nprint(len([k for k in q if k.startswith('op') and k[2].isdigit()]), len(q))"
    out = subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, capture_output=True, text=True).stdout.split()
    without_llm = "quadrille/llm" in gone or not (root / "quadrille" / "llm").is_dir()
    assert int(out[0]) == (0 if without_llm else 10) and int(out[1]) >= len(registry.queries())
