import pytest
from pyspark.sql import functions as F

from quadrille.functions import terms, texts
from quadrille.functions.errors import QueryError, limited

PRE = {"ex": "http://x.test/", "": "http://d.test/"}


@pytest.mark.parametrize(
    "text, stored",
    [
        ("<http://x.test/a>", "http://x.test/a"),
        ("ex:a", "http://x.test/a"),
        (":a", "http://d.test/a"),
        ('"a b"', '"a b"'),
        ('"a\\"b\\n\\u00e9"', '"a"b\né"'),
        ('"A"@EN-gb', '"A"@en-gb'),
        ('"A"@en--ltr', '"A"@en--ltr'),
        ('"1"^^<http://www.w3.org/2001/XMLSchema#integer>', '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'),
        ('"1"^^ex:t', '"1"^^<http://x.test/t>'),
        ('"s"^^<http://www.w3.org/2001/XMLSchema#string>', '"s"'),
        ("_:b", "_:b"),
    ],
)
def test_request_terms_and_their_stored_form(text, stored):
    assert terms.parse(text, PRE).stored() == stored


def test_explicit_terms_are_bare_iris():
    assert terms.parse("http://x.test/a", explicit=True).stored() == "http://x.test/a"
    with pytest.raises(QueryError):
        terms.parse("http://x.test/a b", explicit=True)


def test_statement_terms_nest():
    t = terms.parse("<<( ex:a ex:p <<( ex:b ex:q ?o )>> )>>", PRE, variables=True)
    assert t.kind == "triple" and t.parts[2].parts[2].kind == "variable" and not t.ground()
    assert terms.parse('<<( ex:a ex:p "x"@en )>>', PRE).ground()


@pytest.mark.parametrize("text", ["nope:a", "<http://x", '"open', '"a"@', '"a"^^<x', "<<( ex:a ex:p )>>", '<<( "l" ex:p ex:o )>>', '<<( ex:a "p" ex:o )>>', '"a\\q"', '"\\uD800"', "ex:a ex:b", '"a" x', "<>", "<<(" * 40])
def test_malformed_terms_are_refused(text):
    with pytest.raises(QueryError) as e:
        terms.parse(text, {"ex": "http://x.test/"})
    assert e.value.code == "bad_term_syntax"


def test_columns_read_stored_terms(spark):
    rows = ["http://x.test/a", "_:b", '"plain"', '"a"b\n"@en', '"7"^^<http://t.test/i>', '"x@y"', '"d"@en--rtl', '""']
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    t = F.col("t")
    got = df.select(terms.lexical(t), terms.language(t), terms.datatype(t), terms.ntriples(t)).collect()
    assert [r[0] for r in got] == [None, None, "plain", 'a"b\n', "7", "x@y", "d", ""]
    assert [r[1] for r in got] == [None, None, None, "en", None, None, "en--rtl", None]
    assert [r[2] for r in got] == [None, None, terms.XSD_STRING, terms.RDF_LANG, "http://t.test/i", terms.XSD_STRING, terms.RDF_DIR_LANG, terms.XSD_STRING]
    assert got[3][3] == '"a\\"b\\n"@en' and got[0][3] == "<http://x.test/a>" and got[1][3] == "_:b"
    assert df.select(terms.as_json(t)).collect()[3][0] == '{"type":"literal","value":"a\\"b\\n","lang":"en"}'


def test_readable_names(spark):
    rows = {"http://x.test/ns#hasExactSynonym": "has Exact Synonym", "http://x.test/a_b-c": "a b c", "urn:isbn": "urn:isbn", "http://x.test/ÉtéÀVoir": "Été ÀVoir", "http://x.test/ABCdef": "ABCdef"}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert [r[0] for r in df.select(texts.fallback_label(F.col("t"))).collect()] == list(rows.values())
    assert spark.createDataFrame([(" a\t b　c ",)], "t string").select(texts.normalized(F.col("t"))).first()[0] == "a b c"


def test_terms_in_urls(spark):
    from urllib.parse import quote

    rows = ["http://x.test/a b?c=d&e#f", "é~*+-._", "\"q\"@en"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(texts.url_encoded(F.col("t"))).collect()
    assert [r[0] for r in got] == [quote(r, safe="") for r in rows]


def test_limits():
    assert limited(None) == 100 and limited(10_000) == 10_000
    for bad, code in ((0, "malformed_request"), (10_001, "cap_exceeded"), ("x", "malformed_request")):
        with pytest.raises(QueryError) as e:
            limited(bad)
        assert e.value.code == code
