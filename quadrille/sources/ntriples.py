"""N-Triples and N-Quads, with RDF 1.2 statement terms, as DataFrames; and RDF sinks.

Lines are parsed by one regular expression for each term in the JVM; only lines with a statement
term, whose grammar nests, go through a parser in Python, in Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms
from quadrille.functions.errors import QueryError
from quadrille.sources.mapping import UNION, UNNAMED

IRI, BLANK = r"<([^<>\"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>\"\\\x00-\x20]*)*)>", r"(_:[^\s<>\"]+)"
# possessive: a loop with a way back recurses for every character and overflows on long texts
LITERAL = r'"([^"\\\n\r]*+(?:\\.[^"\\\n\r]*+)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^<>\s]*)>)?'
LINE = rf"^\s*(?:{IRI}|{BLANK})\s*{IRI}\s*(?:{IRI}|{BLANK}|{LITERAL})\s*(?:(?:{IRI}|{BLANK})\s*)?\.\s*(?:#.*)?$"
#: The same from a text's start to its end, for a replacement that leaves nothing.
WHOLE = LINE[:-1] + r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\z"
#: What a parsed line begins with; a line that begins with it is none.
PARSED = "\n."
TT = "urn:x-quadrille:tt:"


def statement_id(s: str, p: str, o: str) -> str:
    return TT + hashlib.sha256("\t".join((s, p, o)).encode()).hexdigest()


def _unescaped(c: Column) -> Column:
    for old, new in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
        # an escaped backslash is set aside first, so what follows it is no escape
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _text(c: Column) -> Column:
    aside = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    return F.when(c.contains("\\"), F.replace(_unescaped(aside), F.lit("\x00"), F.lit("\\"))).otherwise(c)


def parse_lines(lines: DataFrame, column: str = "value", scope: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(memberships (s, p, o, g), propositions (tt_id, s, p, o)) of lines; a line that is none raises.

    scope names the document of a line: blank nodes of one label are one node only within a document.
    """
    mark = F.lit("") if scope is None else F.concat(F.lit("f"), F.substring(F.sha2(scope, 256), 1, 16), F.lit("."))
    # unfolded, for what makes a line up would else be put in place of the line wherever it is named below
    lines = lines.select(F.explode(F.array(F.col(column))).alias(column), mark.alias("_scope"))
    blank = lambda x: F.concat(F.lit("_:"), F.col("_scope"), F.substr(x, F.lit(3)))
    c = F.col(column)
    real = lines.filter(~F.trim(c).startswith("#") & (F.trim(c) != ""))
    hard = c.contains("<<(") | c.contains("\\u") | c.contains("\\U")
    # one match of a line gives all its parts: those without blanks, then the text, which may hold some
    parts = F.split(F.regexp_replace(c, WHOLE, PARSED + "$1 $2 $3 $4 $5 $7 $8 $9 $10 $6"), " ", 10)
    at = lambda i: F.nullif(F.get("_parts", F.lit(i)), F.lit(""))
    subject, obj = F.coalesce(F.nullif(F.substr(at(0), F.lit(len(PARSED) + 1)), F.lit("")), blank(at(1))), F.coalesce(at(3), blank(at(4)))
    tag, kind = at(5), at(6)
    value = F.concat(F.lit('"'), _text(F.get("_parts", F.lit(9))), F.lit('"'), F.when(tag.isNotNull(), F.concat(F.lit("@"), F.lower(tag))).when(kind.isNotNull() & (kind != terms.XSD_STRING), F.concat(F.lit("^^<"), kind, F.lit(">"))).otherwise(""))
    ok = at(0).startswith(PARSED) & ~c.startswith(PARSED)
    easy = real.filter(~hard).withColumn("_parts", parts).select(
        F.when(ok, subject).otherwise(F.raise_error(F.concat(F.lit("no N-Quads line: "), c))).alias("s"),
        at(2).alias("p"),
        F.coalesce(obj, value).alias("o"),
        F.coalesce(at(7), blank(at(8)), F.lit(UNNAMED)).alias("g"),
    )
    kept = real.filter(hard).select(c.alias("line"), "_scope").mapInArrow(_parse_hard, "kind string, s string, p string, o string, g string")
    memberships = easy.union(kept.filter("kind = 'm'").select("s", "p", "o", "g")).distinct()
    propositions = kept.filter("kind = 't'").select(F.col("g").alias("tt_id"), "s", "p", "o").distinct()
    return memberships, propositions


def _parse_hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for line, scope in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += parse_hard_line(line, scope)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows) if rows else [[]] * 5)], ["kind", "s", "p", "o", "g"])


def parse_hard_line(line: str, scope: str = "") -> list[tuple]:
    """Rows ("m", s, p, o, g) and ("t", s, p, o, id) of one line with statement terms or \\u escapes."""
    r = terms._Reader(line, {}, False, False)
    found = []
    while True:
        r.blanks()
        if line.startswith(".", r.at):
            break
        found.append(r.term(1))
    if len(found) not in (3, 4):
        raise QueryError("bad_term_syntax", f"no N-Quads line: {line}")
    out: list[tuple] = []

    def stored(t) -> str:
        if t.kind == "blank":
            return f"_:{scope}{t.value}"
        if t.kind != "triple":
            return t.stored()
        parts = [stored(x) for x in t.parts]
        out.append(("t", *parts, statement_id(*parts)))
        return out[-1][4]

    s, p, o = (stored(t) for t in found[:3])
    out.append(("m", s, p, o, stored(found[3]) if len(found) == 4 else UNNAMED))
    return out


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(memberships, propositions) of N-Triples or N-Quads files. Reserved graph names are refused.

    A blank node's label is its file's: labels carry a mark of the file.
    """
    files = spark.read.text(path)
    memberships, propositions = parse_lines(files.select("value", "_metadata.file_path"), scope=F.col("file_path"))
    refused = F.when(F.col("g") == UNION, F.raise_error(F.lit(f"{UNION} is reserved"))).otherwise(F.col("g"))
    return memberships.withColumn("g", refused), propositions


def lines(rows: DataFrame) -> DataFrame:
    """(value): a line of N-Triples for each (s, p, o), of N-Quads where g is a named graph."""
    parts = [terms.ntriples(F.col(c)) for c in "spo"]
    if "g" in rows.columns:
        parts.append(F.when(F.col("g") != UNNAMED, terms.ntriples(F.col("g"))))
    return rows.select(F.concat_ws(" ", *parts, F.lit(".")).alias("value"))


def write(rows: DataFrame, path: str) -> None:
    lines(rows).write.text(path)


def turtle(rows: list[tuple], prefixes: dict[str, str]) -> str:
    """Turtle of a page of (s, p, o), which is bounded; with a fourth value, TriG."""
    def shown(t: str) -> str:
        if t.startswith("_:"):
            return t
        if not t.startswith('"'):
            return terms.compacted(t, prefixes)
        end = t.rindex('"')
        lex = t[1:end].replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
        tail = t[end + 1 :]
        return f'"{lex}"' + (f"^^{terms.compacted(tail[3:-1], prefixes)}" if tail.startswith("^^") else tail)

    out = [f"@prefix {k}: <{v}> ." for k, v in sorted(prefixes.items())] + [""]
    graphs: dict[str | None, dict[str, dict[str, list[str]]]] = {}
    for s, p, o, *g in rows:
        graphs.setdefault(g[0] if g and g[0] != UNNAMED else None, {}).setdefault(s, {}).setdefault(p, []).append(o)
    for g, subjects in graphs.items():
        body = [f"{shown(s)} " + " ;\n    ".join(f"{'a' if p == terms.RDF_TYPE else shown(p)} {', '.join(map(shown, os))}" for p, os in ps.items()) + " ." for s, ps in subjects.items()]
        out += body if g is None else [f"{shown(g)} {{", *body, "}"]
    return "\n".join(out) + "\n"


def json_ld(rows: list[tuple]) -> list[dict]:
    """Expanded JSON-LD of a page of (s, p, o)."""
    nodes: dict[str, dict] = {}
    for s, p, o, *_ in rows:
        node = nodes.setdefault(s, {"@id": s})
        if p == terms.RDF_TYPE:
            node.setdefault("@type", []).append(o)
        elif o.startswith('"'):
            end = o.rindex('"')
            value, tail = {"@value": o[1:end]}, o[end + 1 :]
            if tail.startswith("@"):
                value["@language"] = tail[1:]
            elif tail:
                value["@type"] = tail[3:-1]
            node.setdefault(p, []).append(value)
        else:
            node.setdefault(p, []).append({"@id": o})
    return list(nodes.values())
