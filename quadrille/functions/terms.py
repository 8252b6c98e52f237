"""RDF terms in dictionary syntax: parsing on the driver, and columns over stored terms.

A stored term is one string: an IRI bare, a blank node ``_:label``, a literal ``"lex"``, ``"lex"@tag``
or ``"lex"^^<datatype>`` with its lexical form unescaped. A statement term is stored as its id and
looked up in the table of propositions. Tags are lower-cased and xsd:string folds to a plain literal,
so equal terms are equal strings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.errors import QueryError

XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE, RDF_REIFIES, RDF_LANG, RDF_DIR_LANG = RDF + "type", RDF + "reifies", RDF + "langString", RDF + "dirLangString"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
DEPTH_CAP = 16

_TAG = re.compile(r"[A-Za-z]{1,8}(?:-[A-Za-z0-9]{1,8})*(?:--(?:ltr|rtl))?\Z")
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_CURIE = re.compile(r"([A-Za-z][\w.-]*)?:(.*)\Z", re.S)


@dataclass(frozen=True)
class Term:
    """A term of a request. kind: iri, blank, literal, triple or variable."""

    kind: str
    value: str = ""
    lang: str | None = None
    datatype: str | None = None
    parts: tuple["Term", "Term", "Term"] | None = None

    def stored(self) -> str:
        if self.kind == "iri":
            return self.value
        if self.kind == "blank":
            return "_:" + self.value
        if self.kind == "literal":
            return literal(self.value, self.lang, self.datatype)
        raise QueryError("bad_term_syntax", f"a {self.kind} has no dictionary syntax")

    def ground(self) -> bool:
        return all(p.ground() for p in self.parts) if self.parts else self.kind != "variable"


def literal(lex: str, lang: str | None = None, datatype: str | None = None) -> str:
    if lang is not None:
        return f'"{lex}"@{lang.lower()}'
    if datatype is not None and datatype != XSD_STRING:
        return f'"{lex}"^^<{datatype}>'
    return f'"{lex}"'


def unescaped(body: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            point = int(m[1] or m[2], 16)
            if point > 0x10FFFF or 0xD800 <= point < 0xE000:
                raise QueryError("bad_term_syntax", "an escape names no character")
            return chr(point)
        if m[3] not in _PLAIN_ESCAPES:
            raise QueryError("bad_term_syntax", f"\\{m[3]} is no escape")
        return _PLAIN_ESCAPES[m[3]]

    return _ESCAPE.sub(one, body)


class _Reader:
    """Reads one term of request syntax from a text."""

    def __init__(self, text: str, prefixes: dict[str, str], explicit: bool, variables: bool):
        self.text, self.at, self.prefixes, self.explicit, self.variables = text, 0, prefixes, explicit, variables

    def fail(self, why: str):
        raise QueryError("bad_term_syntax", f"{why} in {self.text!r}")

    def blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def until(self, end: str) -> str:
        stop = self.text.find(end, self.at)
        if stop < 0:
            self.fail(f"{end!r} is missing")
        out, self.at = self.text[self.at : stop], stop + len(end)
        return out

    def token(self) -> str:
        start = self.at
        while self.at < len(self.text) and not self.text[self.at].isspace():
            self.at += 1
        return self.text[start : self.at]

    def term(self, depth: int = 0) -> Term:
        if depth > DEPTH_CAP:
            self.fail(f"terms nest deeper than {DEPTH_CAP}")
        t = self.text
        if t.startswith("<<(", self.at):
            self.at += 3
            parts = []
            for _ in range(3):
                self.blanks()
                parts.append(self.term(depth + 1))
            self.blanks()
            if not t.startswith(")>>", self.at):
                self.fail("')>>' is missing")
            self.at += 3
            if parts[0].kind in ("literal", "triple"):
                self.fail("a statement's subject is an IRI or a blank node")
            if parts[1].kind not in ("iri", "variable"):
                self.fail("a statement's predicate is an IRI")
            return Term("triple", parts=tuple(parts))
        if t.startswith("<", self.at) and not self.explicit:
            self.at += 1
            return self.iri(self.until(">"))
        if t.startswith('"', self.at):
            return self.literal()
        if t.startswith("?", self.at) and self.variables:
            self.at += 1
            name = self.token().rstrip(")")
            return Term("variable", name)
        if t.startswith("_:", self.at):
            return Term("blank", self.token()[2:])
        word = self.token() if depth else t[self.at :]
        if not depth:
            self.at = len(t)
        if self.explicit:
            if not word or any(c.isspace() for c in word):
                self.fail("an IRI has no blanks")
            return Term("iri", word)
        m = _CURIE.match(word)
        if not m or any(c.isspace() for c in word):
            self.fail("a term is <iri>, prefix:name, a quoted literal or a statement")
        if (m[1] or "") not in self.prefixes:
            self.fail(f"the prefix {m[1] or ''!r} is not declared")
        return self.iri(self.prefixes[m[1] or ""] + m[2])

    def iri(self, value: str) -> Term:
        if not value:
            self.fail("an IRI is not empty")
        return Term("iri", unescaped(value) if "\\" in value else value)

    def literal(self) -> Term:
        start = self.at = self.at + 1
        while self.at < len(self.text) and self.text[self.at] != '"':
            self.at += 2 if self.text[self.at] == "\\" else 1
        if self.at >= len(self.text):
            self.fail("a literal does not end")
        lex = unescaped(self.text[start : self.at])
        self.at += 1
        if self.text.startswith("@", self.at):
            self.at += 1
            start = self.at
            while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] == "-"):
                self.at += 1
            tag = self.text[start : self.at]
            if not _TAG.match(tag):
                self.fail("the language tag is malformed")
            return Term("literal", lex, lang=tag.lower())
        if self.text.startswith("^^", self.at):
            self.at += 2
            if self.text.startswith("<", self.at):
                self.at += 1
                kind = self.until(">")
            else:
                kind = _Reader(self.token(), self.prefixes, self.explicit, False).term().value
            if kind in (RDF_LANG, RDF_DIR_LANG):
                self.fail("a language string needs a tag")
            return Term("literal", lex, datatype=None if kind == XSD_STRING else kind)
        return Term("literal", lex)


def parse(text: str, prefixes: dict[str, str] | None = None, explicit: bool = False, variables: bool = False) -> Term:
    """One term of request syntax; explicit: bare IRIs and no prefixes; variables: ?name inside statements."""
    r = _Reader(text, prefixes or {}, explicit, variables)
    r.blanks()
    out = r.term()
    r.blanks()
    if r.at != len(text):
        r.fail("something follows the term")
    return out


def compacted(iri: str, prefixes: dict[str, str]) -> str:
    """prefix:name by the longest namespace that the IRI begins with, else <iri>."""
    best = max((ns for ns in prefixes.values() if iri.startswith(ns)), key=len, default=None)
    if best is None or not re.fullmatch(r"[\w.-]*", iri[len(best) :]):
        return f"<{iri}>"
    return f"{min(k for k, v in prefixes.items() if v == best)}:{iri[len(best):]}"


# -- columns -----------------------------------------------------------------------------------


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def is_blank(c: Column) -> Column:
    return c.startswith("_:")


def is_iri(c: Column) -> Column:
    return ~is_literal(c) & ~is_blank(c)


#: Characters up to which a term stands for itself where terms are only told apart.
BRIEF = 96


def brief(c: Column) -> Column:
    """The term, or of a long one its digest: a quote that does not end, so no other term is equal to it."""
    return F.when(F.length(c) <= BRIEF, c).otherwise(F.concat(F.lit('"'), F.sha2(c, 256)))


def _suffix(c: Column) -> Column:
    """What follows the closing quote, which is the last one: neither tags nor datatypes hold quotes."""
    return F.regexp_extract(F.substring_index(c, '"', -1), r"^((?:@[A-Za-z0-9-]+|\^\^<[^<>\"]*>)?)$", 1)


def lexical(c: Column) -> Column:
    """The lexical form of a literal, else null."""
    tail = F.substring_index(c, '"', -1)
    end = F.length(c) - F.length(tail)  # that of the closing quote
    whole = (end >= 2) & ((tail == "") | tail.rlike(r"^(?:@[A-Za-z0-9-]+|\^\^<[^<>\"]*>)$"))
    return F.when(is_literal(c), F.when(whole, F.substr(c, F.lit(2), end - 2)).otherwise(""))


def language(c: Column) -> Column:
    """The tag of a literal that has one, else null."""
    s = _suffix(c)
    return F.when(is_literal(c) & s.startswith("@"), F.substr(s, F.lit(2)))


def datatype(c: Column) -> Column:
    """The datatype IRI of a literal, else null."""
    s = _suffix(c)
    return F.when(is_literal(c), F.when(s.startswith("^^"), F.regexp_extract(s, r"^\^\^<(.*)>$", 1)).when(s.contains("--"), RDF_DIR_LANG).when(s.startswith("@"), RDF_LANG).otherwise(XSD_STRING))


def ntriples(c: Column) -> Column:
    """The term in N-Triples syntax."""
    escaped = lexical(c)
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        escaped = F.replace(escaped, F.lit(old), F.lit(new))
    return F.when(is_literal(c), F.concat(F.lit('"'), escaped, F.lit('"'), _suffix(c))).when(is_blank(c), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


SKOLEM = "urn:x-quadrille:bnode:v1:sha256:"


def skolemized(c: Column, scope: str) -> Column:
    """Blank nodes as IRIs of their graph's scope, other terms as they are: how nodes are published."""
    return F.when(is_blank(c), F.concat(F.lit(SKOLEM), F.sha2(F.concat(F.lit(scope + "\t"), c), 256))).otherwise(c)


def as_json(c: Column) -> Column:
    """{"type", "value"} with "lang" or "datatype" for literals that have them."""
    kind = F.when(is_literal(c), "literal").when(is_blank(c), "bnode").otherwise("iri")
    own = F.when(datatype(c) != XSD_STRING, datatype(c))
    tag = language(c)
    return F.to_json(F.struct(kind.alias("type"), F.coalesce(lexical(c), F.when(is_blank(c), F.substr(c, F.lit(3))), c).alias("value"), tag.alias("lang"), F.when(tag.isNull(), own).alias("datatype")))
