"""Inline tables: the VALUES clause of SPARQL, and JSON bindings, to (variables, rows)."""

from __future__ import annotations

import re

from quadrille.functions import terms
from quadrille.functions.errors import BINDINGS_CAP, QueryError

_TOKEN = re.compile(
    r"""\s*(?:(?P<mark>[(){}])|(?P<var>[?$][A-Za-z_]\w*)|(?P<undef>UNDEF\b)|(?P<values>VALUES\b)
    |(?P<term><<\(.*?\)>>|<[^<>\s]*>|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^(?:<[^<>\s]*>|[\w.-]*:[\w.-]*))?|[A-Za-z][\w.-]*:[\w.-]*|:[\w.-]+)|(?P<number>[+-]?\d+(?:\.\d+)?))""",
    re.X | re.I | re.S,
)


def parse_values(text: str, prefixes: dict[str, str] | None = None) -> tuple[list[str], list[list[str | None]]]:
    """Variables and rows of ``VALUES ?x { a b }`` or ``VALUES (?x ?y) { (a b) (UNDEF c) }``."""
    found, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError("malformed_request", f"a VALUES table does not read {text[at:at + 20]!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    queue = found[::-1]

    def take(kind: str, value: str | None = None) -> str:
        if not queue or queue[-1][0] != kind or value is not None and queue[-1][1] != value:
            raise QueryError("malformed_request", f"a VALUES table lacks {value or kind}")
        return queue.pop()[1]

    def cell() -> str | None:
        if not queue:
            raise QueryError("malformed_request", "a VALUES table ends early")
        kind, value = queue.pop()
        if kind == "undef":
            return None
        if kind == "number":
            return f'"{value}"^^<http://www.w3.org/2001/XMLSchema#{"decimal" if "." in value else "integer"}>'
        if kind != "term":
            raise QueryError("malformed_request", f"{value!r} is no term")
        terms.parse(value, prefixes)
        return value

    take("values")
    names, rows, wide = [], [], bool(queue) and queue[-1] == ("mark", "(")
    if wide:
        take("mark", "(")
        while queue and queue[-1][0] == "var":
            names.append(take("var")[1:])
        take("mark", ")")
    else:
        names.append(take("var")[1:])
    if len(set(names)) != len(names):
        raise QueryError("malformed_request", "a variable stands twice")
    take("mark", "{")
    while queue and queue[-1] != ("mark", "}"):
        if wide:
            take("mark", "(")
            row = []
            while queue and queue[-1] != ("mark", ")"):
                row.append(cell())
            take("mark", ")")
        else:
            row = [cell()]
        if len(row) != len(names):
            raise QueryError("malformed_request", "a row has as many terms as there are variables")
        rows.append(row)
        if len(rows) > BINDINGS_CAP:
            raise QueryError("cap_exceeded", f"over {BINDINGS_CAP} rows")
    take("mark", "}")
    if queue:
        raise QueryError("malformed_request", "something follows the VALUES table")
    return names, rows


def normalized_rows(rows: list[list[str | None]]) -> list[list[str | None]]:
    """Rows without repeats and without those that another row subsumes."""
    distinct = list(dict.fromkeys(map(tuple, rows)))

    def covers(a: tuple, b: tuple) -> bool:
        return a != b and all(x is None or x == y for x, y in zip(a, b))

    return [list(r) for r in distinct if not any(covers(o, r) for o in distinct)]
