"""Refusals. A request is answered or refused with a code; nothing in it is ignored."""


class QueryError(ValueError):
    """A refused request; ``code`` is one of a closed set."""

    CODES = frozenset({"bad_term_syntax", "malformed_request", "cap_exceeded", "stale_cursor", "unknown_parameter", "unsupported", "not_found"})

    def __init__(self, code: str, message: str):
        if code not in self.CODES:
            raise AssertionError(code)
        super().__init__(f"{code}: {message}")
        self.code = code


#: Rows a page holds if nothing is said, and at most.
PAGE, PAGE_CAP = 100, 10_000
BINDINGS_CAP, SAMPLE_CAP, SEARCH_CAP, LABELS_CAP, LANGS_CAP, ROOTS_CAP, PREDICATES_CAP = 1_000, 1_000, 1_000, 10_000, 16, 100, 128


def limited(value: int | None, default: int = PAGE, cap: int = PAGE_CAP) -> int:
    if value is None:
        return default
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise QueryError("malformed_request", f"a limit is a whole number from 1 on, not {value!r}")
    if value > cap:
        raise QueryError("cap_exceeded", f"{value} is over the cap of {cap}")
    return value
