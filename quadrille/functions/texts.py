"""Readable names and stable scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def normalized(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def humanized(c: Column) -> Column:
    """Underscores and hyphens as spaces, and a space where a capital follows a small letter."""
    return normalized(F.regexp_replace(F.regexp_replace(c, "[_-]", " "), r"(?<=\p{Ll})(?=\p{Lu})", " "))


def fragment(c: Column) -> Column:
    """What follows the last "#", else the last "/", else all."""
    return F.when(c.contains("#"), F.substring_index(c, "#", -1)).when(c.contains("/"), F.substring_index(c, "/", -1)).otherwise(c)


def fallback_label(c: Column) -> Column:
    return humanized(fragment(c))


def stable_score(root: Column, predicate: Column, value: Column) -> Column:
    """A hash of the three strings; its hexadecimal form sorts as its bytes do."""
    return F.sha2(F.concat_ws("\t", root, predicate, value), 256)


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def language_matches(tag: Column, wanted: str) -> Column:
    """Basic filtering: whole subtags, any case; "*" is any tag."""
    if wanted == "*":
        return tag.isNotNull()
    w = wanted.lower()
    return (F.lower(tag) == w) | F.lower(tag).startswith(w + "-")


def url_encoded(c: Column) -> Column:
    """A term as a part of a URL: all but letters, digits, "-", ".", "_" and "~" as percent signs and hexadecimal."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
