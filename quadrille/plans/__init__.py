"""The registry of queries, filled on import."""

from quadrille.plans import queries  # noqa: F401
