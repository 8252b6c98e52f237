"""Building bundles from a configuration."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession

from quadrille.functions.errors import QueryError
from quadrille.operators.graph import Graph
from quadrille.sources import bundle, ntriples
from quadrille.sources.mapping import UNION, UNNAMED

KINDS = ("source", "derived", "entailment")


@dataclass
class BuildConfig:
    dataset: str
    version: str
    inputs: list[str]
    output: str
    prefixes: dict[str, str] = field(default_factory=dict)
    roles: dict[str, list[str]] = field(default_factory=dict)
    components: list[dict] = field(default_factory=list)

    @classmethod
    def of(cls, values: dict) -> "BuildConfig":
        """Checked: unknown keys, empty inputs and malformed components are refused."""
        known = {f.name for f in fields(cls)}
        if set(values) - known:
            raise QueryError("unknown_parameter", f"unknown keys {sorted(set(values) - known)}")
        missing = [k for k in ("dataset", "version", "inputs", "output") if not values.get(k)]
        if missing:
            raise QueryError("malformed_request", f"missing {missing}")
        out = cls(**values)
        for c in out.components:
            if c.get("kind") not in KINDS or not c.get("id") or c.get("graph") in (UNION, None):
                raise QueryError("malformed_request", f"a component has an id, a kind of {KINDS} and a graph: {c}")
        if len({c["id"] for c in out.components}) != len(out.components):
            raise QueryError("malformed_request", "a component's id stands once")
        return out


def check_config(text: str) -> list[str]:
    """What is wrong with a configuration, as JSON text; nothing is read or written."""
    try:
        values = json.loads(text)
    except ValueError as e:
        return [f"no JSON: {e}"]
    if not isinstance(values, dict):
        return ["a configuration is an object"]
    try:
        BuildConfig.of(values)
    except QueryError as e:
        return [str(e)]
    return []


def build(spark: SparkSession, config: BuildConfig, dry_run: bool = False) -> list[str]:
    """Read the inputs and publish a bundle; a dry run only says what would be done."""
    target = f"{config.output.rstrip('/')}/{config.dataset}/{config.version}"
    steps = [f"read {i}" for i in config.inputs] + [f"publish {target}"]
    if dry_run:
        return steps
    memberships = propositions = None
    for path in config.inputs:
        m, p = ntriples.read(spark, path)
        memberships = m if memberships is None else memberships.union(m)
        propositions = p if propositions is None else propositions.union(p)
    memberships, propositions = memberships.distinct(), propositions.distinct()
    named = not memberships.filter(memberships["g"] != UNNAMED).isEmpty()
    graph = Graph(memberships.select("s", "p", "o").distinct(), memberships if named else None, None if propositions.isEmpty() else propositions, config.prefixes, config.roles)
    bundle.publish(graph, target, bundle.Manifest(config.dataset, config.version, components=config.components))
    return steps
