"""Incremental ingest of RDF lines. The operations themselves are batch plans."""
