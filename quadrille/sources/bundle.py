"""Bundles: immutable folders of Parquet tables with a manifest that is written last.

Triples are written three times, range-partitioned and sorted by (p, s, o), (s, p, o) and (o, p, s), so
a bound predicate, subject or object reads few row groups; the last has digests for long objects, as one
that is bound is known to who asks. Beside them lie what operations would else
make anew for each request: the terms with their roles, section and id, the statistics of every view, and
an inverted index of the words of literals, which it names by their ids: a text is not written again for
each of its words. Files of a shuffle go as soon as the table that they were for is written. A publisher writes below a folder of its own, which the
manifest names, so tables are never overwritten. Files and manifest go through Spark's file system,
so a bundle may lie in any store Spark reads.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms
from quadrille.functions.errors import QueryError
from quadrille.operators import search, stats
from quadrille.operators.graph import Graph

CAPABILITIES = {"triples": ["fragment", "count", "describe", "sample", "distinct", "bindings", "labels", "search", "verbalize"], "memberships": ["graphs", "quads"], "propositions": ["statement-terms"], "stats": ["schema", "void", "summary"], "terms": ["terms"], "postings": ["text-index"]}
TABLES = ("triples", "by_subject", "by_object", "memberships", "propositions", "terms", "stats", "postings", "corpus")


@dataclass
class Manifest:
    dataset: str
    version: str
    prefixes: dict[str, str] = field(default_factory=dict)
    roles: dict[str, list[str]] = field(default_factory=dict)
    components: list[dict] = field(default_factory=list)
    tables: dict[str, str] = field(default_factory=dict)  # name: digest of its rows
    folder: str = ""  # that of the tables, below the bundle's

    @property
    def content_digest(self) -> str:
        """A hash over the sorted names and digests of the tables."""
        return hashlib.sha256("".join(f"{n}  {d}\n" for n, d in sorted(self.tables.items())).encode()).hexdigest()

    @property
    def capabilities(self) -> list[str]:
        return sorted({c for t, own in CAPABILITIES.items() if t in self.tables for c in own})

    def to_json(self) -> str:
        return json.dumps({**self.__dict__, "content_digest": self.content_digest, "capabilities": self.capabilities}, indent=1, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "Manifest":
        got = json.loads(text)
        digest, _ = got.pop("content_digest"), got.pop("capabilities")
        out = cls(**got)
        if out.content_digest != digest:
            raise QueryError("malformed_request", "the manifest's digest does not agree with its tables")
        return out


def merged_prefixes(*layers: dict[str, str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for layer in layers:
        out |= layer
    return out


def rows_digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order or files."""
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)))
    n, x, s = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n} {x} {s}".encode()).hexdigest()


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or a local one where all runs here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise QueryError("malformed_request", "set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    system, p = _fs(spark, path)
    out = system.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Within it the files of a shuffle are deleted when its query has ended, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def publish(graph: Graph, path: str, manifest: Manifest, parts: int | None = None) -> Manifest:
    """Write the graph's tables and then the manifest. An existing bundle is refused."""
    spark = graph.spark
    system, p = _fs(spark, f"{path}/manifest.json")
    if system.exists(p):
        raise QueryError("malformed_request", "a bundle is there already; versions are not changed")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest.folder = f"tables-{uuid.uuid4().hex}"

    def write(name: str, df: DataFrame, mode: str = "error") -> DataFrame:
        df.write.mode(mode).option("compression", "zstd").option("parquet.writer.version", "v2" if name == "postings" else "v1").parquet(f"{path}/{manifest.folder}/{name}")
        back = spark.read.parquet(f"{path}/{manifest.folder}/{name}")
        manifest.tables[name] = rows_digest(back)
        return back

    def ordered(df: DataFrame, *by: str) -> DataFrame:
        return df.repartitionByRange(n, *by).sortWithinPartitions(*by)

    with _shuffles_dropped(spark):
        held = write("triples", ordered(graph.whole, "p", "s", "o"))
        # what is made from the triples is made from the published ones; what takes most shuffling comes first
        memberships = write("memberships", ordered(graph.memberships, "g", "p", "s", "o")) if graph.quads_given else None
        propositions = write("propositions", graph.propositions) if graph.propositions is not None else None
        own = Graph(held, memberships, propositions, graph.prefixes, graph.roles)
        # a literal's id is a hash of as many bits as tell so many apart, salted anew until no two share one
        bits = min(63, 2 * own.triples.count().bit_length() + 3)
        for salt in itertools.count():
            ids = F.when(F.col("term").startswith('"'), F.shiftrightunsigned(F.xxhash64(F.lit(salt), "term"), 64 - bits))
            found = write("terms", search.sized(ordered(own.terms().withColumn("id", ids), "term")), "overwrite")
            if found.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
                break
        write("by_subject", ordered(held, "s", "p", "o"))
        literals = found.filter("size IS NOT NULL")
        write("corpus", search.corpus(literals))
        write("postings", search.postings(literals, n))
        write("stats", stats.all_views(own, manifest.components).repartitionByRange(n, "view", "kind", "class", "predicate"))
        # read by a bound object only, which a request knows as a whole
        write("by_object", ordered(held.withColumn("o", terms.brief(F.col("o"))), "o", "p", "s"))
    manifest.prefixes, manifest.roles = graph.prefixes, graph.roles
    _write_text(spark, f"{path}/manifest.json", manifest.to_json())
    return manifest


def manifest(spark: SparkSession, path: str) -> Manifest:
    system, p = _fs(spark, f"{path}/manifest.json")
    if not system.exists(p):
        raise QueryError("not_found", f"{path} holds no whole bundle")
    return Manifest.from_json(_read_text(spark, f"{path}/manifest.json"))


def open_bundle(spark: SparkSession, path: str) -> Graph:
    """The graph of a bundle: patterns read the copy that suits them, other operations the tables made for them."""
    m = manifest(spark, path)
    tables = {t: spark.read.parquet(f"{path}/{m.folder}/{t}") for t in m.tables}
    copies = {k: tables[t] for k, t in (("s", "by_subject"), ("o", "by_object")) if t in tables}
    return Graph(tables["triples"], tables.get("memberships"), tables.get("propositions"), m.prefixes, m.roles, m.content_digest, copies=copies, published=tables)


def described(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the published statistics that the published triples do not bear out, read back from their VoID: none, if all is well."""
    g = open_bundle(spark, path)
    return stats.verified(Graph(g.triples), stats.as_void(g.tables["stats"].filter("view = 'design'")))


def check(spark: SparkSession, path: str) -> list[str]:
    """Names of tables whose rows are not what the manifest says."""
    m = manifest(spark, path)
    return [t for t, d in sorted(m.tables.items()) if rows_digest(spark.read.parquet(f"{path}/{m.folder}/{t}")) != d]


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, version, path, capabilities, digest) of the bundles at root/<dataset>/<version>."""
    rows = []
    system, p = _fs(spark, root)
    for d in system.listStatus(p) if system.exists(p) else []:
        for v in system.listStatus(d.getPath()) if d.isDirectory() else []:
            at = v.getPath().toString()
            if v.isDirectory() and system.exists(_fs(spark, f"{at}/manifest.json")[1]):
                m = Manifest.from_json(_read_text(spark, f"{at}/manifest.json"))
                rows.append((m.dataset, m.version, at, ",".join(m.capabilities), m.content_digest))
    return spark.createDataFrame(sorted(rows), "dataset string, version string, path string, capabilities string, digest string")
