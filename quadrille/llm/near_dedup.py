"""Near-duplicate documents by bottom-k sketches of one hash function.

Method
    A document's set is its distinct word shingles, hashed by one 64-bit function. Its sketch is
    the k smallest hashes. Of the k smallest values of two sets' union, those that both have are in both
    sketches. A set of n values and any set of similarity t or more have a union of at most n / t
    values; so both sketches hold c(n) values in common, or more, but for a chance of ``MISS`` (1e-8), by the
    hypergeometric distribution. Where the union is retained whole they share the part t, for certain.

    Inverted lists hold retained values. Of a sketch, only its rarest values enter them, as many as
    make it certain that two sketches with c values in common meet in LEAST lists: all but the c - LEAST
    most frequent. The order is by the exact number of sketches that retain a value, so a value
    that very many documents retain (a passage they share) stands last and is in few lists. A value
    that one sketch alone retains is in none. The lists generate the overlaps: pairs of documents with
    the number of lists they meet in. Pairs with fewer than LEAST are no near duplicates; the others are
    filtered by the estimate from the union's sketch, and what is left is verified on the full sets.

    Sets that are equal are one vertex from the start. Lists are first compared as stars: each
    member against the one that stands in the longest lists, so the middle of its group. Then the
    members that these links have not joined are compared with the members of other labels, so no pair
    of a list is lost, and a group of n near copies costs some n comparisons. Components follow.

    Copies that are just under the threshold to the middle stay unjoined and fill long lists. There a
    member x is compared with the centre c of its group on the full sets, which splits x into the s values
    that c has and the rest. Near duplicates x and z of one group share a values or more by their sizes, and
    no more than the smaller s of them lie in c. So either both s reach a, which few sizes allow, or x and
    z meet in an inverted list of values that c does not have. Both kinds of pairs are generated
    without chance, and no others of the group; pairs across groups come from the long list as before.

Defined results
    * null, empty and blank texts: n_shingles 0, linked with nothing, their own component.
    * null ids: the row is kept with its n_shingles, component_id null, kept false; no links.
    * rows that share an id are one vertex; each row gets that vertex's component.
    * an empty table gives an empty result; other columns of the table are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bounded_batches, drop_written, ids_and_texts, scratch_root, written

MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Odd multipliers for the places of a shingle are powers of this one.
PLACE = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1
#: Entries a worker's word cache may hold before it starts anew.
CACHE_WORDS = 200_000
#: Ids that may be sent to every executor.
BROADCAST_IDS = 1_000_000
EDGES_A_TASK = 100_000
#: Retained values of a sketch; chance that a pair at the threshold shares fewer of them than is asked.
SKETCH, MISS = 256, 1e-8
#: Lists that a pair must meet in.
LEAST = 2
#: Members outside a list's most frequent label from which on its pairs come by way of groups' centres.
OUTSIDERS = 8
#: Parts that the members of one centre are dealt into where its text is joined.
DEALS = 16
#: Steps of the table of shares.
STEPS = 500


class WordHashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes, as signed 64-bit numbers, of the text's shingles of ``size`` words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(size, len(w))
    out = np.zeros(len(w) - span + 1, np.uint64)
    out += np.uint64(span)
    place = 1
    for j in range(span):
        place = place * PLACE & M64
        out += w[j : len(w) - span + 1 + j] * np.uint64(place)
    out ^= out >> np.uint64(30)
    out *= MIX[0]
    out ^= out >> np.uint64(27)
    out *= MIX[1]
    out ^= out >> np.uint64(31)
    return np.unique(out.view(np.int64))


@lru_cache(maxsize=50_000)
def fewest_shared(n: int, num: int, den: int, k: int, miss: float = MISS) -> int:
    """c(n): what a sketch of a set of n values shares at least with those of near duplicates.

    The largest union has n * den / num values, of which the least shared part is hit by k draws.
    """
    least, union = -(-num * n // den), n * den // num
    if union <= k:
        return least
    shared = -(-num * union // den)
    pairs = math.lgamma(union + 1) - math.lgamma(k + 1) - math.lgamma(union - k + 1)

    def ways(m: int, r: int) -> float:
        return math.lgamma(m + 1) - math.lgamma(r + 1) - math.lgamma(m - r + 1)

    chance = 0.0
    for c in range(max(0, k - (union - shared)), min(k, shared) + 1):
        chance += math.exp(ways(shared, c) + ways(union - shared, k - c) - pairs)
        if chance > miss:
            return min(c, least)
    return min(k, least)


def pair_table(k: int, miss: float = MISS) -> list[int]:
    """At r: of k draws, each hit with chance r / STEPS at least, fewer than this are hit with chance miss / 2 at most."""
    out = []
    for r in range(STEPS + 1):
        p, chance, c = r / STEPS, 0.0, 0
        while c < k and (chance := chance + math.comb(k, c) * p**c * (1 - p) ** (k - c)) <= miss / 2:
            c += 1
        out.append(c)
    return out


def _asked(x: str, y: str, num: int, den: int, k: int):
    """How many values the sketches of near duplicates with nx and ny values share at least.

    The sets share i >= num (nx + ny) / (num + den) values. A sketch is a random part of its set, so the number
    of its values that the other set has follows the hypergeometric distribution; of the sketch that
    ends first, all of these are in the other sketch too.
    """
    both = F.expr(f"int(({num} * ({x} + {y}) + {num + den - 1}) div {num + den})")
    table = F.split(F.lit(",".join(map(str, pair_table(k)))), ",").cast("array<int>")
    drawn = F.get(table, F.least(F.lit(STEPS), F.expr(f"int({STEPS} * {num} * ({x} + {y}) div ({num + den} * greatest({x}, {y})))")))
    return F.when(F.greatest(x, y) <= k, both).otherwise(F.least(both, drawn))


def _sketcher(shingle: int, k: int, num: int, den: int):
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ns, needs, hi, lo, kept, at = [], [], [], [], [], [0]
            for text in batch.column(1):
                values = shingle_set(text.as_py(), shingle, hashes)
                digest = xxhash.xxh3_128_intdigest(values.tobytes())
                ns.append(len(values))
                needs.append(fewest_shared(len(values), num, den, k))
                hi.append(digest >> 64)
                lo.append(digest & M64)
                kept.append(values[:k])
                at.append(at[-1] + min(k, len(values)))
            flat = np.concatenate(kept) if kept else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ns, pa.int64()),
                    pa.array(needs, pa.int32()),
                    pa.array(np.array(hi, np.uint64).view(np.int64)),
                    pa.array(np.array(lo, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)),
                ],
                ["id", "n", "need", "hi", "lo", "sketch"],
            )

    return sketches


def _lists(nodes: DataFrame) -> DataFrame:
    """(value, node, n, at, left, rest, size): the rarest retained values of each sketch, with how many sketches retain them.

    at is the value's place among them, left how many values of the sketch stand from this one on, in the
    order from rare to frequent, and rest how many of the sketch are in no list.
    """
    entries = nodes.select(F.explode("sketch").alias("value"), "node")
    common = nodes.select(F.explode("sketch").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = entries.join(common, "value")
    # one sketch's values: SKETCH at most
    ranked = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("size", "value"))).alias("found"))
    sizes = nodes.select("node", "n", F.size("sketch").alias("k"), "need")
    # values retained once come before all others; they are shared with none
    most = F.col("k") - F.col("need") + F.lit(LEAST) - (F.col("k") - F.size("found"))
    first = F.slice("found", F.lit(1), F.greatest(F.lit(0), most))
    return ranked.join(sizes, "node").select("node", "n", F.greatest(F.lit(0), F.col("need") - LEAST).alias("rest"), F.size("found").alias("m"), F.posexplode(first).alias("at", "x")).select("x.value", "node", "n", "at", (F.col("m") - F.col("at")).alias("left"), "rest", "x.size")


def _verifier(shingle: int, num: int, den: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = WordHashes(), {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right, ok = batch.column(2), batch.column(3), []
            for k in range(len(a)):
                both = []
                for text in (left[k].as_py(), right[k].as_py()):
                    digest = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                    if digest not in kept:
                        if len(kept) >= 64:
                            kept.pop(next(iter(kept)))
                        kept[digest] = shingle_set(text, shingle, hashes)
                    both.append(kept[digest])
                x, y = both
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared > 0 and den * shared >= num * (len(x) + len(y) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return verify


def _splitter(shingle: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = WordHashes(), {}
        for batch in batches:
            ns, ncs, shared, rests = [], [], [], []
            for own, centre in zip(batch.column(2), batch.column(3)):
                text = centre.as_py()
                digest = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                if digest not in kept:
                    if len(kept) >= 64:
                        kept.pop(next(iter(kept)))
                    kept[digest] = shingle_set(text, shingle, hashes)
                x, c = shingle_set(own.as_py(), shingle, hashes), kept[digest]
                rest = np.setdiff1d(x, c, assume_unique=True)
                ns.append(len(x))
                ncs.append(len(c))
                shared.append(len(x) - len(rest))
                rests.append(rest)
            at = np.cumsum([0, *map(len, rests)])
            flat = np.concatenate(rests) if rests else np.empty(0, np.int64)
            made = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (ns, ncs, shared)), made], ["node", "c", "n", "nc", "s", "rest"])

    return split


def _groups(long: DataFrame, middle: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(node, label, c, n, nc, s, rest) of the members (value, node, label) of long lists.

    c is the centre of most of a member's long lists, nc and n the sizes of both sets, s how many
    values they share, rest the member's others. A node whose id has several texts has no row.
    """
    popular = long.join(middle, "node")
    votes = popular.select("value", "node").join(popular.groupBy("value").agg(F.max(F.struct("pop", "node")).alias("y")), "value")
    chosen = votes.groupBy("node", "y").agg(F.count(F.lit(1)).alias("votes")).groupBy("node").agg(F.max(F.struct("votes", "y")).alias("best"))
    chosen = written(chosen.select("node", F.col("best.y.node").alias("c")), "centres")
    ids = _ends(chosen, "centre-ids", "node", "c")
    texts = _holding(rows, ids)
    # the members of one centre may be very many
    dealt = texts.join(chosen.select(F.col("c").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("c"), F.col("text").alias("tc"), F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    own = chosen.join(texts.select(F.col("id").alias("node"), "text"), "node").withColumn("deal", F.expr(f"int(pmod(hash(node), {DEALS}))"))
    split = own.join(dealt, ["c", "deal"]).select("node", "c", "text", "tc").mapInArrow(_splitter(shingle), "node long, c long, n long, nc long, s long, rest array<long>")
    found = F.struct("c", "n", "nc", "s", "rest")
    sole = split.groupBy("node").agg(F.min(found).alias("x"), F.max(found).alias("z")).filter("x = z").select("node", "x.*")
    out = written(sole.join(long.select("node", "label").distinct(), "node"), "groups")
    drop_written(chosen, ids)
    return out


def _grouped_pairs(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(a, na, b, nb): all pairs of one group and of two labels that can be near duplicates, where not both are near their centre.

    Those near their centre are joined by it. Others have one end x that is not. Each step is written: as
    one plan the driver held the stages of all of them at a time.
    """
    bounds = groups.groupBy("c").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    members = groups.drop("rest").join(bounds, "c").withColumn("joined", F.expr(f"{den} * s >= {num} * (n + nc - s)"))
    # a set of up to reach values can share with x what lies in c alone; sizes of near duplicates of x
    members = members.withColumn("reach", F.expr(f"s * {num + den} div {num} - n")).withColumn("least", F.expr(f"greatest(low, ({num} * n + {den - 1}) div {den})")).withColumn("most", F.expr(f"least(high, {den} * n div {num})"))
    members = written(members, "group-members")
    sides = ["node", "n", "s", "label", "joined", "reach"]
    differ = (F.col("x.label") != F.col("y.label")) & (F.col("y.joined") | (F.col("x.node") < F.col("y.node")))
    less = F.col("x.node") < F.col("y.node")
    ends = [F.when(less, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(n) for p, q, end in (("x", "y", "a"), ("y", "x", "b")) for c, n in (("node", end), ("n", f"n{end}"))]

    tight = members.withColumn("to", F.least("reach", "most")).filter("NOT joined AND least <= to")
    x = tight.select("c", F.explode(F.sequence("least", "to")).alias("size"), F.struct(*sides).alias("x"))
    y = members.select("c", F.col("n").alias("size"), F.struct(*sides).alias("y"))
    inside = written(x.join(y, ["c", "size"]).filter(differ & (F.col("x.n") <= F.col("y.reach"))).select(*ends), "inside")

    entries = groups.select("c", "node", F.explode("rest").alias("value"))
    common = entries.groupBy("c", "value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # a member's values outside its centre: no more than its text has
    ranked = entries.join(common, ["c", "value"]).groupBy("c", "node").agg(F.array_sort(F.collect_list(F.struct("size", "value"))).alias("found"))
    # of a near duplicate's shared values so many at least lie outside c
    asked = F.expr(f"int(greatest(1, ({num} * (n + least) + {num + den - 1}) div {num + den} - s))")
    lists = ranked.join(members.drop("c"), "node")
    lists = lists.withColumn("own", F.transform("found", lambda e: e["value"])).withColumn("first", F.slice("own", F.lit(1), F.greatest(F.lit(0), F.size("own") - asked + 1)))
    held = written(lists.select("c", *sides, "own", "first"), "group-lists")
    lists = held.select("c", F.explode("first").alias("value"), F.struct(*sides, "own").alias("e"))
    x, y = lists.filter("NOT e.joined").withColumnRenamed("e", "x"), lists.withColumnRenamed("e", "y")
    alike = den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")
    enough = F.expr(f"{num + den} * (least(x.s, y.s) + size(array_intersect(x.own, y.own))) >= {num} * (x.n + y.n)")
    outside = written(x.join(y, ["c", "value"]).filter(differ & alike & enough).select(*ends), "outside")
    drop_written(members, held)
    return inside.union(outside)


def _ends(pairs: DataFrame, name: str, *columns: str) -> DataFrame:
    """(id) of what stands in these columns, each once, written: its count then reads no rows, and no plan makes it again."""
    one, *more = (pairs.select(F.col(c).alias("id")) for c in columns)
    for other in more:
        one = one.union(other)
    return written(one.distinct(), name)


def _holding(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with these ids. The ids are counted: up to BROADCAST_IDS (8 MB of longs) are sent to all, more are shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _likely(k: int, num: int, den: int):
    """The filter of a pair by the shared part of the union's bottom-k sketch, from the sketches sa and sb.

    Where the union is retained whole the count is exact; else at least c(n) of its k smallest are shared.
    """
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    whole = (F.col("na") <= k) & (F.col("nb") <= k) & (F.size(F.array_union("sa", "sb")) <= k)
    return F.when(whole, shared * den >= F.size(union) * num).otherwise(shared >= F.greatest("ca", "cb"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) for edges (a, b): the smallest vertex of each component, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        above = parent.setdefault(x, x)
        while above != x:
            parent[x] = parent[above]
            x = parent[x]
            above = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "label"])


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label): the smallest vertex of each vertex's component, for edges (a, b), which are read twice.

    Up to EDGES_A_TASK edges are joined by one task. More are dealt out, and large and small stars alternate;
    every step is a grouped minimum and a join, and each round's edges are written, so a lost executor
    costs one round.
    """
    edges = edges.filter("a != b").select("a", "b")
    if edges.count() <= EDGES_A_TASK:
        return written(edges.coalesce(1).mapInArrow(_forest, "node long, label long"), name)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.filter("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.filter("v > u AND v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            moved = joined.filter("v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
            out = moved.union(least.filter("u != m").select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    # links are few beside rows, and no round has more edges than the one before
    spread = min(parts, max(4, edges.count() // EDGES_A_TASK))
    e = written(edges.coalesce(spread), name)
    before = mark(e)
    while before[0]:
        last, e = e, written(star(star(e, True), False).coalesce(spread), name)
        drop_written(last)
        now = mark(e)
        if now == before:
            break
        before = now
    return e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")).union(e.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: tuple[int, int] = (80, 100),
    k: int = SKETCH,
) -> DataFrame:
    """Return (id, n_shingles, component_id, kept), one row for each row of docs.

    threshold is the similarity as (numerator, denominator); k is the size of the sketches.
    """
    spark = docs.sparkSession
    scratch_root(spark)
    bounded_batches(spark)
    num, den = threshold
    rows = ids_and_texts(docs, id_col, text_col)
    made = rows.mapInArrow(_sketcher(shingle, k, num, den), "id long, n long, need int, hi long, lo long, sketch array<long>")
    made = written(made, "sketches")
    nodes = written(
        made.filter("n > 0 AND id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("need").alias("need"), F.first("sketch").alias("sketch")),
        "classes",
    )
    members = written(
        made.select("id", "n", "hi", "lo").join(nodes.select("hi", "lo", "node"), ["hi", "lo"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("node")).alias("node")),
        "members",
    )
    # an id with several texts joins their classes
    several = members.filter("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z")
    same_id = None
    if not several.isEmpty():
        same_id = written(members.filter("node IS NOT NULL").join(several.select("id", "a"), "id").filter("node != a").select("a", F.col("node").alias("b")), "same-id")

    drop_written(made)
    lists = written(_lists(nodes), "lists")
    sketch = nodes.select(F.col("node").alias("id"), "need", "sketch")

    asked = _asked("x.n", "y.n", num, den, k)
    less = F.col("x.node") < F.col("y.node")
    ends = [F.when(less, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(n) for p, q, end in (("x", "y", "a"), ("y", "x", "b")) for c, n in (("node", end), ("n", f"n{end}"))]
    alike = den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")

    def starred(pairs: DataFrame) -> DataFrame:
        """Pairs (a, na, b, nb) of a list's member x and its middle y, to those that meet in enough lists.

        At one of the first LEAST values that near duplicates share, enough of both sketches is left.
        """
        near = alike & (F.least("x.left", "y.left") + (LEAST - 1) >= asked) & (F.col("x.node") != F.col("y.node"))
        met = pairs.filter(near).select(*ends).groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("lists"))
        return met.filter(F.col("lists") >= F.least(F.lit(LEAST), _asked("na", "nb", num, den, k))).drop("lists")

    def crossed(pairs: DataFrame, *also) -> DataFrame:
        """Pairs (a, na, b, nb) of members x and y of lists, each from the first list that they meet in alone.

        Their overlap is the lists they meet in and, at most, what either has in no list.
        """
        first = ~F.arrays_overlap(F.slice("x.own", F.lit(1), F.col("x.at")), F.slice("y.own", F.lit(1), F.col("y.at")))
        overlap = F.size(F.array_intersect("x.own", "y.own"))
        near = alike & (F.least("x.left", "y.left") >= asked)
        for c in also:
            near = near & c
        enough = (overlap >= F.least(F.lit(LEAST), asked)) & (overlap + F.greatest("x.rest", "y.rest") >= asked)
        return pairs.filter(near & first & enough).select(*ends)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of candidate pairs the links: by the estimate from the sketches, then by the full sets."""
        pairs = overlaps = written(pairs, f"{name}-overlaps")
        ids = _ends(pairs, f"{name}-sketch-ids", "a", "b")
        own = _holding(sketch, ids)
        for x in "ab":
            pairs = pairs.join(own.select(F.col("id").alias(x), F.col("need").alias(f"c{x}"), F.col("sketch").alias(f"s{x}")), x)
        likely = written(pairs.filter(_likely(k, num, den)).select("a", "b"), f"{name}-pairs")
        drop_written(overlaps, ids)
        ids = _ends(likely, f"{name}-text-ids", "a", "b")
        texts = _holding(rows, ids)
        both = likely.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        out = written(both.select("a", "b", "ta", "tb").mapInArrow(_verifier(shingle, num, den), "a long, b long"), name)
        drop_written(likely, ids)
        return out

    # a document whose values stand in the longest lists is nearest to the middle of its group
    middle = written(lists.groupBy("node").agg(F.sum("size").alias("pop")), "middle")
    centre = lists.join(middle, "node").groupBy("value").agg(F.max(F.struct("pop", "node", "n", "left")).alias("y"))
    stars = lists.select("value", F.struct("node", "n", "left").alias("x")).join(centre, "value")
    links = verified(starred(stars), "stars")

    # members with one label are joined already
    found = connected_components(links, "star-labels")
    labelled = written(lists.drop("size").join(found, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    drop_written(lists, found)
    # lists across labels: members of other labels than the most frequent one, against all of other labels
    labels = labelled.groupBy("value", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("value")
    per = labels.agg(F.max_by("label", F.struct("m", "label")).alias("most"), F.count(F.lit(1)).alias("labels"), (F.sum("m") - F.max("m")).alias("outside")).filter("labels > 1")
    per = written(per.select("value", "most", "outside"), "per")
    heads = labelled.join(per, "value")
    # a sketch's values in lists: SKETCH at most
    own = labelled.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("own")).select("node", F.transform("own", lambda e: e["value"]).alias("own"))
    member = ["node", "n", "at", "left", "rest", "label", "own"]

    def across(heads: DataFrame) -> DataFrame:
        x = heads.filter("outer").select("value", F.struct(*member, "key").alias("x"))
        y = heads.select("value", F.struct(*member, "key", "outer").alias("y"))
        # a pair of two such members is there from both sides, and is taken from one
        once = ~F.col("y.outer") | (F.col("x.node") < F.col("y.node"))
        # pairs of one group are all in _grouped_pairs; members without a group are in none
        apart = ~F.coalesce(F.col("x.key") == F.col("y.key"), F.lit(False))
        return crossed(x.join(y, "value"), F.col("x.label") != F.col("y.label"), once, apart)

    short = heads.filter(F.col("outside") < OUTSIDERS).select(*labelled.columns, F.lit(None).cast("long").alias("key"), (F.col("label") != F.col("most")).alias("outer"))
    done = [middle, per]
    if per.filter(F.col("outside") >= OUTSIDERS).isEmpty():
        pairs = across(short.join(own, "node"))
    else:
        held = written(heads.filter(F.col("outside") >= OUTSIDERS).select(*labelled.columns), "long")
        groups = _groups(held, middle, rows, shingle)
        near = groups.filter(F.expr(f"node != c AND {den} * s >= {num} * (n + nc - s)"))
        links = links.union(written(near.select(F.col("node").alias("a"), F.col("c").alias("b")), "near"))
        keyed = written(held.join(groups.select("node", F.col("c").alias("key")), "node", "left").select(*labelled.columns, "key"), "keyed")
        main = keyed.filter("key IS NOT NULL").groupBy("value", "key").agg(F.count(F.lit(1)).alias("m")).groupBy("value").agg(F.max_by("key", F.struct("m", "key")).alias("main"))
        split = keyed.join(main, "value", "left").select(*labelled.columns, "key", (~F.coalesce(F.col("key") == F.col("main"), F.lit(False))).alias("outer"))
        # written apart: as one plan with the pairs of groups it had four times the stages of any other
        apart = written(across(short.union(split).join(own, "node")), "across")
        grouped = _grouped_pairs(groups, num, den)
        done += [held, groups, keyed, apart, grouped]
        pairs = apart.union(grouped).distinct()
    links = links.union(verified(pairs, "cross"))
    drop_written(labelled, nodes, *done)
    labels = connected_components(links if same_id is None else links.union(same_id))

    out = members.join(labels, "node", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("label", "node", "id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
