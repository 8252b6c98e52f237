import itertools
import random
import re

from quadrille.llm import near_dedup as nd

from .conftest import ODD


def brute(rows, shingle, num, den):
    """{row place: component} with ids as vertices; sets of word tuples, all pairs."""
    def words(t):
        lower = "".join(c.lower() if c.isascii() else c for c in t or "")
        return [w for w in re.split(r"[\x20\x09-\x0d]+", lower) if w]

    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(i, s) for (i, _), s in zip(rows, sets) if i is not None and s], 2):
        if den * len(x & y) >= num * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return sorted((str(i), len(s), str(None if i is None else find(i))) for (i, _), s in zip(rows, sets))


def found(df):
    return sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_documents_against_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(nd.near_duplicates(docs, shingle=3, threshold=(85, 100))) == brute(rows, 3, 85, 100)


def test_odd_rows(odd, none):
    got = nd.near_duplicates(odd, shingle=3, threshold=(85, 100))
    assert found(got) == brute(ODD, 3, 85, 100)
    assert all(r.kept == (r.id is not None and r.id == r.component_id) for r in got.collect())
    assert nd.near_duplicates(none).collect() == []


def test_groups_of_edited_copies_short_texts_and_shared_passages(spark):
    """Chains of links, links that no star finds, and sets of a few shingles at the threshold."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(9999)}" for _ in range(150)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4, 5])):
            copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    for i in range(120, 180):
        rows.append((i, " ".join([*(f"u{draw.randrange(10**6)}" for _ in range(20)), *passage])))
    for i in range(180, 260):
        words = [f"s{k}" for k in range(draw.randrange(1, 14))]
        if draw.random() < 0.5:
            words[-1] = f"t{draw.randrange(3)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shingle, num in ((3, 85), (5, 80)):
        assert found(nd.near_duplicates(docs, shingle=shingle, threshold=(num, 100))) == brute(rows, shingle, num, 100)


def test_copies_just_under_the_threshold_are_not_compared_pair_by_pair(spark, monkeypatch):
    """A group whose members are mostly under the threshold to its middle: all links, and few pairs that go to the sketches."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(9999)}" for _ in range(400)]

    def edited(words, least, most):
        words = list(words)
        for _ in range(draw.randint(least, most)):
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice([[f"e{draw.randrange(10**6)}"], [f"e{draw.randrange(10**6)}"], [], [words[at], base[0]]])
        return words

    texts = [base] + [edited(base, 6, 20) for _ in range(260)]
    for start in [edited(base, 14, 20) for _ in range(8)]:  # copies of copies
        texts += [edited(start, 1, 9) for _ in range(5)]
    ids = draw.sample(range(1000), len(texts))
    rows = [(i, " ".join(w)) for i, w in zip(ids, texts)]
    rows += [(1000, rows[3][1]), (1000, rows[9][1]), (1001, rows[12][1]), (1001, "a text of its own")]
    kept, counts = nd.written, {}

    def counted(df, name):
        out = kept(df, name)
        if name.endswith("-overlaps"):
            counts[name] = out.count()
        return out

    monkeypatch.setattr(nd, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(docs, shingle=3, threshold=(85, 100))) == brute(rows, 3, 85, 100)
    assert counts["cross-overlaps"] < 15 * len(rows)


def test_no_plan_of_a_large_group_has_very_many_exchanges(spark, monkeypatch):
    """The driver holds the stages of a plan at a time: pairs of a large group come in steps, few links from one task."""
    draw = random.Random(17)
    base = [f"w{draw.randrange(9999)}" for _ in range(200)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(draw.randint(2, 10)):
            copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    kept, plans = nd.written, {}

    def planned(df, name):
        plans[name] = len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name)

    monkeypatch.setattr(nd, "written", planned)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_duplicates(docs, shingle=3, threshold=(85, 100))) == brute(rows, 3, 85, 100)
    assert "groups" in plans and max(plans.values()) <= 12 and sum(plans.values()) <= 60, plans


def test_an_id_with_two_texts_joins_their_groups(spark):
    a, b = "a b c d e f g h", "k l m n o p q r"
    docs = spark.createDataFrame([(5, a), (5, b), (3, a), (9, b), (7, "x y z")], "doc_id long, text string")
    got = {(r.id, r.component_id) for r in nd.near_duplicates(docs, shingle=3).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7)}


def test_components_by_one_task_and_by_rounds_are_the_same(spark, monkeypatch):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(500, 700)] + [(7, 7), (-5, 3), (2**62, 9)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for most in (nd.EDGES_A_TASK, 40):
        monkeypatch.setattr(nd, "EDGES_A_TASK", most)
        got = nd.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted((r.node, r.label) for r in got) == sorted((x, root(x)) for x in linked)
        assert nd.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.label for r in nd.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(50)}}


def test_the_chance_of_a_missed_pair_is_held():
    """Against exact fractions, for unions of every size that a set's near duplicates can have."""
    from fractions import Fraction
    from math import comb

    for num, k in ((80, 16), (85, 16), (85, 40)):
        for n in (1, 5, 13, 14, 16, 20, 45, 90):
            c = nd.fewest_shared(n, num, 100, k)
            for union in range(n, n * 100 // num + 1):
                shared = -(-num * union // 100)
                kept = min(k, union)
                low = range(max(0, kept - (union - shared)), min(c, kept + 1))
                assert sum(Fraction(comb(shared, i) * comb(union - shared, kept - i), comb(union, kept)) for i in low) <= Fraction(1, 10**8)
    assert nd.fewest_shared(10**9, 85, 100, 256) <= nd.fewest_shared(300, 85, 100, 256) <= 256
