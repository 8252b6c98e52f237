import re

import corpus_pipeline
from quadrille.llm import decontaminate, near_dedup, pii, quality
from quadrille.llm.common import documents


def test_stages_do_what_they_decide(spark, small):
    docs = documents(spark, small)
    before = docs.collect()
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, small).cache()
    assert good.columns == names
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    scores = {r.id: r.predicted for r in quality.score(docs, model).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}

    one = stages["near_dedup"](spark, good, small).cache()
    kept = {r.id for r in near_dedup.near_duplicates(good).collect() if r.kept}
    assert one.columns == names and {r.doc_id for r in one.collect()} == kept

    clean = stages["decontaminate"](spark, one, small).cache()
    found = {r.id for r in decontaminate.find(one, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == kept - found

    masked = stages["pii"](spark, clean, small).cache()
    assert masked.columns == names and masked.count() == clean.count()
    for r in masked.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)

    ids = stages["bpe"](spark, masked, small).collect()
    assert {r.doc_id for r in ids} == {r.doc_id for r in masked.collect()} and all(r.n_tokens == len(r.ids) for r in ids)
    assert len(before) > len(ids) > 0


def test_run_is_the_stages_in_a_row(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 0


def test_odd_rows_pass_through(spark, small, tmp_path):
    rows = [(1, "a b c", "en", "s", 3), (None, "d e f " * 9, None, None, None), (2, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "x y " * 400, "de", "t", 1)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() >= 3


def by_hand(docs, bench):
    """Ids that the near-duplicate and decontamination stages keep, from all pairs of word sets and plain edit distances."""
    from .test_near_dedup import brute
    from .test_other_ops import levenshtein_in

    kept = {int(i) for i, _, c in brute([(r.doc_id, r.text) for r in docs], 5, 80, 100) if i == c}
    items = [decontaminate.words_of(t) for _, t in bench]
    clean = set()
    for r in docs:
        words = decontaminate.words_of(r.text)
        near = [x for x in items if x and sum(w in set(words) for w in x) >= 0.8 * len(x)]
        if r.doc_id in kept and all(levenshtein_in(x, words) > len(x) * decontaminate.RATE for x in near):
            clean.add(r.doc_id)
    return kept, clean


def test_stages_against_brute_force(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark, small)
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept, clean = by_hand(docs.collect(), bench)
    one = stages["near_dedup"](spark, docs, small).cache()
    assert {r.doc_id for r in one.collect()} == kept
    assert {r.doc_id for r in stages["decontaminate"](spark, one, small).collect()} == clean


def test_one_row_of_each_id_stays_whatever_columns_are_called(spark, small):
    rows = [(1, "a b c d e f g", "x", "q", 1), (1, "a b c d e f g", "y", "p", 1), (2, "A b c d e f g", "z", "p", 1), (3, None, "u", "p", 1), (3, "", "u", "p", 1), (None, "h", "v", "p", 1), (None, "h", "v", "p", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string, GONE0 string, several int")
    got = corpus_pipeline.one_of_each(spark, docs, small)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None", "None"]


def test_import_errors_are_not_swallowed():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for f in [root / "corpus_pipeline.py", *(root / "quadrille" / "llm").glob("*.py")]:
        assert not re.search(r"except\s+(ImportError|ModuleNotFoundError)", f.read_text())
