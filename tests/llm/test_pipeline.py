import corpus_pipeline
from helpers import PLAIN, SMALL, TINY, clashing, odd, odd_rows, small
from nitlake.session import stored


def test_stages_narrow_and_keep_columns(spark):
    docs, before = small(spark), None
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), "stage")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and docs.count() == len(ids), name
        assert before is None or ids <= before
        before = ids
    items = [r.text for r in small(spark, "benchmark").collect()]
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept and not any(i in t for i in items for t in kept.values())
    assert all(len(t) <= len(texts[d]) and r for d, t in kept.items() for r in [t])
    seen = set()
    for own in sorted(kept):
        data = kept[own].encode()
        for at in range(len(data) - 99):
            assert (data[at : at + 100] not in seen) or texts[own] != kept[own]
            seen.add(data[at : at + 100])
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in pieces} == set(kept)


def test_odd_rows(spark):
    """Every stage takes nulls, empty texts, repeated rows and an empty table."""
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd(spark), odd(spark).limit(0)):
            assert stage(spark, docs, SMALL).count() <= max(len(odd_rows()), 200), name
    one = corpus_pipeline.near_dedup(spark, odd(spark), SMALL).collect()
    assert sorted(r.doc_id for r in one if r.doc_id in (1, 7, 9)) == [1]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """A near copy under the id of a unique text takes nothing from it, nor does a row that fails."""
    tail = " And so the river went on, past the mill and the old bridge, to the sea that nobody had seen."
    first, unique = PLAIN + tail * 6, " ".join(f"unique{i} word{i % 7}" for i in range(90))
    rows = [(1, first, "en", "s", 1), (7, first + " End.", "en", "s", 1), (7, unique, "en", "s", 1), (None, unique + " x y", "en", "s", 1), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, TINY)
    left = {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SMALL).collect()}
    assert left == {(1, first), (None, unique + " x y"), (7, "")}
    judged = corpus_pipeline.quality_rules(spark, docs, SMALL).collect()
    assert all(r.text for r in judged) and any(r.text == unique for r in judged)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    leaky = spark.createDataFrame([(7, f"x {item} y", "en", "s", 1), (7, unique, "en", "s", 1)], TINY)
    assert [r.text for r in corpus_pipeline.decontamination(spark, leaky, SMALL).collect()] == [unique]


def test_clashing_columns_stay(spark):
    wide = clashing(small(spark).limit(40))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, SMALL).columns == wide.columns, name
