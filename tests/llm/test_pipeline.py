import corpus_pipeline
from quillmart.llm import decontamination as d
from quillmart.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        assert after.count() <= before.count()
        seen.append((name, after))
        before = after
    good, lined, single, clean = (f for _, f in seen)
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    right = sum((marks[i] == 1) == (i in kept) for i in marks)
    assert right >= 0.95 * len(marks)
    texts = [r.text for r in lined.collect()]
    every = [s for t in texts for s in {x.strip().lower() for x in t.split("\n")} if s]
    assert len(every) == len(set(every))
    items = [d.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [1 for r in clean.collect() for p in items if p in d.normal(r.text)]
    assert {r.doc_id for r in single.collect()} - {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if any(p in d.normal(r.text) for p in items)}
    pieces = corpus_pipeline.packed(spark, clean, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean.collect()}
    assert all(len(r.ids) == r.length for r in pieces)
    assert quality.THRESHOLD == 0.7


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _quality_score double, component_id long"
    rows = [(1, None, None, None, None, 1.0, 1), (2, "", "en", "s", 0, None, 2), (2, "", "en", "s", 0, None, 2), (None, "Some text", "en", "s", 9, None, 3), (3, "The long words of it " * 9000, "en", "s", 1, None, 4)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            if "component_id" not in out.columns:
                assert sum(r.length for r in got if r.start == 0 and r.doc_id == 2) == docs.where("doc_id = 2").count()  # an empty text is its end id
                continue
            assert out.columns == docs.columns and all(tuple(r) in {tuple(x) for x in data} for r in got)
            docs = spark.createDataFrame(got, schema)
