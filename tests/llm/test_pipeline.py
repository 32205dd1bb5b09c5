import corpus_pipeline

from parley.llm import quality_classifier, secret_scan
from tests.llm.test_packing import check

DIR = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    """Each stage's result against a brute-force version of its decision."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "minhash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    model = quality_classifier.train(docs, quality_classifier.grades(spark.read.parquet(f"{DIR}/labels.parquet")))
    rows = docs.collect()
    top = {r.doc_id: model.tails(model.scores([r.text]))[0, -1] for r in rows}
    one = stages["quality classifier"](spark, docs, DIR)
    assert one.schema == docs.schema
    assert {r.doc_id for r in one.collect()} == {i for i, p in top.items() if p >= quality_classifier.LEAST}

    from tests.llm.test_near_dedup import brute

    two = stages["minhash near-dedup"](spark, one, DIR)
    classes = brute([(r.doc_id, r.text) for r in one.collect()])
    assert {r.doc_id for r in two.collect()} == set(classes.values()) and two.columns == docs.columns

    from tests.llm.test_decontamination import brute as leaks

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    three = stages["benchmark decontamination"](spark, two, DIR)
    small = [(r.doc_id, r.text) for r in two.collect() if len(r.text) < 1500]
    found = {d for d, _ in leaks(small, items)}
    assert {r.doc_id for r in three.collect()} & {d for d, _ in small} == {d for d, _ in small} - found

    four = stages["secret scans"](spark, three, DIR)
    before, after = ({r.doc_id: r for r in x.collect()} for x in (three, four))
    assert before.keys() == after.keys() and four.columns == docs.columns
    for i, r in after.items():
        spans = [(a, b) for a, _, b in secret_scan.base_spans(before[i].text)]
        assert r.n_chars == len(r.text) or not spans
        assert all(before[i].text[a:b] not in r.text for a, b in spans)

    from tokenizers import Tokenizer

    from parley.llm.queries import tokenizer_files

    five = stages["packing"](spark, four, DIR).collect()
    check(five, {i: r.text for i, r in after.items()}, Tokenizer.from_file(tokenizer_files()["tokenizer"]))


def test_run_and_awkward_rows(spark, awkward, nothing):
    assert corpus_pipeline.run(spark, DIR).count() > 0
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars", "kept")
    for rows in (docs, nothing.select(docs.columns)):
        out = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, DIR)
            assert out.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, out, DIR).count() >= 0


