"""The pipeline against the plain versions, stage by stage and as a whole."""

import corpus_pipeline
from crossover.llm import language_id
from crossover.llm.common import read
from tests.conftest import SMALL, rows
from tests.llm import brute


def test_pipeline(spark):
    docs = read(spark, SMALL, "documents")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    model = language_id.Model(language_id.fit(docs.where(~language_id.held_out())))
    known = [(d, t) for d, t in given if model.judge(t)[2] >= language_id.MARGIN]
    assert 0.9 * len(given) < len(known) <= len(given)
    fresh = [(d, None if t is None else cut) for (d, t), (_, _, _, cut) in zip(known, brute.line_dedup(known))]
    unique = [r for r, (_, _, c) in zip(fresh, brute.near_dedup(fresh)) if c == brute.order(r[0])]
    items = [(r.item_id, r.text) for r in read(spark, SMALL, "benchmark").collect()]
    clean = [r for r, found in zip(unique, brute.decontaminate(unique, items)) if not found[5]]
    want = [known, fresh, unique, clean]
    now = docs
    for (name, stage), rest in zip(corpus_pipeline.STAGES, want):
        now = stage(spark, now, SMALL)
        assert now.columns == docs.columns, name
        assert rows(now.select("doc_id", "text")) == sorted(rest, key=str), name
    assert now.where("n_chars <> length(text)").count() == 0
    brute.check_packing([tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()], clean)


def test_odd_rows_pass_all_stages(spark):
    # columns with names that the stages might want for themselves, one of them with a dot
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, v int, __id string, __v int, __dropped int, __key int, `a.b` int"
    more = (None, 1, 1, 1, 1)
    data = [(None, None, None, None, None, None, None, "u0", *more[1:]), (1, "", "en", "a", 0, 1, 1, "u1", *more[1:]), (2, "the same words here", None, None, None, 1, 1, "u2", *more[1:]),
            (2, "the same words here", None, None, None, 1, 1, "u2", *more[1:]), (3, "x" * 50_000, "en", "b", 5, 1, 1, "u3", *more[1:])]
    for rest in (data, []):
        docs = spark.createDataFrame(rest, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, docs, SMALL)
            if name != "packing":
                assert out.columns == docs.columns
                assert {r["__id"] for r in out.collect()} == {r[7] for r in rest}
                docs = out
        assert out.select("doc_id").distinct().count() == len({r[0] for r in rest})


def test_language_stage_without_labels(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rest in ([(1, "some words", None, "a", 10), (2, None, None, None, None), (2, None, None, None, None)], []):
        docs = spark.createDataFrame(rest, schema)
        assert rows(corpus_pipeline.STAGES[0][1](spark, docs, SMALL)) == rows(docs)
    # repeated texts are one text of the sample
    labelled = spark.createDataFrame([(i, "only one text " * 40, "xx", "s", 9) for i in range(200)] + [(500 + i, f"text number {i} " + "abc " * i, "xx", "s", 9) for i in range(70)], schema)
    words = language_id.fit(labelled)["xx"]
    assert words.count(b" only one text ") <= 42 and words.count(b" text number ") >= 60
    many = spark.createDataFrame([(i, f"text {i}", f"l{i:05d}", "s", 9) for i in range(1100)], schema)
    assert sorted(language_id.fit(many)) == [f"l{i:05d}" for i in range(1000)]
