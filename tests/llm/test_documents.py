"""The operators over documents against plain versions: the small table, a table of odd cases, and an empty one."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crossover.llm import bpe, decontaminate, language_id, line_dedup, line_quality, minhash, packing, substring_dedup, token_files
from crossover.llm.common import BATCH_BYTES, id_back, read, written
from tests.conftest import SMALL, rows
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, v string, h string, bucket int, unit int"
_RANDOM = random.Random(5)
VOCABULARY = ["".join(_RANDOM.choice("abcdeénß") for _ in range(_RANDOM.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60, 1)
LINE = "This very line stands in many documents."
ODD = [
    (None, f"{prose(30, 2)} {PASSAGE}\n{LINE}"),
    (1, None),
    (2, ""),
    (3, " \n\t\r\x0b\x0c \n"),
    (4, prose(40_000, 3)),
    (5, f"{PASSAGE}\n{LINE}\n{LINE}  \nshort"),
    (5, f"{PASSAGE}\n{LINE}\n{LINE}  \nshort"),
    (6, "one two three"),
    (6, "quite another text under the same id"),
    (7, f"\t{LINE.upper()}\n{prose(50, 4)}"),
    (8, prose(50, 4) + " more"),
    (-9, "a b c <|endoftext|> d  e\n\nf\x1cg \x00 ​ \U0001f44d\U0001f3fd it's we'll 12 3.4"),
    (10, "x y " * 200),
    (11, "日本語。"),
    (12, prose(400, 9)),
    (13, prose(400, 9) + " tail"),
    (14, prose(400, 9).upper()),
]
ITEMS = [(0, prose(25, 1)), (1, None), (2, "  "), (3, "One, TWO three"), (3, "One, TWO three"), (None, prose(400, 9)[-120:]), (11, "another text")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "en", "s", None, 7, "v", "h", 1, 1) for d, t in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return read(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def small_rows(small):
    return [(r.doc_id, r.text) for r in small.collect()]


def test_decontaminate(spark, odd, none, small, small_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute.decontaminate(ODD, ITEMS), key=str)
    got = decontaminate.decontaminate(odd, items).drop("id", "v")
    assert rows(got) == want and any(r[5] for r in want)
    # the test set in many blocks
    assert rows(decontaminate.decontaminate(odd, items, block_bytes=300).drop("id", "v")) == want
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(odd, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0
    bench = read(spark, SMALL, "benchmark")
    assert rows(decontaminate.decontaminate(small, bench).drop("id", "v")) == sorted(brute.decontaminate(small_rows, [(r.item_id, r.text) for r in bench.collect()]), key=str)


def test_repeated_items_are_one(spark):
    items = spark.createDataFrame([(i, f"item number {i}") for i in range(5)] + [(9, "the same item again")] * 200, "item_id long, text string")
    blocks = list(decontaminate.test_blocks(items, 1000))
    assert len(blocks) == 1 and sorted(blocks[0]) == sorted([(str(i), f"item number {i}") for i in range(5)] + [("9", "the same item again")])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta very gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    hits = lambda slop: [r.doc_id for r in decontaminate.decontaminate(docs, items, slop=slop).where("contaminated").orderBy("doc_id").collect()]
    assert hits(0) == [2] and hits(1) == [1, 2]


def test_line_dedup(odd, none, small, small_rows):
    want = brute.line_dedup(ODD)
    got = line_dedup.line_report(odd)
    assert rows(got) == sorted(((d, n, gone, brute.sha(t)) for d, n, gone, t in want), key=str)
    assert sum(w[2] for w in want) >= 3
    cleaned = line_dedup.cleaned(odd)
    assert cleaned.columns == odd.columns
    assert rows(cleaned.select("doc_id", "text", "n_chars")) == sorted(((d, None, None) if o is None else (d, t, len(t)) for (d, _, _, t), (_, o) in zip(want, ODD)), key=str)
    assert line_dedup.line_report(none).count() == 0
    assert rows(line_dedup.line_report(small)) == sorted(((d, n, gone, brute.sha(t)) for d, n, gone, t in brute.line_dedup(small_rows)), key=str)


def test_line_dedup_chunks(spark):
    """Keys that chunks settle by themselves, keys that only the stream settles, and the largest id among both."""
    lines = [f"line number {i} is long enough to count" for i in range(40)]
    r = random.Random(1)
    docs = [(d, "\n".join(r.sample(lines, 12))) for d in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    assert rows(line_dedup.line_report(df)) == sorted(((d, n, gone, brute.sha(t)) for d, n, gone, t in brute.line_dedup(docs)), key=str)


def test_near_dedup(odd, none):
    got = minhash.near_components(odd).select(id_back().alias("d"), "n_shingles", "component")
    want = brute.near_dedup(ODD)
    assert rows(got) == sorted(want, key=str)
    four = minhash.near_components(odd, 4).select(id_back().alias("d"), "n_shingles", "component")
    assert rows(four) == sorted(brute.near_dedup(ODD, 4), key=str)
    assert minhash.near_components(none).count() == 0


def test_near_dedup_blocks(spark, monkeypatch):
    """A group of near copies over many blocks: every pair of blocks is compared."""
    base = prose(60, 11).split()
    r = random.Random(2)
    docs = []
    for d in range(90):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        docs.append((d, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = minhash.near_components(spark.createDataFrame(docs, "doc_id long, text string")).select("id", "n_shingles", "component")
    want = brute.near_dedup(docs)
    assert rows(got) == sorted(want, key=str) and 1 < len({w[2] for w in want}) < 90


def test_near_dedup_shared_ids(spark, monkeypatch):
    """Texts under one doc_id are documents of their own: near copies among them go but one, a different text stays."""
    base = prose(200, 21)
    copies = [f"{base} {prose(1, 30 + i)} number {i}" for i in range(6)]
    near, apart, other = f"{prose(80, 22)} end", prose(80, 23), prose(80, 22)
    docs = [(None, t) for t in copies] + [(None, prose(50, 24)), (3, near), (7, apart), (7, other), (8, other), (8, other)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    reps = minhash.written(minhash.classes(minhash.written(minhash.signatures(df), "signatures")), "classes")
    ways = minhash.units(reps.select("c", "n_shingles", F.lit(0).alias("component")))
    assert ways.count() == ways.select("c", "unit").distinct().count() == reps.count() == 10
    got = minhash.near_report(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == sorted([("None", "None", False)] * 5 + [("None", "None", True)] * 2 + [("3", "3", True), ("7", "7", True), ("7", "3", False), ("8", "3", False), ("8", "3", False)])
    kept = [tuple(r) for r in corpus_pipeline.one_of_each(spark, df, SMALL).collect()]
    assert len(kept) == 4 and {(None, prose(50, 24)), (3, near), (7, apart)} < set(kept) and sum(t in copies for _, t in kept) == 1
    monkeypatch.setattr(minhash, "BLOCK", 2)
    assert minhash.near_report(df).where("kept").count() == 4


def test_signature_estimates_similarity():
    import numpy as np

    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
    y = np.concatenate([x[:800], r.integers(0, 1 << 63, 200, dtype=np.uint64)])
    same = (minhash.signature(np.unique(x)) == minhash.signature(np.unique(y))).mean()
    assert abs(same - 800 / 1200) < 0.12
    assert len(minhash.signature(x)) == 2 * minhash.PERMUTATIONS


def test_substring_dedup(odd, none, small, small_rows):
    want = brute.substring_dedup(ODD)
    assert rows(substring_dedup.substring_report(odd)) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 300
    assert substring_dedup.substring_report(none).count() == 0
    assert rows(substring_dedup.substring_report(small)) == sorted(brute.substring_dedup(small_rows), key=str)


def test_substring_dedup_hot(spark, monkeypatch):
    """A passage of a third of all documents, with every minimiser taken as hot: windows travel one by one, the result stays."""
    docs = [(d, f"{prose(20, 100 + d)} {PASSAGE if d % 3 == 0 else ''} {prose(20, 500 + d)}") for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    want = sorted(brute.substring_dedup(docs), key=str)
    assert rows(substring_dedup.substring_report(df)) == want
    monkeypatch.setattr(substring_dedup, "plan_buckets", lambda d: (7, 0))
    assert rows(substring_dedup.substring_report(df)) == want


def test_token_files(odd, none, small, small_rows):
    for df, given in ((odd, ODD), (small, small_rows)):
        ordered = sorted(zip(given, brute.tokens(given, 0)), key=lambda x: brute.order(x[0][0]))
        got = token_files.token_report(df).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(i), brute.crc(i)) for (d, _), i in ordered)
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [d for (d, _), _ in ordered]
    assert token_files.token_report(none).count() == 0
    table = token_files.segments(odd)
    ids = {(r.doc_id, tuple(r.tokens)) for r in token_files.read_documents(table, with_ids=True).collect()}
    assert ids == {(d, tuple(i.tolist())) for (d, _), i in zip(ODD, brute.tokens(ODD, 0))}


def test_packing(odd, none, small, small_rows):
    for df, given in ((odd, ODD), (small, small_rows)):
        n = brute.check_packing([tuple(r) for r in packing.pack(df).collect()], given)
        assert n <= 1 + 1.02 * sum(map(len, brute.tokens(given, 2))) / 1024
    assert packing.pack(none).count() == 0


def test_bounded_batches(spark, small, monkeypatch):
    """Token ids are made from small Arrow batches, and the session's setting comes back."""
    seen, before = [], spark.conf.get(BATCH_BYTES)
    for module in (packing, token_files):
        monkeypatch.setattr(module, "written", lambda df, name: seen.append(spark.conf.get(BATCH_BYTES)) or written(df, name))
    packing.pack(small)
    token_files.token_report(small)
    assert [int(x) for x in seen] == [bpe.CALL_BYTES] * 2 and spark.conf.get(BATCH_BYTES) == before


def test_whole_texts_in_parts(monkeypatch):
    """Texts that go to the library whole go there in parts of bounded size, with the same ids."""
    encoder, calls = bpe.PieceEncoder(public_tokenizers.path(packing.TOKENIZER)), []
    texts = [f"two  spaces {i} " + "word " * (i % 7) for i in range(500)] + ["plain text", None, ""]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    plain = encoder._encode
    monkeypatch.setattr(bpe, "WHOLE_BYTES", 1000)
    monkeypatch.setattr(encoder, "_encode", lambda some: calls.append(sum(map(len, some))) or plain(some))
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == want
    assert len(calls) > 10 and max(calls) < 1100


def test_plan_of_lengths():
    import numpy as np

    r = np.random.default_rng(4)
    for size in (16, 64):
        for _ in range(30):
            counts = np.zeros(size + 1, dtype=np.int64)
            for x in r.integers(1, size + 1, 200):
                counts[x] += 1
            used = np.zeros(size + 1, dtype=np.int64)
            for lengths, times in packing.plan(counts):
                assert times > 0 and sum(lengths) <= size
                for x in lengths:
                    used[x] += times
            assert (used == counts).all()
    # exact complements before best fit: 6 + 4, not 6 + 3
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 4, 3, 7]] = 1
    assert sorted(packing.plan(counts)) == [((6, 4), 1), ((7, 3), 1)]


def test_language(spark, odd, none):
    df = read(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.language_report(df)
    truth = df.select("doc_id", "lang").join(got, "doc_id").where("held_out")
    n, right = truth.count(), truth.where("lang = lang_pred").count()
    assert right >= 0.97 * n and n > 100
    assert got.where("score < 0 or score > 1").count() == 0 and got.count() == df.count()
    report = language_id.language_report(odd)
    assert {r.doc_id for r in report.where("lang_pred = 'und'").collect()} == {1, 2, 3}
    assert report.count() == len(ODD) and language_id.accepted(odd).columns == odd.columns
    assert language_id.language_report(none).count() == 0
    unlabelled = language_id.language_report(odd.drop("lang").selectExpr("*", "cast(null as string) as lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_quality(odd, none):
    got = line_quality.quality_report(odd).collect()
    assert len(got) == len(ODD) and line_quality.quality_report(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[10].base_failed and by[10].n_repeat_words == 400 and not by[1].kept and by[1].n_words == 0
    assert by[5].n_dup_lines == 0 and by[5].n_failed_lines == 2 and not by[5].kept  # its long passage ends without a mark


def test_quality_rules():
    rule = lambda s: line_quality.failed_rule(s.encode(), s.encode().split(), len("".join(s.split())))
    assert rule("This is a plain sentence.") is None
    assert rule("Home » About » Contact us today.") == "navigation"
    assert rule("Buy### now$$$ all%%% of*** it.") == "symbols"
    assert rule("Copyright 2020, All Rights Reserved.") == "boilerplate"
    assert rule("no mark at the end") == "punctuation"
    assert rule("Fin ! Voilà « tout »") is None
