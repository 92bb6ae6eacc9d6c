"""Search by the index equals the scan of the texts, and does not read them."""

import pytest

from airloom.operators.search import search
from airloom.operators.search_index import build, search_index

TEXTS = [
    (1, "How does traffic increase?", "src"), (2, "Air-quality reports; airquality", "State_3"), (3, "", "src"), (4, None, "winter"), (5, "gas spikes, smog", None),
    (6, "how does TRAFFIC, increase", "x"), (7, "the of and", "who"), (7, "no2 no2 vehicles", "who"), (None, "severe decembers", "y"), (8, "flow tionx ction of", "ow"),
    (9, "x" * 3000 + " smog", "long"), (10, "Traffic increase? How does traffic increase? yes", "src"),
]
QUESTIONS = ["How does traffic increase?", "smog", "tion a gas", "ow", "ow did", "which is the", "winter air quality", "n", "traffic, increase", "zzzz"]


@pytest.fixture(scope="module")
def index(spark):
    return build(spark.createDataFrame(TEXTS, "doc_id long, text string, source string"))


@pytest.mark.parametrize("question", QUESTIONS)
@pytest.mark.parametrize("least", [0.2, -1])
def test_index_equals_scan(index, question, least):
    want = sorted(map(repr, map(tuple, search(index.docs, question, least=least).collect())))
    assert sorted(map(repr, map(tuple, search_index(index, question, least=least).collect()))) == want


def test_blank_question_and_empty_table(spark, index):
    assert search_index(index, " ").count() == search(index.docs, " ").count()
    none = build(index.docs.filter("false"))
    assert search_index(none, "smog").collect() == []


def test_a_second_question_reads_buckets_and_no_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = build(docs)
    for question in ("smog", "Which cities had severe smog?"):
        out = search_index(index, question)
        read = out.inputFiles()
        assert read and not any("documents" in f for f in read)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, search(docs, question).collect()))


def test_segments_are_sorted_and_grams_begin_once_per_character(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} tion{i} of stations", "src") for i in range(40)], "doc_id long, text string, source string")
    index = build(docs, tasks=3)
    postings = spark.read.parquet(index.postings)
    assert len(postings.inputFiles()) <= 3
    tokens = set()
    for file in postings.inputFiles():
        rows = [(r.bucket, r.token) for r in spark.read.parquet(file).coalesce(1).collect()]
        assert rows == sorted(rows)
        tokens |= {token for _, token in rows}
    assert spark.read.parquet(index.grams).count() <= sum(map(len, tokens))
    for file in spark.read.parquet(index.grams).inputFiles():
        grams = [r.gram for r in spark.read.parquet(file).coalesce(1).collect()]
        assert grams == sorted(grams)


def test_question_of_more_grams_than_ranges(spark, index):
    question = " ".join(f"{a}{b}q{b}x n" for a in "abcdefgh" for b in "rstuvwxyz") + " tion smog"
    want = sorted(map(tuple, search(index.docs, question, least=0.001).collect()), key=repr)
    assert want and sorted(map(tuple, search_index(index, question, least=0.001).collect()), key=repr) == want


def test_segments_follow_the_size_of_the_texts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        index = build(spark.range(400).selectExpr("id as doc_id", "concat('smog ', id) as text", "'src' as source"))
        assert len(spark.read.parquet(index.postings).inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert search_index(index, "smog").count() == 400


def test_words_are_cut_as_by_the_scan(spark):
    around = [chr(c) for c in [*range(1, 0x180), 0x2028, 0x3000, 0xE000, 0x1F600]]
    docs = spark.createDataFrame([(i, f"x smo{c}g{c}ti{c}on", f"{c}src") for i, c in enumerate(around)], "doc_id long, text string, source string")
    index = build(docs)
    for question in ("smog tion", "smo g", "gti"):
        want = sorted(map(tuple, search(docs, question).collect()))
        assert sorted(map(tuple, search_index(index, question).collect())) == want
