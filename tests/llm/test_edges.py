"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from pulsemill.llm import (decontaminate, exact_dedup, language, line_dedup, pieces, queries, secrets, sharding, simhash,
                           toxicity, url_filter)
from pulsemill.llm.common import stored

LONG = "A very long line of words that goes on. " * 20_000
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "Same text\nin two rows, more than once."), (5, "Same text\nin two rows, more than once."),
       (None, "No id here"), (None, None), (7, "\x00 odd ▁ signs \U0001F600 ſ K İ"), (8, "x" * 50_000)]
MODEL = pieces.load_model(queries.PIECE_MODEL)
GRAMMAR = toxicity.Grammar(words={"idiot": 1.5})

OPERATORS = {
    "exact": lambda d, b: exact_dedup.exact_dedup(d),
    "pieces": lambda d, b: pieces.sample_segmentations(d, MODEL, k=1),
    "encode": lambda d, b: pieces.encode(d, MODEL),
    "shards": lambda d, b: sharding.assign_shards(d, 100),
    "toxicity": lambda d, b: toxicity.score_toxicity(d, GRAMMAR),
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "urls": lambda d, b: url_filter.judge_urls(d, id_col="doc_id", url_col="text"),
    "language": lambda d, b: language.identify_language(d, {"en": "the cat sat", "fr": "le chat est"}),
    "no language": lambda d, b: language.identify_language(d, {}),
    "secrets": lambda d, b: secrets.scan_secrets(d),
}
FILTERS = {
    "toxic": lambda d, b: toxicity.drop_toxic(d, GRAMMAR),
    "leaks": lambda d, b: decontaminate.drop_contaminated(d, b),
    "lines": lambda d, b: line_dedup.drop_copied_lines(stored(d, "t")),
    "near": lambda d, b: simhash.drop_near_duplicates(stored(d, "t")),
}


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "tiny"), (4, "a passage that no odd text holds anywhere")], "item_id long, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs_of, benchmark, name):
    assert OPERATORS[name](docs_of(ODD), benchmark).count() == len(ODD)
    assert OPERATORS[name](docs_of([]), benchmark).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(docs_of, benchmark, name):
    docs = docs_of(ODD)
    out = FILTERS[name](docs, benchmark)
    assert out.dtypes == docs.dtypes
    assert 0 < out.count() <= len(ODD)
    assert FILTERS[name](docs_of([]), benchmark).count() == 0


def test_rows_that_may_be_missing(docs_of, benchmark):
    for docs in (docs_of(ODD), docs_of([])):
        assert decontaminate.find_passages(docs, benchmark).count() == 0
        assert decontaminate.find_passages(docs, benchmark.limit(0)).count() == 0
        line_dedup.judge_lines(stored(docs, "t")).collect()


def test_learning_from_nothing(docs_of, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    grammar = toxicity.learn_grammar(docs_of(ODD), labels)
    assert not grammar.words and not grammar.prefixes
    assert {r.predicted for r in toxicity.score_toxicity(docs_of(ODD), grammar).collect()} == {0}
    assert language.sample_texts(docs_of([])) == {}


def test_stage_functions_chain(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, folder), "stage")
        assert 0 < out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
            docs = out
