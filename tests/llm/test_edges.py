"""Nulls, empty and repeated rows, and columns named like the operators' own, for every operator on documents."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_operators import prose

from millrace.llm import byte_bpe, difference_cover, hyperminhash, licence_sentences, pseudo_likelihood, repair_grammar, robust_outliers, secret_forest, template_windows

CLASHING = (
    "h", "h1", "h2", "n", "k", "k1", "k2", "r", "t", "s1", "s2", "node", "component", "leader", "key", "name", "position", "alone", "anchors", "range", "shard", "payload", "counts", "words", "codes", "place", "start",
    "n_shingles", "sketch", "ids", "decoded", "glang", "gsource", "v1", "d2", "bin", "cut", "code", "total", "ll", "mode", "raw", "typed", "slots", "capital", "item_id", "__t", "x", "value", "text_hash",
)
ITEM = "the first of many words of this question is how far a train goes when it is late by an hour"


def rows():
    texts = [None, "", " ", "one two", *[prose(i, 60) for i in range(12)], prose(3, 60) + " end", ITEM, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and MIT License.", "Released under the MIT License."]
    out = [(None if i % 7 == 5 else i, t, "en" if i % 2 else None, None if i % 5 == 0 else "s") for i, t in enumerate(texts)]
    return [*out, *out[:9], (3, prose(77, 70), "en", "s"), (None, None, None, None)]


def likelihood(docs):
    return pseudo_likelihood.score(docs).select("doc_id", "n_words")


BENCHMARK = [(1, ITEM), (None, ITEM + " or more"), (3, None)]
OPERATORS = {
    "secrets": secret_forest.report, "licences": licence_sentences.licences, "likelihood": likelihood, "quality": robust_outliers.quality_rules,
    "bpe": lambda d: byte_bpe.round_trip(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), "repeats": difference_cover.without_repeats,
    "ids": lambda d: repair_grammar.read(repair_grammar.write(d, P.path("word_bpe_49k.json"))), "copies": hyperminhash.near_duplicates,
    "templates": lambda d: template_windows.contaminated(d, d.sparkSession.createDataFrame(BENCHMARK, "item_id long, text string")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_without_values_and_clashing_columns(spark, name):
    plain = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").coalesce(2)
    run = OPERATORS[name]
    wanted = sorted(map(repr, run(plain).collect()))
    assert len(wanted) == (2 if name == "templates" else len(rows()))
    if name != "likelihood":
        clash = plain.withColumns({c: F.lit("c") for c in CLASHING})
        assert sorted(map(repr, run(clash).collect())) == wanted
    assert run(plain.where("false")).collect() == []
