import pytest

from brute import jaccard_classes, near_copies
from scoutgrid.llm import jaccard_join


def outcome(spark, rows, k, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS class", "2 AS hub", "3 AS row")
    got = jaccard_join.joined(docs, k=k, percent=percent)
    return [(r["row"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_equals_all_pairs(spark, k, percent):
    rows = near_copies()
    assert ordered(outcome(spark, rows, k, percent)) == ordered(jaccard_classes(rows, k, percent))


def test_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 7)
    rows = near_copies(2, 3, 30)
    assert ordered(outcome(spark, rows, 3, 90)) == ordered(jaccard_classes(rows, 3, 90))


def test_repeated_rows_null_keys_and_empty_table(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text), (5, text), (None, text), (7, None), (None, None)]
    assert ordered(outcome(spark, rows, 3, 90)) == ordered([(5, 10, 5, 2), (5, 10, 5, 2), (None, 10, 5, 2), (7, 0, 7, 0), (None, 0, None, 0)])
    assert outcome(spark, [], 3, 90) == []
