"""What the driver holds: numbers of a model, and no plans for frequent keys where there are none."""

import tracemalloc

import pytest

pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from lumenfold.llm import common, language_id, near_dedup  # noqa: E402


def test_training_brings_no_words_to_the_driver(spark):
    """Per entry the driver needs a few numbers, not the entry's text, which is several times as large."""
    word = F.translate(F.hex(F.xxhash64("k")), "0123456789", "ghijklmnop")
    docs = spark.range(200_000).withColumnRenamed("id", "k").groupBy(F.floor(F.col("k") / 100).alias("doc_id")).agg(
        F.array_join(F.collect_list(word), " ").alias("text"), F.lit("en").alias("lang")
    )
    tracemalloc.start()
    try:
        model = language_id.train(docs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    entries = len(model.tables[0].hashes)
    assert 100_000 < entries < 200_000
    assert peak / entries < 120  # bytes


def test_no_frequent_key_no_dealing(spark, monkeypatch):
    counts = spark.createDataFrame([(k, 1 + k % 3) for k in range(20)], "k long, n long")
    rows = counts.select("k", F.explode(F.sequence(F.lit(1), "n")).alias("row"))
    one = counts.select("k", (10 * F.col("k")).alias("tenfold"))
    assert common.hot_keys(counts, ["k"]) is None and common.hot_keys(counts.limit(0), ["k"]) is None
    plain = common.salted_join(rows, one, ["k"], None, ["row"])
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    hot = common.hot_keys(counts, ["k"])
    dealt = common.salted_join(rows, one, ["k"], hot, ["row"])
    assert hot.count() == 13 and plain.columns == dealt.columns
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect()))


def test_places_in_buckets_with_and_without_frequent_keys(spark, monkeypatch):
    """Each bucket numbers its members from 0 without gaps, whether or not it is dealt over tasks."""
    members = spark.createDataFrame([(key, rep, 9, rep % 3) for key in range(4) for rep in range(2 + 5 * key)], "key long, rep long, n long, at long")
    for frequent in (False, True):
        monkeypatch.setattr(common, "HOT_ROWS", 4 if frequent else 1024)
        got = near_dedup._numbered(members)
        assert {*got.columns} == {"key", "rep", "n", "at", "salts", "salt", "rank"}
        found = got.collect()
        assert frequent == any(r["salts"] > 1 for r in found)
        for key in range(4):
            assert sorted(r["rank"] for r in found if r["key"] == key) == list(range(2 + 5 * key))
