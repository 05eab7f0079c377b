"""The pipeline: every stage on awkward rows, and the whole of it on the given documents."""

from collections import Counter

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["row", "key", "n", "n_lines", "copies", "lang_pred", "score", "known", "first", "text_hash", "rep", "salt"]
TEXTS = [f"The quick brown fox number {k} went over the hill and found {k} other animals there, {'very ' * k}happy" for k in range(30)]
COPY = "This text of more than five words is found in the very same form in several documents"
ROWS = [
    *[(k, t, "en" if k % 2 else None, "abc"[k % 3], len(t)) for k, t in enumerate(TEXTS)],
    *[(100 + k, COPY, "en", "a", 1) for k in range(5)], (104, COPY, "en", "a", 1), (200, None, "en", "a", None), (201, "", None, None, 0), (202, " \n\t ", "en", "b", 3),
    (None, COPY + " again and again", "en", None, 1), (203, "word " * 30_000, "en", "c", 1), (204, "12 34 !?", "en", "c", 1), (205, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in EXTRA})


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_a_stage_keeps_columns_and_clean_rows(spark, odd, name, stage):
    got = stage(spark, odd, SF)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in odd.schema]
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in EXTRA)
    known = Counter((r[0], r[1]) for r in ROWS)
    found = Counter((r["doc_id"], r["text"]) for r in rows)
    if name == "language_id":  # only what holds no letter goes
        gone = {200, 201, 202, 204, 205}
        assert found == Counter({k: n for k, n in known.items() if k[0] not in gone})
    elif name == "line_dedup":  # no line is on three sites
        assert found == known
    elif name == "near_dedup":  # copies go but for the least id, whose row is not repeated; similar texts are one group
        copies = {101, 102, 103, 104}
        assert not copies & {i for i, _ in found} and found[100, COPY] == 1
        assert {200, 201, 202, 203, 204, 205, None, 0} <= {i for i, _ in found}
    else:  # mixing: a row is there as often as taken
        assert set(found) <= set(known) and all(n <= 2 * known[k] for k, n in found.items())
    assert stage(spark, odd.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "packing"])
def test_rows_go_to_python_in_small_batches(spark, odd, name):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["bytes"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dict(corpus_pipeline.STAGES)[name](spark, odd.limit(0), SF)
    rows = spark.range(0, 5000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))  # 20 MB
    assert rows.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0] < 8 << 20


def test_the_last_stage(spark, odd):
    name, stage = corpus_pipeline.STAGES[-1]
    got = stage(spark, odd, SF).collect()
    whole = {}
    for r in got:
        whole.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in whole.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(r[0] for r in ROWS)
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_whole_pipeline(spark):
    """Every document of the result passed all stages, whole; packing keeps each token of it once."""
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), kept.schema)
    got = corpus_pipeline.run(spark, SF)
    assert Counter(r["doc_id"] for r in got.where("start = 0").collect()) == Counter(r["doc_id"] for r in kept.collect())
    assert max(r[1] for r in got.groupBy("sequence_id").agg(F.sum("length")).collect()) <= 4096
