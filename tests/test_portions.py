"""Functions in tasks take texts in portions of a bounded size."""

import pyarrow as pa

from vidimus.functions.tables import PORTION_BYTES, PORTION_WORDS, portions, text_batches


def test_portions_are_bounded_and_lose_no_row():
    texts = ["x" * 900_000] * 7 + [None, "", "y" * (3 * PORTION_BYTES), "z"]
    got = list(portions([pa.record_batch({"n": list(range(len(texts))), "text": pa.array(texts)})], "text"))
    assert [t for b in got for t in b.column("text").to_pylist()] == texts
    assert [n for b in got for n in b.column("n").to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= PORTION_BYTES for b in got)
    lists = [["a"] * (PORTION_WORDS // 2)] * 5 + [None, []]
    assert [b.num_rows for b in portions([pa.record_batch({"tokens": pa.array(lists, pa.list_(pa.string()))})], "tokens")] == [2, 2, 3]


def test_batches_of_texts_have_few_rows(spark):
    text_batches(spark.range(1))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000
