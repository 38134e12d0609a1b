"""Steps in Python hold few rows of a batch at a time."""

import pyarrow as pa

from tessera.functions import arrow, segment
from tessera.operators import chunking, lexical


def test_slices_keep_order_and_size():
    got = [s.to_pylist() for s in arrow.slices([pa.array(range(7)), pa.array([], pa.int64()), pa.array([9])], 3)]
    assert got == [[0, 1, 2], [3, 4, 5], [6], [9]]


def test_texts_of_a_batch_are_segmented_slice_by_slice(spark):
    texts = [None if i % 50 == 0 else f"One {i}.\n\n" * (i % 7) for i in range(3 * arrow.SLICE + 5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    got = [tuple(r) for r in chunking.chunks(docs).select("doc_id", "chunk_id", "char_offset", "text", "token_count").orderBy("doc_id", "chunk_id").collect()]
    assert got == [(i, k, *c) for i, t in enumerate(texts) for k, c in enumerate(segment.chunks(t or ""))]
    plan = chunking.chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_a_segment_keeps_no_texts():
    held = lexical._Held()
    for i in range(100):
        held.add([i], "same words here " * 50)
    assert not any("words here" in str(v) for v in vars(held).values()) and held.chars == 80_000
    assert len(held.at) == len(held.counts) == 300 and list(held.lens) == [150] * 100
