"""Stages of the pipeline hold one slice of texts at a time in a worker, however large a batch is."""

import numpy as np
import pyarrow as pa

from motifdrift.llm import lang_id, line_dedup

MODEL = lang_id.Model(["en"], np.full((lang_id.BUCKETS, 1), -1, np.float32), np.ones((lang_id.OTHER + 1, 1), bool), np.full(lang_id.LETTERS, -8.0))


def test_large_batches_are_taken_in_slices(spark, monkeypatch):
    kind = type(spark.range(1))
    steps, real = [], kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, step, schema: steps.append((step, df.columns)) or real(df, step, schema))
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    lang_id.identified(docs, MODEL)
    line_dedup.with_kept_lines(docs)
    line_dedup.deduplicated_lines(docs)
    text = "A line of some length that is in a text.\n" * 2000  # 82 kB
    rows = {"doc_id": list(range(100)), "text": [None, *[text] * 99], "_lost_keys": [[]] * 100, "keys": [[]] * 100}
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "_lost_keys": pa.list_(pa.binary()), "keys": pa.list_(pa.binary())}
    found = 0
    for step, names in steps:
        if "text" not in names or not set(names) <= set(rows):
            continue
        batch = pa.record_batch([pa.array(rows[n], kinds[n]) for n in names], names)
        out = list(step(iter([batch])))
        if "doc_id" in out[0].schema.names and out[0].num_columns in (2, 5):
            found += 1
            assert max(b.nbytes for b in out) <= 5 << 19  # 2.5 MB of 8
            assert [x for b in out for x in b.column(0).to_pylist()] == rows["doc_id"][found == 1 :]  # without a letter, a text goes in the first
    assert found == 3
