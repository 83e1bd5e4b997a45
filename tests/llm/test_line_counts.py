"""The count array of a shard decides whether a key is dropped."""

import numpy as np
import pytest

from textloom.llm.line_dedup import Shard, Shards, build_shards


@pytest.mark.parametrize("min_docs", [2, 3, 5])
def test_probes_read_the_counts(spark, min_docs):
    rows = [(i * 7919 + 1, i * 104729 + 3, i % 6 + 1, 100) for i in range(60)]
    found = build_shards(spark.createDataFrame(rows, "hi long, lo long, n_docs long, last_id long"), 1).collect()
    hi, lo, n_docs, last = (np.array(c, np.int64) for c in zip(*rows))
    data = {r["shard"]: bytes(r["data"]) for r in found}
    for ids in (last - 1, last):
        expected = (n_docs >= min_docs) & (ids != last)
        assert (Shard(data[0]).drops(hi, lo, ids, min_docs) == expected).all()
        assert (Shards(1, data, min_docs).drops(hi, lo, ids) == expected).all()
