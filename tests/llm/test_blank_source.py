"""Sources without a word take nothing and lose nothing of the others."""

import pytest
from pyspark.sql import functions as F

from fleetfootprint.llm import mixing

BLANK = [(1, None, "blank"), (2, "", "blank"), (3, " \t", "blank"), (4, "", None)]


@pytest.mark.parametrize("others", [[], [(5, "a b c", "s"), (6, "d e", "t")]])
def test_blank_source_takes_nothing(spark, others):
    docs = spark.createDataFrame([(*r, 0) for r in BLANK + others], "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: r for r in mixing.assign_positions(docs).collect()}
    assert len(out) == len(BLANK) + len(others)
    assert all(out[i].taken == 0 and out[i].target == 0 and out[i].occurrences == [] for i, *_ in BLANK)
    assert sum(r.taken for r in out.values()) == sum(len(t.split()) for _, t, _ in others)
    mixed = mixing.mixed_documents(docs)
    # whole documents: each source is within half of its one document of its target
    for doc_id, text, source in others:
        words = mixed.filter(F.col("source") == source).select(F.sum(mixing.word_count(F.col("text")))).first()[0] or 0
        assert abs(words - out[doc_id].target) <= len(text.split()) / 2 + 1 and words % len(text.split()) == 0
    assert mixed.filter(~F.col("doc_id").isin([i for i, *_ in others] or [0])).count() == 0
