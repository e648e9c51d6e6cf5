"""Pipeline stages on empty tables and clashing columns, and what the run leaves on disk."""

import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from fleetfootprint.llm.frames import free_name
from fleetfootprint.session import own_folder

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = stage(spark, empty, "")
    assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


def test_clashing_columns_pass_through(spark, docs):
    clash = docs.withColumns({"_found": F.col("doc_id") * 2, "__found": F.lit("kept"), "_spans": F.lit(1), "Found": F.lit(2)}).drop("found")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, clash, "")
        assert out.columns == clash.columns and dict(out.dtypes)["_found"] == "bigint", name
        rows = out.select("doc_id", "_found", "__found", "_spans").collect()
        assert rows and all(r["__found"] == "kept" and r["_spans"] == 1 and (r.doc_id is None or r["_found"] == 2 * r.doc_id) for r in rows), name


def test_free_names():
    assert free_name(["a", "_B"], "b") == "b" and free_name(["a", "_B", "B"], "b") == "__b" and free_name([], "x") == "x"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_run_leaves_its_result_only(spark):
    folder = own_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(folder)) - before
    assert out.count() > 0 and len(left) == 1 and left.pop().startswith("pipeline-packing")
