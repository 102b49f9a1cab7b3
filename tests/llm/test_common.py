import os

import numpy as np

from cuelake.llm.common import batch_rows, clear_scratch, drop_table, free_names, materialise, scratch_dir, session_batches, squeeze, unsqueeze


def test_scratch_tables_go(spark):
    folder = scratch_dir(spark)
    before = set(os.listdir(folder))
    one, two = materialise(spark.range(5).toDF("a")), materialise(spark.range(0).toDF("a"))
    assert one.count() == 5 and two.count() == 0 and len(set(os.listdir(folder)) - before) == 2
    drop_table(one)
    assert len(set(os.listdir(folder)) - before) == 1
    clear_scratch(spark)
    assert not set(os.listdir(folder)) - before


def test_batch_setting_is_given_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "500")
        with batch_rows(spark, 100):
            assert spark.conf.get(key) == "100"
            with batch_rows(spark, 1000):
                assert spark.conf.get(key) == "100"  # a shorter one stays
        assert spark.conf.get(key) == "500"
        session_batches(spark)
        assert spark.conf.get(key) == "500"
    finally:
        spark.conf.set(key, before)


def test_free_names():
    assert free_names(["Score", "_score", "x"], "score", "lang") == ["__score", "lang"]


def test_squeezed_numbers_come_back():
    for x in (np.array([], np.uint64), np.array([1, 2**63, 5], np.uint64)):
        assert unsqueeze(squeeze(x), np.uint64, 8).tolist() == x.tolist()
    paths = np.arange(-24, 24, dtype=np.int8).reshape(6, 8)
    assert (unsqueeze(squeeze(paths), np.int8, 8) == paths).all()
