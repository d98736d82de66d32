import os
import time

import pytest

from larkspur.llm import common


def folders(spark, label):
    at = common.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return {n for n in os.listdir(at) if n.startswith(f"larkspur-{label}-")}


def test_tables_go_once_nothing_is_made_of_them(spark):
    old = folders(spark, "kept")  # of other sessions
    table = common.staged(spark.range(10), "kept")
    made = table.selectExpr("id * 2 AS twice").where("twice > 4")  # not read yet
    del table
    common.release(spark)
    still, n = folders(spark, "kept") - old, made.count()
    assert len(still) == 1
    assert n == 7
    del made
    for _ in range(20):
        spark.range(1).count()  # Spark's listeners hold the last query until the next
        common.release(spark)
        if not folders(spark, "kept") - old:
            return
        time.sleep(0.2)
    pytest.fail(f"the table stays: {common._held}")


def test_staging_keeps_its_own_tables(spark):
    old = folders(spark, "inner")
    with common.staging(spark):
        common.staged(spark.range(3), "inner")
        common.release(spark)
        assert len(folders(spark, "inner") - old) == 1
    assert folders(spark, "inner") == old
